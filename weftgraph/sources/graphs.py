"""Graph files and index files as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = "struct<id:string,label:string,name:string,file_type:string,type:string,source_file:string,source:string,file:string,source_location:string,community:int,norm_label:string,repo:string,local_id:string>"
_EDGE = "struct<source:string,target:string,`from`:string,to:string,src:string,dst:string,relation:string,type:string,label:string,confidence:string,confidence_score:double,context:string,weight:double,source_file:string,source_location:string>"
GRAPH = f"struct<directed:boolean,multigraph:boolean,nodes:array<{_NODE}>,links:array<{_EDGE}>,edges:array<{_EDGE}>,hyperedges:array<struct<id:string,label:string,nodes:array<string>,relation:string,confidence:string,confidence_score:double,source_file:string>>>"
#: Files larger than this are refused.
MAX_BYTES = 512 << 20


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and hyperedges of node-link JSON files; ``links`` or ``edges``, and the usual
    other names of fields, are accepted.  ``ord`` is the position in the file."""
    sizes = spark.read.format("binaryFile").load(path).select("length")
    if sizes.filter(F.col("length") > MAX_BYTES).limit(1).count():
        raise ValueError(f"a graph file exceeds {MAX_BYTES} bytes")
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", GRAPH).alias("g")).select("g.*")
    return parts(raw)


def parts(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = raw.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*").filter("id IS NOT NULL")
    nodes = n.select("id", F.coalesce("label", "name", "id").alias("label"), F.coalesce("file_type", "type").alias("file_type"), F.coalesce("source_file", "source", "file").alias("source_file"), "source_location", "norm_label", "community", "repo", "local_id", F.col("ord").cast("long").alias("ord"))
    e = raw.select(F.posexplode(F.coalesce("links", "edges")).alias("ord", "e")).select("ord", "e.*")
    edges = e.select(F.coalesce("source", "from", "src").alias("src"), F.coalesce("target", "to", "dst").alias("dst"), F.coalesce("relation", "type", "label").alias("relation"), F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), "confidence_score", "context", "weight", "source_file", "source_location", F.col("ord").cast("long").alias("ord")).filter("src IS NOT NULL AND dst IS NOT NULL")
    hyper = raw.select(F.explode("hyperedges").alias("h")).select("h.*").withColumnRenamed("nodes", "members")
    return nodes, edges, hyper


SYMBOLS = "array<struct<relative_path:string,language:string,symbols:array<struct<symbol:string,kind:string,display_name:string,relationships:array<struct<symbol:string,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean,is_reference:boolean>>,occurrences:array<struct<range:array<int>,symbol:string>>>>>>"


def symbol_index(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a symbol index: rows with ``json``, an object with ``documents``.

    A relationship leads to the symbol of its own document, else to the only one of that
    name anywhere, else to an external stub.  Only literal true flags count; an
    implementation goes before a type, a definition and a reference.
    """
    docs = raw.select(F.explode(F.from_json(F.get_json_object("json", "$.documents"), SYMBOLS)).alias("d")).select("d.*")
    s = docs.select("relative_path", "language", F.explode("symbols").alias("s")).select("relative_path", "language", "s.*").filter("symbol IS NOT NULL AND symbol <> ''")
    node_id = lambda p, x: F.concat(F.lit("scip_"), F.substring(F.sha1(F.concat_ws("|", p, x)), 1, 16))
    line = F.get(F.get("occurrences", 0)["range"], 0)
    nodes = s.select(node_id(F.col("relative_path"), F.col("symbol")).alias("id"), F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")), "symbol").alias("label"), F.lit("code").alias("file_type"), F.col("relative_path").alias("source_file"), F.when(line.isNotNull(), F.concat(F.lit("L"), (line + 1).cast("string"))).alias("source_location"), "symbol", "kind")
    r = s.select("relative_path", "symbol", F.explode("relationships").alias("r")).select("relative_path", "symbol", F.col("r.symbol").alias("to"), "r.is_implementation", "r.is_type_definition", "r.is_definition", "r.is_reference").filter("to IS NOT NULL AND to <> ''")
    rel = F.when(F.col("is_implementation"), "scip_impl").when(F.col("is_type_definition"), "scip_typed").when(F.col("is_definition"), "scip_def").when(F.col("is_reference"), "scip_ref")
    local = nodes.select(F.col("source_file").alias("relative_path"), F.col("symbol").alias("to"), F.col("id").alias("here")).distinct()
    unique = nodes.groupBy(F.col("symbol").alias("to")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("there")).filter("n = 1")
    e = r.withColumn("relation", rel).filter("relation IS NOT NULL").join(local, ["relative_path", "to"], "left").join(unique, "to", "left")
    stub = F.concat(F.lit("scip_ext_"), F.substring(F.sha1("to"), 1, 16))
    edges = e.select(node_id(F.col("relative_path"), F.col("symbol")).alias("src"), F.coalesce("here", "there", stub).alias("dst"), "relation", F.lit("EXTRACTED").alias("confidence"), F.col("relative_path").alias("source_file"), "to").distinct()
    stubs = edges.filter(F.col("dst").startswith("scip_ext_")).select(F.col("dst").alias("id"), F.col("to").alias("label"), F.lit("concept").alias("file_type"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("source_location")).distinct()
    return nodes.drop("symbol", "kind").unionByName(stubs), edges.drop("to")


def server_configs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of server configurations (path, content): servers, commands, packages and
    names of environment variables.  Values of variables are never read."""
    servers = F.from_json(F.get_json_object("content", "$.mcpServers"), "map<string,struct<command:string,args:array<string>,env:map<string,string>>>")
    s = files.select("path", F.explode(F.map_entries(servers)).alias("e")).select("path", F.col("e.key").alias("name"), "e.value.command", "e.value.args", F.map_keys("e.value.env").alias("env"))
    package = F.regexp_replace(F.get(F.filter("args", lambda a: ~a.startswith("-") & a.rlike("^(@[\\w.-]+/)?[\\w.-]+(@[\\w.^~-]+)?$")), 0), r"(?<=.)@[^@/]+$", "")
    key = lambda kind, c: F.concat(F.lit(f"mcp_{kind}_"), F.lower(F.regexp_replace(c, r"[^\w]+", "_")))
    server = F.concat(key("server", F.col("path")), F.lit("_"), F.lower(F.regexp_replace("name", r"[^\w]+", "_")))
    edge = lambda df, kind, c, rel: df.select(server.alias("src"), key(kind, c).alias("dst"), F.lit(rel).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("path").alias("source_file"), c.alias("label"))
    out = edge(s.filter("command IS NOT NULL"), "command", F.col("command"), "references")
    out = out.union(edge(s.withColumn("package", package).filter("package IS NOT NULL"), "package", F.col("package"), "references"))
    out = out.union(edge(s.withColumn("var", F.explode("env")), "env", F.col("var"), "requires_env")).distinct()
    nodes = s.select(server.alias("id"), F.col("name").alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file")).union(out.groupBy("dst").agg(F.min("label").alias("label")).select(F.col("dst").alias("id"), "label", F.lit("concept").alias("file_type"), F.lit(None).cast("string").alias("source_file")))
    return nodes, out.drop("label")
