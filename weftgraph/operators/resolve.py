"""Resolution of calls and imports between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import call_key


def resolvable(nodes: DataFrame) -> DataFrame:
    """Code nodes whose label is a symbol: not empty and not the name of a file."""
    name = r"(?i)\.(py|js|ts|tsx|jsx|go|rs|java|rb|md|json)$"
    return nodes.filter((F.col("file_type") == "code") & (F.trim("label") != "") & ~F.col("label").rlike(name))


def resolve_calls(nodes: DataFrame, edges: DataFrame, calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """``calls`` edges for raw calls (caller, callee, is_member, source_file) whose callee names one node only.

    Member calls, calls of oneself and pairs already linked give nothing.  With
    ``evidence`` (source_file, id), an import of the target, a call is EXTRACTED with
    score 1.0, otherwise INFERRED with 0.8.
    """
    unique = resolvable(nodes).groupBy(call_key(F.col("label")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst")).filter("n = 1 AND key <> ''").select("key", "dst")
    raw = calls.filter("NOT is_member").select(F.col("caller").alias("src"), F.lower("callee").alias("key"), "source_file")
    hit = raw.join(unique, "key").filter("src <> dst").join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    seen = evidence.select("source_file", F.col("id").alias("dst"), F.lit(True).alias("known")).distinct()
    out = hit.join(seen, ["source_file", "dst"], "left").groupBy("src", "dst").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("known"), F.min("source_file").alias("source_file"))
    return out.select("src", "dst", F.lit("calls").alias("relation"), F.when(F.col("known"), "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.when(F.col("known"), 1.0).otherwise(0.8).alias("confidence_score"), "source_file")


def import_guided_calls(symbols: DataFrame, aliases: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of imported names: (file, local name) to (module, symbol), to the one node with these.

    ``symbols`` has module, symbol and id; ``aliases`` file, local, module and symbol; ``calls`` caller, callee, file.
    """
    unique = symbols.groupBy("module", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst")).filter("n = 1")
    named = calls.join(aliases, (calls.file == aliases.file) & (calls.callee == aliases.local)).select(calls.caller.alias("src"), "module", "symbol")
    return named.join(unique, ["module", "symbol"]).filter("src <> dst").select("src", "dst", F.lit("calls").alias("relation")).distinct()


def class_imports(classes: DataFrame, imports: DataFrame) -> DataFrame:
    """``uses`` edges from every class of an importing file to each imported entity.

    ``classes`` has file and id, ``imports`` file and target id.
    """
    return classes.join(imports, "file").filter("id <> target").select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight")).distinct()


def merge_extensions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extension nodes (``is_extension``) folded into the only type with their label, in any file."""
    types = nodes.filter("NOT is_extension").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("to")).filter("n = 1")
    move = nodes.filter("is_extension").join(types, "label").select(F.col("id").alias("old"), "to")
    e = edges
    for end in ("src", "dst"):
        e = e.join(move, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("to", end)).drop("old", "to")
    return nodes.join(move.select(F.col("old").alias("id")), "id", "left_anti"), e.filter("src <> dst")


def java_imports(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """``imports`` edges from files (file, name, line), name as in ``a.b.Type``, to the nodes labelled with the type.

    ``static`` and a member after the type are skipped, and wildcards and names without a node give nothing.
    """
    types = nodes.filter(F.col("label").rlike(r"^\p{Lu}") & ~F.col("label").rlike(r"(\)|\.java)$") & (F.coalesce("source_file", F.lit("")) != "")).select("label", F.col("id").alias("dst"))
    name = F.regexp_replace(F.trim("name"), r"^static\s+", "")
    parts = F.split(name, r"\.")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    # a member in lower case belongs to the type before it
    type_name = F.when(last.rlike(r"^\p{Ll}") & before.isNotNull(), before).otherwise(last)
    asked = imports.filter(~name.endswith(".*")).select(F.col("file").alias("src"), "line", type_name.alias("label"))
    hit = asked.join(types, "label").filter("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("line"))
    return hit.select("src", "dst", F.lit("imports").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location"))


def joined_path(folder: Column, path: Column) -> Column:
    """``path`` seen from ``folder``, without ``.`` and ``..``."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(up, "/"))


def shell_sources(files: DataFrame, sources: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """``imports_from`` edges between scripts, and ``calls`` edges of functions that a sourced script defines.

    ``files`` has path and id; ``sources`` path and target, relative to the script's folder; ``functions`` the file id,
    name and id; ``calls`` the file id, caller and callee.  A name that several sourced scripts define gives nothing.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    at = sources.filter(F.trim("target") != "").withColumn("to", joined_path(folder, F.col("target")))
    by_path = files.select(F.col("path").alias("to"), F.col("id").alias("dst"))
    linked = at.join(files.select("path", F.col("id").alias("src")), "path").join(by_path, "to").filter("src <> dst").select("src", "dst").distinct()
    defined = functions.select(F.col("file").alias("dst"), F.col("name").alias("callee"), F.col("id").alias("fn"))
    seen = linked.join(defined, "dst").select(F.col("src").alias("file"), "callee", "fn").distinct()
    one = seen.groupBy("file", "callee").agg(F.count(F.lit(1)).alias("n"), F.min("fn").alias("fn")).filter("n = 1")
    own = functions.select("file", F.col("name").alias("callee"))  # a script's own function comes first
    hits = calls.join(own, ["file", "callee"], "left_anti").join(one, ["file", "callee"]).filter("caller <> fn").select(F.col("caller").alias("src"), F.col("fn").alias("dst")).distinct()
    return linked.withColumn("relation", F.lit("imports_from")).union(hits.withColumn("relation", F.lit("calls")))


def star_reexports(exports: DataFrame, stars: DataFrame, longest: int = 20) -> DataFrame:
    """(module, name, origin): names that modules offer, their own (module, name) and those of modules
    they pass on with a star (module, target), followed up to ``longest`` steps; a name of a module's own comes first."""
    from ..store import stored

    known = stored(exports.select("module", "name", F.col("module").alias("origin"), F.lit(0).alias("far")).distinct(), "exports")
    for step in range(1, longest + 1):
        passed = stars.join(known.filter(F.col("far") == step - 1).withColumnRenamed("module", "target"), "target").select(stars.module, "name", "origin")
        new = passed.distinct().join(known.select("module", "name").distinct(), ["module", "name"], "left_anti")
        new = stored(new.groupBy("module", "name").agg(F.min("origin").alias("origin")).withColumn("far", F.lit(step)), "exports")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known.select("module", "name", "origin")
