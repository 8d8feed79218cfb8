import json

from pyspark.sql import functions as F

from weftgraph.operators import analyze, build
from weftgraph.sinks import cypher, graphs, notes
from weftgraph.sources import extract as X
from weftgraph.sources import graphs as G


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_node_link_reader(spark, tmp_path):
    g = {"directed": False, "nodes": [{"id": "a", "label": "A", "source": "a.py"}, {"id": "b", "name": "B", "source_file": "b.py", "community": 2}], "links": [{"from": "a", "to": "b", "relation": "calls"}, {"source": "a"}], "hyperedges": [{"id": "h", "nodes": ["a", "b"]}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    n, e, h = G.read_node_link(spark, str(tmp_path / "g.json"))
    assert rows(n, "id", "label", "source_file", "ord") == [("a", "A", "a.py", 0), ("b", "B", "b.py", 1)]
    assert rows(e, "src", "dst", "relation", "confidence") == [("a", "b", "calls", "EXTRACTED")]
    assert rows(h, "id", "members") == [("h", ["a", "b"])]


def test_symbol_index(spark):
    sym = lambda s, rel=(), line=None: {"symbol": s, "display_name": s.upper(), "relationships": list(rel), "occurrences": [{"range": [line, 0, 3], "symbol": s}] if line is not None else []}
    doc = {"documents": [{"relative_path": "a.py", "symbols": [sym("x", [{"symbol": "y", "is_implementation": True}, {"symbol": "ext", "is_reference": True}, {"symbol": "z"}], 4), sym("y")]}, {"relative_path": "b.py", "symbols": [sym("y"), sym("only", [{"symbol": "x", "is_type_definition": True, "is_reference": True}])]}]}
    n, e = G.symbol_index(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    ids = {(r["source_file"], r["label"]): r["id"] for r in n.collect()}
    assert len(ids) == 5 and n.filter("source_location = 'L5'").count() == 1
    assert rows(e, "src", "dst", "relation") == sorted([(ids["a.py", "X"], ids["a.py", "Y"], "scip_impl"), (ids["a.py", "X"], ids[None, "ext"], "scip_ref"), (ids["b.py", "ONLY"], ids["a.py", "X"], "scip_typed")])


def test_server_configs_never_show_values(spark):
    cfg = {"mcpServers": {"Git Hub": {"command": "npx", "args": ["-y", "@scope/server-x@1.2"], "env": {"API_TOKEN": "hush"}}, "plain": {"command": "uvx"}}}
    n, e = G.server_configs(spark.createDataFrame([(".mcp.json", json.dumps(cfg))], "path string, content string"))
    assert "hush" not in str(n.collect()) + str(e.collect())
    assert sorted(r["label"] for r in n.filter("file_type = 'concept'").collect()) == ["@scope/server-x", "API_TOKEN", "npx", "uvx"]
    assert e.filter("relation = 'requires_env'").count() == 1 and e.count() == 4


SAMPLES = {
    "pkg/app.py": 'import os\nfrom lib.util import helper\n\nclass Base: pass\n\nclass App(Base):\n    def run(self):\n        """Start it."""\n        helper()\n        self.stop()\n\ndef main():\n    App()\n',
    "db/schema.sql": "CREATE TABLE org (id INT);\nCREATE TABLE users (id INT, org INT REFERENCES org(id));\nCREATE VIEW v AS SELECT * FROM users JOIN org ON 1=1;\nCREATE TRIGGER t AFTER INSERT ON users BEGIN SELECT 1; END;",
    "doc/a.md": "# Top\n## Sub\nsee [b](b.md)\n```\n# not a heading\n```\n# Next\n",
    "conf/p.json": '{"name": "x", "dependencies": {"left-pad": "1"}, "a": {"$ref": "#/defs/q"}} // note',
    "src/m.ts": "import { x } from './util';\nexport class Store {}\nexport async function load(a) {\n  fetchAll(a);\n}\n",
    "src/M.java": "import java.util.List;\npublic class M {\n  public void go(int a) {\n    work();\n  }\n}\n",
    "src/m.go": 'import "fmt"\ntype S struct {}\nfunc (s S) Run() {\n  helper()\n}\n',
    "src/m.rs": "use std::fmt;\npub struct P;\npub fn build() {\n  run();\n}\n",
    "src/m.c": '#include "m.h"\nint add(int a, int b) {\n  return sum(a);\n}\n',
    "src/m.rb": "require 'json'\nclass Dog\n  def bark\n    noise(1)\n  end\nend\n",
    "src/bad.py": "def (:\n",
    "proj.csproj": '<Project><ItemGroup><PackageReference Include="Lib.One" /></ItemGroup></Project>',
    "x.unknown": "nothing",
}


def test_extractors(spark):
    out = X.extract(spark.createDataFrame(list(SAMPLES.items()), "path string, content string")).cache()
    n, e, c = X.nodes_of(out), X.edges_of(out), X.calls_of(out)
    labels = {(r["source_file"], r["label"]) for r in n.collect()}
    assert {("pkg/app.py", "App"), ("pkg/app.py", ".run()"), ("pkg/app.py", "main()"), ("pkg/app.py", "Start it."), ("db/schema.sql", "users"), ("doc/a.md", "Sub"), ("src/m.ts", "Store"), ("src/m.ts", "load()"), ("src/M.java", "M"), ("src/M.java", "go()"), ("src/m.go", "S"), ("src/m.go", "Run()"), ("src/m.rs", "P"), ("src/m.rs", "build()"), ("src/m.c", "add()"), ("src/m.rb", "Dog"), ("src/m.rb", "bark()")} <= labels
    assert ("doc/a.md", "not a heading") not in labels
    rel = {(r["source_file"], r["relation"]) for r in e.collect()}
    assert {("pkg/app.py", "inherits"), ("pkg/app.py", "imports_from"), ("pkg/app.py", "rationale_for"), ("pkg/app.py", "method"), ("db/schema.sql", "references"), ("db/schema.sql", "reads_from"), ("db/schema.sql", "triggers"), ("doc/a.md", "references"), ("conf/p.json", "imports"), ("conf/p.json", "references"), ("src/m.ts", "imports_from"), ("proj.csproj", "imports")} <= rel
    calls = {(r["callee"], r["is_member"]) for r in c.collect()}
    assert {("helper", False), ("stop", True), ("fetchAll", False), ("work", False), ("run", False), ("sum", False), ("noise", False)} <= calls
    assert rows(out.filter("kind = 'error'"), "source_file") == [("src/bad.py",)]


def graph(spark):
    n = spark.createDataFrame([("a", "It's \"A\"", "code", "a.py", 0), ("b", "B", "code", "b.py", 0), ("c", "b", None, None, 1)], "id string, label string, file_type string, source_file string, community int")
    e = spark.createDataFrame([("a", "b", "calls", "EXTRACTED", None, None, 1.0, "a.py", 0), ("b", "c", "weird-rel", "INFERRED", 0.7, None, 2.0, "b.py", 1)], "src string, dst string, relation string, confidence string, confidence_score double, context string, weight double, source_file string, ord long")
    return n, e, build.collapse_edges(e)


def test_scripts_and_markup(spark, tmp_path):
    import xml.etree.ElementTree as ET

    n, _, s = graph(spark)
    lines = [r[0] for r in cypher.statements(n, s).collect()]
    assert "MERGE (n:Code {id: 'a', label: 'It\\'s \"A\"'});" in lines and "MERGE (n:Unknown {id: 'c', label: 'b'});" in lines
    assert any("[:WEIRDREL {confidence: 'INFERRED'}]" in x for x in lines)
    graphs.write_graphml(n, s, str(tmp_path / "g"))
    doc = ET.fromstring("\n".join(r[0] for r in spark.read.text(str(tmp_path / "g")).collect()))
    assert len(doc.findall(".//{*}node")) == 3 and len(doc.findall(".//{*}edge")) == 2
    graphs.write_node_link(n, s, str(tmp_path / "j"))
    back, links, _ = G.read_node_link(spark, str(tmp_path / "j"))
    assert back.count() == 3 and rows(links, "src", "dst", "confidence_score") == [("a", "b", 1.0), ("b", "c", 0.7)]


def test_tables_refuse_to_shrink(spark, tmp_path):
    import pytest

    n, e, _ = graph(spark)
    p = str(tmp_path / "t")
    graphs.write_tables(n, e, p)
    with pytest.raises(graphs.ShrinkError):
        graphs.write_tables(n.limit(1), e, p)
    graphs.write_tables(n.limit(1), e, p, force=True)
    assert spark.read.parquet(p + "/nodes").count() == 1
    r = str(tmp_path / "r")
    graphs.register(n, "east", r)
    graphs.register(n, "west", r)
    graphs.register(n.limit(2), "east", r)
    assert rows(spark.read.parquet(r).groupBy("repo").count()) == [("east", 2), ("west", 3)]
    assert graphs.unregister(spark, "east", r).count() == 3


def test_notes_and_report(spark):
    n, _, s = graph(spark)
    art = dict(rows(notes.community_articles(n, s)))
    assert art.keys() == {"Community_0.md", "Community_1.md"} and "cohesion 1.00" in art["Community_0.md"] and "[[Community 1]] (1 shared" in art["Community_0.md"]
    note = dict(rows(notes.node_notes(n, s)))
    assert note.keys() == {"It's A.md", "B.md", "b_1.md"} and "- [[b_1]] - `weird-rel` [INFERRED]" in note["B.md"]
    text = notes.report(n, s)
    assert "3 nodes · 2 edges · 2 communities" in text and "50% EXTRACTED" in text
    cards, top = notes.canvas(n, s, edges=1)
    assert cards.count() == 3 and rows(top, "src") == [("b",)]
    assert analyze.degree(s).agg(F.sum("degree")).first()[0] == 4


def test_game_sources_and_forms(spark):
    files = {"g/a.dm": '#include "b.dm"\n/obj/item\n/obj/item/proc/use(mob/m)\n\tdo_it(1)\n', "g/m.dmm": '"aa" = (/turf/floor,/obj/item)\n', "g/f.dfm": "object Main: TForm\n  object Ok: TButton\n  end\nend\n", "g/w.dmf": 'window "main"\n'}
    out = X.extract(spark.createDataFrame(list(files.items()), "path string, content string")).cache()
    assert out.filter("kind = 'error'").count() == 0
    assert {("g/a.dm", "use()"), ("g/f.dfm", "Ok"), ("g/w.dmf", "main")} <= {(r["source_file"], r["label"]) for r in X.nodes_of(out).collect()}
    assert {("turf_floor", "references"), ("obj_item", "references")} <= set(rows(X.edges_of(out), "dst", "relation"))


def test_pointers_answers_and_prompt(spark, tmp_path):
    import datetime as dt

    from weftgraph.sources import pointers as P

    f = spark.createDataFrame([("a.gdoc", '{"url": "https://docs.google.com/document/d/abc/edit?resourcekey=k1", "email": "m"}'), ("b.gsheet", '{"resource_id": "sheet:xyz"}'), ("c.gdoc", "{}"), ("d.gdoc", '{"doc_id": "1", "url": "x?id=2"}')], "path string, content string")
    assert rows(P.workspace_pointers(f), "path", "file_id", "resource_key", "account") == [("a.gdoc", "abc", "k1", "m"), ("b.gsheet", "xyz", None, None), ("d.gdoc", "1", None, None)]
    a = spark.createDataFrame([("What is it?", "This.", dt.datetime(2024, 1, 2, 3, 4, 5), ["n1", "n2"])], "question string, answer string, asked_at timestamp, nodes array<string>")
    P.save_answers(a, str(tmp_path / "m"))
    P.save_answers(a, str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m")).collect()
    assert len(got) == 2 and got[0]["path"] == "query_20240102_030405_what_is_it.md" and "- n2" in got[0]["content"]
    gods = spark.createDataFrame([("a", "A", 3), ("b", "B", 9)], "id string, label string, degree int")
    assert P.transcription_prompt(gods) == "Technical discussion about B, A. Use proper punctuation and paragraph breaks."


def test_diagram_parts(spark):
    from weftgraph.operators import diagram as D

    n, e, _ = graph(spark)
    assert [r["id"] for r in D.diagram_nodes(n, e, 2).orderBy("place").collect()] == ["a", "b"]
    flow = spark.createDataFrame([("s1", "s2", 3), ("s1", "s3", 5)], "src_section string, dst_section string, edges int")
    assert D.flow_chain(["s3", "s2", "s1"], flow) == ["s1", "s3", "s2"]
    assert rows(D.call_table(n, e), "id", "callers", "callees")[1] == ("b", 'It\'s "A"', "")
    t = spark.createDataFrame([(str(i), x, "code", "f.py", 0) for i, x in enumerate(["_p", "b", "A", "f.py", "c"])], n.schema)
    assert [r["name"] for r in D.symbol_tree(t, 2).orderBy("place").collect()] == ["A", "b", "(+2 more)"]
