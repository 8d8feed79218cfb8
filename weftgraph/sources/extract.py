"""Extraction of nodes, edges and raw calls from source files.

An extractor is a function from (path, text) to a fragment; a registry maps file suffixes to
extractors, and more can be registered.  ``extract`` runs them over a table of files,
one batch of files at a time, and never fails on a single file: its error becomes a row.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Fragment:
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)

    def node(self, key: str, label: str, path: str, line: int | None = None, kind: str = "code") -> str:
        self.nodes.append({"id": key, "label": label, "file_type": kind, "source_file": path, "source_location": f"L{line}" if line else None})
        return key

    def edge(self, src: str, dst: str, relation: str, path: str, line: int | None = None, context: str | None = None) -> None:
        self.edges.append({"src": src, "dst": dst, "relation": relation, "confidence": "EXTRACTED", "context": context, "source_file": path, "source_location": f"L{line}" if line else None})

    def call(self, caller: str, callee: str, member: bool, path: str, line: int | None = None) -> None:
        self.calls.append({"caller": caller, "callee": callee, "is_member": member, "source_file": path, "source_location": f"L{line}" if line else None})


def make_id(*parts: str) -> str:
    text = "_".join(p.strip("_.") for p in parts if p)
    return re.sub("_+", "_", re.sub(r"[^\w]+", "_", text)).strip("_").lower()


def stem_of(path: str) -> str:
    head, _, name = path.rpartition("/")
    stem = name.rsplit(".", 1)[0] or name
    return f"{head.rpartition('/')[2]}.{stem}" if head else stem


def _file(f: Fragment, path: str, kind: str = "code") -> tuple[str, str]:
    stem = stem_of(path)
    return stem, f.node(make_id(stem), path.rpartition("/")[2], path, 1, kind)


def python(path: str, text: str) -> Fragment:
    """Imports, classes with their bases, functions and methods, and the calls in them."""
    f = Fragment()
    stem, root = _file(f, path)
    tree = ast.parse(text)

    def calls(body, owner: str) -> None:
        for sub in ast.walk(body):
            if isinstance(sub, ast.Call):
                fn = sub.func
                if isinstance(fn, ast.Name):
                    f.call(owner, fn.id, False, path, sub.lineno)
                elif isinstance(fn, ast.Attribute):
                    f.call(owner, fn.attr, True, path, sub.lineno)

    def walk(items, owner: str, cls: str | None) -> None:
        for item in items:
            if isinstance(item, ast.Import):
                for a in item.names:
                    f.edge(root, make_id(a.name), "imports", path, item.lineno, "import")
            elif isinstance(item, ast.ImportFrom):
                f.edge(root, make_id((item.module or "").rpartition(".")[2] or "."), "imports_from", path, item.lineno, "import")
            elif isinstance(item, ast.ClassDef):
                key = f.node(make_id(stem, item.name), item.name, path, item.lineno)
                f.edge(owner, key, "contains", path, item.lineno)
                for b in item.bases:
                    name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
                    if name:
                        f.edge(key, make_id(stem, name), "inherits", path, item.lineno)
                walk(item.body, key, item.name)
            elif isinstance(item, ast.FunctionDef | ast.AsyncFunctionDef):
                label = f".{item.name}()" if cls else f"{item.name}()"
                key = f.node(make_id(stem, cls or "", item.name), label, path, item.lineno)
                f.edge(owner, key, "method" if cls else "contains", path, item.lineno)
                calls(item, key)
                doc = ast.get_docstring(item)
                if doc:
                    f.edge(f.node(make_id(stem, cls or "", item.name, "rationale"), doc.split("\n")[0], path, item.lineno, "rationale"), key, "rationale_for", path, item.lineno)

    walk(tree.body, root, None)
    return f


def sql(path: str, text: str) -> Fragment:
    """Tables, views, functions and triggers; foreign keys, reads and triggers as edges."""
    f = Fragment()
    stem, root = _file(f, path)
    clean = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    name = r'(?:IF\s+NOT\s+EXISTS\s+)?["`\[]?([\w.]+)["`\]]?'
    key_of = lambda n: make_id(stem, n.rpartition(".")[2])
    for m in re.finditer(rf"(?is)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP\w*\s+|MATERIALIZED\s+)?(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER)\s+{name}(.*?)(?=\bCREATE\b|\Z)", clean):
        kind, what, body = m.group(1).upper(), m.group(2), m.group(3)
        line = clean.count("\n", 0, m.start()) + 1
        short = what.rpartition(".")[2]
        key = f.node(key_of(what), f"{short}()" if kind in ("FUNCTION", "PROCEDURE") else short, path, line)
        f.edge(root, key, "contains", path, line)
        relations = [("references", rf"(?is)\bREFERENCES\s+{name}")] if kind == "TABLE" else [("reads_from", rf"(?is)\b(?:FROM|JOIN)\s+{name}")]
        if kind == "TRIGGER":
            relations = [("triggers", rf"(?is)\bON\s+{name}")]
        for rel, rx in relations:
            for to in dict.fromkeys(x.group(1) for x in re.finditer(rx, body)):
                if key_of(to) != key:
                    f.edge(key, key_of(to), rel, path, line)
    return f


def markdown(path: str, text: str) -> Fragment:
    """Headings by level and links to other files; fenced code is skipped."""
    f = Fragment()
    stem, root = _file(f, path, "document")
    stack, fence = [(0, root)], False
    for no, line in enumerate(text.split("\n"), 1):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        if fence:
            continue
        m = re.match(r"(#{1,6})\s+(.+?)\s*#*$", line)
        if m:
            depth = len(m.group(1))
            while stack[-1][0] >= depth:
                stack.pop()
            key = f.node(make_id(stem, m.group(2)), m.group(2), path, no, "document")
            f.edge(stack[-1][1], key, "contains", path, no)
            stack.append((depth, key))
        for to in re.findall(r"\[[^\]]*\]\(([^)#\s]+)", line):
            if not re.match(r"[a-z]+:", to):
                f.edge(stack[-1][1], make_id(stem_of(to)), "references", path, no)
    return f


def json_file(path: str, text: str) -> Fragment:
    """Keys down to the second level, dependencies as imports, $ref as references."""
    f = Fragment()
    stem, root = _file(f, path)
    data = json.loads(re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S))

    def walk(value, owner: str, trail: tuple[str, ...]) -> None:
        for k, v in value.items() if isinstance(value, dict) else ():
            if k == "$ref" and isinstance(v, str):
                f.edge(owner, make_id(stem, v.rpartition("/")[2]), "references", path)
            elif k.lower().endswith("dependencies") and isinstance(v, dict):
                for dep in v:
                    f.edge(root, make_id(dep), "imports", path, None, "import")
            elif len(trail) < 2:
                key = f.node(make_id(stem, *trail, k), k, path)
                f.edge(owner, key, "contains", path)
                walk(v, key, (*trail, k))

    walk(data, root, ())
    return f


def _pattern(defs: list[tuple[str, str]], imports: list[str], call: str = r"\b([A-Za-z_]\w*)\s*\("):
    """An extractor for brace languages from patterns of definitions and imports."""

    def run(path: str, text: str) -> Fragment:
        f = Fragment()
        stem, root = _file(f, path)
        clean = re.sub(r"//[^\n]*|/\*.*?\*/|(?m:^\s*#(?!include)[^\n]*)", lambda m: " " * 0 + "\n" * m.group().count("\n"), text, flags=re.S)
        owner = root
        for no, line in enumerate(clean.split("\n"), 1):
            for rx in imports:
                m = re.search(rx, line)
                if m:
                    f.edge(root, make_id(stem_of(m.group(1).strip("\"'<>;").replace("::", "/").replace("\\", "/"))), "imports_from", path, no, "import")
                    break
            else:
                for kind, rx in defs:
                    m = re.search(rx, line)
                    if m:
                        key = make_id(stem, m.group(1))
                        f.node(key, f"{m.group(1)}()" if kind == "function" else m.group(1), path, no)
                        f.edge(root, key, "contains", path, no)
                        owner = key if kind == "function" else owner
                        break
                else:
                    for name in re.findall(call, line):
                        if name not in _KEYWORDS:
                            f.call(owner, name, False, path, no)
        return f

    return run


_KEYWORDS = set("if for while switch return catch function match else do new sizeof typeof await loop fn func def".split())
_CLASSES = ("class", r"^\s*(?:export\s+|public\s+|abstract\s+|final\s+|sealed\s+|data\s+|pub\s+|default\s+|internal\s+|private\s+|static\s+|partial\s+)*(?:class|interface|enum|struct|trait|object|protocol|record)\s+([A-Za-z_]\w*)")
_JS = _pattern([_CLASSES, ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$]\w*)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")], [r"^\s*(?:import|export)\b.*?from\s+(['\"][^'\"]+['\"])", r"^\s*import\s+(['\"][^'\"]+['\"])", r"require\((['\"][^'\"]+['\"])\)"])
_JAVA = _pattern([_CLASSES, ("function", r"^\s*(?:(?:public|private|protected|static|final|override|suspend|async|virtual)\s+)*(?:[\w<>\[\],.?]+\s+|fun\s+)([A-Za-z_]\w*)\s*\([^;]*$")], [r"^\s*import\s+(?:static\s+)?([\w.*]+)", r"^\s*using\s+([\w.]+)\s*;"])
_GO = _pattern([("class", r"^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)"), ("function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")], [r"^\s*(?:import\s+)?(?:\w+\s+)?(\"[\w./-]+\")\s*$"])
_RUST = _pattern([_CLASSES, ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+([A-Za-z_]\w*)")], [r"^\s*(?:pub\s+)?use\s+([\w:]+)"])
_C = _pattern([_CLASSES, ("function", r"^[A-Za-z_][\w\s*&:<>,]*?\b([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$")], [r"^\s*#include\s+([\"<][^\">]+[\">])"])
_RUBY = _pattern([("class", r"^\s*(?:class|module)\s+([A-Z]\w*)"), ("function", r"^\s*def\s+(?:self\.)?([a-z_]\w*[?!]?)")], [r"^\s*require(?:_relative)?\s+(['\"][^'\"]+['\"])"])
_PHP = _pattern([_CLASSES, ("function", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?([A-Za-z_]\w*)")], [r"^\s*use\s+([\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*(['\"][^'\"]+['\"])"])
_SHELL = _pattern([("function", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?")], [r"^\s*(?:source|\.)\s+(\S+)"], r"^\s*([a-z_][\w-]*)\b")
_LUA = _pattern([("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")], [r"require\s*\(?\s*(['\"][^'\"]+['\"])"])
_SWIFT = _pattern([_CLASSES, ("function", r"^\s*(?:(?:public|private|internal|static|override|mutating)\s+)*func\s+([A-Za-z_]\w*)")], [r"^\s*import\s+(\w+)"])
_JULIA = _pattern([("class", r"^\s*(?:mutable\s+)?(?:struct|abstract\s+type|module)\s+([A-Za-z_]\w*)"), ("function", r"^\s*function\s+([A-Za-z_]\w*)")], [r"^\s*(?:using|import)\s+([\w.]+)"])
_ELIXIR = _pattern([("class", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+([a-z_]\w*[?!]?)")], [r"^\s*(?:alias|import|use|require)\s+([\w.]+)"])
_FORTRAN = _pattern([("class", r"(?i)^\s*(?:module|program)\s+(?!procedure)([a-z_]\w*)"), ("function", r"(?i)^\s*(?:[\w()]+\s+)*(?:subroutine|function)\s+([a-z_]\w*)")], [r"(?i)^\s*use\s+([a-z_]\w*)"])
_PASCAL = _pattern([("class", r"(?i)^\s*(\w+)\s*=\s*(?:class|record|interface)\b"), ("function", r"(?i)^\s*(?:procedure|function|constructor|destructor)\s+([\w.]+)")], [r"(?i)^\s*uses\s+([\w.]+)"])
_VERILOG = _pattern([("class", r"^\s*(?:module|interface|package)\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)?([A-Za-z_]\w*)\s*[;(]")], [r"^\s*`include\s+(\"[^\"]+\")", r"^\s*import\s+([\w:]+)"])
_DART = _pattern([_CLASSES, ("function", r"^\s*(?:[\w<>?]+\s+)([a-z_]\w*)\s*\([^;]*\)\s*(?:async\s*)?\{")], [r"^\s*(?:import|export|part)\s+(['\"][^'\"]+['\"])"])
_ZIG = _pattern([("class", r"^\s*(?:pub\s+)?const\s+([A-Z]\w*)\s*=\s*(?:struct|enum|union)"), ("function", r"^\s*(?:pub\s+)?fn\s+([A-Za-z_]\w*)")], [r"@import\((\"[^\"]+\")\)"])
_POWERSHELL = _pattern([("class", r"(?i)^\s*class\s+(\w+)"), ("function", r"(?i)^\s*function\s+([\w-]+)")], [r"(?i)^\s*(?:Import-Module|using\s+module)\s+(\S+)"])
_DM = _pattern([("function", r"^(?:/[\w/]+/)?(?:proc|verb)/(\w+)\s*\("), ("class", r"^/([\w/]+)\s*$")], [r"^\s*#include\s+(\"[^\"]+\")"])
_FORM = _pattern([("class", r"^\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*\w+")], [])
_WINDOWS = _pattern([("class", r'^\s*(?:window|elem|menu|macro)\s+"([^"]+)"')], [])
_R = _pattern([("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(")], [r"^\s*(?:library|require|source)\((['\"]?[\w./-]+['\"]?)\)"])


def tile_map(path: str, text: str) -> Fragment:
    """Types that the tiles of a map are made of."""
    f = Fragment()
    _, root = _file(f, path)
    for kind in dict.fromkeys(re.findall(r"[(,\s](/[\w/]+)", text)):
        f.edge(root, make_id(kind), "references", path)
    return f


def project_xml(path: str, text: str) -> Fragment:
    """Project and package references of build files."""
    f = Fragment()
    stem, root = _file(f, path)
    for rx, rel in ((r"<(?:ProjectReference|Import)\b[^>]*?(?:Include|Project)=\"([^\"]+)\"", "references"), (r"<PackageReference\b[^>]*?Include=\"([^\"]+)\"", "imports")):
        for to in dict.fromkeys(re.findall(rx, text)):
            f.edge(root, make_id(stem_of(to.replace("\\", "/")) if rel == "references" else to), rel, path)
    for name, to in re.findall(r'Project\("[^"]*"\)\s*=\s*"([^"]+)",\s*"([^"]+)"', text):
        f.edge(root, f.node(make_id(stem, name), name, path), "contains", path)
        f.edge(make_id(stem, name), make_id(stem_of(to.replace("\\", "/"))), "references", path)
    return f


EXTRACTORS: dict[str, Callable[[str, str], Fragment]] = {"py": python, "sql": sql, "md": markdown, "mdx": markdown, "json": json_file}
for _names, _fn in (("js jsx mjs ejs ts tsx vue svelte astro ets", _JS), ("java kt kts scala groovy gradle cs razor cshtml", _JAVA), ("go", _GO), ("rs", _RUST), ("c h cc cpp cxx hpp m mm", _C), ("rb", _RUBY), ("php", _PHP), ("sh bash", _SHELL), ("lua luau", _LUA), ("swift", _SWIFT), ("jl", _JULIA), ("ex exs", _ELIXIR), ("f f90 f95 f03 f08", _FORTRAN), ("pas pp dpr lpr inc", _PASCAL), ("v sv svh", _VERILOG), ("dart", _DART), ("zig", _ZIG), ("ps1", _POWERSHELL), ("r", _R), ("dm dme", _DM), ("dfm lfm", _FORM), ("dmf", _WINDOWS), ("dmm", tile_map), ("sln csproj fsproj vbproj lpk", project_xml)):
    EXTRACTORS |= dict.fromkeys(_names.split(), _fn)

_KINDS = {"node": "nodes", "edge": "edges", "call": "calls"}
_FIELDS = ["id", "label", "file_type", "src", "dst", "relation", "confidence", "context", "caller", "callee", "is_member", "source_file", "source_location", "error"]
SCHEMA = "kind string, ord long, " + ", ".join(f"{f} {'boolean' if f == 'is_member' else 'string'}" for f in _FIELDS)


def extract(files: DataFrame, extractors: dict[str, Callable[[str, str], Fragment]] | None = None) -> DataFrame:
    """One row for each node, edge, raw call and error of (path, content); ``ord`` is the position in the file."""
    table = extractors or EXTRACTORS
    known = files.select("path", "content").filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(sorted(table)))

    def run(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    f = table[path.rpartition(".")[2].lower()](path, text or "")
                    out += [{"kind": k, "ord": i} | row for k, name in _KINDS.items() for i, row in enumerate(getattr(f, name))]
                except Exception as e:
                    out.append({"kind": "error", "ord": 0, "source_file": path, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(out, columns=["kind", "ord", *_FIELDS]).astype(object).where(lambda d: d.notna(), None)

    return known.mapInPandas(run, SCHEMA)


def nodes_of(extracted: DataFrame) -> DataFrame:
    return extracted.filter("kind = 'node'").select("id", "label", "file_type", "source_file", "source_location", "ord")


def edges_of(extracted: DataFrame) -> DataFrame:
    return extracted.filter("kind = 'edge'").select("src", "dst", "relation", "confidence", "context", "source_file", "source_location", "ord")


def calls_of(extracted: DataFrame) -> DataFrame:
    return extracted.filter("kind = 'call'").select("caller", "callee", "is_member", "source_file", "source_location")


def read_files(spark, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return raw.select("path", F.col("content").cast("string").alias("content"))
