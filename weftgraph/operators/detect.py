"""Corpus detection: file kinds, paper signals, sensitive names, ignore rules, manifests, caches."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import base_name, suffix
from ..schema import CODE_SUFFIXES, DOC_SUFFIXES, IMAGE_SUFFIXES, OFFICE_SUFFIXES, PAPER_SUFFIXES, VIDEO_SUFFIXES, WORKSPACE_SUFFIXES

# Signs of a paper, names of sensitive files, interpreters, noise folders.
PAPER_SIGNALS = [
    r"(?i)\barxiv\b",
    r"(?i)\bdoi\s*:",
    r"(?i)\babstract\b",
    r"(?i)\bproceedings\b",
    r"(?i)\bjournal\b",
    r"(?i)\bpreprint\b",
    r"\\cite\{",
    r"\[\d+\]",
    r"\[\n\d+\n\]",
    r"(?i)eq\.\s*\d+|equation\s+\d+",
    r"\d{4}\.\d{4,5}",
    r"(?i)\bwe propose\b",
    r"(?i)\bliterature\b",
]
SENSITIVE_DIRS = [".ssh", ".gnupg", ".aws", ".gcloud", "secrets", ".secrets", "credentials"]
SENSITIVE_NAMES = [
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(?<![a-zA-Z0-9])(credential|secret|passwd|password|private_key)s?(?![a-zA-Z])",
    r"(?i)(?<![a-zA-Z0-9])tokens?(?![a-zA-Z])",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$",
    r"(?i)(aws_credentials|gcloud_credentials|service.account)",
]
INTERPRETERS = "python python3 python2 ruby perl node nodejs bash sh dash zsh fish ksh tcsh lua php julia Rscript".split()
ASSET_DIRS = r"\.(imageset|xcassets|appiconset|colorset|launchimage)(/|$)"
NOISE_DIRS = [
    "venv", ".venv", "env", ".env",
    "node_modules", "__pycache__", ".git",
    "dist", "build", "target", "out",
    "site-packages", "lib64",
    ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".eggs",
    "coverage", "lcov-report",
    "visual-tests", "visual-test",
    "__snapshots__", "snapshots",
    "storybook-static",
    "dist-protected",
    ".next", ".nuxt", ".turbo", ".angular",
    ".idea", ".cache", ".parcel-cache", ".svelte-kit", ".terraform", ".serverless",
    ".worktrees",
]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum"]
PAPER_THRESHOLD, PAPER_CHARS = 3, 3000


def word_count(text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"\s+"))).cast("long")


def paper_signals(text: Column) -> Column:
    """Number of signs of a paper in the first characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, PAPER_CHARS)
    total: Column = F.lit(0)
    for rx in PAPER_SIGNALS:
        total = total + F.when(head.rlike(rx), 1).otherwise(0)
    return total


def shebang(text: Column) -> Column:
    """Interpreter of a first line ``#!``; options and assignments after env are skipped."""
    line = F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, 256), r"^#!\s*([^\n]*)", 1)
    cmd = F.regexp_replace(line, r"^\S*/?env\s+(?:(?:-S|-i|-0|-v|--split-string|--ignore-environment)\s+|(?:-u|-C|-P)\s+\S+\s+|[A-Za-z_]\w*=\S*\s+)*", "")
    return F.regexp_extract(cmd, r"^(?:\S*/)?([^\s/]+)", 1)


def classify(path: Column, text: Column) -> Column:
    """code, paper, image, document, video, or null."""
    s = suffix(path)
    return (
        F.when(F.lower(path).endswith(".blade.php"), "code")
        .when(s == "", F.when(shebang(text).isin(INTERPRETERS), "code"))
        .when(s.isin(CODE_SUFFIXES), "code")
        .when(s.isin(PAPER_SUFFIXES), F.when(~path.rlike(ASSET_DIRS), "paper"))
        .when(s.isin(IMAGE_SUFFIXES), "image")
        .when(s.isin(DOC_SUFFIXES), F.when(paper_signals(text) >= PAPER_THRESHOLD, "paper").otherwise("document"))
        .when(s.isin(OFFICE_SUFFIXES + WORKSPACE_SUFFIXES), "document")
        .when(s.isin(VIDEO_SUFFIXES), "video")
    )


def is_sensitive(path: Column) -> Column:
    folders = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    name = base_name(path)
    found = F.arrays_overlap(folders, F.array(*(F.lit(d) for d in SENSITIVE_DIRS)))
    for rx in SENSITIVE_NAMES:
        found = found | name.rlike(rx)
    return found


def is_noise_dir(name: Column, parent: Column) -> Column:
    """Whether a folder holds environments, caches, dependencies or build results."""
    return name.isin(NOISE_DIRS) | name.rlike(r"(_venv|_env|\.egg-info)$") | ((name == "worktrees") & F.coalesce(parent.startswith("."), F.lit(False)))


def in_noise(path: Column) -> Column:
    """Whether any folder of a relative path is noise, or the file is a lock file."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    parents = F.concat(F.array(F.lit("")), folders)
    inside = F.exists(F.zip_with(folders, F.slice(parents, 1, F.size(folders)), lambda x, y: is_noise_dir(x, y)), lambda x: x)
    return inside | base_name(path).isin(LOCK_FILES)


def parse_ignore(lines: list[str], folder: str = "") -> list[tuple[str, bool, str]]:
    """(pattern, negated, folder) of an ignore or allow file in ``folder``.

    Blank lines and comments go, and so does a comment after a blank; ``\\#`` is a plain sign;
    blanks at the end go unless escaped.
    """
    out = []
    for raw in lines:
        line = raw.rstrip("\r\n").lstrip()
        if not line or line.startswith("#"):
            continue
        line = re.sub(r"\s+#+[^\\].*$", "", line).replace("\\#", "#")
        line = re.sub(r"(?<!\\) +$", "", line)
        negated = line.startswith("!")
        if line[negated:].strip("/"):
            out.append((line[negated:], negated, folder))
    return out


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression of the whole text; ``*`` crosses folders."""
    return "^" + re.sub(r"\\[zZ]$", "", fnmatch.translate(pattern)) + r"\z"


def _parts_and_heads(path: Column) -> Column:
    """The parts of a path, the folders above it and the path itself."""
    parts = F.split(path, "/")
    return F.concat(parts, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def _rule_hits(path: Column, pattern: str, folder: str) -> Column:
    """Whether a rule speaks of a relative path: one that starts with a slash of the path seen from the
    rule's folder, others of the path, its name, any part or any folder above."""
    rx = _glob(pattern.strip("/"))
    inside = F.when(path.startswith(f"{folder}/"), F.substring(path, len(folder) + 2, 1 << 30)) if folder else path
    if pattern.startswith("/"):
        return F.coalesce(inside.rlike(rx), F.lit(False))
    found = F.exists(_parts_and_heads(path), lambda x: x.rlike(rx))
    return found | F.coalesce(F.exists(_parts_and_heads(inside), lambda x: x.rlike(rx)), F.lit(False)) if folder else found


def ignored(paths: DataFrame, rules: list[tuple[str, bool, str]]) -> DataFrame:
    """(path, ignored): the last rule that speaks of a path decides, and an ignored folder hides what is in it."""
    parts = F.split("path", "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    verdict: Column = F.lit(False)
    for pattern, negated, folder in rules:
        verdict = F.when(_rule_hits(F.col("p"), pattern, folder), not negated).otherwise(verdict)
    return paths.select("path", prefix.alias("p")).groupBy("path").agg(F.bool_or(verdict).alias("ignored"))


def allowed(paths: DataFrame, rules: list[tuple[str, bool, str]]) -> DataFrame:
    """(path, allowed): whether any rule of an allow file speaks of a path."""
    hit: Column = F.lit(False)
    for pattern, _, folder in rules:
        hit = hit | _rule_hits(F.col("path"), pattern, folder)
    return paths.select("path", hit.alias("allowed"))


#: Sizes beyond which a corpus is called large, and words below which a graph hardly pays.
MANY_FILES, MANY_WORDS, FEW_WORDS = 200, 500_000, 50_000


def scan(files: DataFrame, ignore: list[tuple[str, bool, str]], allow: list[tuple[str, bool, str]] = ()) -> DataFrame:
    """(path, kind, words) of the files (path, content) a corpus consists of.

    Noise folders, ignored paths, sensitive names and kinds that nothing reads are left out;
    an allow file brings paths in hidden folders back.
    """
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith("."))
    out = files.withColumns({"kind": classify(F.col("path"), F.col("content")), "words": word_count(F.col("content"))})
    out = out.join(ignored(files.select("path"), ignore), "path").join(allowed(files.select("path"), list(allow)), "path")
    keep = ~in_noise(F.col("path")) & ~F.col("ignored") & ~is_sensitive(F.col("path")) & F.col("kind").isNotNull() & (~hidden | F.col("allowed"))
    return out.filter(keep).select("path", "kind", "words")


def verdict(found: DataFrame) -> DataFrame:
    """One row: files, words, needs_graph, and large for a corpus beyond the usual size."""
    total = found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return total.select("files", "words", (F.col("words") >= FEW_WORDS).alias("needs_graph"), ((F.col("files") >= MANY_FILES) | (F.col("words") >= MANY_WORDS)).alias("large"))


def incremental_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): new, changed, unchanged or deleted against a manifest.

    ``files`` has path, mtime and hash, ``manifest`` path, mtime and the hash of the kind asked
    for.  Without that hash a file counts as changed; with an equal mtime it is not read.
    """
    m = manifest.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"), F.col("hash").alias("_h"))
    state = F.when(F.col("path").isNull(), "deleted").when(F.col("_p").isNull(), "new").when(F.col("_h").isNull(), "changed").when(F.col("mtime") == F.col("_m"), "unchanged").when(F.col("hash") == F.col("_h"), "unchanged").otherwise("changed")
    return files.join(m, F.col("path") == F.col("_p"), "full").select(F.coalesce("path", "_p").alias("path"), state.alias("state"))


def save_manifest(files: DataFrame, previous: DataFrame, kind: str) -> DataFrame:
    """(path, mtime, ast_hash, semantic_hash): ``kind`` says which hash is stamped; the semantic hash
    outlives a syntax save only if the content is the one of the last."""
    p = previous.select(F.col("path").alias("_p"), F.col("ast_hash").alias("_a"), F.col("semantic_hash").alias("_s"))
    x = files.join(p, F.col("path") == F.col("_p"), "left")
    if kind == "ast":
        ast, sem = F.col("hash"), F.when(F.col("_a") == F.col("hash"), F.col("_s"))
    else:
        ast, sem = F.col("_a"), F.col("hash")
    return x.select("path", "mtime", ast.alias("ast_hash"), sem.alias("semantic_hash"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored manifest, or an empty one if it can't be read."""
    schema = "path STRING, mtime DOUBLE, ast_hash STRING, semantic_hash STRING"
    try:
        return spark.read.parquet(path).select("path", "mtime", "ast_hash", "semantic_hash")
    except Exception:
        return spark.createDataFrame([], schema)


def content_hash(path: Column, text: Column) -> Column:
    """SHA-256 of the body, a NUL and the lower-cased path; front matter of Markdown is not body."""
    body = F.when(F.lower(path).endswith(".md"), F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")).otherwise(text)
    return F.sha2(F.concat(body, F.lit("\0"), F.lower(path)), 256)


def cache_split(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, hit) by content hash."""
    have = cache.select(F.col("hash").alias("_h")).distinct()
    return files.select("path", "hash").join(have, F.col("hash") == F.col("_h"), "left").select("path", F.col("_h").isNotNull().alias("hit"))


def url_type(url: Column) -> Column:
    low = F.lower(url)
    path = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return (
        F.when(low.contains("twitter.com") | low.contains("x.com"), "tweet")
        .when(low.contains("arxiv.org"), "arxiv")
        .when(low.contains("github.com"), "github")
        .when(low.contains("youtube.com") | low.contains("youtu.be"), "youtube")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image")
        .otherwise("webpage")
    )


def html_text(html: Column, limit: int = 8000) -> Column:
    """Text of a page without scripts, styles and tags."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " ")
    return F.substring(F.trim(t), 1, limit)


def dir_rollup(files: DataFrame) -> DataFrame:
    """(dir, files): number of files below each folder, ``.`` for all."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/")))
    return files.select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def pack_chunks(files: DataFrame, budget: int) -> DataFrame:
    """(path, chunk): files packed within their folder until the budget of tokens (chars div 4) is full.

    Packing is sequential by nature; it runs on each folder by itself, so folders are the
    unit of distribution.
    """
    cost = F.greatest(F.lit(1), (F.length(F.coalesce("content", F.lit(""))) / 4).cast("long"))
    f = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "path", cost.alias("cost"))

    def pack(pdf):
        pdf = pdf.sort_values("path", ignore_index=True)
        chunk, used, out = 0, 0, []
        for c in pdf["cost"]:
            if used and used + c > budget:
                chunk, used = chunk + 1, 0
            used += c
            out.append(chunk)
        return pdf.assign(chunk=out)[["dir", "path", "chunk"]]

    return f.groupBy("dir").applyInPandas(pack, "dir string, path string, chunk int")


def corpus_verdict(files: DataFrame) -> DataFrame:
    """(kind, files, words) of the files that are kept."""
    kept = files.filter(~is_sensitive(F.col("path"))).select(classify(F.col("path"), F.col("content")).alias("kind"), word_count(F.col("content")).alias("words"))
    return kept.filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("words").alias("words"))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
