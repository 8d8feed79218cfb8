"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything on the data is DataFrame functions: one regular expression marks the
candidates, a split lists them with the text around, features are expressions, and the forest
is compiled into CASE expressions.  The forest is grown on the driver from
labelled findings, a list whose size a parameter bounds.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "\x01"
#: Characters kept before and after a candidate.
CONTEXT = 64
#: Pieces of a text whose lengths are added up together.
BLOCK = 256

# Common words for dictionary coverage, and neighbouring words that speak for or against.
WORDS = "about after again also another back because been before being between both build cache class client code config could count create data date default delete does down each error event even every field file filter find first from function get good have header help here home html http image import index info input into item just keep key know label last left like line link list load local login long made main make many menu message method model more most much must name need never next node null number object only open option order other output over page panel param part path people place point post print query read record region request response result return right root same save search section select server service session should show size some source start state static status store string style such system table take task template test text than that their them then there these they thing this time title token tree type under update upload user value version view want well were what when where which while will with word work world would write year your".split()
FOR = "secret|token|passw|passwd|pwd|api.?key|apikey|access.?key|auth|credential|private|bearer|signing"
AGAINST = "commit|sha[0-9]|md5|digest|checksum|integrity|etag|revision|uuid|guid|example|sample|dummy|placeholder|fixture|hash|build|version"
#: In this order: headers of private keys; values of 6 characters or more after an assignment to a word
#: that speaks for, up to their closing quote or else the next space, quote or query parameter; runs
#: of at least 16 key characters with a digit among them, and padding.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    rf"""|(?<=[=:>\s"'])(?<=[=:>][ \t]{{0,3}}["']?)(?<=(?i:{FOR})[\w.-]{{0,24}}["']?[ \t]{{0,3}}(?:=>|:=|={{1,3}}|:)[ \t]{{0,3}}["']?)"""
    r"""(?:(?<=")[^\s"]{6,}|(?<=')[^\s']{6,}|(?<!["'])(?=[^\s"']{6})[^\s"'&]+(?:&(?!\w{1,30}=)[^\s"'&]*){0,64}(?<![.,;)]))"""
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
PATHS = "test|spec|example|sample|fixture|mock|docs?/|vendor|node_modules|\\.lock|\\.md$"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Numeric features of a candidate; null texts count as empty."""
    before, after, path = (F.lower(F.coalesce(c, F.lit(""))) for c in (before, after, path))
    n = F.length(value).cast("double")
    low = F.lower(value)
    hits = lambda c, rx: F.regexp_count(c, F.lit(rx)).cast("double")
    flag = lambda c, rx: F.when(c.rlike(rx), 1.0).otherwise(0.0)
    return {
        "length": n,
        "digits": hits(value, "[0-9]") / n,
        "upper": hits(value, "[A-Z]") / n,
        "symbols": hits(value, "[^A-Za-z0-9]") / n,
        "hex_only": flag(value, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        "class_changes": hits(value, "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "common_pairs": hits(low, PAIRS) / n,
        "repeats": hits(low, "(.)\\1") / n,
        "dictionary": (n - F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=len, reverse=True)), ""))) / n,
        "uuid": flag(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "prefixed": flag(value, "^(?:AKIA|ASIA|ghp_|gho_|ghs_|xox[bpa]-|sk_live_|rk_live_|AIza|eyJ|-----BEGIN )"),
        "word_for": flag(before, FOR),
        "word_against": flag(F.concat(before, F.lit(" "), after), AGAINST),
        "assigned": flag(before, "[=:]>?\\s*[\"']?$"),
        "quoted": flag(before, "[\"']$") * flag(after, "^[\"']"),
        "path_against": flag(path, PATHS),
    }


@dataclass
class Finding:
    value: str
    before: str
    after: str
    path: str
    label: int


def labelled_findings(n: int = 1200, seed: int = 5) -> list[Finding]:
    """Synthetic findings with labels: keys as they are written in code and prose, and
    the look-alikes that scans usually report by mistake."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    out = []
    for i in range(n):
        path = r.choice(["src/app.py", "lib/util.js", "cmd/main.go", "config/settings.yml", "deploy/prod.env", ".env", "lib/client.js", ""])
        quote = r.choice(['"', "'", '"'])
        filler = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 5)))
        if i % 2:
            value = r.choice([lambda: pick(hexa, r.choice([32, 40, 40, 64])), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: pick(alnum + "+/", 40), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(hexa, 40).upper()])()
            name = r.choice(["token", "secret", "api_key", "password", "access_key", "auth", "TOKEN", "SECRET_KEY", "apiKey", "private_key", "credential", "client_secret"])
            before, after = r.choice([(f"{filler} {name} = {quote}", f"{quote} {filler}"), (f"{name}: ", f"\n{filler}"), (f"{filler}\n{name}={quote}", f"{quote}"), (f"bearer ", f" {filler}")])
            if r.random() < 0.05:
                path = "tests/test_client.py"
            value = value if any(c.isdigit() for c in value) else value[:-1] + "7"
            out.append(Finding(value, before, after, path, 1))
            continue
        words = [w.capitalize() if r.random() < 0.5 else w for w in (r.choice(WORDS) for _ in range(r.randint(3, 6)))]
        value, before, after = r.choice(
            [
                lambda: (pick(hexa, 40), f"{filler} commit ", f" {filler}"),
                lambda: (f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", f"{filler} id = {quote}", f"{quote}"),
                lambda: (pick(hexa, r.choice([32, 64])), r.choice(["sha256 ", "md5: ", "checksum = ", "digest: ", "etag "]), f" {filler}"),
                lambda: ("".join(words) + str(r.randint(1, 99)), f"{filler} ", f" {filler}"),
                lambda: ("_".join(words).lower() + str(r.randint(1, 9)), f"{filler} {r.choice(['token', 'name', 'key'])} = {quote}", f"{quote} {filler}"),
                lambda: (pick(string.digits, r.randint(16, 20)), f"{filler} ", f" {filler}"),
                lambda: ("/".join(words).lower() + "/v2", f"{filler} ", f" {filler}"),
                lambda: (r.choice(["x", "0", "1", "a1"]) * r.randint(16, 20) + "0", f"token = {quote}", f"{quote}"),
                lambda: ("YOUR_TOKEN_HERE_" + str(r.randint(0, 9)), f"token = {quote}", f"{quote} example"),
                lambda: ("1234567890abcdef" * r.randint(1, 2), f"example token = {quote}", f"{quote} {filler}"),
                lambda: ("=" * r.randint(8, 20) + pick(string.digits, 8), f"{filler}\n", "\n"),
                lambda: ("sha512-" + pick(alnum + "+/", 60) + "7==", "integrity: ", f" {filler}"),
            ]
        )()
        value = value if any(c.isdigit() for c in value) else value + "7"
        out.append(Finding(value.ljust(16, "0"), before, after, r.choice([path, path, "tests/data/sample.json", "docs/guide.md", "yarn.lock"]), 0))
    return out + _assigned_findings(r, n // 2)


def _assigned_findings(r: random.Random, n: int) -> list[Finding]:
    """Values of any length and characters beside words that speak for, and headers of private keys."""
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum = string.ascii_letters + string.digits
    out = []
    for i in range(n):
        path = r.choice(["src/app.py", "lib/util.js", "cmd/main.go", "config/settings.yml", "deploy/prod.env", ".env", ""])
        filler = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 5)))
        name = r.choice(["token", "secret", "api_key", "password", "passwd", "auth", "DB_PASSWORD", "SECRET_KEY", "API_TOKEN", "private_key", "credential"])
        before, after = r.choice([(f"{filler}\n{name}=", "\n"), (f"{filler}\n{name}=", f"\n{filler}"), (f"{name}: ", f" {filler}"), (f'{filler} {name} = "', f'" {filler}'), (f'"{name}": "', '",')])
        long = [w for w in WORDS if len(w) >= 6]
        if i % 2:
            value = r.choice([lambda: pick(alnum + "!@#$%^*~?.", r.randint(7, 15)) + r.choice("!@#7x"), lambda: pick(string.ascii_letters, r.randint(12, 30)), lambda: pick(alnum, r.randint(8, 40)), lambda: pick("0123456789abcdef", 40), lambda: "ghp_" + pick(alnum, 36), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16)])()
            if i % 20 == 1:
                value, before, after = f"-----BEGIN {r.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----", f"{filler}\n", "\n" + pick(alnum, 40)
        else:
            value = r.choice([lambda: r.choice(long), lambda: r.choice(long).capitalize(), lambda: "_".join(r.choice(WORDS) for _ in range(3)), lambda: f"{r.choice(long)}.{r.choice(long)}", lambda: f"{r.choice(long)}()", lambda: "${" + r.choice(long).upper() + "}", lambda: "x" * r.randint(6, 14), lambda: "*" * r.randint(6, 12), lambda: f"<{r.choice(long)}>", lambda: "process.env." + r.choice(long).upper()])()
        out.append(Finding(value, before, after, path, i % 2))
    return out


def _findings_df(spark: SparkSession, found: list[Finding]) -> DataFrame:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("$", "\\u0024") + "'"
    body = ", ".join(f"({i}, {quote(f.value)}, {quote(f.before[-CONTEXT:])}, {quote(f.after[:CONTEXT])}, {quote(f.path)}, {f.label})" for i, f in enumerate(found))
    return spark.sql(f"SELECT * FROM VALUES {body} AS f(i, value, before, after, path, label)")


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 6, seed: int = 3) -> list:
    """Trees as nested (feature, threshold, left, right) with the share of label 1 at leaves."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)

    def node(at: np.ndarray, left: int):
        p = float(y[at].mean())
        if left == 0 or p in (0.0, 1.0) or len(at) < 4:
            return p
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            v = x[at, f]
            order = np.argsort(v, kind="stable")
            sv, sy = v[order], y[at][order]
            cut = np.flatnonzero(sv[1:] > sv[:-1]) + 1
            if not len(cut):
                continue
            ones = np.cumsum(sy)
            a, n = ones[cut - 1] / cut, len(at)
            b = (ones[-1] - ones[cut - 1]) / (n - cut)
            gini = cut * a * (1 - a) + (n - cut) * b * (1 - b)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0]:
                best = (gini[k], int(f), float((sv[cut[k] - 1] + sv[cut[k]]) / 2))
        if best is None:
            return p
        go = x[at, best[1]] <= best[2]
        return (best[1], best[2], node(at[go], left - 1), node(at[~go], left - 1))

    return [node(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def forest_expr(forest: list, names: list[str]) -> Column:
    """Mean vote of the trees, over feature columns ``_f_<name>``."""

    def sql(t) -> str:
        if not isinstance(t, tuple):
            return f"{t:.6f}D"
        return f"CASE WHEN `_f_{names[t[0]]}` <= {t[1]:.9f}D THEN {sql(t[2])} ELSE {sql(t[3])} END"

    return F.expr("(" + " + ".join(f"({sql(t)})" for t in forest) + f") / {len(forest)}.0D")


def _featured(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_f_{k}": v for k, v in features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()})


def train(spark: SparkSession, found: list[Finding]) -> tuple[list, list[str]]:
    names = list(features(F.lit(""), F.lit(""), F.lit(""), F.lit("")))
    rows = _featured(_findings_df(spark, found)).select("label", *(f"_f_{n}" for n in names)).collect()
    x = np.array([r[1:] for r in rows], float)
    return grow_forest(x, np.array([r[0] for r in rows], float)), names


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each candidate: ``keep``, nth, start (from 1, in characters), value, before, after, path."""
    marked = F.split(F.regexp_replace(F.translate(text_col, MARK, " "), CANDIDATE, MARK + "$0" + MARK), MARK)
    pieces = docs.filter(F.col(text_col).rlike(CANDIDATE)).select(*keep, (F.col(path_col) if path_col else F.lit("")).cast("string").alias("path"), marked.alias("_p"))
    found = F.expr("transform(sequence(1, size(_p) - 2, 2), i -> struct(CAST((i + 1) div 2 AS INT) AS nth, right(_p[i - 1], %d) AS before, _p[i] AS value, left(_p[i + 1], %d) AS after))" % (CONTEXT, CONTEXT))
    # lengths of the pieces before, by blocks of BLOCK pieces, so that no text needs quadratic time
    sums = F.expr(f"transform(sequence(0, (size(_p) - 1) div {BLOCK}), b -> aggregate(slice(_p, b * {BLOCK} + 1, {BLOCK}), 0, (a, s) -> a + length(s)))")
    before = F.expr("aggregate(_s, CAST(array(1) AS ARRAY<INT>), (a, s) -> concat(a, array(element_at(a, -1) + s)))")
    at = F.expr(f"_b[(2 * _c.nth - 1) div {BLOCK}] + aggregate(slice(_p, (2 * _c.nth - 1) div {BLOCK} * {BLOCK} + 1, (2 * _c.nth - 1) % {BLOCK}), 0, (a, s) -> a + length(s))")
    placed = pieces.withColumn("_s", sums).withColumn("_b", before)
    return placed.withColumn("_c", F.explode(found)).select(*keep, F.col("_c.nth").alias("nth"), at.alias("start"), "_c.value", "_c.before", "_c.after", "path")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, forest: tuple[list, list[str]] | None = None) -> DataFrame:
    """Candidates with ``score`` (votes for a secret, 0 to 1) and ``is_secret`` (0.5 or more).

    Null and empty texts have no candidates; a null path is empty; equal candidates of a
    text are rows of their own, and so are those of repeated rows.  Columns other
    than the id are not used, whatever their names.
    """
    trees, names = forest or train(docs.sparkSession, labelled_findings())
    cols = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.col(path_col).alias("_path")] if path_col else [])]
    found = _featured(candidates(docs.select(*cols), "_text", "_path" if path_col else None, ("_id",)))
    scored = found.withColumn("score", F.round(forest_expr(trees, names), 6))
    return scored.select(F.col("_id").alias(id_col), "nth", "start", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"), path_col="source")
    return out.select("doc_id", "nth", "start", F.length("value").alias("length"), F.sha2(F.col("value"), 256).alias("value_sha256"), "score", "is_secret")
