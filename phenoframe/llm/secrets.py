"""Secret scanning: candidates by pattern, false positives removed by a random forest, in SQL functions alone.

A text is split once at its candidates, which gives each one's position and surroundings without a
search. A candidate is described by its length, character transitions, dictionary coverage, path and
neighbouring words. The forest is fitted on labelled findings (a table of bounded size) and turned into one
constant array of nodes that every row walks with higher-order functions. Scanning is a projection of the
documents: no shuffle, no join, no Python on the way.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYWORD = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth)"
ASSIGNED = r"(?<=[:=][\"' ]{0,2})(?<=" + KEYWORD + r"[\"']{0,1} {0,1}[:=] {0,1}"
STARTS = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk_live_|rk_live_|npm_|eyJ"
# A key block, whatever is assigned to a telling name (if quoted, up to the quote), the password in a URL, a published
# key of dotted parts, or a run of token characters with a digit or a published beginning.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|" + ASSIGNED + r"\")[^\s\"]++(?=\")|" + ASSIGNED + r"')[^\s']++(?=')"
    r"|" + ASSIGNED + r"[\"']{0,1})[^\s\"',;<>]++"
    r"|(?<=:)(?<=://[^\s:/@]{0,256}:)[^\s/@]++(?=@)"
    r"|(?<![A-Za-z0-9_+/\-])SG\.[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]++"
    r"|(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9]|" + STARTS + r")[A-Za-z0-9_+/\-]{12,}+={0,2}"
)
# Beginnings of published key formats.
PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk_live_|rk_live_|SG\.|npm_|eyJ|-----BEGIN )"
HASH_WORD = r"(?i)\b(?:commit|sha-?(?:1|256|512)?|md5|hash|checksum|digest|etag|uuid|guid|revision|rev|version|isbn|order|invoice|card|base64|integrity)\b"
# Words that show that a string is written by people.
DICTIONARY = (
    "(password|passwd|secret|token|example|sample|test|demo|dummy|fake|mock|change|your|here|insert|enter|user|name|admin|default|"
    "placeholder|redacted|null|none|true|false|localhost|value|string|key|api|access|auth|main|index|page|chapter|section|image|file|"
    "static|asset|bundle|style|script|report|final|draft|copy|table|figure|summer|winter|january|december|xxx|yyy|zzz|abc|1234|0000)")
BIGRAM = "(th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce)"
TRIAL_PATH = r"(?i)(?:test|example|fixture|sample|mock|vendor|docs?)(?:[/_.\-]|$)"
SETTING_PATH = r"(?i)\.(?:env|pem|key|ya?ml|json|cfg|conf|ini|properties|tfvars)$"

FEATURES = (
    "length", "digits", "upper", "lower", "transitions", "distinct", "hex", "numeric", "dictionary", "bigrams", "prefix",
    "keyword_near", "keyword_next", "hash_word", "assigned", "quoted", "slashes", "path_after", "trial_path", "setting_path")
REACH = 60  # characters of context on the left
BLOCK = 128  # candidates whose lengths are summed together


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def describe(found: Column, left: Column, right: Column, path: Column) -> Column:
    """Feature array of a candidate between ``left`` and ``right``, in a document with ``path``."""
    n = F.length(found)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    flag = lambda c: c.cast("double")
    return F.array(*[c.cast("double") for c in (
        F.least(n, F.lit(200)), _share(_without(found, "[0-9]"), n), _share(_without(found, "[A-Z]"), n), _share(_without(found, "[a-z]"), n),
        _share(F.length(classes) - 1, n - 1), _share(F.size(F.array_distinct(F.split(found, ""))), n),
        flag(found.rlike("^[0-9a-fA-F]+$")), flag(found.rlike(r"^[0-9+/_\-]+$")),
        _share(_without(F.lower(found), DICTIONARY), n), _share(_without(F.lower(found), BIGRAM), n), flag(found.rlike(PREFIX)),
        flag(left.rlike(KEYWORD)), flag(left.rlike(KEYWORD + r"\w{0,12}[\"']?\s{0,2}[:= ]\s{0,2}[\"']?$")), flag(left.rlike(HASH_WORD)),
        flag(left.rlike(r"[:=]\s{0,2}[\"']?$")), flag(left.rlike("[\"']$")), _share(_without(found, "[/]"), n),
        flag(left.rlike("[/.\\\\]$") | right.rlike(r"^(?:\.[A-Za-z]{2,4}\b|/|@)")),
        flag(path.rlike(TRIAL_PATH)), flag(path.rlike(SETTING_PATH)),
    )])


def _text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _parts(text: Column) -> Column:
    """What the candidates are (``found``) and what stands before, between and after them (``between``)."""
    body = _text_of(text)
    return F.struct(F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(body, CANDIDATE, -1).alias("between"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def candidates(text: Column, path: Column) -> Column:
    """Array of (found, start, x): candidates, where they start (code points from 0) and their features.

    Lengths are summed in blocks of ``BLOCK`` and then within a block, so work stays in step with the number of candidates.
    """
    parts = _parts(text)
    sized = F.transform(F.array(parts), lambda p: F.struct(
        p["found"].alias("found"), p["between"].alias("between"),
        F.zip_with(F.slice(p["between"], 1, F.size(p["found"])), p["found"], lambda b, f: F.length(b) + F.length(f)).alias("steps")))
    count = lambda p: F.sequence(F.lit(0), F.floor(F.size(p["steps"]) / BLOCK).cast("int"))
    summed = F.transform(sized, lambda p: F.struct(
        p["found"].alias("found"), p["between"].alias("between"), p["steps"].alias("steps"),
        F.transform(count(p), lambda k: _total(F.slice(p["steps"], k * BLOCK + 1, BLOCK))).alias("sums")))
    placed = F.transform(summed, lambda p: F.struct(
        p["found"].alias("found"), p["between"].alias("between"), p["steps"].alias("steps"),
        F.transform(p["sums"], lambda _, k: _total(F.slice(p["sums"], 1, k))).alias("starts")))
    return F.when(F.size(parts["found"]) > 0, F.transform(placed, lambda p: F.transform(
        p["found"], lambda c, i: F.struct(
            c.alias("found"),
            (p["starts"][F.floor(i / BLOCK).cast("int")] + _total(F.slice(p["steps"], i - i % BLOCK + 1, i % BLOCK)) + F.length(p["between"][i])).alias("start"),
            describe(c, F.substring(p["between"][i], -REACH, REACH), F.substring(p["between"][i + 1], 1, 20), path).alias("x"))))[0])


# Labelled findings ------------------------------------------------------------------------------------------

_WORDS = "the report shows that users and their data were of from with when after note see line also value"


def labelled_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """(found, left, right, path, label): findings of known truth, written by rule from row numbers.

    Half are keys in published formats or values assigned to telling names; the others are what
    scanners mistake for them: digests, identifiers, numbers, paths, placeholders and compound words.
    """
    digest = F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 512)
    other = F.sha2(F.concat(F.lit("other-"), F.col("id").cast("string")), 512)
    dense = F.regexp_replace(F.base64(F.unhex(F.concat(digest, other))), "[^A-Za-z0-9]", "")
    size = F.conv(F.substring(other, 1, 2), 16, 10).cast("int")
    word = lambda k: F.element_at(F.split(F.lit(_WORDS), " "), (F.conv(F.substring(digest, k, 4), 16, 10).cast("int") % 18) + 1)
    near = F.concat(word(1), F.lit(" "), word(9), F.lit(" "))
    digits = F.substring(F.regexp_replace(F.concat(digest, other), "[a-f]", ""), 1, 40)
    up = F.upper(dense)
    name = F.element_at(F.array(*[F.lit(x) for x in ("password", "api_key", "secret", "token", "access_key", "auth_token", "DB_PASSWORD", "client_secret")]), size % 8 + 1)
    sign = F.element_at(F.array(*[F.lit(x) for x in ("=", ": ", " = \"", "=\"", ": '", ":")]), size % 6 + 1)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cut = lambda text, n: F.substring(text, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    kind = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), size % len(names) + 1)
    letters = F.regexp_replace(up, "[0-9]", "")
    url = kind("postgres://admin:", "https://user:", "mongodb://svc:", "redis://:")
    good = [
        (near, join("AKIA", cut(up, 16))), (join(near, name, sign), cut(digest, 18)), (join(near, name, sign), cut(digest, 40)),
        (near, join("ghp_", cut(dense, 36))), (join(near, name, sign), cut(dense, 24 + size % 24)), (join(near, name, sign), cut(dense, 12 + size % 6)),
        (near, join("sk_live_", cut(dense, 24))), (join(near, "Authorization: Bearer "), cut(dense, 40 + size % 60)),
        (near, join("AIza", cut(dense, 35))), (near, join("xoxb-", cut(digits, 12), "-", cut(dense, 24))), (join(near, name, sign), cut(digest, 32)),
        (near, join("AKIA", cut(letters, 16))), (join(near, url), cut(dense, 8 + size % 16)), (join(near, name, sign), cut(dense, 4 + size % 2)),
        (join(near, name, sign), join(cut(dense, 6 + size % 8), kind("!", "#", "@", "$"), F.substring(dense, 20, 5))),
    ]
    bad = [
        (join(near, kind("commit ", "revision ", "sha1 ", "rev ")), cut(digest, 40)), (join(near, kind("sha256:", "checksum: ", "digest = ")), cut(digest, 64)),
        (join(near, kind("md5 ", "etag: ", "hash=")), cut(digest, 32)),
        (join(near, kind("uuid ", "id ", "request ")), join(cut(digest, 8), "-", F.substring(digest, 9, 4), "-", F.substring(digest, 13, 4), "-", F.substring(digest, 17, 4), "-", F.substring(digest, 21, 12))),
        (join(near, kind("/var/www/", "https://cdn.example.com/", "see ")), join(kind("static/img/", "assets/bundle-", "docs/chapter-"), cut(digits, 4), "/", kind("index", "main-page", "report-final"))),
        (join(near, name, sign), kind("changeme123", "your_password_here_1", "xxxxxxxxxxxxxxxx1", "example_token_123456", "${PASSWORD_1234}", "insert-your-key-0000", "placeholder_value")),
        (near, cut(digits, 12 + size % 8)), (join(near, kind("order ", "card ", "isbn ")), join(cut(digits, 4), "-", F.substring(digits, 5, 4), "-", F.substring(digits, 9, 4))),
        (near, join(kind("chapter", "section", "figure", "version", "summer", "table"), cut(digits, 2), kind("introduction", "overview", "appendix", "conclusion"))),
        (near, join("AKIA", cut(up, 9), "EXAMPLE")), (join(near, "src=\"data:image/png;base64,"), join(dense, "/", dense)),
        (join(near, kind("order_id=", "page=", "user_id: ")), cut(digits, 14)), (near, join(kind("interstellar", "counterclockwise", "misunderstanding", "internationalisation"), cut(digits, 1))),
        (join(near, name, sign), kind("the", "a", "none", "null", "true", "from", "your", "is", "is", "must")),
    ]
    flip = F.col("id") % 2

    def pick(table, part):
        value = F.lit("")
        for k, row in enumerate(table):
            value = F.when((F.col("id") / 2).cast("long") % len(table) == k, row[part]).otherwise(value)
        return value

    return spark.range(rows).select(
        F.when(flip == 1, pick(good, 1)).otherwise(pick(bad, 1)).alias("found"), F.when(flip == 1, pick(good, 0)).otherwise(pick(bad, 0)).alias("left"),
        F.when(size % 4 == 0, F.lit("")).when(size % 4 == 1, F.lit("\"")).otherwise(F.lit(" and")).alias("right"),
        F.when((flip == 0) & (size % 9 == 0), F.lit("src/test/data.txt")).when(size % 9 == 1, F.lit("deploy/prod.env")).otherwise(F.lit("src")).alias("path"),
        flip.cast("double").alias("label"))


def fit_forest(findings: DataFrame, trees: int = 25, depth: int = 7) -> list[list[list[float]]]:
    """Trees as node lists [feature, threshold, left, right, share of secrets]; feature -1 marks a leaf.

    ``findings`` has the columns of ``labelled_findings``; its size is the caller's bound. Rows with a null
    candidate or label are not used.
    """
    clean = findings.where("found is not null and label is not null")
    x = describe(F.col("found"), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")), F.coalesce("path", F.lit("")))
    rows = clean.select(F.col("label").cast("double").alias("label"), array_to_vector(x).alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featureSubsetStrategy="sqrt", minInstancesPerNode=4).fit(rows)

    def nodes(tree) -> list[list[float]]:
        out: list[list[float]] = []

        def visit(node) -> int:
            at = len(out)
            stats = list(node.impurityStats().stats())
            out.append([-1.0, 0.0, 0.0, 0.0, stats[1] / max(1e-9, sum(stats)) if len(stats) > 1 else 0.0])
            if "Internal" in node.getClass().getSimpleName():
                split = node.split()
                out[at][:2] = [float(split.featureIndex()), float(split.threshold())]
                out[at][2] = float(visit(node.leftChild()))
                out[at][3] = float(visit(node.rightChild()))
            return at

        visit(tree._call_java("rootNode"))
        return out

    return [nodes(t) for t in model.trees]


def probability(x: Column, forest: list[list[list[float]]]) -> Column:
    """Mean share of secrets in the leaves that a feature array falls into."""
    def number(v: float) -> str:
        return f"{v!r}D"

    literal = F.expr("array(" + ",".join("array(" + ",".join("array(" + ",".join(map(number, n)) + ")" for n in t) + ")" for t in forest) + ")")
    deepest = F.sequence(F.lit(1), F.lit(max(_depth(t) for t in forest)))

    def walk(tree: Column) -> Column:
        leaf = F.aggregate(deepest, F.lit(0), lambda at, _: F.when(tree[at][0] < 0, at).otherwise(
            F.when(x[tree[at][0].cast("int")] <= tree[at][1], tree[at][2].cast("int")).otherwise(tree[at][3].cast("int"))))
        return F.transform(F.array(leaf), lambda at: tree[at][4])[0]

    return F.aggregate(F.transform(literal, walk), F.lit(0.0), lambda a, b: a + b) / len(forest)


def _depth(tree: list[list[float]], at: int = 0) -> int:
    return 0 if tree[at][0] < 0 else 1 + max(_depth(tree, int(tree[at][2])), _depth(tree, int(tree[at][3])))


def findings(text: Column, path: Column, forest: list[list[list[float]]]) -> Column:
    """Array of (start, length, found, score, nth) of all candidates in text order; null if there are none."""
    return F.transform(candidates(text, path), lambda c, i: F.struct(
        c["start"].alias("start"), F.length(c["found"]).alias("length"), c["found"].alias("found"), probability(c["x"], forest).alias("score"), i.alias("nth")))


def accepted(found: Column, threshold: float = 0.5) -> Column:
    """The findings that the forest takes for secrets; an empty array if there are none."""
    none = F.expr("cast(array() as array<struct<start:int,length:int,found:string,score:double,nth:int>>)")
    return F.coalesce(F.filter(found, lambda c: c["score"] >= threshold), none)


def scan(
    docs: DataFrame, forest: list[list[list[float]]], text: str = "text", path: str | None = "source", threshold: float = 0.5,
) -> DataFrame:
    """Add ``n_candidates`` and ``secrets``: array of (start, length, found, score, nth), in text order.

    Starts and lengths count code points, ``nth`` the candidates of the text from 0. Null and empty texts have none; each row is judged alone. Columns of
    these names are replaced, all others stay.
    """
    seen = docs.drop("n_candidates", "secrets").withColumn("_seen", findings(F.col(text), path_of(docs, path), forest))
    return seen.withColumns({"n_candidates": F.greatest(F.size("_seen"), F.lit(0)), "secrets": accepted(F.col("_seen"), threshold)}).drop("_seen")


def path_of(docs: DataFrame, path: str | None) -> Column:
    return F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found secret of this text replaced by ``mark``; what stands between secrets is joined once."""
    def stretch(p, low, high):
        """Texts and candidates from number ``low`` up to ``high``, and the text before that one."""
        many = high - low
        pairs = F.zip_with(F.slice(p["between"], low + 1, many), F.slice(p["found"], low + 1, many), lambda b, f: F.concat(b, f))
        return F.concat(F.array_join(pairs, ""), p["between"][high])

    def after(p, k):
        return F.when(k > 0, F.get(p["taken"], k - 1)["nth"] + 1).otherwise(F.lit(0))

    parts = _parts(text)
    whole = F.struct(parts["found"].alias("found"), parts["between"].alias("between"), secrets.alias("taken"))
    done = F.transform(F.array(whole), lambda p: F.concat(
        F.array_join(F.transform(p["taken"], lambda c, k: F.concat(stretch(p, after(p, k), c["nth"]), F.lit(mark))), ""),
        stretch(p, after(p, F.size(p["taken"])), F.size(p["found"]))))[0]
    return F.when(F.size(secrets) > 0, done).otherwise(text)
