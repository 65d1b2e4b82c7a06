"""Secret scans: candidates by pattern, false positives removed by a random forest; Spark expressions only on the data.

Words end at white space. A candidate in a word is
- a run of 16 or more of the characters ``A-Za-z0-9+/_-`` that has a digit, or begins as known keys do, or mixes upper and lower case;
- the value after a name such as password or token and ``=`` or ``:`` in the same word, or in a following word after the sign: 6 characters or more, whatever they are.
All candidates of all words are looked at. Features: length, shares of digits, upper-case letters, other characters and distinct characters, hexadecimal or not,
transitions between kinds of characters, share covered by dictionary words (the most frequent words of the corpus, counted over all its texts, and a fixed list of words
of names and paths), path marks inside, whether the document's own path speaks of tests or examples, and whether the name before ``=`` or ``:`` or the neighbouring
words speak of secrets or of harmless identifiers.

The forest is grown on the driver from labelled findings - a table of texts with one finding each, of which at most ``most`` candidates are taken - whose features come
from the same expressions; its trees become CASE expressions. ``example_findings`` makes such a table where no reviewed one is at hand. Without a labelled candidate there
is no tree, and every score is 0.

Null and empty texts have no candidate. Repeated rows and repeated secrets give a row each; rows of one doc_id, null ids too, stay apart by row only. Equal scores need no
order; a score equal to the threshold is a secret. Very long texts are searched whole. An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"[A-Za-z0-9+/_\-]{16,}"
#: How known keys begin, words that tell what stands beside a finding, and words that names and paths are made of.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "pk_live_", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "npm_")
SECRET_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private", "credential", "auth", "bearer")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "digest", "checksum", "uuid", "guid", "build", "version", "rev", "revision", "id", "example", "sample", "test", "card", "order")
DICTIONARY = (
    "example sample test dummy changeme placeholder your here file path image index page name value config default service server client user admin mail data base module main class function "
    "release version build project source docs http https www com org net html json xml the and for with key token secret password none null true false optional required string"
).split()
TEST_PATHS = ("test", "tests", "example", "examples", "sample", "fixture", "fixtures", "doc", "docs", "mock")
FEATURES = ("len", "digits", "upper", "other", "distinct", "hex", "turns", "words", "path", "in_test", "prefix", "named_secret", "named_harmless", "near_secret", "near_harmless")
_NAMED = rf"(?i)(?:{'|'.join(SECRET_WORDS)})[A-Za-z0-9_\-]{{0,20}}[\"']?[=:]+"


def corpus_words(docs: DataFrame, most: int = 1000, least_length: int = 4) -> list[str]:
    """The ``most`` most frequent words of least_length letters a-z or more, counted over all texts (ties by the word): the dictionary, of fixed size."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least_length},20}}"), F.lit(0))).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def candidates(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, word long, value, name, before, after, more): each candidate with its word's number and its neighbours."""
    known = rf"(?<![A-Za-z0-9])(?:{'|'.join(PREFIXES)})"
    likely = lambda v: v.rlike("[0-9]") | v.rlike(known) | (v.rlike("[a-z]{2}") & v.rlike("[A-Z][A-Z0-9+/_\\-]*[a-z]+[A-Z]"))
    text = F.col("text")
    extra = [F.struct(*more).alias("more")] if more else []
    words = docs.select("doc_id", *extra, F.split(text, r"\s+").alias("w"))
    sign = lambda w: w.rlike(_NAMED)
    maybe = lambda w: (F.length(w) >= 6) & ((F.length(w) >= 16) & w.rlike(RUN) & likely(w) | (F.contains(w, F.lit("=")) | F.contains(w, F.lit(":"))) & sign(w))
    at = F.filter(F.transform("w", lambda w, i: F.when(maybe(w), i)), lambda i: i.isNotNull())
    after_sign = F.filter(F.transform("w", lambda w, i: F.when(F.endswith(w, F.lit("=")) | F.endswith(w, F.lit(":")), i)), lambda i: i.isNotNull())
    kept = ["doc_id", *(["more"] if more else [])]
    found = words.withColumns({"at": at, "signs": after_sign})
    found = found.where((F.size("at") > 0) | (F.size("signs") > 0))
    # A value in a word of its own: name = value, or name: value.
    spots = F.array_union("at", F.transform("signs", lambda i: i + 1))
    found = found.select(*kept, F.explode(spots).alias("i"), "w")
    near = lambda k: F.coalesce(F.get("w", F.col("i") + k), F.lit(""))
    before = F.concat_ws(" ", F.when(F.col("i") > 1, near(-2)), F.when(F.col("i") > 0, near(-1)))
    found = found.select(*kept, F.col("i").cast("long").alias("word"), near(0).alias("own"), before.alias("before"), near(1).alias("after"))
    runs = F.filter(F.regexp_extract_all("own", F.lit(rf"(?:^|[^A-Za-z0-9+/_\-])({RUN})"), F.lit(1)), likely)
    bare = lambda v: F.regexp_replace(v, "^[\"'`(<\\[{]+|[\"'`)>\\]},;.]+$", "")
    quoted = lambda v: F.regexp_extract(v, "^[(<\\[{]*[\"'`]([^\"'`]+)[\"'`]", 1)
    inner = lambda v: F.when(quoted(v) != "", quoted(v)).otherwise(bare(v))
    told = F.when(sign(F.col("own")), inner(F.regexp_extract("own", _NAMED + "(.*)$", 1)))
    alone = F.when(F.col("before").rlike(rf"(?i)(?:{'|'.join(SECRET_WORDS)})[A-Za-z0-9_\-]{{0,20}}[\"']? ?(?:=|:|:=)$"), inner(F.col("own")))
    named = F.filter(F.array(F.coalesce(told, alone, F.lit(""))), lambda v: F.length(v) >= 6)
    # A run inside a named value is that value.
    values = F.array_union(named, F.filter(runs, lambda r: ~F.exists(named, lambda v: F.contains(v, r))))
    name = F.when(alone.isNotNull() & told.isNull(), F.regexp_extract("before", r"([A-Za-z0-9_\-]{1,30})[\"']? ?[=:]+$", 1)).otherwise(F.regexp_extract("own", r"([A-Za-z_\-]{1,30})[\"']?[=:]", 1))
    out = found.withColumns({"name": name, "value": F.explode(values)}).drop("own")
    return out.select("doc_id", "word", "value", "name", "before", "after", *([F.col("more.*")] if more else []))


def features(found: DataFrame, dictionary: list[str], path: Column | None = None) -> DataFrame:
    """candidates with a double column for each of FEATURES."""
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    says = lambda c, words: F.lower(c).rlike(rf"(^|[^a-z])({'|'.join(words)})([^a-z]|$)").cast("double")
    longest_first = sorted({*dictionary, *DICTIONARY}, key=lambda w: (-len(w), w))
    covered = n - F.length(F.regexp_replace(F.lower(v), f"({'|'.join(longest_first)})", "")).cast("double")
    turns = count("[a-z](?=[0-9A-Z])") + count("[A-Z](?=[0-9a-z])") + count("[0-9](?=[A-Za-z])")
    columns = {
        "len": n, "digits": count("[0-9]") / n, "upper": count("[A-Z]") / n, "other": count("[^A-Za-z0-9]") / n, "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": v.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"), "turns": turns / n, "words": covered / n, "path": count("[/_\\-]") / n,
        "in_test": F.lit(0.0) if path is None else F.coalesce(says(path, TEST_PATHS), F.lit(0.0)), "prefix": v.rlike(f"^(?:{'|'.join(PREFIXES)})").cast("double"),
        "named_secret": says(F.regexp_replace("name", "[_-]", " "), [w.replace("_", " ").replace("-", " ") for w in SECRET_WORDS]), "named_harmless": says(F.regexp_replace("name", "[_-]", " "), HARMLESS_WORDS),
        "near_secret": says(F.col("before"), SECRET_WORDS), "near_harmless": says(F.concat_ws(" ", "before", "after"), HARMLESS_WORDS),
    }
    return found.withColumns(columns)


def example_findings(n: int = 1500, seed: int = 9) -> list[tuple[int, str, int, str, int]]:
    """(id, text, label, path, kind): n findings of known kinds, in ordinary words; label 1 is a secret. What looks like one under a path of tests or examples is a made one, label 0."""
    rnd = random.Random(seed)
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    upper = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890") for _ in range(k))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    part = lambda: rnd.choice(DICTIONARY)
    short = lambda: "".join(rnd.choice("ABCDEFGHJKMNPQRSTabcdefghjkmnpqrst23456789!$%&*#?@.") for _ in range(rnd.randrange(7, 15)))
    word = lambda: "".join(rnd.choice("aeioulnrstdmch") for _ in range(rnd.randrange(2, 9)))
    secret = [
        lambda: f"{rnd.choice(['password', 'passwd', 'secret', 'api_key', 'token'])}={rnd.choice([hexes, mixed])(rnd.randrange(16, 41))}",
        lambda: f"{rnd.choice(['token', 'secret', 'auth', 'password', 'credential'])} = \"{rnd.choice([hexes, mixed])(rnd.choice([20, 32, 40, 64]))}\"",
        lambda: f"{rnd.choice(['password', 'passwd', 'pwd', 'db_password'])}{rnd.choice(['=', ': ', ' = '])}{short()}", lambda: f"{rnd.choice(['secret', 'token'])}: {mixed(rnd.randrange(10, 24))}",
        lambda: "AKIA" + upper(16), lambda: "ghp_" + mixed(36), lambda: "sk-" + mixed(40), lambda: f"Bearer {mixed(48)}", lambda: mixed(rnd.choice([32, 40])),
    ]
    harmless = [
        lambda: f"{rnd.choice(['commit', 'sha', 'rev', 'digest', 'build'])} {hexes(40)}", lambda: f"{rnd.choice(['sha256', 'md5', 'checksum'])}:{hexes(64)}", lambda: f"id={hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
        lambda: digits(16), lambda: f"order {digits(rnd.randrange(16, 24))}", lambda: f"/{part()}/{part()}/{part()}-{digits(3)}/{part()}_{part()}.html", lambda: f"{part()}_{part()}_{part()}{digits(2)}_{part()}",
        lambda: f"{word()}.{word()}@mail{digits(1)}.{part()}-{word()}{digits(2)}{word()}.com", lambda: f"token=your_{part()}_token_here_{digits(4)}", lambda: f"https://{word()}.example.com/{part()}/{digits(6)}/{part()}",
        lambda: word() + word() + word() + word() + digits(2), lambda: f"{rnd.choice(['password', 'token', 'secret'])}: {part()}{rnd.choice(['', part()])}", lambda: f"{rnd.choice(['Password', 'Auth', 'token'])}: {word()} {word()}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        kinds = secret if label else harmless
        kind = rnd.randrange(len(kinds))
        text = " ".join([word() for _ in range(rnd.randrange(0, 5))] + [kinds[kind]()] + [word() for _ in range(rnd.randrange(0, 4))])
        tested = rnd.random() < 0.2
        path = f"{rnd.choice(TEST_PATHS)}/{word()}/{part()}" if tested else f"{rnd.choice(['src', 'lib', 'app', 'web'])}/{word()}/{word()}"
        out.append((i, text, 0 if tested else label, path, kind if label else -1 - kind))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int = 4):
    """A tree as nested (feature, threshold, below, above), or a leaf's share of secrets."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
            low = x[:, f] <= t
            if least <= low.sum() <= len(y) - least:
                parts = [y[low], y[~low]]
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
                if best is None or impurity < best[0]:
                    best = (impurity, int(f), float(t), low)
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, rng, least), grow(x[~low], y[~low], depth - 1, rng, least)


def fit_forest(findings: DataFrame, dictionary: list[str], trees: int = 21, depth: int = 6, seed: int = 4, most: int = 20_000, path: str | None = None) -> list:
    """A forest from findings(doc_id, text, label), and the column that ``path`` names; at most ``most`` of their candidates are taken. No labelled candidate: no tree."""
    label, where_from = F.col("label").cast("double").alias("label"), F.col(path).cast("string").alias("where_from") if path else None
    labelled = candidates(findings.where("label IS NOT NULL"), label, *([where_from] if path else []))
    order = F.xxhash64("value", "before", "after", "label")
    rows = features(labelled, dictionary, F.col("where_from") if path else None).orderBy(order, "doc_id", "word").limit(most).select(*FEATURES, "label").collect()
    if not rows:
        return []
    data = np.array([tuple(r) for r in rows], dtype=np.float64)
    x, y = data[:, :-1], data[:, -1]
    rng = np.random.default_rng(seed)
    picks = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return [grow(x[p], y[p], depth, rng) for p in picks]


def forest_score(forest: list) -> Column:
    """The mean of the trees' leaves, as one expression."""

    def tree(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, t, below, above = node
        return F.when(F.col(FEATURES[f]) <= t, tree(below)).otherwise(tree(above))

    return reduce(lambda a, b: a + b, [tree(t) for t in forest]) / len(forest) if forest else F.lit(0.0)


def find_secrets(docs: DataFrame, forest: list, dictionary: list[str], threshold: float = 0.5, path: str | None = None) -> DataFrame:
    """(doc_id, word, value, score, is_secret) of every candidate; ``path`` names the column of docs that says where a text comes from."""
    found = candidates(docs, F.col(path).cast("string").alias("where_from")) if path else candidates(docs)
    scored = features(found, dictionary, F.col("where_from") if path else None).withColumn("score", forest_score(forest))
    return scored.select("doc_id", "word", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def example_table(spark: SparkSession, n: int = 1500, seed: int = 9) -> DataFrame:
    return spark.createDataFrame(example_findings(n, seed), "doc_id long, text string, label int, path string, kind int")
