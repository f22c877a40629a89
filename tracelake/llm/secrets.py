"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

Everything runs as DataFrame expressions and Spark ML's forest; there is no Python in any
task. Findings are labelled rows of the same form as candidates, given by the caller; the
query labels a bounded sample of its own findings by rules of high precision (below), as
the tables hold no reviewed findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import chosen_share, staged

#: What may be a secret: the header of a private key, a value assigned to the name of a credential, a password in a
#: link, a key of an issuer, three joined parts, or a run of at least 16 characters of keys that holds a digit.
NAMES = r"(?:pass(?:word|wd|phrase)?|secret|token|credential|auth|api[_\-]?key|access[_\-]?key|key)"
CANDIDATE = "|".join((
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    rf"(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{NAMES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"'=:]{{6,}}+={{0,2}}",
    r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/:@]{3,}(?=@)",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9_\-.])[A-Za-z0-9_\-]{6,}+\.[A-Za-z0-9_\-]{6,}+\.[A-Za-z0-9_\-]{6,}+(?![.\w])",
    r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{16,}+={0,2}",
))
#: What stands right before a value that is assigned to a name of a credential.
ASSIGNED = rf"(?i){NAMES}[\"']?\s*[=:]\s*[\"']?$"
#: Formats of issuers.
ISSUED = r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|-----BEGIN .*)$"
#: Labelled findings that the forest is trained on, at most; and words of the dictionary.
MAX_TRAIN, DICTIONARY_WORDS = 20_000, 500
TREES, DEPTH, SEED = 30, 6, 11
CONTEXT = 80
FEATURES = ["length", "distinct", "digits", "uppers", "lowers", "hex", "turns", "turn_kinds", "covered", "slashes", "in_path", "after_scheme", "assigned", "joined", "before_length", "before_word", "before_known", "after_known", "after_joined"]
#: Features that ask what rule_label asks. A forest that learns from those rules does without them, lest it learn the rules.
OF_RULES = {"hex", "after_scheme", "assigned"}


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, candidate, before, after): each candidate with its first code point's offset and up to CONTEXT code points on either side.

    A null text has no candidates; a document's repeated strings are candidates each.
    """
    rows = docs.where(F.col("text").rlike(CANDIDATE)).select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("_row"), F.split("text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    # a candidate's row holds its own string, the gap's length and what stands beside it, never the text's arrays; so the rows of a text grow with its candidates
    beside = F.transform("gaps", lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("last"), F.left(g, F.lit(CONTEXT)).alias("first")))
    rows = rows.select("doc_id", "_row", "found", beside.alias("gaps"))
    rows = rows.select("doc_id", "_row", F.arrays_zip(F.col("found").alias("candidate"), F.slice("gaps", F.lit(1), F.size("found")).alias("left"), F.slice("gaps", F.lit(2), F.size("found")).alias("right")).alias("each"))
    each = rows.select("doc_id", "_row", F.posexplode("each").alias("i", "e")).select("doc_id", "_row", "i", "e.candidate", F.col("e.left.n").alias("gap"), F.col("e.left.last").alias("before"), F.col("e.right.first").alias("after"))
    w = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum((F.col("gap") + F.length("candidate")).cast("long")).over(w) - F.length("candidate")
    return each.select("doc_id", start.alias("start"), "candidate", "before", "after")


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The corpus's most frequent words of three letters or more, by documents that hold them; ties go by the word.

    Null and empty texts hold none; repeated rows count each; an empty table gives no words.
    """
    words = docs.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with the columns FEATURES: length, character transitions, dictionary coverage, path and neighbouring words."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    runs = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.array_contains(known, w))
    before, after = F.regexp_extract(F.lower("before"), r"(\p{L}+)[^\p{L}]*$", 1), F.regexp_extract(F.lower("after"), r"^[^\p{L}]*(\p{L}+)", 1)
    columns = {
        "length": n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "hex": c.rlike("^[0-9a-f]+$"),
        "turns": share("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        "turn_kinds": F.when(c.rlike("[a-z][A-Z]"), 1).otherwise(0) + F.when(c.rlike("[A-Za-z][0-9]"), 1).otherwise(0) + F.when(c.rlike("[0-9][A-Za-z]"), 1).otherwise(0),
        "covered": F.aggregate(runs, F.lit(0), lambda s, w: s + F.length(w)) / n,
        "slashes": share("/"),
        "in_path": F.col("before").rlike(r"[\w.\-]+/$") | F.col("after").rlike(r"^(/|\.[a-z]{2,5}\b)"),
        "after_scheme": F.col("before").rlike(r"[a-z]+://\S*$"),
        "assigned": F.col("before").rlike(ASSIGNED),
        "joined": F.col("before").rlike(r"[=:]\s?[\"']?$"),
        "before_length": F.length(before),
        "before_word": F.pmod(F.xxhash64(before), F.lit(32)),
        "before_known": F.array_contains(known, before),
        "after_known": F.array_contains(known, after),
        "after_joined": F.col("after").rlike(r"^\S"),
    }
    return found.select("*", *(x.cast("double").alias(name) for name, x in columns.items()))


def rule_label() -> Column:
    """1 for issuers' formats and assigned values of mixed letters and digits, 0 for digests, links and words with a number; else null."""
    c = F.col("candidate")
    return (
        F.when(c.rlike(ISSUED) | (F.col("before").rlike(ASSIGNED) & c.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")), 1.0)
        .when(c.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | F.col("before").rlike(r"[a-z]+://\S*$") | c.rlike(r"^[0-9\-/]+$") | c.rlike(r"^[A-Za-z_\-/]{12,}[0-9]{1,4}$"), 0.0)
    )


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, names: tuple[str, ...] = tuple(FEATURES)) -> RandomForestClassificationModel | None:
    """A forest on the features `names` of labelled findings (FEATURES and label), at most about max_train of them; None unless both labels occur.

    The same names are to be given to scan. Findings without doc_id or start are hashed like any other.
    """
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    key = F.xxhash64("doc_id", "start")
    chosen = F.when(F.col("label") == 1, chosen_share(key, max_train / 2 / counts[1.0])).otherwise(chosen_share(key, max_train / 2 / counts[0.0]))
    sample = VectorAssembler(inputCols=list(names), outputCol="x").transform(labelled.where(chosen)).select("x", "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(sample)


def score_found(found: DataFrame, model: RandomForestClassificationModel | None, min_score: float = 0.5, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """Candidates with their features, scored as scan says."""
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        assembled = VectorAssembler(inputCols=list(names), outputCol="x").transform(found)
        scored = model.transform(assembled).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "start", "candidate", "score", (F.col("score") >= min_score).alias("is_secret"))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None, words: list[str], min_score: float = 0.5, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """Every candidate of every document: doc_id, start, candidate, score (the forest's probability of a secret) and is_secret.

    Without a model every candidate stays, with score 1. Null texts have no candidates;
    repeated rows give theirs each; an empty table gives no rows; other columns are ignored.
    """
    return score_found(features(candidates(docs), words), model, min_score, names)


def learned_findings(found: DataFrame) -> DataFrame:
    """The findings that rule_label labels, of documents other than those that the fold keeps out."""
    return found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).withColumn("label", rule_label()).where("label IS NOT NULL")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # texts are searched once; candidates with their features are few
    found = staged(features(candidates(docs), dictionary(docs)), "findings")
    names = tuple(n for n in FEATURES if n not in OF_RULES)
    out = score_found(found, train(learned_findings(found), names=names), names=names)
    return out.select("doc_id", "start", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")
