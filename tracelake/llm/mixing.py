"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import staged

#: Target entropy as a share of the largest possible, and how often a source may be repeated at most.
TARGET_ENTROPY, MAX_REPEATS, SEED = 0.98, 2.0, "mix-1"
ROUNDS, BITS = 5, 4
#: Documents of a source and key range that one window task sorts, about.
RANGE_DOCS = 20_000


def estimated_tokens(text: str = "text") -> Column:
    """A quarter of the characters, rounded up; null is 0."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Temperature:
    exponent: float  # weights are shares ** exponent, normalised
    log_z: float  # log of the sum of shares ** exponent
    total: int  # tokens of all sources
    least_log_share: float
    largest_log_share: float


def bisect(sources: DataFrame, target_entropy: float, max_repeats: float) -> Temperature:
    """The largest exponent in [0, 1] at which the mixture's entropy still is target_entropy of the maximum, or, if
    larger, the smallest at which no source is repeated over max_repeats times for a whole pass over the largest.

    sources: (source, tokens), tokens over 0. Each round takes BITS halvings at once: all
    inner points are aggregated in one pass, and only those sums reach the driver.
    """
    total, n, least, most = sources.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return Temperature(1.0, 0.0, 0, 0.0, 0.0)
    total = int(total)
    log_p = F.log(F.col("tokens") / F.lit(float(total)))

    def sums(points: list[float]) -> dict[int, tuple[float, float]]:
        each = sources.select(log_p.alias("lp"), F.posexplode(F.array(*map(F.lit, points))).alias("k", "t"))
        rows = each.groupBy("k").agg(F.sum(F.exp(F.col("t") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("t") * F.col("lp")) * F.col("t") * F.col("lp")).alias("s"))
        return {r.k: (r.z, r.s) for r in rows.collect()}

    goal = target_entropy * math.log(n)
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (1 << BITS)
        points = [low + step * i for i in range(1, 1 << BITS)]
        found = sums(points)
        ok = [i for i in range(1, 1 << BITS) if math.log(found[i - 1][0]) - found[i - 1][1] / found[i - 1][0] >= goal]
        at = max(ok, default=0)  # entropy falls as the exponent grows
        low, high = low + step * at, low + step * (at + 1)
    limit = 1 - math.log(max_repeats) / math.log(most / least) if most > least * max_repeats else 0.0
    exponent = round(max(low, limit), 6)
    z = sums([exponent])[0][0]
    return Temperature(exponent, math.log(z), total, math.log(least / total), math.log(most / total))


def mix(docs: DataFrame, tokens: Column | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document goes into the mixture: docs' columns doc_id and source, tokens, weight, budget, copies, and the columns `keep` of docs.

    A source's budget is its weight times the whole budget (default: the least at which
    every source is passed over once, so that no document is left out). It is spent in
    blocks, each a permutation of the source's documents by md5(seed, doc_id): whole
    blocks while they fit, then the documents of one more that begin within the rest.
    copies counts a document's blocks.

    Null sources are one source of their own (''), null or empty texts have no tokens; a
    source without tokens stands outside the mixture and keeps each document once. Ties
    of the permutation (rows that repeat a doc_id) go by tokens; rows equal in both may
    share the last block either way. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (estimated_tokens() if tokens is None else tokens).cast("long").alias("tokens"), *keep)
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    n_docs = docs.select("source").count()
    digits = max(1, min(6, math.ceil(math.log(max(n_docs, 1) / RANGE_DOCS + 1, 16))))
    # two levels of prefix sums: over key ranges of a source, and within each range, so that no source is one task
    rows = rows.withColumn("part", F.substring("key", 1, digits))
    ranges = staged(rows.groupBy("source", "part").agg(F.sum("tokens").alias("part_tokens")), "ranges")
    per_source = ranges.groupBy("source").agg(F.sum("part_tokens").alias("tokens"))
    t = bisect(per_source.where("tokens > 0"), target_entropy, max_repeats)
    weight = F.exp(F.lit(t.exponent) * F.log(F.col("total") / F.lit(float(max(t.total, 1)))) - F.lit(t.log_z))
    whole = budget if budget is not None else math.ceil(math.exp(t.largest_log_share * (1 - t.exponent) + t.log_z) * t.total)
    share = F.floor(F.round(weight * F.lit(float(whole)), 3)).cast("long")
    by_source, in_part = Window.partitionBy("source"), Window.partitionBy("source", "part").orderBy("key", "doc_id", "tokens")
    ranges = ranges.select(
        "source", "part",
        F.sum("part_tokens").over(by_source).alias("total"),
        (F.sum("part_tokens").over(by_source.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("part_tokens")).alias("part_start"),
    ).withColumn("weight", F.when(F.col("total") > 0, weight)).withColumn("budget", F.when(F.col("total") > 0, share))
    placed = rows.join(ranges, ["source", "part"]).withColumn("start", F.col("part_start") + F.sum("tokens").over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    copies = F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total")) + F.when(F.col("start") < F.col("budget") % F.col("total"), 1).otherwise(0)).otherwise(1)
    return placed.select("doc_id", "source", "tokens", "weight", "budget", copies.cast("long").alias("copies"), *keep)


def blocks(mixture: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture as it is read: one row for each copy, the columns of mixture, block (from 0) and the key that orders a block.

    The copies of one row lie in different blocks; each block is a permutation of its own.
    Rows without copies are in no block; rows that repeat a doc_id have one key.
    """
    each = mixture.where("copies > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("block").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of every block of the mixture."""
    out = blocks(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "source", "tokens", F.round("weight", 6).alias("weight"), "budget", "copies", "block", "key")


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(CAST(ceil(length(text) / 4) AS BIGINT), 0) AS tokens, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents
), s AS MATERIALIZED (SELECT source, sum(tokens)::BIGINT AS total FROM d GROUP BY source),
p AS MATERIALIZED (SELECT ln(total::DOUBLE / (SELECT sum(total) FROM s)::DOUBLE) AS lp FROM s WHERE total > 0),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= {TARGET_ENTROPY} * ln((SELECT count(*) FROM p)) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= {TARGET_ENTROPY} * ln((SELECT count(*) FROM p)) THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(exp((lo + hi) / 2 * lp))) - sum(exp((lo + hi) / 2 * lp) * (lo + hi) / 2 * lp) / sum(exp((lo + hi) / 2 * lp)) FROM p) AS h FROM b) WHERE i < {ROUNDS * BITS}
), t AS (
  SELECT round(greatest((SELECT lo FROM b WHERE i = {ROUNDS * BITS}), (SELECT CASE WHEN max(total) > min(total) * {MAX_REPEATS} THEN 1 - ln({MAX_REPEATS}) / ln(max(total)::DOUBLE / min(total)) ELSE 0 END FROM s WHERE total > 0)), 6) AS x
), z AS (SELECT x, ln(sum(exp(x * lp))) AS lz, max(lp) AS mx FROM p, t GROUP BY x),
w AS (
  SELECT source, total, exp(x * ln(total::DOUBLE / (SELECT sum(total) FROM s)::DOUBLE) - lz) AS weight,
    floor(round(exp(x * ln(total::DOUBLE / (SELECT sum(total) FROM s)::DOUBLE) - lz) * ceil(exp(mx * (1 - x) + lz) * (SELECT sum(total) FROM s)), 3))::BIGINT AS budget
  FROM s, z WHERE total > 0
)
, m AS (
SELECT doc_id, d.source, tokens, round(weight, 6) AS weight, budget,
  CASE WHEN total > 0 THEN budget // total + CASE WHEN sum(tokens) OVER (PARTITION BY d.source ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens < budget % total THEN 1 ELSE 0 END ELSE 1 END AS copies
FROM d LEFT JOIN w ON d.source = w.source
)
SELECT doc_id, source, tokens, weight, budget, copies, block, md5('{SEED}:' || block::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key
FROM (SELECT *, unnest(range(copies)) AS block FROM m)
"""
