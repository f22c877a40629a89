"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash, so that merging runs shuffles nothing.
The lines of a new batch of documents are merge-anti-joined with the runs: the lines that
no run holds, with their totals in the batch, are the batch's own run. The others are
repeats, kept apart with theirs. A line is thus in one run only, and its totals are its
run's and those of its repeats. When a level holds FANOUT runs they are compacted into
one run of the next level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, dropped, lean, passes, shared_dir, shared_path, staged

STRIP = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 4


def _keys(texts: pa.Array, min_chars: int) -> tuple[pa.Array, list[bytes | None], np.ndarray]:
    """Lines of all texts on end, the hash of each line that counts (else None), and each text's first line."""
    parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    lines = parts.flatten()
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=STRIP))
    counts = pc.greater_equal(pc.utf8_length(keys), min_chars).to_pylist()
    hashes = [xxhash.xxh3_128_digest(k.as_buffer()) if c else None for k, c in zip(keys, counts, strict=True)]
    return lines, hashes, np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))).astype(np.int64)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key) for each distinct counting line of each document that has a doc_id."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                _, hashes, first = _keys(part.column(1), min_chars)
                ids, keys = [], []
                for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = {x for x in hashes[a:b] if x is not None}
                    ids += [doc] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, key binary")


RUN = "key binary, n_docs long, last_doc long"


class LineRuns:
    """Runs of (key, n_docs, last_doc) by level, and the repeats of their keys in later batches."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # files of one write to a bucket each are read as sorted as they were written
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _table(self, df: DataFrame) -> str:
        """Writes df, whose rows lie by key already, as a table of one sorted file for each bucket."""
        path = shared_path(self.spark, "run")
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        df.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            dropped(self.spark, f"{shared_dir(self.spark)}/{name.replace('_', '-')}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds."""
        for run in self.runs():
            batch = batch.join(run.select("key").hint("merge"), "key", "left_anti")
        return batch

    def add(self, keys: DataFrame) -> None:
        """Takes (doc_id, key) rows of documents that no earlier batch held; a pair counts once."""
        batch = keys.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        whole = self._table(batch)
        own = self._table(self.fresh(self.spark.table(whole)))
        if any(self.levels):
            self.repeats.append(self._table(self.spark.table(whole).join(self.spark.table(own).select("key").hint("merge"), "key", "left_anti")))
        self._drop(whole)
        self.levels[0].append(own)
        self.compact()

    def compact(self) -> None:
        """Runs of a full level become one of the next; no key is in two of them."""
        level = 0
        while level < len(self.levels):
            if len(old := self.levels[level]) >= self.fanout:
                if len(self.levels) == level + 1:
                    self.levels.append([])
                rows = reduce(DataFrame.unionByName, map(self.spark.table, old))
                self.levels[level] = []
                self.levels[level + 1].append(self._table(rows.repartition(self.buckets, "key")))
                self._drop(*old)
            level += 1

    def often(self, min_docs: int) -> DataFrame:
        """(key, n_docs, last_doc) of keys in at least min_docs documents."""
        found = self.spark.createDataFrame([], RUN)
        again = reduce(DataFrame.unionByName, map(self.spark.table, self.repeats), found)
        again = again.groupBy("key").agg(F.sum("n_docs").alias("n0"), F.max("last_doc").alias("d0"))
        for run in self.runs():
            both = run.join(again, "key", "left").select("key", (F.col("n_docs") + F.coalesce("n0", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "d0").alias("last_doc"))
            found = found.unionByName(both.where(F.col("n_docs") >= min_docs))
        return found

    def drop(self) -> None:
        self._drop(*(name for level in self.levels for name in level), *self.repeats)
        self.levels, self.repeats = [[]], []


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Documents without their repeated lines, kept only in the largest doc_id that holds them.

    Returns doc_id, kept (text), n_lines, n_dropped, kept_sha256. A line's key is the line
    stripped of ASCII white space with A-Z lower-cased; keys shorter than min_chars code
    points or found in fewer than min_docs documents keep all lines. A null text is one
    empty line; an empty table gives no rows. Rows that repeat a doc_id are one document
    in the counts and each keeps its row; a row without doc_id is not counted and loses
    nothing. Further columns of docs are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    path = shared_path(spark, "line-keys")
    line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, key binary, batch int").parquet(path)  # batches are folders
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", "key"))
    often = staged(runs.often(min_docs), "often")
    runs.drop()
    losing = staged(keys.join(often, "key").where("doc_id < last_doc").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "losing")
    dropped(spark, path)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in passes(batch, "text"):
                lines, hashes, first = _keys(part.column(1), min_chars)
                texts = part.column(1).to_pylist()
                kept, n_dropped = [], []
                for i, (a, b, bad) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), part.column(2).to_pylist(), strict=True)):
                    if not bad:
                        kept.append(texts[i] or "")
                        n_dropped.append(0)
                        continue
                    bad = set(bad)
                    stay = [j for j in range(a, b) if hashes[j] not in bad]
                    kept.append("\n".join(lines[j].as_py() for j in stay))
                    n_dropped.append(b - a - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string())],
                    ["doc_id", "kept", "n_lines", "n_dropped", "kept_sha256"],
                )

    return docs.join(losing, "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(lean(run), "doc_id long, kept string, n_lines long, n_dropped long, kept_sha256 string")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), f AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL AND doc_id < last_doc) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL OR doc_id >= last_doc), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""
