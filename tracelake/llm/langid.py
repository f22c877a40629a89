"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, lean, passes

BITS, ORDERS, ALPHA = 16, (1, 2, 3), 0.5
#: Labelled documents that n-grams are counted in, about at most; chosen by a hash of doc_id, alike many of each language.
MAX_TRAIN_DOCS = 8000
#: The broadcast matrix of float32 has a row for each bucket and a column for each language. Its size is bounded: from
#: MATRIX / 2**BITS languages on, twice as many have half as many buckets.
MATRIX = 1 << 24
#: A letter is a character of Unicode category L.
LETTER = regex.compile(r"\p{L}")

_A, _B = np.uint32(2654435761), np.uint32(2246822519)


def ngrams(texts: list[str | None], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram that begins at each character (2**bits where none does), and each text's first character.

    Characters are code points of the lower-cased text; digits count alike, as does white space.
    """
    low = [(t or "").lower() for t in texts]
    first = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    chars[(chars >= 48) & (chars <= 57)] = 48
    chars[(chars >= 9) & (chars <= 13)] = 32
    out, none = [], np.int64(1 << bits)
    code = np.zeros(len(chars), np.uint32)
    for n in range(1, max(orders) + 1):
        code = code[: len(chars) - n + 1] if n > 1 else code
        code = (code + chars[n - 1 :] if len(chars) >= n else code[:0]) * _A
        code = code ^ (code >> np.uint32(15))
        if n in orders:
            x = (code + np.uint32(n)) * _B
            bucket = (x >> np.uint32(32 - bits)).astype(np.int64)
            for back in range(1, n):
                at = first[1:-1] - back
                bucket[at[(at >= 0) & (at < len(bucket))]] = none
            out.append(bucket)
    return out, first


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (2**bits + 1, languages); the last row is zero
    prior: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's likeliest language, and its posterior probability."""
        buckets, first = ngrams(texts, int(np.log2(len(self.logp) - 1)))
        total = np.tile(self.prior, (len(texts), 1))
        some = np.flatnonzero(np.diff(first) > 0)
        block = max(1, (1 << 22) // len(self.langs))
        for bucket in buckets:
            # a text's rows are summed block by block, so that many languages take no more memory
            for a in range(0, len(bucket), block):
                b = min(len(bucket), a + block)
                own = some[(first[some] < b) & (first[some + 1] > a)]
                if len(own):
                    total[own] += np.add.reduceat(self.logp[bucket[a:b]], np.maximum(first[own] - a, 0), axis=0, dtype=np.float64)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is a multiple of 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, bits: int = BITS, alpha: float = ALPHA) -> Model:
    """Learns from text and lang of labelled documents that are not held out.

    Priors are of all labelled documents. N-grams are counted in about max_docs of them at
    most: an equal share of it for each language, all of a language that has fewer. Rows
    without text, lang or doc_id teach nothing; rows that repeat a doc_id are chosen or
    left together; without any row to learn from, every document is `und`.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    bits = min(bits, max(1, int(np.log2(MATRIX / max(1, len(langs))))))
    # rows hashed up to a language's limit are chosen; one row for each language is broadcast
    limits = [(x, min((1 << 63) - 1, int(max_docs / len(langs) / n * 2.0**64) - (1 << 63))) for x, n in sizes.items()]
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most long"))
    sample = labelled.join(limits, "lang").where(F.xxhash64("doc_id") <= F.col("most")).select("lang", "text")
    buckets = (1 << bits) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in passes(batch, "text"):
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    rows = [t for x, t in zip(langs, part.column(1).to_pylist(), strict=True) if x == lang]
                    own = found.setdefault(lang, np.zeros(buckets, np.int64))
                    for bucket in ngrams(rows, bits)[0]:
                        own += np.bincount(bucket, minlength=buckets)
        for lang, own in found.items():
            own[-1] = 0
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((buckets, max(1, len(langs))))
    found = rows.toPandas()
    if len(found):
        counts[found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"].to_numpy().astype(str))] = found["n"].to_numpy()
    prior = np.array([sizes[x] + 1.0 for x in langs] or [1.0])
    prior = np.log(prior / prior.sum())
    counts = counts[:-1] + alpha
    logp = np.log(counts / counts.sum(axis=0))
    return Model(langs or ["und"], np.vstack([logp, np.zeros((1, logp.shape[1]))]).astype(np.float32), prior)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, lang_pred and score for every document, from its text alone.

    lang_pred is the likeliest learned language, score its posterior probability; a text
    that is null or has no letter is `und` with score 0. Where nothing could be learned
    every document is `und`. Repeated rows are scored each; other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    columns = ["doc_id", "text", *(k for k in keep if k not in ("doc_id", "text"))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            for part in passes(batch, "text"):
                texts = part.column(1).to_pylist()
                best, score = model.scores(texts)
                none = np.array([t is None or LETTER.search(t) is None for t in texts])
                pred = names[np.where(none, len(names) - 1, best)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(np.where(none, 0.0, score))], [*part.schema.names, "lang_pred", "score"])

    picked = docs.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    out = picked.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")
    return out if "text" in keep else out.drop("text")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
