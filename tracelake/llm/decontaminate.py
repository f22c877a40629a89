"""Benchmark decontamination with a generalised suffix automaton of the benchmark items."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import apart, LOWER, bounded_batches, lean, mixed, passes, span_hashes, text_bytes, word_spans

WINDOW = 10
#: Benchmark bytes in one automaton (and so in one broadcast); larger benchmarks are streamed against several.
SHARD_BYTES = 1 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each text's first word."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    return starts, ends, span_hashes(data, starts, ends), first


class Automaton:
    """Suffix automaton of word sequences, parted by separators that no document holds."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        self.window = window
        items = [(i, w) for i, w in items if len(w)]
        every = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(every)
        coded = [(i, np.searchsorted(self.vocabulary, w).tolist()) for i, w in items]
        self.pairs = np.unique(np.concatenate([mixed(w[:-1]) + w[1:] for _, w in items])) if items else every
        self.shortest = min((min(len(w), window) for _, w in coded), default=window)
        self.next, self.link, self.size = [{}], [-1], [0]
        last, ends = 0, []
        for n, (item, words) in enumerate(coded):
            for j, word in enumerate(words):
                last = self._extend(last, word)
                if j >= window - 1:
                    ends.append((last, window, item))
            if len(words) < window:
                ends.append((last, len(words), item))
            last = self._extend(last, -1 - n)
        #: By state: the items whose window of the given length ends in it.
        self.found: list[dict[int, set[int]]] = [{} for _ in self.size]
        for state, length, item in ends:
            while self.size[self.link[state]] >= length:
                state = self.link[state]
            self.found[state].setdefault(length, set()).add(item)
        #: By state: the nearest state on its suffix links, itself included, where a window ends.
        self.near = [-1] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.near[state] = state if self.found[state] else self.near[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        nexts, link, size = self.next, self.link, self.size
        new = len(size)
        nexts.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p != -1:
            q = nexts[p][word]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(size)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p != -1 and nexts[p].get(word) == q:
                    nexts[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        return new

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words that lie in an occurring window, merged, and the items of those windows."""
        nexts, link, size, near, found = self.next, self.link, self.size, self.near, self.found
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = length = 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                length = size[state]
            if word not in nexts[state]:
                continue
            state = nexts[state][word]
            length += 1
            at, widest = near[state], 0
            while at > 0:
                for n, own in found[at].items():
                    if n <= length:
                        items |= own
                        widest = max(widest, n)
                at = near[link[at]] if link[at] > 0 else -1
            if widest:
                start = i + 1 - widest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """By text that has any: spans of hit words (counted from the text's first) and items.

        Only stretches whose neighbouring words are neighbours in an item are streamed: no window occurs elsewhere.
        """
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        if not len(hashes) or not len(self.vocabulary):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        joined = np.zeros(len(hashes) + 1, bool)  # word i continues the stretch of word i - 1
        if len(self.pairs):
            both = np.flatnonzero(known[:-1] & known[1:])
            pair = mixed(hashes[both]) + hashes[both + 1]
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[where] == pair] + 1] = True
        joined[first] = False
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        texts = np.searchsorted(first, starts, "right") - 1
        for text, a, b in zip(texts.tolist(), starts.tolist(), ends.tolist(), strict=True):
            spans, items = self.stream(at[a:b].tolist())
            if spans:
                own = out.setdefault(text, ([], set()))
                own[0].extend((a + s - int(first[text]), a + e - int(first[text])) for s, e in spans)
                own[1].update(items)
        return out


def automata(benchmark: DataFrame, window: int, shard_bytes: int) -> Iterator[Automaton]:
    """One automaton for each shard of items; each shard's size is bounded whatever the benchmark's."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(2 * total / shard_bytes)) if total > shard_bytes else 1
    for shard in range(shards):
        own: list[tuple[int, np.ndarray]] = []
        held = 0
        for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).toLocalIterator():
            words = hashed_words(pa.array([row.text]))[2]
            for start in range(0, max(1, len(words) - window + 1), step := max(1, shard_bytes // 8)):
                own.append((row.item_id, part := words[start : start + step + window - 1]))
                held += len(part)
                if held * 4 >= shard_bytes:
                    yield Automaton(own, window)
                    own, held = [], 0
        if own:
            yield Automaton(own, window)


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with the words that lie in an occurring window of a benchmark item.

    Returns doc_id, the columns in keep, n_words, spans (array of word ranges [start, end)
    that are hit, with their byte ranges), items (sorted item ids). A window is `window` consecutive item words; an item
    of fewer words, but not none, is one window. Items without id or text count for
    nothing; rows that repeat an item_id add their windows to that id. A null or empty
    text has no words and no hits; repeated documents are separate rows; an empty
    benchmark hits nothing. Matching is exact; whole texts are streamed.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    columns = ["doc_id", "text", *(k for k in keep if k not in ("doc_id", "text"))]
    out = docs.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    schema = f"{kinds}, n_words long, spans array<struct<start:long,end:long,from_byte:long,to_byte:long>>, items array<long>"
    out = out.select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long,from_byte:long,to_byte:long>>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("items"))

    def against(shared, out: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                for part in passes(batch, "text"):
                    _, offsets = text_bytes(part.column(1))
                    starts, ends, hashes, first = hashed_words(part.column(1))
                    hit = automaton.matches(hashes, first)
                    spans, items = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                    for text, (own, ids) in hit.items():
                        old = [(s["start"], s["end"]) for s in spans[text]]
                        base, byte = int(first[text]), int(offsets[text])
                        spans[text] = [{"start": s, "end": e, "from_byte": int(starts[base + s]) - byte, "to_byte": int(ends[base + e - 1]) - byte} for s, e in _merged(old + own)]
                        items[text] = sorted(ids | set(items[text]))
                    arrays = [*part.columns[:-3], pa.array(np.diff(first), pa.int64()), pa.array(spans, part.schema.field("spans").type), pa.array(items, part.schema.field("items").type)]
                    yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

        return out.mapInArrow(lean(run), schema)

    for automaton in automata(benchmark, window, shard_bytes):
        out = against(spark.sparkContext.broadcast(automaton), out)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def without_spans(text: Column, spans: Column) -> Column:
    """text with each span's bytes replaced by a space."""

    def cut(data: Column) -> Column:
        begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["to_byte"]))
        ends = F.concat(F.transform(spans, lambda s: s["from_byte"]), F.array(F.octet_length(data).cast("long")))
        pieces = F.zip_with(begins, ends, lambda a, b: F.decode(F.substr(data, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
        return F.array_join(pieces, " ")

    return F.get(F.transform(F.array(F.encode(text, "UTF-8")), cut), F.lit(0))  # encoded once, whatever the number of spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """documents without benchmark passages: hit spans are cut out, and a document goes whole
    when they cover more than max_coverage of its words. Columns as given; n_chars, if
    there, follows the text. Clean documents stay as they are, null and empty texts and
    rows without doc_id among them; repeated rows are treated each by itself; an empty
    table gives no rows, an empty benchmark changes nothing."""
    docs, given = apart(docs, ("doc_id", "text", "n_chars"))
    names = docs.columns
    found = match_items(docs, benchmark, window, shard_bytes, keep=tuple(names))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    dirty = F.size("spans") > 0
    kept = found.where(~dirty | (n_hit <= F.lit(max_coverage) * F.col("n_words"))).withColumn("text", F.when(dirty, without_spans(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(dirty, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*given)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
), occ AS (
  SELECT doc_id, i, k, item_id FROM (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
  ) JOIN win USING (k, g)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
