"""N-gram Jaccard join: subsets of small sets, inverted lists of large ones, parted where the measured cost says.

Documents become sets of distinct word shingles; equal sets are one class, and only
classes are joined. Two sets with overlap c share a subset of size c, so small sets meet
on the hashes of their subsets (enumerated by leaving few elements out). Large sets meet
on the inverted lists of their prefix: the floor(n (1 - t)) + 1 first shingles in an order
that puts corpus-wide frequent ones last. Short lists are joined; long ones are scanned in
pairs of blocks, where count sketches bound the difference of two sets from below, so
that only pairs that may be links leave the scan. Sets that share most of their long
lists are a family, whose links are counted without a row for each (see families). Links
are exact: every candidate's whole sets are intersected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, Scratch, bounded_batches, freed_shuffles, in_parts, lean, mixed, passes, span_hashes, staged, text_bytes, word_spans
from tracelake.llm.components import components
from tracelake.llm.families import differences, family_links, leaders, recurring

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

WORDS, PERCENT = 3, 90
#: Shingles that a broadcast holds as frequent, at most (8 bytes each); the order of all others is that of their hashes.
MAX_FREQUENT = 200_000
FREQUENT_DOCS = 64
#: Inverted lists up to this length are joined, longer ones scanned in blocks of this many sets.
SHORT_LIST, BLOCK = 48, 256
#: Tokens by which a pair is told to have left an earlier list.
BEFORE = 8
#: How many times the distance of a link a set's sketch may have from its leader's.
CLOSE = 2
#: Counters of a sketch. Sets of over FINE elements a counter have a finer one too, of at least one counter for FINE elements.
SKETCH, FINE = 128, 8
#: Positions of the bitmap of documents whose sets are compared: 1 MB.
BITMAP_BITS = 23
#: Largest set size that subsets may be enumerated for.
MAX_LIGHT = 39

_A, _B, _C = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order (repeats included) and each text's first; a text of fewer words is one shingle."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    h = span_hashes(data, starts, ends)
    n = np.diff(first)
    size = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(size)))
    word = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], size)  # first word of each shingle
    code = np.repeat(np.where(n >= words, words, n).astype(np.uint64), size)
    last = np.repeat(first[1:], size)
    padded = np.concatenate((h, np.zeros(words, np.uint64)))
    for k in range(words):
        own = np.where(word + k < last, padded[word + k], np.uint64(0))
        code = mixed(code * _A + own * _B + _C)
    return code, at


def set_hash(elements: np.ndarray) -> int:
    """Identity of a set, from its sorted elements."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def sketch_of(elements: np.ndarray, width: int) -> bytes:
    """How many elements fall to each of width counters, a power of two. The counters of two sets differ by no more than the sets do."""
    return np.minimum(np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def fine_width(n: int) -> int:
    return 1 << max(0, (n - 1) // FINE).bit_length() if n > FINE * SKETCH else 0


def sketch_distance(p: bytes, q: bytes) -> int:
    """The difference of two sketches, of which the wider is folded."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int32) for s in (p, q))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(2, -1).sum(axis=0)
    return int(np.abs(x - y).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def frequent_shingles(docs: DataFrame, words: int, min_docs: int = FREQUENT_DOCS, at_most: int = MAX_FREQUENT) -> np.ndarray:
    """Sorted hashes of shingles that at least min_docs documents are seen to share; only the order of prefixes depends on them, no result.

    Every document is counted, in each task by a table of the shingles that recur within a few MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in passes(batch, "text"):
                code, at = shingles(part.column(0), words)
                own = np.sort(code)
                edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate((edge, [len(own)])))
                k, n = own[edge][n > 1], n[n > 1]
                keys, inverse = np.unique(np.concatenate((keys, k)), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate((counts, n)), len(keys)).astype(np.int64)
                if len(keys) > at_most:
                    top = np.sort(np.argpartition(-counts, at_most)[:at_most])
                    keys, counts = keys[top], counts[top]
        some = counts >= 4
        yield pa.RecordBatch.from_arrays([_signed(keys[some]), pa.array(counts[some])], ["shingle", "n"])

    found = docs.select("text").mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    rows = found.orderBy(F.desc("n"), "shingle").limit(at_most).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def set_table(docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, n, set_id, prefix, sketch, fine, small): one row per document; set_id null and arrays empty without words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in passes(batch, "text"):
                code, at = shingles(part.column(1), words)
                where = np.minimum(np.searchsorted(often, code), max(len(often) - 1, 0))
                common = often[where] == code if len(often) else np.zeros(len(code), bool)
                sizes, ids, prefixes, sketches, fine, small = [], [], [], [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = code[a:b]
                    rare = np.unique(own[~common[a:b]])
                    own = np.concatenate((rare, np.unique(own[common[a:b]])))
                    n = len(own)
                    sizes.append(n)
                    if not n:
                        ids.append(None)
                        prefixes.append([])
                        sketches.append(b"")
                        fine.append(b"")
                        small.append([])
                        continue
                    whole = np.sort(own)
                    ids.append(set_hash(whole))
                    prefixes.append(own[: n * (100 - percent) // 100 + 1].view(np.int64))
                    sketches.append(sketch_of(own, SKETCH))
                    fine.append(sketch_of(own, width) if (width := fine_width(n)) else b"")
                    small.append(whole.view(np.int64) if n <= MAX_LIGHT else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(fine, pa.binary()), pa.array(small, pa.list_(pa.int64()))],
                    ["doc_id", "n", "set_id", "prefix", "sketch", "fine", "small"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n long, set_id long, prefix array<long>, sketch binary, fine binary, small array<long>")


def _near(n: str, m: str, percent: int) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def subsets_left(n: int, percent: int) -> int:
    """How many subsets a set of n elements is enumerated into."""
    return sum(comb(n, d) for d in range(n * (100 - percent) // 100 + 1))


def light_links(sets: DataFrame, largest: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, degrees) of the sets of up to `largest` elements: links (a, b) that connect what is linked, and each linked set's number of links (set_id, n_links).

    In a group of one subset of size c, sets link exactly if c is enough for their sizes,
    so for links the smallest set stands for the group: it is linked to all that c allows.
    Every linked pair is counted in the group of its whole intersection, where the elements
    that both leave out are disjoint. Inclusion and exclusion over the parts of those
    elements count such partners of a set without making pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, overlaps, keys, left = [], [], [], [], []
            for set_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = mixed(np.array(own, np.int64).view(np.uint64))
                n, total = len(own), int(own.sum(dtype=np.uint64))
                own = own.tolist()
                for d in range(n * (100 - percent) // 100 + 1):
                    for out in combinations(own, d):
                        ids.append(set_id)
                        sizes.append(n)
                        overlaps.append(n - d)
                        keys.append((total - sum(out)) & ((1 << 64) - 1))
                        left.append(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(overlaps, pa.int64()), _signed(np.array(keys, np.uint64)), pa.array(left, pa.list_(pa.int64()))], ["set_id", "n", "c", "key", "out"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sums, signs = [], [], []
            for r, out in enumerate(batch.column(4).to_pylist()):
                for d in range(len(out) + 1):
                    for part in combinations(out, d):
                        rows.append(r)
                        sums.append(sum(part) & ((1 << 64) - 1))
                        signs.append(-1 if d % 2 else 1)
            kept = batch.select(["set_id", "n", "c", "key"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, _signed(np.array(sums, np.uint64)), pa.array(signs, pa.int64())], ["set_id", "n", "c", "key", "part", "sign"])

    each = sets.where(F.col("n") <= largest).select("set_id", "small").mapInArrow(lean(run), "set_id long, n long, c long, key long, out array<long>")
    head = each.groupBy("c", "key").agg(F.min(F.struct("n", "set_id")).alias("h"), F.count("*").alias("k")).where("k > 1")
    enough = f"{100 + percent} * c >= {percent} * (n + {{}})"
    # a set that not even the smallest of its group is linked to has no link there
    groups = scratch.put(each.join(head.select("c", "key", "h"), ["c", "key"]).where(enough.format("h.n")).select("set_id", "n", "c", "key", "out", "h"), "subsets")
    links = groups.where("set_id <> h.set_id").select(F.least("set_id", "h.set_id").alias("a"), F.greatest("set_id", "h.set_id").alias("b")).distinct()
    split = scratch.put(groups.select("set_id", "n", "c", "key", "out").mapInArrow(lean(parts), "set_id long, n long, c long, key long, part long, sign long"), "parts")
    partners = split.groupBy("c", "key", "part", "n").agg(F.count("*").alias("k")).withColumnRenamed("n", "m")
    counted = split.join(partners, ["c", "key", "part"]).where(enough.format("m")).groupBy("set_id").agg(F.sum(F.col("sign") * F.col("k")).alias("k"))
    # a set that leaves nothing out of a group has counted itself there
    itself = groups.where("size(out) = 0").select("set_id", F.lit(-1).cast("long").alias("k"))
    degrees = counted.unionByName(itself).groupBy("set_id").agg(F.sum("k").alias("n_links")).where("n_links > 0")
    return links, degrees


def scanned_pairs(rows: DataFrame, percent: int, boundary: int = 0) -> DataFrame:
    """Candidate pairs of long lists with a set of over `boundary` elements, other than those of one family: rows (token, set_id, n, leader, sketch, before, block, blocks).

    Each pair of blocks of a list is a group of its own of at most about 2 BLOCK rows. A
    pair leaves the list of its first common prefix token, and others only if none of the
    tokens in `before` (those of the BEFORE smallest long lists of a set that are smaller) is common; and only if the
    sketches let the sets differ little enough.
    """
    left = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "n", F.coalesce("leader", F.lit(0)).alias("leader"), F.col("leader").isNotNull().alias("led"), "sketch", "before")
    most = 100 - percent

    def scan(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, ids, n, leader = (table.column(c).to_numpy() for c in ("block", "set_id", "n", "leader"))
        led = np.array(table.column("led").to_pylist(), bool)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        before = table.column("before").combine_chunks()
        held: dict[int, frozenset] = {}

        def before_of(r: int) -> frozenset:
            if r not in held:
                held[r] = frozenset(before[r].as_py())
            return held[r]

        xs, ys = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for k, x in enumerate(xs.tolist()):
            to = xs[k + 1 :] if i == j else ys
            to = to[(100 * np.minimum(n[to], n[x]) >= percent * np.maximum(n[to], n[x])) & (np.maximum(n[to], n[x]) > boundary) & ~(led[x] & led[to] & (leader[to] == leader[x]))]
            differ = np.abs(sketch[to] - sketch[x]).sum(axis=1, dtype=np.int64)
            for y in to[differ * (100 + percent) <= (n[to] + n[x]) * most].tolist():
                if before_of(x).isdisjoint(before_of(y)):
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("token", "i", "j").applyInArrow(scan, "a long, b long")


def shared_lists(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, set_id, n, size) of the prefix tokens that two sets or more have; most tokens are one set's alone."""
    tokens, out = sets.select("set_id", "n", F.explode("prefix").alias("token")), []
    for own in in_parts(tokens, "token", sets.agg(F.sum(F.size("prefix"))).first()[0] or 0):
        lists = own.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
        out.append(scratch.put(own.join(lists, "token").select("token", "set_id", "n", "size"), "lists"))
    return reduce(DataFrame.unionByName, out)


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, links, degrees) of links between different sets with 100 |A and B| >= percent |A or B|.

    table has doc_id, n and set_id of every document, degrees (set_id, n_links) the number of
    links of every set that has any. links (a, b) are links that connect the same sets as
    all of them; no table has a row for every pair of a large group.
    """
    bounded_batches(docs.sparkSession)
    freed_shuffles(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession)
    whole = scratch.put(set_table(docs, frequent_shingles(docs, words), words, percent), "sets")
    table = scratch.put(whole.select("doc_id", "n", "set_id"), "documents")
    sets = scratch.put(whole.where("n > 0 AND doc_id IS NOT NULL").select("set_id", "n", "prefix", "sketch", "fine", "small").dropDuplicates(["set_id"]), "classes")
    scratch.drop("sets")
    shared = shared_lists(sets, scratch)

    # the boundary: up to which size is it cheaper to enumerate subsets than to scan lists
    scan_cost = {r.n: r.cost for r in shared.where(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.sum("size").alias("cost")).collect()}
    n_sets = {r.n: r.k for r in sets.where(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.count("*").alias("k")).collect()}
    steps = sorted({x for x in range(1, MAX_LIGHT + 1) if (x + 1) * (100 - percent) // 100 > x * (100 - percent) // 100} | {MAX_LIGHT})
    cost = {x: sum(k * subsets_left(n, percent) if n <= x else scan_cost.get(n, 0) for n, k in n_sets.items()) for x in [0, *steps]}
    boundary = min(cost, key=lambda x: (cost[x], x))
    light, light_degrees = light_links(sets, boundary, percent, scratch)

    # a light set may link to a heavy one of nearly its size: such sets go both ways, but pairs of two light ones do not
    heavy = shared.where(f"100 * n >= {percent} * {boundary + 1}")
    short, long = heavy.where(f"size <= {SHORT_LIST}"), heavy.where(f"size > {SHORT_LIST}")
    described = sets.select("set_id", "n", "sketch", "fine")
    led = scratch.put(leaders(long, percent, lambda pairs: near_sketches(pairs, described, "set_id", "leader", percent, CLOSE), scratch), "led")
    scratch.drop("heads", "first-leaders", "leaders")
    x, y = short.select("token", F.col("set_id").alias("a"), F.col("n").alias("na")), short.select("token", F.col("set_id").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, "token").where(f"a < b AND greatest(na, nb) > {boundary} AND {_near('na', 'nb', percent)}").select("a", "b")
    # a list that one family has to itself is not scanned
    named = scratch.put(long.join(led.select("set_id", "leader"), "set_id", "left").select("token", "set_id", "n", "size", "leader"), "named")
    open_lists = named.groupBy("token").agg(F.count("leader").alias("k"), F.count("*").alias("n"), F.min("leader").alias("l"), F.max("leader").alias("h")).where("k < n OR l <> h").select("token")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    firsts = named.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_list("token")), 1, BEFORE).alias("firsts"))
    rows = named.join(open_lists, "token").join(firsts, "set_id").join(sets.select("set_id", "sketch"), "set_id")
    before = F.filter("firsts", lambda t: t < F.col("token"))
    rows = rows.select("token", "set_id", "n", "leader", "sketch", before.alias("before"), F.pmod(F.xxhash64("set_id"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    pairs = scratch.put(pairs.unionByName(scanned_pairs(rows, percent, boundary)).distinct(), "pairs")
    scratch.drop("lists", "named")

    pairs = scratch.put(likely(pairs, sets.select("set_id", "n", "sketch", "fine").join(led.select("set_id", "leader"), "set_id", "left"), percent), "likely")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(led.select("set_id")).unionByName(led.select(F.col("leader").alias("set_id"))).distinct()
    elements = scratch.put(whole_sets(docs, table, wanted, words), "elements")
    scratch.drop("pairs", "classes")
    found = scratch.put(overlapping(pairs, elements, percent), "verified")
    deltas = scratch.put(differences(led, elements), "differences")
    scratch.drop("likely", "elements")
    within = scratch.put(family_links(scratch.put(recurring(deltas, scratch), "recurring"), percent, boundary), "families")
    scratch.drop("differences", "led", "extras", "recurring")
    one = F.lit(1).cast("long").alias("n_links")
    degrees = light_degrees.unionByName(found.select(F.explode(F.array("a", "b")).alias("set_id"), one)).unionByName(within.where("k IS NOT NULL").select(F.col("a").alias("set_id"), F.col("k").alias("n_links")))
    degrees = scratch.put(degrees.groupBy("set_id").agg(F.sum("n_links").alias("n_links")), "degrees")
    links = scratch.put(light.unionByName(found).unionByName(within.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "links")
    scratch.drop("verified", "families", "subsets", "parts")
    return table, links, degrees


def _position(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << BITMAP_BITS))


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """The hashed positions of ids as packed bits, 2**BITMAP_BITS of them whatever the number of ids; it only spares work, a join decides."""
    at = _position(column)
    rows = ids.groupBy(F.floor(at / 32768).alias("page")).agg(F.bitmap_construct_agg(at % 32768).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows:
        out[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def near_sketches(pairs: DataFrame, sets: DataFrame, a: str, b: str, percent: int, times: int = 1) -> DataFrame:
    """The pairs (columns a and b) whose sketches differ by no more than `times` what those of linked sets may: sets (set_id, n, sketch, fine)."""

    @F.pandas_udf("boolean")
    def may_link(sa, na, sb, nb, fa, fb):
        if not len(na):
            return na.astype(bool)
        x = np.frombuffer(b"".join(sa), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        y = np.frombuffer(b"".join(sb), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        most = ((na + nb) * (100 - percent) * times).to_numpy()
        out = np.abs(x - y).sum(axis=1, dtype=np.int64) * (100 + percent) <= most
        for k in np.flatnonzero(out).tolist():
            if fa[k] and fb[k]:
                out[k] = sketch_distance(fa[k], fb[k]) * (100 + percent) <= most[k]
        return pd.Series(out)

    x = sets.select(F.col("set_id").alias(a), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("fine").alias("fa"))
    y = sets.select(F.col("set_id").alias(b), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("fine").alias("fb"))
    return pairs.join(x, a).join(y, b).where(may_link("sa", "na", "sb", "nb", "fa", "fb")).select(*pairs.columns)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that the sketches don't rule out and that no family holds: sets (set_id, n, sketch, fine, leader)."""
    a, b = (sets.select(F.col("set_id").alias(c), F.col("leader").alias(f"l{c}")) for c in "ab")
    apart = pairs.join(a, "a").join(b, "b").where("la IS NULL OR lb IS NULL OR la <> lb").select("a", "b")
    return near_sketches(apart, sets, "a", "b", percent)


def whole_sets(docs: DataFrame, table: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, elements) of the wanted sets, built again from one document of each."""
    first = table.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    wanted = staged(wanted.join(first, "set_id").select("doc_id", F.col("set_id").alias("want")), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(bits.value, bitorder="little")
        for batch in batches:
            for part in passes(batch.filter(pa.array(held[batch.column(2).to_numpy()].astype(bool))), "text"):
                code, at = shingles(part.column(1), words)
                own = [np.unique(code[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_hash(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["doc_id", "set_id", "elements"])

    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", _position("doc_id").alias("at"))
    return ids.mapInArrow(lean(run), "doc_id long, set_id long, elements binary").join(wanted, "doc_id").where("want = set_id").dropDuplicates(["doc_id", "set_id"]).select("set_id", "elements")


def overlapping(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets overlap enough."""

    @F.pandas_udf("boolean")
    def links(x, y):
        def one(p, q):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            return 100 * both >= percent * (len(p) + len(q) - both)

        return x.combine(y, one)

    joined = pairs.join(elements.select(F.col("set_id").alias("a"), F.col("elements").alias("ea")), "a").join(elements.select(F.col("set_id").alias("b"), F.col("elements").alias("eb")), "b")
    return joined.where(links("ea", "eb")).select("a", "b")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), set_id and n_links (links of its set to different sets).

    Sets are of distinct `words`-word shingles of the whole text, A-Z lower-cased, words
    parted by ASCII white space; fewer words are one shingle. A null, empty or blank text
    has no set, links with nothing and is its own component. Equal texts share a set.
    Rows that repeat a doc_id with other texts are rows of their own; a row without doc_id
    gets the component of its set, null if no other document is in it. An empty table
    gives no rows; further columns play no part.
    """
    scratch = Scratch(docs.sparkSession)
    table, links, degree = jaccard_links(docs, words, percent, scratch)
    found = components(links, scratch=scratch).withColumnRenamed("id", "set_id")
    classes = table.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    classes = classes.join(found, "set_id", "left").join(degree, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "component").select("set_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = table.join(staged(classes, "members"), "set_id", "left")
    scratch.drop("links", "degrees", "labels", "joined", "stars")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), z AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS sid FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT sid, min(doc_id) AS rep, any_value(n) AS n FROM z GROUP BY sid),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id WHERE x.doc_id IN (SELECT rep FROM c) AND y.doc_id IN (SELECT rep FROM c) GROUP BY 1, 2)
  JOIN c p ON p.rep = a JOIN c q ON q.rep = b WHERE 100 * k >= 90 * (p.n + q.n - k)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id, coalesce(d.n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN c USING (sid) LEFT JOIN k USING (rep) LEFT JOIN d USING (rep)
"""
