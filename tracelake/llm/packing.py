"""Packing documents into training sequences whose attention costs are alike.

A document's last ids, short of a whole sequence, are a tail; what comes before are full
sequences of their own. Tails are dealt to shards of bounded size, and each shard packs its
tails by falling cost into the cheapest sequence with room; they are cut where none has room
for the whole, so that every sequence is filled to its capacity and nothing is padded.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch, bounded_batches, lean, passes
from tracelake.llm.tokens import tokenizer_path

TOKENIZER, END_ID = "word_bpe_49k.json", 1
SEQUENCE = 2048
#: A sequence's cost is its tokens and, for each piece, its tokens squared over this (of a block of that width, linear layers cost 6 times the width for each token, attention the tokens).
LINEAR_WIDTH = 6 * 1024
#: Tails of a shard, about; each has under SEQUENCE ids.
SHARD_TAILS = 2048
#: Distinct chunks and words whose ids a worker remembers, in each of two generations, and the longest chunk that it does.
MAX_WORDS, MAX_WORD = 1 << 18, 64
#: Bytes of text that one pass encodes: a longer one meets fewer chunks twice.
PASS_BYTES = 4 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


#: Chunks of these characters have one normal form, and are cut here into what the tokenizer takes for words (fixed value) in lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_WORD_END = "</w>"


class WordEncoder:
    """Encodes texts as the whole-text call of a tokenizer that drops white space and never joins what it parts.

    Texts are split at spaces and line breaks; a chunk that was met before is not encoded
    again. New chunks of plain Latin characters are cut into words, and unknown words are encoded many
    in a call: an id that ends a word parts them. The tokenizer itself encodes all other chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model without its normalizer and word rules, for words that are in lower case and cut.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "it's a don't-Know 42 \n(x) ÉtÉ"
        if [i for c in probe.split() for w in _WORDS.findall(c.lower()) for i in self.words.encode(w, add_special_tokens=False).ids] != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError("the tokenizer joins words, keeps white space or has other words")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(_WORD_END)
        #: Ids of chunks and of words, as bytes; of each a young generation and an old one.
        self.chunks: list[dict[str, bytes]] = [{}, {}]
        self.known: list[dict[str, bytes]] = [{}, {}]

    def _age(self, kept: list[dict[str, bytes]]) -> None:
        if len(kept[0]) > MAX_WORDS:
            kept[1], kept[0] = kept[0], {}

    def _of_words(self, words: set[str]) -> None:
        """Makes all of words known in the young generation."""
        young, old = self.known
        new = []
        for w in words:
            if w not in young:
                if (x := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = x
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.array(self.words.encode(" ".join(some), add_special_tokens=False).ids, self.kind)
            cuts = (self.kind.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer ends a word within a word")
            data = ids.tobytes()
            young.update(zip(some, (data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)), strict=True))

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        self._age(self.chunks)
        self._age(self.known)
        young, old = self.chunks
        found = list(map(young.get, chunks))
        new, other = {}, []
        for k, x in enumerate(found):
            if x is None:
                c = chunks[k]
                if (x := old.get(c)) is not None:
                    found[k] = young[c] = x
                elif _PLAIN.fullmatch(c) and "<|" not in c:
                    new[k] = _WORDS.findall(c.lower())
                else:
                    other.append(k)
        self._of_words({w for words in new.values() for w in words})
        known = self.known[0]
        for k, words in new.items():
            found[k] = b"".join([known[w] for w in words])
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            for k, x in zip(some, self.tokenizer.encode_batch_fast([chunks[k] for k in some], add_special_tokens=False), strict=True):
                found[k] = np.array(x.ids, self.kind).tobytes()
        for k in (*new, *other):
            if len(chunks[k]) <= MAX_WORD:
                young[chunks[k]] = found[k]
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each with the end id, and where each begins (one more entry); null is empty."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        chunks = pc.split_pattern(texts, " ")
        n_chunks = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary
        # chunks hold no space: one join and one split make them strings
        names = pc.binary_join(pa.LargeListArray.from_arrays([0, len(names)], names), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(names) else []
        ids = [*self._of_chunks(names), np.array([end_id], self.kind).tobytes()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        # units: each text's chunks, then the end
        last = np.cumsum(n_chunks + 1) - 1
        units = np.empty(len(coded) + len(n_chunks), np.int64)
        is_end = np.zeros(len(units), bool)
        is_end[last] = True
        units[~is_end], units[is_end] = coded.indices.to_numpy(), len(ids) - 1
        size = sizes[units]
        upto = np.cumsum(size)
        flat = np.frombuffer(b"".join(ids), self.kind)
        begins = np.cumsum(sizes) - sizes
        out = flat[np.repeat(begins[units] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        return out, np.concatenate(([0], upto[last]))


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cost(n: float, width: int = LINEAR_WIDTH) -> float:
    """The estimated cost of a piece: linear in its tokens, and quadratic by attention within it."""
    return n + n * n / width


def capacities(total: int, size: int = SEQUENCE) -> list[int]:
    """Sequences that hold exactly total tokens: full ones, and one for each power of two in the rest."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balanced(sizes: list[int], room: list[int], width: int = LINEAR_WIDTH) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of each piece of documents of these sizes, in sequences with so much room in all.

    The costliest document, or rest of one, goes to the cheapest sequence that has room for
    it; where none has, the cheapest sequence with any room takes what it can and the rest waits
    for its turn. Ties go to the lower number. Each step is a few heap operations.
    """
    if sum(sizes) != sum(room):
        raise ValueError("the room must be that of all documents")
    left, load = list(room), [0.0] * len(room)
    # sequences that hold the document at hand, by cost, and the others by room
    ready: list[tuple[float, int]] = []
    tight = [(-r, s) for s, r in enumerate(room)]
    heapq.heapify(tight)
    cheapest = [(0.0, s) for s in range(len(room))]  # all with room; entries of other costs are out of date
    waiting = [(-n, d, 0) for d, n in enumerate(sizes) if n]
    heapq.heapify(waiting)
    out = []
    while waiting:
        n, d, start = heapq.heappop(waiting)
        n = -n
        while tight and -tight[0][0] >= n:
            s = heapq.heappop(tight)[1]
            if left[s] >= n:
                heapq.heappush(ready, (load[s], s))
        # sizes only fall, so a sequence leaves ready when it is given something, and comes back by its room
        while ready and (ready[0][0] != load[ready[0][1]] or left[ready[0][1]] < n):
            heapq.heappop(ready)
        if ready:
            s, take = heapq.heappop(ready)[1], n
        else:
            while cheapest[0][0] != load[cheapest[0][1]] or not left[cheapest[0][1]]:
                heapq.heappop(cheapest)
            s = cheapest[0][1]
            take = left[s]
        out.append((d, start, take, s))
        left[s] -= take
        load[s] += cost(take, width)
        if left[s]:
            heapq.heappush(tight, (-left[s], s))
            heapq.heappush(cheapest, (load[s], s))
        if take < n:
            heapq.heappush(waiting, (take - n, d, start + take))
    return out


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of docs: full ones with their digest and without ids, tails with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path(tokenizer))
        for batch in batches:
            for own in passes(batch, "text", PASS_BYTES):
                ids, at = encoder.encode(own.column(1), end_id)
                wide, kept = ids.astype("<u4"), ids
                columns: list[list] = [[] for _ in range(6)]
                for doc_id, i, j in zip(own.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for k in range(i, j, size):
                        e = min(k + size, j)
                        full = e - k == size
                        row = (doc_id, k - i, e - k, zlib.crc32(wide[k:e].tobytes()) if full else None, j - i, None if full else kept[k:e].tobytes())
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _ENCODED)


def _packed(shard: pa.Table, size: int, width: int) -> pa.Table:
    """Pieces of one shard's tails."""
    number = shard.column("shard")[0].as_py()
    shard = shard.sort_by([("_at", "ascending")])
    doc_ids, starts, totals, sizes, ids = (shard.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "length", "ids"))
    ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4") for x, n in zip(ids, sizes, strict=True)]
    room = capacities(sum(sizes), size)
    used = [0] * len(room)
    columns: list[list] = [[] for _ in range(7)]
    for d, start, n, s in balanced(sizes, room, width):
        row = (doc_ids[d], starts[d] + start, n, zlib.crc32(ids[d][start : start + n].tobytes()), totals[d], (number << 32 | s) * 2, used[s])
        used[s] += n
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    return pa.table([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SEQUENCE, width: int = LINEAR_WIDTH, shard_tails: int = SHARD_TAILS) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids (null: none) and the end id, so each has one piece at least;
    each id lies in one piece. Every sequence is full, or a power of two long: a shard has one
    such for each binary digit of its rest. Sequence ids are not dense: odd ones
    are full pieces of long documents, even ones a shard's (its number times 2**33 and up). Rows that
    repeat a doc_id, or have none, are documents of their own; an empty table gives no rows.
    Encoded documents are a table in the shared folder, so a lost executor costs no encoding
    of others; tails are dealt by their place in it, so that no shard is larger than others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    table = scratch.put(_encoded(docs, tokenizer, end_id, size), "encoded").withColumn("_at", F.monotonically_increasing_id())
    full = table.where("ids IS NULL").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_at") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tails = table.where("ids IS NOT NULL")
    shards = max(1, -(-tails.count() // shard_tails))
    # a partition's rows are numbered on end: a hash deals them evenly, whatever the partition
    tails = tails.select("doc_id", "start", "length", "doc_tokens", "ids", "_at", F.pmod(F.xxhash64("_at"), F.lit(shards)).alias("shard"))
    return full.unionByName(tails.groupBy("shard").applyInArrow(lambda t: _packed(t, size, width), PIECES))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
