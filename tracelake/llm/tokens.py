"""Token ids of documents in checksummed, range-coded blocks.

The file is a Parquet table of segments, each of whole documents on end: part and segment
(which order the file), doc_ids, doc_sizes (ids of each document, its end id included),
and blocks of at most BLOCK_IDS ids: their number, the CRC-32 of the ids as little-endian
unsigned 16-bit integers, and the coder's bytes. Each block is read without the others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm import rangecoder
from tracelake.llm.common import bounded_batches, lean, passes, shared_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Ids of a segment, about (one longer document is a segment of its own), and ids coded in one go.
SEGMENT_IDS, LANES_IDS = 1 << 16, 1 << 22
#: Distinct pieces of text whose ids a worker remembers.
MAX_PIECES = 1 << 16

SEGMENT = "part int, segment int, n_ids long, doc_ids array<long>, doc_sizes array<long>, block_sizes array<int>, block_crcs array<long>, blocks array<binary>"
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_WS = r"[\t\n\v\f\r \x1c-\x1f\x{85}\p{Z}]"
#: Texts with white space side by side, at either end, or other than spaces and line breaks are encoded on their own.
_ODD = rf"{_WS}{_WS}|^{_WS}|{_WS}$|[\t\v\f\r\x1c-\x1f\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"


class _Pieces(dict):
    """Ids of pieces of text, as bytes of unsigned 16-bit integers; unknown pieces are encoded when asked for.

    Two generations: when the young one is full it becomes the old one, so that pieces in use stay.
    """

    def __init__(self, tokenizer, lead: str):
        self.tokenizer, self.lead, self.old = tokenizer, lead, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids, "<u2").tobytes()
        self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > MAX_PIECES:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """Encodes texts as the whole-text call does.

    A byte-level tokenizer never joins what a single space between two other characters
    parts (the space goes with what follows), nor what a single line break so parts; so
    texts are encoded piece by piece there, and pieces that were met before are not encoded
    again. Texts of tokenizers of another kind are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids over 16 bits are not supported")
        self.tokenizer, split = tokenizer, tokenizer.pre_tokenizer
        #: Whether texts may be parted at single spaces and line breaks.
        self.splits = tokenizer.normalizer is None and type(split).__name__ == "ByteLevel" and not split.add_prefix_space and split.use_regex
        self.special = [t for t in (x.content for x in tokenizer.get_added_tokens_decoder().values()) if t]
        self.first, self.spaced = _Pieces(tokenizer, ""), _Pieces(tokenizer, " ")
        self.line = self.first["\n"]
        #: By id: whether its text begins with a space.
        self.leads = np.zeros(1 << 16, bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            self.leads[i] = token.startswith("\u0120")

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words that follow a space, on end, and how many each has.

        Unknown ones are encoded in few calls: each begins with the only space in it, so ids that begin with one part them.
        """
        young, old = self.spaced, self.spaced.old
        new = [w for w in words if w not in young and w not in old]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False).ids, "<u2")
            cuts = np.flatnonzero(self.leads[ids])
            if len(cuts) == len(some):
                data, cuts = ids.tobytes(), [*(2 * cuts).tolist(), 2 * len(ids)]
                young.update(zip(some, (data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))
        found = [young[w] for w in words]
        return np.frombuffer(b"".join(found), "<u2"), np.array([len(x) for x in found], np.int64) // 2

    def encode_column(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """Each text's ids and the end id. Words are split, numbered and put together again as whole arrays."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False) | (not self.splits)
        self.first.age()
        self.spaced.age()
        out: list = [np.append(np.frombuffer(self.encode(t.as_py()), "<u2"), np.uint16(end_id)) if o else None for t, o in zip(texts, odd, strict=True)] if odd.any() else [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        lines = pc.split_pattern(texts.take(pa.array(plain)), "\n")
        n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(lines.flatten(), " ")
        n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        begins = np.cumsum(n_words) - n_words  # each line's first word
        is_first = np.zeros(len(code), bool)
        is_first[begins] = True
        # units that have ids: distinct words after a space, distinct first words, the line break and the end
        m = len(names)
        led, heads = np.unique(code[~is_first]), np.unique(code[is_first])
        ids, sizes = self._ids_of(names.take(pa.array(led)).to_pylist())
        first = [self.first[w] for w in names.take(pa.array(heads)).to_pylist()]
        ids = np.concatenate((ids, np.frombuffer(b"".join(first) + self.line, "<u2"), np.array([end_id], "<u2")))
        sizes = np.concatenate((sizes, np.array([len(x) // 2 for x in first], np.int64), [len(self.line) // 2, 1])).astype(np.int64)
        place = np.zeros(2 * m, np.int64)
        place[led] = np.arange(len(led))
        place[m + heads] = len(led) + np.arange(len(heads))
        # after each line comes a break, after a text's last line the end
        n = len(code) + len(n_words)
        line_of = np.repeat(np.arange(len(n_words)), n_words)
        units = np.full(n, len(sizes) - 2, np.int64)
        units[np.arange(len(code)) + line_of] = place[code + m * is_first]
        last = np.cumsum(n_lines) - 1
        ends = begins + n_words + np.arange(len(n_words))
        units[ends[last]] = len(sizes) - 1
        size = sizes[units]
        upto = np.cumsum(size)
        all_ids = ids[np.repeat((np.cumsum(sizes) - sizes)[units] - (upto - size), size) + np.arange(upto[-1])]
        stop = upto[ends[last]].tolist()
        for k, i, j in zip(plain.tolist(), [0, *stop[:-1]], stop, strict=True):
            out[k] = all_ids[i:j]
        return out

    def forget(self) -> None:
        """Keeps no more than the young pieces between tasks."""
        self.first.clear()
        self.first.old, self.spaced.old = {}, {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.splits or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        pieces = _BOUNDARY.split(text)
        return self.first[pieces[0]] + b"".join(map(self.spaced.__getitem__, pieces[1:]))


@lru_cache(2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def tokenizer_path(path: str) -> str:
    """A file's own path, or where this machine keeps the public tokenizer of that name."""
    import public_tokenizers

    return path if "/" in path else public_tokenizers.path(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes the ids of docs (doc_id, text) to path in ascending doc_id order, nulls first; each document ends with end_id.

    A null text is empty. Rows that repeat a doc_id are documents of their own, in order
    of their texts. An empty table makes a file without segments.
    """
    bounded_batches(docs.sparkSession)

    def flush(held: list[tuple[list, list, list]], part: int, at: int) -> pa.RecordBatch:
        blocks = [ids[i : i + rangecoder.BLOCK_IDS] for _, _, ids in held for i in range(0, len(ids), rangecoder.BLOCK_IDS)]
        coded = iter(zip(blocks, rangecoder.encode(blocks), strict=True))
        columns: list[list] = [[] for _ in range(8)]
        for k, (docs_, sizes, ids) in enumerate(held):
            own = [next(coded) for _ in range(0, len(ids), rangecoder.BLOCK_IDS)]
            for column, value in zip(columns, (part, at + k, len(ids), docs_, sizes, [len(b) for b, _ in own], [rangecoder.checksum(b) for b, _ in own], [c for _, c in own]), strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()))
        names = ["part", "segment", "n_ids", "doc_ids", "doc_sizes", "block_sizes", "block_crcs", "blocks"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path(tokenizer))
        part, at, held, total = TaskContext.get().partitionId(), 0, [], 0
        ids_of: list = []
        sizes: list = []
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for own in passes(batch, "text"):
                for doc_id, coded in zip(own.column(0).to_pylist(), encoder.encode_column(own.column(1), end_id), strict=True):
                    parts.append(coded)
                    ids_of.append(doc_id)
                    sizes.append(len(coded))
                    size += sizes[-1]
                    if size >= SEGMENT_IDS:
                        held.append((ids_of, sizes, np.concatenate(parts)))
                        total += size
                        ids_of, sizes, parts, size = [], [], [], 0
                        if total >= LANES_IDS:
                            yield flush(held, part, at)
                            at, held, total = at + len(held), [], 0
        if parts:
            held.append((ids_of, sizes, np.concatenate(parts)))
        if held:
            yield flush(held, part, at)
        encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lean(run), SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, pos, offset, doc_id, ids): each document's ids, and how many of its segment come before it.

    A block whose ids don't have their checksum is an error.
    """
    rows = spark.read.schema(SEGMENT).parquet(path)
    return rows.mapInArrow(lean(_decoded), "part int, segment int, pos int, offset long, doc_id long, ids array<int>")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Segments in groups that are decoded in one go, with each segment's ids."""
    for batch in batches:
        n_ids = batch.column(2).to_pylist()
        start, held = 0, 0
        for i, n in enumerate([*n_ids, 0]):
            held += n
            if i == len(n_ids) or (held > LANES_IDS and i > start):
                if i > start:
                    own = batch.slice(start, i - start)
                    sizes, crcs, blocks = (own.column(c).to_pylist() for c in (5, 6, 7))
                    ids = rangecoder.decode([b for x in blocks for b in x], [s for x in sizes for s in x])
                    for x, crc in zip(ids, (c for x in crcs for c in x), strict=True):
                        if rangecoder.checksum(x) != crc:
                            raise ValueError("a block's checksum does not match")
                    at, out = 0, []
                    for x in sizes:
                        out.append(np.concatenate(ids[at : at + len(x)]))
                        at += len(x)
                    yield own, out
                start, held = i, n


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own, ids in _segments(batches):
        for k, x in enumerate(ids):
            sizes = np.array(own.column(4)[k].as_py(), np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(x.astype(np.int32)))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, own.column(0)[k].as_py()), pa.int32()), pa.array(np.full(n, own.column(1)[k].as_py()), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(ends - sizes), own.column(3)[k].values, lists],
                ["part", "segment", "pos", "offset", "doc_id", "ids"],
            )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the file's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, ids in _segments(batches):
            columns: list[list] = [[] for _ in range(6)]
            for k, x in enumerate(ids):
                part, segment, at = own.column(0)[k].as_py(), own.column(1)[k].as_py(), 0
                wide = x.astype("<u4")
                for doc_id, n in zip(own.column(3)[k].as_py(), own.column(4)[k].as_py(), strict=True):
                    for column, value in zip(columns, (part, segment, at, doc_id, n, zlib.crc32(wide[at : at + n].tobytes())), strict=True):
                        column.append(value)
                    at += n
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "segment", "offset", "doc_id", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SEGMENT).parquet(path)
    docs = rows.mapInArrow(lean(run), "part int, segment int, offset long, doc_id long, n_tokens long, ids_crc32 long")
    # starts in two levels: of parts, of which there are as many as the writer had tasks, and of a part's segments
    sizes = rows.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("part_start"))
    starts = sizes.select("part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")).alias("segment_start"))
    starts = starts.join(before, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("s"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("s") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes docs as token ids to the shared folder, and describes what is read back: see write_tokens and token_digests."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(docs.sparkSession, path)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
