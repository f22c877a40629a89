"""Packing: pieces cover each document once, sequences are full, costs are alike."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import packing

SCHEMA = "doc_id long, text string, start string, length string, shard string, ids string"


def whole(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("seed", range(4))
def test_words_encode_like_whole_texts(seed):
    rng = random.Random(seed)
    bits = ["It's", "don't", " ", "  ", "\n", "\r\n", "\t", " ", " ", "é", "é", " ́", "Σ", "ΑΣ", "x9y", "42", "...", "<|endoftext|>", "<|END", "​", "日本", "ǅ", "İ", "", "ÉTÉ", "ß", "ÿŸ", "´", "µ", "ª", "×", "a" * 90]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", " "]
    ids, at = packing.word_encoder(packing.tokenizer_path(packing.TOKENIZER)).encode(pa.array(texts), packing.END_ID)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [whole(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_every_id_lies_in_one_piece_and_sequences_are_full(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, rng.randrange(1, 64), rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 200))]
    room = packing.capacities(sum(sizes), 64)
    pieces = packing.balanced(sizes, room)
    of, used = defaultdict(list), [0] * len(room)
    for d, start, n, s in pieces:
        of[d].append((start, n))
        used[s] += n
    assert used == room and all(r == 64 or r & (r - 1) == 0 for r in room)
    for d, n in enumerate(sizes):
        at = 0
        for start, k in sorted(of[d]):
            assert start == at and k > 0
            at += k
        assert at == n


def plain(sizes, room, width):
    """The same rule, with every sequence looked at in every step."""
    left, load, waiting, out = list(room), [0.0] * len(room), [(n, -d, 0) for d, n in enumerate(sizes) if n], []
    while waiting:
        waiting.sort(key=lambda x: (-x[0], -x[1], x[2]))
        n, d, start = waiting.pop(0)
        fit = [s for s in range(len(room)) if left[s] >= n] or [s for s in range(len(room)) if left[s]]
        s = min(fit, key=lambda s: (load[s], s))
        take = min(n, left[s])
        out.append((-d, start, take, s))
        left[s] -= take
        load[s] += packing.cost(take, width)
        if take < n:
            waiting.append((n - take, d, start + take))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_heaps_choose_as_a_scan_of_all_sequences(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(0, 64) for _ in range(150)]
    room = packing.capacities(sum(sizes), 64)
    assert packing.balanced(sizes, room, 50) == plain(sizes, room, 50)


def test_costs_are_alike():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5, 1, 4000).astype(int) + 1, 900).tolist()
    room = packing.capacities(sum(sizes))
    load = np.zeros(len(room))
    for _, _, n, s in packing.balanced(sizes, room):
        load[s] += packing.cost(n)
    full = load[np.array(room) == packing.SEQUENCE]
    in_order, at = np.zeros(len(room)), 0
    for n in sizes:  # documents on end, cut at each 2048 tokens
        while n:
            take = min(n, packing.SEQUENCE - at % packing.SEQUENCE)
            in_order[at // packing.SEQUENCE] += packing.cost(take)
            at, n = at + take, n - take
    assert full.max() / full.mean() < 1.05 and full.std() < in_order[: len(full)].std() * 0.7


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i % 40 or None, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n "), (502, " \n "), (503, "long " * 40_000), (504, "x" * 20_000)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    got = packing.pack(docs, size=64, shard_tails=30).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == 64 or at & (at - 1) == 0 and at < 64
    short = sum(sum(n for _, n in p) < 64 for p in sequences.values())
    assert short < len(sequences) / 10
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(whole(text))
    for doc_id, all_ids in texts.items():
        assert sum(n for _, n, _, _ in pieces[doc_id]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for start, n, crc, total in sorted(pieces[doc_id]):
                assert start == at and total == len(all_ids[0]) and crc == zlib.crc32(np.array(all_ids[0][at : at + n], "<u4").tobytes())
                at += n
            assert at == len(all_ids[0])


def test_pack_of_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
