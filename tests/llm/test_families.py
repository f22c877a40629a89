"""Near copies whose own words fill most of their prefixes: no row for every pair of them."""

import random

import pytest

from tracelake.llm import jaccard
from tracelake.llm.common import Scratch


def copies(rng, n, k, most):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for c in range(k):
        copy = list(base)
        for m in range(rng.randrange(most + 1)):
            copy[rng.randrange(n)] = f"own{c}x{m}"
        yield " ".join(copy)


@pytest.mark.parametrize(("size", "percent", "n", "most"), [(3, 90, 150, 5), (5, 80, 300, 9)])
def test_near_copies_with_words_of_their_own_are_one_family(spark, monkeypatch, size, percent, n, most):
    rng = random.Random(31)
    texts = [*copies(rng, n, 240, most), *(" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40))]
    sets = [frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) for w in (t.split() for t in texts)]
    different = set(sets)
    links = {x: sum(y != x and 100 * len(x & y) >= percent * len(x | y) for y in different) for x in different}
    rows, scanned, kept = {}, jaccard.scanned_pairs, Scratch.put

    def put(self, df, name):
        out = kept(self, df, name)
        rows[name] = out.count()
        return out

    def scan(*a):
        found = scanned(*a)
        rows["scan"] = found.count()
        return found

    monkeypatch.setattr(Scratch, "put", put)
    monkeypatch.setattr(jaccard, "scanned_pairs", scan)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_join(docs, size, percent).collect()}
    assert got == {i: links[x] for i, x in enumerate(sets)}
    assert sum(got.values()) > 10 * len(texts)
    assert rows["likely"] < len(texts) and rows["scan"] < 2 * len(texts), rows
