"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelake.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, tree string, size string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(leaves, fan_out):
    """(root, path of each leaf) of a plain tree."""
    at, paths, nodes = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + fan_out] for i in range(0, len(nodes), fan_out)]
        for k, i in enumerate(at):
            run, p = runs[i // fan_out], i % fan_out
            paths[k].append(("".join(run[:p]), "".join(run[p + 1 :])))
        at, nodes = [i // fan_out for i in at], [h(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fan_out):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(r[:5]), digest((r[0], r[1], r[2], None if r[3] is None else r[3] + 1, r[4]))))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: grown([x[2] for x in sorted(trees[t])], fan_out) for t in names}
    root, over = grown([built[t][0] for t in names], fan_out)
    out = []
    for t, above in zip(names, over, strict=True):
        for (known, doc_id, leaf, other), path in zip(sorted(trees[t]), built[t][1], strict=True):
            path = path + above
            d = other
            for left, right in path:
                d = h(left, d, right)
            out.append((doc_id if known else None, leaf, built[t][0], root, h(*(left + right for left, right in path)), d))
    return out


def rows_of(rng, n):
    rows = [(rng.choice([None, *range(n)]), rng.choice(["a", "é", None]), rng.choice(["en", "en", "en", "de", "", "z", "ß", None]), rng.choice([None, 3, 99]), rng.choice([None, "", "text é", "x" * 50])) for _ in range(n)]
    return rows + rows[: n // 3]


@pytest.mark.parametrize(("n", "fan_out", "block"), [(1, 2, 64), (40, 2, 4), (60, 3, 3)])
def test_manifest_against_a_plain_tree(spark, monkeypatch, n, fan_out, block):
    monkeypatch.setattr(manifest, "BLOCK_LEAVES", block)
    rows = rows_of(random.Random(n), n)
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    m = manifest.manifest(docs, {"n_chars": F.col("n_chars") + 1}, fan_out=fan_out)
    got = m.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("p"), manifest.folded(F.col("claimed_leaf"), F.col("path")).alias("f")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, fan_out))


def test_untampered_rows_fold_to_the_root(spark):
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows_of(random.Random(5), 60)], SCHEMA)
    m = manifest.manifest(docs).withColumn("f", manifest.folded(F.col("claimed_leaf"), F.col("path")))
    assert m.where("f <> root OR claimed_leaf <> leaf").count() == 0 and m.count() == 80


def test_empty_table_and_refused_fan_out(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        manifest.manifest(spark.createDataFrame([], SCHEMA), fan_out=1)


def test_query_tampers_by_checksum(spark, tmp_path):
    rows = [(i if i % 9 else None, "s", "en" if i % 3 else None, i if i % 5 else None, f"t{i}") for i in range(70)]
    spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op11_manifest(spark, str(tmp_path)).collect()
    changed = {r[0] for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert len(got) == 70 and {r["doc_id"] for r in got if not r["verified"]} == changed and changed
