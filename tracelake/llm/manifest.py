"""A Merkle manifest of a dataset: digests of rows, a tree for each value of a column, and a tree over these.

Nodes carry nested-interval labels: the ranks [lo, hi) of the leaves that they cover. Levels
come in buckets of BLOCK_LEVELS; a block is the part of a bucket under one node, found from
any rank inside it by a division. So a row meets its ancestors by one equi-join a bucket,
and a node's siblings are the intervals within its parent's that don't hold the row's rank.
Everything runs in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch
from tracelake.llm.ranks import ranked

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and the most leaves of a block.
FAN_OUT, BLOCK_LEAVES = 2, 64

_PATH = "array<struct<left:string,right:string>>"
_NODES = "array<struct<lo:bigint,hi:bigint,digest:string>>"


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings on end, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its ancestors give."""
    return F.aggregate(path, leaf, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def _levels(fan_out: int) -> int:
    """Levels of a block: as many as keep it within BLOCK_LEAVES, one at least."""
    n = 1
    while fan_out ** (n + 1) <= BLOCK_LEAVES:
        n += 1
    return n


def _div(value: Column, n: int) -> Column:
    """Division of whole numbers, exact at any size."""
    return F.call_function("div", value, F.lit(n))


def _blocks(units: DataFrame, below: int, fan_out: int) -> DataFrame:
    """Blocks over units (tree, size, lo, hi, digest) that cover `below` leaves each: bucket, l0, l1, .. (nodes by level, empty above the tree's root) and top."""
    levels = _levels(fan_out)
    out = units.groupBy("tree", "size", _div(F.col("lo"), below * fan_out**levels).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("l0"))
    top = "l0"
    for j in range(levels):
        more = f"size > {below * fan_out**j}"  # the level is not the tree's root
        kids = f"transform(sequence(0, int((size(l{j}) - 1) div {fan_out})), i -> slice(l{j}, i * {fan_out} + 1, {fan_out}))"
        parent = "named_struct('lo', k[0].lo, 'hi', element_at(k, -1).hi, 'digest', sha2(array_join(transform(k, x -> x.digest), ''), 256))"
        out = out.withColumn(f"l{j + 1}", F.expr(f"CASE WHEN {more} THEN transform({kids}, k -> {parent}) ELSE CAST(array() AS {_NODES}) END"))
        top = f"CASE WHEN {more} THEN l{j + 1} ELSE {top} END"
    return out.withColumn("top", F.expr(f"({top})[0]"))


def _bands(leaves: DataFrame, fan_out: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Blocks of each bucket of levels, from the leaves (tree, size, rank, leaf) up to the roots."""
    levels = _levels(fan_out)
    most = leaves.agg(F.max("size")).first()[0] or 1
    units = leaves.select("tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"))
    bands, below = [], 1
    while not bands or below < most:
        bands.append(scratch.put(_blocks(units, below, fan_out), name))
        below *= fan_out**levels
        units = bands[-1].where(F.col("size") > below).select("tree", "size", "top.lo", "top.hi", "top.digest")
    return bands


def _siblings(rank: str, below: int, fan_out: int) -> Column:
    """For each level of a block's columns: digests left and right of the node that holds rank (an expression), under the same parent."""
    levels = _levels(fan_out)
    parts = []
    for j in range(levels):
        width = below * fan_out ** (j + 1)
        first = f"int(({rank}) div {width} * {fan_out} - ({rank}) div {below * fan_out**levels} * {fan_out ** (levels - j)} + 1)"
        side = lambda keep, j=j, first=first: f"array_join(transform(filter(slice(l{j}, {first}, {fan_out}), x -> {keep}), x -> x.digest), '')"
        # a parent's children, less the interval that holds rank
        parts.append(f"CASE WHEN size > {below * fan_out**j} THEN named_struct('left', {side(f'x.hi <= {rank}')}, 'right', {side(f'x.lo > {rank}')}) END")
    return F.expr(f"filter(array({', '.join(parts)}), x -> x IS NOT NULL)")


def _paths(leaves: DataFrame, bands: list[DataFrame], tops: DataFrame, fan_out: int, scratch: Scratch) -> DataFrame:
    """leaves (tree, size, rank, ..) with path: siblings at each level of their tree, then tops' path; and tops' other columns.

    tops (tree, path, ..) says what lies above each tree. Buckets of levels are joined from the
    top down, each with the one above it, so that a row is joined once.
    """
    levels, extra = _levels(fan_out), [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for g in range(len(bands) - 1, -1, -1):
        below = fan_out ** (levels * g)
        full = below * fan_out**levels
        ends = bands[g].where(F.col("size") <= full).join(tops, "tree")
        if above is not None:
            # a block's top is a unit of the bucket above
            mine = bands[g].where(F.col("size") > full).withColumn("_up", _div(F.col("bucket"), fan_out**levels))
            upper = above.select("tree", F.col("bucket").alias("_up"), "path", *extra, *(F.col(f"l{j}").alias(f"_l{j}") for j in range(levels)))
            met = mine.join(upper, ["tree", "_up"])
            lower = [F.col(f"l{j}").alias(f"_o{j}") for j in range(levels)]
            met = met.select("tree", "size", "bucket", "path", *extra, *lower, *(F.col(f"_l{j}").alias(f"l{j}") for j in range(levels)))
            met = met.withColumn("path", F.concat(_siblings(f"bucket * {full}", full, fan_out), "path"))
            met = met.select("tree", "size", "bucket", "path", *extra, *(F.col(f"_o{j}").alias(f"l{j}") for j in range(levels)))
            ends = ends.select(*met.columns).unionByName(met)
        else:
            ends = ends.select("tree", "size", "bucket", "path", *extra, *(f"l{j}" for j in range(levels)))
        above = scratch.put(ends, "above")
    blocks = above.drop("size")
    out = leaves.withColumn("bucket", _div(F.col("rank"), fan_out**levels)).join(blocks, ["tree", "bucket"])
    return out.withColumn("path", F.concat(_siblings("rank", 1, fan_out), "path")).drop("bucket", *(f"l{j}" for j in range(levels)))


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, tree: str = "lang", order: str = "doc_id", fan_out: int = FAN_OUT) -> DataFrame:
    """One row per row of docs: order's column, leaf, claimed_leaf, path, subroot and root.

    leaf is the digest of the row's columns; claimed_leaf that of the row with the values of
    claimed in their place. Rows with one value of tree's column (null is one of its own, and
    first) are a tree, in order of order's column, nulls first, then of their leaves; equal rows
    are leaves of their own, in any order. path lists, from the leaf's level to the root's, the
    digests left and right of the row's ancestors under their parents; a lone node has none on
    either side but is hashed again. Columns not named here are left alone; an empty table
    gives no rows. No group is gathered: blocks have BLOCK_LEAVES units at most.
    """
    if fan_out < 2:
        raise ValueError("a node has two children at least")
    scratch = Scratch(docs.sparkSession)
    # null sorts before all other values, whatever they are
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaf, other = row_digest([F.col(c) for c in columns]), row_digest([(claimed or {}).get(c, F.col(c)) for c in columns])
    rows = docs.select(key.alias("tree"), F.col(order).alias("_order"), leaf.alias("leaf"), F.when(leaf != other, other).alias("_other"))
    leaves = ranked(scratch.put(rows, "digests"), "tree", ["_order", "leaf"], scratch, "leaves")
    leaves = scratch.put(leaves, "ranked")
    scratch.drop("digests", "leaves")
    bands = _bands(leaves, fan_out, scratch, "bands")
    # the roots of the trees are the leaves of one more
    levels = _levels(fan_out)
    roots = [b.where((F.col("size") <= fan_out ** (levels * (g + 1))) & (F.col("size") > (fan_out ** (levels * g) if g else 0))) for g, b in enumerate(bands)]
    found = roots[0].select("tree", "top.digest")
    for r in roots[1:]:
        found = found.unionByName(r.select("tree", "top.digest"))
    found = scratch.put(found.select(F.lit("").alias("tree"), F.col("tree").alias("under"), F.col("digest").alias("leaf")), "subroots")
    subroots = scratch.put(ranked(found, "tree", ["under"], scratch, "subroots"), "subroots")
    over = _bands(subroots, fan_out, scratch, "over")
    root = over[-1].select("top.digest").first()
    none = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"), F.lit(root[0] if root else None).cast("string").alias("root"))
    tops = _paths(subroots, over, none, fan_out, scratch).select(F.col("under").alias("tree"), "path", F.col("leaf").alias("subroot"), "root")
    out = _paths(leaves, bands, scratch.put(tops, "tops"), fan_out, scratch)
    return out.select(F.col("_order").alias(order), "leaf", F.coalesce("_other", "leaf").alias("claimed_leaf"), "path", "subroot", "root")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves and proofs of all documents; where 7 divides the CRC-32 of doc_id, the claimed row has one more in n_chars, and verification fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(changed, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    m = manifest(docs, {"n_chars": n_chars})
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("claimed_leaf"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c
  FROM documents
), e AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(c, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS other FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS id FROM e
), low AS (
  SELECT tree, 0 AS l, list(leaf ORDER BY i) AS ds FROM leaves GROUP BY tree
  UNION ALL SELECT tree, l + 1, list_transform(range((len(ds) + 1) // 2), lambda j: sha256(ds[2 * j + 1] || coalesce(ds[2 * j + 2], ''))) FROM low WHERE len(ds) > 1
), subs AS (SELECT tree, ds[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM low WHERE len(ds) = 1
), high AS (
  SELECT 0 AS l, list(subroot ORDER BY i) AS ds FROM subs
  UNION ALL SELECT l + 1, list_transform(range((len(ds) + 1) // 2), lambda j: sha256(ds[2 * j + 1] || coalesce(ds[2 * j + 2], ''))) FROM high WHERE len(ds) > 1
), steps AS (
  SELECT id, 0 AS part, l, i >> l AS k, ds FROM leaves JOIN low USING (tree) WHERE len(ds) > 1
  UNION ALL SELECT id, 1, l, subs.i >> l, ds FROM leaves JOIN subs USING (tree) CROSS JOIN high WHERE len(ds) > 1
), paths AS (
  SELECT id, list(CASE WHEN k % 2 = 1 THEN 'L' || ds[k] ELSE 'R' || coalesce(ds[k + 2], '') END ORDER BY part, l) AS p FROM steps GROUP BY id
), f AS (
  SELECT doc_id, leaf, subroot, (SELECT ds[1] FROM high WHERE len(ds) = 1) AS root, sha256(coalesce(list_aggregate(list_transform(p, lambda x: substr(x, 2)), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(other, leaf), coalesce(p, [])), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN substr(x, 2) || a ELSE a || substr(x, 2) END)) AS folded_root
  FROM leaves JOIN subs USING (tree) LEFT JOIN paths USING (id)
)
SELECT *, folded_root = root AS verified FROM f
"""
