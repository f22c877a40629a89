"""Tables of whole texts that stages leave on disk are packed well."""

import os

import pyarrow.parquet as pq

import corpus_pipeline


def test_numbered_rows_are_held_in_less_than_the_input(spark):
    texts = [" ".join(f"w{(k * i * 7919) % 3001}" for k in range(400)) for i in range(1, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = corpus_pipeline.numbered(docs, "near-rows")
    assert sorted((r.doc_id, r.text) for r in held.select("doc_id", "text").collect()) == list(enumerate(texts))
    files = [f.removeprefix("file://") for f in held.inputFiles()]
    found = [pq.ParquetFile(f).metadata for f in files if os.path.getsize(f)]
    assert {m.row_group(g).column(c).compression for m in found for g in range(m.num_row_groups) for c in range(m.num_columns)} == {"ZSTD"}
