"""Stages of the pipeline and samples where column names clash, ids repeat, and signs are no letters."""

import pytest

from tracelake.llm import langid, toxicity

OTHERS = ("score", "lang_pred", "spans", "items", "n_words", "_row", "_kept0", "copies", "component_id", "tokens", "a.b")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash"))
    passage = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    texts = {"en": "the house of the old man stands on the hill ", "fr": "la maison du vieil homme se trouve sur la colline "}
    rows = [(i, texts[lang] * 3 + f"number {i} " + (passage if i % 5 == 0 else ""), lang, "s", 10) for i in range(40) for lang in [("en", "fr")[i % 2]]]
    rows = [(*r, *(f"{c}{r[0]}" for c in OTHERS)) for r in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OTHERS)
    return path, spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontaminated", "mixed"])
def test_stages_keep_columns_with_names_that_they_use(spark, folder, name):
    import corpus_pipeline

    path, docs = folder
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, path)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in OTHERS)


def test_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the old house", "en"), (2, "² ½ Ⅳ ①", None), (3, "12 _ !", None), (4, "é", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[2] == got[3] == "und" and got[1] != "und" and got[4] != "und"


def test_one_id_on_many_rows_neither_floods_nor_empties_the_sample(spark):
    rows = [(1, f"bad {i}") for i in range(5000)] + [(i, f"text {i}") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 1)) for i in range(1, 400)], "doc_id long, toxic int")
    found, _ = toxicity.labelled_sample(docs, labels, 50, 60, 1 << 20)
    toxic, clean = (sum(y == k for y, _ in found) for k in (1, 0))
    assert 10 < toxic < 100 and 10 < clean < 120 and sum(t.startswith("bad") for _, t in found) <= 1
