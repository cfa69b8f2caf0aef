"""The pipeline: every stage on what the one before kept, and all of it."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from specloom.llm import decontamination, ngram_join, quality
from specloom.session import checkpoint_dir
from tests_llm_util import edited, prose


@pytest.fixture(scope="module")
def corpus(spark, make, tmp_path_factory):
    r = random.Random(12)
    bench = [(j, prose(r, 40)) for j in range(3)]
    clean = [prose(r, r.choice([60, 120])) for _ in range(60)]
    junk = [" ".join(w + r.choice(["$$$", "###"]) for w in prose(r, 80).split()) for _ in range(30)]
    copies = [clean[0], edited(r, clean[1], 0.02), edited(r, clean[2], 0.03)]
    leaks = [prose(r, 40) + " " + bench[1][1] + " " + prose(r, 40), bench[2][1]]
    folder = tmp_path_factory.mktemp("corpus")
    texts = clean + junk + copies + leaks
    make(texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in [*range(0, 60, 2), *range(60, 90, 2)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = cp.classify(spark, docs, folder)
    assert kept.columns == columns
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {i for i, t in enumerate(texts) if quality.predict([t.encode()], model)[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == want and set(range(60)) <= want and not want & set(range(60, 90))
    one = cp.deduplicate(spark, kept, folder)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == want - {90, 91, 92}
    free = cp.decontaminate(spark, one, folder)
    assert free.columns == columns and {r.doc_id for r in free.collect()} == set(range(60))
    mixed = cp.mix(spark, free, folder)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == set(range(60))
    placed = cp.place(spark, mixed, folder)
    assert placed.columns == [*columns, "shard"] and placed.count() == mixed.count()


def test_run(spark, corpus):
    folder, _ = corpus
    rows = cp.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(range(60)) and [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5
    assert ngram_join.THRESHOLD and decontamination.THRESHOLD


def test_odd_rows_and_columns(spark, corpus, tmp_path):
    """NULL ids and texts, repeated rows, and columns named like those that the operators make."""
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    t = texts[0]
    odd = spark.createDataFrame([(None, t, "en", "s", 1), (None, None, None, None, None), (70, None, "en", None, 1), (71, "", "en", "s", 1), (160, texts[5], "en", "s", 1), (160, texts[5], "en", "s", 1)], docs.schema)
    clash = {c: F.lit(i) for i, c in enumerate(("cid", "g", "targets", "shard", "mix_pass", "token", "code", "c", "x", "good_score", "__key0"))}
    docs.unionByName(odd).withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = cp.run(spark, str(tmp_path))
    assert set(out.columns) == {*docs.columns, *clash}
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(range(60)) <= set(ids) and 160 not in ids and None in ids  # a copy goes, a text without an id stays


def test_stage_tables_are_deleted(spark, corpus):
    folder, _ = corpus
    there = lambda: {p.name for p in Path(checkpoint_dir(spark).removeprefix("file:")).glob("table-*")}
    before = there()
    cp.run(spark, folder).count()
    assert len(there() - before) == 1  # the one that the result reads


def test_empty_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
