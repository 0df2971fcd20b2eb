import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftlens.llm import bpe, mixing
from driftlens.llm.common import written
from tests.llm import cases


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.createDataFrame(cases.documents(), cases.SCHEMA).selectExpr("*", "1 AS kept", "'x' AS words", "2.5D AS lang_pred", "7 AS component")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], ""), name))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_are_kept(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
        assert not df.filter("kept <> 1 OR words <> 'x' OR lang_pred <> 2.5 OR component <> 7").count()


def test_language_drops_only_texts_without_letters(steps):
    want = [(d, t) for d, t in texts(steps[0]) if t and any(c.isalpha() for c in t)]
    assert cases.plain(texts(steps[1])) == cases.plain(want)


def test_texts_with_letters_stay_when_no_language_is_labelled(spark, steps):
    bare = steps[0].withColumn("lang", F.lit(None).cast("string"))
    want = [(d, t) for d, t in texts(bare) if t and any(c.isalpha() for c in t)]
    got = corpus_pipeline.language(spark, bare, "")
    assert got.columns == bare.columns and want and cases.plain(texts(got)) == cases.plain(want)


def test_one_document_of_each_group(steps):
    rows = texts(steps[1])
    _, owner = cases.groups(rows)
    first = {}
    for row, o in zip(rows, owner):
        first[o] = min(first.get(o, row), row, key=lambda r: (cases.key_of(r[0])))
    assert cases.plain(d for d in [(r[0],) for r in texts(steps[2])]) == cases.plain((r[0],) for r in first.values())


def test_passages_are_cut_and_others_left_alone(steps):
    rows = texts(steps[2])
    want = [(d, kept if n else t) for (d, t), (_, _, n, kept) in zip(rows, cases.cut_words(rows))]
    assert cases.plain(texts(steps[3])) == cases.plain(want)


def test_mix_repeats_documents(steps):
    plan = mixing.mix(steps[3]).collect()
    want = [(r["doc_id"],) for r in plan for _ in range(r["copies"])]
    assert cases.plain((d,) for d, _ in texts(steps[4])) == cases.plain(want)


def test_tokens(steps):
    words = bpe.vocabulary(bpe.tokenizer_path())
    want = [(d, len(words.encode(t or "")), cases.sha(t or "")) for d, t in texts(steps[4])]
    assert cases.plain((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in steps[5].collect()) == cases.plain(want)


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
