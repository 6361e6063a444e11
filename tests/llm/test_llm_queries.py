"""The registered queries against SQL, and the pipeline stage by stage."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from check import compare, database
from voxtide.llm import nbest, queries
from voxtide.plans.registry import Query

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, data, db, name):
    state, note = compare(spark, db, data, Query(name, "", queries.QUERIES[name], queries.SQL[name]))
    assert state == "ok", note


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_one_row_per_input_row(spark, data, name):
    table = "conversations" if name.startswith("op5") else "documents"
    assert queries.QUERIES[name](spark, data).count() == spark.read.parquet(f"{data}/{table}.parquet").count()


def test_empty_tables(spark, tmp_path, data):
    """The operators of words, vectors and spans on tables without rows."""
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op11_spelling_variants", "op12_vector_codes", "op13_personal_data"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_decontaminate", "op6_token_count", "op8_quality", "op9_language", "op10_nbest", "op13_personal_data"])
def test_scans_do_not_shuffle(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_n_best_returns_its_pieces(spark, tmp_path):
    """The pieces of the best segmentation are part of the result and give the text again."""
    docs = spark.createDataFrame([(1, "a plain sentence, twice: a plain sentence"), (2, ""), (3, None), (4, "ü 漢字 \U0001f600")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op10_nbest"](spark, str(tmp_path))
    assert all(len(r["ids"]) == r["n_pieces"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["crc32s"][0] for r in rows.collect())
    back = nbest.decode_ids(rows, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "classifier", "near_dedup", "decontamination", "segmentation"]


@pytest.fixture(scope="module")
def stages(spark, data):
    """What each stage makes of what the one before it kept."""
    from voxtide.session import materialize

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], data), name))
    return out


def test_stages(spark, data, stages):
    docs, told, good, single, clean, pieces = stages
    for before, after in zip(stages[:5], stages[1:5], strict=False):
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
    assert {r[0] for r in told.select("doc_id").collect()} == {
        r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")
    }
    assert 0 < good.count() < told.count()  # how well it judges is tested in test_classifiers.py, on more ratings
    from tests.llm.test_decontaminate import brute as judged
    from tests.llm.test_near_dup import brute as grouped

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, _, kept in grouped(rows) if kept)
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in single.collect() if not judged(r["text"], items)[4])
    assert pieces.where(~F.col("round_trip")).count() == 0 and pieces.count() == clean.count()


def test_stages_on_odd_tables(spark, data):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "the text of it", None, "s", 1),
            (3, "the same text again here", "en", "s", 3), (4, "the same text again here", "en", "s", 3), (5, "x " * 100_000, "de", "s", 3)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", v int, score int")
    for own in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, own, data).count() <= own.count()


def test_stages_with_columns_of_their_names(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    for name in ("hits", "language", "grading", "_language", "rank", "kept"):
        docs = docs.withColumn(name, F.lit(7))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.where("hits <> 7 or language <> 7 or grading <> 7 or rank <> 7").count() == 0


def test_kept_columns_that_are_results(spark):
    from voxtide.llm import licenses, nbest, token_count

    docs = spark.createDataFrame([(1, "a", 0.5, 3)], "doc_id bigint, text string, score double, n_tokens int")
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, keep=("doc_id", "score"))
    with pytest.raises(ValueError):
        token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "n_tokens"))
    with pytest.raises(ValueError):
        nbest.encode_n_best(docs.withColumnRenamed("score", "N_pieces"), public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "N_pieces"))


def test_classifier_stage_removes_toxic_documents(spark):
    """The stage itself, on a table with thousands of ratings."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = corpus_pipeline.classifier(spark, docs, folder)
    count = lambda df: df.join(labels.where("toxic = 1"), "doc_id").count()
    assert count(docs) > 100 and count(good) <= 0.3 * count(docs)
