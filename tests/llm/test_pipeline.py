"""The pipeline's stages on a small folder of tables."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from tests.llm.test_operators import check_packing, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("tables"))
    clean = [prose(rng, rng.randrange(40, 200)) for _ in range(120)]
    item = prose(rng, 40)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(200, clean[0] + " end"), (201, f"{prose(rng, 100)} {item} {prose(rng, 100)}"), (202, None), (203, "")]
    rows += [(300 + i, "!!! SPAM " * rng.randrange(20, 90)) for i in range(40)]
    labels = [(i, 1, 0) for i in range(100)] + [(300 + i, 0, 0) for i in range(40)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = {r.doc_id for r in docs.collect()}
    assert not any(300 <= i < 340 for i in ids["quality"]) and len(ids["quality"] & set(range(120))) >= 118
    assert 200 not in ids["near_duplicates"] and 0 in ids["near_duplicates"]
    assert 201 in ids["near_duplicates"] and 201 not in ids["decontaminate"]
    from brightmill.llm.packing import Limits

    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert set(check_packing(packed, Limits())) == ids["decontaminate"]


def test_run(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, folder).count() > 0
    assert Path(folder).exists()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_odd_rows_and_empty_tables(spark, folder, tmp_path):
    """Nulls, repeated rows and ids, null ids and long texts pass every stage; empty tables give empty results."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(22)
    text = prose(rng, 80)
    rows = [(1, text), (1, text), (1, prose(rng, 60)), (None, prose(rng, 50)), (None, None), (2, None), (3, ""), (4, " \n"), (5, prose(rng, 30_000)), (6, text.upper()), (7, "one")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert {(r.doc_id, r.text) for r in out.collect() if r.doc_id == 5 and stage is not pipeline.lines_stage} <= {(5, rows[8][1])}
        assert stage(spark, empty, folder).count() == 0
    assert sorted({r.doc_id for r in pipeline.near_duplicates_stage(spark, docs, folder).collect() if r.doc_id is not None}) == [1, 2, 3, 4, 5, 7]
    packed = pipeline.pack_stage(spark, docs, folder).collect()
    assert len({(r.doc_id, r.start) for r in packed}) and sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert pipeline.pack_stage(spark, empty, folder).count() == 0
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    # without labels nothing is known of quality, and nothing is rejected
    assert pipeline.quality_stage(spark, docs, str(tmp_path)).count() == len(rows)
