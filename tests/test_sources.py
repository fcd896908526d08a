import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators.scoring import Head
from tamis.session import scratch_path, shared_folder
from tamis.sources import exports as X
from tamis.sources import heads as H
from tamis.sources import items as I


def head(**kw):
    rng = np.random.default_rng(0)
    return Head(("healthy", "rust", "other"), np.round(rng.normal(size=(3, 5)), 6), np.round(rng.normal(size=3), 6), 1.3, 0.4, version="v3", **kw)


def test_head_round_trip(spark):
    path = scratch_path(spark, "head")
    h = head(cutoff=0.49, local_cutoff=0.5, routed=(2,), prior_strength=0.3, high_band=0.8)
    H.write_head(spark, h, path)
    got = H.read_head(spark, path)
    np.testing.assert_allclose(got.weights, h.weights)
    assert got.with_settings(weights=None, bias=None) == h.with_settings(weights=None, bias=None)


def test_absent_fields_switch_features_off(spark):
    path = scratch_path(spark, "head")
    H.write_head(spark, head(), path)
    got = H.read_head(spark, path)
    assert got.cutoff is None and got.local_cutoff is None and got.routed == () and got.high_band is None


def test_wrong_shape_is_refused(spark):
    path = scratch_path(spark, "head")
    H.write_head(spark, head().with_settings(bias=np.zeros(2)), path)
    with pytest.raises(ValueError):
        H.read_head(spark, path)


def test_items_must_match(spark):
    a, b = scratch_path(spark, "i"), scratch_path(spark, "e")
    I.write_index(spark.createDataFrame([(1, "s", "l", "", "g", "p"), (2, "s", "l", "", "g", "p")], I.INDEX_SCHEMA), a)
    spark.createDataFrame([(1, [0.5])], I.EMBEDDING_SCHEMA).write.parquet(b)
    with pytest.raises(ValueError):
        I.read_items(spark, a, b)


def test_annotations_one_document_per_file(spark, tmp_path):
    (tmp_path / "a.jpg.json").write_text('{"objects": [\n {"classTitle": "rust_level_1"}, {"classTitle": "unhealthy"}]}')
    (tmp_path / "b.jpg.json").write_text('{"objects": [{"classTitle": "rust_level_1"}, {"classTitle": "healthy"}]}')
    (tmp_path / "c.jpg.json").write_text('{"objects": [{"classTitle": "unhealthy"}]}')
    got = I.read_annotations(spark, str(tmp_path)).collect()
    assert [(r.file, r.detail, r.label) for r in got] == [("a.jpg", "rust_level_1", "rust")]


def test_csv_file(spark):
    path = scratch_path(spark, "csv")
    X.write_csv(spark.createDataFrame([("=x", "ĩ,ũ"), (None, "b")], "a string, b string"), path, single_file=True)
    raw = spark.read.format("binaryFile").load(path + "/part-*").first().content.decode("utf-8")
    assert raw == "﻿a,b\r\n'=x,\"ĩ,ũ\"\r\n,b\r\n"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_folder(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_update_size_is_checked(spark):
    rows = spark.range(5).select(F.col("id").alias("ref_id"), F.array(F.lit(1).cast("tinyint")).alias("q"), F.lit(1.0).cast("float").alias("scale"))
    labels = rows.select("ref_id", F.lit("rust").alias("label"))
    with pytest.raises(ValueError):
        H.export_update(spark, head(), head(), rows, labels, None, scratch_path(spark, "u"), max_rows=4)
