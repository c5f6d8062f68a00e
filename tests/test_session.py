"""The folder for intermediate tables on a cluster."""

import os

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablescope import session as S
from tablescope.catalog import all_queries


@pytest.fixture()
def cluster(spark, monkeypatch, tmp_path):
    """The session as on a cluster, ``spark.checkpoint.dir`` a plain path."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *rest: str(tmp_path) if key == "spark.checkpoint.dir" else get(conf, key, *rest))
    return spark


def test_shared_mount_without_scheme_is_taken(cluster, tmp_path):
    rows = S.materialize(cluster.range(100))
    assert rows.count() == 100 and all(str(tmp_path) in f for f in rows.inputFiles())
    before = len(os.listdir(tmp_path))
    S.materialize(cluster.range(3))
    assert len(os.listdir(tmp_path)) == before + 1  # tried once


def test_folder_that_loses_rows_is_refused(cluster, monkeypatch):
    made = cluster.range
    monkeypatch.setattr(type(cluster), "range", lambda s, a, b=None, *rest: made(a, b, *rest).filter("id <> 2"))
    with pytest.raises(ValueError, match="do not come back"):
        S.shared_folder(cluster)


def test_unset_folder_on_a_cluster_is_one_in_the_warehouse(spark, monkeypatch, tmp_path):
    own = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": str(tmp_path)}
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *rest: own[key] if key in own else get(conf, key, *rest))
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    for master in ("spark://driver:7077", "local-cluster[3,4,4096]"):
        monkeypatch.setattr(spark.sparkContext, "master", master)
        rows = S.materialize(spark.range(100))
        assert rows.count() == 100 and all(f"{tmp_path}/tablescope-steps/" in f for f in rows.inputFiles())
    assert len(os.listdir(tmp_path / "tablescope-steps")) == 3  # tried once


def test_folder_that_loses_rows_is_refused_on_a_local_cluster(cluster, monkeypatch):
    monkeypatch.setattr(cluster.sparkContext, "master", "local-cluster[3,4,4096]")
    made = cluster.range
    monkeypatch.setattr(type(cluster), "range", lambda s, a, b=None, *rest: made(a, b, *rest).filter("id <> 2"))
    with pytest.raises(ValueError, match="do not come back"):
        S.shared_folder(cluster)


@pytest.mark.parametrize("name", ["boundary_snapshot_grid", "boundary_snapshot_points", "cluster_flow", "dbscan", "dbscan_customers", "dbscan_embeddings"])
def test_queries_take_a_plain_folder_on_a_cluster(name, cluster, sf, tmp_path):
    rows = all_queries()[name][0](cluster, sf)
    assert rows.count() > 0 and os.listdir(tmp_path)


def test_small_tables_start_no_python_workers(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 1.5D, 'x', true, DATE'2020-01-01', 1.25BD), (NULL, NULL, NULL, NULL, NULL, NULL) t(a, b, c, d, e, f)")
    back = S.small(rows)
    assert "PythonRDD" not in back._jdf.queryExecution().toRdd().toDebugString()
    assert back.schema == rows.schema and back.orderBy("a").collect() == rows.orderBy("a").collect()
    assert S.small(rows.limit(0)).collect() == [] and S.small(rows, 1) is rows


def test_small_keeps_vectors_and_structs(spark):
    rows = spark.range(2).select(array_to_vector(F.array(F.lit(1.0))).alias("v"), F.when(F.col("id") > 0, F.struct(F.lit(1), F.array("id"))).alias("s"))
    assert S.small(rows).collect() == rows.collect()
