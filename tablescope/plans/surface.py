"""Boundary snapshot: projected points, scored grid and statistics in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import present
from tablescope.operators import boundary as B
from tablescope.operators import models as K
from tablescope.operators.prepare import fit_preprocessor, prepare_rows
from tablescope.plans.roles import PrepSpec, Roles
from tablescope.plans.workflows import numbered, project
from tablescope.session import materialize


@dataclass
class Snapshot:
    points: DataFrame
    grid: DataFrame
    statistics: DataFrame
    axes: B.Axes
    class_labels: list[str]
    explained: list[float]


def boundary_snapshot(
    df: DataFrame, roles: Roles, spec: PrepSpec = PrepSpec(), algorithm: str = "random_forest", result: DataFrame | None = None,
    kind: str = "classification", resolution: int = 40, order_by: Sequence[str] = ("_row_id",), **params,
) -> Snapshot:
    """``result`` is a stored Prepare or workflow result with ``_row_id``; clustering needs it."""
    features = [c for c in roles.features if c in df.columns]
    label = roles.label if roles.label in df.columns else None
    classification = bool(label) and K.is_classification(df, label)
    rows = materialize(prepare_rows(numbered(df, order_by), features, spec))
    classes = rows.select(label).distinct().limit(2).count() if classification else 0
    B.check_boundary(features, label, 2, classification, classes, kind)
    pre = fit_preprocessor(rows, features, spec, "prepare")
    width = len(pre.vector(rows).select("features").first()["features"])
    B.check_boundary(features, label, width, classification, classes, kind)
    vectors = pre.vector(rows)
    spark = df.sparkSession
    if kind == "clustering":
        if result is None:
            raise ValueError("a clustering surface needs the clustering result")
        projected, _, _, explained = project(materialize(vectors), 2)
        points = materialize(B.cluster_points(projected, result))
        ax = B.axes(points, "x", "y", resolution)
        grid = B.cluster_grid(points, ax)
        labels = sorted(r[0] for r in points.select("cluster_id").distinct().collect())  # one per cluster
    else:
        target = F.coalesce(present(rows, label), F.lit("unknown"))
        ready = materialize(vectors.withColumn("_target", target))
        model = K.fit_vectors(ready, pre, "_target", algorithm, "classification", **params)
        projected, components, mean, explained = project(model.score_vectors(ready), 2)
        points = materialize(B.boundary_points(projected, "_target", result))
        ax = B.axes(points, "x", "y", resolution)
        grid = B.surface_grid(spark, ax, model, components, mean)
        labels = model.classes
    stats = B.boundary_stats(points, ax, width, len(pre.numeric), explained, kind)
    return Snapshot(points, grid, stats, ax, labels, explained)
