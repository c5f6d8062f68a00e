"""Impute, filter outliers, encode, scale; fit once, then pure Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.values import column_kinds, missing, numeric_of, present
from tablescope.operators.ordering import exact_quantiles
from tablescope.operators.rows import drop_missing
from tablescope.plans.roles import PrepSpec
from tablescope.session import small

# Dictionaries up to this size become expressions; larger ones are joined.
INLINE_CATEGORIES = 64


def _text(df: DataFrame, c: str) -> Column:
    return present(df, c).cast("string")


def numeric_fills(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, float]:
    """Mean, median or zero per column; 0.0 where a column has no value at all."""
    if not cols:
        return {}
    if method == "zero":
        return {c: 0.0 for c in cols}
    if method == "median":
        found = {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}
    else:
        row = df.agg(*[F.avg(numeric_of(df, c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
        found = {c: row[f"a{i}"] for i, c in enumerate(cols)}
    return {c: 0.0 if v is None else float(v) for c, v in found.items()}


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n) of the non-missing values of all columns, one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _text(df, c).alias("value")) for c in cols])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent text, ties to the smallest; "unknown" for an empty column.

    Counts per value first, so no task ever holds all values of a column.
    """
    if not cols:
        return {}
    top = category_counts(df, cols).groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    found = {r["feature"]: r["value"] for r in top.collect()}
    return {c: found.get(c, "unknown") for c in cols}


def fill_values(df: DataFrame, cols: Sequence[str], method: str = "mean") -> dict[str, float | str]:
    numeric, categorical = column_kinds(df, list(cols))
    return {**numeric_fills(df, numeric, method), **modes(df, categorical)}


def _filled(df: DataFrame, c: str, value: float | str) -> Column:
    if isinstance(value, str):
        return F.coalesce(_text(df, c), F.lit(value))
    return F.coalesce(numeric_of(df, c), F.lit(float(value)))


def impute(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    return df.withColumns({c: _filled(df, c, v) for c, v in fills.items()})


def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """q1 - 1.5 iqr and q3 + 1.5 iqr of each column that has data."""
    out = {}
    for c, (q1, q3) in exact_quantiles(df, list(cols), [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def iqr_filter(df: DataFrame, cols: Sequence[str], mode: str = "prepare") -> DataFrame:
    """Keep rows inside the bounds of every column.

    ``prepare``: every column counts, also a constant one. ``workflow``: columns without
    spread are skipped and a missing value in a checked column drops the row.
    """
    keep = F.lit(True)
    for c, (low, high) in iqr_bounds(df, cols).items():
        if mode == "workflow" and low == high:
            continue
        keep = keep & F.coalesce(numeric_of(df, c).between(low, high), F.lit(False))
    return df.filter(keep)


@dataclass
class Dictionary:
    """Sorted categories of one column: ``values`` if few, a table (value, n, code) with row counts otherwise."""

    size: int
    values: list[str] | None = None
    table: DataFrame | None = None

    def ordered(self) -> list[str]:
        """All categories by code; for names of matrix columns, which are as many."""
        if self.values is not None:
            return self.values
        return [r["value"] for r in self.table.orderBy("code").select("value").collect()]


def dictionaries(df: DataFrame, cols: Sequence[str]) -> dict[str, Dictionary]:
    if not cols:
        return {}
    counts = category_counts(df, cols)
    sizes = {r["feature"]: r["k"] for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).collect()}
    few = [c for c in cols if sizes.get(c, 0) <= INLINE_CATEGORIES]
    listed: dict[str, list[str]] = {c: [] for c in few}
    if few:
        for r in counts.filter(F.col("feature").isin(*few)).orderBy("feature", "value").collect():
            listed[r["feature"]].append(r["value"])
    out = {c: Dictionary(len(listed[c]), values=listed[c]) for c in few}
    for c in cols:
        if c not in out:
            values = counts.filter(F.col("feature") == c).select("value", "n")
            out[c] = Dictionary(sizes[c], table=_coded(values))
    return out


def _coded(values: DataFrame) -> DataFrame:
    from tablescope.operators.ordering import number_rows

    return number_rows(values, ["value"], "code").withColumn("code", (F.col("code") - 1).cast("double"))


def _code(value: Column, values: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(v) for v in values]), value) if values else F.lit(0)
    return F.when(at > 0, (at - 1).cast("double")).otherwise(F.lit(-1.0))


def label_encode(df: DataFrame, cols: Sequence[str], fitted: dict[str, Dictionary] | None = None) -> DataFrame:
    """Replace text by its place among the sorted categories; -1 for an unseen one."""
    fitted = fitted or dictionaries(df, cols)
    inline = {c: _code(_text(df, c), fitted[c].values) for c in cols if fitted[c].values is not None}
    out = df.withColumns(inline) if inline else df
    for c in cols:
        if fitted[c].table is not None:
            table = fitted[c].table.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            out = out.join(small(table), F.col(f"`{c}`").cast("string") == F.col("_value"), "left")
            out = out.withColumn(c, F.coalesce("_code", F.lit(-1.0))).drop("_value", "_code")
    return out


def onehot(df: DataFrame, cols: Sequence[str], fitted: dict[str, Dictionary] | None = None) -> DataFrame:
    """One 0/1 column ``<col>_<value>`` per category, whatever their number.

    The result is as wide as the categories asked for; ``onehot_rows`` keeps the table
    narrow.
    """
    fitted = fitted or dictionaries(df, cols)
    flags = {}
    for c in cols:
        for v in fitted[c].ordered():
            flags[f"{c}_{v}"] = F.coalesce(_text(df, c) == v, F.lit(False)).cast("double")
    return df.withColumns(flags).drop(*cols)


def onehot_rows(df: DataFrame, key: Sequence[str], col: str, fitted: dict[str, Dictionary] | None = None) -> DataFrame:
    """(key.., position, value): the one 1 of each row's one-hot block; value 0 and position -1 if unseen."""
    coded = label_encode(df.select(*key, col), [col], fitted)
    return coded.select(*key, F.col(f"`{col}`").cast("bigint").alias("position"), (F.col(f"`{col}`") >= 0).cast("double").alias("value"))


def scale_stats(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """(offset, width) per column; width 0 means constant."""
    if not cols or method == "none":
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = numeric_of(df, c)
        if method == "minmax":
            aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
        else:
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0) for i, c in enumerate(cols)}


def scaled(x: Column, stats: tuple[float, float]) -> Column:
    offset, width = stats
    if width == 0:
        return F.when(x.isNotNull(), x - F.lit(float(offset)))
    return (x - F.lit(float(offset))) / F.lit(float(width))


def scale(df: DataFrame, cols: Sequence[str], method: str = "minmax") -> DataFrame:
    stats = scale_stats(df, cols, method)
    return df.withColumns({c: scaled(numeric_of(df, c), s) for c, s in stats.items()}) if stats else df


@dataclass
class Preprocessor:
    """Fitted fills, dictionaries and scales.

    ``preset`` "prepare" scales encoded columns too, "workflow" only numeric ones. A one-hot
    column is divided by its spread whatever the number of categories. A small block is also
    centred; a large one stays sparse, and its zeros are zeros: that is a shift of the whole column,
    which intercepts, trees, distances between rows and centred projections do not see. (Scaled
    to [0, 1], a one-hot column stays as it is in both.)
    """

    spec: PrepSpec
    preset: str
    numeric: list[str]
    categorical: list[str]
    fills: dict[str, float | str]
    codes: dict[str, Dictionary]
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: Divisors by code of the large one-hot blocks that are scaled.
    spreads: dict[str, list[float]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def _wide_onehot(self) -> list[str]:
        if self.spec.categorical_encoding != "onehot":
            return []
        return [c for c in self.categorical if self.codes[c].values is None]

    def columns(self) -> list[str]:
        """Matrix column names, numeric first; a large one-hot block counts as one entry."""
        out = list(self.numeric)
        for c in self.categorical:
            if self.spec.categorical_encoding == "onehot" and self.codes[c].values is not None:
                out += [f"{c}_{v}" for v in self.codes[c].values]
            else:
                out.append(c)
        return out

    def positions(self) -> list[str]:
        """Name of every position of the feature vector, large one-hot blocks included."""
        out = list(self.numeric)
        for c in self.categorical:
            out += [f"{c}_{v}" for v in self.codes[c].ordered()] if self.spec.categorical_encoding == "onehot" else [c]
        return out

    def _encode(self, df: DataFrame) -> DataFrame:
        filled = impute(df, self.fills)
        if not self.categorical:
            return filled
        wide = self._wide_onehot()
        if self.spec.categorical_encoding == "label":
            return label_encode(filled, self.categorical, self.codes)
        narrow = [c for c in self.categorical if c not in wide]
        out = onehot(filled, narrow, self.codes) if narrow else filled
        return label_encode(out, wide, self.codes) if wide else out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its feature columns replaced by the model matrix columns."""
        out = self._encode(df)
        stats = {c: s for c, s in self.scales.items() if c in out.columns}
        return out.withColumns({c: scaled(F.col(f"`{c}`").cast("double"), s) for c, s in stats.items()}) if stats else out

    def vector(self, df: DataFrame, out: str = "features", keep: Sequence[str] | None = None) -> DataFrame:
        """``df`` plus the feature vector; ``keep`` names columns of ``df`` to carry along."""
        keep = list(df.columns if keep is None else keep)
        copies = {f"_src_{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
        matrix = self.transform(df.withColumns(copies) if copies else df)
        names = self.columns()
        wide = self._wide_onehot()
        if not wide:
            dense = array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in names]))
            built = matrix.withColumn(out, dense)
        else:
            for i, c in enumerate(wide):
                size = self.codes[c].size
                code = F.when(F.col(f"`{c}`") < 0, F.lit(float(size))).otherwise(F.col(f"`{c}`"))
                matrix = matrix.withColumn(f"_oh_in{i}", code)
            ins, outs = [f"_oh_in{i}" for i in range(len(wide))], [f"_oh_out{i}" for i in range(len(wide))]
            sizes = self.codes[wide[0]].table.sparkSession.range(1).select(
                *[F.lit(float(self.codes[c].size - 1)).alias(f"_oh_in{i}") for i, c in enumerate(wide)]
            )
            encoder = OneHotEncoder(inputCols=ins, outputCols=outs, dropLast=True, handleInvalid="keep").fit(sizes)
            matrix = encoder.transform(matrix)
            for i, c in enumerate(wide):
                if c in self.spreads:
                    factors = Vectors.dense([1.0 / w if w else 1.0 for w in self.spreads[c]])
                    matrix = ElementwiseProduct(scalingVec=factors, inputCol=outs[i], outputCol=f"_oh_scaled{i}").transform(matrix)
                    outs[i] = f"_oh_scaled{i}"
            inputs = [outs[wide.index(c)] if c in wide else c for c in names]
            built = VectorAssembler(inputCols=inputs, outputCol=out).transform(matrix)
        return built.select(*[F.col(f"_src_{i}").alias(c) for i, c in enumerate(keep)], out)


def fit_preprocessor(train: DataFrame, features: Sequence[str], spec: PrepSpec, preset: str = "workflow") -> Preprocessor:
    """Statistics from ``train`` only; three small actions whatever the number of columns."""
    numeric, categorical = column_kinds(train, list(features))
    method = spec.handle_missing if spec.handle_missing in ("median", "zero") else "mean"
    fills = {**numeric_fills(train, numeric, method), **modes(train, categorical)}
    codes = dictionaries(impute(train, {c: fills[c] for c in categorical}), categorical) if categorical else {}
    fitted = Preprocessor(spec, preset, numeric, categorical, fills, codes)
    if preset == "prepare" and categorical:
        encoded = fitted._encode(train)
        to_scale = [c for c in fitted.columns() if c not in fitted._wide_onehot()]
    else:
        encoded = impute(train, {c: fills[c] for c in numeric})
        to_scale = numeric
    fitted.scales = scale_stats(encoded, to_scale, spec.normalization)
    if preset == "prepare" and spec.normalization == "standard":
        for c in fitted._wide_onehot():
            fitted.spreads[c] = _spreads(codes[c])
    return fitted


def _spreads(codes: Dictionary) -> list[float]:
    """Standard deviation of each category's 0/1 column, by code; as many as the matrix has columns."""
    total = codes.table.agg(F.sum("n")).first()[0]
    share = F.col("n") / F.lit(float(total))
    return [r["s"] for r in codes.table.orderBy("code").select(F.sqrt(share * (1 - share)).alias("s")).collect()]


def prepare_rows(df: DataFrame, features: Sequence[str], spec: PrepSpec) -> DataFrame:
    """Row filters of the Prepare flow: missing features, then IQR on imputed values."""
    out = drop_missing(df, features) if spec.handle_missing == "drop" else df
    if not spec.outlier_removal:
        return out
    numeric, _ = column_kinds(out, list(features))
    method = spec.handle_missing if spec.handle_missing in ("median", "zero") else "mean"
    filled = out.withColumns({f"_imp_{i}": _filled(out, c, v) for i, (c, v) in enumerate(numeric_fills(out, numeric, method).items())})
    return iqr_filter(filled, [f"_imp_{i}" for i in range(len(numeric))], "prepare").select(*df.columns)


def workflow_rows(df: DataFrame, features: Sequence[str], label: str | None, spec: PrepSpec) -> DataFrame:
    """Row filters of the workflows: missing label, missing features, IQR on raw values."""
    out = df.filter(~missing(df, label)) if label in df.columns else df
    if spec.handle_missing == "drop":
        out = drop_missing(out, list(features))
    if spec.outlier_removal:
        numeric, _ = column_kinds(out, list(features))
        out = iqr_filter(out, numeric, "workflow")
    return out
