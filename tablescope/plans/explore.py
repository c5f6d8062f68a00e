"""Explore: profile, target check, model sweep and a rule-based verdict.

The rules are Columns over one row of facts per target, so many targets or segments
are judged in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.profile import data_profile
from tablescope.operators.target import class_feasibility, missing_target, regression_feasibility, target_kind
from tablescope.plans.roles import PrepSpec, Roles, normalize_roles
from tablescope.plans.workflows import split_and_fit_preprocessor, supervised_on
from tablescope.session import materialize

# Sweep order, limits, names and texts of the verdict.
SWEEP = {
    "classification": ("logistic_regression", "random_forest", "gradient_boosting", "svm"),
    "regression": ("linear_regression", "random_forest", "gradient_boosting", "svm"),
}
OVERFIT_GAP = {"classification": 0.15, "regression": 0.25}
MIN_ROWS = 20
TARGET_FAILURES = ("label_column_missing", "single_class_target", "non_numeric_target", "near_constant_target")
FEATURE_RISKS = ("likely_identifier", "high_missing_rate", "low_variance")
ACTIONS = {
    "change_target": ("Current target configuration is not suitable for model learning.", "high"),
    "collect_more_rows": ("Sample size is too small for stable evaluation.", "high"),
    "try_balanced_class_weight": ("Class imbalance is likely reducing minority-class performance.", "high"),
    "exclude_risky_columns": ("Some selected features look unstable or non-informative.", "medium"),
    "try_regularized_model": ("Train/test gap indicates overfitting risk.", "medium"),
    "inspect_features": ("Current feature set does not beat baseline reliably.", "high"),
    "inspect_clusters": ("Segment-level behavior can reveal where the model is strongest.", "low"),
    "inspect_outliers": ("Outliers may be hiding useful signal.", "low"),
}
DECISIONS = {
    "usable_signal": ("Signal looks usable. Proceed to workflow validation.", "run_workflow", None),
    "needs_better_target": ("Current target configuration is not suitable for reliable learning.", "change_target", "target_configuration"),
    "not_enough_data": ("Data volume is too small for stable model evaluation.", "collect_more_data", "row_count"),
    "overfit_risk": ("Potential overfitting detected. Improve data quality before workflow.", "inspect_data_quality", "train_test_gap"),
    "no_model_beats_baseline": ("Current feature set does not outperform baseline reliably.", "use_baseline", "baseline_gap"),
    "other": ("Feature signal needs improvement before workflow execution.", "adjust_features", "feature_quality"),
}

REASONS = {
    "no_target": "Label column is missing or target kind is not inferable.",
    "all_failed": "All candidate models failed to train or evaluate for this target.",
    "gain": "Best model improves baseline by %.4f.",
    "no_gain": "Baseline improvement could not be computed.",
    "rmse_gain": "Best model reduces baseline RMSE by %.1f%%.",
    "no_rmse_gain": "Baseline RMSE improvement could not be computed.",
    "gap": "Train/test gap is large (%.4f).",
    "imbalance": "Class imbalance may limit stability on minority classes.",
}

ITEM = "struct<algorithm:string,status:string,primary_metric:double,train_metric:double,gap:double,test_r2:double,failure_reason:string>"
FACTS = (
    "target_column string, target_kind string, baseline double, target_warnings array<string>, row_count bigint, "
    f"risky array<struct<name:string,flags:array<string>>>, items array<{ITEM}>"
)


def sweep_gap(train: Column, test: Column, kind: Column) -> tuple[Column, Column]:
    """(gap, overfit_risk) of one model."""
    gap = F.abs(train - test)
    limit = F.when(kind == "classification", F.lit(OVERFIT_GAP["classification"])).otherwise(F.lit(OVERFIT_GAP["regression"]))
    return gap, F.coalesce(gap >= limit, F.lit(False))


def _has(flags: Column, *names: str) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))


def _best(good: Column, kind: Column) -> Column:
    """First model with the best primary metric."""
    keyed = F.transform(good, lambda m, i: F.struct(F.when(kind == "classification", -m["primary_metric"]).otherwise(m["primary_metric"]).alias("k"), i.alias("i"), m.alias("m")))
    return F.get(F.array_sort(keyed), F.lit(0))["m"]


def evaluate(facts: DataFrame) -> DataFrame:
    """Verdict per row of FACTS: strength, viability, verdict, confidence, reasons, flags, decision, actions."""
    kind = F.col("target_kind")
    cls = kind == "classification"
    known = kind.isin("classification", "regression")
    good = F.filter("items", lambda m: (m["status"] == "success") & m["primary_metric"].isNotNull())
    df = facts.withColumns({"_good": good}).withColumn("_any", known & (F.size("_good") > 0))
    df = df.withColumn("_best", F.when(F.col("_any"), _best(F.col("_good"), kind)))
    best, base = F.col("_best"), F.col("baseline")
    primary, gap = best["primary_metric"], best["gap"]
    improvement = F.when(cls, primary - base).otherwise(base - primary)
    gain = F.when(cls, improvement).when(base > 0, improvement / base)
    df = df.withColumn("_gain", F.when(F.col("_any"), gain))
    g = F.col("_gain")
    strong = F.when(cls, (g >= 0.15) & (gap.isNull() | (gap <= 0.10))).otherwise((g >= 0.20) & F.coalesce(best["test_r2"] > 0.40, F.lit(False)))
    medium = F.when(cls, g >= 0.05).otherwise(g >= 0.08)
    strength = (
        F.when(~known, "unknown").when(~F.col("_any"), "none").when(g.isNull(), "unknown")
        .when(strong, "strong").when(medium, "medium").when(g > 0, "weak").otherwise("none")
    )
    df = df.withColumn("signal_strength", strength)
    s = F.col("signal_strength")
    beating = F.size(F.filter("_good", lambda m: F.coalesce(F.when(cls, m["primary_metric"] > base).otherwise(m["primary_metric"] < base), F.lit(False))))
    overfit = F.coalesce(F.col("_any") & (gap >= F.when(cls, F.lit(0.15)).otherwise(F.lit(0.25))), F.lit(False))
    first = F.when((s == "strong") & (beating >= 2), "strong").when(s.isin("strong", "medium", "weak"), "promising").when(s == "none", "not_useful").otherwise("unclear")
    lowered = F.when(overfit & (first == "strong"), "promising").when(overfit & (first == "promising"), "unclear").otherwise(first)
    viability = F.when(~known, "unknown").when(~F.col("_any"), "not_useful").otherwise(lowered)
    df = df.withColumns({"model_viability": viability, "_overfit": overfit})
    v = F.col("model_viability")

    found = F.flatten(F.transform("risky", lambda r: r["flags"]))
    flags = F.array_distinct(F.concat(
        F.coalesce("target_warnings", F.array().cast("array<string>")),
        F.array_compact(F.array(
            *[F.when(F.array_contains(found, r), F.lit(f"{r}_features")) for r in FEATURE_RISKS],
            F.when(F.col("row_count") < MIN_ROWS, F.lit("not_enough_rows")), F.when(known & ~F.col("_any"), F.lit("all_models_failed")),
            F.when(F.col("_any") & (s == "none"), F.lit("no_model_beats_baseline")), F.when(F.col("_overfit"), F.lit("overfit_risk")),
        )),
    ))
    df = df.withColumn("risk_flags", flags)
    risks = F.col("risk_flags")
    failing = _has(risks, *TARGET_FAILURES)
    good_signal = s.isin("strong", "medium") & v.isin("strong", "promising")
    verdict = (
        F.when(~known, F.when(_has(risks, "label_column_missing"), "needs_better_target").otherwise("not_enough_data"))
        .when(~F.col("_any"), F.when(failing, "needs_better_target").otherwise("needs_better_features"))
        .when(_has(risks, "not_enough_rows"), "not_enough_data").when(failing, "needs_better_target")
        .when(good_signal, F.when(_has(risks, "overfit_risk"), "try_more").otherwise("usable_signal"))
        .when((s == "weak") | (v == "unclear"), "try_more").when((s == "none") | (v == "not_useful"), "needs_better_features").otherwise("try_more")
    )
    bonus = F.coalesce(F.least(F.lit(0.35), F.greatest(F.lit(0.0), F.when(cls, g * 1.5).otherwise(g))), F.lit(0.0))
    doubt = F.when(F.col("_overfit"), F.when(cls, 0.15).otherwise(0.12)).otherwise(0.0) + F.when(cls & _has(risks, "class_imbalance"), 0.08).otherwise(0.0)
    confidence = F.when(~known, F.lit(0.2)).when(~F.col("_any"), F.lit(0.25)).otherwise(F.least(F.greatest(F.lit(0.35) + bonus - doubt, F.lit(0.0)), F.lit(1.0)))
    reasons = F.array_distinct(F.array_compact(F.array(
        F.when(~known, F.lit(REASONS["no_target"])),
        F.when(known & ~F.col("_any"), F.lit(REASONS["all_failed"])),
        F.when(F.col("_any"), F.concat(F.lit("Best "), kind, F.lit(" model: "), best["algorithm"], F.lit("."))),
        F.when(F.col("_any") & cls, F.coalesce(
            F.when(g.isNotNull(), F.format_string(REASONS["gain"], g)), F.lit(REASONS["no_gain"]))),
        F.when(F.col("_any") & ~cls, F.coalesce(
            F.when(g.isNotNull(), F.format_string(REASONS["rmse_gain"], g * 100)), F.lit(REASONS["no_rmse_gain"]))),
        F.when(F.col("_overfit"), F.format_string(REASONS["gap"], gap)),
        F.when(F.col("_any") & cls & _has(risks, "class_imbalance"), F.lit(REASONS["imbalance"])),
    )))
    df = df.withColumns({"overall_verdict": verdict, "confidence": confidence, "reasons": reasons, "best_algorithm": best["algorithm"]})
    # written once: a filter pushed through the rules would copy them over and over
    return materialize(df.withColumns({"decision": _decision(), "next_actions": _next_actions()}).select(
        "target_column", "target_kind", "best_algorithm", "signal_strength", "model_viability", "overall_verdict", "confidence", "reasons", "risk_flags",
        "decision", "next_actions",
    ))


def _decision() -> Column:
    """Struct (primary_message, recommended_path, primary_blocker) for verdict and flags."""
    verdict, risks = F.col("overall_verdict"), F.col("risk_flags")

    def made(name: str) -> Column:
        message, path, blocker = DECISIONS[name]
        return F.struct(F.lit(message).alias("primary_message"), F.lit(path).alias("recommended_path"), F.lit(blocker).cast("string").alias("primary_blocker"))

    picked = F.when(verdict == "usable_signal", made("usable_signal"))
    for name in ("needs_better_target", "not_enough_data"):
        picked = picked.when(verdict == name, made(name))
    for name in ("overfit_risk", "no_model_beats_baseline"):
        picked = picked.when(_has(risks, name), made(name))
    return picked.otherwise(made("other"))


def _flagged(risk: str):
    return lambda column: F.array_contains(column["flags"], risk)


def _next_actions() -> Column:
    """Ordered array of (action, reason, priority, affected_columns)."""
    risks, s, v = F.col("risk_flags"), F.col("signal_strength"), F.col("model_viability")
    risky = [f"{r}_features" for r in FEATURE_RISKS]
    conditions = {
        "change_target": _has(risks, *TARGET_FAILURES),
        "collect_more_rows": _has(risks, "not_enough_rows", "minority_class_too_small"),
        "try_balanced_class_weight": _has(risks, "class_imbalance") & (F.col("target_kind") == "classification"),
        "exclude_risky_columns": _has(risks, *risky),
        "try_regularized_model": _has(risks, "overfit_risk"),
        "inspect_features": _has(risks, "all_models_failed", "no_model_beats_baseline") | (v == "not_useful"),
        "inspect_clusters": s.isin("strong", "medium") & v.isin("promising", "strong"),
        "inspect_outliers": s.isin("weak", "none"),
    }
    # columns by warning, in the order of the risk flags
    affected = F.array_distinct(F.flatten(F.array(*[
        F.transform(F.filter("risky", _flagged(r)), lambda c: c["name"]) for r in FEATURE_RISKS
    ])))
    nothing = F.array().cast("array<string>")
    out = []
    for name, condition in conditions.items():
        reason, priority = ACTIONS[name]
        columns = affected if name == "exclude_risky_columns" else nothing
        out.append(F.when(condition, F.struct(
            F.lit(name).alias("action"), F.lit(reason).alias("reason"), F.lit(priority).alias("priority"), columns.alias("affected_columns")
        )))
    return F.array_compact(F.array(*out))


@dataclass
class Exploration:
    profile: DataFrame
    target: dict[str, Any]
    sweep: DataFrame
    evaluation: DataFrame
    roles: Roles


def model_sweep(
    df: DataFrame, roles: Roles, kind: str, spec: PrepSpec = PrepSpec(), order_by: Sequence[str] = ("_row_id",), split: dict[str, Any] | None = None,
    algorithms: Sequence[str] | None = None, **params,
) -> list[dict[str, Any]]:
    """One record per algorithm; all models share one split and one prepared table. A failing model is a row."""
    if kind not in SWEEP:
        return []
    if not roles.label:
        return [_item("none", failure="label_column_missing")]
    names = list(algorithms or SWEEP[kind])
    try:
        ready, pre, _ = split_and_fit_preprocessor(df, roles, spec, kind, order_by, split or {})
    except ValueError as exc:
        return [_item(a, failure=str(exc)) for a in names]
    items = []
    for algorithm in names:
        try:
            out = supervised_on(ready, pre, roles.label, algorithm, kind, **params)
            got = {r["metric"]: r["value"] for r in out.metrics.collect()}
            test, train = (got["test_f1"], got["train_f1"]) if kind == "classification" else (got["test_rmse"], got["train_rmse"])
            gap = abs(train - test) if test is not None and train is not None else None
            items.append(_item(algorithm, test, train, gap, got.get("test_r2")))
        except Exception as exc:  # noqa: BLE001 - one model must not stop the others
            items.append(_item(algorithm, failure=str(exc)))
    return items


def _item(algorithm, test=None, train=None, gap=None, r2=None, failure=None) -> dict[str, Any]:
    return {
        "algorithm": algorithm, "status": "failed" if failure else "success", "primary_metric": test, "train_metric": train, "gap": gap,
        "test_r2": r2, "failure_reason": failure,
    }


def best_algorithm(sweep: DataFrame, kind: str) -> DataFrame:
    """First best successful model of a sweep table with a ``position`` column."""
    good = sweep.filter((F.col("status") == "success") & F.col("primary_metric").isNotNull())
    order = -F.col("primary_metric") if kind == "classification" else F.col("primary_metric")
    return good.agg(F.min_by("algorithm", F.struct(order, F.col("position"))).alias("best_algorithm"))


def explore(
    df: DataFrame, roles: Roles, task: str = "auto", spec: PrepSpec = PrepSpec(), order_by: Sequence[str] = ("_row_id",),
    split: dict[str, Any] | None = None, algorithms: Sequence[str] | None = None, approx_profile: bool = False, **params,
) -> Exploration:
    """Is there a signal? Profile, target check, sweep over one prepared table, verdict."""
    spark = df.sparkSession
    asked, roles = roles.label, normalize_roles(df.columns, roles)
    profile = data_profile(df, approx_profile)
    columns = profile.collect()  # one row per column
    n = columns[0]["row_count"] if columns else 0
    if not roles.label:
        target = {**missing_target(spark, asked).first().asDict(), "baseline": None}
    else:
        kind = target_kind(df, [roles.label], task).first()["target_kind"]
        check = (class_feasibility if kind == "classification" else regression_feasibility)(df, [roles.label]).first().asDict()
        target = {**check, "baseline": check.get("baseline_accuracy", check.get("baseline_rmse"))}
    items = model_sweep(df, roles, target["target_kind"], spec, order_by, split, algorithms, **params)
    risky = [(r["name"], list(r["warning_flags"])) for r in columns if r["name"] in roles.features and r["warning_flags"]]
    names = [f.split(":")[0] for f in ITEM[7:-1].split(",")]
    facts = spark.createDataFrame(
        [(target["target_column"], target["target_kind"], target["baseline"], list(target["warnings"]), n, risky, [tuple(i[k] for k in names) for i in items])], FACTS
    )
    sweep = spark.createDataFrame(
        [(p, *[i[k] for k in names]) for p, i in enumerate(items)],
        "position int, algorithm string, status string, primary_metric double, train_metric double, gap double, test_r2 double, failure_reason string",
    )
    return Exploration(profile, target, sweep, evaluate(facts), roles)
