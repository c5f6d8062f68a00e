"""Verdict rules over facts derived per supplier, and the composed Explore flow."""

from pyspark.sql import functions as F

from tablescope.catalog import read
from tablescope.catalog.features import KEY
from tablescope.plans import explore as X
from tablescope.plans.roles import Roles
from tablescope.sources.export import evaluation_table, metrics_table

C, L = F.col, F.lit
_ALGORITHMS = ("first", "second", "third", "fourth")


def facts(s, d):
    """One target per supplier; baselines, scores and warnings vary with its lines."""
    k = C("k")
    g = read(s, d, "lineitem").groupBy(C("l_suppkey").alias("k")).agg(F.count(L(1)).alias("n"))
    kind = F.when(k % 10 == 9, L("unknown")).when(k % 2 == 0, L("classification")).otherwise(L("regression"))
    base = F.when(k % 13 == 0, L(None).cast("double")).when(k % 2 == 0, (30 + k % 7 * 10) / 100.0).otherwise(k % 5 * 50 / 100.0)
    warnings = F.array_compact(F.array(
        F.when(k % 10 == 9, L("label_column_missing")), F.when(k % 11 == 0, L("single_class_target")),
        F.when(k % 12 == 5, L("minority_class_too_small")), F.when(k % 8 == 0, L("class_imbalance")),
    ))

    def risky(column, *flags):
        return F.struct(L(column).alias("name"), F.array(*[L(f) for f in flags]).alias("flags"))

    risks = F.array_compact(F.array(
        F.when(k % 6 == 1, risky("l_tax", "high_missing_rate", "low_variance")), F.when(k % 4 == 1, risky("l_orderkey", "likely_identifier"))
    ))
    items = []
    for i, name in enumerate(_ALGORITHMS):
        primary = (20 + (C("n") + k * (i + 3)) % 75) / 100.0
        failed = ((k + i) % 5 == 0) | (k % 17 == 0)
        items.append(F.struct(
            L(name).alias("algorithm"), F.when(failed, L("failed")).otherwise(L("success")).alias("status"), F.when(~failed, primary).alias("primary_metric"),
            F.when(~failed, primary).alias("train_metric"), F.when(~failed, (C("n") + k * (i + 1)) % 30 / 100.0).alias("gap"),
            F.when(~failed, (C("n") + k * i) % 10 / 10.0).alias("test_r2"), F.when(failed, L("boom")).alias("failure_reason"),
        ))
    return g.select(
        k.cast("string").alias("target_column"), kind.alias("target_kind"), base.alias("baseline"), warnings.alias("target_warnings"),
        (C("n") % 40).alias("row_count"), risks.alias("risky"), F.array(*items).alias("items"),
    )


_ITEMS = " UNION ALL ".join(
    f"""SELECT k, {i} AS i, '{name}' AS algorithm, (k + {i}) % 5 = 0 OR k % 17 = 0 AS failed, (20 + (n + k * {i + 3}) % 75) / 100.0::DOUBLE AS prim,
        (n + k * {i + 1}) % 30 / 100.0::DOUBLE AS gap, (n + k * {i}) % 10 / 10.0::DOUBLE AS r2 FROM g"""
    for i, name in enumerate(_ALGORITHMS)
)
_RULES = f"""
    WITH g AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT k, n % 40 AS rows, CASE WHEN k % 10 = 9 THEN 'unknown' WHEN k % 2 = 0 THEN 'classification' ELSE 'regression' END AS kind,
                 CASE WHEN k % 13 = 0 THEN NULL WHEN k % 2 = 0 THEN (30 + k % 7 * 10) / 100.0::DOUBLE ELSE k % 5 * 50 / 100.0::DOUBLE END AS base FROM g),
    i AS ({_ITEMS}), ok AS (SELECT i.*, kind, base FROM i JOIN f USING (k) WHERE NOT failed),
    b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN kind = 'classification' THEN -prim ELSE prim END, i) AS r FROM ok),
    w AS (SELECT k, count(*) FILTER (CASE WHEN kind = 'classification' THEN prim > base ELSE prim < base END) AS beating FROM ok GROUP BY 1),
    j AS (SELECT f.*, algorithm, prim, gap, r2, coalesce(beating, 0) AS beating, f.kind <> 'unknown' AND b.k IS NOT NULL AS fitted,
                 CASE WHEN f.kind = 'classification' THEN prim - f.base WHEN f.base > 0 THEN (f.base - prim) / f.base END AS gain
          FROM f LEFT JOIN b ON b.k = f.k AND r = 1 LEFT JOIN w ON w.k = f.k),
    s AS (SELECT *, CASE WHEN kind = 'unknown' THEN 'unknown' WHEN NOT fitted THEN 'none' WHEN gain IS NULL THEN 'unknown'
                    WHEN kind = 'classification' AND gain >= 0.15::DOUBLE AND gap <= 0.10::DOUBLE THEN 'strong' WHEN kind = 'regression' AND gain >= 0.20::DOUBLE AND r2 > 0.40::DOUBLE THEN 'strong'
                    WHEN gain >= CASE WHEN kind = 'classification' THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END THEN 'medium' WHEN gain > 0 THEN 'weak' ELSE 'none' END AS strength,
                 fitted AND gap >= CASE WHEN kind = 'classification' THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END AS overfit FROM j),
    v AS (SELECT *, CASE WHEN strength = 'strong' AND beating >= 2 THEN 3 WHEN strength IN ('strong', 'medium', 'weak') THEN 2 WHEN strength = 'none' THEN 0 ELSE 1 END AS step FROM s),
    x AS (SELECT *, CASE WHEN kind = 'unknown' THEN 'unknown' WHEN NOT fitted THEN 'not_useful'
                    ELSE ['not_useful', 'unclear', 'promising', 'strong'][(CASE WHEN overfit AND step >= 2 THEN step - 1 ELSE step END) + 1] END AS viability,
                 k % 10 = 9 OR k % 11 = 0 AS target_failure FROM v),
    y AS (SELECT *, CASE WHEN kind = 'unknown' THEN 'needs_better_target' WHEN NOT fitted THEN CASE WHEN target_failure THEN 'needs_better_target' ELSE 'needs_better_features' END
                    WHEN rows < 20 THEN 'not_enough_data' WHEN target_failure THEN 'needs_better_target'
                    WHEN strength IN ('strong', 'medium') AND viability IN ('strong', 'promising') THEN CASE WHEN overfit THEN 'try_more' ELSE 'usable_signal' END
                    WHEN strength = 'weak' OR viability = 'unclear' THEN 'try_more' WHEN strength = 'none' OR viability = 'not_useful' THEN 'needs_better_features' ELSE 'try_more' END AS verdict,
                 concat_ws(',', CASE WHEN k % 10 = 9 THEN 'label_column_missing' END, CASE WHEN k % 11 = 0 THEN 'single_class_target' END, CASE WHEN k % 12 = 5 THEN 'minority_class_too_small' END,
                    CASE WHEN k % 8 = 0 THEN 'class_imbalance' END, CASE WHEN k % 4 = 1 THEN 'likely_identifier_features' END,
                    CASE WHEN k % 6 = 1 THEN 'high_missing_rate_features,low_variance_features' END, CASE WHEN rows < 20 THEN 'not_enough_rows' END,
                    CASE WHEN kind <> 'unknown' AND NOT fitted THEN 'all_models_failed' END, CASE WHEN fitted AND strength = 'none' THEN 'no_model_beats_baseline' END,
                    CASE WHEN overfit THEN 'overfit_risk' END) AS flags FROM x)"""
_VERDICT_SQL = f"""{_RULES}
    SELECT CAST(k AS VARCHAR) AS target_column, kind AS target_kind, CASE WHEN fitted THEN algorithm END AS best_algorithm, strength AS signal_strength, viability AS model_viability,
           verdict AS overall_verdict, flags AS risk_flags,
           round(CASE WHEN kind = 'unknown' THEN 0.2 WHEN NOT fitted THEN 0.25 ELSE
             greatest(0, least(1, 0.35::DOUBLE + coalesce(least(0.35::DOUBLE, greatest(0, gain * CASE WHEN kind = 'classification' THEN 1.5::DOUBLE ELSE 1 END)), 0)
               - CASE WHEN NOT overfit THEN 0 WHEN kind = 'classification' THEN 0.15 ELSE 0.12 END - CASE WHEN kind = 'classification' AND k % 8 = 0 THEN 0.08 ELSE 0 END)) END, 9) AS confidence
    FROM y"""


def _verdict(s, d):
    out = X.evaluate(facts(s, d))
    return out.select(
        "target_column", "target_kind", "best_algorithm", "signal_strength", "model_viability", "overall_verdict", F.array_join("risk_flags", ",").alias("risk_flags"),
        F.round("confidence", 9).alias("confidence"),
    )


def _decision(s, d):
    return X.evaluate(facts(s, d)).select("target_column", "decision.*")


_DECISION_SQL = f"""{_RULES}
    SELECT CAST(k AS VARCHAR) AS target_column,
           CASE WHEN verdict = 'usable_signal' THEN 'Signal looks usable. Proceed to workflow validation.' WHEN verdict = 'needs_better_target' THEN 'Current target configuration is not suitable for reliable learning.'
                WHEN verdict = 'not_enough_data' THEN 'Data volume is too small for stable model evaluation.' WHEN overfit THEN 'Potential overfitting detected. Improve data quality before workflow.'
                WHEN fitted AND strength = 'none' THEN 'Current feature set does not outperform baseline reliably.' ELSE 'Feature signal needs improvement before workflow execution.' END AS primary_message,
           CASE WHEN verdict = 'usable_signal' THEN 'run_workflow' WHEN verdict = 'needs_better_target' THEN 'change_target' WHEN verdict = 'not_enough_data' THEN 'collect_more_data'
                WHEN overfit THEN 'inspect_data_quality' WHEN fitted AND strength = 'none' THEN 'use_baseline' ELSE 'adjust_features' END AS recommended_path,
           CASE WHEN verdict = 'usable_signal' THEN NULL WHEN verdict = 'needs_better_target' THEN 'target_configuration' WHEN verdict = 'not_enough_data' THEN 'row_count'
                WHEN overfit THEN 'train_test_gap' WHEN fitted AND strength = 'none' THEN 'baseline_gap' ELSE 'feature_quality' END AS primary_blocker FROM y"""


def _actions(s, d):
    out = X.evaluate(facts(s, d)).select("target_column", F.posexplode("next_actions").alias("position", "a"))
    return out.select("target_column", "position", "a.action", "a.priority", F.array_join("a.affected_columns", ",").alias("affected_columns"))


_ACTIONS_SQL = f"""{_RULES},
    a AS (SELECT k, p, action, priority, cols FROM y, LATERAL (VALUES
        (1, 'change_target', 'high', '', target_failure), (2, 'collect_more_rows', 'high', '', rows < 20 OR k % 12 = 5),
        (3, 'try_balanced_class_weight', 'high', '', k % 8 = 0 AND kind = 'classification'),
        (4, 'exclude_risky_columns', 'medium', concat_ws(',', CASE WHEN k % 4 = 1 THEN 'l_orderkey' END, CASE WHEN k % 6 = 1 THEN 'l_tax' END), k % 4 = 1 OR k % 6 = 1),
        (5, 'try_regularized_model', 'medium', '', overfit), (6, 'inspect_features', 'high', '', (kind <> 'unknown' AND NOT fitted) OR (fitted AND strength = 'none') OR viability = 'not_useful'),
        (7, 'inspect_clusters', 'low', '', strength IN ('strong', 'medium') AND viability IN ('promising', 'strong')), (8, 'inspect_outliers', 'low', '', strength IN ('weak', 'none'))
    ) t(p, action, priority, cols, hit) WHERE hit)
    SELECT CAST(k AS VARCHAR) AS target_column, (row_number() OVER (PARTITION BY k ORDER BY p) - 1)::INT AS position, action, priority, cols AS affected_columns FROM a"""


def _reasons(s, d):
    return X.evaluate(facts(s, d)).select("target_column", F.posexplode("reasons").alias("position", "reason"))


_REASONS_SQL = f"""{_RULES},
    a AS (SELECT k, p, reason FROM y, LATERAL (VALUES
        (1, 'Label column is missing or target kind is not inferable.', kind = 'unknown'), (2, 'All candidate models failed to train or evaluate for this target.', kind <> 'unknown' AND NOT fitted),
        (3, 'Best ' || kind || ' model: ' || algorithm || '.', fitted),
        (4, CASE WHEN kind = 'classification' AND gain IS NULL THEN 'Baseline improvement could not be computed.' WHEN gain IS NULL THEN 'Baseline RMSE improvement could not be computed.'
                 WHEN kind = 'classification' THEN printf('Best model improves baseline by %.4f.', gain) ELSE printf('Best model reduces baseline RMSE by %.1f%%.', gain * 100) END, fitted),
        (5, printf('Train/test gap is large (%.4f).', gap), overfit), (6, 'Class imbalance may limit stability on minority classes.', fitted AND kind = 'classification' AND k % 8 = 0)
    ) t(p, reason, hit) WHERE hit)
    SELECT CAST(k AS VARCHAR) AS target_column, (row_number() OVER (PARTITION BY k ORDER BY p) - 1)::INT AS position, reason FROM a"""


def _sweep_rows(s, d):
    """Gap and overfit warning of given train and test scores."""
    long = facts(s, d).select("target_column", "target_kind", F.inline("items")).filter("status = 'success'")
    gap, risk = X.sweep_gap(C("primary_metric") + C("gap"), C("primary_metric"), C("target_kind"))
    return long.select("target_column", "algorithm", F.round(gap, 6).alias("gap"), risk.alias("overfit_risk"))


_SWEEP_SQL = f"""{_RULES} SELECT CAST(k AS VARCHAR) AS target_column, algorithm, round(abs((prim + gap) - prim), 6) AS gap,
    abs((prim + gap) - prim) >= CASE WHEN kind = 'classification' THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END AS overfit_risk FROM ok"""


def _best(s, d):
    long = facts(s, d).filter("target_kind = 'regression'").select(C("target_column").cast("int").alias("t"), F.posexplode("items").alias("i", "m")).select(
        "t", "i", "m.*", (C("t") * 10 + C("i")).alias("position")
    )
    return X.best_algorithm(long.withColumn("algorithm", F.concat(C("t").cast("string"), L(":"), C("algorithm"))), "regression")


_BEST_SQL = f"{_RULES} SELECT arg_min(k || ':' || algorithm, (prim, k * 10 + i)) AS best_algorithm FROM ok WHERE kind = 'regression'"


def _evaluation_export(s, d):
    return evaluation_table(X.evaluate(facts(s, d)), s).filter(C("key").isin("overall_verdict", "signal_strength", "model_viability", "risk_flags", "decision"))


_EXPORT_SQL = f"""{_RULES}, d AS ({_DECISION_SQL.split(_RULES)[1]})
    SELECT CAST(k AS VARCHAR) AS target_column, key, value FROM y JOIN d ON d.target_column = CAST(k AS VARCHAR), LATERAL (VALUES ('overall_verdict', verdict), ('signal_strength', strength),
        ('model_viability', viability), ('risk_flags', CASE WHEN flags = '' THEN '[]' ELSE '["' || replace(flags, ',', '","') || '"]' END),
        ('decision', '{{"primary_message":"' || primary_message || '","recommended_path":"' || recommended_path || '","primary_blocker":' || coalesce('"' || primary_blocker || '"', 'null') || '}}')) t(key, value)"""


def _metrics_export(s, d):
    lines = read(s, d, "lineitem")
    metrics = lines.agg(F.count(L(1)).cast("double").alias("value")).select(L("rows").alias("metric"), "value")
    matrix = lines.groupBy(C("l_returnflag").alias("truth"), C("l_linestatus").alias("prediction")).agg(F.count(L(1)).alias("n"))
    return metrics_table(metrics, {"confusion_matrix": matrix})


_METRICS_SQL = """
    WITH m AS (SELECT l_returnflag AS t, l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT 'rows' AS key, CAST(count(*)::DOUBLE AS VARCHAR) AS value FROM lineitem
    UNION ALL SELECT 'confusion_matrix', '[' || string_agg('{"truth":"' || t || '","prediction":"' || p || '","n":' || n || '}', ',' ORDER BY t, p) || ']' FROM m"""


def _without(s, d):
    """Independent columns: no model should beat the share of the largest class."""
    df = read(s, d, "orders").select("o_orderkey", "o_totalprice", C("o_custkey").cast("double").alias("cust"), "o_orderstatus")
    out = X.explore(df, Roles(("o_totalprice", "cust"), "o_orderstatus", "o_orderkey"), order_by=["o_orderkey"])
    return out.evaluation.select("target_kind", "signal_strength", "model_viability", "overall_verdict")


def _explore(s, d, label, features):
    df = read(s, d, "lineitem").select(
        *KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", F.when(C("l_quantity") * (1 - C("l_discount")) > 25, L("hi")).otherwise(L("lo")).alias("size"),
    )
    out = X.explore(df, Roles(features, label), order_by=KEY)
    return out.evaluation.select("target_kind", "signal_strength", "model_viability", "overall_verdict", F.array_join("risk_flags", ",").alias("risk_flags"))


def _missing(s, d):
    return X.explore(read(s, d, "customer"), Roles(("c_acctbal",), "absent"), order_by=["c_custkey"]).evaluation.select(
        "target_kind", "overall_verdict", "confidence", "decision.recommended_path", F.array_join("risk_flags", ",").alias("risk_flags")
    )


QUERIES = {
    "verdict_rules": (_verdict, _VERDICT_SQL),
    "decision": (_decision, _DECISION_SQL),
    "next_actions": (_actions, _ACTIONS_SQL),
    "verdict_reasons": (_reasons, _REASONS_SQL),
    "sweep_rows": (_sweep_rows, _SWEEP_SQL),
    "best_algorithm": (_best, _BEST_SQL),
    "export_evaluation": (_evaluation_export, _EXPORT_SQL),
    "export_metrics": (_metrics_export, _METRICS_SQL),
    "explore": (lambda s, d: _explore(s, d, "size", ("l_quantity", "l_discount", "l_tax")), None),
    "explore_without_signal": (_without, None),
    "explore_missing_label": (
        _missing,
        """SELECT 'unknown' AS target_kind, 'needs_better_target' AS overall_verdict, 0.2::DOUBLE AS confidence, 'change_target' AS recommended_path,
           'label_column_missing' || CASE WHEN count(DISTINCT c_acctbal) / count(*) > 0.9 THEN ',likely_identifier_features' ELSE '' END AS risk_flags FROM customer""",
    ),
}
