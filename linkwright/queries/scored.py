"""Decision, context, metric and universe operators over the scored-pair views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, decide, metrics, universe
from ..sources.views import entities, roles, scored, scored_b, targets, truth_of, with_views

QUERIES: dict[str, tuple[Callable, str | None]] = {}
BASE = ("scored", "truth", "entities")


def register(name: str, sql: str | None = None):
    # DuckDB rounds a tiny negative number to -0.0, Spark to 0.0
    sql = sql and sql.replace(", 6) AS ", ", 6) + 0.0::DOUBLE AS ")

    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- decision --------------------------------------------------------------------------------

EF = """SELECT {keys}, t, p FROM (
  SELECT *, max((ef, -k)) OVER (PARTITION BY {keys}) AS best FROM (
    SELECT *, 1.25::DOUBLE * run / (0.25::DOUBLE * total + k) AS ef FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC, t) AS k,
        sum(p) OVER (PARTITION BY {keys} ORDER BY p DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
        sum(p) OVER (PARTITION BY {keys}) AS total,
        CASE WHEN max(p) OVER (PARTITION BY {keys}) >= 1 THEN 0.0 ELSE exp(sum(CASE WHEN p < 1 THEN ln(1 - p) END) OVER (PARTITION BY {keys})) END AS none
      FROM {rows}))) WHERE best[1] > none AND k <= -best[2]"""
DECIDED = {"decided": EF.format(keys="q", rows="(SELECT * FROM own WHERE p >= 0.05)")}
METRIC = {
    "per": "SELECT d.q, count(*)::DOUBLE AS n_pred, count(truth.q) AS tp FROM decided d LEFT JOIN truth ON d.q = truth.q AND d.t = truth.t GROUP BY d.q",
    "ent": """SELECT q, n_true, n_pred, tp, CASE WHEN n_pred > 0 THEN tp / n_pred END AS precision, CASE WHEN n_true > 0 THEN tp / n_true::DOUBLE END AS recall,
      CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0
           ELSE 1.25::DOUBLE * (tp / n_pred) * (tp / n_true::DOUBLE) / (0.25::DOUBLE * (tp / n_pred) + tp / n_true::DOUBLE) END AS f05
      FROM (SELECT e.q, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0.0::DOUBLE) AS n_pred, coalesce(tp, 0) AS tp FROM entities e
            LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) USING (q) LEFT JOIN per USING (q))""",
}


@register("exclusive", with_views("SELECT q, t, round(p, 6) AS p FROM own", "scored", "own"))
def exclusive(spark, d):
    return rounded(decide.exclusive(scored(spark, d)).select("q", "t", "p"), "p")


@register("exclusive_first", with_views("SELECT q, t, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, q) AS r FROM scored) WHERE r = 1", "scored"))
def exclusive_first(spark, d):
    return rounded(decide.exclusive(scored(spark, d), tie="first").select("q", "t", "p"), "p")


@register("threshold", with_views("SELECT q, t, round(p, 6) AS p FROM own WHERE p >= 0.6", "scored", "own"))
def threshold(spark, d):
    return rounded(decide.threshold(scored(spark, d), 0.6).select("q", "t", "p"), "p")


@register(
    "score_profile",
    with_views(
        """SELECT country, entities, round(linked, 6) AS linked, round(links_each, 6) AS links_each, round(top_low, 6) AS top_low, round(top_between, 6) AS top_between, round(top_high, 6) AS top_high,
          round(link_unsure, 6) AS link_unsure, round(link_mean, 6) AS link_mean, round(target_none, 6) AS target_none, round(target_likely, 6) AS target_likely
        FROM (SELECT country, count(*) AS entities, avg((coalesce(n, 0) > 0)::INT) AS linked, avg(coalesce(n, 0)) AS links_each, avg((coalesce(top, 0) < 0.2)::INT) AS top_low,
            avg((coalesce(top, 0) BETWEEN 0.2 AND 0.8)::INT) AS top_between, avg((coalesce(top, 0) > 0.95)::INT) AS top_high
          FROM entities LEFT JOIN (SELECT q, max(p) AS top, count(*) FILTER (p >= 0.6) AS n FROM own GROUP BY q) USING (q) GROUP BY 1)
        LEFT JOIN (SELECT e.country, avg((p < 0.8)::INT) AS link_unsure, avg(p) AS link_mean FROM own JOIN entities e USING (q) WHERE p >= 0.6 GROUP BY 1) USING (country)
        LEFT JOIN (SELECT country, avg((coalesce(most, 0) < 0.05)::INT) AS target_none, avg((coalesce(most, 0) > 0.5)::INT) AS target_likely
          FROM targets LEFT JOIN (SELECT t, max(p) AS most FROM scored GROUP BY t) USING (t) GROUP BY 1) USING (country)""",
        "scored", "own", "entities", "targets",
    ),
)
def score_profile(spark, d):
    x = scored(spark, d)
    got = metrics.score_profile(x, decide.threshold(x.select("q", "t", "p"), 0.6), entities(spark, d), targets(spark, d))
    return rounded(got, *[c for c in got.columns if c not in ("country", "entities")])


@register("expected_f", with_views("SELECT q, t, round(p, 6) AS p FROM decided", "scored", "own", **DECIDED))
def expected_f(spark, d):
    return rounded(decide.expected_f(scored(spark, d), 0.05).select("q", "t", "p"), "p")


GATED = EF.format(keys="q", rows="(SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY q) AS top FROM own) WHERE top >= 0.9 AND p >= 0.05)")


@register("gated_ef", with_views(f"SELECT q, t, round(p, 6) AS p FROM ({GATED})", "scored", "own"))
def gated_ef(spark, d):
    return rounded(decide.gated(scored(spark, d), 0.9).select("q", "t", "p"), "p")


def _grid_sql() -> str:
    own = "labelled AS (SELECT o.q, o.t, o.p, o.top, count(truth.q) AS y FROM (SELECT *, max(p) OVER (PARTITION BY q) AS top FROM own) o LEFT JOIN truth ON o.q = truth.q AND o.t = truth.t GROUP BY ALL)"
    values = ", ".join(f"('{r}', {v}::DOUBLE)" for r, vs in (("threshold", decide.THRESHOLDS), ("expected", decide.FLOORS), ("gated", decide.GATES)) for v in vs)
    return f"""{own}, rules AS (SELECT * FROM (VALUES {values}) v(rule, value)),
each AS (SELECT rule, value, q, t, p, y FROM labelled, rules WHERE CASE WHEN rule = 'gated' THEN top >= value AND p >= 0.05 ELSE p >= value END),
kept AS (SELECT rule, value, q, t, p FROM each WHERE rule = 'threshold' UNION ALL SELECT rule, value, q, t, p FROM ({EF.format(keys="rule, value, q", rows="(SELECT * FROM each WHERE rule <> 'threshold')")})),
per AS (SELECT rule, value, kept.q, count(*)::DOUBLE AS n_pred, count(truth.q) AS tp FROM kept LEFT JOIN truth ON kept.q = truth.q AND kept.t = truth.t GROUP BY ALL),
sizes AS (SELECT e.q, coalesce(n_true, 0) AS n_true FROM entities e LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) USING (q))
SELECT rule, value, round(avg(CASE WHEN n_true = 0 THEN CASE WHEN n_pred IS NULL THEN 1.0 ELSE 0.0 END WHEN coalesce(tp, 0) = 0 THEN 0.0
   ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END), 6) AS f05, coalesce(sum(n_pred), 0)::BIGINT AS n_links
FROM rules CROSS JOIN sizes LEFT JOIN per USING (rule, value, q) GROUP BY rule, value"""


@register("rule_grid", with_views("SELECT 1", "scored", "truth", "entities", "own").replace("\nSELECT 1", ",\n" + _grid_sql()))
def rule_grid(spark, d):
    return rounded(decide.grid(scored(spark, d), truth_of(spark, d), entities(spark, d)), "f05")


@register("best_rule", with_views("SELECT 1", "scored", "truth", "entities", "own").replace("\nSELECT 1", ",\n" + f"g AS (SELECT * FROM (WITH {_grid_sql()})) SELECT rule, value, f05 FROM g ORDER BY f05 DESC, rule, value LIMIT 1"))
def best_rule(spark, d):
    return decide.best_rule(rounded(decide.grid(scored(spark, d), truth_of(spark, d), entities(spark, d)), "f05")).select("rule", "value", "f05")


UNION = {
    "both_sides": "SELECT coalesce(a.q, b.q) AS q, coalesce(a.t, b.t) AS t, a.p AS p_a, b.p AS p_b FROM scored a FULL JOIN scored_b b ON a.q = b.q AND a.t = b.t"
}


def _both(spark, d):
    a, b = scored(spark, d).select("q", "t", F.col("p").alias("p_a")), scored_b(spark, d).select("q", "t", F.col("p").alias("p_b"))
    return a.join(b, ["q", "t"], "full")


@register("prefilter", with_views("SELECT q, t, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b FROM both_sides WHERE greatest(coalesce(p_a, 0), coalesce(p_b, 0)) >= 0.5", "scored", "scored_b", **UNION))
def prefilter(spark, d):
    return rounded(decide.prefilter(_both(spark, d), 0.5, ["p_a", "p_b"]), "p_a", "p_b")


SHIFTS = [round(-2 + 0.5 * i, 1) for i in range(17)]
_C = "least(greatest(p, 0.000001::DOUBLE), 0.999999::DOUBLE)"


@register(
    "logit_shift",
    with_views(
        f"""SELECT s AS shift, round(avg(CASE WHEN country = 'Brand#7' THEN CASE WHEN coalesce(1 / (1 + exp(-(ln({_C} / (1 - {_C})) - s))) >= 0.5, false) THEN 0.0 ELSE 1.0 END END), 6) AS empty_share,
          round(avg(CASE WHEN country <> 'Brand#7' THEN CASE WHEN coalesce(p >= 0.5, false) THEN 0.0 ELSE 1.0 END END), 6) AS others_share
        FROM (SELECT a.q, a.country, b.p FROM (SELECT DISTINCT q, country FROM scored) a LEFT JOIN (SELECT q, max(p) AS p FROM own GROUP BY q) b USING (q)),
             (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in SHIFTS)}]) AS s) GROUP BY s""",
        "scored", "own",
    ),
)
def logit_shift(spark, d):
    return rounded(decide.shift_grid(scored(spark, d), "Brand#7", SHIFTS, 0.5), "empty_share", "others_share")


@register("oracle_ceiling", with_views("SELECT round(avg(f05), 6) AS f05, count(*) AS n FROM ent", *BASE, decided="SELECT q, t FROM scored SEMI JOIN truth USING (q, t)", **METRIC))
def oracle_ceiling(spark, d):
    truth = truth_of(spark, d)
    possible = scored(spark, d).join(truth, ["q", "t"], "left_semi")
    return rounded(metrics.macro_f05(possible, truth, entities(spark, d)).select("f05", "n"), "f05")


@register(
    "entity_cost_weights",
    with_views(
        """SELECT q, k, round(CASE WHEN k <= 0 THEN 1.0 ELSE 1 - 1.25::DOUBLE * k / (0.25::DOUBLE * k + k + 1) END, 6) AS fp_cost,
          round(CASE WHEN k <= 1 THEN 1.0 ELSE 1 - 1.25::DOUBLE * (k - 1) / (0.25::DOUBLE * k + k - 1) END, 6) AS fn_cost
        FROM (SELECT e.q, coalesce(n, 0) AS k FROM entities e LEFT JOIN (SELECT q, count(*) AS n FROM truth GROUP BY q) USING (q))""",
        *BASE,
    ),
)
def entity_cost_weights(spark, d):
    x = entities(spark, d).select("q").join(metrics.links_per(truth_of(spark, d), "k"), "q", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rounded(x.withColumns({"fp_cost": decide.fp_cost(F.col("k")), "fn_cost": decide.fn_cost(F.col("k"))}), "fp_cost", "fn_cost")


# --- metrics ---------------------------------------------------------------------------------


def _decided(spark, d):
    return decide.expected_f(scored(spark, d), 0.05)


MACRO = """SELECT round(avg(f05), 6) AS f05, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
  round(avg(CASE WHEN n_true = 0 THEN f05 END), 6) AS f05_single, round(avg(CASE WHEN n_true > 0 THEN f05 END), 6) AS f05_linked, count(*) AS n FROM ent"""
NUMBERS = ("f05", "precision", "recall", "f05_single", "f05_linked")
_WEIGHTED = """SELECT d.q, sum(CASE WHEN owned.t IS NULL THEN {w}::DOUBLE ELSE 1.0 END) AS n_pred, count(truth.q) AS tp FROM decided d
  LEFT JOIN truth ON d.q = truth.q AND d.t = truth.t LEFT JOIN (SELECT DISTINCT t FROM truth) owned ON d.t = owned.t GROUP BY d.q"""


@register("macro_f05", with_views(MACRO, *BASE, "own", **DECIDED, **METRIC))
def macro_f05(spark, d):
    return rounded(metrics.macro_f05(_decided(spark, d), truth_of(spark, d), entities(spark, d)), *NUMBERS)


@register("macro_f05_doubled", with_views(MACRO, *BASE, "own", **DECIDED, **(METRIC | {"per": _WEIGHTED.format(w=2)})))
def macro_f05_doubled(spark, d):
    return rounded(metrics.macro_f05(_decided(spark, d), truth_of(spark, d), entities(spark, d), 2.0), *NUMBERS)


@register(
    "macro_f05_weighted",
    with_views(
        "SELECT round(avg(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 ELSE coalesce(1.25::DOUBLE * tp / nullif(0.25::DOUBLE * n_true + n_pred, 0), 0) END), 6) AS f05, count(*) AS n FROM ent",
        *BASE, "own", **DECIDED, **(METRIC | {"per": _WEIGHTED.format(w=1.5)}),
    ),
)
def macro_f05_weighted(spark, d):
    return rounded(metrics.macro_f05_closed(_decided(spark, d), truth_of(spark, d), entities(spark, d), 1.5), "f05")


LABELLED = {"labelled": "SELECT s.q, s.t, s.p, s.country, CASE WHEN truth.q IS NULL THEN 0 ELSE 1 END AS y FROM scored s LEFT JOIN truth ON s.q = truth.q AND s.t = truth.t"}


@register("labels_join", with_views("SELECT q, t, round(p, 6) AS p, y FROM labelled", "scored", "truth", **LABELLED))
def labels_join(spark, d):
    return rounded(universe.labels(scored(spark, d).select("q", "t", "p"), truth_of(spark, d)), "p")


@register(
    "auc",
    with_views(
        """SELECT country, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE, 6) AS auc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg
        FROM (SELECT country, y, rank() OVER (PARTITION BY country ORDER BY p) + (count(*) OVER (PARTITION BY country, p) - 1) / 2.0 AS r FROM labelled) GROUP BY country""",
        "scored", "truth", **LABELLED,
    ),
)
def auc(spark, d):
    return rounded(metrics.auc(universe.labels(scored(spark, d), truth_of(spark, d)), by="country"), "auc")


@register(
    "logloss",
    with_views(
        f"SELECT round(avg(-(y * ln({_C}) + (1 - y) * ln(1 - {_C}))), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5)::INT = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labelled",
        "scored", "truth", **LABELLED,
    ),
)
def logloss(spark, d):
    return rounded(metrics.log_loss(universe.labels(scored(spark, d), truth_of(spark, d))), "log_loss", "accuracy")


@register(
    "spearman_leak",
    with_views(
        """SELECT country, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM (SELECT country, row_number() OVER (PARTITION BY country ORDER BY q, t) AS ra, row_number() OVER (PARTITION BY country ORDER BY t, q) AS rb
        FROM truth JOIN entities USING (q)) GROUP BY country""",
        *BASE,
    ),
)
def spearman_leak(spark, d):
    return rounded(metrics.spearman(truth_of(spark, d).join(entities(spark, d), "q"), "q", "t", "country"), "spearman")


@register(
    "universe_report",
    with_views(
        """SELECT e.country, e.n_q, coalesce(n_t, 0) AS n_t, round(coalesce(n_t, 0) / n_q::DOUBLE, 6) AS t_per_q, round(coalesce(free, 0) / n_q::DOUBLE, 6) AS distractors_per_q
        FROM (SELECT country, count(*) AS n_q FROM entities GROUP BY 1) e LEFT JOIN (SELECT country, count(*) AS n_t, count(*) FILTER (WHERE o.t IS NULL) AS free
          FROM targets LEFT JOIN (SELECT DISTINCT t FROM truth) o ON targets.t = o.t GROUP BY 1) USING (country)""",
        *BASE, "targets",
    ),
)
def universe_report(spark, d):
    return rounded(metrics.universe_report(entities(spark, d), targets(spark, d), truth_of(spark, d)), "t_per_q", "distractors_per_q")


@register(
    "profile_by_country",
    with_views(
        """SELECT country, count(*) AS n_q, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_linked, round(avg(coalesce(n, 0)), 6) AS links_per_q
        FROM entities LEFT JOIN (SELECT q, count(*) AS n FROM decided GROUP BY q) USING (q) GROUP BY country""",
        *BASE, "own", **DECIDED,
    ),
)
def profile_by_country(spark, d):
    return rounded(metrics.profile(_decided(spark, d), entities(spark, d)), "share_linked", "links_per_q")


@register(
    "outcome_loss",
    with_views(
        """SELECT outcome, n, round(coalesce(loss / nullif(sum(loss) OVER (), 0), 0), 6) AS loss_share FROM (SELECT CASE WHEN n_true = 0 AND n_pred = 0 THEN 'right_empty' WHEN n_true = 0 THEN 'false_on_single'
          WHEN n_pred = 0 THEN 'nothing_found' WHEN tp = n_true AND tp = n_pred THEN 'perfect' WHEN tp = n_pred THEN 'missed_only' WHEN tp = n_true THEN 'extra_only' ELSE 'both' END AS outcome,
          count(*) AS n, sum(1 - f05) AS loss FROM ent GROUP BY 1)""",
        *BASE, "own", **DECIDED, **METRIC,
    ),
)
def outcome_loss(spark, d):
    return rounded(metrics.outcomes(_decided(spark, d), truth_of(spark, d), entities(spark, d)), "loss_share")


@register(
    "missed_links_why",
    with_views(
        """SELECT CASE WHEN c.q IS NULL THEN 'never_candidate' WHEN owner IS NOT NULL THEN 'lost_to_other' ELSE 'not_chosen' END AS reason, count(*) AS n
        FROM (SELECT q, t FROM truth ANTI JOIN decided USING (q, t)) m LEFT JOIN (SELECT DISTINCT q, t FROM scored) c ON m.q = c.q AND m.t = c.t
        LEFT JOIN (SELECT t, min(q) AS owner FROM decided GROUP BY t) o ON m.t = o.t GROUP BY 1""",
        "scored", "truth", "own", **DECIDED,
    ),
)
def missed_links_why(spark, d):
    return metrics.missed_why(_decided(spark, d), truth_of(spark, d), scored(spark, d))


@register(
    "wrong_links",
    with_views(
        "SELECT CASE WHEN o.t IS NULL THEN 'distractor' ELSE 'other_owner' END AS kind, count(*) AS n FROM (SELECT q, t FROM decided ANTI JOIN truth USING (q, t)) w LEFT JOIN (SELECT DISTINCT t FROM truth) o ON w.t = o.t GROUP BY 1",
        "scored", "truth", "own", **DECIDED,
    ),
)
def wrong_links(spark, d):
    return metrics.wrong_links(_decided(spark, d), truth_of(spark, d))


@register("f05_by_truth_count", with_views("SELECT least(n_true, 7) AS n_true, count(*) AS n, round(avg(f05), 6) AS f05 FROM ent GROUP BY 1", *BASE, "own", **DECIDED, **METRIC))
def f05_by_truth_count(spark, d):
    return rounded(metrics.by_truth_count(_decided(spark, d), truth_of(spark, d), entities(spark, d)), "f05")


@register(
    "recall_report",
    with_views(
        """SELECT sum(n)::BIGINT AS n_links, round(sum(h) / sum(n)::DOUBLE, 6) AS pair_recall, round(avg(CASE WHEN n = h THEN 1.0 ELSE 0.0 END), 6) AS entities_all_found,
          (SELECT round(count(*) / count(DISTINCT q)::DOUBLE, 6) FROM scored_b) AS candidates_per_entity
        FROM (SELECT truth.q, count(*) AS n, count(b.q) AS h FROM truth LEFT JOIN scored_b b ON truth.q = b.q AND truth.t = b.t GROUP BY truth.q)""",
        "scored", "scored_b", "truth",
    ),
)
def recall_report(spark, d):
    return rounded(metrics.recall_report(scored_b(spark, d), truth_of(spark, d)), "pair_recall", "entities_all_found", "candidates_per_entity")


@register(
    "candidate_distribution",
    with_views(
        """SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_empty
        FROM (SELECT coalesce(n, 0) AS n FROM entities LEFT JOIN (SELECT q, count(*) AS n FROM scored_b GROUP BY q) USING (q))""",
        "entities", "scored_b",
    ),
)
def candidate_distribution(spark, d):
    return rounded(metrics.candidate_distribution(scored_b(spark, d), entities(spark, d)), "mean", "p99", "share_empty")


# --- context ---------------------------------------------------------------------------------

_RQ, _RS, _RT = (f"row_number() OVER (PARTITION BY {k} ORDER BY p DESC, {o})" for k, o in (("q", "t"), ("q, src", "t"), ("t", "q")))


def _other(key: str, tie: str) -> str:
    w = f"PARTITION BY {key}"
    return f"CASE WHEN p = max(p) OVER ({w}) THEN nth_value(p, 2) OVER ({w} ORDER BY p DESC, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(p) OVER ({w}) END"


@register(
    "context_features",
    with_views(
        f"""SELECT q, t, {_RS} AS rank_in_src, {_RQ} AS rank_in_q, round(p - max(p) OVER (PARTITION BY q, src), 6) AS gap_to_best_src, count(*) OVER (PARTITION BY q) AS n_cand_q,
          count(*) OVER (PARTITION BY t) AS t_indegree, {_RT} AS rank_for_t, round(coalesce(p - ({_other("t", "q")}), 0), 6) AS margin_vs_other FROM scored""",
        "scored",
    ),
)
def context_features(spark, d):
    x = context.context_features(scored(spark, d), "p")
    names = ["rank_in_src", "rank_in_q", "gap_to_best_src", "n_cand_q", "t_indegree", "rank_for_t", "margin_vs_other"]
    return rounded(x.select("q", "t", *names), "gap_to_best_src", "margin_vs_other")


@register("rank_in_src", with_views(f"SELECT q, t, src, {_RS} AS rank_in_src FROM scored", "scored"))
def rank_in_src(spark, d):
    return scored(spark, d).select("q", "t", "src", context.rank(["q", "src"], "p", "t").alias("rank_in_src"))


@register("margin_vs_other", with_views(f"SELECT q, t, round(coalesce(p - ({_other('t', 'q')}), 0), 6) AS margin FROM scored", "scored"))
def margin_vs_other(spark, d):
    return rounded(scored(spark, d).select("q", "t", context.margin(["t"], "p", "q").alias("margin")), "margin")


@register(
    "probability_context",
    with_views(
        f"""SELECT q, t, round(p, 6) AS p, rank_q, rank_src, rank_t, round(bq, 6) AS best_other_q, round(bs, 6) AS best_other_src, round(bt, 6) AS best_other_t, round(sum_q, 6) AS sum_q, n05_q, n_t,
          round(p - bt, 6) AS margin_t, round(p - bq, 6) AS margin_q FROM (SELECT *, {_RQ} AS rank_q, {_RS} AS rank_src, {_RT} AS rank_t, coalesce({_other("q", "t")}, 0) AS bq, coalesce({_other("q, src", "t")}, 0) AS bs,
          coalesce({_other("t", "q")}, 0) AS bt, sum(p) OVER (PARTITION BY q) AS sum_q, sum((p > 0.5)::BIGINT) OVER (PARTITION BY q)::BIGINT AS n05_q, count(*) OVER (PARTITION BY t) AS n_t FROM scored)""",
        "scored",
    ),
)
def probability_context(spark, d):
    x = context.probability_context(scored(spark, d))
    return rounded(x.drop("src", "country"), "p", "best_other_q", "best_other_src", "best_other_t", "sum_q", "margin_t", "margin_q")


@register(
    "score_context",
    with_views(
        f"""SELECT q, t, {_RQ} AS p_rank_q, {_RT} AS p_rank_t, round(coalesce(p - ({_other("q", "t")}), 0), 6) AS p_margin_q, round(coalesce(p - ({_other("t", "q")}), 0), 6) AS p_margin_t,
          round(max(p) OVER (PARTITION BY q), 6) AS p_top_q FROM scored""",
        "scored",
    ),
)
def score_context(spark, d):
    x = context.score_context(scored(spark, d).select("q", "t", "p"))
    return rounded(x.drop("p"), "p_margin_q", "p_margin_t", "p_top_q")


_SIDE = f"""SELECT q, t, round(p, 6) AS p_b, {_RQ} AS b_rank_q, {_RT} AS b_rank_t, round(coalesce(p - ({_other("q", "t")}), 0), 6) AS b_margin_q, round(coalesce(p - ({_other("t", "q")}), 0), 6) AS b_margin_t,
  round(max(p) OVER (PARTITION BY q), 6) AS b_top_q, count(*) OVER (PARTITION BY q) AS b_n_q FROM scored_b"""


@register("side_context", with_views(_SIDE, "scored_b"))
def side_context(spark, d):
    return rounded(context.side_context(scored_b(spark, d), "b"), "p_b", "b_margin_q", "b_margin_t", "b_top_q")


@register(
    "stacker_context",
    with_views(
        f"""SELECT q, t, rank_q, n_q, round(sum_q, 6) AS sum_q, n05_q, round(bq, 6) AS best_other_q, round(p - bq, 6) AS margin_q, rank_src, round(bs, 6) AS best_other_src, rank_t, n_t,
          round(bt, 6) AS best_other_t, round(p - bt, 6) AS margin_t FROM (
          SELECT q, t, p, {_RQ} AS rank_q, count(*) OVER (PARTITION BY q) AS n_q, sum(p) OVER (PARTITION BY q) AS sum_q, sum((p > 0.5)::BIGINT) OVER (PARTITION BY q)::BIGINT AS n05_q,
          coalesce({_other("q", "t")}, 0) AS bq, {_RS} AS rank_src, coalesce({_other("q, src", "t")}, 0) AS bs, {_RT} AS rank_t, count(*) OVER (PARTITION BY t) AS n_t, coalesce({_other("t", "q")}, 0) AS bt
        FROM (SELECT 'S1-' || q AS q, 'S' || src || '-' || t AS t, p, 'S' || src AS src FROM scored))""",
        "scored",
    ),
)
def stacker_context(spark, d):
    ids = scored(spark, d).select(F.concat(F.lit("S1-"), "q").alias("q"), F.concat(F.lit("S"), "src", F.lit("-"), "t").alias("t"), "p")
    return rounded(context.stacker_context(ids).drop("p", "src"), "sum_q", "best_other_q", "margin_q", "best_other_src", "best_other_t", "margin_t")


@register(
    "name_freq",
    """WITH n AS (SELECT p_brand AS country, p_name AS name, count(*) AS f FROM part GROUP BY 1, 2)
    SELECT p_partkey AS q, f AS a_name_freq, coalesce(f - 1, 0) AS others FROM part JOIN n ON p_brand = country AND p_name = name""",
)
def name_freq(spark, d):
    from ..session import table

    names = table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_brand").alias("country"), F.col("p_name").alias("name"))
    return context.name_freq(names, names, "a_name_freq").select("q", "a_name_freq", (F.col("a_name_freq") - 1).alias("others"))


# --- universes and combination ---------------------------------------------------------------

_SHARE = "(({k} * 7919 + {a}) % 1000003) / 1000003.0::DOUBLE"


@register("role_split", with_views("SELECT role, count(*) AS n FROM roles GROUP BY role", "entities", "roles"))
def role_split(spark, d):
    return roles(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@register("learning_pairs", with_views("SELECT q, t FROM truth SEMI JOIN (SELECT q FROM roles WHERE role <> 'EVAL') r USING (q)", *BASE, "roles"))
def learning_pairs(spark, d):
    return universe.learning_links(truth_of(spark, d), roles(spark, d))


_TRAIN = {
    "chosen": f"SELECT q FROM roles WHERE role = 'EVAL' OR {_SHARE.format(k='q', a=104729)} < 0.4",
    "uni": "SELECT targets.t, country FROM targets ANTI JOIN (SELECT t FROM truth ANTI JOIN chosen USING (q)) g ON targets.t = g.t",
}


@register("train_universe", with_views("SELECT 'q' AS side, q AS id FROM chosen UNION ALL SELECT 't', t FROM uni", *BASE, "targets", "roles", **_TRAIN))
def train_universe(spark, d):
    q, t = universe.train_universe(entities(spark, d), targets(spark, d), truth_of(spark, d), roles(spark, d), 0.4)
    return q.select(F.lit("q").alias("side"), F.col("q").alias("id")).unionByName(t.select(F.lit("t").alias("side"), F.col("t").alias("id")))


@register(
    "distractor_copies",
    with_views("SELECT t, country, copy, t + copy * 100000000 AS t_copy FROM targets ANTI JOIN truth USING (t), (SELECT unnest([1, 2])::INT AS copy)", "scored", "truth", "targets"),
)
def distractor_copies(spark, d):
    return universe.distractor_copies(targets(spark, d), truth_of(spark, d), 3, 100_000_000)


@register(
    "train_frames",
    with_views("SELECT t, country FROM uni UNION ALL SELECT t + 100000000 AS t, country FROM uni ANTI JOIN truth USING (t)", *BASE, "targets", "roles", **_TRAIN),
)
def train_frames(spark, d):
    return universe.train_frames(entities(spark, d), targets(spark, d), truth_of(spark, d), roles(spark, d), 0.4, 2, 100_000_000)[1]


@register(
    "copy_candidates",
    with_views(
        """SELECT q, t, src, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY p DESC, t) AS r FROM (
          SELECT q, t, p, src FROM scored UNION ALL SELECT q, t + 100000000, p, src FROM scored ANTI JOIN truth USING (t))) WHERE r <= 20""",
        "scored", "truth",
    ),
)
def copy_candidates(spark, d):
    copies = universe.distractor_copies(targets(spark, d), truth_of(spark, d), 2, 100_000_000)
    got = universe.copy_candidates(scored(spark, d).select("q", "t", "p", "src"), copies, 20, score="p")
    return rounded(got.select("q", "t", "src", "p"), "p")


@register("owner_join", with_views("SELECT s.q, s.t, truth.q AS owner FROM scored s LEFT JOIN truth ON s.t = truth.t", "scored", "truth"))
def owner_join(spark, d):
    return universe.owner_join(scored(spark, d).select("q", "t"), truth_of(spark, d)).select("q", "t", "owner")


@register(
    "dev_sample",
    with_views(
        f"""SELECT 'q' AS side, q AS id FROM dq UNION ALL SELECT 't', t FROM targets SEMI JOIN (SELECT t FROM truth SEMI JOIN dq USING (q)) o USING (t)
        UNION ALL SELECT 't', t FROM targets ANTI JOIN truth USING (t) WHERE {_SHARE.format(k='t', a=209458)} < 0.3""",
        *BASE, "targets", dq=f"SELECT q FROM entities WHERE {_SHARE.format(k='q', a=104729)} < 0.3",
    ),
)
def dev_sample(spark, d):
    q, t, _ = universe.dev_sample(entities(spark, d), targets(spark, d), truth_of(spark, d), 0.3)
    return q.select(F.lit("q").alias("side"), F.col("q").alias("id")).unionByName(t.select(F.lit("t").alias("side"), F.col("t").alias("id")))


@register(
    "union_features",
    with_views(
        "SELECT q, t, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, p_a IS NOT NULL AS in_a, p_b IS NOT NULL AS in_b, round(coalesce((p_a + p_b) / 2, p_a, p_b), 6) AS p_mean, round(p_a - p_b, 6) AS p_diff FROM both_sides",
        "scored", "scored_b", **UNION,
    ),
)
def union_features(spark, d):
    from ..operators.combine import union_features as combined

    got = combined(scored(spark, d).select("q", "t", "p"), scored_b(spark, d))
    return rounded(got.select("q", "t", "p_a", "p_b", "in_a", "in_b", "p_mean", "p_diff"), "p_a", "p_b", "p_mean", "p_diff")


@register("blend", with_views("SELECT a.q, a.t, round((a.p + b.p) / 2, 6) AS p FROM scored a JOIN scored_b b ON a.q = b.q AND a.t = b.t", "scored", "scored_b"))
def blend(spark, d):
    from ..operators.combine import blend as blended

    b = scored_b(spark, d)
    a = scored(spark, d).join(b.select("q", "t"), ["q", "t"], "left_semi").select("q", "t", "p")
    return rounded(blended([a, b], check=False), "p")


@register("id_map", with_views("SELECT p_name AS s1_id, 'S' || src || '-' || t AS cand_id, round(p, 6) AS p FROM scored JOIN part ON q = p_partkey", "scored"))
def id_map(spark, d):
    from ..session import table
    from ..sources.records import to_ids

    names = table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("s1_id"))
    pairs = scored(spark, d)
    named = pairs.select("t", "src").distinct().select(F.col("t").alias("rid"), F.concat(F.lit("S"), "src", F.lit("-"), "t").alias("entity_id"))
    got = to_ids(pairs.select("q", "t", "p"), names.select(F.col("q").alias("rid"), F.col("s1_id").alias("entity_id")), named)
    return rounded(got.select("s1_id", "cand_id", "p"), "p")
