"""Learned scorers over the scored-pair view. Their scores have no SQL; the relations around them do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, models, universe
from ..operators.combine import union_features
from ..session import materialise
from ..sources.views import roles, scored, scored_b, truth_of, with_views

QUERIES: dict[str, tuple[Callable, str | None]] = {}
FEATURES = ["s", "rank_in_q", "rank_in_src", "gap_to_best_src", "n_cand_q", "t_indegree", "rank_for_t", "margin_vs_other"]
LEARNER = models.Learner(rounds=8, depth=4)
KEEPS = (0.98, 0.99, 0.995, 0.997, 0.999)


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def rows(spark, d) -> DataFrame:
    """q, t, src, country, y, role and features of every scored pair."""
    x = context.context_features(scored(spark, d), "p").withColumnRenamed("p", "s")
    x = universe.labels(x, truth_of(spark, d)).join(roles(spark, d), "q")
    return materialise(x, "rows")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("cross_fit_stage1")
def cross_fit_stage1(spark, d):
    x = rows(spark, d)
    return rounded(models.cross_fit(x, FEATURES, LEARNER).transform(x).select("q", "t", "y", "p1"), "p1")


@register("stage2_stack")
def stage2_stack(spark, d):
    return rounded(models.two_stages(rows(spark, d), FEATURES, LEARNER, 2).select("q", "t", "y", "p1", "p2"), "p1", "p2")


@register("candidate_filter")
def candidate_filter(spark, d):
    kept, _ = models.candidate_filter(rows(spark, d), ["s", "rank_in_q", "rank_in_src", "gap_to_best_src"], 0.99, LEARNER, 2)
    return rounded(kept.select("q", "t", "p_block"), "p_block")


@register(
    "filter_curve",
    with_views(
        """SELECT keep::DOUBLE AS keep, round(cut, 6) AS threshold, round(sum(CASE WHEN p >= cut THEN y ELSE 0 END) / sum(y)::DOUBLE, 6) AS recall, round(sum((p >= cut)::INT) / count(DISTINCT q)::DOUBLE, 6) AS per_entity
        FROM marked, ("""
        + " UNION ALL ".join(f"SELECT {k}::DOUBLE AS keep, quantile_cont(p, 1 - {k}::DOUBLE) AS cut FROM marked WHERE y = 1" for k in KEEPS)
        + """) GROUP BY keep, cut""",
        "scored", "truth",
        marked="SELECT s.q, s.t, p, (tr.q IS NOT NULL)::INT AS y FROM scored s LEFT JOIN truth tr ON s.q = tr.q AND s.t = tr.t",
    ),
)
def filter_curve(spark, d):
    x = rows(spark, d).withColumn("p_block", F.col("s"))
    return rounded(models.filter_curve(x, list(KEEPS)), "threshold", "recall", "per_entity")


@register("covshift_weights")
def covshift_weights(spark, d):
    x = rows(spark, d).withColumn("domain", (F.col("src") == 3).cast("int"))
    return rounded(models.shift_weights(x, ["s", "n_cand_q", "t_indegree"]).select("q", "t", "w"), "w")


@register(
    "distractor_weights",
    with_views("SELECT s.q, s.t, CASE WHEN o.t IS NULL THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM scored s LEFT JOIN (SELECT DISTINCT t FROM truth) o ON s.t = o.t", "scored", "truth"),
)
def distractor_weights(spark, d):
    return models.distractor_weights(scored(spark, d).select("q", "t"), truth_of(spark, d), 2.0).select("q", "t", "w")


@register(
    "pseudo_labels",
    with_views("SELECT q, t, CASE WHEN p >= 0.8 AND p = m THEN 1 ELSE 0 END AS y FROM (SELECT *, max(p) OVER (PARTITION BY t) AS m FROM scored) WHERE (p >= 0.8 AND p = m) OR p <= 0.1", "scored"),
)
def pseudo_labels(spark, d):
    return models.pseudo_labels(scored(spark, d), 0.8, 0.1, "p").select("q", "t", "y")


@register("self_train")
def self_train(spark, d):
    x = rows(spark, d)
    got = models.self_train(x.filter("role = 'FIT'"), x.filter("role <> 'FIT'"), FEATURES, 0.9, 0.02, LEARNER)
    return rounded(got.select("q", "t", "y", "p2"), "p2")


@register("leave_country_out")
def leave_country_out(spark, d):
    x = rows(spark, d).withColumn("side", F.when(F.col("src") == 2, "a").otherwise("b"))
    return rounded(models.leave_one_out(x, FEATURES, "side", ["a", "b"], LEARNER).select("q", "t", "side", "p"), "p")


@register("frozen_scores")
def frozen_scores(spark, d):
    from ..session import new_path

    x = rows(spark, d)
    path = new_path(spark, "model")
    models.save(LEARNER.fit(x.filter("role = 'FIT'"), FEATURES), path)
    return rounded(models.frozen(path, x, FEATURES).select("q", "t", "p"), "p")


@register("feature_importance")
def feature_importance(spark, d):
    x = rows(spark, d).filter("role = 'FIT'")
    return spark.createDataFrame(models.importance(LEARNER.fit(x, FEATURES), FEATURES), "feature string, share double")


@register(
    "monotone_signs",
    with_views(
        """SELECT 's' AS feature, round(c, 6) + 0.0::DOUBLE AS corr, CASE WHEN abs(c) >= 0.1 THEN sign(c) ELSE 0 END::INT AS sign FROM (SELECT corr(p, y) AS c FROM l)
        UNION ALL SELECT 'n', round(c, 6) + 0.0::DOUBLE, CASE WHEN abs(c) >= 0.1 THEN sign(c) ELSE 0 END::INT FROM (SELECT corr(n, y) AS c FROM l)""",
        "scored", "truth", l="SELECT s.*, CASE WHEN truth.q IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS y, (count(*) OVER (PARTITION BY s.q))::DOUBLE AS n FROM scored s LEFT JOIN truth ON s.q = truth.q AND s.t = truth.t",
    ),
)
def monotone_signs(spark, d):
    x = rows(spark, d).select(F.col("s"), F.col("n_cand_q").alias("n"), "y")
    return rounded(models.monotone_signs(x, ["s", "n"]), "corr")


@register("adversarial_auc")
def adversarial_auc(spark, d):
    x = rows(spark, d)
    return rounded(models.adversarial(x.filter("src = 2"), x.filter("src = 3"), ["s", "n_cand_q", "t_indegree"], "country"), "auc")


@register("combine_model")
def combine_model(spark, d):
    x = union_features(scored(spark, d).select("q", "t", "p"), scored_b(spark, d))
    x = universe.labels(x, truth_of(spark, d)).join(roles(spark, d), "q")
    names = ["p_a", "p_b", "p_mean", "p_diff", "a_rank_q", "a_rank_t", "a_margin_q", "a_margin_t", "b_rank_q", "b_rank_t", "b_margin_q", "b_margin_t"]
    x = materialise(x.withColumns({n: F.col(n).cast("double") for n in names}), "union")
    return rounded(models.cross_fit(x, names, LEARNER, 3).transform(x, "p_comb").select("q", "t", "y", "p_comb"), "p_comb")


@register(
    "entity_weights_rows",
    with_views(
        """SELECT q, t, y, round(CASE WHEN y = 1 THEN CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE 1 - 1.25::DOUBLE * (k - 1) / (0.25::DOUBLE * k + k - 1) END
            ELSE CASE WHEN k <= 0 THEN 1.0::DOUBLE ELSE 1 - 1.25::DOUBLE * k / (0.25::DOUBLE * k + k + 1) END END, 6) AS w
        FROM (SELECT s.q, s.t, (tr.q IS NOT NULL)::INT AS y, coalesce(k, 0) AS k FROM scored s LEFT JOIN truth tr ON s.q = tr.q AND s.t = tr.t LEFT JOIN (SELECT q, count(*) AS k FROM truth GROUP BY q) n ON s.q = n.q)""",
        "scored", "truth",
    ),
)
def entity_weights_rows(spark, d):
    x = universe.labels(scored(spark, d).select("q", "t"), truth_of(spark, d))
    return rounded(models.entity_weights(x, truth_of(spark, d)).select("q", "t", "y", "w"), "w")


@register("model_ablation")
def model_ablation(spark, d):
    from ..operators.metrics import auc

    x = rows(spark, d)
    value = lambda s: float(auc(s).first()["auc"])
    got = models.ablation(x, FEATURES, {"ranks": ["rank_in_q", "rank_in_src", "rank_for_t"], "margins": ["gap_to_best_src", "margin_vs_other"]}, value, models.Learner("logistic"))
    return spark.createDataFrame([(n, round(v, 6)) for n, v in got], "left_out string, auc double")


@register("text_scorer")
def text_scorer(spark, d):
    """Export of pair texts and cross-fitted routing to two pluggable scorers (here: word overlap)."""
    from ..session import table

    q = table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("name"), F.col("p_brand").alias("addr"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("addr"))
    pairs = models.export_pairs(scored(spark, d).select("q", "t"), q, t)

    def overlap(a, b):
        return [len(set(x.split()) & set(y.split())) / max(1, len(set(x.split()) | set(y.split()))) for x, y in zip(a, b)]

    return rounded(models.score_text(pairs, {0: overlap, 1: overlap}), "p")


