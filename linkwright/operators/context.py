"""Competition features: what a pair's rivals look like, from the entity's and from the target's side.

Specs on the same key share one shuffle: everything by q and (q, src) first, then
everything by t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(by: list[str], score: str, tie: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), tie))


def best_other(by: list[str], score: str, tie: str) -> Column:
    """Best score of another row of the group: the second best for a row that has the best (ties: the same score), else the best."""
    w = Window.partitionBy(*by)
    ordered = w.orderBy(F.col(score).desc(), tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.when(F.col(score) == F.max(score).over(w), F.nth_value(score, 2).over(ordered)).otherwise(F.max(score).over(w))


def margin(by: list[str], score: str, tie: str) -> Column:
    """Score less the best other of the group; 0 without another."""
    return F.coalesce(F.col(score) - best_other(by, score, tie), F.lit(0.0))


def name_freq(records: DataFrame, names: DataFrame, out: str, country: str = "country", name: str = "name") -> DataFrame:
    """Adds how many of ``names`` (country, name) share a record's; 0 for none."""
    n = names.groupBy(country, name).agg(F.count(F.lit(1)).alias(out))
    return records.join(n, [country, name], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def context_features(candidates: DataFrame, score: str = "bscore") -> DataFrame:
    """rank_in_src, rank_in_q, gap_to_best_src, n_cand_q, t_indegree, rank_for_t, margin_vs_other."""
    q, qs, t = Window.partitionBy("q"), Window.partitionBy("q", "src"), Window.partitionBy("t")
    return candidates.withColumns(
        {
            "rank_in_q": rank(["q"], score, "t"),
            "n_cand_q": F.count(F.lit(1)).over(q),
            "rank_in_src": rank(["q", "src"], score, "t"),
            "gap_to_best_src": F.col(score) - F.max(score).over(qs),
        }
    ).withColumns({"t_indegree": F.count(F.lit(1)).over(t), "rank_for_t": rank(["t"], score, "q"), "margin_vs_other": margin(["t"], score, "q")})


def probability_context(pairs: DataFrame, p: str = "p") -> DataFrame:
    """The twelve columns of a first-stage probability and its rivals."""
    q, t = Window.partitionBy("q"), Window.partitionBy("t")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = pairs.withColumns(
        {
            "rank_q": rank(["q"], p, "t"),
            "sum_q": F.sum(p).over(q),
            "n05_q": F.sum((F.col(p) > 0.5).cast("long")).over(q),
            "best_other_q": zero(best_other(["q"], p, "t")),
            "rank_src": rank(["q", "src"], p, "t"),
            "best_other_src": zero(best_other(["q", "src"], p, "t")),
        }
    )
    x = x.withColumns({"rank_t": rank(["t"], p, "q"), "n_t": F.count(F.lit(1)).over(t), "best_other_t": zero(best_other(["t"], p, "q"))})
    return x.withColumns({"margin_q": F.col(p) - F.col("best_other_q"), "margin_t": F.col(p) - F.col("best_other_t")})


def score_context(pairs: DataFrame, p: str = "p") -> DataFrame:
    """rank_q, rank_t, margin_q, margin_t, top_q of a named score."""
    x = pairs.withColumns({f"{p}_rank_q": rank(["q"], p, "t"), f"{p}_margin_q": margin(["q"], p, "t"), f"{p}_top_q": F.max(p).over(Window.partitionBy("q"))})
    return x.withColumns({f"{p}_rank_t": rank(["t"], p, "q"), f"{p}_margin_t": margin(["t"], p, "q")})


def side_context(pairs: DataFrame, side: str, p: str = "p") -> DataFrame:
    """One scorer's q, t, p and context, named by the side, for a union with another's."""
    x = score_context(pairs.select("q", "t", F.col(p).alias(f"p_{side}")), f"p_{side}")
    x = x.withColumn(f"{side}_n_q", F.count(F.lit(1)).over(Window.partitionBy("q")))
    renamed = {f"p_{side}_{c}": f"{side}_{c}" for c in ("rank_q", "rank_t", "margin_q", "margin_t", "top_q")}
    return x.withColumnsRenamed(renamed)


def stacker_context(pairs: DataFrame, with_targets: bool = True) -> DataFrame:
    """Context for a stand-alone second stage on string ids: source from the candidate's prefix; the best others are 0 without one."""
    x = pairs.withColumn("src", F.substring("t", 1, 2))
    q = Window.partitionBy("q")
    other = lambda by, tie: F.coalesce(best_other(by, "p", tie), F.lit(0.0))
    x = x.withColumns(
        {
            "rank_q": rank(["q"], "p", "t"),
            "n_q": F.count(F.lit(1)).over(q),
            "sum_q": F.sum("p").over(q),
            "n05_q": F.sum((F.col("p") > 0.5).cast("long")).over(q),
            "best_other_q": other(["q"], "t"),
            "rank_src": rank(["q", "src"], "p", "t"),
            "best_other_src": other(["q", "src"], "t"),
        }
    ).withColumn("margin_q", F.col("p") - F.col("best_other_q"))
    if with_targets:
        x = x.withColumns({"rank_t": rank(["t"], "p", "q"), "n_t": F.count(F.lit(1)).over(Window.partitionBy("t")), "best_other_t": other(["t"], "q")})
        x = x.withColumn("margin_t", F.col("p") - F.col("best_other_t"))
    return x
