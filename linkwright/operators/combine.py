"""Combining scorers: one table from two candidate sets, blends of runs on the same pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context import side_context


def union_features(a: DataFrame, b: DataFrame, extra: dict[str, DataFrame] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Full outer join of two scorers' contexts on (q, t), with in_a, in_b, p_mean, p_diff and further scores.

    Contexts see each side's whole pair set; ``ids`` (q) restricts afterwards.
    """
    x, y = side_context(a, "a"), side_context(b, "b")
    if ids is not None:
        x, y = x.join(ids, "q", "left_semi"), y.join(ids, "q", "left_semi")
    got = x.join(y, ["q", "t"], "full")
    for name, scores in (extra or {}).items():
        got = got.join(scores.select("q", "t", F.col("p").alias(name)), ["q", "t"], "left")
    return got.withColumns(
        {
            "in_a": F.col("p_a").isNotNull(),
            "in_b": F.col("p_b").isNotNull(),
            "p_mean": F.coalesce((F.col("p_a") + F.col("p_b")) / 2, F.col("p_a"), F.col("p_b")),
            "p_diff": F.col("p_a") - F.col("p_b"),
        }
    )


def blend(runs: list[DataFrame], check: bool = True) -> DataFrame:
    """Mean score of runs over identical pairs; ``check`` raises where their pairs differ."""
    named = [r.select("q", "t", F.col("p").alias(f"p{i}")) for i, r in enumerate(runs)]
    joined = reduce(lambda a, b: a.join(b, ["q", "t"], "full" if check else "inner"), named)
    if check:
        missing = reduce(lambda a, b: a | b, [F.col(f"p{i}").isNull() for i in range(len(runs))])
        if not joined.filter(missing).isEmpty():
            raise ValueError("the runs score different pairs")
    return joined.select("q", "t", (sum(F.col(f"p{i}") for i in range(len(runs))) / len(runs)).alias("p"))


def extra_scores(pairs: DataFrame, scores: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pairs with external scores joined by key, counts of pairs each scorer misses)."""
    got = pairs
    for name, s in scores.items():
        got = got.join(s.select("q", "t", F.col("p").alias(name)), ["q", "t"], "left")
    missing = got.agg(*[F.sum(F.col(n).isNull().cast("long")).alias(n) for n in scores])
    return got, missing
