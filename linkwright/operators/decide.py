"""Decision operators: which links to keep, given a score per candidate pair.

Pairs are (q, t, p): entity, target, score in [0, 1]. Every rank has a total
order (p descending, then ids), so results do not depend on row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = tuple(round(0.2 + 0.025 * i, 3) for i in range(31))
FLOORS = (0.05, 0.1, 0.2, 0.3, 0.4)
GATES = tuple(round(0.3 + 0.05 * i, 2) for i in range(14))
#: The floor that gated selection uses; beta squared of the F measure.
GATE_FLOOR, BETA2 = 0.05, 0.25


def exclusive(pairs: DataFrame, p: str = "p", q: str = "q", t: str = "t", tie: str = "all") -> DataFrame:
    """Pairs whose score is the best that their target has. Tied owners all stay, or the smallest q with tie="first"."""
    best = Window.partitionBy(t)
    if tie == "first":
        return pairs.withColumn("_r", F.row_number().over(best.orderBy(F.col(p).desc(), q))).filter("_r = 1").drop("_r")
    return pairs.withColumn("_m", F.max(p).over(best)).filter(F.col(p) == F.col("_m")).drop("_m")


def threshold(pairs: DataFrame, least: float, p: str = "p", **names) -> DataFrame:
    """Exclusive pairs that score at least ``least``."""
    return exclusive(pairs, p, **names).filter(F.col(p) >= least)


def none_true(p: Column, over: Window) -> Column:
    """Product of (1 - p) over a window. Spark's ln(0) is null and would be skipped, so certainty is handled first."""
    return F.when(F.max(p).over(over) >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(p < 1, F.log(1 - p))).over(over)))


def expected_f_keep(pairs: DataFrame, p: str, keys: list[str], t: str) -> DataFrame:
    """The rows that the expected-F rule keeps in each group of ``keys``: the best first k, or none if none is likelier right."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.col(p).desc(), t)
    x = pairs.withColumns(
        {
            "_k": F.row_number().over(order),
            "_run": F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_all": F.sum(p).over(group),
            "_none": none_true(F.col(p), group),
        }
    )
    x = x.withColumn("_ef", (1 + BETA2) * F.col("_run") / (BETA2 * F.col("_all") + F.col("_k")))
    x = x.withColumn("_best", F.max(F.struct(F.col("_ef"), (-F.col("_k")).alias("k"))).over(group))
    kept = x.filter((F.col("_best._ef") > F.col("_none")) & (F.col("_k") <= -F.col("_best.k")))
    return kept.select(*pairs.columns)


def expected_f(pairs: DataFrame, floor: float, p: str = "p", q: str = "q", t: str = "t") -> DataFrame:
    """Exclusive pairs of at least ``floor``, cut at each entity's largest expected F0.5."""
    return expected_f_keep(exclusive(pairs, p, q, t).filter(F.col(p) >= floor), p, [q], t)


def gated(pairs: DataFrame, gate: float, p: str = "p", q: str = "q", t: str = "t", floor: float = GATE_FLOOR) -> DataFrame:
    """Expected-F selection for entities whose best exclusive pair reaches ``gate``; the others get none."""
    own = exclusive(pairs, p, q, t).withColumn("_top", F.max(p).over(Window.partitionBy(q))).filter(F.col("_top") >= gate).drop("_top")
    return expected_f_keep(own.filter(F.col(p) >= floor), p, [q], t)


def decide(pairs: DataFrame, rule: str, value: float, **names) -> DataFrame:
    """threshold, expected or gated."""
    return {"threshold": threshold, "expected": expected_f, "gated": gated}[rule](pairs, value, **names)


def grid(pairs: DataFrame, truth: DataFrame, entities: DataFrame, thresholds=THRESHOLDS, floors=FLOORS, gates=GATES, distractor_weight: float = 1.0, owned: DataFrame | None = None) -> DataFrame:
    """rule, value, f05, n_links of every rule, in one plan; links to targets that ``owned`` (by default the truth) lacks weigh ``distractor_weight``.

    Exclusive assignment happens once over all entities, rivals included; then the
    entities asked for are kept, each pair is labelled once and carries the rules it
    may pass, and per-entity counts come from one partial aggregate.
    """
    own = exclusive(pairs).withColumn("top", F.max("p").over(Window.partitionBy("q")))
    own = own.join(entities.select("q"), "q", "left_semi").join(truth.select("q", "t", F.lit(1).alias("y")), ["q", "t"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    weight = F.lit(1)
    if distractor_weight != 1:
        own = own.join((truth if owned is None else owned).select("t", F.lit(True).alias("owned")).distinct(), "t", "left")
        weight = F.when(F.col("owned"), 1.0).otherwise(float(distractor_weight))
    own = own.withColumn("w", weight)
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(float(v)).alias("value"), keep.alias("keep")) for r, v, keep in [
        *[("threshold", v, F.col("p") >= v) for v in thresholds],
        *[("expected", v, F.col("p") >= v) for v in floors],
        *[("gated", v, (F.col("top") >= v) & (F.col("p") >= GATE_FLOOR)) for v in gates],
    ]]
    each = own.select("q", "t", "p", "y", "w", F.explode(F.filter(F.array(*rules), lambda r: r["keep"])).alias("r")).select("q", "t", "p", "y", "w", "r.rule", "r.value")
    simple = each.filter("rule = 'threshold'")
    kept = simple.unionByName(expected_f_keep(each.filter("rule <> 'threshold'"), "p", ["rule", "value", "q"], "t"))
    per = kept.groupBy("rule", "value", "q").agg(F.sum("w").alias("n_pred"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("tp"))
    # entities without predictions score 1 or 0 by their truth alone, so only sums are needed beyond the kept pairs
    sizes = entities.select("q").join(truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true")), "q", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    scored = per.join(sizes, "q")
    p, r = F.col("tp") / F.col("n_pred"), F.col("tp") / F.col("n_true")
    f = F.when((F.col("n_true") == 0) | (F.col("tp") == 0), 0.0).otherwise((1 + BETA2) * p * r / (BETA2 * p + r))
    sums = scored.groupBy("rule", "value").agg(F.sum(f).alias("f"), F.sum((F.col("n_true") == 0).cast("long")).alias("wrong"), F.sum("n").alias("n_links"))
    base = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_true") == 0).cast("long")).alias("empty"))
    every = [("threshold", float(v)) for v in thresholds] + [("expected", float(v)) for v in floors] + [("gated", float(v)) for v in gates]
    wanted = pairs.sparkSession.createDataFrame(every, "rule string, value double")
    joined = F.broadcast(wanted).join(sums, ["rule", "value"], "left").join(F.broadcast(base))
    return joined.select(
        "rule", "value", ((F.coalesce("f", F.lit(0.0)) + F.col("empty") - F.coalesce("wrong", F.lit(0))) / F.col("n")).alias("f05"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def best_rule(table: DataFrame) -> DataFrame:
    """The grid's best row; ties go to the first rule and the smallest value."""
    return table.orderBy(F.col("f05").desc(), "rule", "value").limit(1)


def prefilter(pairs: DataFrame, least: float, scores: list[str]) -> DataFrame:
    """Pairs that one scorer at least puts at ``least``; missing scores count as 0."""
    best = [F.coalesce(F.col(s), F.lit(0.0)) for s in scores]
    return pairs.filter((F.greatest(*best) if len(best) > 1 else best[0]) >= least)


def shifted(p: Column, by: Column | float, clip: float = 1e-6) -> Column:
    """Sigmoid of the clipped score's logit less ``by``."""
    c = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    by = F.lit(by) if isinstance(by, (int, float)) else by
    return 1 / (1 + F.exp(-(F.log(c / (1 - c)) - by)))


def shift_grid(pairs: DataFrame, country: str, shifts: list[float], least: float) -> DataFrame:
    """shift, empty_share of one country's entities if its scores were shifted, for all shifts in one plan; and of the others.

    Monotone in the shift, so the shift whose share is nearest to the others' replaces a driver-side bisection.
    """
    own = exclusive(pairs)
    best = own.groupBy("q", "country").agg(F.max("p").alias("p"))
    # an entity that owns no target is empty whatever the shift
    best = pairs.select("q", "country").distinct().join(best, ["q", "country"], "left")
    here = F.col("country") == country
    row = best.agg(
        *[F.avg(F.when(here, F.when(F.coalesce(shifted(F.col("p"), s) >= least, F.lit(False)), 0.0).otherwise(1.0))).alias(f"s{i}") for i, s in enumerate(shifts)],
        F.avg(F.when(~here, F.when(F.coalesce(F.col("p") >= least, F.lit(False)), 0.0).otherwise(1.0))).alias("others"),
    )
    listed = F.array(*[F.struct(F.lit(float(s)).alias("shift"), F.col(f"s{i}").alias("empty_share")) for i, s in enumerate(shifts)])
    return row.select(F.explode(listed).alias("x"), "others").select("x.shift", "x.empty_share", F.col("others").alias("others_share"))


def country_shift(pairs: DataFrame, entities: DataFrame, country: str, rule: str, value: float, low: float = -2.0, high: float = 6.0, rounds: int = 14) -> float:
    """The shift of one country's logits at which its share of entities without a link is the others', for any rule.

    Larger shifts leave more of them empty, so it is bisected; each round is one
    plan over the pairs that returns two numbers. pairs: q, t, p; entities: q, country.
    """
    rows = pairs.join(entities, "q")
    here = F.col("country") == country
    for _ in range(rounds):
        middle = (low + high) / 2
        linked = decide(_moved(rows, country, middle), rule, value).select("q").distinct().withColumn("_linked", F.lit(1.0))
        x = entities.join(linked, "q", "left").withColumn("_empty", 1 - F.coalesce("_linked", F.lit(0.0)))
        own, others = x.agg(F.avg(F.when(here, F.col("_empty"))), F.avg(F.when(~here, F.col("_empty")))).first()
        if own is None or others is None:
            raise ValueError(f"{country} and other countries need entities")
        low, high = (middle, high) if own < others else (low, middle)
    return (low + high) / 2


def _moved(rows: DataFrame, country: str, by: float) -> DataFrame:
    return rows.withColumn("p", F.when(F.col("country") == country, shifted(F.col("p"), by)).otherwise(F.col("p")))


def decide_shifted(pairs: DataFrame, entities: DataFrame, country: str, rule: str, value: float, by: float) -> DataFrame:
    """The links that a rule keeps once a country's logits are shifted."""
    return decide(_moved(pairs.join(entities, "q"), country, by), rule, value)


def fp_cost(k: Column) -> Column:
    """Loss of F0.5 by one wrong link beside k right ones; 1 with none."""
    return F.when(k <= 0, F.lit(1.0)).otherwise(1 - (1 + BETA2) * k / (BETA2 * k + k + 1))


def fn_cost(k: Column) -> Column:
    """Loss of F0.5 by missing one of k links; 1 if it is the only one."""
    return F.when(k <= 1, F.lit(1.0)).otherwise(1 - (1 + BETA2) * (k - 1) / (BETA2 * k + k - 1))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
