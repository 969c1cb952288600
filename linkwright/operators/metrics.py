"""Evaluation operators over links, candidates and scores."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decide import BETA2


def links_per(links: DataFrame, name: str) -> DataFrame:
    return links.groupBy("q").agg(F.count(F.lit(1)).alias(name))


def entity_scores(pred: DataFrame, truth: DataFrame, entities: DataFrame, distractor_weight: float = 1.0, owned: DataFrame | None = None) -> DataFrame:
    """q, n_true, n_pred, tp, precision, recall, f05 of every entity; links to targets that ``owned`` (by default the truth) lacks weigh ``distractor_weight``."""
    labelled = pred.select("q", "t").join(truth.select("q", "t", F.lit(1).alias("y")), ["q", "t"], "left")
    if distractor_weight != 1:
        linked = (truth if owned is None else owned).select("t").distinct().withColumn("owned", F.lit(True))
        labelled = labelled.join(linked, "t", "left").withColumn("w", F.when(F.col("owned"), 1.0).otherwise(float(distractor_weight)))
    else:
        labelled = labelled.withColumn("w", F.lit(1.0))
    per = labelled.groupBy("q").agg(F.sum("w").alias("n_pred"), F.sum(F.coalesce("y", F.lit(0))).alias("tp"))
    x = entities.select("q").join(links_per(truth, "n_true"), "q", "left").join(per, "q", "left")
    x = x.select("q", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.coalesce("n_pred", F.lit(0.0)).alias("n_pred"), F.coalesce("tp", F.lit(0)).alias("tp"))
    p, r = F.try_divide("tp", "n_pred"), F.try_divide("tp", "n_true")
    f = F.when(F.col("n_true") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).when(F.col("tp") == 0, 0.0).otherwise((1 + BETA2) * p * r / (BETA2 * p + r))
    return x.withColumns({"precision": p, "recall": r, "f05": f})


def macro_f05(pred: DataFrame, truth: DataFrame, entities: DataFrame, distractor_weight: float = 1.0, owned: DataFrame | None = None) -> DataFrame:
    """f05, precision (of entities with links), recall (of entities with truth), f05 of singletons and others, n."""
    x = entity_scores(pred, truth, entities, distractor_weight, owned)
    return x.agg(
        F.avg("f05").alias("f05"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg(F.when(F.col("n_true") == 0, F.col("f05"))).alias("f05_single"),
        F.avg(F.when(F.col("n_true") > 0, F.col("f05"))).alias("f05_linked"),
        F.count(F.lit(1)).alias("n"),
    )


def macro_f05_closed(pred: DataFrame, truth: DataFrame, entities: DataFrame, distractor_weight: float) -> DataFrame:
    """The same mean in closed form: 1.25 tp / (0.25 n_true + n_pred)."""
    x = entity_scores(pred, truth, entities, distractor_weight)
    f = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).otherwise(F.coalesce(F.try_divide((1 + BETA2) * F.col("tp"), BETA2 * F.col("n_true") + F.col("n_pred")), F.lit(0.0)))
    return x.agg(F.avg(f).alias("f05"), F.count(F.lit(1)).alias("n"))


def recall_report(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """n_links, pair_recall, entities_all_found, candidates_per_entity (of entities that have some)."""
    found = truth.select("q", "t").join(candidates.select("q", "t").distinct().withColumn("hit", F.lit(1)), ["q", "t"], "left")
    per = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("h"))
    a = per.agg(
        F.sum("n").alias("n_links"),
        F.try_divide(F.sum("h"), F.sum("n")).alias("pair_recall"),
        F.avg((F.col("n") == F.col("h")).cast("double")).alias("entities_all_found"),
    )
    b = candidates.agg(F.try_divide(F.count(F.lit(1)), F.count_distinct("q")).alias("candidates_per_entity"))
    return a.join(F.broadcast(b))


def at_depths(candidates: DataFrame, truth: DataFrame, depths: list[int], score: str = "bscore", second: str = "noaddr") -> DataFrame:
    """k, recall, recall_second, candidates_per_entity when one pass is cut at k per (q, src); the other pass counts whole.

    One ranking, one join, one aggregate for all depths.
    """
    w = Window.partitionBy("q", "src", second).orderBy(F.col(score).desc(), "t")
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    n_q = F.count_distinct("q")
    hit = truth.select("q", "t", F.lit(1).alias("y")).join(ranked, ["q", "t"], "left")
    second_ = F.coalesce(F.col(second), F.lit(False))
    found = [F.avg(F.when((F.col("rank") <= k) & ~second_ | second_, 1.0).otherwise(0.0)).alias(f"r{k}") for k in depths]
    found2 = [F.avg(F.when((F.col("rank") <= k) & second_ | (F.col("rank").isNotNull() & ~second_), 1.0).otherwise(0.0)).alias(f"n{k}") for k in depths]
    cost = [F.sum(F.when((F.col("rank") <= k) & ~F.col(second) | F.col(second), 1).otherwise(0)).alias(f"c{k}") for k in depths]
    a, b = hit.agg(*found, *found2), ranked.agg(*cost, n_q.alias("nq"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall"), F.col(f"n{k}").alias("recall_second"), F.try_divide(f"c{k}", "nq").alias("candidates_per_entity")) for k in depths])
    return a.join(F.broadcast(b)).select(F.explode(rows).alias("x")).select("x.*")


def candidate_distribution(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """mean, p50, p90, p99, max of candidates per entity, zeros included, and the share without."""
    x = entities.select("q").join(links_per(candidates, "n"), "q", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.agg(
        F.avg("n").alias("mean"),
        *[F.percentile("n", F.lit(v)).alias(n) for n, v in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))],
        F.max("n").alias("max"),
        F.avg((F.col("n") == 0).cast("double")).alias("share_empty"),
    )


def universe_report(entities: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """country, n_q, n_t, t_per_q, distractors_per_q."""
    owned = truth.select("t").distinct().withColumn("owned", F.lit(1))
    t = targets.select("t", "country").join(owned, "t", "left").groupBy("country").agg(F.count(F.lit(1)).alias("n_t"), F.sum(F.when(F.col("owned").isNull(), 1).otherwise(0)).alias("free"))
    q = entities.groupBy("country").agg(F.count(F.lit(1)).alias("n_q"))
    return q.join(t, "country", "left").select(
        "country", "n_q", F.coalesce("n_t", F.lit(0)).alias("n_t"), (F.coalesce("n_t", F.lit(0)) / F.col("n_q")).alias("t_per_q"), (F.coalesce("free", F.lit(0)) / F.col("n_q")).alias("distractors_per_q")
    )


def profile(pred: DataFrame, entities: DataFrame) -> DataFrame:
    """country, n_q, share_linked, links_per_q."""
    x = entities.select("q", "country").join(links_per(pred, "n"), "q", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.groupBy("country").agg(F.count(F.lit(1)).alias("n_q"), F.avg((F.col("n") > 0).cast("double")).alias("share_linked"), F.avg("n").alias("links_per_q"))


def outcomes(pred: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """outcome, n, loss_share: what kind of error entities suffer, and what share of the lost F0.5 it explains."""
    x = entity_scores(pred, truth, entities)
    what = (
        F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), "right_empty")
        .when(F.col("n_true") == 0, "false_on_single")
        .when(F.col("n_pred") == 0, "nothing_found")
        .when((F.col("tp") == F.col("n_true")) & (F.col("tp") == F.col("n_pred")), "perfect")
        .when(F.col("tp") == F.col("n_pred"), "missed_only")
        .when(F.col("tp") == F.col("n_true"), "extra_only")
        .otherwise("both")
    )
    g = x.withColumn("outcome", what).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("f05")).alias("loss"))
    return g.select("outcome", "n", F.coalesce(F.try_divide("loss", F.sum("loss").over(Window.partitionBy())), F.lit(0.0)).alias("loss_share"))


def missed_why(pred: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """reason, n: never a candidate, lost to another entity, or not chosen."""
    missed = truth.select("q", "t").join(pred.select("q", "t"), ["q", "t"], "left_anti")
    seen = candidates.select("q", "t").distinct().withColumn("seen", F.lit(1))
    taken = pred.groupBy("t").agg(F.min("q").alias("owner"))
    x = missed.join(seen, ["q", "t"], "left").join(taken, "t", "left")
    reason = F.when(F.col("seen").isNull(), "never_candidate").when(F.col("owner").isNotNull(), "lost_to_other").otherwise("not_chosen")
    return x.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def wrong_links(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """kind, n: links to targets nobody owns, or that another entity owns."""
    wrong = pred.select("q", "t").join(truth.select("q", "t"), ["q", "t"], "left_anti")
    owner = truth.groupBy("t").agg(F.min("q").alias("owner"))
    return wrong.join(owner, "t", "left").groupBy(F.when(F.col("owner").isNull(), "distractor").otherwise("other_owner").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def by_truth_count(pred: DataFrame, truth: DataFrame, entities: DataFrame, most: int = 7) -> DataFrame:
    """n_true (clipped), n, f05."""
    x = entity_scores(pred, truth, entities)
    return x.groupBy(F.least("n_true", F.lit(most)).alias("n_true")).agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("f05"))


def average_rank(column: str, by: list[str] | None = None) -> Column:
    """Mean rank of ties: rank plus half of the ties beyond the first."""
    by = by or []
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """by, spearman: rank correlation within each group; ordinal ranks in the order (value, a, b)."""
    w = Window.partitionBy(by)
    x = df.withColumns({"ra": F.row_number().over(w.orderBy(a, b)), "rb": F.row_number().over(w.orderBy(b, a))})
    return x.groupBy(by).agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def auc(scored: DataFrame, p: str = "p", y: str = "y", by: str | None = None) -> DataFrame:
    """Area under the ROC curve from rank sums; ties count half.

    Ranks come from the histogram of distinct scores: counts combine on the map
    side, and only distinct scores are ordered.
    """
    keys = [by] if by else []
    h = scored.groupBy(*keys, p).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumn("mean_rank", before + (F.col("n") + 1) / 2)
    s = h.groupBy(*keys).agg(F.sum(F.col("mean_rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p1"), F.sum(F.col("n") - F.col("pos")).alias("p0"))
    value = F.try_divide(F.col("r") - F.col("p1") * (F.col("p1") + 1) / 2, (F.col("p1") * F.col("p0")).cast("double"))
    return s.select(*keys, value.alias("auc"), F.col("p1").alias("n_pos"), F.col("p0").alias("n_neg"))


def log_loss(scored: DataFrame, p: str = "p", y: str = "y", clip: float = 1e-6) -> DataFrame:
    """log_loss, accuracy, n."""
    c = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return scored.agg(
        F.avg(-(F.col(y) * F.log(c) + (1 - F.col(y)) * F.log(1 - c))).alias("log_loss"),
        F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def record_stats(q: DataFrame, t: DataFrame) -> DataFrame:
    """Per country: entities, targets and their ratio, shares of entities that share a core name and of targets that have one's, and of targets by kind.

    Both sides normalised. Counts of names are aggregated before they are joined.
    """
    names = q.groupBy("country", "name_core").agg(F.count(F.lit(1)).alias("n"))
    share = lambda c: F.avg(c.cast("double"))
    one = names.groupBy("country").agg(F.sum("n").alias("entities"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"))
    one = one.select("country", "entities", (F.col("shared") / F.col("entities")).alias("name_shared"))
    x = t.join(names.select("country", "name_core", F.lit(True).alias("_known")), ["country", "name_core"], "left")
    two = x.groupBy("country").agg(
        F.count(F.lit(1)).alias("targets"),
        share(F.col("_known").isNotNull()).alias("name_known"),
        share(~F.col("has_addr")).alias("no_addr"),
        *[share(F.col(c)).alias(c) for c in ("non_ascii", "is_web", "has_alias")],
        share(F.coalesce(F.size("nums"), F.lit(0)) <= 0).alias("no_number"),
    )
    return one.join(two, "country", "left").withColumn("targets", F.coalesce("targets", F.lit(0))).withColumn("per_entity", F.col("targets") / F.col("entities"))


def score_profile(pairs: DataFrame, links: DataFrame, entities: DataFrame, targets: DataFrame) -> DataFrame:
    """Per country: how scores are spread, to compare one split with another.

    pairs: q, t, p; links: the chosen q, t; entities: q, country; targets: t,
    country. Of entities: share linked, links each, shares whose best exclusive score
    is low, in between, high; of links: share under 0.8 and mean score; of targets:
    shares whose best score is near nothing and over a half.
    """
    from .decide import exclusive

    own = exclusive(pairs.select("q", "t", "p"))
    share = lambda c: F.avg(c.cast("double"))
    top = own.groupBy("q").agg(F.max("p").alias("top"))
    n = links.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    per = entities.join(top, "q", "left").join(n, "q", "left").withColumns({"top": F.coalesce("top", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})
    of_entities = per.groupBy("country").agg(
        F.count(F.lit(1)).alias("entities"), share(F.col("n") > 0).alias("linked"), F.avg("n").alias("links_each"), share(F.col("top") < 0.2).alias("top_low"),
        share(F.col("top").between(0.2, 0.8)).alias("top_between"), share(F.col("top") > 0.95).alias("top_high"),
    )
    of_links = links.select("q", "t").join(own, ["q", "t"]).join(entities, "q").groupBy("country").agg(share(F.col("p") < 0.8).alias("link_unsure"), F.avg("p").alias("link_mean"))
    most = targets.join(pairs.groupBy("t").agg(F.max("p").alias("most")), "t", "left").withColumn("most", F.coalesce("most", F.lit(0.0)))
    of_targets = most.groupBy("country").agg(share(F.col("most") < 0.05).alias("target_none"), share(F.col("most") > 0.5).alias("target_likely"))
    return of_entities.join(of_links, "country", "left").join(of_targets, "country", "left")


def twin_summary(twins: DataFrame, by: str, levels: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """by, n, same_name (mean number of entities of the same name) and the share of targets whose best twin reaches each level."""
    at = lambda x: F.avg((F.coalesce("best_jaccard", F.lit(0.0)) >= x).cast("double")).alias(f"twin_{round(100 * x)}")
    return twins.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("n_twins").alias("same_name"), *[at(x) for x in levels])


def write_metrics(rows: dict[str, DataFrame], path: str) -> None:
    """Metric frames as lines of JSON, {"metric": name, "row": {...}}, written by Spark to any of its file systems; nothing is collected."""
    from .decide import union_all

    each = [v.select(F.lit(k).alias("metric"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in v.columns])).alias("row")) for k, v in rows.items()]
    line = F.concat(F.lit('{"metric": "'), "metric", F.lit('", "row": '), "row", F.lit("}"))
    union_all(each).select(line.alias("value")).write.mode("overwrite").text(path)
