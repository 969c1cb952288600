"""Pair scorers: learners behind one interface, cross-fitting, stacking and the procedures around them.

Learners are pyspark.ml pipelines, so fitting and scoring are distributed; folds
are hashes of the entity, so all pairs of an entity share one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .context import probability_context
from .universe import hash_share


class PairClassifier(Protocol):
    def fit(self, rows: DataFrame, features: list[str], weight: str | None = None) -> PipelineModel: ...


@dataclass
class Learner:
    """algo: gbt, deep (boosted trees of depth 8), forest, logistic or mlp. Missing features are -1, as in the features themselves."""

    algo: str = "gbt"
    rounds: int = 20
    depth: int = 5
    rate: float = 0.1
    seed: int = 42
    early_stop: bool = False
    layers: tuple[int, ...] = (16,)
    extra: dict = field(default_factory=dict)

    def fit(self, rows: DataFrame, features: list[str], weight: str | None = None) -> PipelineModel:
        rows = rows.na.fill(-1.0, features)
        stages: list = [VectorAssembler(inputCols=features, outputCol="_raw" if self.algo in ("logistic", "mlp") else "_x")]
        if self.algo in ("logistic", "mlp"):
            stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True))
        common = {"featuresCol": "_x", "labelCol": "y", "predictionCol": "_pred", **self.extra}
        if weight and self.algo != "mlp":
            common["weightCol"] = weight
        if self.algo in ("gbt", "deep"):
            stop = {"validationIndicatorCol": "is_es"} if self.early_stop and "is_es" in rows.columns else {}
            est = GBTClassifier(maxIter=self.rounds, maxDepth=8 if self.algo == "deep" else self.depth, stepSize=self.rate, seed=self.seed, subsamplingRate=0.8, **stop, **common)
        elif self.algo == "forest":
            est = RandomForestClassifier(numTrees=self.rounds, maxDepth=self.depth, seed=self.seed, **common)
        elif self.algo == "logistic":
            est = LogisticRegression(maxIter=50, regParam=1e-4, **common)
        else:
            est = MultilayerPerceptronClassifier(layers=[len(features), *self.layers, 2], maxIter=50, seed=self.seed, **common)
        est = est.setProbabilityCol("_prob").setRawPredictionCol("_raw_p")
        return Pipeline(stages=[*stages, est]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    """The rows with the probability of label 1."""
    got = model.transform(rows.na.fill(-1.0, features))
    return got.withColumn(out, vector_to_array("_prob")[1]).drop("_raw", "_x", "_prob", "_raw_p", "_pred")


def fold_of(q: Column, folds: int, seed: int = 5) -> Column:
    return F.floor(hash_share(q, seed) * folds).cast("int")


@dataclass
class CrossFit:
    """Models by fold; rows of fit entities are scored by the model that has not seen them, all others by the mean."""

    models: list[PipelineModel]
    features: list[str]
    folds: int

    def transform(self, rows: DataFrame, out: str = "p1", fit_role: str = "FIT") -> DataFrame:
        x = rows.withColumn("_fold", F.when(F.col("role") == fit_role, fold_of(F.col("q"), self.folds)))
        for i, m in enumerate(self.models):
            x = score(m, x, self.features, f"_p{i}")
        own = F.coalesce(*[F.when(F.col("_fold") == i, F.col(f"_p{i}")) for i in range(self.folds)])
        mean = sum(F.col(f"_p{i}") for i in range(self.folds)) / self.folds
        return x.withColumn(out, F.coalesce(own, mean)).drop("_fold", *[f"_p{i}" for i in range(self.folds)])


def cross_fit(rows: DataFrame, features: list[str], learner: PairClassifier | None = None, folds: int = 3, weight: str | None = None, fit_role: str = "FIT") -> CrossFit:
    """rows: q, y, role and features; fold f's model learns from the fit rows of the other folds, early-stopped on role ES if the learner asks."""
    learner = learner or Learner()
    x = rows.filter(F.col("role").isin(fit_role, "ES")).withColumn("is_es", F.col("role") == "ES").withColumn("_fold", fold_of(F.col("q"), folds))
    x = materialise(x, "fit-rows")
    return CrossFit([learner.fit(x.filter((F.col("_fold") != f) | F.col("is_es")), features, weight) for f in range(folds)], features, folds)


def two_stages(rows: DataFrame, features: list[str], learner: PairClassifier | None = None, folds: int = 3) -> DataFrame:
    """p1 from the features, p2 from them and the context of p1."""
    first = materialise(cross_fit(rows, features, learner, folds).transform(rows, "p1"), "stage-1")
    seen = probability_context(first, "p1")
    more = [*features, "p1", "rank_q", "rank_src", "rank_t", "best_other_q", "best_other_src", "best_other_t", "sum_q", "n05_q", "n_t", "margin_t", "margin_q"]
    seen = materialise(seen, "stage-2-rows")
    return cross_fit(seen, more, learner, folds).transform(seen, "p2")


def candidate_filter(rows: DataFrame, features: list[str], keep: float = 0.995, learner: PairClassifier | None = None, folds: int = 3) -> tuple[DataFrame, float]:
    """(rows that a cheap model on search features lets through, the threshold that keeps a share of the fit positives)."""
    x = materialise(cross_fit(rows, features, learner or Learner(rounds=10), folds).transform(rows, "p_block"), "filter")
    cut = x.filter("y = 1 and role = 'FIT'").agg(F.percentile("p_block", F.lit(1 - keep))).first()[0] or 0.0
    return x.filter(F.col("p_block") >= cut), float(cut)


def filter_curve(rows: DataFrame, keeps: list[float]) -> DataFrame:
    """keep, threshold, recall, per_entity for several shares, from one pass over p_block."""
    cuts = rows.filter("y = 1").agg(*[F.percentile("p_block", F.lit(1 - k)).alias(f"c{i}") for i, k in enumerate(keeps)])
    x = rows.join(F.broadcast(cuts))
    n, pos = F.count_distinct("q"), F.sum("y")
    aggs = [F.struct(F.lit(k).alias("keep"), F.first(f"c{i}").alias("threshold"), (F.sum(F.when(F.col("p_block") >= F.col(f"c{i}"), F.col("y")).otherwise(0)) / pos).alias("recall"), (F.sum((F.col("p_block") >= F.col(f"c{i}")).cast("long")) / n).alias("per_entity")).alias(f"r{i}") for i, k in enumerate(keeps)]
    return x.agg(*aggs).select(F.explode(F.array(*[f"r{i}" for i in range(len(keeps))])).alias("r")).select("r.*")


def monotone_signs(rows: DataFrame, features: list[str], least: float = 0.1) -> DataFrame:
    """feature, corr, sign: label correlation, nulls as the median; sign 0 below ``least``."""
    median = rows.agg(*[F.percentile(f, F.lit(0.5)).alias(f"m{i}") for i, f in enumerate(features)])
    x = rows.join(F.broadcast(median))
    c = x.agg(*[F.corr(F.coalesce(F.col(f).cast("double"), F.col(f"m{i}").cast("double")), F.col("y").cast("double")).alias(f"c{i}") for i, f in enumerate(features)])
    listed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("corr")) for i, f in enumerate(features)])
    each = c.select(F.explode(listed).alias("x")).select("x.*")
    return each.withColumn("sign", F.when(F.abs("corr") >= least, F.signum("corr")).otherwise(0.0).cast("int"))


def distractor_weights(rows: DataFrame, truth: DataFrame, weight: float) -> DataFrame:
    """Adds w: ``weight`` for pairs whose target nobody owns, else 1."""
    owned = truth.select("t").distinct().withColumn("_owned", F.lit(True))
    return rows.join(owned, "t", "left").withColumn("w", F.when(F.col("_owned"), 1.0).otherwise(float(weight))).drop("_owned")


def entity_weights(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds w: what a wrong pair costs its entity, what a missed link costs."""
    from .decide import fn_cost, fp_cost

    k = truth.groupBy("q").agg(F.count(F.lit(1)).alias("_k"))
    x = rows.join(k, "q", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    return x.withColumn("w", F.when(F.col("y") == 1, fn_cost(F.col("_k"))).otherwise(fp_cost(F.col("_k")))).drop("_k")


def shift_weights(rows: DataFrame, features: list[str], learner: PairClassifier | None = None, clip: tuple[float, float] = (0.1, 10.0), over: str = "true") -> DataFrame:
    """Adds w: root of the odds that a row looks like the target domain (column domain: 1), by a weak two-fold classifier, clipped around the mean of the rows ``over``."""
    x = rows.withColumn("y_keep", F.col("y")).withColumn("y", F.col("domain")).withColumn("role", F.lit("FIT"))
    got = cross_fit(x, features, learner or Learner("logistic"), 2).transform(x, "_d")
    p = F.least(F.greatest("_d", F.lit(1e-6)), F.lit(1 - 1e-6))
    got = got.withColumn("_w", F.sqrt(p / (1 - p))).withColumn("y", F.col("y_keep"))
    got = materialise(got, "shift")
    m = got.filter(over).agg(F.avg("_w")).first()[0] or 1.0
    return got.withColumn("w", F.least(F.greatest(F.col("_w") / m, F.lit(clip[0])), F.lit(clip[1]))).drop("_w", "_d", "y_keep")


def pseudo_labels(scored: DataFrame, high: float, low: float, p: str = "p2") -> DataFrame:
    """Unlabelled pairs sure enough to learn from: 1 where the score is high and its target's best, 0 where it is low."""
    best = F.max(p).over(Window.partitionBy("t"))
    y = F.when((F.col(p) >= high) & (F.col(p) == best), 1).when(F.col(p) <= low, 0)
    return scored.withColumn("y", y).filter(F.col("y").isNotNull())


def self_train(rows: DataFrame, unlabelled: DataFrame, features: list[str], high: float = 0.95, low: float = 0.05, learner: PairClassifier | None = None) -> DataFrame:
    """Scores of ``unlabelled`` by a model refitted with its own sure pairs."""
    learner = learner or Learner()
    first = learner.fit(rows, features)
    seen = materialise(score(first, unlabelled, features, "p2"), "self-train")
    more = pseudo_labels(seen, high, low)
    both = rows.select("y", *features).unionByName(more.select("y", *features))
    return score(learner.fit(both, features), unlabelled, features, "p2")


def leave_one_out(rows: DataFrame, features: list[str], by: str, values: list, learner: PairClassifier | None = None) -> DataFrame:
    """Every value's rows scored by a model fitted on all others."""
    learner = learner or Learner()
    parts = [score(learner.fit(rows.filter(F.col(by) != v), features), rows.filter(F.col(by) == v), features) for v in values]
    return reduce(lambda a, b: a.unionByName(b), parts)


def importance(model: PipelineModel, features: list[str], most: int = 15) -> list[tuple[str, float]]:
    """The features with the largest shares of gain."""
    v = model.stages[-1].featureImportances.toArray()
    total = v.sum() or 1.0
    return sorted(((f, float(x / total)) for f, x in zip(features, v)), key=lambda kv: (-kv[1], kv[0]))[:most]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def frozen(path: str, rows: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    """Scores by a saved model."""
    return score(PipelineModel.load(path), rows, features, out)


def adversarial(a: DataFrame, b: DataFrame, features: list[str], by: str, learner: PairClassifier | None = None) -> DataFrame:
    """by, auc: how well three entity folds tell the two sets of pairs apart; 0.5 is no difference."""
    from .metrics import auc

    both = a.select("q", by, *features).withColumn("y", F.lit(0)).unionByName(b.select("q", by, *features).withColumn("y", F.lit(1)))
    x = both.withColumn("role", F.lit("FIT"))
    return auc(materialise(cross_fit(x, features, learner or Learner("logistic"), 3).transform(x, "p"), "adversarial"), by=by)


def ablation(rows: DataFrame, features: list[str], groups: dict[str, list[str]], measure: Callable[[DataFrame], float], learner: PairClassifier | None = None) -> list[tuple[str, float]]:
    """(group left out, measure): what each feature group is worth."""
    out = []
    for name, cols in {"": [], **groups}.items():
        left = [f for f in features if f not in cols]
        out.append((name or "none", measure(cross_fit(rows, left, learner, 2).transform(rows, "p"))))
    return out


def tune(rows: DataFrame, features: list[str], grid: list[Learner], measure: Callable[[DataFrame], float]) -> tuple[Learner, float]:
    """The learner with the largest measure of its out-of-fold scores; ties go to the first."""
    tried = [(measure(cross_fit(rows, features, g, 2).transform(rows, "p")), -i, g) for i, g in enumerate(grid)]
    best = max(tried, key=lambda t: t[:2])
    return best[2], best[0]


def export_pairs(pairs: DataFrame, q: DataFrame, t: DataFrame) -> DataFrame:
    """q, t, qtext, ttext, half: what a text scorer outside gets; halves by the entity, so each half is scored by the other's model."""
    from .universe import pair_text

    return pair_text(pairs, q, t).withColumn("half", fold_of(F.col("q"), 2, seed=11))


def score_text(pairs: DataFrame, scorers: dict[int, Callable[[list[str], list[str]], list[float]]], out: str = "p") -> DataFrame:
    """Scores of exported pairs by two pluggable scorers: a pair of half h goes to the scorer fitted on the other half."""
    import pandas as pd

    def run(frames):
        for x in frames:
            got = pd.Series(0.0, index=x.index)
            for half, f in scorers.items():
                mine = x["half"] != half
                if mine.any():
                    got[mine] = f(x.loc[mine, "qtext"].tolist(), x.loc[mine, "ttext"].tolist())
            yield x[["q", "t"]].assign(**{out: got.astype(float)})

    return pairs.mapInPandas(run, f"q long, t long, {out} double")
