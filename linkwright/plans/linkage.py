"""The whole linkage: records and known links in, chosen links out.

Five stages, each written once under the key of the versions it depends on and read
again by the next, so a lost executor or a new matcher never repeats a search.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import combine, context, decide, learn, metrics, models, search, universe
from ..operators import features as pf
from ..session import materialise
from .registry import BLOCK, FEAT, MATCH, NORM, Match, Versions

#: Ids of copied distractors: the original's and a multiple of this.
SHIFT = 1 << 40


@dataclass
class Inputs:
    """Raw records (rid, country, src, business_name, business_address), true links (q, t) and roles (q, role)."""

    entities: DataFrame
    targets: DataFrame
    truth: DataFrame
    roles: DataFrame


class Linkage:
    """prep, block, features, train and predict over a folder of stage tables.

    extra: scores (q, t, p) of the text scorers that the feature version names;
    source: the run in this folder whose models a frozen matcher loads, by default
    the same versions with the matcher it names.
    """

    def __init__(
        self, spark: SparkSession, folder: str, versions: Versions = Versions(), learner: models.Learner | None = None, scope: str = "full",
        extra: dict[str, DataFrame] | None = None, source: Versions | None = None,
    ):
        self.extra = extra or {}
        self.spark, self.folder, self.v, self.scope = spark, folder.rstrip("/"), versions, scope
        self.norm, self.block, self.feat, self.match = NORM[versions.norm], BLOCK[versions.block], FEAT[versions.feat], MATCH[versions.match]
        if self.match.monotone_min_corr:
            raise NotImplementedError(f"{versions.match}: the learners of pyspark.ml take no monotone constraints")
        if self.match.pred_margin:
            raise NotImplementedError(f"{versions.match}: the learners of pyspark.ml sum all their trees")
        self.learner = learner or models.Learner(self.match.algo, rate=self.match.rate)
        self.source = source or replace(versions, **dict(zip(("block", "feat", "match"), self.match.frozen_from.split("__") if self.match.frozen_from else ())))
        self.check_scope()

    def check_scope(self) -> None:
        """Refuses a folder whose tables come from other data."""
        path = f"{self.folder}/scope"
        try:
            found = self.spark.read.text(path).first()[0]
        except AnalysisException:
            self.spark.createDataFrame([(json.dumps({"scope": self.scope}),)], "value string").coalesce(1).write.text(path)
            return
        if json.loads(found)["scope"] != self.scope:
            raise ValueError(f"{self.folder} holds tables of scope {found}")

    def table(self, stage: str, name: str, make) -> DataFrame:
        """The stage's table, computed and written if it is not there."""
        path = f"{self.folder}/{self.v.key(stage)}/{name}"
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            make().write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)

    def prep(self, x: Inputs) -> tuple[DataFrame, DataFrame]:
        """Both sides normalised, with aliases learned from links that are not held out."""
        raw = [text.normalize(r) for r in (x.entities, x.targets)]
        known = universe.learning_links(x.truth, x.roles)
        pairs = known.join(raw[0].select(F.col("rid").alias("q"), "country", F.col("name_n").alias("qn"), F.col("addr_n").alias("qa")), "q")
        pairs = pairs.join(raw[1].select(F.col("rid").alias("t"), F.col("name_n").alias("tn"), F.col("addr_n").alias("ta")), "t")
        alias = {}
        for side, a, b in (("name", "qn", "tn"), ("addr", "qa", "ta")):
            links = pairs.select("country", text.tokens(F.col(a)).alias("q_tokens"), text.tokens(F.col(b)).alias("t_tokens"))
            n = self.norm
            alias[side] = self.table("prep", f"{side}_alias", lambda links=links, n=n: learn.learn_aliases(links, min_count=n.alias_min_count, min_ratio=n.alias_min_ratio, max_unaligned=n.alias_max_unaligned))
        return tuple(self.table("prep", s, lambda r=r: text.normalize(r, alias["name"], alias["addr"])) for s, r in (("q", x.entities), ("t", x.targets)))

    def candidates(self, x: Inputs, q: DataFrame, t: DataFrame) -> DataFrame:
        b = self.block

        def make() -> DataFrame:
            qs, ts = q.withColumn("q", F.col("rid")), t.withColumn("t", F.col("rid"))
            if b.keep_nonevals < 1:
                qs, ts = universe.train_universe(qs, ts, x.truth, x.roles, b.keep_nonevals)
            regions = None
            if b.region_split:
                keys = materialise(learn.region_keys(qs, b.region_min_share, b.region_min_last_ratio), "region-keys")
                known = universe.learning_links(x.truth, x.roles)
                qk, tk = learn.record_keys(qs, keys), learn.record_keys(ts, keys)
                groups = learn.merged_groups(keys, learn.region_merges(known, qk, tk, b.region_min_cross))
                named = lambda r, k: r.select("rid", "country").join(k.join(groups, ["country", "k"]).groupBy("rid").agg(F.collect_set("g").alias("gs")), "rid", "left")
                split = known.join(qs.select("q", "country"), "q").select("country").distinct()
                regions = (named(qs, qk), named(ts, tk), split)
            got = search.generate_candidates(qs, ts, b.search, regions)
            if b.dup_distractors > 1:
                copies = universe.distractor_copies(ts.select("t"), x.truth, b.dup_distractors, SHIFT)
                got = universe.copy_candidates(got, copies, b.search.k, b.search.k_noaddr)
            return got

        if b.search_from:
            got = Linkage(self.spark, self.folder, replace(self.v, block=b.search_from, match="MATCH-v1"), self.learner, self.scope, self.extra).candidates(x, q, t)
        else:
            got = self.table("block", "candidates", make)
        if not b.prune_keep:
            return got
        rows = context.context_features(got).join(q.select(F.col("rid").alias("q"), "country", F.col("name_core").alias("a_name_core")), "q")
        rows = rows.join(t.select(F.col("rid").alias("t"), F.col("name_core").alias("b_name_core")), "t")
        for side in "ab":
            rows = context.name_freq(rows, q.select("country", F.col("name_core").alias(f"{side}_name_core")), f"{side}_name_freq", name=f"{side}_name_core")
        rows = rows.drop("a_name_core", "b_name_core").withColumn("noaddr", F.col("noaddr_pass").cast("int"))
        rows = universe.labels(rows.join(x.roles, "q"), x.truth)
        # the search's own scores and their competition, no string similarity
        cheap = ["src", "bscore", "cos_name", "cos_addr", "noaddr", "rank_in_q", "n_cand_q", "rank_in_src", "gap_to_best_src", "t_indegree", "rank_for_t", "margin_vs_other", "a_name_freq", "b_name_freq"]
        return self.table("block", "filtered", lambda: models.candidate_filter(rows, cheap, b.prune_keep)[0].select(*got.columns, "p_block"))

    def universe(self, x: Inputs, q: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides as features see them: with copied distractors, the universe that was searched and a record for every copy."""
        b = self.block
        if b.dup_distractors == 1:
            return q, t
        qs, ts = q.withColumn("q", F.col("rid")), t.withColumn("t", F.col("rid"))
        if b.keep_nonevals < 1:
            qs, ts = universe.train_universe(qs, ts, x.truth, x.roles, b.keep_nonevals)
        copies = universe.distractor_copies(ts, x.truth, b.dup_distractors, SHIFT).withColumn("rid", F.col("t_copy"))
        return qs.select(*q.columns), ts.select(*t.columns).unionByName(copies.select(*t.columns))

    def features(self, q: DataFrame, t: DataFrame, cand: DataFrame) -> DataFrame:
        f = self.feat

        def make() -> DataFrame:
            if lacking := [n for n in f.extra if n not in self.extra]:
                raise ValueError(f"{self.v.feat} needs the scores of {', '.join(lacking)}")
            a, b = q, t
            extra: tuple[str, ...] = ()
            if f.distinct:
                for c, out in (("name_core", "nr"), ("addr_n", "ar")):
                    often = learn.frequent_tokens([q, t], c, keep_numbers=f.keep_numbers)
                    a, b = pf.distinctive(a, often, c, out), pf.distinctive(b, often, c, out)
                extra = ("nr", "ar")
            rows = pf.with_records(context.context_features(cand), a, b, (*pf.COLUMNS, *extra))
            rows = pf.kernel_features(pf.native_features(rows))
            if f.distinct:
                rows = pf.distinct_features(rows)
            if f.align:
                rows = pf.align_features(rows, learn.name_idf(q))
            for side in "ab":
                rows = context.name_freq(rows, q.select("country", F.col("name_core").alias(f"{side}_name_core")), f"{side}_name_freq", name=f"{side}_name_core")
                if f.target_names:
                    rows = context.name_freq(rows, t.select("country", F.col("name_core").alias(f"{side}_name_core")), f"{side}_name_tfreq", name=f"{side}_name_core")
            if f.twin_flag:
                rows = rows.withColumn("addr_twin_num_diff", pf.twin_flag(F.col("cos_addr"), F.col("num_jacc")))
            keep = [c for c, kind in rows.dtypes if kind in ("double", "int", "bigint", "float") and c not in ("q", "t", "src")]
            rows = rows.select("q", "t", "src", "country", *[F.col(c).cast("double").alias(c) for c in keep])
            if f.extra:
                rows, missing = combine.extra_scores(rows, {n: self.extra[n] for n in f.extra})
                self.table("features", "extra_missing", lambda: missing)
            for n in f.extra if f.extra_context else ():
                seen = context.score_context(self.extra[n].select("q", "t", F.col("p").alias(n)), n).drop(n)
                rows = rows.join(seen.select("q", "t", *[F.col(c).cast("double").alias(c) for c in seen.columns if c not in ("q", "t")]), ["q", "t"], "left")
            return rows

        return self.table("features", "pairs", make)

    def fit(self, stage: str, rows: DataFrame, names: list[str], folds: int, weight: str | None) -> models.CrossFit:
        """The stage's fold models: fitted and saved beside the scores, or loaded from the frozen run."""
        if self.match.frozen_from:
            path = f"{self.folder}/{self.source.key('scores')}/models/{stage}"
            try:
                self.spark.read.text(f"{path}-0/metadata")
            except AnalysisException as e:
                raise FileNotFoundError(f"{self.v.match} needs the saved models {path}-*") from e
            loaded = [PipelineModel.load(f"{path}-{i}") for i in range(folds)]
            used = list(loaded[0].stages[0].getInputCols())
            if lacking := [c for c in used if c not in names]:
                raise ValueError(f"{self.v.match}: the frozen models need {', '.join(lacking)}")
            return models.CrossFit(loaded, used, folds)
        got = models.cross_fit(rows.filter("y is not null"), names, self.learner, folds, weight)
        for i, m in enumerate(got.models):
            models.save(m, f"{self.folder}/{self.v.key('scores')}/models/{stage}-{i}")
        return got

    def fitted(self, m: Match, rows: DataFrame, names: list[str], t: DataFrame, weight: str | None = None, tag: str = "") -> DataFrame:
        """q, t, src, country, p of all rows by one or two stages; rows without y are scored only."""
        if m.stages == 1:
            return self.fit(f"stage1{tag}", rows, names, m.folds, weight).transform(rows, "p").select("q", "t", "src", "country", "p")
        first = materialise(self.fit(f"stage1{tag}", rows, names, m.folds, weight).transform(rows, "p1"), "stage-1")
        more = [*names, "p1", "rank_q", "rank_src", "rank_t", "best_other_q", "best_other_src", "best_other_t", "sum_q", "n05_q", "n_t", "margin_t", "margin_q"]
        seen = context.probability_context(first, "p1")
        if m.support:
            sup = pf.support_features(first.select("q", "t", "src", F.col("p1").alias("p")), t).drop("src", "p")
            more += [c for c in sup.columns if c.startswith("sup_")]
            seen = seen.join(sup, ["q", "t"])
        seen = materialise(seen, "stage-2-rows")
        return self.fit(f"stage2{tag}", seen, more, m.folds, weight).transform(seen, "p").select("q", "t", "src", "country", "p")

    def unseen(self, rows: DataFrame) -> list[str]:
        """Countries of the rows without an entity to fit on: what adapting matchers adapt to."""
        fit = F.max(F.col("role").isin("FIT", "ES").cast("int"))
        found = [r.country for r in rows.groupBy("country").agg(fit.alias("fit")).filter("fit = 0").collect()]
        if not found:
            raise ValueError(f"{self.v.match} adapts to countries without an entity to fit on, and there is none")
        return found

    def blended(self, x: Inputs, feats: DataFrame, t: DataFrame) -> DataFrame:
        """Mean score of the member matchers, each with its own learner."""
        runs = []
        for name in self.match.blend_of:
            learner = replace(self.learner, algo=MATCH[name].algo, rate=MATCH[name].rate) if isinstance(self.learner, models.Learner) else None
            runs.append(Linkage(self.spark, self.folder, replace(self.v, match=name), learner, self.scope, self.extra).scores(x, feats, t))
        return combine.blend(runs).join(feats.select("q", "t", "src", "country"), ["q", "t"]).select("q", "t", "src", "country", "p")

    def scores(self, x: Inputs, feats: DataFrame, t: DataFrame) -> DataFrame:
        m = MATCH[self.source.match] if self.match.frozen_from else self.match
        names = [c for c in feats.columns if c not in ("q", "t", "src", "country")]

        def make() -> DataFrame:
            if m.blend_of:
                return self.blended(x, feats, t)
            rows = universe.labels(feats, x.truth).join(x.roles, "q")
            if m.fit_rest:
                rows = rows.withColumn("role", F.when(F.col("role") == "REST", "FIT").otherwise(F.col("role")))
            if m.train_countries:
                rows = rows.withColumn("role", F.when(F.col("role").isin("FIT", "ES") & ~F.col("country").isin(*m.train_countries), "REST").otherwise(F.col("role")))
            weight = None
            if m.distractor_weight != 1:
                rows, weight = models.distractor_weights(rows, x.truth, m.distractor_weight), "w"
            elif m.entity_weight:
                rows, weight = models.entity_weights(rows, x.truth), "w"
            rows = materialise(rows, "train-rows")
            if m.covshift:
                away = F.col("country").isin(*self.unseen(rows))
                both = rows.filter(away | F.col("role").isin("FIT", "ES")).withColumn("domain", away.cast("int"))
                shift = models.shift_weights(both, names, over="domain = 0").select("q", "t", F.col("w").alias("_shift"))
                rows = rows.join(shift, ["q", "t"], "left").withColumn("w", F.coalesce("_shift", F.lit(1.0)) * (F.col("w") if weight else F.lit(1.0)))
                rows, weight = materialise(rows.drop("_shift"), "train-rows"), "w"
            got = self.fitted(m, rows, names, t, weight)
            if not m.self_train:
                return got
            if weight or m.support or m.stages != 2:
                raise ValueError("self-training needs the plain two-stage matcher: no weights, no support features")
            away = F.col("country").isin(*self.unseen(rows))
            sure = models.pseudo_labels(materialise(got, "self-train"), *m.self_train, p="p").filter(away).select("q", "t", F.col("y").alias("_sure"))
            again = rows.join(sure, ["q", "t"], "left").withColumn("y", F.when(away, F.col("_sure")).otherwise(F.col("y"))).drop("_sure")
            again = materialise(again.withColumn("role", F.when(away, "FIT").otherwise(F.col("role"))), "train-rows")
            return self.fitted(m, again, names, t, tag="-self")

        return self.table("scores", "pairs", make)

    def predict(self, x: Inputs, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chosen links of all entities by the matcher's rule that is best on held-out ones, the grid of rules).

        A matcher with eval_dup counts links to targets that nobody owns twice; one
        that is fitted on some countries chooses on theirs.
        """
        held = x.roles.filter("role = 'EVAL'").select("q")
        if self.match.train_countries:
            held = held.join(x.entities.filter(F.col("country").isin(*self.match.train_countries)).select(F.col("rid").alias("q")), "q", "left_semi")
        table = materialise(decide.grid(scores, x.truth.join(held, "q", "left_semi"), held, distractor_weight=self.doubled(), owned=x.truth), "grid")
        best = decide.best_rule(table.filter(F.col("rule").isin(*self.match.rules))).first()
        return decide.decide(scores, best["rule"], best["value"]), table

    def doubled(self) -> float:
        return 2.0 if self.match.eval_dup else 1.0

    def run(self, x: Inputs) -> dict[str, DataFrame]:
        q, t = self.prep(x)
        cand = self.candidates(x, q, t)
        q, t = self.universe(x, q, t)
        scores = self.scores(x, self.features(q, t, cand), t)
        links, table = self.predict(x, scores)
        held = x.roles.filter("role = 'EVAL'").select("q")
        return {
            "links": links,
            "rules": table,
            "recall": metrics.recall_report(cand, x.truth),
            "quality": metrics.macro_f05(links.join(held, "q", "left_semi"), x.truth.join(held, "q", "left_semi"), held, self.doubled(), x.truth),
        }
