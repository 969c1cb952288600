"""Universes and named joins: labels, learning links, splits, test-like training sets, distractor copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds y: 1 for a true link."""
    return pairs.join(truth.select("q", "t", F.lit(1).alias("y")), ["q", "t"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def learning_links(truth: DataFrame, roles: DataFrame, held: str = "EVAL") -> DataFrame:
    """Links of entities that are not held out."""
    return truth.join(roles.filter(F.col("role") != held).select("q"), "q", "left_semi")


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) of a whole-number key that any engine can compute: the fixed split."""
    return ((key * 7919 + 104729 * (seed + 1)) % 1000003) / F.lit(1000003.0)


def train_universe(entities: DataFrame, targets: DataFrame, truth: DataFrame, roles: DataFrame, keep: float, held: str = "EVAL", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(entities, targets): held-out entities and a share of the others; targets of entities left out go, distractors stay."""
    chosen = entities.join(roles, "q").filter((F.col("role") == held) | (hash_share(F.col("q"), seed) < keep)).select("q")
    gone = truth.join(chosen, "q", "left_anti").select("t").distinct()
    return entities.join(chosen, "q", "left_semi"), targets.join(gone, "t", "left_anti")


def distractor_copies(targets: DataFrame, truth: DataFrame, copies: int, shift: int) -> DataFrame:
    """``copies - 1`` more of each target without a link, ids shifted by a multiple of ``shift``."""
    free = targets.join(truth.select("t").distinct(), "t", "left_anti")
    numbered = free.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies - 1)))) if copies > 1 else free.withColumn("copy", F.lit(1)).filter("false")
    return numbered.withColumn("t_copy", F.col("t") + F.col("copy") * shift)


def train_frames(entities: DataFrame, targets: DataFrame, truth: DataFrame, roles: DataFrame, keep: float, copies: int, shift: int) -> tuple[DataFrame, DataFrame]:
    """The test-like universe with its distractors' copies appended."""
    q, t = train_universe(entities, targets, truth, roles, keep)
    more = distractor_copies(t, truth, copies, shift).withColumn("t", F.col("t_copy")).select(*t.columns)
    return q, t.unionByName(more)


def copy_candidates(candidates: DataFrame, copies: DataFrame, k: int, k_noaddr: int | None = None, score: str = "bscore") -> DataFrame:
    """A row for every copy of a candidate distractor, cut to the best per (q, src) again: k of the main pass, k_noaddr of the name-only one.

    Candidates without noaddr_pass come from one pass. Originals win ties with their copies.
    """
    from .context import rank

    more = candidates.join(copies.select("t", "t_copy"), "t").withColumn("t", F.col("t_copy")).select(*candidates.columns)
    both = candidates.unionByName(more)
    by, most = ["q", "src"], F.lit(k)
    if "noaddr_pass" in candidates.columns:
        if k_noaddr is None:
            raise ValueError("candidates of two passes need k_noaddr")
        by, most = [*by, "noaddr_pass"], F.when(F.col("noaddr_pass"), k_noaddr).otherwise(k)
    return both.withColumn("_r", rank(by, score, "t")).filter(F.col("_r") <= most).drop("_r")


def owner_join(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds owner, the target's true entity (null for distractors)."""
    return pairs.join(truth.select(F.col("q").alias("owner"), "t"), "t", "left")


def pair_text(pairs: DataFrame, q: DataFrame, t: DataFrame, name: str = "name", addr: str = "addr") -> DataFrame:
    """q, t, qtext, ttext for a cross-encoder: name and address around a bar, nulls as empty."""
    text = lambda: F.concat(F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(addr, F.lit("")))
    return pairs.join(q.select("q", text().alias("qtext")), "q", "left").join(t.select("t", text().alias("ttext")), "t", "left")


def dev_sample(entities: DataFrame, targets: DataFrame, truth: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, targets, truth): a share of entities, all their targets, the share of distractors."""
    q = entities.filter(hash_share(F.col("q"), seed) < share)
    links = truth.join(q.select("q"), "q", "left_semi")
    owned = targets.join(links.select("t").distinct(), "t", "left_semi")
    free = targets.join(truth.select("t").distinct(), "t", "left_anti").filter(hash_share(F.col("t"), seed + 1) < share)
    return q, owned.unionByName(free), links
