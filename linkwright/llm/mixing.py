"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (partial aggregation, so a source that holds a third
of all rows costs one row per task), target sizes come from water-filling over
the per-source table, and each document is then taken ``floor(rate)`` times plus
one hash-seeded Bernoulli copy whose probability is the fraction. The document
table is scanned twice and never shuffled: only the per-source table is joined,
by broadcast when it has at most ``BROADCAST_ROWS`` sources (counted), else by a
skew-split sort-merge join.

Edge cases: null text has size 0; a null source is a source of its own, ordered
last; a source of size 0 has target 0; an empty table gives an empty mix; rows
with equal doc_id and text share their draw, so repeated rows are taken alike;
extra columns never clash because only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialise
from .common import WORD

#: Weights by the source's rank in code point order, repeating; the mix's share of all sizes; the most times a source is repeated.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with weight, target and rate.

    Water-filling in closed form: with sources ordered by cap/weight, those that
    reach their cap form a prefix, and all others get ``level * weight``. One row
    per source, so the ordered windows see a catalogue, not the corpus.
    """
    everything = Window.partitionBy()
    by_code = everything.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_code) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = (
        t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("rank", F.row_number().over(fill))
        .withColumn("capped", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
        .withColumn("below", F.col("cap") > F.col("level") * F.col("weight"))
    )
    level = F.min(F.when(F.col("below"), F.struct("rank", "level"))).over(everything)
    t = t.withColumn("fill", level)
    t = t.withColumn(
        "target",
        F.when(F.col("fill.rank").isNull() | (F.col("rank") < F.col("fill.rank")), F.col("cap").cast("double")).otherwise(F.col("fill.level") * F.col("weight")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return t.select("source", "source_size", "weight", "target", rate.alias("rate"))


def draw(seed: str = SEED) -> Column:
    """Uniform in [0, 1) from the row's id and text: 52 bits of an MD5 digest."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(docs: DataFrame, keep: list[str] | None = None, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row, after the columns named in ``keep``."""
    seed = parameters.pop("seed", SEED)
    keep = keep or ["doc_id"]
    rows = docs.select(*dict.fromkeys([*keep, "doc_id", "text", "source"]))
    sizes = rows.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("source_size"))
    plan = materialise(targets(sizes, **parameters).withColumnRenamed("source", "_source"), "mix-plan")
    got = join_small(
        rows.select(*rows.columns, size_of(F.col("text")).alias("_size"), draw(seed).alias("_draw")),
        plan.select("_source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate")),
        F.col("source").eqNullSafe(F.col("_source")),
    )
    whole = F.floor("_rate")
    number = (whole + F.when(F.col("_draw") < F.col("_rate") - whole, 1).otherwise(0)).cast("long")
    return got.select(
        *[F.col(c) for c in keep],
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        number.alias("copies"),
        (number * F.col("_size")).alias("taken"),
    )


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed documents, each row repeated as often as the mix takes it, with the columns it came with."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner)]).alias("_row"))
    got = copies(packed, keep=["_row"], **parameters)
    return (
        got.filter(F.col("copies") > 0)
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
        .select(*[F.col(f"_row.{i}").alias(n) for n, i in zip(names, inner)])
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), f AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         row_number() OVER (ORDER BY 2 * source_size / weight::DOUBLE, source ASC NULLS LAST) AS rank,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
), l AS (
  SELECT *, (budget - capped)::DOUBLE / open::DOUBLE AS level FROM f
), m AS (
  SELECT *, min(CASE WHEN cap > level * weight THEN rank END) OVER () AS first_open FROM l
), t AS (
  SELECT source, source_size, CASE WHEN first_open IS NULL OR rank < first_open THEN cap::DOUBLE
         ELSE (SELECT any_value(level) FROM m WHERE rank = first_open) * weight END AS target FROM m
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t
), u AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
         ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.text), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS x
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), c AS (
  SELECT *, (floor(rate) + CASE WHEN x < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM u
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
