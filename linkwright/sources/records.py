"""Sources and sinks of records, links and results: tab-separated files, link lists, the output validator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Tab-separated text with a header and no quoting; stray quotes stay, empty cells are null."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or TSV by extension."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)


def load_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(entities, targets): source 1, and sources 2 and 3 stacked with ``src``."""
    one, two, three = (read_tsv(spark, f"{folder}/{split}_source{i}.tsv") for i in (1, 2, 3))
    return one, two.withColumn("src", F.lit(2)).unionByName(three.withColumn("src", F.lit(3)))


def stack(frames: dict[int, DataFrame]) -> DataFrame:
    """Frames one upon the other, with the number of their source."""
    from ..operators.decide import union_all

    return union_all([f.withColumn("src", F.lit(n)) for n, f in frames.items()])


def with_rid(records: DataFrame, key: str = "entity_id", start: int = 0) -> DataFrame:
    """Adds rid: the row's place in the order of its key, the same on every run.

    Places come from range partitions: counts per partition, then a rank inside each.
    """
    ranged = records.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    from pyspark.sql import Window

    from ..session import materialise

    ranged = materialise(ranged, "rid")
    n = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.join(F.broadcast(before), "_p").withColumn("rid", (F.col("_before") + inside + start).cast("long")).drop("_p", "_before")


def explode_lists(truth: DataFrame, key: str = "source1_entity_id", lists: str = "matched_entity_ids") -> DataFrame:
    """q, t of comma lists; empty lists vanish."""
    x = truth.select(F.col(key).alias("q"), F.explode(F.split(F.coalesce(lists, F.lit("")), ",")).alias("t"))
    return x.filter("t <> ''")


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return explode_lists(read_tsv(spark, path, TRUTH))


def match_lists(links: DataFrame, entities: DataFrame, out: str = "matched_entity_ids") -> DataFrame:
    """One row per entity: its distinct targets in order, comma-joined; '' for none."""
    lists = links.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set(F.col("t").cast("string"))), ",").alias(out))
    return entities.select("q").join(lists, "q", "left").withColumn(out, F.coalesce(out, F.lit("")))


def write_lists(lists: DataFrame, path: str, key: str = "q", out: str = "matched_entity_ids") -> None:
    """Tab-separated, with a header, never quoted, in the order of the key; range partitions keep it over many files."""
    x = lists.select(F.col(key).cast("string").alias("source1_entity_id"), out).orderBy(F.col(key))
    x.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def to_ids(pairs: DataFrame, q_ids: DataFrame, t_ids: DataFrame) -> DataFrame:
    """s1_id, cand_id and the other columns: row ids (rid) mapped to entity ids by two joins."""
    a = q_ids.select(F.col("rid").alias("q"), F.col("entity_id").alias("s1_id"))
    b = t_ids.select(F.col("rid").alias("t"), F.col("entity_id").alias("cand_id"))
    return pairs.join(a, "q").join(b, "t").drop("q", "t")


def check_file(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """check, offenders of a list file's form: empty, comma_separated, header (not exactly ``columns``), no_tab (rows without a tab).

    The header is the file's first line, or the first line of each part of a folder.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"), F.min("row").alias("head"))
    heads = first.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum((~F.contains("header", F.lit("\t")) & F.contains("header", F.lit(","))).cast("long")), F.lit(0)).alias("comma"),
        F.coalesce(F.sum((F.transform(F.split("header", "\t"), lambda c: F.lower(F.trim(c))) != F.array(*[F.lit(c) for c in columns])).cast("long")), F.lit(0)).alias("header"),
    )
    rows = lines.join(F.broadcast(first.select("file", "head")), "file").filter("row <> head")
    tabs = rows.agg(F.coalesce(F.sum((~F.contains("value", F.lit("\t")) & (F.trim("value") != "")).cast("long")), F.lit(0)).alias("no_tab"))
    x = heads.join(F.broadcast(tabs))
    found = {"empty": (F.col("files") == 0).cast("long"), "comma_separated": F.col("comma"), "header": F.col("header"), "no_tab": F.col("no_tab")}
    return x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("offenders")) for k, v in found.items()])).alias("x")).select("x.check", "x.offenders")


CHECKS = ("duplicate_row", "duplicate_id_in_list", "self_match", "wrong_prefix", "unknown_id", "missing_entity", "extra_entity", "match_not_candidate")


def validate(results: DataFrame, entity_ids: DataFrame, target_ids: DataFrame, candidates: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-"), own_prefix: str = "S1-", key: str = "source1_entity_id", lists: str = "matched_entity_ids") -> DataFrame:
    """check, offenders, severity for each check; a clean file has no offenders.

    Every check is one join or aggregate over the lists' rows or ids.
    """
    one = results.select(F.col(key).alias("q"), F.split(F.coalesce(F.col(lists), F.lit("")), ",").alias("ids"))
    ids = one.select("q", F.explode("ids").alias("t")).filter("t <> ''")
    own = F.startswith(F.col("t"), F.lit(own_prefix))
    good = F.lit(False)
    for p in prefixes:
        good = good | F.startswith(F.col("t"), F.lit(p))
    ent, tar = entity_ids.select(F.col("id").alias("q")).distinct(), target_ids.select(F.col("id").alias("t")).distinct()
    found = {
        "duplicate_row": one.groupBy("q").count().filter("count > 1"),
        "duplicate_id_in_list": one.filter(F.size(F.array_distinct("ids")) < F.size("ids")),
        "self_match": ids.filter(own),
        "wrong_prefix": ids.filter(~good & ~own),
        "unknown_id": ids.filter(good).select("t").join(tar, "t", "left_anti"),
        "missing_entity": ent.join(one, "q", "left_anti"),
        "extra_entity": one.join(ent, "q", "left_anti"),
    }
    if candidates is not None:
        found["match_not_candidate"] = ids.join(candidates.select("q", "t"), ["q", "t"], "left_anti")
    from ..operators.decide import union_all

    rows = [f.agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(c).alias("check"), "offenders", F.lit("warning" if c == "match_not_candidate" else "error").alias("severity")) for c, f in found.items()]
    return union_all(rows)
