"""The provided tables seen as linkage inputs. Every row of a table takes part.

records: documents as business records. The name is the text's first line, the
address the other lines; the document source decides which of the three record
sources it stands for.
scored: line items as candidate pairs (part q, order t) with a score; truth_of
gives each order at most one true part, and orders with status P none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def records(spark: SparkSession, d: str) -> DataFrame:
    """rid, country, src (1, 2, 3), business_name, business_address."""
    docs = table(spark, d, "documents")
    k = F.try_to_number(F.substring("source", 4, 9), F.lit("999999999")).cast("int")
    first = F.element_at(F.split(F.col("text"), "\n", 2), 1)
    return docs.select(
        F.col("doc_id").alias("rid"),
        F.col("lang").alias("country"),
        F.when(k < 5, 1).when(k < 12, 2).otherwise(3).alias("src"),
        first.alias("business_name"),
        F.expr("substring(text, length(element_at(split(text, '\n', 2), 1)) + 2)").alias("business_address"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """q, t, p, src, country: one row per part and order."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    p = ((F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber") * 13 + F.col("l_suppkey")) % 101) / F.lit(100.0) * (1 + F.col("l_orderkey") % 10) / F.lit(10.0)
    pairs = li.groupBy(F.col("l_partkey").alias("q"), F.col("l_orderkey").alias("t")).agg(F.max(p).alias("p"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_brand").alias("country"))
    return pairs.join(part, "q").select("q", "t", "p", (2 + F.col("t") % 2).cast("int").alias("src"), "country")


def scored_b(spark: SparkSession, d: str) -> DataFrame:
    """q, t, p of a second scorer, which has not seen returned items."""
    li = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    p = ((F.col("l_quantity").cast("int") * 5 + F.col("l_linenumber") * 17 + F.col("l_suppkey")) % 97) / F.lit(100.0) * (1 + F.col("l_orderkey") % 10) / F.lit(10.0)
    return li.groupBy(F.col("l_partkey").alias("q"), F.col("l_orderkey").alias("t")).agg(F.max(p).alias("p"))


def truth_of(spark: SparkSession, d: str) -> DataFrame:
    """q, t: the best part of an order with status F, the second best with status O, none with P."""
    o = table(spark, d, "orders").filter("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("t"), "o_orderstatus")
    w = Window.partitionBy("t").orderBy(F.col("p").desc(), "q")
    x = scored(spark, d).join(o, "t").withColumn("r", F.row_number().over(w))
    return x.filter(F.col("r") == F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)).select("q", "t")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """q, country of every part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_brand").alias("country"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    """t, country of every order: the country most of its parts are from."""
    x = scored(spark, d).groupBy("t", "country").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("t").agg(F.min_by("country", F.struct(-F.col("n"), "country")).alias("country"))


ROLE = "CASE WHEN (q * 7919 + 13) % 20 < 4 THEN 'EVAL' WHEN (q * 7919 + 13) % 20 < 5 THEN 'ES' WHEN (q * 7919 + 13) % 20 < 11 THEN 'FIT' ELSE 'REST' END"


def roles(spark: SparkSession, d: str) -> DataFrame:
    """q, role: the fixed split of entities."""
    return entities(spark, d).select("q", F.expr(ROLE).alias("role"))


SQL = {
    "records": """SELECT doc_id AS rid, lang AS country, CASE WHEN try_cast(substr(source, 4) AS INT) < 5 THEN 1 WHEN try_cast(substr(source, 4) AS INT) < 12 THEN 2 ELSE 3 END AS src,
      split_part(text, chr(10), 1) AS business_name, substr(text, length(split_part(text, chr(10), 1)) + 2) AS business_address FROM documents""",
    "scored": """SELECT q, t, p, (2 + t % 2)::INT AS src, p_brand AS country FROM (
      SELECT l_partkey AS q, l_orderkey AS t, max(((l_quantity::INT * 7 + l_linenumber * 13 + l_suppkey) % 101)::DOUBLE / 100.0::DOUBLE * (1 + l_orderkey % 10)::DOUBLE / 10.0::DOUBLE) AS p
      FROM lineitem GROUP BY 1, 2) JOIN part ON q = p_partkey""",
    "scored_b": """SELECT l_partkey AS q, l_orderkey AS t, max(((l_quantity::INT * 5 + l_linenumber * 17 + l_suppkey) % 97)::DOUBLE / 100.0::DOUBLE * (1 + l_orderkey % 10)::DOUBLE / 10.0::DOUBLE) AS p
      FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2""",
    "truth": """SELECT q, t FROM (SELECT q, t, o_orderstatus, row_number() OVER (PARTITION BY t ORDER BY p DESC, q) AS r FROM scored JOIN orders ON t = o_orderkey WHERE o_orderstatus IN ('F', 'O'))
      WHERE r = CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END""",
    "entities": "SELECT p_partkey AS q, p_brand AS country FROM part",
    "targets": "SELECT t, min_by(country, (-n, country)) AS country FROM (SELECT t, country, count(*) AS n FROM scored GROUP BY 1, 2) GROUP BY t",
    "roles": f"SELECT q, {ROLE} AS role FROM entities",
    "own": "SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY t) AS m FROM scored) WHERE p = m",
}


def with_views(body: str, *names: str, **more: str) -> str:
    """Oracle SQL with the named views (in the order of SQL) and further ones before it."""
    parts = [f"{n} AS (\n{SQL[n]}\n)" for n in SQL if n in names] + [f"{n} AS (\n{s}\n)" for n, s in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
