"""Exact token-length histogram.

Documents are encoded once and only their lengths leave the Python worker; the
groupBy combines on the map side, so what is shuffled is one row per distinct
length and task. Suffix sums over that histogram (a row per distinct length,
bounded by the longest document and not by the corpus) answer totals, quantiles
and truncated totals for every context limit.

Edge cases: null or empty text has length 0 (plus ``extra`` end tokens); ties
and repeated rows add up; an empty table gives an empty histogram; extra columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD, TOKEN_BYTES, WordIds, bound_batches, regrouped, tokenizer_path


def _lengths(batches, path, extra):
    ids = WordIds.of(path, HELD)
    for batch in regrouped(batches, most=TOKEN_BYTES * HELD):
        out = np.diff(ids.encode(batch.column(0))[1]) + extra
        yield pa.RecordBatch.from_arrays([pa.array(out)], names=["length"])


def lengths(docs: DataFrame, path: str | None = None, extra: int = 1) -> DataFrame:
    """One row per document: its encoded length, ``extra`` end tokens included."""
    bound_batches(docs.sparkSession)
    path = path or tokenizer_path()
    return docs.select("text").mapInArrow(lambda it: _lengths(it, path, extra), "length long")


def histogram(docs: DataFrame, path: str | None = None, extra: int = 1) -> DataFrame:
    """length, n_docs."""
    return lengths(docs, path, extra).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """Per distinct length L, taken as the context limit: everything a planner asks of it.

    n_docs, tokens: documents of exactly L and their tokens; docs_longer and
    tokens_longer: of more than L; quantile: share of documents of at most L;
    truncated_total: tokens left when every document is cut at L;
    tokens_lost: what that cut drops.
    """
    h = hist.withColumn("tokens", F.col("length") * F.col("n_docs"))
    down = Window.partitionBy().orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    h = h.select(
        "length",
        "n_docs",
        "tokens",
        F.coalesce(F.sum("n_docs").over(down), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum("tokens").over(down), F.lit(0)).alias("tokens_longer"),
        F.sum("n_docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    lost = F.col("tokens_longer") - F.col("length") * F.col("docs_longer")
    return h.select(
        "length", "n_docs", "tokens", "docs_longer", "tokens_longer",
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - lost).alias("truncated_total"),
        lost.alias("tokens_lost"),
    )


def at_limits(answered: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total for any limits, present in the histogram or not: one conditional aggregate a limit."""
    spark = answered.sparkSession
    cut = lambda x: F.sum(F.least(F.col("length"), F.lit(int(x))) * F.col("n_docs"))
    row = answered.agg(*[cut(x).alias(f"at{i}") for i, x in enumerate(limits)]).first()
    return spark.createDataFrame([(int(x), int(row[i] or 0)) for i, x in enumerate(limits)], "limit long, truncated_total long")
