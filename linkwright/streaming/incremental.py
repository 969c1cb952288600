"""Arriving targets against a static entity side (an addition of ours: nothing in the linkage itself is a stream).

Only rules that look at one pair are exact on a stream; exclusive assignment needs
all targets and belongs to the batch plan. A checkpoint location makes a restarted
stream go on where it stopped; batches are written by their number, so a repeated
batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize
from ..operators.search import Search, features, top, unit, weights
from ..session import materialise


class EntitySide:
    """An entity side prepared once: weights of its features against a reference set of targets, and unit vectors."""

    def __init__(self, q: DataFrame, reference: DataFrame, how: Search = Search()):
        self.how = how
        idf = weights(features(reference, how, ["rid", "country", "src"]), reference, how)
        self.idf = materialise(idf, "stream-idf")
        qf = features(q, how, ["rid", "country"]).join(self.idf, ["country", "feat"])
        self.q = materialise(unit(qf, ["rid", "src"], how).select("country", "src", "feat", F.col("rid").alias("q"), F.col("w").alias("wq")), "stream-entities")

    def search(self, targets: DataFrame) -> DataFrame:
        """q, t, src, bscore of the best k per entity and source among these targets."""
        tf = features(targets, self.how, ["rid", "country", "src"]).join(self.idf, ["country", "src", "feat"])
        tw = unit(tf, ["rid"], self.how).select("country", "src", "feat", F.col("rid").alias("t"), F.col("w").alias("wt"))
        scored = self.q.join(tw, ["country", "src", "feat"]).groupBy("q", "t", "src").agg(F.sum(F.col("wq") * F.col("wt")).alias("bscore"))
        return top(scored.filter(F.col("bscore") > self.how.least), self.how.k)


def link_stream(stream: DataFrame, side: EntitySide, out: str, checkpoint: str, least: float = 0.5, **trigger) -> StreamingQuery:
    """Raw target records in, links of at least ``least`` out, as Parquet partitioned by batch."""

    def batch(df: DataFrame, number: int) -> None:
        links = side.search(normalize(df)).filter(F.col("bscore") >= least)
        links.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
