"""The corpus pipeline: documents -> packed sequences.

Each stage reads all that the one before kept, as written, and gives documents in
the columns they came with; the last gives the pieces of sequences.

Every stage takes null ids, texts and sources, empty and very long texts, repeated
rows, an empty table (which stays empty) and further columns of any name, which
come out as they went in. What each does with them:

- quality_classifier: null and empty texts get the score of a text that says
  nothing; repeated rows are judged alike; without labels of both classes all stay.
- quality_rules: null and empty texts have too few words and go.
- near_duplicates: texts without words link with nothing and stay; of repeated rows
  one stays, the first by its other columns; ties go to the smaller doc_id, null last.
- source_mixing: a null source is one of its own; null texts have no words; rows
  with equal doc_id and text share their draw.
- best_fit_packing: null text is the end token alone; every row is packed, repeated
  ones as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import jaccard, mixing, packing, quality, rules
from linkwright.session import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.5 or more."""
    return quality.filtered(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ledger bits pass policy v2."""
    return rules.filtered(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 word 5-gram Jaccard similarity hold together."""
    return jaccard.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in a sequence."""
    return packing.pack(docs, held=60_000)  # beside what earlier stages leave in an executor's memory


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL has neither the compression classifier nor the tokenizer; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None
