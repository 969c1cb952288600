"""The queries of this subpackage: thin views of its operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, chat, html, jaccard, lengths, mixing, packing, quality, rules, warc


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~quality.trainable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transcripts of all conversations, in mixed marker styles and a quarter of the turns without any, and the turns recovered from them."""
    talks = table(spark, sf_dir, "conversations")
    line = chat.written()
    model = chat.learn(chat.runs(talks.filter(chat.trainable()), line))
    return chat.recover(talks, model, line)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents"))
    base = ~rules.passes("base")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rules.passes("v2").alias("kept")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.answers(lengths.histogram(table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return ann.search(base, base.filter(F.col("vec_id") % 20 == 0))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_mixing,
        op3_chat_formatting,
        op4_quality_rules,
        op5_warc,
        op6_ngram_jaccard,
        op7_packing,
        op8_token_counts,
        op9_html_extraction,
        op10_nearest_neighbours,
    )
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op4_quality_rules": rules.ORACLE,
    "op6_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), g AS (
  SELECT rid, doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w
), s AS (
  SELECT rid, len(grams) AS n, unnest(grams) AS gram FROM g
), p AS (
  SELECT a.rid AS x, b.rid AS y, a.n AS n, b.n AS m, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.rid < b.rid GROUP BY 1, 2, 3, 4
), e AS (
  SELECT x AS a, y AS b FROM p WHERE 100 * c >= 80 * (n + m - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= 80 * (n + m - c)
), r(rid, other) AS (
  SELECT rid, rid FROM g UNION SELECT r.rid, e.b FROM r JOIN e ON r.other = e.a
)
SELECT g.doc_id, len(g.grams)::BIGINT AS n_shingles, c.component_id
FROM g JOIN (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN g o ON o.rid = r.other GROUP BY r.rid) c USING (rid)
""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
""",
}
