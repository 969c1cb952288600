"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document in one pass over the text; the ledger
holds the measurements and one bit per failed rule. Versioned policies are masks
over those bits, so applying another policy, or asking what one rule costs, is
bit arithmetic over the ledger and never touches the text again. Ablations group
by the mask first: at most 2^rules rows leave the map side.

Edge cases: null or blank text has no words, so it fails ``few_words``; text of
any length is measured whole; repeated rows each keep a ledger row; an empty
table gives an empty ledger; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import unused
from .common import Codes, bound_batches, forget, utf8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted")
#: (rule, when it fails) over the measures, in whole numbers; the bit is the place in this list.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 60 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "100 * n_shouted > 60 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}
SYMBOLS = b"#*$%&|<>"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def repeated(codes: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(codes) < 4:
        return 0
    top = int(codes.max()) + 1
    if top < 1 << 21:
        windows = (codes[:-2] * top + codes[1:-1]) * top + codes[2:]
    else:
        pairs = np.unique(codes[:-2] * top + codes[1:-1], return_inverse=True)[1]
        windows = pairs * top + codes[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : len(codes) - 2 + k] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text."""
    words = text.split()
    if not words:
        return (0,) * len(MEASURES)
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    points = len(text) - int(counts[128:192].sum()) - int(counts[_SPACE].sum())
    lines, seen, again = 0, set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            again += line in seen
            seen.add(line)
    code = Codes()
    codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    shouted = sum(1 for w in words if w.endswith(b"!!")) if b"!!" in text else 0
    return len(words), points, int(counts[_SYMBOL].sum()), lines, again, repeated(codes), shouted


def _measure(batches, names, drop):
    forget()
    for batch in batches:
        rows = np.array([measure(t) for t in utf8(batch.column(batch.schema.get_field_index("text")))], np.int64).reshape(-1, len(MEASURES))
        kept = [i for i, n in enumerate(batch.schema.names) if n != drop]
        arrays = [batch.column(i) for i in kept] + [pa.array(rows[:, k]) for k in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + list(names))


def measured(docs: DataFrame, names: list[str], keep_text: bool) -> DataFrame:
    """The documents' columns and MEASURES, by the given names."""
    bound_batches(docs.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != "text"]
    return docs.mapInArrow(lambda it: _measure(it, names, None if keep_text else "text"), ", ".join([*fields, *[f"`{n}` long" for n in names]]))


def bits(names: list[str]) -> Column:
    """The failure bits of every rule, from columns that hold MEASURES by the given names."""
    column = dict(zip(MEASURES, names))
    failed = F.lit(0)
    for name, when in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(re.sub(r"[a-z_]+", lambda m: f"`{column[m[0]]}`", when)), bit(name)).otherwise(0))
    return failed.cast("int")


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, MEASURES and ``failed``: the bits of the rules that the document fails."""
    return measured(docs.select(key, "text"), list(MEASURES), False).withColumn("failed", bits(list(MEASURES)))


def passes(policy: str, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(mask(policy)) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only: documents that fail it, and that pass the policy once this rule is left out."""
    groups = book.groupBy(F.col("failed").bitwiseAND(mask(policy)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in POLICIES[policy]])
    each = groups.select("bits", "n", F.explode(rules).alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def filtered(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that pass, with the columns they came with: the policy's mask over the ledger's bits. Row-local: nothing is shuffled."""
    names = unused(docs.columns, *MEASURES)
    return measured(docs, names, True).filter(passes(policy, bits(names))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
), l AS (
  SELECT rid, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         CASE WHEN len(words) = 0 THEN 0 ELSE length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) END::BIGINT AS n_symbols,
         coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: ends_with(x, '!!')))::BIGINT AS n_shouted
  FROM w LEFT JOIN l USING (rid) LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 60 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 100 * n_shouted > 60 * n_words) AS kept
FROM b
"""
