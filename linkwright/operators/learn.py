"""Lookup tables learned from links and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import similarity
from ..functions.text import tokens
from ..session import is_small, materialise


def learn_aliases(links: DataFrame, q_tokens: str = "q_tokens", t_tokens: str = "t_tokens", min_count: int = 25, min_ratio: float = 0.5, max_unaligned: int = 4) -> DataFrame:
    """country, tok, to, n, ratio from true links with both sides' token arrays and the country.

    Tokens of one side only are array differences within a link, so links are never
    joined with themselves. Among words that meet a token often enough the one
    spelt most alike wins; ties go to the smaller word.
    """
    a, b = F.array_distinct(q_tokens), F.array_distinct(t_tokens)
    x = links.select("country", a.alias("a"), b.alias("b"))
    own, other = F.array_except("a", "b"), F.array_except("b", "a")
    few = x.withColumns({"ua": own, "ub": other}).filter(F.size("ua").between(1, max_unaligned) & F.size("ub").between(1, max_unaligned))
    co = few.select("country", F.explode("ub").alias("tok"), "ua").select("country", "tok", F.explode("ua").alias("to"))
    n = co.groupBy("country", "tok", "to").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    n = n.withColumn("score", F.col("n") * (1 + F.round(similarity("jaro_winkler", F.col("tok"), F.col("to")), 6)))
    best = n.withColumn("_r", F.row_number().over(Window.partitionBy("country", "tok").orderBy(F.col("score").desc(), "to"))).filter("_r = 1")
    occ = x.select("country", F.explode("b").alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("occ"))
    q_occ = x.select("country", F.explode("a").alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("q_occ"))
    got = best.join(occ, ["country", "tok"]).join(q_occ, ["country", "tok"], "left").withColumn("ratio", F.col("n") / F.col("occ"))
    return got.filter((F.col("ratio") >= min_ratio) & (F.col("tok") != F.col("to")) & (F.coalesce("q_occ", F.lit(0)) < 0.25 * F.col("occ"))).select("country", "tok", "to", "n", "ratio")


def region_keys(records: DataFrame, min_share: float = 0.002, min_last_ratio: float = 0.6, addr: str = "addr_n") -> DataFrame:
    """country, k: words that often end an address and seldom stand elsewhere."""
    toks = tokens(F.col(addr))
    x = records.select("country", addr, toks.alias("toks")).filter(F.size("toks") > 0)
    last = x.groupBy("country", F.element_at("toks", -1).alias("k")).agg(F.count(F.lit(1)).alias("n_last"))
    n = records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))  # a row a country
    # only words that end enough addresses are looked for in all of them
    last = materialise(last.join(F.broadcast(n), "country").filter(F.col("n_last") >= min_share * F.col("n")), "last-words")
    words = _listed(x, last, addr) if is_small(last, LISTED) else x.withColumn("gs", F.array_distinct("toks"))
    anywhere = words.select("country", F.explode("gs").alias("k")).groupBy("country", "k").agg(F.count(F.lit(1)).alias("n_any"))
    return last.join(anywhere, ["country", "k"]).filter(F.col("n_last") >= min_last_ratio * F.col("n_any")).select("country", "k")


def record_keys(records: DataFrame, keys: DataFrame, rid: str = "rid", addr: str = "addr_n") -> DataFrame:
    """rid, country, k: the region words anywhere in a record's address."""
    return records.select(rid, "country", F.explode(F.array_distinct(tokens(F.col(addr)))).alias("k")).join(keys, ["country", "k"], "left_semi")


def with_region_words(records: DataFrame, keys: DataFrame, addr: str = "addr_n") -> DataFrame:
    """Adds gs: the region words anywhere in a record's address; null or empty without any.

    Keys (country, k; materialised) that are few, as a share of the last words leaves them, travel to the records as
    a list a country, so no word of a text and no record is shuffled; others are joined.
    """
    if is_small(keys, LISTED):
        return _listed(records, keys, addr)
    found = record_keys(records, keys, addr=addr).groupBy("rid").agg(F.collect_set("k").alias("gs"))
    return records.join(found, "rid", "left")


def _listed(records: DataFrame, keys: DataFrame, addr: str) -> DataFrame:
    lists = F.broadcast(keys.groupBy("country").agg(F.collect_set("k").alias("_ks")))
    return records.join(lists, "country", "left").withColumn("gs", F.array_intersect(tokens(F.col(addr)), F.col("_ks"))).drop("_ks")


#: Region words, of all countries, that are listed to every task.
LISTED = 20_000


def region_merges(links: DataFrame, q_keys: DataFrame, t_keys: DataFrame, min_cross: int = 10) -> DataFrame:
    """country, kq, kt, n: keys that links cross although the two records share none."""
    q = q_keys.groupBy(F.col("rid").alias("q"), "country").agg(F.collect_set("k").alias("ks"))
    t = t_keys.groupBy(F.col("rid").alias("t")).agg(F.collect_set("k").alias("kt_all"))
    x = links.select("q", "t").join(q, "q").join(t, "t").filter(~F.arrays_overlap("ks", "kt_all"))
    each = x.select("country", F.explode("ks").alias("kq"), "kt_all").select("country", "kq", F.explode("kt_all").alias("kt"))
    return each.groupBy("country", "kq", "kt").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cross)


def merged_groups(keys: DataFrame, merges: DataFrame, rounds: int = 30) -> DataFrame:
    """country, k, g: each key's group after merges; the group is named by its smallest key.

    Labels run along merges until none changes: a join and an aggregate a round.
    """
    edges = merges.select("country", F.col("kq").alias("k"), F.col("kt").alias("o"))
    edges = materialise(edges.union(merges.select("country", F.col("kt").alias("k"), F.col("kq").alias("o"))).distinct(), "region-edges")
    label = materialise(keys.select("country", "k", F.col("k").alias("g")), "region-labels")
    for _ in range(rounds):
        seen = edges.join(label.select("country", F.col("k").alias("o"), F.col("g").alias("og")), ["country", "o"])
        least = seen.groupBy("country", "k").agg(F.min("og").alias("m"))
        new = label.join(least, ["country", "k"], "left").select("country", "k", F.least("g", F.coalesce("m", "g")).alias("g"))
        new = materialise(new, "region-labels")
        changed = new.join(label, ["country", "k", "g"], "left_anti").isEmpty()
        label = new
        if changed:
            break
    return label


def frequent_tokens(records: list[DataFrame], column: str, share: float = 0.01, keep_numbers: bool = False) -> DataFrame:
    """country, tok: tokens in more than a share of a country's records, over all frames."""
    from .decide import union_all

    x = union_all([r.select("country", tokens(F.col(column)).alias("toks")) for r in records])
    n = x.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = x.select("country", F.explode(F.array_distinct("toks")).alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))
    got = df.join(n, "country").filter(F.col("df") > share * F.col("n"))
    return (got.filter(~F.col("tok").rlike(r"^\d+[a-z]?$")) if keep_numbers else got).select("country", "tok")


def name_idf(records: DataFrame, column: str = "name_core") -> DataFrame:
    """country, tok, idf = ln(n / df) over one side's names."""
    n = records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = records.select("country", F.explode(F.array_distinct(tokens(F.col(column)))).alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "country").select("country", "tok", F.log(F.col("n") / F.col("df")).alias("idf"))


