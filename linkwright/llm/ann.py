"""Approximate nearest neighbours by learned partitions.

Fit, on a sample that grows with the table up to a bound: the sample's neighbour
graph is cut into balanced parts (bisection along principal directions, then moves
of nodes to the part that holds most of their neighbours, within a capacity); a
small two-layer classifier learns which parts hold a vector's neighbours. Index:
every row goes to its most probable part. Search: a query goes to its most probable
parts until they hold ``mass`` of the probability and at least k + 1 rows; the rows
there are reranked by exact inner products in double precision.

A part is cut into shards of at most ``shard`` rows, by its counted size, so a part
that holds a third of all rows becomes many tasks. Each row is shuffled once, to its
shard; queries come to the shards of their parts, behind the rows, and are scored as
they stream past, so a task holds one shard and one batch of queries. Each shard
returns k rows a query, and the merge sees only those.

Vectors of different lengths have no inner product: each length is searched by
itself, those of few rows in one part.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; ties go to the smaller vec_id; repeated rows of a vec_id
count once (of different vectors, the better score); fewer than k candidates return
all found; a query alone in its length returns nothing; an empty table gives an
empty result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches

#: Least and most rows of the sample (in between, SAMPLE_ROOT times the root of all rows); sampled rows of a part; neighbours of a node; probability that a query's parts hold; rows of a shard.
SAMPLE, MOST_SAMPLE, SAMPLE_ROOT, PART_ROWS, NEIGHBOURS, MASS, SHARD = 8_192, 65_536, 8, 256, 16, 0.975, 32_768
#: A part's name is its vectors' length times this, plus its number.
LENGTH = 1 << 20


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))


def graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Indices of the k nearest rows by inner product, without the row itself."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15) -> np.ndarray:
    """Part of each node: balanced bisection first, then capacity-bound moves that keep neighbours together."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        v = y[0] + 1e-9
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-30
        left = n // 2
        order = rows[np.argsort(y @ v, kind="stable")]
        cut = len(rows) * left // n
        todo += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    capacity = int(slack * len(x) / parts) + 1
    back = np.concatenate([near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])])
    here = np.concatenate([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()])
    for _ in range(rounds):
        votes = np.bincount(here * parts + part[back], minlength=len(x) * parts).reshape(len(x), parts)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < capacity:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def _layers(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(0, x @ model["w1"] + model["b1"])
    z = hidden @ model["w2"] + model["b2"]
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return hidden, e / e.sum(1, keepdims=True)


def probabilities(v: np.ndarray, model: dict) -> np.ndarray:
    x = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-300)
    return _layers(x, model)[1]


def fit(vectors: np.ndarray, part_rows: int = PART_ROWS, neighbours: int = NEIGHBOURS, hidden: int = 128, epochs: int = 60, seed: int = 7) -> dict:
    """The router: weights of a classifier over the parts of the sample's neighbour graph."""
    d = vectors.shape[1]
    parts = max(1, len(vectors) // part_rows)
    rng = np.random.default_rng(seed)
    if parts < 2:
        return {"w1": np.zeros((d, 1)), "b1": np.zeros(1), "w2": np.zeros((1, 1)), "b2": np.zeros(1), "parts": 1}
    x = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-300)
    near = graph(vectors, neighbours)
    part = balanced(x, near, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    soft[np.arange(len(x)), part] += 1 + near.shape[1] / 4
    soft /= soft.sum(1, keepdims=True)
    m = {"w1": rng.normal(0, (2 / d) ** 0.5, (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), "b2": np.zeros(parts)}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(x), 256):
            b = order[i : i + 256]
            h, p = _layers(x[b], m)
            dz = (p - soft[b]) / len(b)
            dh = (dz @ m["w2"].T) * (h > 0)
            step += 1
            for k, g in (("w1", x[b].T @ dh), ("b1", dh.sum(0)), ("w2", h.T @ dz), ("b2", dz.sum(0))):
                a, s = state[k]
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                m[k] = m[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return m | {"parts": parts}


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _by_length(batch):
    """(length, rows of the batch that have it, their vectors)."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = pa.array(np.nonzero(sizes == d)[0])
        part = batch.take(at)
        yield int(d), part, matrix(part.column(1), int(d))


def _assign(batches, models):
    for batch in batches:
        for d, part, v in _by_length(batch):
            number = probabilities(v, models[d]).argmax(1) if d in models else np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(number.astype(np.int64) + d * LENGTH)], names=["vec_id", "embedding", "part"])


def _route(batches, models, sizes, mass, least):
    for batch in batches:
        for d, part, v in _by_length(batch):
            if d not in models:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(v), d * LENGTH))], names=["vec_id", "embedding", "part"])
                continue
            p = probabilities(v, models[d])
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
            rows = np.cumsum(sizes[d][order], 1) - sizes[d][order]
            go = (before < mass) | (rows < least)
            at = pa.array(np.nonzero(go)[0])
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(order[go].astype(np.int64) + d * LENGTH)], names=["vec_id", "embedding", "part"])


def rerank(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best rows (sorted by id); products are recomputed pair by pair, so equal vectors tie exactly."""
    out: list[tuple] = []
    step = max(1, (1 << 22) // max(1, len(rows)))
    spare = len(row_ids) - len(np.unique(row_ids))  # a repeated id counts once
    for i in range(0, len(queries), step):
        s = queries[i : i + step] @ rows.T
        for j, line in enumerate(s):
            line[np.searchsorted(row_ids, query_ids[i + j]) : np.searchsorted(row_ids, query_ids[i + j], "right")] = -np.inf
            n = min(k + spare, int((line > -np.inf).sum()))
            if not n:
                continue
            least = np.partition(line, len(line) - n)[len(line) - n]
            at = np.nonzero(line >= least - 1e-9 * max(1.0, abs(least)))[0]
            exact = (rows[at] * queries[i + j]).sum(1)
            # of a repeated id the better score
            best = np.lexsort((row_ids[at], -exact))
            best = best[np.sort(np.unique(row_ids[at][best], return_index=True)[1])][:k]
            out.append((np.full(len(best), query_ids[i + j]), row_ids[at[best]], exact[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(batches, k):
    """Of rows sorted by part, shard and kind (0: rows of the index, 1: queries): each query's k best of its shard."""
    here, held, ready = None, [], None
    for batch in batches:
        part, shard, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        cuts = np.concatenate([[0], np.nonzero((part[1:] != part[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]))[0] + 1, [len(part)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if (part[a], shard[a]) != here:
                here, held, ready = (part[a], shard[a]), [], None
            v = matrix(batch.column(4).slice(a, b - a), int(part[a]) // LENGTH)
            if not kind[a]:
                held.append((v, ids[a:b]))
                continue
            if ready is None and held:
                rows, row_ids = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(row_ids, kind="stable")
                rows, row_ids, held = rows[order], row_ids[order], []
                if (row_ids[1:] == row_ids[:-1]).any():  # repeated rows
                    once = np.sort(np.unique(np.c_[row_ids.astype(float), rows], axis=0, return_index=True)[1])
                    rows, row_ids = rows[once], row_ids[once]
                ready = rows, row_ids
            if ready is not None:
                got = rerank(v, ids[a:b], *ready, k)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2])], names=["query_id", "vec_id", "score"])


def search(base: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, mass: float = MASS, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``base`` found for each row of ``queries`` (both vec_id, embedding)."""
    spark = base.sparkSession
    bound_batches(spark, 4_096)
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, asked = pick(base), pick(queries)
    lengths = {r.d: r.n for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a vector length
    models, numbers = {}, {d: 1 for d in lengths}
    for d, n in lengths.items():
        size = int(min(MOST_SAMPLE, max(sample, SAMPLE_ROOT * n**0.5)))
        if n >= 2 * PART_ROWS:
            few = rows.filter(F.size("embedding") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
            models[d] = fit(matrix(few.column("embedding").combine_chunks(), d))
            numbers[d] = models[d]["parts"]
    assigned = materialise(rows.mapInArrow(lambda it: _assign(it, models), "vec_id long, embedding array<double>, part long"), "ann-index")
    counted = {r.part: r.n for r in assigned.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
    sizes = {d: np.array([counted.get(d * LENGTH + p, 0) for p in range(numbers[d])], np.int64) for d in lengths}
    unique = asked.filter(F.size("embedding").isin(list(lengths) or [-1])).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    routed = unique.mapInArrow(lambda it: _route(it, models, sizes, mass, k + 1), "vec_id long, embedding array<double>, part long")
    cuts = spark.createDataFrame([(p, -(-n // shard)) for p, n in counted.items()], "_part long, shards long")
    cut = lambda df: df.join(F.broadcast(cuts), F.col("part") == F.col("_part"))  # noqa: E731  a row a part: MOST_SAMPLE / PART_ROWS a length
    left = cut(assigned).select("part", F.pmod(F.xxhash64("vec_id"), "shards").alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding")
    right = cut(routed).select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding")
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = left.unionByName(right).repartition(slots, "part", "shard").sortWithinPartitions("part", "shard", "kind")
    found = dealt.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score double")
    # a vec_id with different vectors can sit in two parts: its best score counts
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
