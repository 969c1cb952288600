"""Regions of the search: entities and targets of many groups, and region words listed to the records."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkwright.functions import text
from linkwright.operators import blocks, learn
from linkwright.session import materialise
from linkwright.sources import views


def side(n, groups, **more):
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    return pa.table({"rid": pa.array(range(n), pa.int64()), "ids": lists([[2 * (i % 7)] for i in range(n)], pa.int32()), "n_name": np.ones(n), "n_addr": np.zeros(n), "gs": lists(groups, pa.string()), **more})


def met(q_groups, t_groups, k):
    n = len(t_groups)
    t = side(n, t_groups, src=pa.array([2] * n, pa.int32()), has_addr=pa.array([True] * n), ws=pa.nulls(n, pa.list_(pa.float64())))
    one = {"ids": list(range(0, 14, 2)), "ws": [1.0] * 7}
    t = pa.concat_tables([t, pa.table([pa.array([one.get(f.name)], f.type) for f in t.schema], schema=t.schema)])
    out = pa.schema([("q", pa.int64()), ("t", pa.int64()), ("src", pa.int32()), ("cos_name", pa.float64()), ("cos_addr", pa.float64()), ("second", pa.bool_())])
    got = blocks._best(side(len(q_groups), q_groups), t, out, k, 0, 0.05, 9, (1.0, 1.0))
    return sorted(zip(got.column("q").to_pylist(), got.column("t").to_pylist()))


def test_groups_of_few_and_of_many(monkeypatch):
    rng = np.random.default_rng(5)
    some = lambda most: [f"g{g}" for g in rng.choice(400, rng.integers(0, most), replace=False) ** 2 // 400]
    q, t = [list(dict.fromkeys(some(6))) for _ in range(60)], [list(dict.fromkeys(some(9))) for _ in range(701)]
    q[0], t[0] = ["in no target"], []
    want = [(i, j) for i, a in enumerate(q) for j, b in enumerate(t) if i % 7 == j % 7 and (not a or not b or set(a) & set(b))]
    assert met(q, t, 701) == want


def test_entities_of_many_groups_are_quick():
    """300 entities of 200 groups, each of 16,000 targets: bits are united, no lists of members a pair."""
    groups = [f"g{i}" for i in range(200)]
    began = time.time()
    got = met([groups] * 300, [groups] * 16_000, 3)
    assert got == [(i, i % 7 + 7 * j) for i in range(300) for j in range(3)]
    assert time.time() - began < 15


def test_region_words_travel_to_the_records(spark, sf, monkeypatch):
    x = text.normalize(views.records(spark, sf)).withColumn("country", F.when(F.col("rid") % 50 > 0, F.col("country"))).select("rid", "country", "addr_n").persist()
    keys = materialise(learn.region_keys(x, 0.002, 0.02), "keys")
    got = learn.with_region_words(x, keys)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
    rows = lambda df: sorted((r.rid, *sorted(r.gs or ())) for r in df.collect())
    want, keyed = rows(got), sorted(map(tuple, keys.collect()))
    assert any(len(r) > 2 for r in want) and keyed
    monkeypatch.setattr(learn, "LISTED", -1)
    assert rows(learn.with_region_words(x, keys)) == want
    assert sorted(map(tuple, learn.region_keys(x, 0.002, 0.02).collect())) == keyed
