"""Each flag of the version registry changes what the linkage does, or the version is refused."""

import pytest
from pyspark.sql import functions as F

from linkwright.functions import text
from linkwright.operators import decide, models, universe
from linkwright.plans.linkage import Inputs, Linkage
from linkwright.plans.registry import BLOCK, DEFAULT_PRESET, MATCH, PRESETS, Versions, resolve

FAST = models.Learner("logistic", rounds=2, depth=2)


@pytest.fixture(scope="module")
def case(spark):
    """Entities of two countries, the second without roles to fit on; each has a true, a near and a free target."""
    rows, truth, roles, records = [], [], [], []
    for q in range(90):
        country = "a" if q < 60 else "b"
        roles.append((q, "EVAL" if q % 3 == 0 or country == "b" else "REST" if q % 3 == 1 else "FIT"))
        truth.append((q, 1000 + q))
        for k, (t, s) in enumerate([(1000 + q, 0.6 + q % 7 / 20), (1000 + (q + 1) % 90, q % 5 / 10), (2000 + q, 0.3 + q % 11 / 20)]):
            rows.append((q, t, 2 + k % 2, country, s + (0.2 if country == "b" else 0.0), float((q * 7 + k) % 13)))
            records.append((t, country, 2 + k % 2, f"name {t % 17} x{t}", f"{t} road"))
    feats = spark.createDataFrame(rows, "q long, t long, src int, country string, s double, noise double")
    t = spark.createDataFrame(records, "rid long, country string, src int, business_name string, business_address string").dropDuplicates(["rid"])
    x = Inputs(None, None, spark.createDataFrame(truth, "q long, t long"), spark.createDataFrame(roles, "q long, role string"))
    return x, feats.persist(), text.normalize(t).persist()


def p_of(df):
    return {(r.q, r.t): r.p for r in df.collect()}


def test_blend_and_frozen(spark, case, tmp_path):
    versions = lambda match: resolve("M-v6", match=match)
    run = lambda match: p_of(Linkage(spark, f"file://{tmp_path}/run", versions(match), FAST).scores(*case))
    with pytest.raises(FileNotFoundError):
        run("MATCH-v6-frozen-tlu")
    mixed = run("MATCH-v9")
    one = {m: p_of(spark.read.parquet(f"file://{tmp_path}/run/{versions(m).key('scores')}/pairs")) for m in ("MATCH-v6", "MATCH-v8")}
    assert mixed == pytest.approx({k: (v + one["MATCH-v8"][k]) / 2 for k, v in one["MATCH-v6"].items()})
    assert one["MATCH-v6"] != one["MATCH-v8"]
    assert run("MATCH-v6-frozen-tlu") == pytest.approx(one["MATCH-v6"])


def test_shift_and_self_training(spark, case, tmp_path):
    run = lambda match: p_of(Linkage(spark, f"file://{tmp_path}/run", resolve(match=match), FAST).scores(*case))
    plain = run("MATCH-v6")
    assert len(plain) == 270
    for match in ("MATCH-v22", "MATCH-v20", "MATCH-v17"):
        got = run(match)
        assert set(got) == set(plain)
        assert max(abs(got[k] - plain[k]) for k in got) > 1e-4
    x, feats, t = case
    with pytest.raises(ValueError):  # nothing to adapt to
        Linkage(spark, f"file://{tmp_path}/one", resolve(match="MATCH-v22"), FAST).scores(x, feats.filter("country = 'a'"), t)


def test_early_stop_of_scoring_is_refused(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        Linkage(spark, f"file://{tmp_path}/run", resolve(match="MATCH-v4"))


def test_presets_resolve():
    assert resolve("M-v12") == Versions("NORM-v2", "BLK-v5-tlu40", "FEAT-v4", "MATCH-v10")
    assert resolve(DEFAULT_PRESET) == Versions() and resolve("M-v27").feat == "FEAT-v8"
    for name in PRESETS:
        resolve(name)
    for m in MATCH.values():
        assert set(m.blend_of) <= set(MATCH)
    assert BLOCK["BLK-v5-tlu40"].search_from in BLOCK


def test_doubled_distractors(spark):
    """A wrong link to a target nobody owns costs double, one to another entity's target does not."""
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 99, 0.9), (2, 20, 0.9), (2, 30, 0.9)], "q long, t long, p double")
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "q long, t long")
    held = spark.createDataFrame([(1,), (2,)], "q long")
    f = lambda w: decide.grid(pairs, truth.filter("q < 3"), held, [0.5], [], [], w, truth).first()
    of = lambda n: 1.25 / (0.25 + n)
    assert f(1.0).f05 == pytest.approx((of(2) + of(2)) / 2)
    assert f(2.0).f05 == pytest.approx((of(3) + of(2)) / 2) and f(2.0).n_links == 4


def test_text_scores_enter_features(spark, tmp_path):
    rows = [(1, "a", 1, "red house bakery", "1 long road"), (2, "a", 1, "blue mill", "2 short lane")]
    q = spark.createDataFrame(rows, "rid long, country string, src int, business_name string, business_address string")
    t = q.withColumn("rid", F.col("rid") + 10).withColumn("src", F.lit(2))
    cand = spark.createDataFrame([(1, 11, 2, 1.5, False, 0.9, 0.6), (2, 12, 2, 1.4, False, 0.9, 0.5), (1, 12, 2, 0.2, False, 0.1, 0.1)], "q long, t long, src int, bscore double, noaddr_pass boolean, cos_name double, cos_addr double")
    s = spark.createDataFrame([(1, 11, 0.75), (1, 12, 0.25), (2, 99, 0.5)], "q long, t long, p double")
    with pytest.raises(ValueError):
        Linkage(spark, f"file://{tmp_path}/none", resolve(feat="FEAT-v9")).features(text.normalize(q), text.normalize(t), cand)
    plan = Linkage(spark, f"file://{tmp_path}/run", resolve(feat="FEAT-v9"), extra={"ce1": s, "ce2": s})
    got = {(r.q, r.t): r for r in plan.features(text.normalize(q), text.normalize(t), cand).collect()}
    assert (got[1, 11].ce1, got[1, 12].ce2, got[2, 12].ce1) == (0.75, 0.25, None)
    assert got[1, 11].ce1_margin_q == 0.5 and got[1, 12].ce2_rank_q == 2
    less = Linkage(spark, f"file://{tmp_path}/run", resolve(feat="FEAT-v6"), extra={"ce1": s}).features(text.normalize(q), text.normalize(t), cand)
    assert "ce1" in less.columns and "ce1_rank_q" not in less.columns


def test_copies_are_cut_by_pass(spark, tmp_path):
    """A full main list and its copies leave the name-only list alone, and every copy has features."""
    schema = "q long, t long, src int, bscore double, noaddr_pass boolean, cos_name double, cos_addr double"
    rows = [(1, 10 + i, 2, 1.9 - i / 10, False, 0.9, 1.0 - i / 10) for i in range(4)] + [(1, 20 + i, 2, 0.8 - i / 10, True, 0.8 - i / 10, 0.0) for i in range(3)]
    truth = spark.createDataFrame([(1, 11), (1, 21)], "q long, t long")
    cand = spark.createDataFrame(rows, schema)
    copies = universe.distractor_copies(cand.select("t"), truth, 2, 1 << 40)
    got = universe.copy_candidates(cand, copies, 4, 3)
    assert sorted((r.noaddr_pass, r.t % (1 << 40)) for r in got.collect()) == [(False, 10), (False, 10), (False, 11), (False, 12), (True, 20), (True, 20), (True, 21)]
    with pytest.raises(ValueError):
        universe.copy_candidates(cand, copies, 4)
    record = "rid long, country string, src int, business_name string, business_address string"
    q = text.normalize(spark.createDataFrame([(1, "a", 1, "red mill", "1 road")], record))
    t = text.normalize(spark.createDataFrame([(r[1], "a", 2, f"red mill {r[1]}", "1 road") for r in rows], record))
    x = Inputs(None, None, truth, spark.createDataFrame([(1, "EVAL")], "q long, role string"))
    plan = Linkage(spark, f"file://{tmp_path}/run", resolve("M-v7"))
    feats = plan.features(*plan.universe(x, q, t), got)
    assert feats.count() == 7 and feats.filter(F.col("t") >= 1 << 40).count() == 2
