"""Facts and invariants of single operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwright.functions import kernels, text
from linkwright.operators import context, decide, features, metrics, models, search
from linkwright.plans.linkage import Inputs, Linkage
from linkwright.plans.registry import BLOCK, FEAT, MATCH, PRESETS, Versions, resolve
from linkwright.sources import records as rec
from linkwright.sources import views


def one(spark, e):
    return spark.range(1).select(e).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [("c0rporation", "corp"), ("5ummit", "summit"), ("malna6ers", "malnagers"), ("3m", "3m"), ("24x7", "24x7"), ("1st", "1st"), ("svcs", "services")],
)
def test_token_fix(spark, raw, want):
    assert one(spark, text.fix_name_token(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("3rd Road 017", "3 road 17"), ("P.O. Box 12, n/a", "pobox 12"), ("Jammu and Kashmir", "jammukashmir"), (None, ""), ("12b Élan", "12 b elan")])
def test_clean_address(spark, raw, want):
    assert one(spark, text.clean_address(F.lit(raw).cast("string"))) == want


def test_clean_names(spark):
    df = spark.createDataFrame([(1, "Acme & Sons (ID: 83039)"), (2, "https://www.big-shop.com"), (3, "New Co formerly known as Old Co"), (4, None), (5, "")], "rid int, business_name string")
    got = {r.rid: r for r in text.clean_names(df).collect()}
    assert got[1].name_c == "acme and sons"
    assert got[2].is_web and got[2].name_c == "big shop"
    assert (got[3].has_alias, got[3].name_pre_c, got[3].name_post_c) == (True, "new co", "old co")
    assert got[4].name_c == got[5].name_c == ""


def test_normalise_is_idempotent(spark, sf):
    x = text.normalize(views.records(spark, sf))
    again = text.normalize(x.select("rid", "country", "src", F.col("name_n").alias("business_name"), F.col("addr_n").alias("business_address")))
    both = x.select("rid", F.col("name_n").alias("a")).join(again.select("rid", F.col("name_n").alias("b"), "has_alias"), "rid")
    assert both.filter("a <> b and not has_alias").count() == 0


def test_spelled(spark):
    assert text.spell("नमस्ते") == "namaste"
    df = spark.createDataFrame([("नमस्ते",), ("Café",), ("plain",), (None,)], "n string")
    assert [r.n for r in df.select(text.ascii_of(F.col("n")).alias("n")).orderBy("n").collect()] == ["", "Cafe", "namaste", "plain"]


words = st.text(alphabet="abcd ", max_size=14)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_kernels(a, b):
    assert kernels.lcs(a, b) == slow_lcs(a, b)
    for name, f in kernels.KERNELS.items():
        top = 1.0 if name == "jaro_winkler" else 100.0
        assert 0 <= f(a, b) <= top + 1e-9
        assert f(a, a) == pytest.approx(top)
        if name != "jaro_winkler":
            assert f(a, b) == pytest.approx(f(b, a))


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_jaro_winkler(a, b):
    import duckdb

    if not a and not b:
        return  # two empty strings are alike here
    want = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    assert kernels.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9)


def test_costs(spark):
    fp = [round(one(spark, decide.fp_cost(F.lit(k))), 4) for k in (0, 1, 2, 5)]
    fn = [round(one(spark, decide.fn_cost(F.lit(k))), 4) for k in (1, 2, 5)]
    assert fp == [1, 0.4444, 0.2857, 0.1379] and fn == [1, 0.1667, 0.0476]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "q long, t long, p double")


def test_expected_f_keeps_certain_link(spark):
    assert decide.expected_f(pairs(spark, [(1, 1, 1.0)]), 0.05).count() == 1
    assert decide.expected_f(pairs(spark, [(1, 1, 0.06)]), 0.05).count() == 0
    assert decide.expected_f(pairs(spark, []), 0.05).count() == 0


def test_exclusive_ties(spark):
    df = pairs(spark, [(1, 7, 0.5), (2, 7, 0.5), (3, 7, 0.4)])
    assert {r.q for r in decide.exclusive(df).collect()} == {1, 2}
    assert {r.q for r in decide.exclusive(df, tie="first").collect()} == {1}


@pytest.mark.parametrize("pred, true, want", [([1, 2, 3], [1, 2], 0.714), ([], [], 1.0), ([1], [], 0.0), ([], [1], 0.0)])
def test_macro_f05(spark, pred, true, want):
    ent = spark.createDataFrame([(1,)], "q long")
    link = lambda ts: spark.createDataFrame([(1, t) for t in ts], "q long, t long")
    assert metrics.macro_f05(link(pred), link(true), ent).first().f05 == pytest.approx(want, abs=1e-3)
    assert metrics.macro_f05_closed(link(pred), link(true), ent, 1.0).first().f05 == pytest.approx(want, abs=1e-3)


def test_grid_agrees_with_single_rules(spark, sf):
    x, truth, ent = views.scored(spark, sf), views.truth_of(spark, sf), views.entities(spark, sf)
    table = {(r.rule, r.value): r for r in decide.grid(x, truth, ent).collect()}
    for rule, value in (("threshold", 0.5), ("expected", 0.1), ("gated", 0.5)):
        links = decide.decide(x, rule, value)
        assert table[rule, value].n_links == links.count()
        assert table[rule, value].f05 == pytest.approx(metrics.macro_f05(links, truth, ent).first().f05)


def test_search_invariants(spark, sf):
    x = text.normalize(views.records(spark, sf)).persist()
    q, t = x.filter("src = 1"), x.filter("src > 1")
    how = search.Search(k=5, k_noaddr=2, min_df_cap=20, max_df_frac=0.05)
    got = search.generate_candidates(q, t, how).persist()
    assert got.groupBy("q", "src", "noaddr_pass").count().filter("count > 5").count() == 0
    assert got.groupBy("q", "t").count().filter("count > 1").count() == 0
    assert got.filter("not noaddr_pass and abs(bscore - cos_name - cos_addr) > 1e-9").count() == 0
    groups = lambda r: r.select("rid", "country", F.array(F.substring("name_nosp", 1, 1)).alias("gs"))
    less = search.generate_candidates(q, t, search.Search(k=10**6, k_noaddr=0, min_df_cap=20, max_df_frac=0.05), (groups(q), groups(t), q.select("country").distinct()))
    every = search.generate_candidates(q, t, search.Search(k=10**6, k_noaddr=0, min_df_cap=20, max_df_frac=0.05))
    assert less.join(every, ["q", "t"], "left_anti").count() == 0
    assert less.count() < every.count()


def test_number_variants(spark):
    assert sorted(one(spark, search.number_variants(F.array(F.lit("7530"), F.lit("12"))))) == ["#p:753", "#s:530"]
    assert one(spark, search.skeleton(F.lit("balloon"))) == "bln"
    assert one(spark, search.char_grams(F.lit("ab"))) == ["g:^ab", "g:ab$"]
    assert one(spark, search.char_grams(F.lit(""))) == []


def test_cross_fit_never_scores_its_own_fold(spark):
    rows = spark.createDataFrame([(i, i, float(i % 7), int(i % 7 > 3), "FIT") for i in range(300)], "q long, t long, s double, y int, role string")
    cf = models.cross_fit(rows, ["s"], models.Learner("logistic"), 3)
    got = cf.transform(rows).withColumn("fold", models.fold_of(F.col("q"), 3))
    assert got.groupBy("fold").count().count() == 3
    for f, m in enumerate(cf.models):
        own = models.score(m, got.filter(F.col("fold") == f), ["s"], "again")
        assert own.filter("abs(again - p1) > 1e-9").count() == 0


def test_tsv_and_lists(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-2\tA "B\t\tus\nS1-1\tC\tx\tus\n')
    df = rec.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert [(r.business_name, r.business_address) for r in df.orderBy("entity_id").collect()] == [("C", "x"), ('A "B', None)]
    assert [r.rid for r in rec.with_rid(df).orderBy("entity_id").collect()] == [0, 1]
    links = spark.createDataFrame([("S1-1", "S2-9"), ("S1-1", "S2-1"), ("S1-1", "S2-9")], "q string, t string")
    lists = rec.match_lists(links, df.select(F.col("entity_id").alias("q")))
    assert {r.q: r.matched_entity_ids for r in lists.collect()} == {"S1-1": "S2-1,S2-9", "S1-2": ""}
    rec.write_lists(lists, str(tmp_path / "out"))
    back = rec.load_truth(spark, str(tmp_path / "out"))
    assert sorted((r.q, r.t) for r in back.collect()) == [("S1-1", "S2-1"), ("S1-1", "S2-9")]


def test_validator(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    tar = spark.createDataFrame([("S2-1",), ("S3-1",)], "id string")
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-5,S2-7"), ("S1-9", "S3-1")], "source1_entity_id string, matched_entity_ids string")
    got = {r.check: r.offenders for r in rec.validate(bad, ids, tar, tar.select(F.lit("S1-1").alias("q"), F.col("id").alias("t"))).collect()}
    assert got == {"duplicate_row": 1, "duplicate_id_in_list": 1, "wrong_prefix": 1, "unknown_id": 1, "missing_entity": 1, "extra_entity": 1, "match_not_candidate": 3}


def test_registry():
    assert resolve("M-v11").block == "BLK-v5-tlu40"
    assert Versions().key("block") != resolve(block="BLK-v1").key("block")
    assert Versions().key("prep") == resolve(block="BLK-v1").key("prep")
    assert all(v.block in BLOCK and v.feat in FEAT and v.match in MATCH for v in PRESETS.values())
    with pytest.raises(KeyError):
        resolve(feat="FEAT-v99")


@pytest.fixture(scope="module")
def inputs(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    x = part.select(
        F.col("p_partkey").alias("rid"),
        F.lit("all").alias("country"),
        F.when(F.col("p_type") == "ECONOMY", 1).otherwise(2 + F.col("p_partkey") % 2).cast("int").alias("src"),
        F.concat_ws(" ", "p_name", "p_brand").alias("business_name"),
        F.concat_ws(" ", "p_size", "p_brand").alias("business_address"),
    )
    # every entity has two targets: a copy, and one with another number
    q = x.filter("src = 1")
    t = q.withColumn("rid", F.col("rid") + 1000).withColumn("src", F.lit(2)).unionByName(
        q.withColumn("rid", F.col("rid") + 2000).withColumn("src", F.lit(3)).withColumn("business_name", F.concat("business_name", F.lit(" ltd")))
    )
    truth = q.select(F.col("rid").alias("q"), F.explode(F.array(F.col("rid") + 1000, F.col("rid") + 2000)).alias("t"))
    roles = q.select(F.col("rid").alias("q"), F.when(F.col("rid") % 3 == 0, "EVAL").otherwise("FIT").alias("role"))
    return Inputs(q, t.unionByName(x.filter("src > 1")), truth, roles)


def test_linkage_end_to_end(spark, inputs, tmp_path):
    plan = Linkage(spark, f"file://{tmp_path}/run", resolve(block="BLK-v4b@20", feat="FEAT-v2", match="MATCH-v2"), models.Learner("logistic"))
    got = plan.run(inputs)
    q = got["quality"].first()
    assert q.f05 > 0.6 and got["recall"].first().pair_recall > 0.9
    again = Linkage(spark, f"file://{tmp_path}/run", plan.v, plan.learner)
    assert again.run(inputs)["links"].count() == got["links"].count()
    with pytest.raises(ValueError):
        Linkage(spark, f"file://{tmp_path}/run", plan.v, scope="other")


def test_stream(spark, inputs, tmp_path):
    from linkwright.streaming.incremental import EntitySide, link_stream

    how = search.Search(k=5, min_df_cap=20)
    n = text.normalize(inputs.entities), text.normalize(inputs.targets)
    side = EntitySide(*n, how)
    src = str(tmp_path / "in")
    inputs.targets.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(inputs.targets.schema).option("maxFilesPerTrigger", 1).parquet(src)
    link_stream(stream, side, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    # scores are the batch search's, none is under the threshold, and each entity's best target of a source is there
    every = {(r.q, r.t): (r.src, r.bscore) for r in search.products(*n, how).collect()}
    found = {(r.q, r.t): r.bscore for r in got.collect()}
    assert found and all(v >= 0.5 and math.isclose(v, every[k][1], abs_tol=1e-6) for k, v in found.items())
    best = {}
    for (q, t), (source, score) in every.items():
        best[q, source] = max(best.get((q, source), (0.0, 0)), (score, -t))
    assert all((q, -t) in found for (q, _), (score, t) in best.items() if score >= 0.5 + 1e-6)


def test_reports_and_shift(spark):
    """Facts worked out by hand."""
    n = lambda a, b: {k: one(spark, c) for k, c in features.number_agreement(F.array(*map(F.lit, a)) if a else F.array().cast("array<string>"), F.array(*map(F.lit, b))).items()}
    assert n([], ["12"]) == {"num_jacc": -1.0, "num_b_in_a": -1.0, "num_first_in_b": -1.0, "num_trunc": 0.0}
    assert n(["123", "7"], ["12", "7"]) == {"num_jacc": 1 / 3, "num_b_in_a": 0.5, "num_first_in_b": 0.0, "num_trunc": 1.0}
    red = spark.createDataFrame([("a b", "a c", "x y z", "x")], "a_nr string, b_nr string, a_ar string, b_ar string")
    got = features.distinct_features(red).first()
    assert (got.nr_len_a, got.ar_len_a, got.ar_b_in_a) == (2, 3, 1.0)
    idf = spark.createDataFrame([("c", "red", 1.0), ("c", "zzz", 3.0), ("c", "qqq", 2.0)], "country string, tok string, idf double")
    row = features.align_features(spark.createDataFrame([("c", "red zzz qqq", "red")], "country string, a_name_core string, b_name_core string"), idf).first()
    assert (row.al_a_n_unaligned, row.al_a_unaligned_idf, row.al_b_unaligned_idf) == (2.0, 3.0, 0.0)
    pairs = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 1, 0.75), (2, 10, 1, 0.25)], "q long, t long, src int, p double")
    seen = {(r.q, r.t): r for r in context.probability_context(pairs).collect()}
    assert seen[1, 10].n05_q == 1 and seen[2, 10].n05_q == 0 and seen[1, 11].best_other_q == 0.5
    named = text.normalize(spark.createDataFrame([(1, "x", 1, "plain", "é"), (2, "x", 1, "Café", "a"), (3, "x", 1, "नमस्ते Łódź", None)], "rid long, country string, src int, business_name string, business_address string"))
    assert [(r.name_n, r.non_ascii) for r in named.orderBy("rid").collect()] == [("plain", False), ("cafe", True), ("namaste lodz", True)]
    # a country whose scores are two logits too high links as often as the others once they are shifted back
    rows, ents = [], []
    for q in range(200):
        c = "far" if q % 2 else "near"
        p = 1 / (1 + np.exp(-((q // 2) / 10 - 5 + (2 if c == "far" else 0))))
        rows.append((q, 1000 + q, float(p)))
        ents.append((q, c))
    rows, ents = spark.createDataFrame(rows, "q long, t long, p double"), spark.createDataFrame(ents, "q long, country string")
    by = decide.country_shift(rows, ents, "far", "threshold", 0.5, rounds=8)
    assert 1.8 < by < 2.2
    kept = decide.decide_shifted(rows, ents, "far", "threshold", 0.5, by).groupBy("country").count().collect()
    a, b = (r["count"] for r in kept)
    assert abs(a - b) <= 1  # the entity whose shifted score is the threshold itself falls on either side


def test_check_file(spark, tmp_path):
    columns = ["source1_entity_id", "matched_entity_ids"]
    form = lambda s: ((tmp_path / "f.tsv").write_text(s), {r.check: r.offenders for r in rec.check_file(spark, f"file://{tmp_path}/f.tsv", columns).collect()})[1]
    assert form("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n") == {"empty": 0, "comma_separated": 0, "header": 0, "no_tab": 0}
    assert form("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n") == {"empty": 0, "comma_separated": 1, "header": 1, "no_tab": 1}
    assert form("")["empty"] == 1
    lists = spark.createDataFrame([("S1-1", "S2-1,S1-2,S4-1")], "source1_entity_id string, matched_entity_ids string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.check: r.offenders for r in rec.validate(lists, ids("S1-1"), ids("S2-1")).collect()}
    assert got["self_match"] == 1 and got["wrong_prefix"] == 1 and got["unknown_id"] == 0


def test_holders_by_key(spark):
    texts = spark.createDataFrame([(1, "one two three four five"), (2, "two three"), (3, ""), (4, None)], "t long, text string")
    passages = spark.createDataFrame([(1, "two three"), (2, "e"), (3, ""), (4, None), (5, "three four five")], "q long, passage string")
    want = {(1, 1), (1, 2), (2, 1), (2, 2), (5, 1)}
    for few in (1000, 0):
        assert {tuple(r) for r in search.holders(passages, texts, few=few).select("q", "t").collect()} == want


def test_dense_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "a" if i % 3 else "b", [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    x = spark.createDataFrame(rows, "id long, country string, v array<double>")
    few, many = (sorted(map(tuple, search.dense_topk(x, x, 4, rows=n).select("id", "other", "rank").collect())) for n in (1000, 11))
    assert few == many and len(few) == 360


def test_command_line(spark, tmp_path):
    from linkwright import __main__ as command

    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for i in (1, 2, 3):
        (tmp_path / f"train_source{i}.tsv").write_text(head + "".join(f"S{i}-{k}\tred mill {k}\t{k} road\tUS\n" for k in range(12)))
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{k}\tS2-{k},S3-{k}\n" for k in range(12)))
    x, q, t = command.inputs(spark, f"file://{tmp_path}")
    assert x.truth.count() == 24 and q.count() == 12 and t.count() == 24
    assert {r.role for r in x.roles.select("role").distinct().collect()} <= {"EVAL", "ES", "FIT", "REST"}


def test_distinctive_by_hash_sets(spark):
    x = spark.createDataFrame([("us", "main st  7 main"), (None, "main st"), ("fr", "main st"), ("us", None), ("us", "")], "country string, addr_n string")
    often = spark.createDataFrame([("us", "main"), ("fr", "st"), (None, "st")], "country string, tok string")
    got = features.distinctive(x, often, "addr_n", "rare")
    assert {(r.country, r.addr_n): r.rare for r in got.collect()} == {("us", "main st  7 main"): "st 7", (None, "main st"): "main st", ("fr", "main st"): "main", ("us", None): None, ("us", ""): ""}
    assert "array_contains" not in got._jdf.queryExecution().toString()
