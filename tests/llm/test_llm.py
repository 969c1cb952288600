"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import collections
import hashlib
import html as entities
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwright.llm import ann, chat, html, jaccard, lengths, mixing, packing, quality, rules, warc
from linkwright.llm.common import tokenizer_path
from linkwright.llm.queries import ORACLES, QUERIES
from tests.conftest import as_rows

ODD = "doc_id long, text string, source string, lang string, target double, size long, n long, score double"


def odd(spark):
    """Null columns, empty and blank texts, repeated rows, a very long text, and columns with the operators' own names."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, long), (7, "Ä ö ü ß ÉÈ " * 30), (None, None)]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else f"s{k % 2}", None, 0.5, 1, 2, None) for k, (i, t) in enumerate(rows)], ODD)


def empty(df):
    return df.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, duck):
    got, want = as_rows(QUERIES[name](spark, sf).toPandas()), as_rows(duck.execute(ORACLES[name]).df())
    assert got == want


# 1
def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = QUERIES["op1_quality_classifier"](spark, d).join(labels, "doc_id").toPandas()
    assert QUERIES["op1_quality_classifier"](spark, d).count() == docs.count()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))


def test_quality_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    assert quality.scores(odd(spark), model).filter("score between 0 and 1").count() == 10
    assert quality.scores(odd(spark), None).filter("score = 0.5").count() == 10
    assert quality.scores(empty(odd(spark)), model).count() == 0
    assert quality.fit(docs, labels.filter("quality = 1")) is None
    assert quality.filtered(odd(spark), model).columns == odd(spark).columns


def test_quality_repeats_and_ids(spark):
    """Repeats of a labelled id do not fill the sample; ids may be strings; every sampled text enters both views, from all over it."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    first = docs.join(labels.filter("quality = 0"), "doc_id", "left_semi").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(1)
    copies = first.crossJoin(spark.range(10_000)).select("doc_id", "text")
    plain, many = quality.fit(docs, labels, 60), quality.fit(docs.union(copies), labels, 60)
    assert plain is not None and many["dictionaries"] == plain["dictionaries"]
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    model = quality.fit(named(docs), named(labels), 60)
    assert quality.scores(named(docs), model).filter("score between 0 and 1").count() == docs.count()
    text = bytes(range(65, 91)) * 1000
    got = quality.spread(text, 1024, "x")
    assert len(got) <= 1024 and got != text[:1024] and quality.spread(b"ab", 1024, "x") == b"ab"


# 2
def test_mixing_odd_rows(spark):
    got = mixing.copies(odd(spark)).toPandas()
    assert len(got) == 10 and (got.taken <= 2 * got["size"]).all()
    assert mixing.copies(empty(odd(spark))).count() == 0
    assert mixing.mix(odd(spark)).columns == odd(spark).columns
    again = mixing.copies(odd(spark)).toPandas()
    key = lambda x: sorted(map(str, x.itertuples(index=False)))
    assert key(got) == key(again)


@pytest.mark.parametrize("sizes", [[1000, 10, 10, 500], [5, 5, 5], [0, 7], [0], [100]])
def test_mixing_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    want, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = 1.5 * sum(sizes)
    while open_:  # targets stop at twice their size, what is over is shared again
        each = {i: left * weight[i] / sum(weight[k] for k in open_) for i in open_}
        over = [i for i in open_ if each[i] >= 2 * sizes[i]]
        if not over:
            want = [each.get(i, w) for i, w in enumerate(want)]
            break
        for i in over:
            want[i] = 2.0 * sizes[i]
            left -= want[i]
            open_.discard(i)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


# 3
def by_markers(transcript):
    """What markers alone tell: a turn begins at each marked line."""
    return [chat._ROLE[m[1].lower()] for m in map(chat._MARKER.match, transcript.split("\n")) if m]


def test_chat_beats_markers(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    line = chat.written()
    model = chat.learn(chat.runs(talks.filter(chat.trainable()), line))
    held = talks.filter(~chat.trainable())
    raw = {r.conv_id: r.transcript for r in chat.transcripts(chat.runs(held, line)).collect()}
    want = collections.defaultdict(list)
    for r in held.orderBy("conv_id", "turn").collect():
        want[r.conv_id].append(r.role)
    got = collections.defaultdict(list)
    for r in chat.recover(held, model, line).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append(r.role)
    right = sum(got[c] == want[c] for c in want) / len(want)
    marked = sum(by_markers(raw[c]) == want[c] for c in want) / len(want)
    assert right > 0.75 and right > marked + 0.2
    assert QUERIES["op3_chat_formatting"](spark, "/root/testdata/sf0.01").select("conv_id").distinct().count() == talks.select("conv_id").distinct().count()


def slow_viterbi(observed, model):
    """The best of all paths."""
    import itertools

    best = max(
        itertools.product(range(len(chat.STATES)), repeat=len(observed)),
        key=lambda p: model["start"][p[0]] + sum(model["move"][a][b] for a, b in zip(p, p[1:])) + sum(model["emit"][v][s] for s, o in zip(p, observed) for v in o),
    )
    return list(best)


def test_viterbi_is_best():
    model = chat.default_model()
    lines = ["User: what is a?", "it has", "Assistant: an answer.", "- one", "why?"]
    observed = [chat.features(x, k % 2 == 0) for k, x in enumerate(lines)]
    for k in range(1, 6):
        assert chat.viterbi(observed[:k], model) == slow_viterbi(observed[:k], model)


def test_chat_long_conversation(spark):
    """Runs do not show: 600 turns, null and repeated turns, give what one Viterbi over the whole gives."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}?" if i % 2 == 0 else f"It is {i}.\n\nA: first option\nmore") for i in range(600)]
    rows += [(2, 0, "user", "hello?"), (2, 1, "assistant", None), (2, 2, "user", "x"), (3, None, "user", "a"), (3, None, "assistant", "b"), (4, 0, None, None), (None, 0, "user", "hm")]
    rows += [(5, 0, "user", "same")] * 3000
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("run", F.lit("x")).withColumn("piece", F.lit(1)).withColumn("_cut", F.lit(1))
    line = chat.written()
    model = chat.learn(chat.runs(talks, line))
    got = collections.defaultdict(list)
    for r in chat.recover(talks, model, line, run=50).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.turn, r.role, r.text))
        assert r.rendered == chat.render([(r.role, r.text)])
    whole = {r.conv_id: r.transcript for r in chat.transcripts(chat.runs(talks, line, run=10**6, most=1 << 30)).collect() if r.conv_id != 5}
    for c, t in whole.items():
        assert got[c] == [(k, role, text) for k, (role, text) in enumerate(chat.turns(t, model))]
    assert [n for n, _, _ in got[5]] == list(range(len(got[5]))) and len(got[5]) == 3000
    assert chat.recover(talks.limit(0), model, line).count() == 0
    letters = lambda x: re.sub(r"[^a-z0-9:]", "", x.lower())
    assert "a:firstoption" in letters(got[1][1][2])


def test_chat_markers():
    model = chat.default_model()
    text = "System: be kind\n### Human: what is a?\nit has\nNote: two lines\n**Assistant:** an answer.\nUser: ok"
    assert [r for r, _ in chat.turns(text, model)] == ["system", "user", "assistant", "user"]
    assert chat.turns(None, model) == chat.turns("\n \n", model) == []
    again = chat.turns("".join(chat.render([t]) for t in chat.turns(text, model)), model)
    assert [r for r, _ in again] == ["system", "user", "assistant", "user"]


# 4
def brute_measure(text):
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(covered)


def test_rules_odd_rows(spark):
    got = rules.ledger(odd(spark)).toPandas()
    want = [brute_measure(r.text) for r in odd(spark).collect()]
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert collections.Counter(map(tuple, got[cols].values.tolist())) == collections.Counter(want)
    assert rules.ledger(empty(odd(spark))).count() == 0


def test_rules_policies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    book = rules.ledger(docs).persist()
    for policy in rules.POLICIES:
        for r in rules.ablations(book, policy).collect():
            b, m = rules.bit(r.rule), rules.mask(policy)
            bits = [x.failed & m for x in book.collect()]
            assert (r.n_failed, r.n_only) == (sum(bool(x & b) for x in bits), sum(x == b for x in bits))
        assert rules.filtered(docs, policy).count() == book.filter(rules.passes(policy)).count()


# 5
def test_warc_round_trip(spark):
    same = "<p>" + "x" * 200
    rows = [(i, f"http://a.b.com:80/p{i % 3}?q=ü ", same if i % 2 else f"<p>é{i}</p>" * 30) for i in range(30)]
    rows += [(100, None, None), (101, "", "short"), (102, "not a url", "short"), (None, "http://a.b.com/x", same), (103, "http://x\r\ny/", "z" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit("x"))
    parts = warc.write(pages, records=7)
    got = {r.page_id: r for r in warc.read(parts).collect()}
    assert len(got) == len(rows)
    for i, url, text in rows:
        data = (text or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        first = min((k for k, _, t in rows if t == text and k is not None), default=None)
        assert (r.record_type, r.refers_to) == (("revisit", first) if len(data) >= 100 and i != first else ("response", None))
        assert r.payload == (data if r.record_type == "response" else None)
    found = warc.lookup(parts, "http://a.b.com/p1?q=ü ")
    assert {r["page_id"] for r in found} == {i for i in range(30) if i % 3 == 1}
    assert warc.lookup(parts, "http://nowhere.org/") == []
    none = warc.write(pages.limit(0))
    assert none.count() == 0 and warc.read(none).count() == 0


def test_index_blocks():
    lines = [(f"k{i // 3:05d}", i * 10, 10) for i in range(5000)]
    data = warc.pack_index(lines, 64)
    import struct

    at, n = struct.unpack("<QQ", data[-16:])
    assert len(data) == at + n + 16


# 6
def shingles(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 10 >= 8 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), i if not s else least.get(find(a))) for a, (i, s) in enumerate(sets)), key=repr)


def test_jaccard_brute(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 60))
    rows = []
    for group in range(6):
        base = list(rng.choice(vocabulary, rng.integers(6, 160)))
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.integers(0, max(2, len(base) // 12))):
                copy[rng.integers(len(copy))] = str(rng.choice(vocabulary))
            rows.append(" ".join(copy))
    rows += [" ".join([*rng.choice(vocabulary, 40), *passage, *rng.choice(vocabulary, 40)]) for _ in range(40)]
    rows = [*enumerate(rows), (900, ""), (901, None), (902, "A b c"), (903, "a B c"), (904, "a b"), (None, "a b"), (None, "q r s t u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    want = brute_components(rows)
    for hot, tile in ((4, 7),):
        got = sorted(map(tuple, jaccard.join(docs, hot=hot, tile=tile).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
        assert got == want
    kept = jaccard.representatives(docs).collect()
    assert len(kept) == len({c for i, n, c in want if n}) + 2
    assert jaccard.join(docs.limit(0)).count() == 0


def test_rtree_finds_all():
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (300, 64)).astype(np.uint8)
    points[150:] = np.clip(points[:150].astype(int) + rng.integers(-1, 2, (150, 64)) * (rng.random((150, 64)) < 0.1), 0, 254)
    points[0, 0] = 255
    raw = points
    sizes = points.sum(1).astype(np.int64)
    points = jaccard.vectors_of([p.tobytes() for p in points])
    tree = jaccard.RTree(points, sizes)
    for i in range(len(points)):
        bound = np.minimum(np.minimum(points, points[i]).sum(1), np.minimum(sizes, sizes[i]))
        want = {j for j in range(len(points)) if j != i and jaccard.enough(bound[j], sizes[i], sizes[j])}
        assert set(tree.search(points[i], sizes[i], i).tolist()) == want
    assert points[0, 0] >= 1 << 16  # a full count bounds nothing


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (3, 90, 130, 700)]
    sets += [np.unique(np.concatenate([s[len(s) // 8 :], rng.integers(0, 1 << 62, len(s) // 6).astype(np.uint64)])) for s in sets]
    odd = jaccard.Parities([jaccard.parities(s).tobytes() for s in sets])
    for i, a in enumerate(sets):
        apart = odd.apart(i, np.arange(len(sets)))
        true = np.array([len(np.setxor1d(a, b)) for b in sets])
        assert (apart <= true).all() and apart[i] == 0
    assert odd.apart(3, np.array([7]))[0] > 0.8 * len(np.setxor1d(sets[3], sets[7]))


def test_jaccard_many_components(spark):
    """A group of near copies that stays in many components, chains of links, and a passage that unrelated texts share."""
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, 120))
    rows = []
    for _ in range(700):  # from under to over the threshold of each other
        copy = list(base)
        for at in rng.choice(len(base), rng.integers(0, 9), replace=False):
            copy[at] = str(rng.choice(vocabulary))
        rows.append(" ".join(copy))
    chain = list(rng.choice(vocabulary, 90))
    for k in range(150):  # each links with the next
        chain[(k * 7) % 90] = f"c{k}"
        rows.append(" ".join(chain))
    passage = list(rng.choice(vocabulary, 60))
    rows += [" ".join([*rng.choice(vocabulary, rng.integers(5, 60)), *passage, *rng.choice(vocabulary, rng.integers(5, 60))]) for _ in range(300)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 50
    assert sorted(map(tuple, jaccard.join(docs, tile=50).collect()), key=repr) == want


def test_jaccard_clashing_columns(spark):
    docs = odd(spark).selectExpr("*", "1 as _doc", "'x' as _hash", "2 as _place", "3 as cls", "4 as label", "5 as `component_id`")
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(t for t in texts if t and t.split()) == sorted({r.text for r in docs.collect() if r.text and r.text.split()})
    assert len([t for t in texts if not (t and t.split())]) == len([r for r in docs.collect() if not (r.text and r.text.split())])
    assert jaccard.representatives(docs.limit(0)).count() == 0


# 7, 8
def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(9001, "it's DON'T 'll é İ ſ Σας 12,5€ 你好  x <|endoftext|>")], "doc_id long, text string").filter("doc_id < 9001"))
    rows = docs.collect()
    want = collections.Counter()
    total = 0
    for r, ids in zip(rows, brute_ids([r.text for r in rows])):
        ids = np.array(ids, "<u4")
        total += len(ids)
        for k in range(0, len(ids), 4096):
            want[r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    got = packing.pack(docs, shard=50).toPandas().astype(object).where(lambda x: x.notna(), None)
    assert collections.Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(s.length.astype(int))
        assert list(s.offset) == [0, *ends[:-1]] and ends.iloc[-1] <= 4096
    assert got.sequence_id.nunique() <= 1.02 * total / 4096 + 1
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["it's DON'T 'll", "é İ ſ Σας", "12,5€ 你好  x", "a b\x1cc\x85d", "", "  x  ", "Ünïcode.### ÀÈ!!"])
def test_tokens_are_exact(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from linkwright.llm.common import WordIds

    ids, at = WordIds(tokenizer_path()).encode(pa.array(["pad word", text, None]))
    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert ids[at[1] : at[2]].tolist() == want and at[3] == at[2]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y<|startoftext|>.", "<|ENDOFTEXT|> <|endoftext", "end.<|endoftext|>\n<|endoftext|>"])
def test_added_tokens_are_exact(text):
    test_tokens_are_exact(text)


def test_packing_keeps_added_tokens(spark):
    rows = [(9001, "it's DON'T 'll é İ ſ Σας 12,5€ 你好  x <|endoftext|>"), (9002, "<|startoftext|>one two<|endoftext|>three"), (9003, "one two")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard=50).toPandas()
    want = {(i, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, _), ids in zip(rows, brute_ids([x for _, x in rows]))}
    assert set(zip(got.doc_id, got.start, got.length, got.ids_crc32)) == want


def test_plan_places_everything():
    rng = np.random.default_rng(0)
    counts = collections.Counter(np.clip(rng.lognormal(6, 1.3, 20_000).astype(int) + 1, 1, 4096).tolist())
    p = packing.Plan(counts)
    used = collections.Counter()
    for length, first, n, seq, offset in p.runs:
        for k in range(n):
            used[seq + k] += length
    assert p.placed == counts and max(used.values()) <= 4096
    assert len(used) <= 1.005 * sum(k * v for k, v in counts.items()) / 4096 + 1


def test_lengths(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    want = [len(x) for x in brute_ids([r.text for r in docs.collect()])]
    got = lengths.answers(lengths.histogram(docs)).toPandas()
    assert dict(zip(got.length, got.n_docs)) == collections.Counter(want)
    for r in got.itertuples():
        assert r.truncated_total == sum(min(x, r.length) for x in want)
        assert r.docs_longer == sum(x > r.length for x in want)
        assert r.quantile == pytest.approx(sum(x <= r.length for x in want) / len(want))
    limits = lengths.at_limits(lengths.answers(lengths.histogram(docs)), [1, 100, 10**6]).toPandas()
    assert limits.truncated_total.tolist() == [sum(min(x, n) for x in want) for n in (1, 100, 10**6)]
    assert lengths.answers(lengths.histogram(docs.limit(0))).count() == 0


# 9
def test_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages.withColumn("text", F.lit(1))).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article|footer|html|body)\b[^>]*>", body)]
        want = "\n\n".join(x for x in blocks if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain  text &amp; x", "plain text & x"),
        ("<p>a < b and c > d <", "a < b and c > d <"),
        ("<nav>menu</nav><div><p>One, two. Three<p>x</div><div class='comments'><p>bad, bad.</p></div><script>if(a<b){'</p>'}</script><form>f</form>", "One, two. Three\n\nx"),
        ("<div class=cookie-notice>We use, cookies.</div><main><h1>T</h1><p>Fi<b>v</b>e&nbsp;six, and.</main><aside>Read, this.</aside>", "T\n\nFive six, and."),
        ("<div><ul><li><a href=x>Home page</a><li><a href=y>About us</a></ul></div><div><p>Long, real text. It goes on.</p><p>More, of it. Yes.</p></div>", "Long, real text. It goes on.\n\nMore, of it. Yes."),
        ("<article><p>a<script>x", "a"),
    ],
)
def test_html_cases(page, want):
    assert html.main_text(page) == want


_LONG = "<p>Long, real text; it goes on, and on. More, of it.</p>" * 6
_TEXT = "\n\n".join(["Long, real text; it goes on, and on. More, of it."] * 6)


@pytest.mark.parametrize(
    "page, want",
    [
        # an unnamed advert in the article, whose path does not pass
        (f"<article><h1>T</h1>{_LONG}<h2>More</h2>{_LONG}<div class=x7f>Buy now</div></article>", f"T\n\n{_TEXT}\n\nMore\n\n{_TEXT}"),
        # comments as nested articles, and noise words beside layout words
        (f"<article>{_LONG}<article class=comment><p>I like it, really. Good, good.</p></article></article>", _TEXT),
        (f"<article>{_LONG}<div class=comment-body><p>I like it, really. Good, good.</p></div></article>", _TEXT),
        (f"<div class=cookie-container><p>We use cookies, many. Accept, please.</p></div><article>{_LONG}</article>", _TEXT),
        (f"<article>{_LONG}<div class=ad-wrapper><p>Buy, now. Cheap, cheap.</p></div></article>", _TEXT),
        # words of the layout around the article name no noise
        (f"<main class='content has-sidebar'><div class=entry-header><h1>T</h1></div>{_LONG}</main>", "T\n\n" + _TEXT),
        (f"<article class='post tag-social'>{_LONG}</article>", _TEXT),
        # a list of links in the article's body
        (f"<article>{_LONG}<ul><li><a href=x>First source of it all</a><li><a href=y>Second source</a></ul></article>", _TEXT + "\n\nFirst source of it all\n\nSecond source"),
    ],
)
def test_html_scores_decide_in_articles(page, want):
    assert html.main_text(page) == want


# 10
def test_ann(spark, sf):
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame(
        [(2000, None), (2020, []), (2040, [0.0] * 64), (2060, [float("nan")] * 64), (2080, [None] * 64)], "vec_id long, embedding array<float>"
    )
    same = base.filter("vec_id = 20").withColumn("vec_id", F.explode(F.array([F.lit(x).cast("long") for x in range(3000, 3060)])))
    every = base.union(bad).union(same).union(base.filter("vec_id = 40"))
    got = ann.search(every, every.filter("vec_id % 20 = 0")).toPandas()
    rows = {r.vec_id: np.array(r.embedding, float) for r in base.union(same).collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    found = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = (x * rows[q]).sum(1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [(rows[i] * rows[q]).sum() for i in mine.vec_id], atol=0, rtol=1e-12)
        assert list(zip(-mine.score, mine.vec_id)) == sorted(zip(-mine.score, mine.vec_id))
        found += len(set(mine.vec_id) & set(ids[order]))
        total += 20
    assert found / total >= 0.9
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    assert ann.search(every.limit(0), every.limit(0)).count() == 0


def test_ann_several_parts(spark):
    """6,000 clustered vectors in 23 parts and several shards, two lengths, clashing columns: recall, order, and how much was visited."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([c + 0.4 * rng.normal(size=(100, 24)) for c in centres])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(10_000 + i, [1.0, float(i)]) for i in range(30)] + [(20_000, [1.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("x")).withColumn("shards", F.lit(1)).withColumn("kind", F.lit(2))
    got = ann.search(base, base.filter("vec_id % 20 = 0"), shard=100).toPandas()
    found = total = 0
    for q in range(0, 6000, 20):
        s = (x * x[q]).sum(1)
        want = [k for k in np.lexsort((np.arange(len(x)), -s)) if k != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id)) == sorted(zip(-mine.score, mine.vec_id)) and len(mine) == 20
        found += len(set(mine.vec_id) & set(want))
        total += 20
    assert found / total >= 0.9
    short = got[got.query_id == 10_000].sort_values("rank").vec_id.tolist()  # all products with (1, 0) are 1
    assert short == list(range(10_001, 10_021)) and not (got.query_id == 20_000).any()
    model = ann.fit(x)
    p = ann.probabilities(x[::20], model)
    order = np.argsort(-p, axis=1)
    before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
    sizes = np.bincount(ann.probabilities(x, model).argmax(1), minlength=model["parts"])
    assert model["parts"] == 23 and (np.where(before < ann.MASS, sizes[order], 0).sum(1) / len(x)).mean() < 0.5


def test_ann_partitions():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 32)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = ann.graph(x, 16)
    part = ann.balanced(x, near, 8)
    size = np.bincount(part, minlength=8)
    assert size.max() <= 1.2 * len(x) / 8 + 2
    assert (part[near] == part[:, None]).mean() > 0.8


# pipeline
def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        docs = spark.createDataFrame(got.collect(), docs.schema)
        assert docs.count() < rows or name == "source_mixing"
        rows = docs.count()
    sizes = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.filter("piece = 0").count() == sizes


def test_pipeline_stages_on_odd_tables(spark):
    """Row-local stages on odd and empty tables, with columns that clash with the operators' own."""
    docs = odd(spark).selectExpr("*", "1 as n_words", "2 as failed", "3 as _row", "4 as c0", "5 as copies")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "source_mixing"):
        assert stages[name](spark, docs, "").columns == docs.columns
        assert stages[name](spark, empty(docs), "").count() == 0
    kept = stages["quality_rules"](spark, docs, "").collect()
    assert all(len(words(r.text)) >= 50 for r in kept)
    packed = stages["best_fit_packing"](spark, docs, "")
    assert packed.filter("piece = 0").count() == docs.count() and stages["best_fit_packing"](spark, empty(docs), "").count() == 0


def test_chat_runs_keep_their_order_when_cut(spark):
    """Runs over the bounds, by rows and by bytes, repeated and null numbers among them: the pieces below each other are the uncut run."""
    from linkwright.llm import chat

    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "x" * (t * 37 % 90)) for t in range(40)]
    rows += [(1, 7, "user", "same")] * 30 + [(1, None, "user", f"late {i}") for i in range(20)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    order = lambda got: [(r.conv_id, t.turn, t.role, t.line) for r in sorted(got.collect(), key=lambda r: (r.conv_id, r.run, r.piece)) for t in r.turns]
    whole = order(chat.runs(df, run=64))
    assert len(whole) == len(rows)
    for most in (1 << 20, 200, 60):
        cut = chat.runs(df.repartition(3), run=64 if most < 1 << 20 else 4, most=most)
        assert cut.filter("piece > 0").count() > 0
        assert order(cut) == whole
