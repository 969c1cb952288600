"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct word 5-grams (64-bit hashes). Two documents link
when ``100 * intersection >= 80 * union``. Documents with equal sets are one class
from the start, so copies never meet each other.

Points: the n-grams of a set are hashed into groups; the counts per group are a
point, and the sum over groups of the smaller of two counts bounds the
intersection from above. Points are indexed in packed R-trees, whose boxes give the
same bound for all points under them; pairs that survive are verified on the full
sets. In hot runs (below) the counts of many more groups, of which only the parity
is kept, bound the pairs that the R-tree leaves once more: the sets differ in at
least as many n-grams as parities differ.

One R-tree over a corpus would not fit a task, so classes are first dealt out such
that every pair that may link meets: n-grams are ordered (those of many documents
last, else by hash), and two linked sets share an n-gram among the first fifth of
either. Each such n-gram is a run of classes; each run gets its own R-tree. Size
and place in the order prune pairs before (a pair that links is seen at the first
n-gram it shares, where what is left of both must still suffice).

Hot runs, of more than HOT classes, are copies of one text with small edits, or
texts that share a passage. All pairs there would grow with the square, and only
components are returned, so they are searched for spanning links:

1. A run's most central class (fewest rare n-grams before this one) is bounded
   against every other.
2. With the components that verified links make, the run is cut into bands of
   size, of which only neighbours can link, and bands into tiles of bounded size.
   An R-tree of a tile, whose boxes are also skipped when all under them belong to
   the query's component, gives the pairs across components that the bound leaves;
   of these only a forest is verified, the likeliest links first: no more rows
   than the tile has classes.
3. Where links of a forest turn out not to hold, the tile is searched again for
   pairs across the components there are then, beside the pairs it has tried, and
   for MORE times as many forests. Tiles whose forests held are done: what the forest
   left out lies within one component. This ends when no tile has a pair left, so
   no link between components is lost.

N-grams of many documents are found by counting in blocks and adding up what
repeats inside a block. The order they get is a matter of speed alone: any order
gives the same result. Their postings are dealt by class as well, so no task gets
all of them.

Edge cases: null, empty and blank texts have an empty set, link with nothing and
are their own component; fewer than five words are one n-gram, the sequence;
repeated rows are one class; texts of any length are read whole; ties cannot
matter, since components do not depend on the order of links; null doc_id is never
the smallest of a component unless it is alone, and then the component is null;
an empty table gives an empty result; extra columns, whatever their names, are not
read (``representatives`` returns them as they came). Two different n-grams share a
hash with probability 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_small, join_small, materialise, release, unused
from .common import bound_batches, forget, regrouped, trim

#: Words of an n-gram; similarity as a fraction; groups of a count vector; fewest groups of a parity vector; classes that make a run hot; points of a tree node.
WORDS, NUMERATOR, DENOMINATOR, GROUPS, PARITIES, HOT, NODE = 5, 80, 100, 64, 256, 32, 16
#: Classes and bytes of points that a tile holds; parts that a common n-gram's postings are dealt into; growth of a search's forests by round.
TILE, TILE_BYTES, SALTS, MORE = 4_096, 8 << 20, 1_024, 16
#: An n-gram counts as common from this share of all documents; n-grams of a counting block; repeats within a block that are reported; most that travel with tasks.
COMMON_SHARE, COUNT_BLOCK, REPEATS, MOST_COMMON = 1 / 1500, 1_000_000, 3, 1_000_000
#: Bytes of text whose n-grams are made at a time; classes a task remembers having met.
GRAM_BYTES, SEEN = 3 << 20, 100_000
#: Classes whose hashes may be broadcast to pick texts.
PICK = 1_000_000
_FULL = 255  # a count of 255 or more


def grams(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    coded = split.flatten().dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    h = each[codes] if len(codes) else np.empty(0, np.uint64)
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    solid = h != 0  # splitting leaves empty pieces at the ends of a text
    if not solid.all():
        at = np.concatenate([[0], np.cumsum(solid)])[at]
        h = h[solid]
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = one * np.uint64(0xC2B2AE3D27D4EB4F) + x
            out.append(_mix(one))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def counts(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A set's point; 255 stands for any larger count."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % groups, minlength=groups), _FULL).astype(np.uint8)


def parities(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of two to four groups an n-gram, packed: a power of two, so that a finer vector folds onto a coarser one."""
    groups = max(PARITIES, 1 << max(0, 2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(8)).astype(np.int64) % groups, minlength=groups).astype(np.uint8) & 1, bitorder="little")


def vectors_of(points: list[bytes]) -> np.ndarray:
    """Points as rows; a full count bounds nothing."""
    x = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1).astype(np.int32)
    x[x == _FULL] = 1 << 16
    return x


def apart(a: bytes, b: bytes) -> int:
    """In how many groups two parity vectors differ, the finer one folded: at least so many n-grams are in one set alone."""
    n = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, n // 8), 0) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


class Parities:
    """Parity vectors of several lengths: at each length those of that many groups or more, folded."""

    def __init__(self, packed: list[bytes]):
        self.size = np.array([len(p) for p in packed])
        self.at = {}
        for n in np.unique(self.size):
            rows = np.zeros((len(packed), n), np.uint8)
            for i in np.nonzero(self.size >= n)[0]:
                rows[i] = np.bitwise_xor.reduce(np.frombuffer(packed[i], np.uint8).reshape(-1, n), 0)
            self.at[int(n)] = rows.view(np.uint64)

    def apart(self, i: int, js: np.ndarray) -> np.ndarray:
        """``apart`` of a row and others."""
        out = np.empty(len(js), np.int64)
        common = np.minimum(self.size[js], self.size[i])
        for n in np.unique(common):
            here, rows = common == n, self.at[int(n)]
            out[here] = np.bitwise_count(rows[js[here]] ^ rows[i]).sum(1, dtype=np.int64)
        return out


def enough(overlap, n, m):
    """Whether an overlap links sets of n and m."""
    return (NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (n + m)


def prefix(n: int) -> int:
    """How many of a set's n-grams, in order, must hold one of every linked set."""
    least = -(-NUMERATOR * n // DENOMINATOR)
    return n - least + 1 if n else 0


class RTree:
    """Packed R-tree over count vectors, with a label of every box whose points share one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None, node: int = NODE):
        high = self.points = points
        # neighbours in size, then in the groups that vary most, share leaves
        order = np.lexsort((*(high[:, g] for g in np.argsort(high.var(0))[-3:]), sizes // max(1, int(sizes.mean()) // 8)))
        self.order, self.sizes = order, sizes
        labels = np.arange(len(points)) if labels is None else labels
        self.labels = labels
        boxes, small, large = high[order], sizes[order], sizes[order]
        low_label = high_label = labels[order]
        self.levels = []  # from the leaves' boxes up: largest counts, smallest and largest size, the one label or None
        while True:
            cuts = np.arange(0, len(boxes), node)
            boxes, small, large = np.maximum.reduceat(boxes, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
            low_label, high_label = np.minimum.reduceat(low_label, cuts), np.maximum.reduceat(high_label, cuts)
            self.levels.append((boxes, small, large, low_label, high_label))
            if len(boxes) == 1:
                break
        self.node = node

    def search(self, point: np.ndarray, size: int, label: int) -> np.ndarray:
        """Rows of other labels whose bound lets them link with the point."""
        at = np.zeros(1, np.int64)
        for boxes, small, large, low, high in reversed(self.levels):
            at = at[at < len(boxes)]
            bound = np.minimum(np.minimum(boxes[at], point).sum(1), np.minimum(size, large[at]))
            keep = enough(bound, size, small[at]) & ~((low[at] == label) & (high[at] == label))
            at = (at[keep][:, None] * self.node + np.arange(self.node)).ravel()
        rows = self.order[at[at < len(self.order)]]
        bound = np.minimum(np.minimum(self.points[rows], point).sum(1), np.minimum(size, self.sizes[rows]))
        return rows[enough(bound, size, self.sizes[rows]) & (self.labels[rows] != label)]


# --- passes over the texts -------------------------------------------------------------------


def _common(batches, block, repeats):
    forget()
    held, size, seen = [], 0, set()

    def flush():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= repeats
        return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["gram", "n"])

    for batch in regrouped(batches, most=GRAM_BYTES):
        for s in grams(batch.column(0)):
            key = s.tobytes() if len(s) < 4 else (len(s), int(s[0]), int(s[len(s) // 2]), int(s[-1]))
            if not len(s) or key in seen:
                continue
            seen.add(key)
            held.append(s)
            size += len(s)
            if size >= block:
                yield flush()
                held, size, seen = [], 0, set()
    if held:
        yield flush()
    held, seen = [], set()
    trim()


def common(docs: DataFrame, share: float = COMMON_SHARE, block: int = COUNT_BLOCK, repeats: int = REPEATS) -> np.ndarray:
    """Sorted hashes of n-grams that a share of all documents hold.

    A document has a bounded mean number of n-grams, so at most that number over
    ``share`` can be common, whatever the corpus; MOST_COMMON makes the bound firm
    by keeping the commonest.
    """
    n = docs.select("text").count()
    least = max(16, int(n * share))
    got = docs.select("text").mapInArrow(lambda it: _common(it, block, repeats), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = got.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "gram").limit(MOST_COMMON).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _sketch(batches, often):
    import xxhash

    forget()
    seen: set[int] = set()
    for batch in regrouped(batches, most=GRAM_BYTES):
        sets = grams(batch.column(1))
        size, cls, keys, rare, points, odd = [], [], [], [], [], []
        for s in sets:
            c = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
            size.append(len(s))
            cls.append(c)
            if c in seen or not len(s):
                for column in (keys, rare, points, odd):
                    column.append(None)
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.add(c)
            p = prefix(len(s))
            if len(often):
                k = np.searchsorted(often, s)
                hit = often[np.minimum(k, len(often) - 1)] == s
                ordered = np.concatenate([s[~hit], s[hit]])
                rare.append(min(p, len(s) - int(hit.sum())))
            else:
                ordered = s
                rare.append(p)
            keys.append(ordered[:p].tobytes())
            points.append(counts(s).tobytes())
            odd.append(parities(s).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.binary()), pa.array(rare, pa.int64()), pa.array(points, pa.binary()), pa.array(odd, pa.binary())],
            names=["doc_id", "text_hash", "n", "cls", "keys", "rare", "point", "odd"],
        )
    seen.clear()
    trim()


def sketch(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n, cls, and for a class's first document in a task its prefix, how many of that are not common, its point and parities."""
    bound_batches(docs.sparkSession, 128)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(lambda it: _sketch(it, often), f"doc_id {kind}, text_hash long, n long, cls long, keys binary, rare long, point binary, odd binary")


# --- runs ------------------------------------------------------------------------------------


def _postings(batches):
    """(key, cls, at) of each prefix n-gram; at: the set's size, whether the n-gram is common (COMMON), its place."""
    trim()
    for batch in batches:
        cls, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        keys, rare = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
        size = np.array([len(k) // 8 for k in keys], np.int64)
        flat = np.frombuffer(b"".join(keys), np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        place += np.where(place < np.repeat(rare, size), 0, COMMON)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(cls, size)), pa.array(np.repeat(n, size) << 32 | place)], names=["key", "cls", "at"])


#: Marks a common n-gram in ``at``; its postings are dealt by class as well.
COMMON, PLACE = 1 << 31, (1 << 31) - 1
SALT = f"case when at & {COMMON} = 0 then -1 else pmod(cls, {SALTS}) end"


def _salt(cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at & COMMON, cls % SALTS, -1)


def _shared(batches):
    """Of postings sorted by key, salt and class: those of keys that two or more classes hold, and those of common n-grams, unmarked."""
    trim()
    last = None  # (key, cls, at) of the last row, and whether its run has been reported
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cls, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if last is not None:
            key, cls, at = (np.concatenate([[a], b]) for a, b in zip(last, (key, cls, at)))
        salt = _salt(cls, at)
        turn = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        new = np.concatenate([[True], turn | (cls[1:] != cls[:-1])])
        report = np.ones(len(key), bool)
        if last is not None and told:
            report[0] = False  # reported with the batch before
        key, salt, cls, at, report = key[new], salt[new], cls[new], at[new], report[new]
        starts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))[0] + 1])
        size = np.diff(np.concatenate([starts, [len(key)]]))
        many = np.repeat(size > 1, size) | (salt >= 0)
        if last is not None and told:
            many[: size[0]] = True  # the open run has two classes already
        # a finished run of two classes that cannot link is dropped here
        two = starts[(size == 2) & (starts + 2 < len(key)) & (salt[starts] < 0)]
        two = two[two > 0] if last is not None and told else two
        n, m, i, j = at[two] >> 32, at[two + 1] >> 32, at[two] & PLACE, at[two + 1] & PLACE
        apart = two[~enough(np.minimum(n - i, m - j), n, m)]
        many[apart] = many[apart + 1] = False
        out = many & report
        told = bool(many[-1])
        last = (key[-1], cls[-1], at[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, cls, at & ~COMMON)], names=["key", "cls", "at"])


def _pairs_of_run(rows: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of a run's classes (cls, at, point) that may link, by its R-tree."""
    cls = [r[0] for r in rows]
    n = np.array([r[1] >> 32 for r in rows])
    left = n - np.array([r[1] & 0xFFFFFFFF for r in rows])
    if len(rows) == 2 and not enough(min(left), n[0], n[1]):
        return []
    out = []
    if len(rows) <= 3:  # a tree of one leaf: its points are bounded directly
        points = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        for i in range(1, len(rows)):
            for j in range(i):
                least = np.minimum(points[i], points[j])
                bound = int(least.sum(dtype=np.int64)) if least.max() < _FULL else 1 << 30
                if enough(min(bound, left[i], left[j]), n[i], n[j]):
                    out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
        return out
    points = vectors_of([r[2] for r in rows])
    tree = RTree(points, n)
    for i in range(len(rows)):
        for j in tree.search(points[i], n[i], i):
            if i < j and enough(min(left[i], left[j]), n[i], n[j]):
                out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
    return out


def _bounded(batches):
    """Pairs whose parities still let them link."""
    trim()
    for batch in batches:
        keep = [bool(enough((n + m - apart(a, b)) // 2, n, m)) for n, m, a, b in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def bounded(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (materialised) whose parities still let them link."""
    light = F.broadcast(pairs) if is_small(pairs) else pairs
    side = lambda c: vectors.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("odd").alias("o" + c))
    joined = side("x").join(light, "x").join(side("y"), "y").select("x", "y", "nx", "ny", "ox", "oy")
    return joined.mapInArrow(_bounded, "x long, y long")


def _search_runs(batches):
    """Of rows sorted by key: pairs that may link."""
    trim()
    key, rows, out = None, [], set()
    for batch in batches:
        for k, c, at, point in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if k != key:
                if len(rows) > 1:
                    out.update(_pairs_of_run(rows))
                key, rows = k, []
            rows.append((c, at, point))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["x", "y"])
            out = set()
    if len(rows) > 1:
        out.update(_pairs_of_run(rows))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["x", "y"])


def _led(batches):
    """Pairs of a hot run's most central class and another whose points and parities let them link."""
    trim()
    for batch in batches:
        got = set()
        for c, at, point, odd, d, lead, other, more in zip(*(batch.column(i).to_pylist() for i in range(8))):
            n, m = at >> 32, lead >> 32
            if c != d and enough(min(n - (at & PLACE), m - (lead & PLACE)), n, m):
                a, b = vectors_of([point, other])
                if enough(min(int(np.minimum(a, b).sum()), n, m), n, m):
                    if enough((n + m - apart(odd, more)) // 2, n, m):
                        got.add((min(c, d), max(c, d)))
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(2)], names=["x", "y"])


class _Forests:
    """Edge-disjoint forests, filled in the order edges come."""

    def __init__(self, nodes: int, forests: int):
        self.parents = [list(range(nodes)) for _ in range(forests)]

    def takes(self, a: int, b: int) -> bool:
        """Whether one of the forests has room for the edge; it is then in it."""
        for parent in self.parents:
            x, y = a, b
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                return True
        return False


def _search_tile(table: pa.Table, tried: pa.Table | None, forests: int) -> pa.Table:
    """A spanning choice of the untried pairs across components that may link, between two tiles of a hot run (or within one)."""
    table = table.sort_by("cls")  # other runs of the same classes choose alike
    cls, at, label, tile = (table.column(c).to_numpy().astype(np.int64) for c in ("cls", "at", "label", "tile"))
    done = set(zip(tried.column("x").to_pylist(), tried.column("y").to_pylist())) if tried is not None and tried.num_rows else set()
    out: list[tuple[int, int]] = []
    names, label = np.unique(label, return_inverse=True)
    here = np.nonzero(tile == table.column("low")[0].as_py())[0] if table.num_rows else np.empty(0, np.int64)
    within = table.num_rows and table.column("low")[0].as_py() == table.column("high")[0].as_py()
    there = here if within else np.nonzero(tile == table.column("high")[0].as_py())[0] if table.num_rows else here
    if len(names) > 1 and len(here) and len(there):
        points, odd = vectors_of(table.column("point").to_pylist()), Parities(table.column("odd").to_pylist())
        n, left = at >> 32, (at >> 32) - (at & PLACE)
        tree = RTree(points[there], n[there], label[there])
        kept = _Forests(len(names), forests)
        for i in here:
            js = there[tree.search(points[i], n[i], label[i])]
            js = js[js > i] if within else js
            js = js[enough(np.minimum(left[i], left[js]), n[i], n[js])]
            far = odd.apart(i, js)
            fits = enough((n[i] + n[js] - far) // 2, n[i], n[js])
            js, far = js[fits], far[fits]
            if not len(js):
                continue
            near = -far / (n[js] + n[i])
            for j in js[np.argsort(-near, kind="stable")].tolist():
                pair = (min(cls[i], cls[j]), max(cls[i], cls[j]))
                if pair not in done and kept.takes(label[i], label[j]):
                    out.append(pair)
    first = lambda c: [table.column(c)[0].as_py()] * len(out) if out else []
    return pa.table(
        {"key": pa.array(first("key"), pa.int64()), "low": pa.array(first("low"), pa.int64()), "high": pa.array(first("high"), pa.int64()), **{c: pa.array([o[k] for o in out], pa.int64()) for k, c in enumerate("xy")}}
    )


def _searcher(forests: int):
    none = pa.table({c: pa.array([], pa.int64()) for c in ("key", "low", "high", "x", "y")})
    return lambda table, tried: _search_tile(table, tried, forests) if table.num_rows else none


_FOUND = "key long, low long, high long, x long, y long"


def tiles(hot: DataFrame, labels: DataFrame, tile: int = TILE, only: DataFrame | None = None) -> DataFrame:
    """key, low, high, tile, cls, at, point, odd, label: the rows of hot runs for every pair of tiles that may hold a link across components.

    A run that fits a tile is one. In larger ones, linked sets differ in size by a
    quarter at most, so they lie in one band or in neighbours, and a band is cut into
    tiles by class. ``only``: keys of the runs that count.
    """
    named = labels.select(F.col("cls").alias("_cls"), "label")
    rows = join_small(hot, named, F.col("cls") == F.col("_cls")).drop("_cls").withColumn("label", F.coalesce("label", "cls"))
    if only is not None:
        rows = join_small(rows, only.select(F.col("key").alias("_key")).distinct(), F.col("key") == F.col("_key"), "left_semi")
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("odd")).alias("bytes"), F.min("label").alias("a"), F.max("label").alias("b"))
    per = per.filter("a <> b").select(F.col("key").alias("_key"), ((F.col("m") <= tile) & (F.col("bytes") <= TILE_BYTES)).alias("whole"))
    per = materialise(per, "jaccard-open")
    rows = join_small(rows, per, F.col("key") == F.col("_key"), "inner").drop("_key")
    zero = F.lit(0).cast("long")
    one = rows.filter("whole").select("key", zero.alias("low"), zero.alias("high"), zero.alias("tile"), "cls", "at", "point", "odd", "label")
    if per.filter("not whole").isEmpty():
        return one
    rows = rows.filter("not whole").drop("whole")
    rows = rows.withColumn("band", F.floor(F.log(F.shiftright("at", 32).cast("double")) / F.lit(float(np.log(1.26)))).cast("long"))
    each = rows.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.length("odd")).alias("bytes"), F.min("label").alias("least"), F.max("label").alias("most")
    )
    each = each.withColumn("cut", F.greatest(F.ceil(F.col("m") / tile), F.ceil(F.col("bytes") / TILE_BYTES)).cast("long"))
    up = each.select("key", (F.col("band") - 1).alias("band"), F.col("cut").alias("cut_up"), F.col("least").alias("least_up"), F.col("most").alias("most_up"))
    down = each.select("key", (F.col("band") + 1).alias("band"), F.col("cut").alias("cut_down"), F.col("least").alias("least_down"), F.col("most").alias("most_down"))
    each = each.join(up, ["key", "band"], "left").join(down, ["key", "band"], "left")
    # a band, or two neighbours, of one component is done
    open_ = lambda s: F.col(f"cut{s}").isNotNull() & (F.least("least", f"least{s}") != F.greatest("most", f"most{s}"))
    each = each.select(
        "key", "band", "cut",
        F.when(F.col("least") != F.col("most"), F.col("cut")).otherwise(0).alias("same"),
        F.when(open_("_up"), F.col("cut_up")).otherwise(0).alias("up"),
        F.when(open_("_down"), F.col("cut_down")).otherwise(0).alias("down"),
    ).filter("same + up + down > 0")
    rows = rows.join(each, ["key", "band"])
    part = F.pmod(F.xxhash64("cls"), F.col("cut"))
    name = lambda band, k: F.shiftleft(band, 32) + k
    all_of = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("tile", name(F.col("band"), part))
    meet = F.concat(
        F.transform(all_of("same"), lambda k: F.struct(F.least(F.col("tile"), name(F.col("band"), k)).alias("low"), F.greatest(F.col("tile"), name(F.col("band"), k)).alias("high"))),
        F.transform(all_of("up"), lambda k: F.struct(F.col("tile").alias("low"), name(F.col("band") + 1, k).alias("high"))),
        F.transform(all_of("down"), lambda k: F.struct(name(F.col("band") - 1, k).alias("low"), F.col("tile").alias("high"))),
    )
    parts = rows.withColumn("_m", F.explode(meet)).select("key", F.col("_m.low").alias("low"), F.col("_m.high").alias("high"), "tile", "cls", "at", "point", "odd", "label")
    return one.unionByName(parts)


# --- verification and components -------------------------------------------------------------


def _sets(batches):
    trim()
    import xxhash

    seen: set[int] = set()
    for batch in regrouped(batches, most=GRAM_BYTES):
        cls, data = [], []
        for s in grams(batch.column(0)):
            b = s.tobytes()
            c = xxhash.xxh3_64_intdigest(b) - (1 << 63)
            if c not in seen:
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(c)
                cls.append(c)
                data.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(data, pa.binary())], names=["cls", "grams"])


def _verify(batches):
    trim()
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            keep.append(bool(enough(int((both[1:] == both[:-1]).sum()), len(a), len(b))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (materialised) whose full sets link; only texts of classes in pairs are read into sets. firsts: a document of each class."""
    needed = materialise(pairs.select(F.explode(F.array("x", "y")).alias("_cls")).distinct(), "jaccard-needed")
    text = join_small(firsts, needed, F.col("cls") == F.col("_cls"), "left_semi")
    text = materialise(text.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "jaccard-texts")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    bound_batches(docs.sparkSession, 64)
    # one row per class where ids are unique; repeated rows repeat their pairs, which distinct() takes back
    sets = join_small(docs.select("doc_id", "text"), text, same, "left_semi", PICK).select("text").mapInArrow(_sets, "cls long, grams binary")
    sets = materialise(sets, "jaccard-sets")
    light = F.broadcast(pairs) if is_small(pairs) else pairs
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("grams").alias("g" + c))
    joined = side("x").join(light, "x").join(side("y"), "y").select("x", "y", "gx", "gy")
    links = materialise(joined.mapInArrow(_verify, "x long, y long").distinct(), "jaccard-links")
    release(needed, text, sets)
    return links


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """cls, label (smallest class of the component) for every class with a link, by alternating large and small stars.

    Minima are aggregates with a map side, and hubs meet their stars by a
    skew-split join. The rounds grow with the logarithm of the longest chain;
    rather than give unfinished components it raises.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges if small else edges.union(edges.select("v", "u"))  # u's neighbours v; small: those below u
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if small:
            new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            new = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return new.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    edges = materialise(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "jaccard-edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(edges)
    for _ in range(rounds):
        old, edges = edges, materialise(star(star(edges, False), True), "jaccard-edges")
        release(old)
        after = sign(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components unfinished after {rounds} rounds")
    both = edges.select(F.col("u").alias("cls"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("cls"), F.col("v").alias("label")).distinct())
    labels = materialise(both, "jaccard-labels")
    release(edges)
    return labels


def spanning(hot: DataFrame, links: DataFrame, firsts: DataFrame, docs: DataFrame, tile: int = TILE) -> DataFrame:
    """cls, label once all links between components that hot runs hold are found, beginning with ``links``."""
    labels = components(links)
    tried, forests = None, 1
    while True:
        rows = tiles(hot, labels, tile, tried)
        keys = ["key", "low", "high"]
        if tried is None:
            found = rows.groupBy(*keys).applyInArrow(lambda t: _search_tile(t, None, 1), _FOUND)
        else:  # only tiles with a choice that did not hold
            again = tried.select(*keys).distinct()
            left = rows.join(again, keys, "left_semi").groupBy(*keys)
            right = tried.groupBy(*keys)
            found = left.cogroup(right).applyInArrow(_searcher(forests), _FOUND)
        found = materialise(found, "jaccard-found")
        pairs = found.select("x", "y").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("x", "y").distinct(), ["x", "y"], "left_anti")
        pairs = materialise(pairs, "jaccard-pairs")
        if not pairs.isEmpty():
            new = verified(pairs, firsts, docs)
            if not new.isEmpty():
                star = labels.select(F.col("cls").alias("x"), F.col("label").alias("y"))
                old, labels = labels, components(star.union(new))
                release(old)
            # pairs tried before that this round's tiles chose as well did not hold either
            failed = found.join(new, ["x", "y"], "left_anti")
        else:
            new, failed = None, found
        before, tried = tried, materialise(failed if tried is None else failed.unionByName(tried).distinct(), "jaccard-tried")
        fresh = materialise(failed.select(*keys).distinct(), "jaccard-again")
        tried_on = materialise(tried.join(fresh, keys, "left_semi"), "jaccard-tried")
        release(found, pairs, fresh, tried, *[x for x in (new, before) if x is not None])
        tried = tried_on
        if tried.isEmpty():
            release(tried)
            return labels
        forests *= MORE


def members(docs: DataFrame, hot: int = HOT, tile: int = TILE) -> DataFrame:
    """doc_id, text_hash, n, cls, label, component_id of every document; rows of one component share ``label``."""
    spark = docs.sparkSession
    often = common(docs)
    sketches = materialise(sketch(docs, often), "jaccard-sketch")
    points = sketches.filter("keys is not null")
    rows = materialise(sketches.select("doc_id", "text_hash", "n", "cls"), "jaccard-rows")
    bound_batches(spark, 500)
    postings = points.select("cls", "n", "keys", "rare").mapInArrow(_postings, "key long, cls long, at long")
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bound_batches(spark, 10_000)
    dealt = postings.repartition(slots, F.col("key"), F.expr(SALT)).sortWithinPartitions(F.col("key"), F.expr(SALT), F.col("cls"))
    shared = materialise(dealt.mapInArrow(_shared, "key long, cls long, at long"), "jaccard-shared")
    release()
    vectors = materialise(points.groupBy("cls").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.first("odd").alias("odd")), "jaccard-points")
    firsts = points.groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("cls", "one.doc_id", "one.text_hash")
    firsts = materialise(firsts, "jaccard-firsts")
    release(sketches)
    relative = F.expr("(at & 4294967295) / shiftright(at, 32)")
    runs = shared.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(relative.alias("far"), "cls", "at")).alias("lead"))
    runs = materialise(runs.filter(F.col("m") > hot).select("key", F.col("lead.cls").alias("lead"), F.col("lead.at").alias("lead_at")), "jaccard-hot")
    heads = runs.select(F.col("key").alias("_key"))
    cold = join_small(shared, heads, F.col("key") == F.col("_key"), "left_anti").join(vectors.select("cls", "point"), "cls").select("key", "cls", "at", "point")
    found = cold.repartition(slots, "key").sortWithinPartitions("key", "cls").mapInArrow(_search_runs, "x long, y long").distinct()
    met = materialise(found, "jaccard-met")
    bound_batches(spark, 2_000)
    some = materialise(bounded(met, vectors), "jaccard-pairs")
    warm = join_small(shared, heads, F.col("key") == F.col("_key"), "left_semi").join(vectors.drop("n"), "cls").select("key", "cls", "at", "point", "odd")
    warm = materialise(warm, "jaccard-warm")
    release(shared)
    leads = runs.join(vectors, F.col("lead") == F.col("cls")).select(F.col("key").alias("_key"), "lead", "lead_at", F.col("point").alias("lead_point"), F.col("odd").alias("lead_odd"))
    leads = materialise(leads, "jaccard-leads")
    release(vectors, runs, met)
    led = join_small(warm, leads, F.col("key") == F.col("_key"), "inner", PICK // 100).select("cls", "at", "point", "odd", "lead", "lead_at", "lead_point", "lead_odd")
    led = led.mapInArrow(_led, "x long, y long").distinct()
    pairs = materialise(some.union(led).distinct(), "jaccard-pairs")
    release(leads, some)
    links = verified(pairs, firsts, docs)
    labels = spanning(warm, links, firsts, docs, tile)
    release(pairs, links, warm, firsts)
    # the smallest id of each class first: partial aggregates, so a class of a third of all rows is a row a task
    least = rows.groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = least.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = materialise(named.join(ids, "label").select(F.col("cls").alias("_cls"), "label", "component_id"), "jaccard-components")
    release(labels)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return join_small(rows, named, F.col("cls") == F.col("_cls")).select("doc_id", "text_hash", "n", "cls", "label", own.alias("component_id"))


def join(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return members(docs, **parameters).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each component, in the columns it came with; all documents with an empty set.

    It is the one with the smallest doc_id (null last), then the smallest hash of
    its text; of repeated rows one stays, the first by its other columns.
    """
    got = materialise(members(docs, **parameters).filter("n > 0").select("doc_id", "text_hash", "label"), "jaccard-documents")
    doc, digest, place = unused(docs.columns, "_doc", "_hash", "_place")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = got.groupBy("label").agg(F.min(key).alias("best"))
    named = lambda df: df.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest))
    judged = got.join(best, "label").withColumn("stays", key == F.col("best"))
    drop = materialise(named(judged.filter("not stays")).distinct(), "jaccard-drop")
    again = materialise(named(judged.filter("stays").groupBy("doc_id", "text_hash").count().filter("count > 1")), "jaccard-again")
    release(got)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(digest))
    kept = join_small(docs, drop, same, "left_anti", PICK)
    if again.isEmpty():
        return kept
    one = Window.partitionBy("doc_id", "text").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    twice = join_small(kept, again, same, "left_semi", PICK)
    once = join_small(kept, again, same, "left_anti", PICK)
    return once.unionByName(twice.withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1).drop(place))
