"""Best-fit packing by linear grouping.

What is packed is decided on the histogram of piece lengths, which has at most
``limit`` entries whatever the corpus holds:

1. Encode; cut documents longer than ``limit`` into pieces; keep no text.
2. Large lengths (over ``small`` of the limit) are sorted, dealt into groups of
   equal cardinality and rounded up to their group's largest length.
3. For these few sizes, configurations (multisets that fit a sequence) are
   optimised: one at a time, the configuration with the most tokens that the
   remaining counts can fill is taken as often as the counts allow.
4. Actual lengths replace the rounded ones: the slots of a group are filled by
   the group's pieces in order of length.
5. What room is left takes the small pieces, longest first, each in the fullest
   sequence that still holds it (best fit), counts of equal cases at a time.

The plan is a short list of runs: pieces ``first..`` of length L go, in order of
their rank among the pieces of that length, to consecutive sequences of a run at
given offsets. Ranks come from per-(length, shard) counts, so a length that a
third of all pieces share is ranked by many tasks.

Edge cases: null or empty text is the end token alone; repeated rows are packed
as often as they occur; an empty table gives no sequence; extra columns are not
read; null doc_id stays null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import HELD, TOKEN_BYTES, WordIds, bound_batches, regrouped, tokenizer_path, trim

#: Tokens of a sequence; id that ends a document; groups of large lengths; what share of a sequence makes a length large; pieces of a rank shard.
LIMIT, END, GROUPS, SMALL, SHARD = 4096, 1, 24, 1 / 6, 250_000


def _pieces(batches, path, limit, end, held):
    trim()
    ids = WordIds.of(path, held)
    tail = np.array([end], "<u4").tobytes()
    for batch in regrouped(batches, most=TOKEN_BYTES * held):
        flat, at = ids.encode(batch.column(1))
        row, piece, start, length, crc = [], [], [], [], []
        for i in range(batch.num_rows):
            data = flat[at[i] : at[i + 1]].tobytes() + tail
            for k, first in enumerate(range(0, len(data), 4 * limit)):
                part = data[first : first + 4 * limit]
                row.append(i)
                piece.append(k)
                start.append(first // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END, held: int = HELD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    bound_batches(docs.sparkSession)
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, path, limit, end, held), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs of pieces of one length laid into runs of sequences.

    A bin run is (first sequence, how many, used tokens); sequences of a run are
    alike in what they use. Splitting runs instead of sequences keeps the work a
    function of the number of distinct lengths.
    """

    def __init__(self, counts: dict[int, int], limit: int = LIMIT, groups: int = GROUPS, small: float = SMALL):
        self.limit = limit
        self.left = {k: int(v) for k, v in counts.items() if v}
        self.placed: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first sequence, offset
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
        self.rooms: list[int] = []
        self.sequences = 0
        self._large(groups, small)
        self._best_fit()

    def _room(self, room: int, first: int, n: int) -> None:
        if n and room:
            if not self.free[room]:
                insort(self.rooms, room)
            self.free[room].append((first, n))

    def _take(self, length: int, n: int, first: int, offset: int) -> None:
        self.runs.append((length, self.placed[length], n, first, offset))
        self.placed[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _large(self, groups: int, small: float) -> None:
        limit = self.limit
        if limit in self.left:
            n = self.left[limit]
            self._take(limit, n, 0, 0)
            self.sequences = n
        large = sorted((x for x in self.left if x > small * limit), reverse=True)
        total = sum(self.left[x] for x in large)
        if not total:
            return
        each, group, have = -(-total // groups), {}, 0
        for x in large:  # a length stays whole: its pieces share a group
            group.setdefault(have // each, []).append(x)
            have += self.left[x]
        stock = [(max(xs), list(xs)) for _, xs in sorted(group.items())]  # rounded size, lengths from the longest
        count = [sum(self.left[x] for x in xs) for _, xs in stock]
        sizes = [s for s, _ in stock]
        while any(count):
            pattern = self._configuration(sizes, count)
            times = min(count[g] // k for g, k in pattern.items())
            self._fill(pattern, times, stock)
            for g, k in pattern.items():
                count[g] -= k * times

    def _configuration(self, sizes: list[int], count: list[int]) -> dict[int, int]:
        """The multiset of rounded sizes, within the counts, that uses most of a sequence; it holds the largest size left."""
        first = next(g for g, n in enumerate(count) if n)
        best: list = [sizes[first], {first: 1}]

        def grow(g: int, used: int, chosen: dict[int, int]) -> None:
            if used > best[0]:
                best[0], best[1] = used, dict(chosen)
            for h in range(g, len(sizes)):
                if best[0] == self.limit:
                    return
                if count[h] > chosen.get(h, 0) and used + sizes[h] <= self.limit:
                    chosen[h] = chosen.get(h, 0) + 1
                    grow(h, used + sizes[h], chosen)
                    chosen[h] -= 1
                    if not chosen[h]:
                        del chosen[h]

        grow(first, sizes[first], {first: 1})
        return best[1]

    def _fill(self, pattern: dict[int, int], times: int, stock) -> None:
        """``times`` sequences of a configuration, its slots filled with actual lengths."""
        runs = [(self.sequences, times, 0)]
        self.sequences += times
        for g, k in pattern.items():
            lengths = stock[g][1]
            for _ in range(k):
                after = []
                for first, n, used in runs:
                    while n:
                        while lengths[0] not in self.left:
                            lengths.pop(0)
                        m = min(n, self.left[lengths[0]])
                        self._take(lengths[0], m, first, used)
                        after.append((first, m, used + lengths[0]))
                        first, n = first + m, n - m
                runs = after
        for first, n, used in runs:
            self._room(self.limit - used, first, n)

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    each = self.limit // length  # nothing has room: open sequences that this length fills alone
                    n = self.left[length]
                    new = max(1, n // each)
                    for k in range(min(each, n)):
                        self._take(length, new, self.sequences, k * length)
                    self._room(self.limit - min(each, n) * length, self.sequences, new)
                    self.sequences += new
                    continue
                room = self.rooms[at]
                first, n = self.free[room].pop()
                if not self.free[room]:
                    self.rooms.pop(at)
                m = min(n, self.left[length])
                self._take(length, m, first, self.limit - room)
                self._room(room - length, first, m)
                self._room(room, first + m, n - m)


def plan(counts: dict[int, int], **parameters) -> Plan:
    return Plan(counts, **parameters)


def _place(batches, table):
    """length, rank -> sequence_id, offset by binary search in the plan's runs."""
    keys = table[0].astype(np.int64) << 44 | table[1]
    for batch in batches:
        names = batch.schema.names
        length, rank = (batch.column(names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
        at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
        keep = [i for i, n in enumerate(names) if n != "rank"]
        sequence = table[3][at] + rank - table[1][at]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(sequence), pa.array(table[4][at])], names=[names[i] for i in keep] + ["sequence_id", "offset"]
        )


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END, groups: int = GROUPS, small: float = SMALL, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, limit, end, held), "pack-pieces")
    by_length = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``limit`` rows
    shards = max(1, -(-sum(by_length.values()) // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    counts = dealt.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, ["length", "shard"]).select(*cut.columns, (F.col("before") + F.col("place")).cast("long").alias("rank"))
    got = Plan(by_length, limit, groups, small)
    runs = np.array(sorted(got.runs), np.int64).reshape(-1, 5).T
    bound_batches(spark, 20_000)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lambda it: _place(it, runs), fields)
