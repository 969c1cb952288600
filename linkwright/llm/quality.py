"""Quality classifier by compression.

Two zstandard dictionaries are cut from labelled text, one of good and one of
bad documents, for each of two views of a text: its bytes, and its shape
(letters, capitals and digits replaced by one sign each). A text is compressed
in blocks against both dictionaries of each view; the difference of the two
compressed sizes over the text's size says which side it resembles. A logistic
calibration of these differences (and of how far the text shrinks at all),
fitted on labelled documents that no dictionary has seen, turns them into a
score from 0 to 1.

Only the fit is bounded: at most ``per_class`` labelled ids of either label, of
those that have a document, chosen by hash. Two thirds feed the dictionaries,
each text with the same share in both views, cut as slices spread over the whole
text; the others calibrate, whole. Slices and differences are made where the
texts are, so the driver gets dictionaries and numbers of a fixed size, no texts.
Every text is scored whole, row by row, without a shuffle.

Edge cases: null and empty texts have differences of 0 and get the score of a
text that says nothing; a text of any length is scored whole; labels that are null
or contradict each other for a doc_id are not learned from; of several rows of a
labelled id the smallest text is learned from, once, and each row is scored; ids
may be of any type; without labels of both classes every score is 0.5; ties go to
1 (a score of 0.5 predicts 1); extra columns, whatever their names, are kept apart
and never read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, forget, utf8

#: Labelled documents of each class the fit may read; dictionary bytes of the text and shape views; block bytes; zstd level; bytes of a slice of a document's share.
PER_CLASS, TEXT_DICT, SHAPE_DICT, BLOCK, LEVEL, SLICE = 2_400, 512 << 10, 256 << 10, 4096, 3, 256
_SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 192 else ord("0") if 48 <= c <= 57 else ord("a") if c >= 128 else c for c in range(256)
)


def trainable(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 3, is not 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def views(text: bytes) -> tuple[bytes, bytes]:
    return text, text.translate(_SHAPE)


class Compressors:
    """The four compressors of a model, made once in each worker."""

    def __init__(self, model: dict):
        import zstandard

        def make(data: bytes):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model["level"])
            return zstandard.ZstdCompressor(dict_data=d, level=model["level"], write_content_size=False, write_checksum=False, write_dict_id=False)

        self.pairs = [(make(bad), make(good)) for bad, good in model["dictionaries"]]
        self.block = model["block"]

    def features(self, text: bytes) -> tuple[float, ...]:
        if not text:
            return 0.0, 0.0, 0.0, 0.0
        out, least = [], 0
        for (bad, good), view in zip(self.pairs, views(text)):
            b = g = 0
            for i in range(0, len(view), self.block):
                part = view[i : i + self.block]
                b += len(bad.compress(part))
                g += len(good.compress(part))
            out.append((b - g) / len(view))
            least = least or min(b, g)
        # the sign of the difference for short texts, where block overhead dilutes it; how far the text shrinks
        return out[0], out[1], out[0] * min(1.0, 200 / len(text)), least / len(text)


def calibrate(x: np.ndarray, y: np.ndarray, share: float = 0.5, ridge: float = 1e-3, steps: int = 50) -> tuple[list[float], list[float], list[float]]:
    """Ridge logistic regression by Newton's method: means, scales, weights (intercept first).

    ``share``: of label 1 among all labels that may be learned. The sample holds
    the classes in other shares, so its rows are weighted back.
    """
    m = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (m * (p - y)) + ridge * w
        h = (z * (m * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean.tolist(), scale.tolist(), w.tolist()


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame | None, dict[tuple[int, bool], int], float]:
    """(quality, h, calibrates, text) of at most ``per_class`` ids of either label, how many there are of each kind, and the share of label 1 among all that may be learned."""
    agreed = labels.filter(F.col("quality").isin(0, 1) & trainable()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    agreed = agreed.filter("low = high").select("doc_id", F.col("low").alias("quality"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    here = agreed.join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi")
    first = lambda label: here.filter(F.col("quality") == label).orderBy("h", "doc_id").limit(per_class)
    rows = first(0).union(first(1)).collect()
    n = {label: sum(r.quality == label for r in rows) for label in (0, 1)}
    if not all(n.values()):
        return None, {}, 0.5
    share = agreed.agg(F.avg("quality")).first()[0]
    place: dict[int, int] = {0: 0, 1: 0}
    known, counts = [], {}
    for r in sorted(rows, key=lambda r: (r.quality, r.h, str(r.doc_id))):
        calibrates = place[r.quality] >= max(1, 2 * n[r.quality] // 3)
        place[r.quality] += 1
        counts[r.quality, calibrates] = counts.get((r.quality, calibrates), 0) + 1
        known.append((r.doc_id, int(r.quality), r.h, calibrates))
    spark = docs.sparkSession
    kind = agreed.schema["doc_id"].dataType.simpleString()
    # 2 * per_class rows at most: a proven bound for the broadcast
    few = spark.createDataFrame(known, f"doc_id {kind}, quality int, h string, calibrates boolean")
    got = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(few), "doc_id")
    got = got.groupBy("quality", "h", "calibrates").agg(F.min("text").alias("text"))
    return materialise(got, "quality-sample"), counts, share


def spread(view: bytes, size: int, seed: str, piece: int = SLICE) -> bytes:
    """``size`` bytes of a text (all, if it has fewer), as slices at hashed places of equal stretches of it."""
    if len(view) <= size:
        return view
    n = max(1, size // piece)
    each, stretch = size // n, len(view) / n
    out = []
    for i in range(n):
        room = max(0, int(stretch) - each)
        at = int(i * stretch) + zlib.crc32(f"{seed}|{i}".encode()) % (room + 1)
        out.append(view[at : at + each])
    return b"\n".join(out)[:size]


def _shares(batches, sizes):
    for batch in batches:
        quality, h = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        got = [[spread(v, size - 1, key) for v, size in zip(views(t), sizes[y])] for y, key, t in zip(quality, h, utf8(batch.column(2)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([g[k] for g in got], pa.binary()) for k in (0, 1)]], names=["quality", "h", "text", "shape"])


def _differences(batches, model):
    made = Compressors(model)
    for batch in batches:
        x = np.array([made.features(t) for t in utf8(batch.column(2))]).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x[:, k]) for k in range(4)]], names=["quality", "h", "a", "b", "c", "d"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text_dict: int = TEXT_DICT, shape_dict: int = SHAPE_DICT, block: int = BLOCK, level: int = LEVEL) -> dict | None:
    """The model, small enough to travel with each task; None without labels of both classes."""
    rows, counts, share = sample(docs, labels, per_class)
    if rows is None:
        return None
    bound_batches(docs.sparkSession)
    sizes = {y: tuple(max(2, size // counts[y, False]) for size in (text_dict, shape_dict)) for y in (0, 1)}
    cut = rows.filter("not calibrates").select("quality", "h", "text").mapInArrow(lambda it: _shares(it, sizes), "quality int, h string, text binary, shape binary")
    cut = cut.orderBy("quality", "h").collect()  # the bytes of the dictionaries
    content = lambda y, view: b"\n".join(bytes(r[view]) for r in cut if r.quality == y).ljust(8, b"\n")
    model = {"dictionaries": [(content(0, v), content(1, v)) for v in ("text", "shape")], "block": block, "level": level}
    # where a class has no document left to calibrate with, those of the dictionary do
    alone = [y for y in (0, 1) if (y, True) not in counts]
    held = rows.filter(F.col("calibrates") | F.col("quality").isin(alone or [-1])).select("quality", "h", "text")
    held = held.mapInArrow(lambda it: _differences(it, model), "quality int, h string, a double, b double, c double, d double")
    held = held.orderBy("quality", "h").collect()  # at most 2 * per_class rows of numbers
    model["calibration"] = calibrate(np.array([r[2:] for r in held], float), np.array([r.quality for r in held], float), share)
    return model


def _score(batches, model):
    forget()
    made = Compressors(model) if model else None
    for batch in batches:
        texts = utf8(batch.column(batch.schema.get_field_index("text")))
        if made:
            mean, scale, w = (np.array(a) for a in model["calibration"])
            x = np.array([made.features(t) for t in texts]).reshape(-1, len(mean))
            scores = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))
        else:
            scores = np.full(len(texts), 0.5)
        yield batch, scores


def _scored(batches, model):
    for batch, scores in _score(batches, model):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])


def _kept(batches, model, least):
    for batch, scores in _score(batches, model):
        yield batch.filter(pa.array(scores >= least))


def scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scored(it, model), f"doc_id {kind}, score double")


def filtered(docs: DataFrame, model: dict | None, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, with the columns they came with."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _kept(it, model, least), docs.schema)
