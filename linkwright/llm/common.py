"""What several operators share: words, Arrow batches, tokenizer encoding."""

from __future__ import annotations

import os
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: The contract's word: a run of anything but space and U+0009..U+000D. bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch. Texts reach 100 KB and more, so the default of 10,000 rows is too many.
BATCH_ROWS, BATCH_BYTES = 128, 8 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def forget() -> None:
    """Gives up what earlier operators' tasks left in this worker, so that stages do not add up in an executor's memory."""
    sys.__dict__.pop("_linkwright_word_ids", None)
    trim()


def trim() -> None:
    """Hands freed memory back to the system, which allocators else keep for this worker."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes without decoding; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words(text: bytes) -> list[bytes]:
    return text.split()


class Codes(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = code = len(self)
        return code


#: Chunks of which a worker holds the token ids; fewer need less memory and more time.
HELD = 500_000
#: Bytes of text that are tokenized at a time, a held chunk.
TOKEN_BYTES = 16


def regrouped(batches, column: str = "text", most: int = 8 << 20):
    """The same rows in record batches of about ``most`` bytes of a column, however Spark cut them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (merged := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield merged[0]


class WordIds:
    """Texts' token ids, exactly as the tokenizer encodes them.

    The tokenizers this is used with drop white space, lower-case, and never let
    a token, a normalisation or a split pattern reach across white space, so a
    text's ids are the ids of its white-space-free chunks in order. Chunks recur:
    a batch's distinct chunks are looked up once, and each is encoded once while
    it is held. When ``most`` are young they become the old generation, from
    which chunks that occur again are taken over.

    A chunk of Latin-1 letters and then ASCII signs is two pre-tokens, encoded
    (and held) apart; only other chunks are encoded as they stand.
    """

    SPLIT = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, most: int = HELD, group: int = 500):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.group = most, group
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str, most: int) -> WordIds:
        """This worker's table: Python workers serve many tasks, and sys outlives the pickled functions of each."""
        held = sys.__dict__.setdefault("_linkwright_word_ids", {})
        if (path, most) not in held:
            held.clear()
            held[path, most] = cls(path, most)
        return held[path, most]

    def _encode(self, texts: list[str]) -> None:
        for i in range(0, len(texts), self.group):
            part = texts[i : i + self.group]
            starts = np.cumsum([0] + [len(t) + 1 for t in part])
            got = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            data = np.array(got.ids, "<u4").tobytes()
            at = np.array([o[0] for o in got.offsets], np.int64)
            cuts = (4 * np.searchsorted(at, starts)).tolist()
            for k, t in enumerate(part):
                self.parts[t] = data[cuts[k] : cuts[k + 1]]

    def learn(self, chunks: list[bytes]) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        if len(self.parts) > 2 * self.most:
            self.parts = {"": b""}
        todo, new = [], set()
        for c in chunks:
            got = self.old.get(c)
            if got is not None:
                self.young[c] = got
                continue
            text = c.decode("utf-8", "replace")
            m = self.SPLIT.fullmatch(text)
            pieces = (m[1].lower(), m[2]) if m else (text,)
            todo.append((c, pieces))
            new.update(x for x in pieces if x not in self.parts)
        self._encode(list(new))
        for c, pieces in todo:
            self.young[c] = self.parts[pieces[0]] + self.parts[pieces[1]] if len(pieces) == 2 else self.parts[pieces[0]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's begin, with a last entry) of a string column; null is empty."""
        split = pc.ascii_split_whitespace(column.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.young.get, chunks))
        missing = [c for c, ids in zip(chunks, found) if ids is None]
        if missing:
            before = self.young
            self.learn(missing)
            if before is self.young:
                found = list(map(self.young.__getitem__, chunks))
            else:  # a new generation began: what this batch had found is in the old one
                found = [self.young[c] if ids is None else ids for c, ids in zip(chunks, found)]
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], sizes)
        words = split.offsets.to_numpy()
        return pool[at], ends[words - words[0]]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
