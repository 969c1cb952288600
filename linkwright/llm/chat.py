"""Chat formatting: roles of a raw transcript by a hidden Markov model.

A transcript is text in which some turns carry a speaker marker, of one style or
another, and some none. Each line is an observation: which marker it starts with,
whether a blank line is above it, whether it asks, whether it instructs, whether
it is code, and its length class. Hidden states are (role, first line of a turn or
a later one). Start, transition and emission tables, markers included, are counted
on labelled transcripts and smoothed by default tables; Viterbi finds the
likeliest sequence of states, and turns are then rendered in one canonical form. A
marker is strong evidence, but "A: first option" inside a turn starts none where
labelled turns begin below a blank line; it then stays in the text. Only the
marker of a turn's own role is taken off; no other text is lost.

Viterbi needs a conversation's lines in order. A table of turns is put together in
runs of bounded size; a run that is part of a longer conversation yields the 6 x 6
matrix of best scores between the state before it and its last state, these are
multiplied (max, +) along the conversation, and with the states at its borders
each run is decoded on its own: the result is that of one Viterbi over the whole
conversation, though no task ever holds one. A turn that a border cuts is put
together again, and turns are numbered through.

Edge cases: null text or role is an empty string; a transcript without lines has
no turns; an empty turn of a table leaves no line and so no turn; repeated rows
are turns like others; null turn numbers come last; equal turn numbers are in the
order of role and text, however many they are; ties between states go to the
first in STATES order; an empty table gives an empty result; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialise
from .common import bound_batches

ROLES = ("system", "user", "assistant")
#: Speaker names a marker may use, by role.
NAMES = {
    "system": ("system", "instructions", "sys"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "response"),
}
_ROLE = {name: role for role, names in NAMES.items() for name in names}
_MARKER = re.compile(
    r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?(?:im_start\|>)?)?\s*(" + "|".join(sorted(_ROLE, key=len, reverse=True)) + r")\s*(?:\d+\s*)?(?:\*\*\s*:|:\s*\*\*|\|?>|\]\s*:?|:)\s*(.*)$", re.I | re.S
)
_END = re.compile(r"<\|im_end\|>|</s>|<\|end\|>")
STATES = tuple((role, first) for role in ROLES for first in (True, False))
#: Turns and bytes of a run.
RUN, RUN_BYTES = 256, 4 << 20


def features(line: str, blank: bool = False) -> tuple[str, ...]:
    """What the model sees of a line: one value for each of marker, ask, kind, length, and whether a blank line is above it."""
    m = _MARKER.match(line)
    text = (m[2] if m else line).strip()
    ask = "ask" if text.endswith("?") else "bid" if re.match(r"(?i)(please|write|explain|give|tell|how|what|why|can you|could you)\b", text) else "-"
    kind = "code" if re.match(r"(```|\s{4}|[{}<>]|def |class |import )", line) else "list" if re.match(r"\s*([-*]|\d+[.)])\s", line) else "-"
    size = "empty" if not text else "short" if len(text) < 60 else "middle" if len(text) < 160 else "long" if len(text) < 400 else "huge"
    return f"m:{_ROLE[m[1].lower()] if m else '-'}", f"a:{ask}", f"k:{kind}", f"s:{size}", f"b:{int(blank)}"


def observe(transcript: str | None, open_: bool = True) -> tuple[list[str], list[int], list[tuple[str, ...]]]:
    """(lines, places of lines with text, their features). ``open_``: the first line counts as below a blank one."""
    lines = _END.sub("", transcript or "").split("\n")
    seen = [i for i, x in enumerate(lines) if x.strip()]
    return lines, seen, [features(lines[i], open_ if k == 0 else not lines[i - 1].strip()) for k, i in enumerate(seen)]


VALUES = (
    ("m:-", *(f"m:{r}" for r in ROLES)),
    ("a:-", "a:ask", "a:bid"),
    ("k:-", "k:code", "k:list"),
    ("s:empty", "s:short", "s:middle", "s:long", "s:huge"),
    ("b:0", "b:1"),
)


def default_model() -> dict:
    """Tables for transcripts of which nothing is known: markers decide, turns alternate, system comes first."""
    start = {("system", True): 0.2, ("user", True): 0.6, ("assistant", True): 0.2}
    move = {s: {} for s in STATES}
    for role, first in STATES:
        for to, first_to in STATES:
            if not first_to:
                p = (0.7 if to == role else 0.0) or 1e-9
            else:
                p = {("system", "user"): 0.28, ("user", "assistant"): 0.26, ("assistant", "user"): 0.26}.get((role, to), 0.02)
            move[(role, first)][(to, first_to)] = p
    emit = {}
    for role, first in STATES:
        for v in VALUES[0]:
            emit[(role, first), v] = (0.75 if v == f"m:{role}" else 0.23 if v == "m:-" else 0.01) if first else (0.97 if v == "m:-" else 0.01)
        ask, bid = {"user": (0.35, 0.25), "assistant": (0.08, 0.04), "system": (0.03, 0.05)}[role]
        emit |= {((role, first), "a:ask"): ask, ((role, first), "a:bid"): bid, ((role, first), "a:-"): 1 - ask - bid}
        code, item = {"user": (0.05, 0.05), "assistant": (0.15, 0.2), "system": (0.02, 0.1)}[role]
        emit |= {((role, first), "k:code"): code, ((role, first), "k:list"): item, ((role, first), "k:-"): 1 - code - item}
        for v, p in zip(VALUES[3], {"user": (0.1, 0.4, 0.35, 0.1, 0.05), "assistant": (0.1, 0.2, 0.3, 0.25, 0.15), "system": (0.05, 0.35, 0.35, 0.15, 0.1)}[role]):
            emit[(role, first), v] = p
        for v, p in zip(VALUES[4], (0.5, 0.5) if first else (0.7, 0.3)):  # where turns begin below blank lines is for the labelled ones to tell
            emit[(role, first), v] = p
    return _log(start, move, emit)


def _log(start: dict, move: dict, emit: dict) -> dict:
    ln = lambda p: math.log(max(p, 1e-12))
    return {
        "start": [ln(start.get(s, 1e-9)) for s in STATES],
        "move": [[ln(move[a].get(b, 1e-9)) for b in STATES] for a in STATES],
        "emit": {v: [ln(emit[s, v]) for s in STATES] for group in VALUES for v in group},
    }


def _scored(observed: list[tuple[str, ...]], model: dict) -> np.ndarray:
    """Log emissions, a row an observation."""
    emit = model["emit"]
    return np.array([np.sum([emit[v] for v in o], axis=0) for o in observed], float).reshape(-1, len(STATES))


def viterbi(observed: list[tuple[str, ...]], model: dict, entry: int | None = None, leave: int | None = None) -> list[int]:
    """The likeliest states of a sequence of feature tuples, after a state (None: at the start) and ending in one (None: in any)."""
    if not observed:
        return []
    emit, move = _scored(observed, model), np.array(model["move"])
    best = (np.array(model["start"]) if entry is None else move[entry]) + emit[0]
    back = []
    for e in emit[1:]:
        came = best[:, None] + move
        back.append(came.argmax(0))
        best = came.max(0) + e
    path = [int(best.argmax()) if leave is None else leave]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def between(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best score from each state before a sequence (log emissions) to each of its last states; unchanged states where it is empty."""
    out = np.where(np.eye(len(move), dtype=bool), 0.0, -np.inf)
    for e in emit:
        out = (out[:, :, None] + move[None]).max(1) + e
    return out


def pieces(transcript: str | None, model: dict, entry: int | None = None, leave: int | None = None, open_: bool = False) -> list[tuple[str, str, bool]]:
    """(role, text, whether a turn begins here) of each turn; the marker of its role and end signs are not part of the text."""
    lines, seen, observed = observe(transcript, open_)
    states = dict(zip(seen, viterbi(observed, model, entry, leave)))
    out: list[tuple[str, list[str], bool]] = []
    for i, line in enumerate(lines):
        role, first = STATES[states[i]] if i in states else (None, False)
        if role and (first or not out):
            m = _MARKER.match(line)
            begins = first or entry is None
            out.append((role, [m[2] if m and begins and _ROLE[m[1].lower()] == role else line], begins))
        elif out:
            out[-1][1].append(line)
    return [(role, "\n".join(text).strip(), begins) for role, text, begins in out]


def turns(transcript: str | None, model: dict) -> list[tuple[str, str]]:
    """(role, text) of each turn of a whole transcript."""
    return [(role, text) for role, text, _ in pieces(transcript, model)]


def render(parsed: list[tuple[str, str]]) -> str:
    """The canonical form."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in parsed)


def runs(conversations: DataFrame, line: Column | None = None, run: int = RUN, most: int = RUN_BYTES) -> DataFrame:
    """conv_id, run, piece, turns (array of turn, role, line): each conversation's turns in order, in groups of bounded size.

    line: how a turn is written (its text). Runs cut by number that hold more than
    four times ``run`` rows or ``most`` bytes are cut again, in the order of turns: the
    pieces one after another are the run, whatever its size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), (text if line is None else line).alias("line"))
    last = F.lit((1 << 62) // run)
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / run).cast("long"), last))
    size = rows.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("bytes"))
    big = size.filter((F.col("n") > 4 * run) | (F.col("bytes") > 4 * most))
    big = materialise(big.select(F.col("conv_id").alias("_conv"), F.col("run").alias("_run")), "chat-big")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("run") == F.col("_run"))
    if big.isEmpty():
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
    else:
        wide = join_small(rows, big, on)
        # copies are counted first, on the map side; a turn's place is what its run holds before it, then what its number holds
        many = wide.filter("_run is not null").groupBy("conv_id", "run", "turn", "role", "line").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.octet_length("line").cast("long"))
        total = many.groupBy("conv_id", "run", "turn").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
        until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        w = until(Window.partitionBy("conv_id", "run").orderBy(F.col("turn").isNull(), "turn"))  # a row a turn number
        at = total.select(F.col("conv_id").alias("_c"), F.col("run").alias("_r"), F.col("turn").alias("_t"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}") for c in ("rows", "bytes")])
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("run") == F.col("_r")) & F.col("turn").eqNullSafe(F.col("_t"))
        w = until(Window.partitionBy("conv_id", "run", "turn").orderBy("role", "line"))
        for c, x in (("rows", F.col("n")), ("bytes", F.col("n") * F.col("size"))):
            many = many.withColumn(c, F.coalesce(F.sum(x).over(w), F.lit(0)))
        many = many.join(at, same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        before = lambda c, each: F.col(c) + F.col(f"_{c}") + F.col("copy") * each
        many = many.withColumn("piece", (F.floor(before("rows", F.lit(1)) / run) + F.floor(before("bytes", F.col("size")) / most)).cast("long"))
        keep = ["conv_id", "run", "turn", "role", "line", "piece"]
        rows = wide.filter("_run is null").withColumn("piece", F.lit(0).cast("long")).select(*keep).unionByName(many.select(*keep))
    none_last = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "line")
    grouped = rows.groupBy("conv_id", "run", "piece").agg(F.array_sort(F.collect_list(none_last)).alias("turns"))
    return grouped.select("conv_id", "run", "piece", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["line"].alias("line"))).alias("turns"))


#: How transcripts write a speaker, by the conversation's hash: before and after the name.
STYLES = (("", ": "), ("### ", ":\n"), ("**", ":** "), ("[", "] "), ("<|", "|> "))


def written(unmarked: int = 4) -> Column:
    """A turn as a raw transcript has it: the style of marker differs by conversation, and one turn in ``unmarked`` carries none (0: all carry one)."""
    h = F.xxhash64(F.col("conv_id"))
    style = F.pmod(h, F.lit(len(STYLES)))
    before, after = (F.element_at(F.array(*[F.lit(x[k]) for x in STYLES]), (style + 1).cast("int")) for k in (0, 1))
    name = F.initcap(F.coalesce("role", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    full = F.concat(before, name, after, text)
    if not unmarked:
        return full
    return F.when(F.pmod(F.xxhash64("conv_id", "turn", F.lit("marker")), F.lit(unmarked)) == 0, text).otherwise(full)


def transcripts(grouped: DataFrame) -> DataFrame:
    """conv_id, run, piece, transcript of runs: turns below each other, a blank line between."""
    return grouped.select("conv_id", "run", "piece", F.array_join(F.transform("turns", lambda t: t["line"]), "\n\n").alias("transcript"))


def trainable(conv_id: Column | str = "conv_id") -> Column:
    """Conversations to learn from: crc32 of the id as text, modulo 3, is not 1."""
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _estimate(batches):
    """Counts of starts, moves and emissions in labelled runs, as (what, a, b, n)."""
    from collections import Counter

    counts: Counter = Counter()
    for batch in batches:
        for first_run, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            before = None
            for t in run:
                if t["role"] not in ROLES or not t["line"].strip():
                    before = None
                    continue
                _, _, observed = observe(t["line"], before is not None or not first_run)
                for k, o in enumerate(observed):
                    s = f"{t['role']}|{int(k == 0)}"
                    for v in o:
                        counts["emit", s, v] += 1
                    counts["line", s, ""] += 1
                if before is None and first_run and t is run[0]:
                    counts["start", t["role"], ""] += 1
                if before is not None:
                    counts["move", before, t["role"]] += 1
                before = t["role"]
    rows = [(*k, n) for k, n in counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i in range(4)], names=["what", "a", "b", "n"])


def learn(grouped: DataFrame, weight: float = 20.0) -> dict:
    """The default tables moved towards labelled runs (``runs``, with the lines as transcripts write them).

    Counted on the map side: what is shuffled is one row per table entry and task.
    ``weight``: how many lines, turns or conversations the default tables count as.
    """
    bound_batches(grouped.sparkSession)
    counted = grouped.select(((F.col("run") == 0) & (F.col("piece") == 0)).alias("begins"), "turns").mapInArrow(_estimate, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    got = {(r.what, r.a, r.b): r.n for r in counted.collect()}  # states times values at most
    model = default_model()
    starts = sum(got.get(("start", r, ""), 0) for r in ROLES)
    turned = {r: sum(got.get(("move", r, to), 0) for to in ROLES) for r in ROLES}
    for s, (role, first) in enumerate(STATES):
        name = f"{role}|{int(first)}"
        lines = got.get(("line", name, ""), 0)
        for group in VALUES:
            for v in group:
                old = math.exp(model["emit"][v][s])
                model["emit"][v][s] = math.log((got.get(("emit", name, v), 0) + weight * old) / (lines + weight))
        if first:
            old = math.exp(model["start"][s])
            model["start"][s] = math.log((got.get(("start", role, ""), 0) + weight * old) / (starts + weight))
        # after a line: another of the same turn, or the first of a turn of each role
        begun, later = got.get(("line", f"{role}|1", ""), 0), got.get(("line", f"{role}|0", ""), 0)
        here, on = (begun, later) if not first else (begun, begun)
        stay = (later + weight * 0.5) / (begun + later + weight)
        change = [math.exp(model["move"][s][STATES.index((to, True))]) for to in ROLES]
        for k, to in enumerate(ROLES):
            p = (got.get(("move", role, to), 0) + weight * change[k] / sum(change)) / (turned[role] + weight)
            model["move"][s][STATES.index((to, True))] = math.log((1 - stay) * p)
        model["move"][s][STATES.index((role, False))] = math.log(stay)
    return model


def _parse(batches, model):
    for batch in batches:
        names = batch.schema.names
        got = [turns(t, model) for t in batch.column(names.index("transcript")).to_pylist()]
        row = [i for i, ts in enumerate(got) for _ in ts]
        kept = [i for i, n in enumerate(names) if n != "transcript"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i).take(pa.array(row, pa.int64())) for i in kept]
            + [pa.array([k for ts in got for k in range(len(ts))], pa.int64()), pa.array([r for ts in got for r, _ in ts], pa.string()), pa.array([t for ts in got for _, t in ts], pa.string()), pa.array([render([t]) for ts in got for t in ts], pa.string())],
            names=[names[i] for i in kept] + ["turn", "role", "text", "rendered"],
        )


def parse(raw: DataFrame, model: dict | None = None) -> DataFrame:
    """The columns beside ``transcript``, then turn, role, text, rendered of each recovered turn; every transcript stands for itself."""
    bound_batches(raw.sparkSession)
    model = model or default_model()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema if f.name != "transcript")
    return raw.mapInArrow(lambda it: _parse(it, model), fields + ", turn long, role string, text string, rendered string")


def _matrices(batches, model):
    """Of each run with lines: its matrix, and the scores of its last states if the conversation begins with it."""
    move, start = np.array(model["move"]), np.array(model["start"])
    for batch in batches:
        ms, vs = [], []
        for t in batch.column(3).to_pylist():
            later, first = (_scored(observe(t, open_)[2], model) for open_ in (True, False))
            if not len(later):
                ms.append(None)
                vs.append(None)
                continue
            rest = between(later[1:], move)
            ms.append(((move + later[0])[:, :, None] + rest[None]).max(1).ravel().tolist())
            vs.append(((start + first[0])[:, None] + rest).max(0).tolist())
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], *[pa.array(x, pa.list_(pa.float64())) for x in (ms, vs)]], names=["conv_id", "run", "piece", "m", "v"])


def _borders(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before (-1: the start) and at the end of each run on the conversation's best path."""
    rows = rows.sort_values(["run", "piece"]).reset_index(drop=True)
    best, back = np.array(rows["v"][0]), []
    for m in rows["m"][1:]:
        came = best[:, None] + np.array(m).reshape(len(STATES), -1)
        back.append(came.argmax(0))
        best = came.max(0)
    leave = [int(best.argmax())]
    for came in reversed(back):
        leave.append(int(came[leave[-1]]))
    leave = leave[::-1]
    return rows.assign(entry=[-1, *leave[:-1]], leave=leave)[["conv_id", "run", "piece", "entry", "leave"]]


def _decode(batches, model):
    for batch in batches:
        out: list[tuple] = []
        for i, (text, entry, leave) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))):
            for k, (role, part, begins) in enumerate(pieces(text, model, None if entry < 0 else entry, leave, entry >= 0)):
                out.append((i, k, role, part, begins))
        at = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(k).take(at) for k in range(3)] + [pa.array([o[1] for o in out], pa.int64()), *[pa.array([o[k] for o in out], pa.string()) for k in (2, 3)], pa.array([o[4] for o in out], pa.bool_())],
            names=["conv_id", "run", "piece", "k", "role", "text", "begins"],
        )


def recover(conversations: DataFrame, model: dict, line: Column | None = None, run: int = RUN, most: int = RUN_BYTES) -> DataFrame:
    """conv_id, turn, role, text, rendered of the turns recovered from each conversation's transcript (``line``: how a turn is written)."""
    grouped = runs(conversations, line, run, most)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    model = model or default_model()
    span = conversations.select("conv_id", F.coalesce(F.floor(F.col("turn") / run), F.lit(-1)).alias("run"), F.octet_length("text").alias("size"))
    long = span.groupBy("conv_id").agg(F.min("run").alias("a"), F.max("run").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    long = long.filter((F.col("a") < F.col("b")) | (F.col("n") > 4 * run) | (F.col("bytes") > 2 * most)).select(F.col("conv_id").alias("_long"))
    long = materialise(long, "chat-long")
    names = ["conv_id", "turn", "role", "text", "rendered"]
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    if long.isEmpty():
        return parse(transcripts(grouped), model).select(*names)
    short = parse(transcripts(join_small(grouped, long, same, "left_anti")), model).select(*names)
    part = materialise(transcripts(join_small(grouped, long, same, "left_semi")), "chat-runs")
    bound_batches(part.sparkSession)
    found = part.mapInArrow(lambda it: _matrices(it, model), f"conv_id {kind}, run long, piece long, m array<double>, v array<double>").filter("m is not null")
    borders = found.groupBy("conv_id").applyInPandas(_borders, f"conv_id {kind}, run long, piece long, entry int, leave int")
    borders = materialise(borders.select(F.col("conv_id").alias("_conv"), F.col("run").alias("_run"), F.col("piece").alias("_piece"), "entry", "leave"), "chat-borders")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("run") == F.col("_run")) & (F.col("piece") == F.col("_piece"))
    joined = join_small(part, borders, on, "inner").select("conv_id", "run", "piece", "transcript", "entry", "leave")
    got = joined.mapInArrow(lambda it: _decode(it, model), f"conv_id {kind}, run long, piece long, k long, role string, text string, begins boolean")
    got = materialise(got, "chat-pieces")
    opened = got.groupBy("conv_id", "run", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("begins").cast("long")).alias("begun"))
    before = F.sum("begun").over(Window.partitionBy("conv_id").orderBy("run", "piece").rowsBetween(Window.unboundedPreceding, -1))  # a row a run
    opened = opened.select(F.col("conv_id").alias("_conv"), F.col("run").alias("_run"), F.col("piece").alias("_piece"), (F.coalesce(before, F.lit(0)) - (F.col("n") - F.col("begun"))).alias("_before"))
    placed = join_small(got, materialise(opened, "chat-opened"), on, "inner").withColumn("turn", F.col("_before") + F.col("k"))
    at = F.struct("run", "piece", "k")
    whole = placed.groupBy("conv_id", "turn").agg(F.min_by("role", at).alias("role"), F.array_sort(F.collect_list(F.struct("run", "piece", "k", "text"))).alias("_parts"))
    whole = whole.withColumn("text", F.array_join(F.transform("_parts", lambda x: x["text"]), "\n\n"))
    return short.unionByName(whole.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))).select(*names))
