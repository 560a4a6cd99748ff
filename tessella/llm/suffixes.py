"""Substring dedup by longest previous factors, to a depth of `length` bytes.

A byte goes if a string of `length` bytes that covers it also starts elsewhere. That is a statement
about the array of longest previous factors and its mirror: the factor at a position reaches `length`
where the suffix order, cut off at that depth, has an equal suffix at a smaller position (for the
mirror: a larger one). Suffixes that are equal to that depth are neighbours in the order, so within
such a run the smallest position is the previous smaller one of all others, and no other part of
the order matters. Runs are found without sorting all suffixes:

* Every window of `length` bytes has an anchor, the leftmost least hash among its strings of CORE bytes,
  which depends on its content alone: equal windows have equal anchors at equal offsets. Neighbouring
  windows share anchors, so anchors are few, one for about 70 bytes.
* Windows of an anchor form its context. A core (the CORE bytes at an anchor) that occurs once settles
  all its windows: nothing equals them. Where all contexts of a core are the same text, all windows of
  all of them have copies. Only the first of each context of other cores is opened: the suffixes that
  start at its windows are sorted with those of its core, as bytes, to the depth of `length`.

A core of many contexts is dealt to parts by a hash of the window, ten at most; a core of more
than MANY contexts goes the way of fingerprints, a row a window. Fingerprints of a core and of a context (or window) have
64 bits each, so it takes 128 equal bits to be taken for equal. Aggregates combine before they shuffle, joins have
plain exchanges on both sides, which adaptive execution splits where a key is hot, and texts are sent compressed.

Positions are ordered by document id, then text fingerprint, then byte. With `keep_first` only later
copies go: what equals something at a smaller position. Defined cases: null texts count as empty; texts
shorter than `length` stay whole; rows equal in id and text are copies of each other, and with
`keep_first` all of them keep what the first keeps; a null id comes before all others; columns other than
id and text are not carried; an empty table gives an empty result. Kept bytes are binary, as a removed
string may begin inside a character.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, release, task_count, text_or_empty, written

LENGTH, CORE = 200, 64
#: Bytes that are hashed at once; positions in a piece have so many bits.
PIECE, PLACE_BITS = 1 << 20, 24
#: Contexts that are sorted together; cores of more than MANY contexts go the way of fingerprints.
GROUP, MANY = 2048, 20_000
#: A class with more rows than a task's share by this part is dealt to several tasks.
HOT_PART = 4
BASE = 0x9E3779B97F4A7C15 | 1
ANCHORS = "core long, x long, id long, h long, start int, n int"


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, powers of the base and of its inverse."""
    letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    inverse = pow(BASE, -1, 1 << 64)
    powers = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
    return letters, powers(BASE), powers(inverse)


class Hashes:
    """Fingerprints of all substrings of a piece of bytes, from sums over its prefixes."""

    def __init__(self, data: bytes):
        self.n = len(data)
        size = PIECE
        while size < self.n:
            size *= 2
        letters, up, self.down = _tables(size)
        terms = letters[np.frombuffer(data, np.uint8)] * up[: self.n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        return _mixed((self.sums[length:] - self.sums[: self.n + 1 - length]) * self.down[: self.n + 1 - length] + np.uint64(length))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def contexts(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(core, context's fingerprint, start, number of windows) of the anchors of texts that lie one after another.

    `ends` are the texts' ends in `data`; starts are places in `data`.
    """
    h = Hashes(data)
    if h.n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    core = h.all(CORE)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = _least((core & ~place) | np.arange(len(core), dtype=np.uint64), length - CORE + 1)
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - begins - length + 1, 0)
    offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(begins, counts) + offsets
    anchor = (least[start] & place).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (offsets[1:] == 0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    s = start[first]
    return core[anchor[first]], h.of(s, s + n - 1 + length), s, n


def _pieces(ids, hs, texts, length: int):
    """(ids, fingerprints, places in the text, ends, bytes) of groups of texts; a very long text comes in overlapping pieces."""
    group, size = [], 0
    for i, h, t in zip(ids, hs, texts, strict=True):
        if len(t) < length:
            continue
        step = 4 * PIECE
        for at in range(0, max(1, len(t) - length + 1), step):
            piece = t[at: at + step + length - 1]
            if group and size + len(piece) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, h, at, piece))
            size += len(piece)
    if group:
        yield group


def _bytes(column) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def anchors(rows: DataFrame, length: int, narrow: bool) -> DataFrame:
    """Anchors of all texts; narrow: core and context only."""
    ddl = "core long, x long" if narrow else ANCHORS
    kinds = arrow_schema(rows.sparkSession, ddl)

    def run(batches):
        for b in batches:
            for group in _pieces(b.column("id").to_pylist(), b.column("h").to_pylist(), _bytes(b.column("text")), length):
                ends = np.cumsum([len(g[3]) for g in group])
                core, x, start, n = contexts(b"".join(g[3] for g in group), ends, length)
                cols = [core.view(np.int64), x.view(np.int64)]
                if not narrow:
                    whose = np.searchsorted(ends, start, side="right")
                    own = lambda k, w=whose, g=group: np.array([y[k] for y in g], np.int64)[w]
                    shift = own(2) - np.concatenate([[0], ends[:-1]])[whose]
                    cols += [own(0), own(1), (start + shift).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=kinds)
        release()

    return rows.mapInArrow(run, ddl)


def opened(texts: DataFrame, length: int) -> DataFrame:
    """(core, parts, id, h, start, n, solo, x): the bytes of the contexts `asked` of each packed text."""
    ddl = "core long, parts int, id long, h long, start int, n int, solo boolean, x binary"
    kinds = arrow_schema(texts.sparkSession, ddl)

    def run(batches):
        import zstandard

        for b in batches:
            for i, h, z, asked in zip(b.column("id").to_pylist(), b.column("h").to_pylist(), b.column("z").to_pylist(), b.column("asked"), strict=True):
                data, want = zstandard.decompress(z), asked.values
                core, parts, start, n, solo = (want.field(k) for k in ("core", "parts", "start", "n", "solo"))
                x = [data[s: s + k - 1 + length] for s, k in zip(start.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([core, parts, pa.array(np.full(len(x), i), pa.int64()), pa.array(np.full(len(x), h), pa.int64()), start, n, solo, pa.array(x, pa.binary())], schema=kinds)
        release()

    return texts.mapInArrow(run, ddl)


def suffix_runs(core: np.ndarray, x: list[bytes], part: np.ndarray, parts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(context, window, run) of the windows of contexts that are in a part, in suffix order.

    Suffixes are sorted as byte strings to a depth of `length`, core by core; those with a common prefix of that length are a run.
    """
    n = np.array([len(v) - length + 1 for v in x])
    whose = np.repeat(np.arange(len(x)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    joined = b"".join(x)
    begin = np.cumsum([0, *map(len, x[:-1])])
    if (parts > 1).any():  # equal windows fall into equal parts
        at = begin[whose] + window
        mine = Hashes(joined).of(at, at + length) % parts[whose].astype(np.uint64) == part[whose].astype(np.uint64)
        whose, window = whose[mine], window[mine]
    data = np.frombuffer(joined, np.uint8)
    rows = np.empty((len(whose), 8 + length), np.uint8)
    rows[:, :8] = core.astype(">i8").view(np.uint8).reshape(-1, 8)[whose]
    rows[:, 8:] = np.lib.stride_tricks.sliding_window_view(data, length)[begin[whose] + window]
    order = np.argsort(rows.view(f"V{8 + length}").ravel(), kind="stable")
    rows = rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return whose[order], window[order], np.cumsum(new) - 1


def resolved(contexts_: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(id, h, start, n): windows that start elsewhere too, neighbours as one row; with `keep_first` those that start earlier.

    Of a run in suffix order the smallest position is the previous smaller one of all others: their longest previous factor has
    the full length. What is not the largest has a next one, for the mirror.
    """
    ddl = "id long, h long, start int, n int"
    kinds = arrow_schema(contexts_.sparkSession, ddl)

    def solve(rows: list[dict]) -> pa.RecordBatch:
        core, ids, hs, start, part, parts = (np.array([r[k] for r in rows], np.int64) for k in ("core", "id", "h", "start", "part", "parts"))
        whose, window, run = suffix_runs(core, [r["x"] for r in rows], part, parts, length)
        if keep_first:
            place = np.lexsort((start[whose] + window, hs[whose], ids[whose], run))
            whose, window, run = whose[place], window[place], run[place]
            hit = np.zeros(len(run), bool)
            hit[1:] = run[1:] == run[:-1]
        else:
            hit = (np.bincount(run)[run] > 1) & np.array([r["solo"] for r in rows])[whose]
        whose, at = whose[hit], window[hit]
        order = np.lexsort((at, whose))
        whose, at = whose[order], at[order]
        first = np.ones(len(at), bool)
        first[1:] = (whose[1:] != whose[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(first)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids[whose[head]], hs[whose[head]], start[whose[head]] + at[head], np.diff(np.append(head, len(at)))), kinds.types, strict=True)], schema=kinds)

    def run_(batches):
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if len(held) >= GROUP and (row["core"], row["part"]) != (held[-1]["core"], held[-1]["part"]):
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)
        release()

    spread = contexts_.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.repartition("core", "part").sortWithinPartitions("core", "part").mapInArrow(run_, ddl)


def resolved_alone(contexts_: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for cores of so many contexts that one offset of them is too much for a task: a row a window, by fingerprint."""
    ddl = "core long, w long, id long, h long, start int, solo boolean"
    kinds = arrow_schema(contexts_.sparkSession, ddl)

    def run(batches):
        for b in batches:
            x = b.column("x").to_pylist()
            n = b.column("n").to_numpy()
            w = np.concatenate([Hashes(v).all(length) for v in x]) if x else np.zeros(0, np.uint64)
            core, ids, hs, start, solo = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), n) for c in ("core", "id", "h", "start", "solo"))
            step = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((core, w.view(np.int64), ids, hs, start + step, solo), kinds.types, strict=True)], schema=kinds)
        release()

    inside = written(contexts_.mapInArrow(run, ddl), "windows")
    place = F.struct("id", "h", "start")
    equal = inside.groupBy("core", "w").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1")
    found = inside.where(F.col("solo") | F.lit(keep_first)).join(equal, ["core", "w"])
    return (found.where(place != F.col("first")) if keep_first else found).select("id", "h", "start", F.lit(1).alias("n"))


def packed(rows: DataFrame) -> DataFrame:
    """(id, h, none, z): texts compressed, for exchanges."""
    ddl = "id long, h long, none boolean, z binary"
    kinds = arrow_schema(rows.sparkSession, ddl)

    def run(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), b.column("none"), pa.array([c.compress(t) for t in _bytes(b.column("text"))], pa.binary())], schema=kinds)

    return rows.mapInArrow(run, ddl)


def _cut(texts: DataFrame, length: int, id_col: str) -> DataFrame:
    """Texts without the bytes that the windows in `spans` cover."""
    ddl = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: int, end: int>>, kept binary"
    kinds = arrow_schema(texts.sparkSession, ddl)

    def run(batches):
        import zstandard

        for b in batches:
            out = []
            for i, none, z, spans in zip(b.column("id").to_pylist(), b.column("none").to_pylist(), b.column("z").to_pylist(), b.column("spans"), strict=True):
                data = zstandard.decompress(z)
                change = np.zeros(len(data) + 1, np.int32)
                if spans.is_valid:
                    first, n = (spans.values.field(k).to_numpy() for k in ("start", "n"))
                    np.add.at(change, first, 1)
                    np.add.at(change, first + n - 1 + length, -1)
                gone = np.concatenate([[0], np.cumsum(change)[:-1] > 0, [0]]).astype(np.int8)
                step = np.diff(gone)
                found = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
                kept = np.frombuffer(data, np.uint8)[gone[1:-1] == 0].tobytes() if found else data
                out.append((None if none else i, len(data), len(data) - len(kept), len(found), [{"start": s, "end": e} for s, e in found], kept))
            cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.types, strict=True)], schema=kinds)
        release()

    return texts.mapInArrow(run, ddl)


def _copies(again: DataFrame, classes: DataFrame) -> DataFrame:
    """Contexts with the first of their class; classes of more than a task's share of rows are dealt to several tasks.

    There are at most as many such classes as tasks times HOT_PART, so they may be broadcast.
    """
    share = F.ceil(classes.agg(F.sum("c")).scalar() / (task_count(again.sparkSession) * HOT_PART))
    parts = F.when(F.col("c") > share, F.ceil(F.col("c") / share)).otherwise(1)
    hot = classes.where(F.col("c") > share).select("core", "x", parts.alias("parts"))
    rows = again.join(F.broadcast(hot), ["core", "x"], "left").withColumn("deal", F.pmod(F.xxhash64("id", "h", "start"), F.coalesce("parts", F.lit(1))))
    firsts = classes.select("core", "x", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("deal"))
    return rows.join(firsts, ["core", "x", "deal"])


def remove_repeats(df: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) of every document; spans are removed byte ranges."""
    if length < CORE:
        raise ValueError(f"a string has {CORE} bytes at least")
    text = text_or_empty(text_col)
    none = F.col(id_col).isNull()
    rows = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(none, text).alias("h"), none.alias("none"), text.alias("text"))
    long = rows.where(F.octet_length("text") >= length)

    # cores that occur again, and whether all their contexts are one text
    seen = anchors(long, length, narrow=True).groupBy("core").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
    cores = written(seen.where("c > 1").select("core", (F.col("low") != F.col("high")).alias("open")), "cores")
    again = written(anchors(long, length, narrow=False).join(cores, "core"), "contexts")

    place = F.struct("id", "h", "start")
    classes = written(again.where(F.col("open") | F.lit(keep_first)).groupBy("core", "x", "open").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "start", "n")).alias("first")), "classes")
    sizes = classes.where("open").groupBy("core").agg(F.count("*").alias("m"))
    asked = (classes.where("open").join(sizes, "core").select("first.*", "core", (F.col("c") == 1).alias("solo"), F.when(F.col("m") > MANY, 0).otherwise(F.ceil(F.col("m") / GROUP)).cast("int").alias("parts"))
             .groupBy("id", "h").agg(F.collect_set(F.struct("core", "parts", "start", "n", "solo")).alias("asked")))
    inside = opened(packed(long).join(asked, ["id", "h"]).select("id", "h", "z", "asked"), length)
    parts = [resolved(inside.where("parts > 0"), length, keep_first)]
    if not sizes.where(F.col("m") > MANY).isEmpty():
        parts.append(resolved_alone(inside.where("parts = 0"), length, keep_first))
    copied = _copies(again, classes.where("c > 1"))
    if keep_first:
        parts.append(copied.where(place != F.struct("first.id", "first.h", "first.start")).select("id", "h", "start", "n"))
    else:
        parts += [again.where("not open").select("id", "h", "start", "n"), copied.select("id", "h", "start", "n")]
    spans = reduce(DataFrame.unionByName, parts)
    by_text = written(spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")
    discard(cores, again, classes)
    return _cut(packed(rows).join(by_text, ["id", "h"], "left").select("id", "none", "z", "spans"), length, id_col)
