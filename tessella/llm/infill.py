"""Fill-in-middle transformation: texts cut at seeded unit boundaries and put out of order.

A unit is a run of letters A-Z and a-z or any other single character. Identical texts share one
index entry: documents are dealt by a hash of their text, the rows of a hash come one after
another, and a text is looked up by its content, so two texts with one hash stay two. An entry is
an Elias-Fano list of the ends of the text's units, made once for each distinct text of a task; each
document joins it and takes its own two boundaries from the list by select.

A hash that holds more than its share of all rows is dealt to several tasks, each of which makes the
entry once. Those hashes are counted first; there are at most as many as tasks were asked for (times
four), so the table of them is broadcast. One shuffle moves the texts, a task holds the entries of
one hash.

Defined cases: null texts count as empty and stay plain, so do texts that contain a marker; a null id
takes the seed of an empty number; rows with equal ids and texts all stay, with equal results; columns
other than id and text pass only where `keep` names them, and results replace kept columns of their
own names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, task_count, text_or_empty

#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are cut, and of 100 cut ones so many begin with the suffix.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
#: A hash with more rows than a task's share by this part is dealt to several tasks.
HOT_PART = 4
#: Bits of the unary part between two stored counts.
BLOCK = 512
RESULT = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
          T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


class EliasFano:
    """An ascending list of numbers up to `bound`: low bits packed, high bits in unary with counts a block."""

    def __init__(self, values: np.ndarray, bound: int):
        self.n = len(values)
        self.low_bits = max(0, (bound // self.n).bit_length() - 1) if self.n else 0
        low = self.low_bits
        values = values.astype(np.int64)
        ones = (values >> low) + np.arange(self.n)
        size = -(-(int(ones[-1]) + 1 if self.n else 1) // BLOCK) * BLOCK
        unary = np.zeros(size, np.uint8)
        unary[ones] = 1
        self.high = np.packbits(unary, bitorder="little")
        self.upto = np.cumsum(np.bitwise_count(self.high.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64))
        self.low = np.packbits((values[:, None] >> np.arange(low) & 1).astype(np.uint8).ravel(), bitorder="little")

    def select(self, k: int) -> int:
        """The number at place k from 0."""
        block = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[block - 1]) if block else 0
        bits = np.unpackbits(self.high[block * BLOCK // 8: (block + 1) * BLOCK // 8], bitorder="little")
        high = block * BLOCK + int(np.flatnonzero(bits)[k - before]) - k
        if not self.low_bits:
            return high
        first = k * self.low_bits
        raw = np.unpackbits(self.low[first // 8: (first + self.low_bits + 7) // 8], bitorder="little")
        return high << self.low_bits | int(raw[first % 8: first % 8 + self.low_bits] @ (1 << np.arange(self.low_bits)))

    def nbytes(self) -> int:
        return self.high.nbytes + self.low.nbytes + self.upto.nbytes


def unit_ends(text: str) -> np.ndarray:
    """Where units end, in code points: behind every character that is no letter, and where a run of letters ends."""
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = points | 32
    letter = (folded >= 97) & (folded <= 122) & (points < 128)
    inside = np.zeros(len(points), bool)
    inside[:-1] = letter[:-1] & letter[1:]
    return np.flatnonzero(~inside) + 1


class Entry:
    """What the index holds of a distinct text: its boundaries, and whether it has to stay plain."""

    def __init__(self, text: str, markers: Sequence[str]):
        self.plain = not text or any(m in text for m in markers)
        self.ends = EliasFano(unit_ends(text), len(text))

    def boundary(self, units: int) -> int:
        return self.ends.select(units - 1) if units else 0


def seeds(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k: k + 8], 16) for k in range(0, 32, 8)]


def cut(doc_id: int | None, text: str, entry: Entry, seed: int, markers: Sequence[str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a document."""
    n = entry.ends.n
    h1, h2, h3, h4 = seeds(doc_id, seed)
    if entry.plain or h3 % 100 >= CUT_SHARE:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = entry.boundary(a), entry.boundary(b)
    p, s, m = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _dealt(df: DataFrame) -> DataFrame:
    """Rows with `_hash` of their text and `_deal`, which spreads the rows of a hot hash."""
    hashed = df.withColumn("_hash", F.xxhash64("_text"))
    tasks = task_count(df.sparkSession) * HOT_PART
    counts = hashed.groupBy("_hash").agg(F.count("*").alias("_rows"))
    share = F.ceil(counts.select(F.sum("_rows")).scalar() / tasks)
    hot = counts.where(F.col("_rows") > share).select("_hash", F.ceil(F.col("_rows") / share).alias("_parts"))
    spread = hashed.join(F.broadcast(hot), "_hash", "left")
    return spread.withColumn("_deal", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), "_parts")).otherwise(0)).drop("_parts")


def fill_in_middle(df: DataFrame, seed: int = 1, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text",
                   markers: Sequence[str] = MARKERS) -> DataFrame:
    """The kept columns, n, form, prefix_chars, middle_chars and output of every document."""
    names = {f.name for f in RESULT}
    kept = [c for c in keep if c not in names]
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
    dealt = _dealt(rows).repartition("_hash", "_deal").sortWithinPartitions("_hash")
    carried = [f"k{i}" for i in range(len(kept))]
    schema = T.StructType([*[rows.schema[c] for c in carried], *RESULT])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    marks = tuple(markers)

    def run(batches):
        current, index = None, {}
        for b in batches:
            done = []
            for h, doc_id, text in zip(b.column("_hash").to_pylist(), b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
                if h != current:
                    current, index = h, {}
                entry = index.get(text)
                if entry is None:
                    entry = index[text] = Entry(text, marks)
                done.append(cut(doc_id, text, entry, seed, marks))
            cols = list(zip(*done, strict=True)) if done else [()] * len(kinds)
            added = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            added[-1] = added[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *added], names=[*carried, *[f.name for f in RESULT]])
        release()

    out = dealt.mapInArrow(run, schema)
    return out.select(*[F.col(c).alias(k) for c, k in zip(carried, kept, strict=True)], *[f.name for f in RESULT])


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made from, out of the output and its form alone.

    Markers do not occur in a cut text, and as they neither overlap themselves nor each other, the
    first of each kind in an output is the one that was put in.
    """
    p, s, m = markers
    first, second = F.when(form == "spm", s).otherwise(p), F.when(form == "spm", p).otherwise(s)
    body = F.substr(output, F.length(first) + 1)
    two, three = F.instr(body, second), F.instr(body, F.lit(m))
    left = F.substr(body, F.lit(1), two - 1)
    right = F.substr(body, two + F.length(second), three - two - F.length(second))
    middle = F.substr(body, three + len(m))
    return F.when(form == "plain", output).when(form == "spm", F.concat(right, middle, left)).otherwise(F.concat(left, middle, right))
