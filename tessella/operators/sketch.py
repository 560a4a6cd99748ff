"""A mergeable quantile sketch of fixed size that knows its own error.

Values lie in levels; a value of level h stands for 2**h values. A full level is sorted and every other value moves one level
up, first the odd, next time the even places. One such step changes the rank of any value by 2**h at most, so the sum of
the steps' weights is a bound on the error of every rank, and it is carried along and added up when sketches merge. Rows
are sketched task by task, sketches meet in a tree, and the last few on the driver.

Defined cases: nulls and numbers that are not finite are left out and not counted; an empty table gives a sketch without values
whose quantiles are null; equal values are as many values as there are rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a level; rank errors are about log2(n / SIZE) / SIZE of all rows.
SIZE = 2048


@dataclass
class Sketch:
    size: int = SIZE
    n: int = 0
    error: int = 0
    levels: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])
    turns: list[int] = field(default_factory=lambda: [0])

    def add(self, values: np.ndarray) -> None:
        for at in range(0, len(values), self.size):
            part = values[at: at + self.size]
            self.n += len(part)
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._compact()

    def merge(self, other: Sketch) -> None:
        self.n, self.error = self.n + other.n, self.error + other.error
        for h, v in enumerate(other.levels):
            self._level(h)
            self.levels[h] = np.concatenate([self.levels[h], v])
        self._compact()

    def _level(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.zeros(0))
            self.turns.append(0)

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            v = self.levels[h]
            if len(v) > self.size:
                v = np.sort(v)
                even = len(v) // 2 * 2
                self._level(h + 1)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], v[self.turns[h]: even: 2]])
                self.levels[h], self.turns[h] = v[even:], 1 - self.turns[h]
                self.error += 1 << h
            h += 1

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Values whose rank is within `error` of each share of the rows."""
        if not self.n:
            return [None] * len(shares)
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(w[order])
        return [float(v[order][min(len(v) - 1, int(np.searchsorted(upto, max(1, math.ceil(s * self.n)))))]) for s in shares]

    def to_row(self) -> dict:
        return {"n": self.n, "error": self.error, "levels": [x.tolist() for x in self.levels], "turns": self.turns}

    @classmethod
    def from_row(cls, row: dict, size: int) -> Sketch:
        return cls(size, row["n"], row["error"], [np.array(x, float) for x in row["levels"]], list(row["turns"]))


KIND = pa.schema([("n", pa.int64()), ("error", pa.int64()), ("levels", pa.list_(pa.list_(pa.float64()))), ("turns", pa.list_(pa.int32()))])
DDL = "n long, error long, levels array<array<double>>, turns array<int>"


def sketch(df: DataFrame, column: str, size: int = SIZE) -> Sketch:
    """The sketch of a column over all rows."""
    v = df.select(F.col(column).cast("double").alias("v"))
    v = v.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))

    def start(batches):
        own = Sketch(size)
        for b in batches:
            own.add(b.column("v").to_numpy())
        if own.n:
            yield pa.RecordBatch.from_pylist([own.to_row()], KIND)

    def meet(batches):
        own = None
        for b in batches:
            for row in b.to_pylist():
                one = Sketch.from_row(row, size)
                if own is None:
                    own = one
                else:
                    own.merge(one)
        if own is not None:
            yield pa.RecordBatch.from_pylist([own.to_row()], KIND)

    tasks = v.rdd.getNumPartitions()
    found = v.mapInArrow(start, DDL)
    while tasks > 16:
        tasks = math.isqrt(tasks)
        found = found.repartition(tasks).mapInArrow(meet, DDL)
    out = Sketch(size)
    for r in found.collect():  # sixteen sketches at most
        out.merge(Sketch.from_row(r.asDict(), size))
    return out


def quantile_table(df: DataFrame, column: str, percents: list[int], size: int = SIZE) -> DataFrame:
    """(percent, value, n, rank_error): a value for each percent, and what its rank may be off by at most."""
    own = sketch(df, column, size)
    rows = list(zip(percents, own.quantiles([p / 100 for p in percents]), strict=True))
    return df.sparkSession.createDataFrame([(p, v, own.n, own.error) for p, v in rows], "percent int, value double, n long, rank_error long")
