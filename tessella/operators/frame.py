"""A table with an optional row order: addressing, predicates, assignment and set-like operators.

A Frame is a DataFrame plus the names of the columns that order its rows. Operations by position
(slices, row lists, first occurrence) need an order and refuse to run without one: Spark's rows have
none of their own. Every operation returns a new Frame; nothing writes through to a parent.

Null rules: equality is two-valued and null equals null; an ordering comparison with null is null
and rejects the row; a null cell of a looked-up row matches anything.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import in_ranges

RID = "_rid"


class FrameError(ValueError):
    """An operation that the table's shape or names do not allow."""


# Predicates and elementwise operators ------------------------------------------------------------

def equals(c: Column, value) -> Column:
    """Two-valued equality; a set means membership, null included if the set holds None."""
    if isinstance(value, (set, frozenset)):
        some = [v for v in value if v is not None]
        hit = F.coalesce(c.isin(some), F.lit(False)) if some else F.lit(False)
        return hit | c.isNull() if None in value else hit
    return c.eqNullSafe(value)


def differs(c: Column, value) -> Column:
    """True for null against any value that is not null."""
    return ~equals(c, value)


def compare(c: Column, op: str, value) -> Column:
    """One of < > <= >=; null on either side gives null."""
    v = value if isinstance(value, Column) else F.lit(value)
    return {"<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[op]


def arithmetic(a: Column, op: str, b: Column, text: bool = False) -> Column:
    """+ - * / // ** %; nulls propagate, + of texts concatenates, // rounds down."""
    if op == "+" and text:
        return F.concat(a, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a.cast("double") / b, "//": lambda: F.floor(a.cast("double") / b),
            "**": lambda: F.pow(a, b), "%": lambda: a % b}[op]()


def row_elementwise(cols: Sequence[Column], op: str, values: Sequence) -> Column:
    """Array of the results of an operator on each cell of a row and a value of the same place."""
    if len(cols) != len(values):
        raise FrameError("a row and the values it is combined with have to be of one length")
    done = []
    for c, v in zip(cols, values, strict=True):
        v = v if isinstance(v, Column) else F.lit(v)
        done.append(c.eqNullSafe(v) if op == "==" else ~c.eqNullSafe(v) if op == "!=" else compare(c, op, v) if op in ("<", ">", "<=", ">=") else arithmetic(c, op, v))
    return F.array(*done)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_iterable(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StringType))


def row_matches(df: DataFrame, row: Sequence) -> Column:
    """Whether a row equals the given cells; null on either side matches anything."""
    if len(row) != len(df.columns):
        raise FrameError("a looked-up row needs a cell for each column")
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == F.lit(v), F.lit(True)) if v is not None else F.lit(True) for c, v in zip(df.columns, row, strict=True)], F.lit(True))


class Frame:
    """DataFrame and the columns that order its rows."""

    def __init__(self, df: DataFrame, order: Sequence[str] | str | None = None):
        self.df = df
        self.order = [order] if isinstance(order, str) else list(order or [])
        if missing := set(self.order) - set(df.columns):
            raise FrameError(f"no such order columns: {sorted(missing)}")

    # Construction and shape

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str] | None = None, types: Sequence[str] | None = None) -> Frame:
        """Rows in the order given, kept in column _rid; names default to "0", "1" and so on."""
        width = len(rows[0]) if rows else len(names or ())
        names = list(names) if names is not None else [str(i) for i in range(width)]
        if any(not isinstance(n, str) for n in names):
            raise FrameError("names have to be texts")
        if types is not None and len(types) != len(names) or any(len(r) != len(names) for r in rows):
            raise FrameError("names, types and rows have to be of one length")
        if types is None:
            types = [next(({bool: "boolean", int: "bigint", float: "double", str: "string"}[type(r[i])] for r in rows if r[i] is not None), "string") for i in range(len(names))]
        kinds = {"bigint": int, "double": float, "string": str, "boolean": bool}
        cast = [[None if v is None else kinds[t](v) if t in kinds else v for v, t in zip(r, types, strict=True)] for r in rows]
        schema = T.StructType([T.StructField(RID, T.LongType(), False), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, types, strict=True))])
        return cls(spark.createDataFrame([[i, *r] for i, r in enumerate(cast)], schema), RID)

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != RID]

    @property
    def types(self) -> list[str]:
        return [self.df.schema[c].dataType.simpleString() for c in self.names]

    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.names)

    def empty(self) -> bool:
        return self.df.isEmpty()

    def rid(self) -> Frame:
        """With row numbers 0, 1, ... in column _rid."""
        if not self.order:
            raise FrameError("an operation by position needs an order")
        if self.order == [RID]:
            return self
        return Frame(numbered(self.df, self.order), RID)

    # Rows

    def row(self, i: int) -> Frame:
        """Row i; negative ones count from the end."""
        f = self.rid()
        if i < 0:
            return Frame(f.df.orderBy(F.desc(RID)).offset(-i - 1).limit(1), RID)
        return Frame(f.df.where(F.col(RID) == i), RID)

    def cell(self, i: int, name: str | int) -> DataFrame:
        """One cell, by row number and column name or place, as a table of one row and column."""
        return self.row(i).df.select(self.names[name] if isinstance(name, int) else name)

    def column(self, name: str) -> DataFrame:
        """One column in the frame's order."""
        return self.show_order().select(name)

    def copy(self) -> Frame:
        """The frame itself would do: tables do not change."""
        return Frame(self.df, self.order)

    def rows(self, start: int | None = None, stop: int | None = None, step: int = 1) -> Frame:
        """Slice by row number; a negative step reverses (then `start` and `stop` bound the same rows)."""
        f = self.rid()
        r = F.col(RID)
        if (start or 0) < 0 or (stop or 0) < 0:
            n = f.df.count()
            start, stop = (n + start if start is not None and start < 0 else start), (n + stop if stop is not None and stop < 0 else stop)
        cond = r >= (start or 0) if stop is None else (r >= (start or 0)) & (r < stop)
        out = f.df.where(cond & ((r - (start or 0)) % abs(step) == 0))
        if step < 0:
            out = out.withColumn(RID, -r)
        return Frame(out, RID)

    def take(self, places: Sequence[int]) -> Frame:
        """Rows by a list of numbers, order and repetition kept; the list is small by nature."""
        f = self.rid()
        spark = self.df.sparkSession
        wanted = spark.createDataFrame([(i, int(p)) for i, p in enumerate(places)], "_at bigint, _rid bigint")
        return Frame(f.df.join(F.broadcast(wanted), RID).withColumn(RID, F.col("_at")).drop("_at"), RID)

    def filter(self, cond: Column) -> Frame:
        return Frame(self.df.where(cond), self.order)

    def lookup(self, row: Sequence) -> DataFrame:
        """Number of the first row that matches (column first_row; null if none does)."""
        f = self.rid()
        own = f.df.select(*f.names)
        return f.df.where(row_matches(own, row)).agg(F.min(RID).alias("first_row"))

    def matches(self, row: Sequence) -> DataFrame:
        f = self.rid()
        return f.df.where(row_matches(f.df.select(*f.names), row)).select(RID)

    def holds(self, row: Sequence) -> bool:
        return not self.df.where(row_matches(self.df.select(*self.names), row)).isEmpty()

    def append(self, row: Sequence) -> Frame:
        """One more row at the end, cast to the columns' types."""
        f = self.rid()
        if len(row) != len(f.names):
            raise FrameError("a row needs a cell for each column")
        spark = self.df.sparkSession
        new = spark.range(1).select(*[F.lit(v).cast(f.df.schema[c].dataType).alias(c) for c, v in zip(f.names, row, strict=True)])
        last = f.df.agg((F.coalesce(F.max(RID), F.lit(-1)) + 1).alias(RID))
        return Frame(f.df.unionByName(new.crossJoin(last)), RID)

    def insert(self, i: int, row: Sequence) -> Frame:
        f = self.rid()
        spark = self.df.sparkSession
        new = spark.range(1).select(F.lit(i).cast("bigint").alias(RID), *[F.lit(v).cast(f.df.schema[c].dataType).alias(c) for c, v in zip(f.names, row, strict=True)])
        return Frame(f.df.withColumn(RID, F.when(F.col(RID) >= i, F.col(RID) + 1).otherwise(F.col(RID))).unionByName(new), RID)

    def drop_row(self, i: int) -> Frame:
        f = self.rid()
        r = F.col(RID)
        return Frame(f.df.where(r != i).withColumn(RID, F.when(r > i, r - 1).otherwise(r)), RID)

    # Columns

    def select(self, *names) -> Frame:
        """Columns by name, place, slice or mask, in the order given."""
        own = self.names
        got: list[str] = []
        for n in names:
            if isinstance(n, slice):
                got += own[n]
            elif isinstance(n, int) and not isinstance(n, bool):
                got.append(own[n])
            elif isinstance(n, (list, tuple)):
                if n and all(isinstance(x, bool) for x in n):
                    got += [c for c, keep in zip(own, n, strict=False) if keep]
                else:
                    got += [own[x] if isinstance(x, int) else x for x in n]
            else:
                got.append(n)
        keep = [c for c in self.order if c not in got]
        return Frame(self.df.select(*keep, *got), self.order)

    def with_column(self, name: str, value, index: int | None = None) -> Frame:
        """Add or replace a column; a value that is no Column is broadcast; `index` places a new one."""
        if index is not None and name in self.df.columns:
            raise FrameError(f"column exists already: {name}")
        out = self.df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
        if index is not None:
            rest = self.names
            out = out.select(*[c for c in self.df.columns if c not in rest], *rest[:index], name, *rest[index:])
        return Frame(out, self.order)

    def assign(self, cond: Column, name: str, value) -> Frame:
        """Set the cells of a column where the condition holds; the type stays."""
        v = value if isinstance(value, Column) else F.lit(value)
        return Frame(self.df.withColumn(name, F.when(cond, v.cast(self.df.schema[name].dataType)).otherwise(F.col(name))), self.order)

    def drop(self, *names: str) -> Frame:
        if missing := set(names) - set(self.df.columns):
            raise FrameError(f"no such columns: {sorted(missing)}")
        return Frame(self.df.drop(*names), [c for c in self.order if c not in names])

    def rename(self, names: dict[str, str]) -> Frame:
        return Frame(self.df.withColumnsRenamed(names), [names.get(c, c) for c in self.order])

    def reorder(self, *names: str) -> Frame:
        """The given names first, the others as they were."""
        if missing := set(names) - set(self.names):
            raise FrameError(f"no such columns: {sorted(missing)}")
        hidden = [c for c in self.df.columns if c not in self.names]
        return Frame(self.df.select(*hidden, *names, *[c for c in self.names if c not in names]), self.order)

    def retype(self, types: dict[str, str], strict: bool = True) -> Frame:
        """Cast columns; a failing cast raises (strict) or gives null."""
        cast = {c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in types.items()}
        return Frame(self.df.withColumns(cast), self.order)

    # Set-like operators

    def union(self, other: Frame) -> Frame:
        """Rows of both; columns that only one has are null for the other. Neither name set may miss some of both."""
        if not isinstance(other, Frame):
            raise FrameError("only a Frame can be added to a Frame")
        a, b = set(self.names), set(other.names)
        if not a or not b:
            return other if not a else self
        if not (a <= b or b <= a):
            raise FrameError(f"names overlap in part: {sorted(a ^ b)}")
        if not (self.order and other.order):
            return Frame(self.df.unionByName(other.df, allowMissingColumns=True))
        x, y = self.rid().df.withColumn("_side", F.lit(0)), other.rid().df.withColumn("_side", F.lit(1))
        both = x.unionByName(y, allowMissingColumns=True)
        return Frame(numbered(both.withColumnRenamed(RID, "_old"), ["_side", "_old"]).drop("_side", "_old"), RID)

    def add_columns(self, other: Frame) -> Frame:
        """Columns side by side, row by row; names have to differ and lengths to agree."""
        if set(self.names) & set(other.names):
            raise FrameError("names have to differ")
        a, b = self.rid().df, other.rid().df
        joined = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), RID, "full")
        check = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("tables have to be of one length"))).otherwise(F.col(RID))
        return Frame(joined.withColumn(RID, check.cast("bigint")).drop("_a", "_b"), RID)

    def __add__(self, other: Frame) -> Frame:
        if isinstance(other, Frame) and not set(self.names) & set(other.names) and self.names and other.names:
            return self.add_columns(other)
        return self.union(other)

    def unique(self) -> Frame:
        """Distinct rows (null equals null); with an order the first occurrence of each, in order."""
        if not self.order:
            return Frame(self.df.dropDuplicates())
        f = self.rid()
        return Frame(f.df.groupBy(*f.names).agg(F.min(RID).alias(RID)).select(RID, *f.names), RID)

    def sort(self, *keys: str | Column) -> Frame:
        """New order: the keys (all columns by default), nulls last, ties in the old order."""
        keys = list(keys) or [F.col(c).asc_nulls_last() for c in self.names]
        old = [c for c in self.order]
        return Frame(numbered(self.df.withColumnRenamed(RID, "_old") if RID in self.df.columns else self.df, [k if isinstance(k, Column) else F.col(k).asc_nulls_last() for k in keys] + [("_old" if c == RID else c) for c in old]).drop("_old"), RID)

    def head(self, n: int) -> DataFrame:
        return self.df.orderBy(*self.order).limit(n) if self.order else self.df.limit(n)

    def show_order(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df


def numbered(df: DataFrame, order: Iterable[str | Column], name: str = RID) -> DataFrame:
    """Rows numbered from 0 in an order, without a global sort in one task.

    Rows are range-partitioned by the order and numbered inside a partition; the totals of the
    partitions before (a row each) make the numbers global.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = in_ranges(df, parts, keys)
    inner = Window.partitionBy("_part").orderBy(*keys)
    local = ranged.withColumn("_in", F.row_number().over(inner))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return local.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_from") + F.col("_in") - 1).cast("bigint")).drop("_part", "_in", "_from")
