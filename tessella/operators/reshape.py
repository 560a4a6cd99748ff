"""Stack, unstack, pack, unpack, flatten, transpose."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cell(name: str):
    return lambda x: x["v"][name]


def stack(df: DataFrame, columns: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Group by all other columns (null equals null) and make lists of `columns`, nulls kept, in `order`.

    Columns of `order` that are not stacked themselves are ordering keys only and leave the result.
    """
    keys = [o for o in order if isinstance(o, str)]
    rest = [c for c in df.columns if c not in columns and c not in keys]
    cells = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"k{i}") for i, o in enumerate(order)], F.struct(*columns).alias("v"))
    got = df.groupBy(*rest).agg(F.array_sort(F.collect_list(cells)).alias("_m"))
    return got.select(*rest, *[F.transform("_m", _cell(c)).alias(c) for c in columns])


def unstack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of stack: lists of a row side by side; unequal lengths raise; null or empty lists give one row with nulls."""
    rest = [c for c in df.columns if c not in columns]
    size = F.coalesce(F.size(F.col(columns[0])), F.lit(0))
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.coalesce(F.size(F.col(c)), F.lit(0)) == size)
    lists = F.when(same, F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c) for c in columns])).otherwise(F.raise_error(F.lit("lists of a row have to be of one length")).cast(T.ArrayType(T.StructType([T.StructField(c, df.schema[c].dataType.elementType) for c in columns]))))
    return df.select(*rest, F.explode_outer(lists).alias("_x")).select(*rest, *[F.col("_x").getField(c).alias(c) for c in columns])


def unpack(df: DataFrame, column: str) -> DataFrame:
    """A list column as columns "name 1" .. "name k", k the longest; texts give their characters, scalars themselves."""
    kind = df.schema[column].dataType
    lists = F.col(column) if isinstance(kind, T.ArrayType) else F.filter(F.split(F.col(column), ""), lambda x: x != "") if isinstance(kind, T.StringType) else F.array(F.col(column))
    longest = df.agg(F.max(F.size(lists))).first()[0] or 0  # one number
    return df.select(*[c for c in df.columns if c != column], *[F.get(lists, F.lit(i)).alias(f"{column} {i + 1}") for i in range(max(0, longest))])


def pack(df: DataFrame, name: str) -> DataFrame:
    """Columns "name 1", "name 2" ... as one list, trailing nulls cut; nulls only give null."""
    found = sorted((c for c in df.columns if re.fullmatch(re.escape(name) + r" \d+", c)), key=lambda c: int(c.rsplit(" ", 1)[1]))
    if not found:
        raise ValueError(f"no columns to pack: {name}")
    cells = F.array(*[F.col(c) for c in found])
    last = F.greatest(*[F.when(F.col(c).isNotNull(), i + 1).otherwise(0) for i, c in enumerate(found)]) if len(found) > 1 else F.when(F.col(found[0]).isNotNull(), 1).otherwise(0)
    return df.select(*[c for c in df.columns if c not in found], F.when(last > 0, F.slice(cells, F.lit(1), last)).alias(name))


def flatten(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """The leaves of a nested list column, a row each with their place; texts count as their characters."""
    kind, c = df.schema[column].dataType, F.col(column)
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        c = F.flatten(F.transform(c, lambda x: F.filter(F.split(x, ""), lambda y: y != "")))
    return df.select(*[x for x in df.columns if x != column], F.posexplode(c).alias("place", name))


def transpose(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """Columns become rows (column `name`), the given values of `key` become columns; for small tables."""
    rest = [c for c in df.columns if c != key]
    long = df.unpivot([key], rest, "name", "value")
    return long.groupBy("name").pivot(key, list(keys)).agg(F.first("value", ignorenulls=True))
