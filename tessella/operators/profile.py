"""Profiling: counts, missing cells, summary, histogram, boxes, percentile clouds, text layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value as text, n) of every value of each column, null among them; all columns in one pass."""
    columns = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))


def with_share(counted: DataFrame, name: str = "share", n: str = "n") -> DataFrame:
    """Add each count's share of their sum: the sum is an aggregate of one row that is sent to all tasks."""
    total = counted.agg(F.sum(n).alias("_total"))
    return counted.crossJoin(F.broadcast(total)).withColumn(name, F.col(n) / F.col("_total")).drop("_total")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column."""
    return with_share(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))


def missing(df: DataFrame) -> DataFrame:
    """(column, missing, present) of each column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count("*").alias("_n"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), (F.col("_n") - F.col(c)).alias("present")) for c in df.columns])
    return one.select(F.inline(cells))


def missing_footer(df: DataFrame) -> DataFrame:
    """One row: rows, columns, rows with a missing cell, columns with one, missing cells."""
    gaps = [F.col(c).isNull().cast("bigint") for c in df.columns]
    row = sum(gaps[1:], gaps[0])
    one = df.select(*[g.alias(c) for g, c in zip(gaps, df.columns, strict=True)], row.alias("_row"))
    return one.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.coalesce(F.sum((F.col("_row") > 0).cast("bigint")), F.lit(0)).alias("rows_with_missing"),
                   sum([F.coalesce(F.max(c), F.lit(0)) for c in df.columns[1:]], F.coalesce(F.max(df.columns[0]), F.lit(0))).cast("bigint").alias("columns_with_missing"), F.coalesce(F.sum("_row"), F.lit(0)).alias("missing_cells"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def histogram(df: DataFrame, column: str, bins: int = 100, padding: float = 0.0, probability: bool = False) -> DataFrame:
    """(bin, low, high, n[, share]) of equal bins from min - range * padding; the last bin is closed."""
    v = F.col(column).cast("double")
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).select((F.col("lo") - (F.col("hi") - F.col("lo")) * padding).alias("lo"), ((F.col("hi") - F.col("lo")) * (1 + padding)).alias("r"))
    placed = df.where(v.isNotNull()).select(v.alias("v")).crossJoin(F.broadcast(span))  # one row
    width = F.col("r") / bins
    b = F.when(F.col("r") == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    out = placed.groupBy(b.alias("bin"), "lo", "r").agg(F.count("*").alias("n"))
    out = out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")
    return with_share(out) if probability else out


def summary(df: DataFrame, max_display: int = 10) -> DataFrame:
    """(column, kind, item, n, share): for a category its most frequent values; for a number its values if few, else bins.

    Distinct counts of all columns come from one pass; then each column is one aggregate.
    """
    kinds = {c: "number" if isinstance(df.schema[c].dataType, T.NumericType) else "category" for c in df.columns}
    n = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns], F.count("*").alias("_n")).first()  # one row
    out = None
    for c, kind in kinds.items():
        if kind == "number" and n[c] > max_display:
            h = histogram(df, c, max_display - 1)
            part = h.select(F.lit(c).alias("column"), F.lit("bin").alias("kind"), F.col("bin").cast("string").alias("item"), "n")
        else:
            one = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
            order = [F.asc("v")] if kind == "number" else [F.desc("n"), F.asc("v")]
            part = one.orderBy(*order).limit(max_display).select(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col("v").cast("string").alias("item"), "n")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("share", F.col("n") / F.lit(max(1, n["_n"])))


def summary_head(df: DataFrame) -> DataFrame:
    """(column, kind, distinct, missing) of each column."""
    one = df.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in df.columns], *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("number" if isinstance(df.schema[c].dataType, T.NumericType) else "category").alias("kind"), F.col(f"d_{c}").alias("n_distinct"), F.col(f"m_{c}").alias("n_missing")) for c in df.columns])
    return one.select(F.inline(cells))


def boxes(df: DataFrame, by: str, column: str) -> DataFrame:
    """Least, quartiles, greatest, mean and standard deviation of a column for each group."""
    q = df.groupBy(by).agg(F.min(column).alias("least"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(column).alias("greatest"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("deviation"))
    return q.select(by, "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "greatest", "mean", "deviation")


def percentile_cloud(df: DataFrame, x: str, y: str, percents: Sequence[float] = (0, 20, 40, 60, 80, 100)) -> DataFrame:
    """(x, percent, value): percentiles of y for each x."""
    ps = F.array(*[F.lit(p / 100) for p in percents])
    got = df.groupBy(x).agg(F.percentile(y, ps).alias("v"))
    return got.select(x, F.inline(F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), F.col("v").alias("value"))))


def cell_text(c: Column, width: int = 30) -> Column:
    """A cell as it is printed: line breaks shown, cut to the width with two dots."""
    s = F.regexp_replace(c.cast("string"), "\n", "\\\\n")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 2), F.lit(".."))).otherwise(s)


def table_text(df: DataFrame, order: Sequence[str], max_display: int = 10) -> DataFrame:
    """The first and last rows of a table as printed: (place, row text)."""
    row = F.concat_ws(" | ", *[F.coalesce(cell_text(F.col(c)), F.lit("")) for c in df.columns])
    half = max_display // 2
    head = df.orderBy(*order).limit(half).select(row.alias("row")).withColumn("place", F.lit("head"))
    tail = df.orderBy(*[F.desc(o) for o in order]).limit(max_display - half).select(row.alias("row")).withColumn("place", F.lit("tail"))
    return head.unionByName(tail)


def aligned_numbers(c: Column, width: int = 12, digits: int = 3) -> Column:
    """Numbers padded so that decimal points stand in one column; very large or small ones in scientific form."""
    far = (F.abs(c) >= 10 ** (width - digits - 2)) | ((c != 0) & (F.abs(c) < 10.0 ** -digits))
    return F.lpad(F.when(far, F.format_string(f"%.{max(1, width - 9)}e", c.cast("double"))).otherwise(F.format_string(f"%.{digits}f", c.cast("double"))), width, " ")


def ranked_cells(df: DataFrame, column: str, rank: int, before: str, after: str, digits: int = 3) -> DataFrame:
    """The column formatted, its rank-th smallest distinct formatted value wrapped; negative ranks count from the top."""
    text = F.format_string(f"%.{digits}f", F.col(column).cast("double"))
    values = df.select(F.round(F.col(column), digits).alias("_v")).distinct()
    order = F.asc("_v") if rank >= 0 else F.desc("_v")
    wanted = values.orderBy(order).offset(rank if rank >= 0 else -rank - 1).limit(1)
    joined = df.crossJoin(F.broadcast(wanted))  # one row
    return joined.withColumn("text", F.when(F.round(F.col(column), digits) == F.col("_v"), F.concat(F.lit(before), text, F.lit(after))).otherwise(text)).drop("_v")


def colour_scale(df: DataFrame, column: str, low: Sequence[int] = (30, 60, 200), high: Sequence[int] = (200, 60, 30)) -> DataFrame:
    """A colour "rgb(r,g,b)" between two ends by the value's place between least and greatest; null stays null."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    t = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    part = [F.floor(F.lit(a) + t * (b - a) + 0.5).cast("string") for a, b in zip(low, high, strict=True)]
    return df.crossJoin(F.broadcast(span)).withColumn("colour", F.concat(F.lit("rgb("), part[0], F.lit(","), part[1], F.lit(","), part[2], F.lit(")"))).drop("_lo", "_hi")
