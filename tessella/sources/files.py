"""Reading and writing tables: delimited text with type and separator detection, Parquet, chunks, folder trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.maths import split_quoted, without_quoted

SEPARATORS = {"csv": ",", "txt": " ", "tsv": "\t"}
#: Candidate separators in order of preference.
PREFERRED = (",", " ", "\t", ";")
WHOLE = r"^[+-]?[0-9]+(_[0-9]+)*$"
REAL = r"^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?|nan|inf|infinity)$"


def extension(path: str) -> tuple[str, bool]:
    """(format, compressed) of a path; without an extension Parquet."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    packed = name.endswith(".gz")
    name = name[:-3] if packed else name
    return (name.rsplit(".", 1)[1] if "." in name else "parquet"), packed


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by extension: csv, txt, tsv (each .gz too), parquet, json, orc. Never samples on its own."""
    kind, _ = extension(path)
    if kind in SEPARATORS:
        return read_delimited(spark, path, options.pop("sep", SEPARATORS[kind]), **options)
    if kind in ("parquet", "json", "orc"):
        return spark.read.options(**options).format(kind).load(path)
    raise ValueError(f"unknown kind of file: {kind}")


def load_onto(df: DataFrame, path: str, **options) -> DataFrame:
    """The rows of a file after those of a table, by name, missing columns null."""
    return df.unionByName(load(df.sparkSession, path, **options), allowMissingColumns=True)


def value_type(value: Column) -> Column:
    """0 nothing, 1 whole number, 2 number, 3 text: the first that a trimmed text can be read as, as Python reads them."""
    v = F.trim(value)
    return F.when(v.isNull() | (v == ""), 0).when(v.rlike(WHOLE), 1).when(F.lower(v).rlike(REAL), 2).otherwise(3)


def column_types(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type) of text columns: the widest type of any value; a column of nothing but nulls is text."""
    columns = columns or raw.columns
    one = raw.agg(*[F.coalesce(F.max(value_type(F.col(c))), F.lit(0)).alias(c) for c in columns])
    name = lambda c: F.element_at(F.array(F.lit("string"), F.lit("bigint"), F.lit("double"), F.lit("string")), F.col(c) + 1)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), name(c).alias("type")) for c in columns])))


def typed(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns, empty cells null; Python's digit groups are read."""
    def cell(c, t):
        v = F.when(F.trim(F.col(c)) == "", None).otherwise(F.trim(F.col(c)))
        return v if t == "string" else F.regexp_replace(v, "_", "").try_cast(t)
    return raw.select(*[cell(c, types.get(c, "string")).alias(c) for c in raw.columns])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _place, _first): lines that are not blank, each with its file, its place there in the order of reading, and whether it is the file's first.

    A partition of a text scan reads its files' parts in order, so numbers that rise inside a partition are places; the first
    line of a file is in the partition that begins with its first byte.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_n")).where(F.trim("value") != "")
    firsts = lines.groupBy("_file").agg(F.min(F.struct("_block", "_n")).alias("_f"))  # a row a file
    place = F.struct("_block", "_n")
    return lines.join(firsts, "_file").select("value", "_file", place.alias("_place"), (place == F.col("_f")).alias("_first"))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, types: dict[str, str] | None = None,
                   sample: float | int | None = None, report: bool = False) -> DataFrame:
    """A delimited text file: cells trimmed, empty ones null, short lines filled with nulls, blank ones skipped.

    Lines with more cells than columns are dropped, and so are lines whose cells cannot be read as
    the given types; with `report` they are returned instead, as column `line`. Without `types` they
    are found in one pass: whole number, number, text, the widest that a column needs. A `sample` of
    less than 1 is a share of the lines, 1 or more a count; the first data line is always kept. The
    header is the first line that is not blank of the file that comes first by name, and in every other
    file a first line equal to it; a data line with the same text stays.
    """
    lines = numbered_lines(spark, path)
    if sep is None:
        sep = detect_separator(lines)
    first = lines.where("_first").agg(F.min(F.struct("_file", "value")).alias("f")).first().f
    if first is None:
        raise ValueError(f"no lines: {path}")
    head = [c.strip().strip('"') for c in re.split(re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', first.value)]
    names = head if header else [f"column {i + 1}" for i in range(len(head))]
    data = lines.where(~(F.col("_first") & (F.col("value") == F.lit(first.value)))) if header else lines
    if sample is not None:
        # the first data line, by file and place
        place = data.agg(F.min(F.struct("_file", "_place"))).first()[0]
        one = F.lit(False) if place is None else (F.col("_file") == place["_file"]) & (F.col("_place") == place["_place"])
        keep = F.xxhash64("value")
        if sample < 1:
            data = data.where((F.pmod(keep, F.lit(1 << 32)) < int(sample * 2**32)) | one)
        else:
            data = data.orderBy(F.desc(one), keep, "value").limit(int(sample))
    cells = data.select("value", split_quoted(F.col("value"), sep).alias("c"))
    long = cells.where(F.size("c") > len(names))
    fine = cells.where(F.size("c") <= len(names))
    raw = fine.select("value", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if types is None:
        found = {r.column: r.type for r in column_types(raw, names).collect()}  # one row a column
        return long.select(F.col("value").alias("line")) if report else typed(raw.select(*names), found)
    bad = F.lit(False)
    for n in names:
        if types.get(n, "string") != "string":
            v = F.trim(F.col(n))
            bad = bad | F.coalesce((v != "") & F.regexp_replace(v, "_", "").try_cast(types[n]).isNull(), F.lit(False))
    return long.select(F.col("value").alias("line")).union(raw.where(bad).select("value")) if report else typed(raw.where(~bad).select(*names), types)


def separator_stats(lines: DataFrame, column: str = "value") -> DataFrame:
    """(character, least, most, lines): how often each character stands on the lines that have it, quoted text left out.

    `lines` counts the lines with it; a separator has least = most on every line that is not blank.
    """
    keyed = lines.select(without_quoted(F.col(column)).alias("v")).where(F.trim("v") != "").withColumn("id", F.monotonically_increasing_id())
    marks = keyed.select("id", F.explode(F.filter(F.split("v", ""), lambda c: ~c.rlike("[A-Za-z0-9_.+-]") & (c != ""))).alias("character"))
    per = marks.groupBy("id", "character").agg(F.count("*").alias("n"))
    return per.groupBy("character").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("lines"))


def detect_separator(lines: DataFrame, column: str = "value") -> str:
    """The character used equally often on every line: the preferred ones first, else the most used."""
    total = lines.where(F.trim(column) != "").count()
    good = separator_stats(lines, column).where((F.col("least") == F.col("most")) & (F.col("lines") == total)).collect()  # one row a character
    found = {r.character: r.most for r in good}
    for c in PREFERRED:
        if c in found:
            return c
    if not found:
        raise ValueError("no character stands equally often on every line")
    return max(sorted(found), key=lambda c: found[c])


def save(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write by extension: csv, txt, tsv (each .gz too) with a header and quoting, parquet, json, orc; returns the table."""
    kind, packed = extension(path)
    w = df.write.mode(mode)
    if kind in SEPARATORS:
        w.options(header=True, sep=SEPARATORS[kind], quote='"', escape='"', nullValue="", emptyValue='""').option("compression", "gzip" if packed else "none").csv(path)
    elif kind in ("parquet", "json", "orc"):
        w.format(kind).save(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")
    return df


def disassemble(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    """(path, part, content): a file's bytes in numbered chunks."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    parts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / chunk_bytes) - 1, F.lit(0).cast("bigint")))
    at = raw.select("path", "content", F.explode(parts).alias("part"))
    return at.select("path", "part", F.substring(F.col("content"), (F.col("part") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)).alias("content"))


def assemble(chunks: DataFrame) -> DataFrame:
    """(path, content): chunks joined in the order of their numbers."""
    got = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", F.hex("content").alias("h")))).alias("c"))
    return got.select("path", F.unhex(F.array_join(F.transform("c", lambda x: x["h"]), "")).alias("content"))


def corpus_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a tree <dims>-<names>/<train>--<test>/Train-<i>.csv or Test-<i>.csv with what the path says of them."""
    raw = spark.read.option("recursiveFileLookup", "true").option("header", "true").option("inferSchema", "true").csv(folder)
    name = F.input_file_name()
    part = lambda pattern, kind: F.regexp_extract(name, pattern, 1).cast(kind)
    return raw.select("*", part(r"/([0-9]+)-[^/]*/[^/]*/[^/]*$", "int").alias("_dims"), part(r"/[0-9]+-([^/]*)/[^/]*/[^/]*$", "string").alias("_names"), part(r"/([0-9]+)--[0-9]+/[^/]*$", "int").alias("_train"),
                      part(r"/[0-9]+--([0-9]+)/[^/]*$", "int").alias("_test"), F.lower(part(r"/(Train|Test)-[0-9]+\.csv", "string")).alias("_part"), part(r"/(?:Train|Test)-([0-9]+)\.csv", "int").alias("_number"))
