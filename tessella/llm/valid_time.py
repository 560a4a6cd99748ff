"""Valid-time enrichment: each sale takes the version of its client that was valid when it was sold.

A stateful stream over the union of sales and client changes. Clients are dealt to cells, and a cell is
a key of transformWithState: its list states hold the versions of its clients, sorted by client, time,
sequence and id, and the sales that wait. A key for each client would visit the state a client and
batch at a time, each visit with its own calls between the JVM and Python; a cell is visited once a
batch, and inside it clients are told apart by sorted arrays. Elements of the list states are blocks
of up to 16,384 rows, so that no element grows with a cell. A clock row for each cell and batch
carries both watermarks. With it a cell takes in new versions, bisects the sorted versions for every
sale below the lesser watermark, emits, and then prunes: of a client's versions up to that watermark
only the last can be asked for again.

No client is too large for a task: one with more than a task's share of all rows is cut into slices
of time, bounded by quantiles of its own times, and each slice lies in a cell by itself. Slices of a
client do not see each other in the stream. Each reports its versions to a summary of a row a slice
and batch, and a join with it gives sales what lies in earlier slices: the last version before the
slice, the count over all slices, and the last version up to the watermark, before which everything
is pruned. Slices, and with them summaries and bounds, are bounded by the number of cells (SLICES_A_CELL),
however many rows there are; they may be broadcast.

Times are wall-clock times without a zone. Order of versions: time, sequence, id; nulls first, rows
that tie in all three by op and balance. Defined cases: repeated changes count once (over the columns
used here); changes without a time are ignored; sales without a time are emitted at once and take no
version; rows without a client have none in common, so such sales hold nothing and such changes are
late or nothing; sales without an arrival belong to the first batch, and so do rows before it;
balances that are no number give null cents; repeated sales all stay; other columns are not read; empty
tables give an empty result. Numbers equal to -2**63 stand for null in the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .common import shared_dir, task_count

NONE, FOREVER = -(1 << 63), (1 << 63) - 1
CLOCK, CHANGE, SALE, SLICE = range(4)
#: A client that is whole has this slice; a row without a client has the other one.
WHOLE, NOBODY = -1, -2
HOUR = 3_600_000_000
BLOCK_ROWS = 16_384
#: Rows a cell at most on average.
CELL_ROWS = 200_000
#: A client is cut where it has more than this part of a cell's share of all rows.
SLICES_A_CELL = 4
FEED = "cell int, kind int, client long, slice int, id long, at long, seq long, op string, balance double, sales_mark long, changes_mark long"
OUT = "kind int, id long, batch int, client long, slice int, n long, v_at long, v_seq long, v_id long, op string, balance double, base_at long, base_seq long, base_id long"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    # logs of write buffers are else allocated in full at once, some 70 MB a task, however small the state is
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
    # a checksum file beside each file of a checkpoint doubles what a commit writes; file systems have their own
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    # each start of a query opens its own stores; those of ended ones are closed by maintenance
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    # no later batch uses a store of this start, so each is closed with its task and memory does not grow with partitions
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
VERSION = {"client": pa.int64(), "slice": pa.int32(), "at": pa.int64(), "seq": pa.int64(), "id": pa.int64(), "op": pa.string(), "balance": pa.float64(), "base": pa.bool_()}
WAITING = {"client": pa.int64(), "slice": pa.int32(), "at": pa.int64(), "id": pa.int64()}

Rows = dict[str, np.ndarray]


def _blocks(rows: Rows, kinds: dict) -> list[tuple]:
    """List elements of rows: Arrow streams of up to BLOCK_ROWS rows."""
    schema = pa.schema(list(kinds.items()))
    found = []
    for k in range(0, len(rows["client"]), BLOCK_ROWS):
        batch = pa.RecordBatch.from_arrays([pa.array(rows[c][k: k + BLOCK_ROWS], t) for c, t in kinds.items()], schema=schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_batch(batch)
        found.append((sink.getvalue().to_pybytes(),))
    return found


def _rows(elements: Iterator[tuple], kinds: dict) -> list[Rows]:
    found = []
    for (block,) in elements:
        table = pa.ipc.open_stream(bytes(block)).read_all()
        found.append({c: table.column(c).to_numpy() for c in kinds})
    return found


def _joined(parts: list[Rows], kinds: dict) -> Rows:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.array([], t.to_pandas_dtype()) for c, t in kinds.items()}


def _sorted(v: Rows) -> Rows:
    order = np.lexsort((v["id"], v["seq"], v["at"], v["slice"], v["client"]))
    tied = np.ones(max(0, len(order) - 1), bool)
    for c in ("id", "seq", "at", "slice", "client"):
        x = v[c][order]
        tied &= x[1:] == x[:-1]
    if tied.any():
        op = np.unique(np.array(["" if o is None else f"+{o}" for o in v["op"]]), return_inverse=True)[1]
        order = np.lexsort((np.where(np.isnan(v["balance"]), -np.inf, v["balance"]), op, v["id"], v["seq"], v["at"], v["slice"], v["client"]))
    return {c: x[order] for c, x in v.items()}


def _codes(v: Rows, s: Rows) -> tuple[np.ndarray, np.ndarray]:
    """A number for each client and slice; those of versions ascend, as they are sorted."""
    n = len(v["client"])
    first = np.ones(n, bool)
    first[1:] = (v["client"][1:] != v["client"][:-1]) | (v["slice"][1:] != v["slice"][:-1])
    clients, at = np.unique(np.concatenate([v["client"][first], s["client"]]), return_inverse=True)
    both = at.astype(np.int64) << 31 | (np.concatenate([v["slice"][first], s["slice"]]).astype(np.int64) - NOBODY)
    code = np.unique(both, return_inverse=True)[1]
    heads = int(first.sum())
    return code[:heads][np.cumsum(first) - 1] if n else code[:0], code[heads:]


class Enricher(StatefulProcessor):
    """State and steps of a cell; rows in, sales with their version, late changes and slices out."""

    def init(self, handle) -> None:
        self.versions = handle.getListState("versions", "block binary")
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        clock = new[new["kind"] == CLOCK].iloc[0]
        batch, changes_mark = int(clock["batch"]), int(clock["changes_mark"])
        bound = min(int(clock["sales_mark"]), changes_mark)

        change = new[new["kind"] == CHANGE]
        late = change["at"].to_numpy() < changes_mark
        fresh = change[~late & (change["slice"].to_numpy() != NOBODY)]
        taken = {c: fresh[c].to_numpy() for c in VERSION if c != "base"} | {"base": np.zeros(len(fresh), bool)}
        v = _sorted(_joined([*_rows(self.versions.get(), VERSION), taken], VERSION))

        sale = new[new["kind"] == SALE]
        s = _joined([*_rows(self.waiting.get(), WAITING), {c: sale[c].to_numpy() for c in WAITING}], WAITING)
        due = (s["at"] == NONE) | (s["at"] < bound)
        self.waiting.put(_blocks({c: x[~due] for c, x in s.items()}, WAITING)) if not due.all() else self.waiting.clear()
        s = {c: x[due] for c, x in s.items()}

        code, own = _codes(v, s)
        lost = {"kind": CHANGE, "id": change["id"].to_numpy()[late]}
        found = [self._columns(batch, **x) for x in (lost, self._emitted(v, s, code, own), self._slices(v, s, code, own)) if len(x["id"])]
        if found:  # one frame a visit: each costs its own conversion to Arrow
            yield pd.DataFrame({c: np.concatenate([x[c] for x in found]) for c in found[0]})

        past = v["at"] <= bound
        last = np.ones(len(past), bool)
        last[:-1] = (code[1:] != code[:-1]) | ~past[1:]
        stay = ~past | last
        v = {c: x[stay] for c, x in v.items()}
        v["base"] = past[stay]
        self.versions.put(_blocks(v, VERSION)) if stay.any() else self.versions.clear()

    @staticmethod
    def _columns(batch: int, **cols) -> Rows:
        """All columns of OUT, those not given with what stands for nothing."""
        n = len(cols["id"])
        full = {"batch": batch, "client": NONE, "slice": NOBODY, "n": 0, "op": None, "balance": np.nan} | cols
        found = {}
        for name, kind in (f.split() for f in OUT.split(", ")):
            x = full.get(name, NONE)
            found[name] = np.asarray(x if isinstance(x, np.ndarray) else [x] * n, {"int": np.int32, "long": np.int64, "double": np.float64, "string": object}[kind])
        return found

    def _emitted(self, v: Rows, s: Rows, code: np.ndarray, own: np.ndarray) -> dict:
        """The last version up to each sale's time, found by bisection among the versions of its client and slice."""
        times = np.unique(np.concatenate([v["at"], s["at"]]))
        place = lambda c, at: c.astype(np.int64) << 32 | np.searchsorted(times, at)
        at = np.searchsorted(place(code, v["at"]), place(own, s["at"]), side="right") - 1
        found = (at >= 0) & (s["at"] != NONE)
        found[found] = code[at[found]] == own[found]
        held = np.bincount(code, minlength=int(own.max(initial=-1)) + 1)[own]
        pick = {o: np.full(len(own), NONE, np.int64) for o in ("v_at", "v_seq", "v_id")} | {"op": np.full(len(own), None, object), "balance": np.full(len(own), np.nan)}
        for o, c in (("v_at", "at"), ("v_seq", "seq"), ("v_id", "id"), ("op", "op"), ("balance", "balance")):
            pick[o][found] = v[c][at[found]]
        return {"kind": SALE, "id": s["id"], "client": s["client"], "slice": s["slice"], "n": held.astype(np.int64)} | pick

    def _slices(self, v: Rows, s: Rows, code: np.ndarray, own: np.ndarray) -> dict:
        """A row for each slice with versions or sales: its count without the base, its last version, its base."""
        both, first = np.unique(np.concatenate([code, own]), return_index=True)
        client, part = (np.concatenate([v[c], s[c]])[first] for c in ("client", "slice"))
        size, hot = int(both.max(initial=-1)) + 1, part >= 0
        both, client, part = both[hot], client[hot], part[hot]
        end = np.searchsorted(code, both, side="right") - 1
        has = (end >= 0) & (np.searchsorted(code, both) <= end)
        where = np.flatnonzero(v["base"])
        base = np.searchsorted(code[where], both)
        based = base < len(where)
        based[based] = code[where][base[based]] == both[based]
        count = (np.bincount(code, minlength=size) - np.bincount(code[where], minlength=size))[both]
        cols = {o: np.full(len(both), NONE, np.int64) for o in ("v_at", "v_seq", "v_id", "base_at", "base_seq", "base_id")} | {"op": np.full(len(both), None, object), "balance": np.full(len(both), np.nan)}
        for o, c in (("v_at", "at"), ("v_seq", "seq"), ("v_id", "id"), ("op", "op"), ("balance", "balance")):
            cols[o][has] = v[c][end[has]]
        for c in ("at", "seq", "id"):
            cols[f"base_{c}"][based] = v[c][where[base[based]]]
        return {"kind": SLICE, "id": np.full(len(both), NONE, np.int64), "client": client, "slice": part, "n": count.astype(np.int64)} | cols


def enrich_stream(feed: DataFrame) -> DataFrame:
    """The stateful step over a stream of feed rows."""
    return feed.groupBy("cell").transformWithStateInPandas(Enricher(), outputStructType=OUT, outputMode="Append", timeMode="None")


def micros(at: str) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session's zone."""
    t = F.col(at).cast("timestamp_ntz")
    seconds = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return (F.unix_date(t.cast("date")).cast("bigint") * 24 + F.hour(t)) * HOUR + F.minute(t).cast("bigint") * (HOUR // 60) + seconds


def batch_of(day: Column, batches: int, first_day: int, days: int) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first_day) * batches / days))), F.lit(0)).cast("int")


def _or_none(col: str) -> Column:
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NONE))


def feed_rows(sales: DataFrame, changes: DataFrame, batches: int, first_day: int, days: int, delay_days: int) -> DataFrame:
    """Both tables in the columns of a feed, with their batch; slices and cells come later."""
    day = lambda c: F.unix_date(F.col(c).cast("timestamp_ntz").cast("date"))
    distinct = changes.where(F.col("valid_at").isNotNull()).select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").distinct()
    arrival = day("valid_at") + F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")) % delay_days, F.lit(0))
    one = distinct.select(batch_of(arrival, batches, first_day, days).alias("batch"), F.lit(CHANGE).alias("kind"), F.col("client_id").cast("bigint").alias("client"), _or_none("change_id").alias("id"),
                          micros("valid_at").alias("at"), _or_none("seq").alias("seq"), F.col("op").cast("string").alias("op"), F.col("balance").cast("double").alias("balance"))
    two = sales.select(batch_of(day("arrived_at"), batches, first_day, days).alias("batch"), F.lit(SALE).alias("kind"), F.col("client_id").cast("bigint").alias("client"), _or_none("sale_id").alias("id"),
                       F.coalesce(micros("sold_at"), F.lit(NONE)).alias("at"), F.lit(NONE).alias("seq"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("double").alias("balance"))
    return one.unionByName(two)


def _slice_bounds(sales: DataFrame, changes: DataFrame, parts: int) -> DataFrame:
    """(client, bounds): clients with more than a part of all rows, and times that cut their rows into parts."""
    keys = sales.select("client_id", F.col("sold_at").alias("t")).unionByName(changes.select("client_id", F.col("valid_at").alias("t")))
    counts = keys.groupBy("client_id").agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    hot = counts.where(F.col("client_id").isNotNull() & (F.col("n") > total / parts)).select(F.col("client_id").cast("bigint").alias("client"), F.ceil(total / F.col("n")).cast("int").alias("step"))
    timed = keys.where("client_id is not null and t is not null").select(F.col("client_id").cast("bigint").alias("client"), micros("t").alias("at"))
    cuts = timed.join(F.broadcast(hot), "client").groupBy("client", "step").agg(F.percentile_approx("at", [(k + 1) / parts for k in range(parts - 1)], 10_000).alias("b"))
    return cuts.select("client", F.array_distinct(F.filter("b", lambda x, i: (i + 1) % F.col("step") == 0)).alias("bounds"))


def cell_numbers(spark: SparkSession, each: int) -> DataFrame:
    """(place, cell): keys that the shuffle deals evenly, `each` to every task; places count from 0."""
    tasks = task_count(spark)
    task = F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks))
    keys = spark.range((tasks * each + 50) * 40).select(F.col("id").cast("int").alias("cell"), task.alias("task"))
    turn = F.row_number().over(Window.partitionBy("task").orderBy("cell"))
    found = sorted(r.cell for r in keys.withColumn("turn", turn).where(F.col("turn") <= each).collect())  # `each` rows a task
    return spark.createDataFrame(list(enumerate(found)), "place int, cell int")


def _in_cells(rows: DataFrame, bounds: DataFrame, cells: DataFrame) -> DataFrame:
    sliced = rows.join(F.broadcast(bounds), "client", "left")
    part = F.when(F.col("client").isNull(), F.lit(NOBODY)).when(F.col("bounds").isNull(), F.lit(WHOLE)).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col("at"))))
    key = F.when(F.col("client").isNull(), F.xxhash64("id", "kind", "at")).otherwise(F.xxhash64("client", "slice"))
    placed = sliced.withColumn("slice", part.cast("int")).withColumn("place", F.pmod(key, F.lit(cells.count())).cast("int")).join(F.broadcast(cells), "place")
    return placed.select("batch", "cell", "kind", F.coalesce("client", F.lit(NONE)).alias("client"), "slice", "id", "at", "seq", "op", "balance", F.lit(NONE).alias("sales_mark"), F.lit(NONE).alias("changes_mark"))


def clock_rows(cells: DataFrame, marks: list[tuple[int, int]]) -> DataFrame:
    """A row for each cell and batch with the watermarks of the batch."""
    times = cells.sparkSession.createDataFrame([(b, s, c) for b, (s, c) in enumerate(marks)], "batch int, sales_mark long, changes_mark long")
    row = cells.select("cell").join(F.broadcast(times), F.lit(True))
    none = F.lit(NONE)
    return row.select("batch", "cell", F.lit(CLOCK).alias("kind"), none.alias("client"), F.lit(NOBODY).alias("slice"), none.alias("id"), none.alias("at"), none.alias("seq"),
                      F.lit(None).cast("string").alias("op"), F.lit(None).cast("double").alias("balance"), "sales_mark", "changes_mark")


def watermarks(largest: dict[tuple[int, int], int], batches: int, delay: int) -> list[tuple[int, int]]:
    """(of sales, of changes) before each batch, and the two that let everything out behind the last one."""
    found = []
    for b in range(batches):
        one = [max([largest[k, kind] - delay for k in range(b) if (k, kind) in largest], default=NONE) for kind in (SALE, CHANGE)]
        found.append((one[0], one[1]))
    return [*found, (FOREVER, FOREVER)]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _run(spark: SparkSession, folder: str, batches: int) -> DataFrame:
    """Give the stream a batch at a time: the batch's folder moves below the watched one, a query starts on the checkpoint and ends."""
    schema = f"{FEED}, batch int"
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, x in SETTINGS.items():
            spark.conf.set(k, x)
        _, fs = _fs(spark, folder)
        fs.mkdirs(_fs(spark, f"{folder}/feed")[0])
        for b in range(batches + 1):
            fs.rename(_fs(spark, f"{folder}/cut/batch={b}")[0], _fs(spark, f"{folder}/feed/batch={b}")[0])
            stream = spark.readStream.schema(schema).parquet(f"{folder}/feed")
            query = (enrich_stream(stream).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
                     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
            query.awaitTermination()
        for done in ("cut", "feed", "checkpoint"):
            fs.delete(_fs(spark, f"{folder}/{done}")[0], True)
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    return spark.read.schema(OUT).parquet(f"{folder}/out")


def _settled(out: DataFrame) -> DataFrame:
    """Sales of sliced clients take what earlier slices hold; then all rows in the columns of the result."""
    version = lambda p: F.struct(*[F.col(f"{p}_{c}") for c in ("at", "seq", "id")])
    known = lambda p: F.col(f"{p}_at") != NONE
    slices = out.where(F.col("kind") == SLICE)
    batch = Window.partitionBy("client", "batch")
    earlier = F.last(F.when(known("v"), F.struct("v_at", "v_seq", "v_id", "op", "balance")), True).over(batch.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    base = F.max(F.when(known("base"), version("base"))).over(batch)
    held = F.sum("n").over(batch) + F.when(base.isNotNull(), 1).otherwise(0)
    summary = slices.select("client", "batch", "slice", earlier.alias("earlier"), base.alias("base"), held.alias("held"))
    rows = out.where(F.col("kind") != SLICE).join(F.broadcast(summary), ["client", "batch", "slice"], "left")
    own = F.when(known("v"), F.struct("v_at", "v_seq", "v_id", "op", "balance"))
    rows = rows.withColumn("t", F.coalesce(own, F.col("earlier")))
    pruned = F.col("base").isNotNull() & (F.struct(F.col("t.v_at").alias("base_at"), F.col("t.v_seq").alias("base_seq"), F.col("t.v_id").alias("base_id")) < F.col("base"))
    return rows.withColumn("t", F.when(~pruned, F.col("t")))


def enrich(sales: DataFrame, changes: DataFrame, batches: int = 10, first_day: int = 19723, days: int = 152, delay_days: int = 4,
           lateness_hours: int = 36, each: int | None = None) -> DataFrame:
    """(rec, id, batch, n_held, change_id, valid_at, op, balance): a row for each sale and each late change.

    The tables are cut into batches of `days` days from `first_day` (days since 1970) and fed in order
    to a stateful query that is started anew for each on one checkpoint, all below a new shared folder.
    `each` cells lie in a task; by default one, or more where a task's would hold too many rows.
    """
    spark = sales.sparkSession
    folder = shared_dir(spark, "valid-time")
    rows = feed_rows(sales, changes, batches, first_day, days, delay_days)
    if each is None:
        n = sales.select(F.lit(1)).unionAll(changes.select(F.lit(1))).count()
        each = max(1, -(-n // (CELL_ROWS * task_count(spark))))
    cells = cell_numbers(spark, each)
    placed = _in_cells(rows, _slice_bounds(sales, changes, int(cells.count() * SLICES_A_CELL)), cells)
    placed.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{folder}/cut")
    cut = spark.read.schema(f"{FEED}, batch int").parquet(f"{folder}/cut")
    largest = {(r.batch, r.kind): r.at for r in cut.where(F.col("at") != NONE).groupBy("batch", "kind").agg(F.max("at").alias("at")).collect()}
    clock_rows(cells, watermarks(largest, batches, lateness_hours * HOUR)).coalesce(1).write.mode("append").partitionBy("batch").parquet(f"{folder}/cut")
    settled = _settled(_run(spark, folder, batches))
    number = lambda c: F.nullif(F.col(c), F.lit(NONE))
    sale = lambda c: F.when(F.col("kind") == SALE, c)
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(t.v_at / 1000000BD AS DECIMAL(18, 6)))")
    return settled.select(F.when(F.col("kind") == SALE, "sale").otherwise("late").alias("rec"), number("id").alias("id"), F.col("batch").cast("bigint").alias("batch"),
                          sale(F.coalesce("held", "n")).alias("n_held"), number("t.v_id").alias("change_id"), at.alias("valid_at"), F.col("t.op").alias("op"), F.when(~F.isnan("t.balance"), F.col("t.balance")).alias("balance"))
