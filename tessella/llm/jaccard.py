"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Two documents link when
their sets' Jaccard similarity is `percent` / 100 or more.

Equal sets are one node, so copies never meet in a join. All sets follow one order: shingles that a
count sketch over all documents finds frequent come last, the others by hash. If two sets of n
shingles share o >= percent of either, they share at least l of the first n - ceil(percent n) + l.
Every document chooses l: a longer prefix costs more list entries but asks for more shared tokens
before a pair is verified; the least estimated cost (entries read plus entries / l verifications)
wins. A pair with c shared prefix tokens can only reach the threshold if c plus the longer of the
two rests does; pairs below that are dropped, unseen texts and all.

Candidates of a token's list are not all its pairs. First every member meets the list's leader, the
member whose prefix is shared most, which in a group of near copies is next to the original.
Verified links give components, and leaders of further components follow in the same way; at last
only members outside the first leader's component meet the members of other components. A list of near copies thus costs its length, and no pair of different
components that shares a prefix token goes unexamined, so components are exact.

Defined cases: null texts and texts without words have empty sets, size 0, and link with nothing;
fewer than five words count as one shingle; rows with equal ids count as one document whose links
are those of either text; a null id keeps a null component; of members that share equal parts of their
prefixes the one with the greatest id leads, which changes costs and no result; columns other than id
and text are not carried by near_duplicates(), so their names cannot clash, and keep_one() passes all
through; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bucketed, discard, release, task_count, written
from .components import components

WORDS = 5
PERCENT = 75
SKETCH = 1 << 18
BLOCK = 1 << 10
LONGEST = 4
VERIFY_COST = 8.0
STAR_ROUNDS = 2
LONG_LIST = 512
LIST_BLOCK = 256
DENSE = 8192
FEW_IDS = 2_000_000
SLICE_BYTES = 3_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
FINISH = 0xBF58476D1CE4E5B9


def _slices(texts: pa.Array):
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield texts.slice(at, upto - at)
        done, at = int(sizes[upto - 1]), upto


_hashes: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > 100_000:
        _hashes.clear()
    get, out = _hashes.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(FINISH)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (nulls as empty)."""
    out: list[np.ndarray] = []
    for part in _slices(texts.fill_null("")):
        split = pc.ascii_split_whitespace(pc.ascii_lower(part))
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        own = word_hashes(names)[code] if len(names) else np.zeros(0, np.uint64)
        real = np.array([bool(w) for w in names], bool)[code] if len(names) else np.zeros(0, bool)
        at = split.offsets.to_numpy()
        at = np.concatenate([[0], np.cumsum(real)])[at - at[0]]
        own = own[real]
        # all shingles of the slice at once; those that reach over the end of a text are not taken
        h = own[: max(0, len(own) - words + 1)] + np.uint64(words)
        for j in range(1, words):
            h = h * np.uint64(MULTIPLIER) + own[j: j + len(h)]
        h = mixed(h)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(h[a: b - words + 1]))
            elif b > a:
                one = own[a: a + 1] + np.uint64(b - a)
                for j in range(a + 1, b):
                    one = one * np.uint64(MULTIPLIER) + own[j: j + 1]
                out.append(mixed(one))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Sketch:
    """Two rows of counters: how many documents hold a shingle, never too low but for the noise taken off."""

    def __init__(self, counters: np.ndarray):
        self.counters = counters
        low = counters[0]
        self.mean = float(low.mean())
        self.noise = max(1.0, float(np.median(np.abs(low - np.median(low)))) * 1.4826)

    @staticmethod
    def places(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(SKETCH - 1)
        return ((s >> np.uint64(20)) & mask).astype(np.int64), ((s >> np.uint64(42)) & mask).astype(np.int64)

    def excess(self, s: np.ndarray) -> np.ndarray:
        a, b = self.places(s)
        return np.maximum(np.minimum(self.counters[0][a], self.counters[1][b]) - self.mean, 0)

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """(prefix of the set, l): frequent shingles last, length by least estimated cost."""
        e = self.excess(s)
        level = np.maximum(0, np.floor(np.log2(np.maximum(e, 1) / (4 * self.noise))) + 1).astype(np.int64)
        order = np.lexsort((s, level))
        n = len(s)
        base = n - (-(-percent * n // 100))
        top = min(LONGEST, n - base)
        ahead = order[: base + top]
        frequent = np.where(level[ahead] > 0, e[ahead], 0.0)
        entries = np.cumsum(frequent + 1)[base:]
        partners = np.cumsum(frequent)[base:]
        ell = int(np.argmin(entries + VERIFY_COST * partners / np.arange(1, top + 1))) + 1
        return s[order[: base + ell]], ell


def _survey(docs: DataFrame, words: int) -> tuple[DataFrame, Sketch]:
    """One pass: (id, n, k1, k2) of every document, written; and the sketch, whose size is fixed."""
    schema = "id long, n long, k1 long, k2 long, block int, part int, counts binary"
    kinds = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        counts, seen = np.zeros((2, SKETCH), np.int64), set()
        part = TaskContext.get().partitionId()
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                some, rows, new = b.slice(first, 1000), [], [np.zeros(0, np.uint64)]
                for d, s in zip(some.column("id").to_pylist(), shingle_sets(some.column("text"), words), strict=True):
                    k = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                    rows.append((d, len(s), (k & (1 << 64) - 1) - (1 << 63), (k >> 64) - (1 << 63), None, None, None))
                    if len(s) and k not in seen:
                        seen.add(k)
                        new.append(s)
                for row, at in zip(counts, Sketch.places(np.concatenate(new)), strict=True):
                    row += np.bincount(at, minlength=SKETCH)
                yield arrow_batch(rows, kinds)
        release()
        flat = counts.reshape(-1, BLOCK)
        yield arrow_batch([(None, None, None, None, i, part, flat[i].astype("<i8").tobytes()) for i in np.flatnonzero(flat.any(1)).tolist()], kinds)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(c, "<i8")
        return pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    both = written(docs.mapInArrow(run, schema), "survey")
    pieces = both.where("block is not null").select("block", (F.col("part") % 997).alias("part"), "counts")
    for _ in range(2):  # two levels: no task adds up more than the tasks' square root of arrays or so
        pieces = pieces.groupBy("block", "part").applyInArrow(add, "block int, part int, counts binary").withColumn("part", F.lit(0))
    counters = np.zeros((2, SKETCH), np.int64).reshape(-1, BLOCK)
    for r in pieces.select("block", "counts").collect():  # a fixed number of blocks, 4 MB in all
        counters[r.block] = np.frombuffer(bytes(r.counts), "<i8")
    return both.where("block is null").select("id", "n", "k1", "k2"), Sketch(counters.reshape(2, SKETCH))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. Texts of other documents are not read into sets."""
    sets_kind = arrow_schema(docs.sparkSession, "id long, s binary")

    def as_sets(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = shingle_sets(part.column("text"), words)
                yield arrow_batch([(d, s.tobytes()) for d, s in zip(part.column("id").to_pylist(), sets, strict=True)], sets_kind)
        release()

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                both = int((x[at] == y).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(m := pa.array(keep, pa.bool_())), b.column("b").filter(m)], names=["a", "b"])
        release()

    pairs = written(pairs.select("a", "b"), "pairs")
    held = involved = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "involved")
    if involved.count() <= FEW_IDS:  # 16 MB of ids at most; beyond that the join shuffles
        involved = F.broadcast(involved)
    sets = written(docs.join(involved, "id", "left_semi").mapInArrow(as_sets, "id long, s binary"), "sets")
    full = (pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))
    links = written(full.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")
    discard(pairs, sets, held)
    return links


def _conditions(percent: int) -> tuple[Column, Column, Column, Column]:
    """Of pairs of n and m shingles, p and q in the prefixes, k and l of them shared with any: sizes fit, shared shingles needed, the longer rest, may link at best."""
    size_ok = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    needed = F.ceil((F.col("n") + F.col("m")) * F.lit(percent) / F.lit(100 + percent))
    rests = F.greatest(F.col("n") - F.col("p"), F.col("m") - F.col("q"))
    return size_ok, needed, rests, F.least("k", "l") + rests >= needed


def _short_list_pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different components that share enough prefix tokens, one of the two outside the leader's in each list.

    Which one is outside differs between the lists of a pair, so the pair is ordered before its tokens are counted.
    """
    size_ok, needed, rests, may_at_best = _conditions(percent)
    out = short.where("out").select("token", F.col("node").alias("a"), "n", "p", "k", F.col("component").alias("ca"))
    rest = short.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("k").alias("l"), F.col("component").alias("cb"), F.col("out").alias("b_out"))
    return (out.join(rest, "token").where((F.col("ca") != F.col("cb")) & (~F.col("b_out") | (F.col("a") < F.col("b"))) & size_ok & may_at_best)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (needed - rests).alias("least"))  # the same from both sides
            .groupBy("a", "b").agg(F.count("*").alias("c"), F.first("least").alias("least")).where("c >= least").select("a", "b"))


def _long_list_pairs(marked: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a long list with different components, one outside the leader's, that share enough prefix tokens.

    Members are dealt to blocks; a block of outside members meets every block of members in one task
    with all their tokens, and only pairs that may reach the threshold leave it. A pair leaves the
    list of the least long-listed token that it shares.
    """
    spark = marked.sparkSession
    kinds = arrow_schema(spark, "a long, b long")
    nodes = marked.select("node").distinct()
    long_tokens = marked.select("token").distinct().withColumn("long", F.lit(True))
    own = lists.join(nodes, "node", "left_semi").join(long_tokens, "token", "left").groupBy("node").agg(F.collect_list("token").alias("t"), F.collect_list(F.when(F.col("long"), F.col("token"))).alias("u"))
    parts, outs = F.ceil(F.col("members") / LIST_BLOCK).cast("int"), F.ceil(F.col("outs") / LIST_BLOCK).cast("int")
    rows = marked.join(own, "node").withColumns({"parts": parts, "outs": outs})
    cell = [F.struct("node", "n", "p", "component", "out", "t", "u").alias("x")]
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("outs")).cast("int")
    left = rows.where("out").select("token", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), *cell)
    other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"), other.alias("j"), F.lit(1).alias("side"), *cell)
    groups = left.unionByName(right).groupBy("token", "i", "j").agg(F.collect_list(F.struct("side", "x")).alias("m"))  # two blocks at most

    def run(batches):
        for batch in batches:
            for token, m in zip(batch.column("token").to_pylist(), batch.column("m"), strict=True):
                rows = m.as_py()
                yield arrow_batch(_block_pairs([r["x"] for r in rows if not r["side"]], [r["x"] for r in rows if r["side"]], token, percent), kinds)

    return groups.select("token", "m").mapInArrow(run, "a long, b long")


def _block_pairs(left: list[dict], right: list[dict], token: int, percent: int) -> list[tuple[int, int]]:
    if not left or not right:
        return []
    code: dict[int, int] = {}
    for r in left:
        for t in r["t"]:
            code.setdefault(t, len(code))
    where = []
    for rows in (left, right):
        found = [[code[t] for t in r["t"] if t in code] for r in rows]
        where.append((np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.array([x for f in found for x in f], np.int64)))
    c = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(code), DENSE):  # a slice of the tokens at a time bounds the matrices
        x, y = (np.zeros((len(rows), DENSE), np.float32) for rows in (left, right))
        for z, (row, col) in zip((x, y), where, strict=True):
            inside = (col >= low) & (col < low + DENSE)
            z[row[inside], col[inside] - low] = 1
        c += x @ y.T
    field = lambda rows, k: np.array([r[k] for r in rows])
    n, m, rest_x, rest_y = field(left, "n")[:, None], field(right, "n")[None], (field(left, "n") - field(left, "p"))[:, None], (field(right, "n") - field(right, "p"))[None]
    a, b = field(left, "node")[:, None], field(right, "node")[None]
    good = (100 + percent) * (c + np.maximum(rest_x, rest_y)) >= percent * (n + m)
    good &= (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (field(left, "component")[:, None] != field(right, "component")[None]) & (~field(right, "out")[None] | (a < b))
    u, v = [set(r["u"]) for r in left], [set(r["u"]) for r in right]
    return [(left[i]["node"], right[j]["node"]) for i, j in zip(*(k.tolist() for k in np.nonzero(good)), strict=True) if min(u[i] & v[j]) == token]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row of `df`."""
    spark = df.sparkSession
    tasks = task_count(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    survey, sketch = _survey(docs, words)
    nodes = survey.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("n").alias("n"))
    nodes = written(nodes, "nodes")

    sent = spark.sparkContext.broadcast(sketch)
    kinds = arrow_schema(spark, "token long, k1 long, p int")

    def prefixes(batches):
        seen, own = set(), sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                tokens, keys, lens = [], [], []
                for s in shingle_sets(b.column("text").slice(at, 1000), words):
                    if not len(s) or (k := xxhash.xxh3_128_intdigest(s.tobytes())) in seen:
                        continue
                    seen.add(k)
                    pre, _ = own.prefix(s, percent)
                    tokens.append(signed(pre))
                    keys.append((k & (1 << 64) - 1) - (1 << 63))
                    lens.append(len(pre))
                if not tokens:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(keys, lens)), pa.array(np.repeat(lens, lens).astype(np.int32))], schema=kinds)
        release()

    rows = docs.where("id is not null").select("text").mapInArrow(prefixes, "token long, k1 long, p int")
    # bucketed by token: one pass over the texts and one shuffle serve the counting and the lists
    rows = bucketed(rows, "token", tasks, "prefixes")
    shared = rows.groupBy("token").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("token")
    lists = rows.join(shared.hint("shuffle_hash"), "token").dropDuplicates(["token", "k1"])
    named = written(lists.join(nodes.select("k1", "node", "n"), "k1").select("token", "node", "n", "p"), "lists")
    discard(rows)
    held = named.groupBy("node").agg(F.count("*").alias("k"))
    lists = written(named.join(held, "node"), "lists")  # k: how many of its prefix tokens a node shares with any other
    discard(named)

    size_ok, needed, rests, may_at_best = _conditions(percent)
    may = F.col("c") + rests >= needed

    def placed_by(comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return lists.withColumn("component", F.col("node"))
        return written(lists.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")

    # star rounds: the members of a list against a leader of another component, the most central one
    placed, links, first_heads, heads, comps = placed_by(None), [], None, None, None
    for _ in range(STAR_ROUNDS):
        left = placed
        if heads is not None:
            now = heads.join(placed.select("token", F.col("node").alias("b"), F.col("component").alias("hc")), ["token", "b"]).select("token", "hc")
            left = placed.join(now, "token").where("component <> hc")
        heads = written(left.groupBy("token").agg(F.max(F.struct((F.col("k") / F.col("p")).alias("share"), "node", "n", "p", "k", "component")).alias("h"))
                        .select("token", F.col("h.node").alias("b"), F.col("h.n").alias("m"), F.col("h.p").alias("q"), F.col("h.k").alias("l"), F.col("h.component").alias("hc")), "heads")
        first_heads = heads if first_heads is None else first_heads
        star = (placed.join(heads, "token").where((F.col("component") != F.col("hc")) & size_ok & may_at_best)
                .select(F.col("node").alias("a"), "n", "p", "b", "m", "q").distinct())
        # all tokens that a pair shares, those of lists with other leaders too
        star = (star.join(lists.select(F.col("node").alias("a"), "token"), "a")
                .join(lists.select(F.col("node").alias("b"), "token"), ["token", "b"])
                .groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("p").alias("p"), F.first("q").alias("q")))
        new = _verified(star.where(may), docs, words, percent)
        links.append(new)
        discard(comps, placed)
        comps = written(components(reduce(DataFrame.unionByName, links)), "components")
        placed = placed_by(comps)
        heads = heads.drop("hc")
        if new.isEmpty():
            break

    # last round: members outside their first leader's component against those of any other component
    inner = first_heads.select("token", "b").join(placed.select("token", F.col("node").alias("b"), F.col("component").alias("head")), ["token", "b"]).select("token", "head")
    marked = placed.join(inner, "token").withColumn("out", F.col("component") != F.col("head")).drop("head")
    sizes = marked.groupBy("token").agg(F.count("*").alias("members"), F.count_if("out").alias("outs")).where("outs > 0")
    marked = mixed_lists = written(marked.join(sizes, "token"), "mixed")
    short = marked.where(F.col("members") <= LONG_LIST)
    # a pair whose shared tokens all have short lists is counted there; one that meets in a long list is counted in blocks of it
    pairs = _short_list_pairs(short, percent).unionByName(_long_list_pairs(marked.where(F.col("members") > LONG_LIST), lists, percent)).distinct()
    more = _verified(pairs, docs, words, percent)
    found = written(components(reduce(DataFrame.unionByName, [*links, more])), "components")
    discard(*links, more, lists, placed, comps, mixed_lists)

    return (survey.join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").join(found, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each component, that of least id, with all columns of `df`; rows without an id stay."""
    found = near_duplicates(df, id_col, text_col, **kw)
    gone = written(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "gone")
    if gone.count() <= FEW_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, id_col, "left_anti").select(*df.columns)
