"""Benchmark decontamination: pigeonhole edit matching.

A benchmark item of m words may differ from a passage by k = floor(edit_rate * m) word edits. Cut
into k + 1 pieces, at least one piece of it lies unchanged in any passage within the budget. All
pieces' hashes are looked up in every document with vectorised rolling hashes; around each exact
piece hit, Myers' bit-parallel algorithm finds the least edit distance of the whole item. A document
is hit by an item where that distance is k at most.

Words are maximal runs of letters and digits of the lower-cased text, so case, punctuation and white
space never count. The items are a stated query set: they are read in blocks of at most
`block_bytes` of text and broadcast, up to `pass_blocks` blocks at a time, so a pass over the
documents serves 64 MB of items and only larger sets take further passes. A worker builds the index
of a block once, however many tasks it runs.

Defined cases: null and empty items match nothing; items so short that k is 0 match exactly; null,
empty and very long documents are read whole, in linear time; repeated items and repeated documents
are reported each; of equally distant places of an item the first counts; the result has its own
columns alone, so names of other columns cannot clash; an empty table gives no hits.
"""

from __future__ import annotations

import re
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema

WORD = re.compile(r"[^\W_]+")
EDIT_RATE = 0.15
BLOCK_BYTES = 8 << 20
PASS_BLOCKS = 8
PRIME = 0x9E3779B97F4A7C15
STEP_WORDS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 pieces of m words, lengths at most one apart."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[int, int], m: int, text, limit: int) -> tuple[int, int]:
    """Least edit distance of the pattern against any part of `text`, and the end of the first such part.

    `masks` has, for each symbol, the bits of its places in the pattern. Gives (limit + 1, -1) if
    every part is further away than `limit`.
    """
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, dist = full, 0, m
    best, end = limit + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if dist < best:
            best, end = dist, j + 1
            if not dist:
                break
    return best, end


class Matcher:
    """Piece index over a block of items."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float):
        self.code: dict[str, int] = {}
        self.items, found = [], {}
        for item_id, text in items:
            ws = words_of(text)
            if not ws:
                continue
            k = int(edit_rate * len(ws))
            codes = [self.code.setdefault(w, len(self.code) + 1) for w in ws]
            masks: dict[int, int] = {}
            for i, c in enumerate(codes):
                masks[c] = masks.get(c, 0) | 1 << i
            at = len(self.items)
            self.items.append((item_id, codes, k, masks))
            for start, n in pieces(len(ws), k):
                found.setdefault(n, []).append((self.hash_of(codes[start: start + n]), at, start))
        self.by_length = {}
        for n, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            self.by_length[n] = (keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    @staticmethod
    def hash_of(codes: list[int]) -> int:
        h = 0
        for c in codes:
            h = (h * PRIME + c) & 0xFFFFFFFFFFFFFFFF
        return h

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, first word, end word) of each item found, once for an item: its best place."""
        ws = words_of(text)
        if not ws or not self.items:
            return []
        get = self.code.get
        codes = np.fromiter((get(w, 0) for w in ws), np.uint64, len(ws))
        near: dict[int, set[int]] = {}
        for n, (keys, item, start) in self.by_length.items():
            if len(codes) < n:
                continue
            h = np.zeros(len(codes) - n + 1, np.uint64)
            known = np.ones(len(h), bool)
            for i in range(n):
                part = codes[i: len(codes) - n + 1 + i]
                h = h * np.uint64(PRIME) + part
                known &= part > 0
            at = np.flatnonzero(known)
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                for r in range(a, b):
                    near.setdefault(int(item[r]), set()).add(p - int(start[r]))
        out = []
        codes_list = codes.tolist() if near else []
        for at in sorted(near):
            item_id, own, k, masks = self.items[at]
            m, best, upto = len(own), (k + 1, 0, 0), -1
            for p in sorted(near[at]):
                lo, hi = max(0, p - k), min(len(codes_list), p + m + k)
                if hi <= upto:
                    continue
                upto = hi
                if codes_list[p: p + m] == own and p >= 0:
                    best = min(best, (0, p, p + m))
                    break
                d, end = myers(masks, m, codes_list[lo:hi], k)
                if d < best[0]:
                    best = (d, max(lo, lo + end - m), lo + end)
            if best[0] <= k:
                out.append((item_id, *best))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Blocks of (id, text) with at most `block_bytes` of text each, or one longer item."""
    own = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    block: list[tuple[int, str]] = []
    size = 0
    for r in own.toLocalIterator():
        if block and size + len(r.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.id, r.text))
        size += len(r.text)
    if block:
        yield block


_matchers: dict[str, list[Matcher]] = {}


def matchers_of(key: str, blocks: list, edit_rate: float) -> list[Matcher]:
    """The indexes of the blocks of a pass, kept by the worker until the next pass."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = [Matcher(b, edit_rate) for b in blocks]
    return _matchers[key]


def _passes(docs: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str, block_bytes: int, pass_blocks: int):
    """(key, broadcast blocks) for each pass over the documents."""
    blocks = item_blocks(items, item_id_col, item_text_col, block_bytes)
    while some := list(islice(blocks, pass_blocks)):
        yield uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(some)


def find_leaks(docs: DataFrame, items: DataFrame, edit_rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """A row (doc_id, item_id, distance, first_word, end_word) for each document and item that leaks into it."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id_col].dataType.simpleString()}, distance int, first_word long, end_word long"
    kinds = arrow_schema(spark, schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for key, sent in _passes(docs, items, item_id_col, item_text_col, block_bytes, pass_blocks):
        def run(batches, key=key, sent=sent):
            matchers = matchers_of(key, sent.value, edit_rate)
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in matchers for hit in m.hits(t)]
                yield arrow_batch(rows, kinds)

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def remove_leaking(docs: DataFrame, items: DataFrame, edit_rate: float = EDIT_RATE, text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """The documents that no item leaks into, with all their columns; each is judged where it lies, nothing is joined."""
    for key, sent in _passes(docs, items, item_id_col, item_text_col, block_bytes, pass_blocks):
        def run(batches, key=key, sent=sent):
            matchers = matchers_of(key, sent.value, edit_rate)
            for b in batches:
                yield b.filter(pa.array([not any(m.hits(t) for m in matchers) for t in b.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
