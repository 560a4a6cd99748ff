"""BPE encoding and decoding: speculate, verify, and merge exactly only where verification fails.

Greedy longest match proposes the tokens of each new word. A sequence of tokens is the one that BPE
would give if and only if each adjacent pair is compatible, that is, if BPE leaves the two tokens
apart when it encodes their joined text. Compatibility of all adjacent pairs of all new words of a
batch is tested at once with numpy. Words with an incompatible pair are merged exactly, by rank.

Words repeat, so each worker keeps a bounded table from white-space-separated chunks to ids. The
vocabulary (about 2 MB, fixed) is read by the driver from a path and broadcast.

Defined cases: a null text is encoded as the empty text (no ids) and decodes to ""; very long words
take O(n log n); all other columns pass through, but one with the name of a result column is
replaced by it; ties and repeated rows are coded each; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import release

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SUFFIX = "</w>"
SPACE = re.compile(r"[\t-\r ]+")
CACHE_LIMIT = 200_000
WORD_LIMIT = 100_000
GROUP_BYTES = 8_000_000
SHORT = 40


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBpe:
    """Tables of a word-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*self.vocab.values(), *added.values()]) + 1
        self.token = [""] * size
        for t, i in chain(self.vocab.items(), added.items()):
            self.token[i] = t
        self.added = added
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        if not (np.diff(made) > 0).all():
            raise ValueError("ids of merged tokens must follow the order of the merges")
        key = left * size + right
        self.rank = dict(zip(key.tolist(), made.tolist(), strict=True))
        order = np.argsort(key)
        self.key, self.made, self.size = key[order], made[order], size
        self.split_left, self.split_right = np.arange(size), np.arange(size)
        self.split_left[made], self.split_right[made] = left, right
        self.alphabet = byte_alphabet()
        self.longest = max(map(len, self.vocab))
        #: Tokens that BPE gives for their own text; only these may be proposed.
        self.usable = {t: i for t, i in self.vocab.items() if self.merge_exactly(self.symbols(t)) == [i]}
        #: Length of the longest usable token inside a word by its first three characters; two characters at most for others.
        self.reach: dict[str, int] = {}
        for t in self.usable:
            if not t.endswith(SUFFIX) and len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.decimal = [str(i) for i in range(size)]
        #: chunk -> place; the ids of the chunk at place k are flat[ends[k]:ends[k + 1]]
        self.cache: dict[str, int] = {}
        self.flat, self.ends, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0
        self.words: dict[str, tuple[int, ...]] = {}
        self.limits: tuple[int, int] | None = None

    def symbols(self, mapped: str) -> list[int]:
        if mapped.endswith(SUFFIX) and len(mapped) > len(SUFFIX):
            body = mapped[: -len(SUFFIX)]
            return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + SUFFIX]]
        return [self.vocab[c] for c in mapped]

    def merge_exactly(self, ids: list[int]) -> list[int]:
        """BPE by rank: lowest rank first, leftmost among equals. Ids follow the ranks, so they stand for them."""
        n, get, size = len(ids), self.rank.get, self.size
        if n > SHORT:
            return self.merge_long(ids)
        ids = list(ids)
        made = [get(a * size + b, size) for a, b in zip(ids, ids[1:], strict=False)]
        while made and (best := min(made)) < size:
            i = made.index(best)
            ids[i] = best
            del ids[i + 1], made[i]
            if i:
                made[i - 1] = get(ids[i - 1] * size + best, size)
            if i < len(made):
                made[i] = get(best * size + ids[i + 1], size)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, in n log n."""
        n, get, size = len(ids), self.rank.get, self.size
        ids = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(made * size + ids[k])) is not None:
                    heapq.heappush(heap, (r, i, made, ids[k]))
            h = before[i]
            if h >= 0 and (r := get(ids[h] * size + made)) is not None:
                heapq.heappush(heap, (r, h, ids[h], made))
        return [x for x in ids if x >= 0]

    def propose(self, mapped: str) -> list[int]:
        """Greedy longest match; `mapped` ends with the suffix."""
        usable, reach, end, out, i = self.usable.get, self.reach.get, len(mapped) - len(SUFFIX), [], 0
        while i < end:
            if len(mapped) - i <= self.longest and (t := usable(mapped[i:])) is not None:
                out.append(t)
                break
            # the last character belongs to the suffix
            j = min(end - 1, i + reach(mapped[i:i + 3], 2))
            while j > i and (t := usable(mapped[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether BPE leaves tokens a and b apart in their joined text.

        Walks down the inner edges of both merge trees from the latest merge to the earliest; a pair
        that could have been merged earlier than the merges that hide it is incompatible.
        """
        n = len(a)
        ok, live = np.ones(n, bool), np.arange(n)
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(n, np.iinfo(np.int64).max)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            bad = (self.key[at] == key) & (self.made[at] < limit)
            ok[live[bad]] = False
            keep = ~bad
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
            if not len(live):
                break
            done = np.zeros(len(live), bool)
            go_a = a > b
            # the later token is opened; where it is a leaf, the other one
            ra, lb = self.split_right[a], self.split_left[b]
            leaf_a, leaf_b = ra == a, lb == b
            open_a = (go_a & ~leaf_a) | (~go_a & leaf_b & ~leaf_a)
            open_b = (~go_a & ~leaf_b) | (go_a & leaf_a & ~leaf_b)
            done = ~(open_a | open_b)
            limit = np.where(open_a, a, np.where(open_b, b + 1, limit))
            a, b = np.where(open_a, ra, a), np.where(open_b, lb, b)
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return ok

    def pieces(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
            if "İ" in chunk:  # its lower case is a letter and a mark
                return PIECES.findall(chunk.lower())
        if chunk.isalpha():
            return [chunk.lower()]
        if (body := chunk[:-1]).isalpha() and chunk[-1].isascii():
            return [body.lower(), chunk[-1]]
        return PIECES.findall(chunk.lower())

    def mapped(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word + SUFFIX
        alphabet = self.alphabet
        return "".join([alphabet[x] for x in word.encode("utf-8", "replace")]) + SUFFIX

    def learn(self, chunks) -> None:
        """Add new chunks to the table: propose for all, test all pairs at once, merge the failing words."""
        collecting = gc.isenabled()
        gc.disable()  # the many small tuples made here hold no cycles
        try:
            self.learn_all(chunks)
        finally:
            if collecting:
                gc.enable()

    def learn_all(self, chunks) -> None:
        words, pieces = self.words, self.pieces
        parts = [(c, pieces(c)) for c in chunks]
        texts = list({w for _, ws in parts for w in ws}.difference(words))
        usable, propose = self.usable, self.propose
        mapped = list(map(self.mapped, texts))
        guesses = [[hit] if (hit := usable.get(m)) is not None else propose(m) for m in mapped]
        lens = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(lens.sum()))
        if len(flat) > 1:
            word_of = np.repeat(np.arange(len(lens)), lens)
            inner = np.flatnonzero(word_of[1:] == word_of[:-1])
            key, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            wrong = inner[~self.compatible(key // self.size, key % self.size)[which]]
            for k in set(word_of[wrong].tolist()):
                guesses[k] = self.merge_exactly(self.symbols(mapped[k]))
        words.update(zip(texts, map(tuple, guesses), strict=True))
        own = [words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([words[w] for w in ws])) for _, ws in parts]
        lens = list(map(len, own))
        flat = np.fromiter(chain.from_iterable(own), np.int32, sum(lens))
        ends = self.used + np.cumsum(lens, dtype=np.int64)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used: self.used + len(flat)] = flat
        at = len(self.cache)
        while at + len(parts) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[at + 1: at + 1 + len(parts)] = ends
        self.cache.update(zip([c for c, _ in parts], range(at, at + len(parts)), strict=True))
        self.used += len(flat)

    def forget(self) -> None:
        """Empty the tables once they are full; they hold what is dear, not what is needed."""
        chunks, words = self.limits or (CACHE_LIMIT, WORD_LIMIT)
        if len(self.cache) > chunks:
            self.cache.clear()
            self.used = 0
        if len(self.words) > words:
            self.words.clear()

    def places(self, chunks: list[str]) -> np.ndarray:
        """The places of chunks in the tables, new ones learned."""
        get = self.cache.get
        at = list(map(get, chunks))
        if None in at:
            self.learn(dict.fromkeys([c for c, k in zip(chunks, at, strict=True) if k is None]))
            at = list(map(get, chunks))
        return np.array(at, np.int64)

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the chunks at these places, the number of ids of each chunk)."""
        starts = self.ends[at]
        lens = self.ends[at + 1] - starts
        stops = np.cumsum(lens)
        total = int(stops[-1]) if len(stops) else 0
        return self.flat[np.repeat(starts - (stops - lens), lens) + np.arange(total)], lens

    def encode_text(self, text: str) -> np.ndarray:
        """One text, with the strings of added tokens as their ids."""
        parts = self.added_split.split(text) if self.added_split else [text]
        out = []
        for k, part in enumerate(parts):
            out.append(np.array([self.added[part]], np.int32) if k % 2 else self.expand(self.places(SPACE.split(part)))[0])
        return np.concatenate(out)

    def encode_arrow(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow string array without nulls.

        Arrow splits the texts and finds the distinct chunks of a slice; only these meet Python.
        """
        out: list[np.ndarray] = []
        at, sizes = 0, pc.binary_length(texts).to_numpy(zero_copy_only=False)
        while at < len(texts):
            self.forget()
            upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), GROUP_BYTES, "right")))
            part = texts.slice(at, upto - at)
            at = upto
            if any(pc.any(pc.match_substring(part, t)).as_py() for t in self.added):
                out += [self.encode_text(t) for t in part.to_pylist()]
                continue
            split = pc.ascii_split_whitespace(part)
            coded = split.flatten().dictionary_encode()
            which = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            ids, lens = self.expand(which)
            stops = np.concatenate([[0], np.cumsum(lens)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
            out += np.split(ids, stops[1:-1])
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.encode_arrow(pa.array(texts, pa.string()))]

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens' strings, joined by one space."""
        return " ".join(map(self.token.__getitem__, ids))

    def decimals(self, ids) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


_loaded: dict[int, WordBpe] = {}


def loaded(spec: str, limits: tuple[int, int] | None = None) -> WordBpe:
    """One set of tables a worker process; `limits` are the most chunks and words that it remembers."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec)
    _loaded[key].limits = limits
    return _loaded[key]


def broadcast_vocabulary(spark, path: str):
    """The vocabulary file's text as a broadcast; its size is that of the file, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *added])


def encode(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of each text as array<int>."""
    spec = broadcast_vocabulary(df.sparkSession, vocabulary_path)
    df = df.drop(ids_col)

    def run(batches):
        bpe = loaded(spec.value)
        for b in batches:
            ids = bpe.encode_arrow(b.column(text_col).fill_null(""))
            stops = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
            yield b.append_column(ids_col, pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat))
        release()

    return df.mapInArrow(run, _with(df, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null ids decode to the empty text."""
    spec = broadcast_vocabulary(df.sparkSession, vocabulary_path)
    df = df.drop(text_col)

    def run(batches):
        bpe = loaded(spec.value)
        for b in batches:
            yield b.append_column(text_col, pa.array([bpe.decode(i or ()) for i in b.column(ids_col).to_pylist()], pa.string()))

    return df.mapInArrow(run, _with(df, [T.StructField(text_col, T.StringType())]))


def encode_decode(df: DataFrame, vocabulary_path: str, finish, added: list[T.StructField],
                  text_col: str = "text", keep: list[str] | None = None, limits: tuple[int, int] | None = None) -> DataFrame:
    """Encode and decode in one pass over the texts, keeping only what `finish(bpe, ids, decoded)` makes of a text.

    `finish` returns a tuple with a value for each field of `added`. Ids and decoded texts are
    several times as large as the texts; callers that need digests of them need not move them. `limits` are the most chunks and
    words that a worker remembers.
    """
    spec = broadcast_vocabulary(df.sparkSession, vocabulary_path)
    names = {f.name for f in added}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names and (keep is not None or c != text_col)]
    schema = _with(df.select(*keep), added)
    kinds = T.StructType(added)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe, kind = loaded(spec.value, limits), to_arrow_schema(kinds)
        release()  # what stages before and the reading of the vocabulary left behind
        for whole in batches:
            for k in range(0, whole.num_rows, 512):  # ids as Python numbers are large: few at a time
                b = whole.slice(k, 512)
                rows = [finish(bpe, ids := x.tolist(), bpe.decode(ids)) for x in bpe.encode_arrow(b.column(text_col).fill_null(""))]
                cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=schema.names)
        release()

    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)
