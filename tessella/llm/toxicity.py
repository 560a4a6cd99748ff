"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of lexicon words, their nearness to second-person words,
capitals, punctuation and obfuscation rates, and word statistics. The lexicon is a short fixed list
plus words that a significance test finds in the training texts; `mined_words` 0 leaves the fixed
list alone. Calibration is fitted on margins of held-out folds, whose words are mined and whose trees
are grown without the fold's labels. Trees and calibration are fitted on the driver with numpy, on a
bounded sample of labelled documents (`max_training_rows`, those of least hash, so that a repeated
run takes the same ones); only the sample's feature rows come to the driver. Scoring reads every
whole text once and moves no text.

Defined cases: null texts count as empty and get a score like any other; null labels are left out;
several labels of a document count as toxic if one of them is; without labelled documents of both
classes every score is the share of toxic ones (0 without labels); repeated rows are scored each;
other columns pass through, one with the name of the score column is replaced; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
import re
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, release, written

# Insults in four languages, second-person words, characters that stand for letters.
LEXICON = """idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown clowns dumb
fool jerk bastard bitch crap damn filth freak garbage hate hateful imbecile liar lunatic maggot parasite pig psycho
retard shit shut sucker ugly useless vermin vile weirdo whore asshole fuck fucking
idiote imbécile débile salaud connard connasse merde ordure pourriture crétin abruti bouffon
dumm dummkopf arschloch scheiße scheisse abschaum versager trottel widerlich wertlos hure
estúpido idiota imbécil mierda basura asqueroso patético payaso inútil cabrón puta""".split()
SECOND_PERSON = """you your yours yourself u ur ye tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch
euer sie usted ustedes tú ti vosotros vuestro""".split()
LEET = str.maketrans("013457@$!|*+", "oleastasiiit")

NAMES = ("log_words", "word_len", "lex_count", "lex_density", "lex_kinds", "lex_window", "second_density", "second_near", "second_near_share", "second_distance", "caps_rate", "caps_words", "exclaims", "questions", "punct_rate", "digit_rate", "obfuscated_count", "obfuscated_rate", "symbol_words", "repeat_rate", "lines", "unique_rate")
MINED_NAMES = ("mined_count", "mined_weight", "mined_density", "mined_max")
FOLDS = 4
WINDOW = 50
NEAR = 6
EDGES = string.punctuation + "«»“”‘’…–—"
STRETCH = re.compile(r"(.)\1{2,}")
CACHE = 100_000
PREFIXES = (5, 6, 7)


def forms(word: str) -> list[str]:
    """What the lexicon is mined from: the word and its beginnings, so that inflected and joined forms count."""
    return [word, *[word[:k] + "-" for k in PREFIXES if len(word) > k]] if 2 < len(word) < 40 else []


class Features:
    """Feature rows of texts under one or several mined lexicons; remembers what it found out about each word."""

    def __init__(self, *mined: dict[str, float]):
        self.lexicon, self.mined, self.second = set(LEXICON), mined, set(SECOND_PERSON)
        self.known: dict[str, tuple] = {}
        self.nothing = (0.0,) * len(mined)
        punct = np.zeros(256, bool)
        punct[[ord(c) for c in string.punctuation]] = True
        self.punct = punct

    def word(self, raw: str) -> tuple:
        """(bits, weight in each mined lexicon); bits: 1 lexicon, 2 second person, 4 obfuscated, 8 capitals, 16 inner symbol, 32 stretched."""
        bare = raw.strip(EDGES)
        low = bare.lower()
        bits = 0
        if low in self.lexicon:
            bits |= 1
        elif low in self.second:
            bits |= 2
        if len(bare) > 2 and bare.isupper():
            bits |= 8
        if bare and not bare.isalpha():
            if any(not c.isalnum() and c not in "'’-" for c in bare) or not bare.isdigit() and any(c.isdigit() for c in bare):
                bits |= 16
        # only words with a symbol or digit inside, or with a stretch, can hide another one
        stretched = STRETCH.search(low) is not None
        if not bits & 3 and len(raw) < 40:
            hidden = bits & 16 and any("".join(filter(str.isalpha, w.lower().translate(LEET))) in self.lexicon for w in (raw, bare))
            if hidden or stretched and STRETCH.sub(r"\1", low) in self.lexicon:
                bits |= 1 | 4
        if stretched:
            bits |= 32
        if not 2 < len(low) < 40:
            return bits, *self.nothing
        own = forms(low)
        return bits, *[max([m.get(f, 0.0) for f in own], default=0.0) for m in self.mined]

    def row(self, text: str) -> list[float]:
        """The features of `NAMES`, then those of `MINED_NAMES` for each mined lexicon."""
        raw = text.split()
        n = len(raw)
        if not n:
            return [0.0] * (len(NAMES) + len(MINED_NAMES) * len(self.mined))
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(raw).difference(known):
            known[w] = self.word(w)
        bits = np.fromiter([known[w][0] for w in raw], np.int16, n)
        lex = np.flatnonzero(bits & 1)
        sec = np.flatnonzero(bits & 2)
        near, dist = 0, 99.0
        if len(lex) and len(sec):
            at = np.searchsorted(sec, lex)
            gap = np.minimum(np.abs(sec[np.minimum(at, len(sec) - 1)] - lex), np.abs(sec[np.maximum(at - 1, 0)] - lex))
            near, dist = int((gap <= NEAR).sum()), float(gap.min())
        window = int((np.searchsorted(lex, lex + WINDOW) - np.arange(len(lex))).max()) if len(lex) else 0
        hist = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        size = max(1, int(hist.sum()))
        caps, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
        obf = int((bits & 4 > 0).sum())
        out = [math.log1p(n), size / n, len(lex), len(lex) / n, len({raw[i].strip(EDGES).lower() for i in lex.tolist()}), window, len(sec) / n, near,
               near / max(1, len(lex)), dist, caps / max(1, caps + lower), float((bits & 8 > 0).mean()), hist[33] / n, hist[63] / n,
               float(hist[self.punct].sum()) / size, float(hist[48:58].sum()) / size, obf, obf / n, float((bits & 16 > 0).mean()),
               float((bits & 32 > 0).mean()), float(hist[10]) / n, len(set(raw)) / n]
        if len(self.mined) == 1:
            columns = [[known[w][1] for w in raw]]
        else:
            columns = list(zip(*[known[w][1:] for w in raw], strict=True))
        for column in columns:
            mined = list(filter(None, column))
            out += [len(mined), sum(mined), len(mined) / n, max(mined, default=0.0)]
        return out


class Trees:
    """Boosted regression trees for log loss over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.cuts = []
        for j in range(d):
            v = np.unique(x[:, j])
            mids = (v[1:] + v[:-1]) / 2
            self.cuts.append(mids if len(mids) < self.bins else np.unique(np.quantile(mids, np.linspace(0, 1, self.bins - 1))))
        b = self.binned(x)
        prior = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = math.log(prior / (1 - prior))
        f, self.trees = np.full(n, self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(b, y - p, np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            f += self.walk(tree, b)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def grow(self, b, g, h) -> dict:
        """Level by level; a node is (feature, cut) or a leaf value, numbered as in a heap."""
        feature, cut, value = {}, {}, {}
        at = np.zeros(len(g), np.int64)
        for level in range(self.depth + 1):
            for node in np.unique(at).tolist():
                if node < (1 << level) - 1:
                    continue
                rows = np.flatnonzero(at == node)
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None, None)
                if level < self.depth:
                    for j, cuts in enumerate(self.cuts):
                        if not len(cuts):
                            continue
                        k = b[rows, j]
                        gl = np.cumsum(np.bincount(k, g[rows], len(cuts) + 1))[:-1]
                        hl = np.cumsum(np.bincount(k, h[rows], len(cuts) + 1))[:-1]
                        gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                        gain[(hl < self.least / 10) | (hs - hl < self.least / 10)] = 0
                        if gain[i := int(gain.argmax())] > best[0]:
                            best = (gain[i], j, i)
                if best[1] is None:
                    value[node] = self.rate * gs / (hs + self.l2)
                else:
                    feature[node], cut[node] = best[1], best[2]
                    at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
        return {"feature": feature, "cut": cut, "value": value}

    def walk(self, tree: dict, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        for node in sorted(tree["feature"]):
            rows = np.flatnonzero(at == node)
            at[rows] = 2 * node + 1 + (b[rows, tree["feature"][node]] > tree["cut"][node])
        table = np.zeros(1 << (self.depth + 1))
        for node, v in tree["value"].items():
            table[node] = v
        return table[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += self.walk(t, b)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both ascending."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], y[order].astype(float)
    sums, counts, lows, highs = [], [], [], []
    for a, v in zip(s.tolist(), y.tolist(), strict=True):
        sums.append(v), counts.append(1.0), lows.append(a), highs.append(a)
        while len(sums) > 1 and sums[-2] / counts[-2] >= sums[-1] / counts[-1]:
            v2, c2, h2 = sums.pop(), counts.pop(), highs.pop()
            lows.pop()
            sums[-1] += v2
            counts[-1] += c2
            highs[-1] = h2
    # shrink towards the open interval: a block without any toxic row is not proof of 0
    p = [(a + 0.02) / (c + 0.04) for a, c in zip(sums, counts, strict=True)]
    xs = [x for lo, hi in zip(lows, highs, strict=True) for x in (lo, hi)]
    return np.array(xs), np.maximum.accumulate(np.repeat(p, 2))


class Model:
    """Lexicon, trees and calibration; picklable.

    `x` has the features of the rows under the final lexicon, `held[k]` those under the lexicon mined without fold k.
    """

    def __init__(self, mined: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray, held: list[np.ndarray]):
        self.mined, self.constant, self.trees = mined, float(y.mean()) if len(y) else 0.0, None
        if len(y) and 0 < y.sum() < len(y):
            margin = np.zeros(len(y))
            for k, own in enumerate(held):
                t = y[fold != k]
                margin[fold == k] = Trees().fit(own[fold != k], t).margin(own[fold == k]) if 0 < t.sum() < len(t) else math.log((t.mean() + 1e-6) / (1 - t.mean() + 1e-6))
            self.trees, self.knots = Trees().fit(x, y), isotonic(margin, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.constant)
        m = self.trees.margin(x)
        # the margin breaks ties within a calibrated step
        return np.clip(0.998 * np.interp(m, *self.knots) + 0.002 / (1 + np.exp(-m)), 0, 1)


def may_train(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, max_training_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", allowed: Column | None = None, min_toxic: int = 4, least_z: float = 5.0, mined_words: int = 400) -> Model:
    """Fit on at most `max_training_rows` labelled documents; `allowed` restricts them further."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = [F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary")), F.col("doc_id")]
    sample = written(known.orderBy(*order).limit(max_training_rows), "labels")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample is at most max_training_rows rows of two numbers
    texts = written(texts.join(F.broadcast(sample), "doc_id").repartition("doc_id"), "sample")

    def words(batches):
        for b in batches:
            for t, y, k in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("fold").to_pylist(), strict=True):
                seen = list({f for w in {x.strip(EDGES).lower() for x in t.split()} for f in forms(w)})
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([y] * len(seen), pa.int32()), pa.array([k] * len(seen), pa.int32())], names=["w", "y", "fold"])

    texts = texts.withColumn("fold", (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % FOLDS).cast("int"))
    sizes = {r.fold: (r.n, r.pos) for r in texts.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}  # a row a fold
    n, pos = (sum(s[i] for s in sizes.values()) for i in (0, 1))
    lexicons: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    if 0 < pos < n and mined_words:
        each = [F.sum(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{name}{k}") for k in range(FOLDS) for name, v in (("a", F.col("y")), ("c", 1 - F.col("y")))]
        seen = written(texts.mapInArrow(words, "w string, y int, fold int").groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("c"), *each).where(F.col("a") >= min_toxic), "words")
        for k in range(FOLDS + 1):  # without fold k, at last without none
            without = sizes.get(k, (0, 0))
            rows, toxic = n - without[0], pos - without[1]
            clean = rows - toxic
            if not toxic or not clean:
                continue
            a, c = (F.col("a"), F.col("c")) if k == FOLDS else (F.col("a") - F.col(f"a{k}"), F.col("c") - F.col(f"c{k}"))
            p = (a + c) / rows
            z = (a / toxic - c / clean) / F.sqrt(p * (1 - p) * (1 / toxic + 1 / clean) + 1e-12)
            odds = F.log(((a + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))
            top = seen.where(a >= min_toxic).select("w", z.alias("z"), odds.alias("o")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "w").limit(mined_words).collect()
            lexicons[k] = {r.w: float(r.o) for r in top}

    def rows(batches):
        f = Features(*lexicons)
        for b in batches:
            x = [f.row(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    schema = T.StructType([texts.schema["doc_id"], texts.schema["y"], texts.schema["fold"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = texts.mapInArrow(rows, schema).orderBy("doc_id").collect()  # at most max_training_rows rows of numbers
    base, own = len(NAMES), len(MINED_NAMES)
    x = np.array([r.x for r in got], float).reshape(len(got), base + own * len(lexicons))
    under = [np.hstack([x[:, :base], x[:, base + own * k: base + own * (k + 1)]]) for k in range(len(lexicons))]
    return Model(lexicons[FOLDS], under[FOLDS], np.array([r.y for r in got], float), np.array([r.fold for r in got], int), under[:FOLDS])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score of each text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(score_col, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        f = Features(m.mined)
        for whole, at in ((w, k) for w in batches for k in range(0, max(1, w.num_rows), 1024)):  # few texts at a time are Python's
            b = whole.slice(at, 1024)
            x = np.array([f.row(t or "") for t in b.column(text_col).to_pylist()], float).reshape(b.num_rows, len(NAMES) + len(MINED_NAMES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(m.score(x), pa.float64())], names=[*keep, score_col])
        f.known.clear()
        release()

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **kw) -> DataFrame:
    """The documents whose score is below the threshold, with the columns they had."""
    model = fit(docs, labels, allowed=may_train(F.col(kw.get("id_col", "doc_id"))), **kw)
    name = free_name(docs, "toxicity")
    return score(docs, model, kw.get("text_col", "text"), name).where(F.col(name) < threshold).drop(name)


