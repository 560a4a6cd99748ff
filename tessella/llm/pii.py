"""Personal data by patterns plus a skip-chain conditional random field.

Patterns give the base spans (email, ip, card, phone). The field works on mentions: the base spans,
whose labels are observed, and looser candidates (numbers with separators, parts around "@" or a
written-out "at") that no pattern took. Neighbouring mentions are linked in a chain; distant ones by
skip edges of three kinds: EQUAL (same digits, same address once spelled plainly), NEAR (at most two
edits apart) and SHARED (same mail domain, same network of an address, same last seven digits).
Loopy message passing then makes labels agree over the document. A span is added where the posterior
of a candidate's label reaches `threshold`, in documents with base spans and in those without.

All weights (soft features, chain, each kind of skip edge) are learned together, by maximising the
pseudo-likelihood of the patterns' own labels over all documents: a mention's label given its soft
features (shape, length, separators, checks, the word before) and its neighbours' labels. Candidates
that no pattern took count as OTHER, but for those equal to a base span in another spelling: they are
what the field is for and are left unlabelled. Skip weights have a prior that rewards agreement
(`SKIP_PRIOR`), and each value of a feature is seen once as OTHER beforehand, so that what was never
seen is no entity. What comes to the driver are distinct combinations of discrete values, a finite
number whatever the input.

Defined cases: null and empty texts have no spans; base spans are never removed or changed; repeated
rows are treated each; texts of any length are read whole; a corpus without entities adds nothing;
equal posteriors go to the kind listed first; a column with the name of a result column is replaced;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batch, arrow_schema, release

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE_NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
LOOSE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9._%+-]{1,64}+){0,4}+(?: ?[\[(] ?at ?[\])] ?|@)[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{1,63}+){0,8}+", re.I)
LOOSE_ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]? ?(?:\.|dot) ?[\])]? ?[0-9]{1,3}){3}(?![0-9.])", re.I)
SPELLED = re.compile(r" ?[\[(] ?(at|dot|\.) ?[\])] ?| ?(\.) ?", re.I)
AT_HINT = re.compile(r"at ?[\])]", re.I)
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CONTEXT = {"phone": 1, "tel": 1, "call": 1, "telephone": 1, "mobile": 1, "fax": 1, "card": 2, "visa": 2, "credit": 2, "ip": 3, "host": 3, "server": 3, "address": 3, "mail": 4, "email": 4, "contact": 4}
THRESHOLD = 0.9
ROUNDS = 60
REACH = 400
#: Kinds of skip edges and the prior mean of the weight that agreement has on them.
EQUAL, NEAR, SHARED = range(3)
SKIP_PRIOR = (6.0, 1.0, 0.5)
NEAR_EDITS = 2
MOST_NEIGHBOURS = 3

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind and start; leftmost and non-overlapping inside a kind."""
    out: list[Span] = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            local = text[free:at]
            start = free + len(local.rstrip(LOCAL_CHARS))
            free = at + 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((0, start, m.end()))
                free = m.end()
            at = text.find("@", free)
    if DIGIT.search(text) is None:
        return out
    for m in ADDRESS.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Loose mentions that touch no base span, in order."""
    found = []
    if DIGIT.search(text) is not None:
        found += [m.span() for m in LOOSE_ADDRESS.finditer(text)]
        found += [m.span() for m in LOOSE_NUMBER.finditer(text)]
    if "@" in text or AT_HINT.search(text):
        found += [m.span() for m in LOOSE_AT.finditer(text) if not m[0].isalnum()]
    if not found:
        return []
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    furthest = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    out, last = [], -1
    for s, e in sorted(found):
        k = int(np.searchsorted(starts, e)) - 1
        if s >= last and (k < 0 or furthest[k] <= s):
            out.append((s, e))
            last = e
    return out


def plainly(mention: str) -> str:
    """A mention with spelled-out signs as signs, in lower case without spaces."""
    return SPELLED.sub(lambda m: "@" if (m[1] or "").lower() == "at" else ".", mention).replace(" ", "").lower()


def key_of(mention: str) -> str:
    """What similar mentions share: the plain address, or the last digits of a number."""
    plain = plainly(mention)
    if "@" in plain or QUAD.fullmatch(plain):
        return plain
    digits = "".join(c for c in mention if c.isdigit())
    return "#" + (digits if len(digits) > 12 else digits[-10:])


def edits(x: str, y: str) -> int:
    """Levenshtein distance of two short texts, bit-parallel."""
    if not x or not y:
        return max(len(x), len(y))
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    top, full = 1 << (len(x) - 1), (1 << len(x)) - 1
    up, down, dist = full, 0, len(x)
    for c in y:
        eq = masks.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(h | up) & full, up & h
        dist += (plus & top > 0) - (minus & top > 0)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | ~(v | plus) & full, plus & v
    return dist


def soft(text: str, start: int, end: int) -> tuple[int, ...]:
    """Discrete soft features of a mention, spelled plainly: digits, letters, separators, checks, its neighbours in the text."""
    m = text[start:end]
    plain = plainly(m)
    numbers = "".join(c for c in plain if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in plain)
    before = text[max(0, start - 24):start].rstrip(" :+#(").rsplit(None, 1)
    word = before[-1].strip(".,:;()").lower() if before else ""
    parts = plain.split(".")
    check = 1 + luhn(numbers) if not letters and 13 <= len(numbers) <= 19 else 3 + all(len(p) < 4 and int(p) < 256 for p in parts) if len(parts) == 4 and all(p.isdecimal() for p in parts) else 0
    joined = (start > 0 and text[start - 1].isalnum()) + 2 * (end < len(text) and text[end].isalnum())
    return (min(len(numbers), 20) if letters == 0 else 21, min(letters, 3), min(plain.count("."), 4), min(m.count("-") + m.count(" "), 4) if not letters else 0, int("(" in m and not letters), int("@" in plain), CONTEXT.get(word, 0), check, joined)


WIDTHS = (22, 4, 5, 5, 2, 2, 5, 5, 4)


def one_hot(rows: list[tuple[int, ...]]) -> np.ndarray:
    x = np.zeros((len(rows), sum(WIDTHS) + 1))
    x[:, -1] = 1
    at = 0
    for j, w in enumerate(WIDTHS):
        x[np.arange(len(rows)), at + np.array([r[j] for r in rows], int)] = 1
        at += w
    return x


def _share(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


class Field:
    """Weights of the field: soft features, chain (label, next label), skip (kind, label, label); picklable."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    @classmethod
    def fit(cls, seen: list[tuple[tuple[int, ...], int]], steps: int = 400, rate: float = 0.3, l2: float = 0.05) -> Field:
        """`seen`: (soft features, label, label before, label after, neighbours by kind of skip edge and label) and its count.

        The soft features of the labelled mentions tell their labels nearly always, which would leave nothing to learn from
        neighbours; so each mention counts a second time with its features masked, and each value of a feature once as OTHER.
        """
        d, k = sum(WIDTHS), len(SKIP_PRIOR)
        prior = np.stack([np.eye(LABELS) * m for m in SKIP_PRIOR])
        w, chain, skip = np.zeros((d + 2, LABELS)), np.zeros((LABELS, LABELS)), prior.copy()
        if not seen:
            return cls(w[:-1], chain, skip)
        f, rows = len(WIDTHS), [r for r, _ in seen]
        masked = np.zeros((len(rows), d + 2))
        masked[:, -1] = 1
        x = np.vstack([np.pad(one_hot([r[:f] for r in rows]), ((0, 0), (0, 1))), masked, np.hstack([np.eye(d), np.ones((d, 1)), np.zeros((d, 1))])])
        y = np.array([r[f] for r in rows] * 2 + [OTHER] * d)
        n = np.array([c for _, c in seen] * 2 + [1] * d, float)
        ends = np.array([r[f + 1: f + 3] for r in rows] * 2 + [(-1, -1)] * d)
        before, after = ((ends[:, [i]] == np.arange(LABELS)).astype(float) for i in (0, 1))
        near = np.array([r[f + 3:] for r in rows] * 2 + [(0,) * (k * LABELS)] * d, float).reshape(-1, k, LABELS)
        target, total = np.eye(LABELS)[y], np.sqrt(n.sum())
        sums = [np.full_like(m, 1e-8) for m in (w, chain, skip)]
        for _ in range(steps):  # ascent with a step for each weight that shrinks with its gradients
            z = x @ w + before @ chain + after @ chain.T + np.einsum("rkl,klm->rm", near, skip)
            miss = (target - _share(z)) * n[:, None]
            up_skip = np.einsum("rkl,rm->klm", near, miss)
            for m, up, s in zip((w, chain, skip), (x.T @ miss - l2 * w, before.T @ miss + (after.T @ miss).T - chain, (up_skip + up_skip.transpose(0, 2, 1)) / 2 - (skip - prior)), sums, strict=True):
                up = up / total
                s += up * up
                m += rate * up / np.sqrt(s)
        return cls(w[:-1], chain, skip)

    def posterior(self, features: list[tuple[int, ...]], known: list[int], chain: list[tuple[int, int]], skips: list[tuple[int, int, int]], rounds: int = ROUNDS) -> np.ndarray:
        """Marginals by loopy sum-product, all messages of a round at once; `known` is a label or -1. Exact where edges form no loop."""
        logit = one_hot(features) @ self.weights
        for i, k in enumerate(known):
            if k >= 0:
                logit[i] = -60
                logit[i, k] = 0
        if chain or skips:
            a, b = np.array([e[:2] for e in chain] + [e[:2] for e in skips]).T
            pot = np.concatenate([np.repeat(self.chain[None], len(chain), 0), self.skip[[e[2] for e in skips]] if skips else np.zeros((0, LABELS, LABELS))])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            a, b, m = np.r_[a, b], np.r_[b, a], len(a)
            back = np.r_[m: 2 * m, 0:m]
            msg = np.zeros((2 * m, LABELS))
            for step in range(rounds):
                total = logit.copy()
                np.add.at(total, b, msg)
                out = (total[a] - msg[back])[:, :, None] + pot
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                if step > rounds // 3:  # what has not settled by then swings: halves of both
                    new = 0.5 * (new + msg)
                moved = np.abs(new - msg).max()
                msg = new
                if moved < 1e-6:
                    break
            np.add.at(logit, b, msg)
        return _share(logit)


def _groups(keys: list[str]) -> list[tuple[int, dict]]:
    """(kind of edge, groups of mentions) by what similar mentions have in common; each mention is in a few groups."""
    equal, halves, shared = {}, {}, {}
    for i, k in enumerate(keys):
        equal.setdefault(k, []).append(i)
        middle = len(k) // 2
        if middle > 2:
            halves.setdefault((0, k[:middle]), []).append(i)
            halves.setdefault((1, k[middle:]), []).append(i)
        if "@" in k:
            shared.setdefault(k[k.index("@"):], []).append(i)
        elif k[0] == "#":
            shared.setdefault(k[-7:], []).append(i)
        else:
            shared.setdefault(k.rsplit(".", 1)[0] + ".", []).append(i)
    return [(EQUAL, equal), (NEAR, halves), (SHARED, shared)]


def graph(text: str, base: list[Span], loose: list[tuple[int, int]]):
    """(mentions, chain edges, skip edges); a mention is (start, end, kind or -1), a skip edge (mention, later mention, kind).

    Similar neighbours have a skip edge instead of one of the chain. In a group each member is linked to the next one and, without a label, to the labelled ones next to it: linear in the mentions.
    """
    nodes = sorted([(s, e, k) for k, s, e in base] + [(s, e, -1) for s, e in loose])
    keys = [key_of(text[s:e]) for s, e, _ in nodes]
    skips: dict[tuple[int, int], int] = {}
    for kind, groups in _groups(keys):
        for members in groups.values():
            if len(members) < 2:
                continue
            members = sorted(members, key=lambda i: (keys[i], i)) if kind == NEAR else members
            last = None
            pairs = list(zip(members, members[1:], strict=False))
            for i in members:
                if nodes[i][2] >= 0:
                    last = i
                elif last is not None:
                    pairs.append((last, i))
            last = None
            for i in reversed(members):
                if nodes[i][2] >= 0:
                    last = i
                elif last is not None:
                    pairs.append((i, last))
            for i, j in pairs:
                i, j = min(i, j), max(i, j)
                if (i, j) not in skips and (kind != NEAR or keys[i] != keys[j] and edits(keys[i], keys[j]) <= NEAR_EDITS) and (kind != SHARED or keys[i] != keys[j]):
                    skips[i, j] = kind
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= REACH and (i, i + 1) not in skips]
    return nodes, chain, sorted((i, j, k) for (i, j), k in skips.items())


def observed(nodes, skips) -> list[int]:
    """Labels for learning: the pattern's, OTHER, or -1 for a candidate that equals a base span in another spelling."""
    lab = [k if k >= 0 else OTHER for *_, k in nodes]
    for i, j, kind in skips:
        for x, y in ((i, j), (j, i)):
            if kind == EQUAL and nodes[x][2] < 0 and nodes[y][2] >= 0:
                lab[x] = -1
    return lab


def added_spans(text: str, base: list[Span], field: Field, threshold: float = THRESHOLD) -> list[Span]:
    """Spans that the field adds to the base spans."""
    loose = candidates(text, base)
    if not loose:
        return []
    nodes, chain, skips = graph(text, base, loose)
    p = field.posterior([soft(text, s, e) for s, e, _ in nodes], [k for *_, k in nodes], chain, skips)[:, :OTHER]
    return [(int(q.argmax()), s, e) for (s, e, k), q in zip(nodes, p, strict=True) if k < 0 and q.max() >= threshold]


def combinations_of(text: str) -> list[tuple[int, ...]]:
    """What is learned from a text: for each labelled mention soft features, label, label before and after, neighbours by kind of skip edge and label."""
    base = base_spans(text)
    loose = candidates(text, base)
    if not base and not loose:
        return []
    nodes, chain, skips = graph(text, base, loose)
    lab = observed(nodes, skips)
    before, after = [-1] * len(nodes), [-1] * len(nodes)
    for i, j in chain:
        before[j], after[i] = lab[i], lab[j]
    near = [[0] * (len(SKIP_PRIOR) * LABELS) for _ in nodes]
    for i, j, kind in skips:
        for x, y in ((i, j), (j, i)):
            if lab[y] >= 0:
                at = kind * LABELS + lab[y]
                near[x][at] = min(MOST_NEIGHBOURS, near[x][at] + 1)
    return [(*soft(text, s, e), y, p, q, *m) for (s, e, _), y, p, q, m in zip(nodes, lab, before, after, near, strict=True) if y >= 0]


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """Count the combinations of all documents and fit the field on the driver."""
    kinds = arrow_schema(docs.sparkSession, "what string, n long")

    def count(batches):
        seen: dict[tuple, int] = {}

        def rows():
            return arrow_batch([(",".join(map(str, k)), n) for k, n in seen.items()], kinds)

        for b in batches:
            for text in b.column("text").to_pylist():
                for what in combinations_of(text):
                    seen[what] = seen.get(what, 0) + 1
            if len(seen) > 10_000:
                yield rows()
                seen = {}
        yield rows()

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    got = texts.mapInArrow(count, "what string, n long").groupBy("what").agg(F.sum("n").alias("n")).orderBy("what").collect()
    return Field.fit([(tuple(map(int, r.what.split(","))), r.n) for r in got])


def rendered(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans)])


def find(docs: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans) and spans (all of them)."""
    added = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    names = {f.name for f in added}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names and (keep is not None or c != text_col)]
    schema = T.StructType([*docs.select(*keep).schema.fields, *added])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        own = sent.value
        for b in batches:
            rows = []
            for t in b.column(text_col).to_pylist():
                base = base_spans(t) if t else []
                counts = [0] * len(KINDS)
                for k, *_ in base:
                    counts[k] += 1
                more = added_spans(t, base, own, threshold) if t else []
                rows.append((*counts, hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(base + more)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(added)
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def redact_text(text: str, spans: list[Span]) -> str:
    """Replace each span by its kind in angle brackets; where spans overlap, one replacement covers them."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """Replace all spans in the texts; `length_col` (where present) follows the changed texts. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches):
        own = sent.value
        for whole, at in ((w, k) for w in batches for k in range(0, max(1, w.num_rows), 1024)):  # few texts at a time are Python's
            b = whole.slice(at, 1024)
            texts, lengths = b.column(text_col).to_pylist(), b.column(length_col).to_pylist() if length_col in names else None
            for i, t in enumerate(texts):
                base = base_spans(t) if t else []
                if spans := base + added_spans(t or "", base, own, threshold):
                    texts[i] = redact_text(t, spans)
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            new = {text_col: pa.array(texts, pa.string())} | ({length_col: pa.array(lengths, b.column(length_col).type)} if lengths is not None else {})
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names=names)
        release()

    return docs.mapInArrow(run, docs.schema)
