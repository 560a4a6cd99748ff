"""The training-data operators against plain versions, round trips and edge cases."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, html_extract, jaccard, nn_descent, passages, pii, queries, records, shards, toxicity
from tessella.llm.components import components

ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "Tie tie TIE"), (5, "Tie tie TIE"), (6, "é" * 3000 + " x" * 20000), (None, "no id here"), (7, "\x1c\x85  ﬁ İ Σ <|endoftext|>x")]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white and very long texts, repeated rows, and extra columns with the names of results."""
    return spark.createDataFrame([(d, t, "x", 1.0, "y") for d, t in ODD], "doc_id long, text string, ids string, score double, spans string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id < 0")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", ","]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


# BPE ------------------------------------------------------------------------------------------------

def test_bpe_equals_library(spark, sf_dir, library):
    coder = bpe.WordBpe(open(queries.vocabulary(), encoding="utf-8").read())
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    letters = "abthein'sé ΣİßÅå<|startoftext|> \x1c\x85​½²三語👍🏽ﬁ0१_-\n\t́"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("thinganderoesl") for _ in range(rng.randint(5, 60))) for _ in range(3000)] + ["x" * 5000, "ab" * 3000, "don't we'll I'VE", "<|endoftext|>"]
    mine = coder.encode(texts)
    ref = library.encode_batch(texts, add_special_tokens=False)
    assert [m for m, r in zip(mine, ref, strict=True) if m != r.ids] == []
    assert all(coder.decode(m) == library.decode(m, skip_special_tokens=False) for m in mine)


def test_bpe_any_added_token(library):
    """Strings of added tokens are found whatever they look like."""
    import json

    from tokenizers import AddedToken, Tokenizer

    spec = json.loads(open(queries.vocabulary(), encoding="utf-8").read())
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    own = Tokenizer.from_str(json.dumps(spec))
    own.add_special_tokens([AddedToken("[SEP.]", normalized=False)])
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": own.token_to_id("[SEP.]"), "content": "[SEP.]"})
    assert own.token_to_id("[SEP.]") == top + 1
    coder = bpe.WordBpe(json.dumps(spec))
    texts = ["one[SEP.]two", "[SEP.]", "three [SEPx] four", "<|endoftext|>[SEP.]five"]
    assert coder.encode(texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_bpe_verification_finds_every_wrong_guess():
    coder = bpe.WordBpe(open(queries.vocabulary(), encoding="utf-8").read())
    rng = random.Random(2)
    for _ in range(400):
        w = "".join(rng.choice("theinganrosl") for _ in range(rng.randint(2, 14)))
        guess, exact = coder.propose(w + "</w>"), coder.merge_exactly(coder.symbols(w + "</w>"))
        assert coder.merge_long(coder.symbols(w + "</w>")) == exact
        fits = bool(coder.compatible(np.array(guess[:-1]), np.array(guess[1:])).all()) if len(guess) > 1 else True
        assert fits == (guess == exact)


def test_bpe_small_tables(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_LIMIT", 20)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 200)
    coder = bpe.WordBpe(open(queries.vocabulary(), encoding="utf-8").read())
    rng = random.Random(3)
    texts = [prose(rng, 30) for _ in range(40)]
    assert coder.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_edges(odd, empty, library):
    got = bpe.decode(bpe.encode(odd, queries.vocabulary()), queries.vocabulary())
    assert got.columns == ["doc_id", "text", "score", "spans", "ids", "decoded"]
    for r in got.collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == library.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode(empty, queries.vocabulary()).count() == 0


def test_op1(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs[:100]:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# Records ----------------------------------------------------------------------------------------------

def test_records_round_trip(spark, sf_dir, library):
    got = sorted(queries.op6_records(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    at = 0
    for r, d in zip(got, docs, strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)


def test_records_edges_and_index(spark, odd, empty):
    files = records.write_records(odd, queries.vocabulary(), tasks=3)
    rows = records.read_records(spark, files, lambda ids: (ids.tolist(),), "ids array<int>").orderBy("start").collect()
    assert len(rows) == len(ODD) and rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(d for d, _ in ODD if d is not None)
    f = files.orderBy("first_id").collect()[-1]
    for entry in records.read_index(f.folder, f.file):
        doc, ids = records.read_at(f.folder, f.file, int(entry["offset"]), int(entry["length"]))
        assert doc == entry["doc_id"] and len(ids) == entry["n_tokens"]
    none = records.write_records(empty, queries.vocabulary(), tasks=2)
    assert none.count() == 0 and records.read_records(spark, none, lambda ids: (0,), "x int").count() == 0


def test_records_order_of_many_files(spark):
    """Files are in the order of their number, not of their name: part-100000 comes after part-99999."""
    rows = [(f"part-{n:05d}", n, n, 1, 10, 0, "x") for n in (99_998, 99_999, 100_000, 100_001)]
    files = spark.createDataFrame(rows, "file string, number int, first_id long, n_docs long, n_tokens long, bytes long, folder string")
    before = records.tokens_before(files)
    assert [(r.number, r.before) for r in before.orderBy("number").collect()] == [(n, 10 * i) for i, n in enumerate((99_998, 99_999, 100_000, 100_001))]


def test_records_refuse_the_id_that_stands_for_none(spark):
    d = spark.createDataFrame([(records.NO_ID, "x")], "doc_id long, text string")
    with pytest.raises(Exception, match="stands for no id"):
        records.write_records(d, queries.vocabulary(), tasks=1)


def test_records_find_damage():
    rec = records.frame(5, np.array([1, 2, 3]), 2)
    assert records.unframe(rec)[0] == 5 and records.unframe(rec)[1].tolist() == [1, 2, 3] and records.unframe(rec)[2] == len(rec)
    for k in range(len(rec)):
        bad = bytearray(rec)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        records.unframe(rec[:-1])


# Shards -------------------------------------------------------------------------------------------------

def test_shards(odd, empty):
    got = shards.shard_by_bytes(odd, 4).collect()
    assert len(got) == len(ODD)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r["size"] for r in got if r.doc_id == 1} == {16}
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in ODD)
    assert shards.shard_by_bytes(empty, 4).count() == 0


def test_shards_balance(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([(i * 7 % 1009, "x" * rng.randrange(2000)) for i in range(1009)], "doc_id long, text string")
    got = shards.shard_by_bytes(d, 10).collect()
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(10)]
    assert max(sizes) - min(sizes) <= 2 * 2016
    order = sorted(got, key=lambda r: r.doc_id)
    assert [r.shard for r in order] == sorted(r.shard for r in got)


# HTML -----------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site</h1><a href=/>home</a></header>
<nav><ul><li><a href=/a>a</a></ul></nav><div id="sidebar"><p>Side text, long enough, to be scored as a paragraph here.</p></div><div class="cookie-notice"><p>We use cookies, and more, and more, and yet more of them.</p></div>
<div class="content"><h2>Title</h2><p>First paragraph with <a href="x">a link</a>, some text, and more &eacute;&#39;s.<p>Second one, unclosed, with &amp; and <b>bold</b>word 1 < 5 text.<!-- <p>no</p> --><ul><li>One<li>Two</ul><div class="ad">Buy, buy, buy, all of you.</div><script>var x = "<p>no</p>";</script></div>
<div class="comments"><p>Reader comment, a very long one, indeed, it goes on and on.</p></div><form><p>Form text, long, enough, really, to count as one.</p></form><footer>F</footer></body></html>"""


def test_html_page():
    assert html_extract.main_text(PAGE) == "Title\n\nFirst paragraph with a link, some text, and more é's.\n\nSecond one, unclosed, with & and boldword 1 < 5 text.\n\nOne\n\nTwo"


def test_html_edges(spark):
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    assert html_extract.main_text("plain text only") == "plain text only"
    assert html_extract.main_text("<article>short</article>") == "short"
    assert html_extract.main_text('<div class="a' * 2000) is not None and html_extract.main_text("<" * 20000) is not None
    assert html_extract.main_text("<div>" * 3000 + "deep text that is long enough, yes") == "deep text that is long enough, yes"
    d = spark.createDataFrame([(1, None, "old"), (2, PAGE, "old"), (2, PAGE, "old")], "page_id long, html string, text string")
    got = html_extract.extract(d)
    assert got.columns == ["page_id", "html", "text"] and sorted(len(r.text) for r in got.collect())[0] == 0
    assert html_extract.extract(d.where("page_id > 9")).count() == 0


TEXT = "<p>A first paragraph, long enough, with commas, that anyone would read to its end.</p><p>And a second one, no shorter, for good measure and more.</p>"
SAME = "A first paragraph, long enough, with commas, that anyone would read to its end.\n\nAnd a second one, no shorter, for good measure and more."


@pytest.mark.parametrize("page", [
    f'<body><div class="layout with-sidebar"><article>{TEXT}</article></div></body>',
    f'<body><div id="content" class="no-comments">{TEXT}</div><div id="comments"><p>A comment, by a reader, that is long, very long, and full of commas, too.</p></div></body>',
    f'<body><form action="/"><input name=q><div><nav><a href=/>x</a></nav>{TEXT}</div></form></body>',
    f'<body><div class="sidebar-left"><article>{TEXT}</article><div class="sidebar"><p>Some side text, that is long enough, to be read as a paragraph.</p></div></div></body>',
    f'<body><div>{TEXT}</div><form><p>Your name, your mail, please, so that we can answer you.</p></form></body>',
    f'<body><article><section>{TEXT}</section></article><section id=comments><article class="comment-body"><p>A reply, long, with commas, that goes on and on, and on.</p></article></section></body>',
    f'<body><main><ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul><div>{TEXT}</div></main></body>',
])
def test_html_trees(page):
    assert html_extract.main_text(page) == SAME


@pytest.mark.parametrize("name", ["related-work", "share-price", "tags", "side"])
def test_html_loose_words_inside_an_article(name):
    more = "<p>Prices rose, fell, and rose again in the course of the year.</p>"
    assert html_extract.main_text(f'<body><article>{TEXT}<div class="{name}">{more}</div></article></body>') == SAME + "\n\n" + more[3:-4]
    links = "".join(f"<li><a href=/{i}>Another story {i}</a>" for i in range(4))
    assert html_extract.main_text(f'<body><article>{TEXT}<div class="{name}"><ul>{links}</ul></div></article></body>') == SAME


ONE, TWO = "The council met on Tuesday, and it decided on the bridge.", "Work begins in spring, the mayor said, and it will take a year."


@pytest.mark.parametrize("page", [
    '<main><div class="elementor-widget-container">{}</div></main>', '<div class="elementor-widget-wrap">{}</div>', '<div class="post type-post comments-open">{}</div>', '<article class="post comments-open">{}</article>',
    '<article class="post comment-status-closed">{}</article>', '<div class="comment-enabled">{}</div>', '<div class="ad-free">{}</div>', '<div role="form">{}</div>', '<fieldset>{}</fieldset>', '<div class="reply">{}</div>',
    '<div class="site no-sidebar"><div class="modal">{}</div></div>'])
def test_html_names_of_builders_and_states_do_not_hide_the_article(page):
    menu = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul>'
    assert html_extract.main_text(f"<html><body>{menu}{page.format(f'<p>{ONE}</p><p>{TWO}</p>')}</body></html>") == f"{ONE}\n\n{TWO}"


def test_html_builder_blocks_share_an_article():
    parts = "".join(f'<div class="elementor-widget"><div class="elementor-widget-container"><p>{k}. {ONE}</p></div></div>' for k in range(6))
    assert html_extract.main_text(f'<body><main>{parts}</main><div class="sidebar"><p>{TWO}</p></div></body>') == "\n\n".join(f"{k}. {ONE}" for k in range(6))


def test_html_comments_go_even_where_they_are_long():
    comments = "".join(f'<div class="comment"><p>{TWO} {k}, and more of it, as readers will.</p></div>' for k in range(9))
    assert html_extract.main_text(f'<body><article><p>{ONE}</p><p>{TWO}</p></article><div class="comments">{comments}</div></body>') == f"{ONE}\n\n{TWO}"


def test_html_link_lists_between_paragraphs_stay():
    links = '<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul>'
    assert html_extract.main_text(f"<article><p>{ONE}</p>{links}<p>{TWO}</p></article>") == f"{ONE}\n\nOne\n\nTwo\n\nThree\n\n{TWO}"
    assert html_extract.main_text(f"<article><p>{ONE}</p><p>{TWO}</p>{links}</article>") == f"{ONE}\n\n{TWO}"
    assert html_extract.main_text(f"<article><p>{ONE}</p><ul class='menu'>{links}</ul><p>{TWO}</p></article>") == f"{ONE}\n\n{TWO}"


def test_html_references_end_with_their_element():
    assert html_extract.main_text(f"<article><p>{ONE} &<b>amp;</b> &amp; &copy; x&lt;y.</p></article>") == f"{ONE} &amp; & \xa9 x<y."


def test_html_sections_of_an_article_stay():
    short = "<section><h2>Short</h2><ul><li>one</li><li>two</li></ul></section>"
    assert html_extract.main_text(f"<body><article><h1>T</h1><section>{TEXT * 4}</section>{short}</article></body>") == "\n\n".join(["T", *[SAME] * 4, "Short", "one", "two"])


@pytest.mark.parametrize("tag", ["article", "main", "div", "section", "div class=x17"])
def test_html_tables_against_template(spark, sf_dir, tag):
    """The pages as they are and with another element, or none that tells anything, in place of the article."""
    import html as h

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0]
        r = type(r)(html=r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")) if tag != "article" else r
        parts = (re.sub(r"<[^>]*$", "", re.sub(r"<(?!/?(p|h1)\b)[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)) for x in re.split(r"</?(?:p|h1)>", body))
        assert html_extract.main_text(r.html) == "\n\n".join(x for x in (" ".join(h.unescape(p).split()) for p in parts) if x)


# Jaccard ------------------------------------------------------------------------------------------------

def plain_components(texts: dict, percent=75):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(lower).split()
        k = min(5, len(w))
        sets[d] = {b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in texts}


def near_corpus():
    rng = random.Random(5)
    docs, n = {}, 0
    shared = prose(rng, 30)
    for size in (1, 1, 2, 5, 40, 60):
        base = prose(rng, rng.randint(40, 160)).split()
        for k in range(size):
            w = list(base)
            for _ in range(0 if k == 0 else rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            docs[n * 13 % 997] = " ".join(w)
            n += 1
    for _ in range(60):
        docs[n * 13 % 997] = prose(rng, rng.randint(3, 20)) + " " + shared
        n += 1
    for t in (None, "", " ", "one", "One", "a b c d", "a b c d e", "A B c d e"):
        docs[n * 13 % 997] = t
        n += 1
    return docs


def test_jaccard_exact(spark):
    docs = near_corpus()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d).collect()}
    assert got == plain_components(docs)
    kept = {r.doc_id for r in jaccard.keep_one(d).collect()}
    assert kept == {c for _, c in got.values()}


def test_jaccard_prefix_is_safe():
    """Any two sets that reach the threshold share at least min(l) tokens of their prefixes, whatever l each chose."""
    rng = np.random.default_rng(6)
    counters = rng.integers(0, 400, (2, jaccard.SKETCH))
    sketch = jaccard.Sketch(counters)
    for _ in range(200):
        n = int(rng.integers(4, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        b[: int(rng.integers(0, max(1, n // 8)))] = rng.integers(0, 2**63, 1).astype(np.uint64)
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        (pa_, la), (pb, lb) = sketch.prefix(a, 75), sketch.prefix(b, 75)
        c = len(np.intersect1d(pa_, pb))
        assert c >= min(la, lb) and c + max(len(a) - len(pa_), len(b) - len(pb)) >= both


def test_jaccard_short_lists_count_a_pair_once(spark):
    """Pairs across components of lists with three or more: shared tokens count together, whichever side is outside the leader's."""
    rng = random.Random(21)
    n, p, nodes = 100, 28, range(16)
    tokens = {d: set(rng.sample(range(40), p)) for d in nodes}
    lists = {t: [d for d in nodes if t in tokens[d]] for t in range(40)}
    rows = []
    for t, m in lists.items():
        head = rng.choice(m) % 4  # of four components
        rows += [(t, d, n, p, p, d % 4, d % 4 != head) for d in m]
    short = spark.createDataFrame(rows, "token long, node long, n long, p int, k long, component long, out boolean")
    got = sorted((r.a, r.b) for r in jaccard._short_list_pairs(short, 75).collect())
    need = -(-2 * n * 75 // 175)
    want = [(a, b) for a, b in itertools.combinations(nodes, 2) if a % 4 != b % 4 and len(tokens[a] & tokens[b]) + n - p >= need]
    assert want and got == want


def test_jaccard_edges(odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id == 5} == {5} and [r.component_id for r in got if r.doc_id is None] == [None]
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (1, 2, 3))
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["jaccard", "passages", "shards", "decontam", "records", "pii", "toxicity"])
def test_columns_named_like_results_change_nothing(spark, odd, name):
    plain = odd.select("doc_id", "text")
    clash = plain.select("*", *[F.lit("x").alias(c) for c in "component_id n_shingles node token k1 id class_id passages partners size slot shard at block item_id distance file number start n_tokens spans n_email score held_out fold".split()])
    items = spark.createDataFrame([(1, "tie tie tie")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    run = {"jaccard": jaccard.near_duplicates, "passages": passages.repeated_passages, "shards": lambda d: shards.shard_by_bytes(d, 3), "decontam": lambda d: decontam.find_leaks(d, items),
           "records": lambda d: records.read_records(spark, records.write_records(d, queries.vocabulary(), tasks=2), lambda ids: (len(ids),), "n int"),
           "pii": lambda d: pii.find(d, pii.fit(d), keep=["doc_id"]), "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels), keep=["doc_id"])}[name]
    want, got = (sorted(map(tuple, run(d).collect()), key=repr) for d in (plain, clash))
    assert got == want and (want or name == "passages")


# Passages -----------------------------------------------------------------------------------------------

def test_passages_planted(spark):
    rng = random.Random(8)
    exact, fuzzy = prose(rng, 70), prose(rng, 90).split()
    docs = {i: prose(rng, 150) for i in range(40)}
    for i in (3, 11, 29):
        docs[i] = prose(rng, 40) + " " + exact + " " + prose(rng, 30)
    for k, i in enumerate((5, 17)):
        w = list(fuzzy)
        for j in range(8 + k, len(w), 17):
            w[j] = f"change{k}{j}"
        docs[i] = prose(rng, 33) + " " + " ".join(w) + " " + prose(rng, 21)
    docs[50] = docs[51] = prose(rng, 60)
    docs[52], docs[53], docs[54] = None, "", exact.split()[0]
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(d).collect()}
    assert set(got) == {3, 11, 29, 5, 17, 50, 51}
    assert {got[i].passages for i in (3, 11, 29)} == {"40:110"} and {got[i].class_id for i in (3, 11, 29)} == {3}
    s, e = map(int, got[5].passages.split(":"))
    assert s >= 33 and e <= 123 and e - s >= 75 and got[17].class_id == 5
    assert got[50].passages == "0:60" and got[51].class_id == 50


def test_chains_against_all_predecessors():
    """The best chain's score is that of a search over all pairs of runs, and chains ascend and are disjoint."""
    rng, k, cost = random.Random(19), passages.SEED_WORDS, passages.GAP_COST
    for _ in range(300):
        n = rng.randint(1, 50)
        top = rng.choice((40, 300))
        a, b, size = ([rng.randrange(lo, hi) for _ in range(n)] for lo, hi in ((0, top), (0, top), (1, 20)))
        best = [0.0] * n
        for j in sorted(range(n), key=lambda i: (a[i], b[i])):
            before = [i for i in range(n) if a[i] + size[i] <= a[j] and b[i] + size[i] <= b[j]]
            best[j] = size[j] + k - 1 + max([0.0] + [best[i] - cost * (a[j] - a[i] - size[i] + b[j] - b[i] - size[i]) for i in before])
        found = passages.chains(np.array(a), np.array(b), np.array(size))
        assert sorted(i for c in found for i in c) == list(range(n))
        assert all(a[i] + size[i] <= a[j] and b[i] + size[i] <= b[j] for c in found for i, j in zip(c, c[1:], strict=False))
        s = 0.0
        for i, j in zip([None, *found[0]], found[0], strict=False):
            s = size[j] + k - 1 + (0.0 if i is None else s - cost * (a[j] - a[i] - size[i] + b[j] - b[i] - size[i]))
        assert abs(s - max(best)) < 1e-9


def test_equal_runs_are_those_of_all_pairs():
    rng, k = random.Random(26), passages.SEED_WORDS
    for _ in range(60):
        x = [rng.randrange(1 << 32) for _ in range(rng.randint(0, 60))]
        y = [rng.randrange(1 << 32) for _ in range(10)] + x[5:30] + [7] + x[31:50] + x[10:20]
        got = set(zip(*(c.tolist() for c in passages.equal_runs(np.array(x, np.uint32), np.array(y, np.uint32))), strict=True))
        want = set()
        for i in range(len(x)):
            for j in range(len(y)):
                if x[i] == y[j] and (not i or not j or x[i - 1] != y[j - 1]):
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                        n += 1
                    if n >= k:
                        want.add((i, j, n - k + 1))
        assert got == want
    long = np.full(100_000, 3, np.uint32)
    a, b, size = passages.equal_runs(long, long[:70_000])
    assert len(a) < 100_000 and (100_000 - 4) in (a + size)


def passages_by_force(texts):
    """{id: spans}, {id: least id linked} by comparing all pairs of texts, none of them equal."""
    words = [w.astype(np.uint32) for w in passages.word_arrays(pa.array(texts, pa.string()))]
    spans, up = {}, list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = {}
    for x, y in itertools.combinations(range(len(texts)), 2):
        for s, e, t, f in passages.shared_spans(words[x], words[y]):
            spans.setdefault(x, []).append((s, e, y))
            spans.setdefault(y, []).append((t, f, x))
    kept = {i: [z for z in passages.merged(got, passages.JOIN_GAP) if z[1] - z[0] >= passages.MIN_WORDS] for i, got in spans.items()}
    for i, got in spans.items():
        for s, e, other in got:
            if any(s >= u and e <= v for u, v, _ in kept[i]):
                x, y = root(i), root(other)
                up[max(x, y)] = min(x, y)
    return {i: [(s, e) for s, e, _ in k] for i, k in kept.items() if k}, {i: root(i) for i, k in kept.items() if k}


def repeating_corpus(rng):
    """Texts with near copies, passages in two to thirty texts, fuzzy ones, frequent lines, passages of frequent lines, repetitions."""
    lines = [prose(rng, rng.randint(6, 30)) for _ in range(12)]
    shared = [prose(rng, rng.randint(50, 90)) for _ in range(10)]
    long = " ".join(rng.choice(lines) for _ in range(5))
    out = []
    for i in range(260):
        parts = [prose(rng, rng.randint(5, 60))]
        for _ in range(rng.randint(0, 3)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(rng.choice(lines))
            elif kind < 0.55:
                parts.append(shared[min(9, int(rng.expovariate(0.4)))])
            elif kind < 0.75:
                w = rng.choice(shared).split()
                parts.append(" ".join(f"new{rng.randrange(10**6)}" if rng.random() < 0.08 else x for x in w))
            elif kind < 0.85:
                parts.append(long)
            parts.append(prose(rng, rng.randint(5, 40)))
        out.append(" ".join(parts))
    base = prose(rng, 200).split()
    out += [" ".join(f"edit{rng.randrange(10**6)}" if rng.random() < 0.02 else x for x in base) for _ in range(30)]
    return out


def test_passages_against_all_pairs(spark):
    texts = repeating_corpus(random.Random(27))
    spans, classes = passages_by_force(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(d).collect()}
    found = {i: [tuple(map(int, x.split(":"))) for x in r.passages.split(",")] for i, r in got.items()}
    covered = lambda s: {i: {w for a, b in v for w in range(a, b)} for i, v in s.items()}
    want, have = covered(spans), covered(found)
    recall = sum(len(want[i] & have.get(i, set())) for i in want) / sum(map(len, want.values()))
    print(f"documents {len(set(want) & set(have))} of {len(want)}, words {recall:.4f}, too many {sorted(set(have) - set(want))}")
    assert set(have) <= set(want) and len(set(want) - set(have)) <= 0.01 * len(want) and recall >= 0.97
    assert sum(got[i].class_id == classes[i] for i in found) >= 0.99 * len(found)


def test_no_pair_of_passages_is_left_out(spark, monkeypatch):
    """The words and classes of all pairs, with partners of many texts dealt to several tasks."""
    monkeypatch.setattr(passages, "PARTNER_PAIRS", 8)
    texts = repeating_corpus(random.Random(27))
    spans, classes = passages_by_force(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(d).collect()}
    assert {i: [tuple(map(int, x.split(":"))) for x in r.passages.split(",")] for i, r in got.items()} == spans
    assert {i: r.class_id for i, r in got.items()} == classes


def two_passages(rng, first, gap, second):
    """Two texts that share `first` words, differ for `gap` words each, and share `second` words."""
    one, two = prose(rng, first), prose(rng, second)
    return [f"{one} {prose(rng, gap)} {two}" for _ in range(2)]


def test_second_passage_after_a_long_one(spark):
    rng = random.Random(20)
    docs = [t for gap in (50, 100, 150, 250) for t in two_passages(rng, 200, gap, 60)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.passages for r in passages.repeated_passages(d).collect()}
    assert got == {i: f"0:200,{200 + gap}:{260 + gap}" for i, gap in enumerate(g for g in (50, 100, 150, 250) for _ in range(2))}


def test_passage_twice_in_one_text(spark):
    rng = random.Random(22)
    for _ in range(2):
        one = prose(rng, 70)
        docs = [f"{one} {prose(rng, 60)} {one}", f"{prose(rng, 30)} {one}", f"{one} {prose(rng, 30)}"]
        d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        got = {r.doc_id: r.passages for r in passages.repeated_passages(d).collect()}
        assert got == {0: "0:70,130:200", 1: "30:100", 2: "0:70"}


def test_passage_of_frequent_lines(spark):
    """Each line of the passage stands in many other texts, in none of them two in a row as in the passage."""
    rng = random.Random(23)
    docs, want = [], {}
    for _ in range(5):
        lines = [prose(rng, 10) for _ in range(6)]
        for _ in range(2):
            want[len(docs)] = "30:90"
            docs.append(f"{prose(rng, 30)} {' '.join(lines)} {prose(rng, 30)}")
        for line in lines:
            docs += [f"{prose(rng, 20)} {line} {prose(rng, 20)}" for _ in range(25)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(d).collect()}
    assert {i: r.passages for i, r in got.items()} == want
    assert all(got[i].class_id == min(j for j in want if j // 152 == i // 152) for i in want)


def test_frequent_seeds_are_counted_over_all_texts(spark, monkeypatch):
    """Copies count once; a bound on sampled documents, as there was one, changes nothing."""
    rng = random.Random(24)
    monkeypatch.setattr(passages, "FREQUENT_SHARE", 20)
    monkeypatch.setattr(passages, "SAMPLE_DOCS", 20, raising=False)
    lines = [prose(rng, 12) for _ in range(12)]
    texts = [f"{prose(rng, 20)} {' '.join(x for k, x in enumerate(lines) if i % (k + 8) == 0)} {prose(rng, 10)}" for i in range(300)]
    docs = [*texts, *[texts[1]] * 40, None, ""]
    frequent = []
    monkeypatch.setattr(passages, "_frequent", lambda *a, found=passages._frequent: frequent.append(found(*a)) or frequent[-1])
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(7)
    passages.repeated_passages(d).count()
    held = {}
    for t in set(texts):
        h, _, _ = passages.minimizers(passages.word_arrays(pa.array([t])))
        for s in set((h >> np.uint64(16)).tolist()):
            held[s] = held.get(s, 0) + 1
    want = sorted(s for s, n in held.items() if n >= 15)  # 301 different texts
    assert frequent[0].tolist() == want and 3 <= len(want) < len(held)


def test_frequent_seeds_with_few_counters(spark, monkeypatch):
    """Each different text counts once; counters that many seeds share, and any dealing of rows, change nothing."""
    rng = random.Random(27)
    monkeypatch.setattr(passages, "FREQUENT_SHARE", 20)
    lines = [prose(rng, 12) for _ in range(12)]
    texts = [f"{prose(rng, 20)} {' '.join(x for k, x in enumerate(lines) if i % (k + 8) == 0)} {prose(rng, 10)}" for i in range(300)]
    got = []
    for slice_, parts in ((passages.SLICE, 3), (4, 3), (64, 40)):
        monkeypatch.setattr(passages, "SLICE", slice_)
        monkeypatch.setattr(passages, "MAX_COUNTERS", slice_)
        seen = []
        with monkeypatch.context() as own:
            own.setattr(passages, "_frequent", lambda seeds, *a, found=passages._frequent, seen=seen: seen.append((seeds.where("main").count(), found(seeds, *a).tolist())) or np.array(seen[-1][1], np.uint64))
            d = spark.createDataFrame(list(enumerate([*texts, *texts[:50]])), "doc_id long, text string").repartition(parts)
            rows = sorted((r.doc_id, r.class_id, r.passages) for r in passages.repeated_passages(d).collect())
        got.append((*seen, [r[:2] for r in rows]))
    assert got[0] == got[1] == got[2] and got[0][0][0] == 300 and len(got[0][0][1]) >= 3


def test_passages_with_every_tenth_word_changed(spark):
    rng = random.Random(25)
    docs = []
    for n in range(30):
        w = prose(rng, 80).split()
        docs += [prose(rng, 30) + " " + " ".join(w), " ".join(x if i % 10 != n % 10 else f"new{n}x{i}" for i, x in enumerate(w)) + " " + prose(rng, 30)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_words) for r in passages.repeated_passages(d).collect()}
    assert set(got) == set(range(60)) and all(c == i // 2 * 2 and n >= 60 for i, (c, n) in got.items())


def test_seeds_of_a_hot_group_are_dealt_to_many_buckets():
    """Repetitions of a seed and what follows leave the bucket of the seed but for two a chunk; all rows are dealt, and met again."""
    rng = np.random.default_rng(24)
    texts = [np.concatenate([rng.integers(0, 2**63, 30), np.arange(40) + 9]).astype(np.uint64) for _ in range(300)]
    h, doc, pos = passages.minimizers(texts)
    s, ctx = h >> np.uint64(16), passages.following(h >> np.uint64(16), doc)
    rows, where = passages.dealt(s, ctx, doc, pos, np.zeros(0, np.uint64), 64, 5)
    assert (np.diff(where) >= 0).all() and set(rows.tolist()) == set(range(len(s)))
    hot = [x for x, c in zip(*np.unique(s, return_counts=True), strict=True) if c == 300]
    assert len(hot) > 5
    for x in hot:
        per = np.unique(where[s[rows] == x], return_counts=True)[1]
        assert len(per) >= 1 and (s[rows] == x).sum() <= 302
    packed = passages.unpacked(passages.packed(s, ctx, doc, pos))
    assert all((u == v).all() for u, v in zip(packed, (s, ctx, doc, pos), strict=True))
    x, y, p, q = passages.met(s, ctx, doc, pos)
    pairs = {(int(a), int(b)) for a, b in zip(x, y, strict=True)}
    assert len(pairs) <= 2 * len(s) and all(any((i, j) in pairs for j in (0, i - 1)) for i in range(1, 300))
    assert all((texts[a][i:i + 5] == texts[b][j:j + 5]).all() for a, b, i, j in zip(x.tolist(), y.tolist(), p.tolist(), q.tolist(), strict=True))


def test_minimizers_of_many_texts():
    rng = np.random.default_rng(28)
    texts = [rng.integers(0, 50, int(n)).astype(np.uint64) for n in (0, 3, 5, 7, 9, 40, 4, 100)]
    h, doc, pos = passages.minimizers(texts)
    got = list(zip(doc.tolist(), pos.tolist(), strict=True))
    want = []
    for i, t in enumerate(texts):
        own = passages.kmers(t).tolist()
        if not own:
            continue
        w = min(passages.WINDOW, len(own))
        want += [(i, p) for p in sorted({min(range(j, j + w), key=lambda q: (own[q], q)) for j in range(len(own) - w + 1)})]
    assert got == want and all(h[n] == passages.kmers(texts[i])[p] for n, (i, p) in enumerate(got))


def test_edit_distance():
    rng = random.Random(10)
    for _ in range(200):
        x, y = [rng.randrange(4) for _ in range(rng.randint(0, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        d = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            prev, d[0] = d[0], i
            for j, q in enumerate(y, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (p != q))
        assert passages.edit_distance(x, y) == d[-1]


def test_passages_edges(odd, empty):
    assert {r.doc_id for r in passages.repeated_passages(odd).collect()} <= {5, 6}
    assert passages.repeated_passages(empty).count() == 0


# PII ----------------------------------------------------------------------------------------------------

def plain_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_equals_patterns(spark, sf_dir):
    rng = random.Random(11)
    letters = "0123456789" * 3 + "..--  ++()@@aZ_%é"
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    assert [t for t in texts if pii.base_spans(t) != plain_spans(t)] == []


def test_pii_long_runs_are_linear():
    for t in ("a" * 300_000, "0" * 300_000, "a@" * 50_000, "1." * 100_000, "+1 " * 50_000, "1 " * 100_000):
        pii.base_spans(t)
        pii.candidates(t, [])


def test_pii_consistency(spark):
    rows = [(i, f"{prose(random.Random(i), 20)} call +1 (555) 010-{2000 + i} or mail u{i}@mail.example.com now") for i in range(60)]
    rows += [(100, "Call +1 (555) 010-7777 today. Again: 555 010 7777. Mail bob@corp.example.org or bob (at) corp (dot) example (dot) org."), (101, "Order 555 010 7777 and 4111111111111112 alone.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(d, pii.fit(d)).collect()}
    spans = got[100].spans.split(",")
    assert len(spans) == 4 and got[100].n_phone == 1 and got[100].n_email == 1
    text = dict(rows)[100]
    assert {text[int(s.split(":")[1]):int(s.split(":")[2])] for s in spans} >= {"555 010 7777", "bob (at) corp (dot) example (dot) org"}
    assert got[101].spans == "" and all(got[i].spans.count(":") == 4 for i in range(60))
    red = {r.doc_id: r.text for r in pii.redact(d, pii.fit(d)).collect()}
    assert red[100] == "Call <PHONE> today. Again: <PHONE>. Mail <EMAIL> or <EMAIL>." and red[101] == dict(rows)[101]


def test_pii_messages_against_exact_marginals():
    rng = np.random.default_rng(31)
    for trial in range(60):
        n = int(rng.integers(1, 6))
        field = pii.Field(rng.normal(0, 0.6, (sum(pii.WIDTHS) + 1, pii.LABELS)), rng.normal(0, 0.5, (pii.LABELS, pii.LABELS)), np.zeros((3, pii.LABELS, pii.LABELS)))
        for k in range(3):
            m = rng.normal(0, 0.5, (pii.LABELS, pii.LABELS))
            field.skip[k] = m + m.T
        tree = trial % 2 == 0
        chain = [(i, i + 1) for i in range(n - 1)] if not tree else []
        skips = sorted({(int(rng.integers(0, j)), j, int(rng.integers(0, 3))) for j in range(1, n)}, key=str)
        if not tree:
            field.chain *= 0.4
            field.skip *= 0.4
        feats = [tuple(int(rng.integers(0, w)) for w in pii.WIDTHS) for _ in range(n)]
        known = [int(rng.integers(-1, pii.LABELS)) for _ in range(n)]
        logit = pii.one_hot(feats) @ field.weights
        want = np.zeros((n, pii.LABELS))
        for lab in itertools.product(range(pii.LABELS), repeat=n):
            if any(k >= 0 and k != y for k, y in zip(known, lab, strict=True)):
                continue
            e = sum(logit[i, y] for i, y in enumerate(lab) if known[i] < 0) + sum(field.chain[lab[i], lab[j]] for i, j in chain) + sum(field.skip[k][lab[i], lab[j]] for i, j, k in skips)
            for i, y in enumerate(lab):
                want[i, y] += np.exp(e)
        want /= want.sum(1, keepdims=True)
        got = field.posterior(feats, known, chain, skips)
        assert np.abs(got - want).max() < (1e-6 if tree else 0.08)


def test_pii_respelled_mentions_of_the_table(spark, sf_dir):
    """Mentions of the table in another spelling are found; the table's own texts, which hold decoys and no such spelling, get no span."""
    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet").select("doc_id", "text")
    field = pii.fit(docs)
    seen = [0, 0]
    for t in (r.text for r in docs.collect() if r.text):
        base = pii.base_spans(t)
        assert pii.added_spans(t, base, field) == []
        for k, s, e in base[:1]:
            m = t[s:e]
            new = {0: m.replace("@", " (at) ").replace(".", " [dot] "), 1: m.replace(".", "[.]"), 3: re.sub("[^0-9]+", "-", m[3:]).strip("-")}.get(k)
            if new:
                longer = f"{t} once more, {new} it is"
                found = [x for x in pii.added_spans(longer, pii.base_spans(longer), field) if x[1] >= len(t)]
                seen[0] += 1
                seen[1] += [(k, longer[a:b]) for k, a, b in found] == [(k, new)]
    assert seen[0] > 20 and seen[1] >= 0.9 * seen[0]


def test_pii_skip_weights_are_learned():
    """Where repeated mentions agree, equal mentions' weights rise above their prior; where near ones differ, theirs fall below it."""
    rng = random.Random(33)
    seen = {}
    for _ in range(300):
        card = "41111111" + "".join(rng.choice("0123456789") for _ in range(7))
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
        for x in pii.combinations_of(f"a {card} b {wrong} c {card} d {wrong} e"):
            seen[x] = seen.get(x, 0) + 1
    field = pii.Field.fit(sorted(seen.items()))
    gain = [field.skip[k][2, 2] + field.skip[k][4, 4] - 2 * field.skip[k][2, 4] for k in range(3)]
    assert gain[pii.EQUAL] > 2 * pii.SKIP_PRIOR[pii.EQUAL] and gain[pii.NEAR] < 0


def test_pii_edges(odd, empty):
    field = pii.fit(odd)
    got = pii.find(odd, field)
    assert got.count() == len(ODD) and {r.spans for r in got.collect()} == {""} and "score" in got.columns
    assert pii.find(empty, pii.fit(empty)).count() == 0 and pii.redact(odd, field).columns == odd.columns


# Embeddings -----------------------------------------------------------------------------------------------

def test_nn_descent(spark):
    rng = np.random.default_rng(12)
    x = [rng.standard_normal(24) for _ in range(250)]
    for size in (2, 3, 30, 60):
        c = rng.standard_normal(24)
        x += [c + rng.standard_normal(24) * (0.06 if size < 60 else 0.12) for _ in range(size)]
    x += [x[0]] * 4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in nn_descent.near_duplicates(d).collect()}
    m = np.array([np.float32(v) for v in x], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T >= 0.9
    np.fill_diagonal(s, False)
    true, found = int(s.sum()), sum(r.n_links for r in got.values())
    assert found <= true and found >= 0.9 * true and len(got) == len(rows)
    assert all(got[i].n_links <= s[i].sum() for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(1000, 1005))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert nn_descent.near_duplicates(d.where("vec_id < 0")).count() == 0 and nn_descent.near_duplicates(d.where("vec_id = 1000")).count() == 1


def vectors_by_force(x, threshold=0.9):
    """(links of each vector, least vector reachable)."""
    m = np.array([np.float32(v) for v in x], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T >= threshold
    np.fill_diagonal(s, False)
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(s, least[None], len(x)).min(1))
        if (new == least).all():
            return s.sum(1).tolist(), least.tolist()
        least = new


def test_nn_descent_and_its_audit_on_planted_groups(spark, monkeypatch):
    """Three thousand vectors with the settings in use: most links are found, none too many, and the audit says how many."""
    rng = np.random.default_rng(13)
    x = [rng.standard_normal(64) for _ in range(2600)]
    for _ in range(150):
        c = rng.standard_normal(64)
        x += [c + rng.standard_normal(64) * 0.22 for _ in range(rng.integers(2, 6))]
    audits, plain = [], nn_descent._audit
    monkeypatch.setattr(nn_descent, "_audit", lambda *a: audits.append(plain(*a)) or audits[-1])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in nn_descent.near_duplicates(d).collect()}
    counts, _ = vectors_by_force(x)
    true, found = sum(counts), sum(got.values())
    assert true > 600 and all(got[i] <= n for i, n in enumerate(counts)) and found >= 0.95 * true
    print(f"true links {true}, found {found}, recall {found / true:.3f}, audited {audits}")
    assert audits and abs(audits[-1] - found / true) <= 0.03


def test_nn_descent_every_length_is_searched(spark):
    rng = np.random.default_rng(41)
    x = [rng.standard_normal(16) for _ in range(40)]
    x += [x[k] + rng.standard_normal(16) * 0.05 for k in range(20)]
    y = [rng.standard_normal(5) for _ in range(6)]
    y += [y[0] * 2, y[1] + 1e-3, y[1]]
    rows = [(i, v.tolist()) for i, v in enumerate(x + y)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    (na, ca), (nb, cb) = vectors_by_force(x), vectors_by_force(y)
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(na + nb, ca + [60 + c for c in cb], strict=True))} and sum(nb) > 0


def test_nn_descent_poor_lists_end_exact_or_fail(spark, monkeypatch):
    """Lists of one neighbour without rounds find too little; the audit sees it, whatever the share of vectors with links."""
    rng = np.random.default_rng(42)
    x = [rng.standard_normal(8) for _ in range(1500)]
    for k in range(60):
        c = rng.standard_normal(8)
        x += [c + rng.standard_normal(8) * 0.16 for _ in range(4)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for name, value in (("LIST", 2), ("REVERSE", 1), ("ROUNDS", 0), ("PROJECTIONS", 1), ("GROWTHS", 0)):
        monkeypatch.setattr(nn_descent, name, value)
    monkeypatch.setattr(nn_descent.linked_vectors, "__defaults__", (0.9, 2, 0.95, 0, 7))
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(d).collect()}
    assert got == dict(enumerate(zip(*vectors_by_force(x), strict=True)))
    monkeypatch.setattr(nn_descent, "EXACT_ROWS", 100)
    with pytest.raises(RuntimeError, match="audited recall"):
        nn_descent.near_duplicates(d).collect()


@pytest.mark.parametrize("n", [1740, 10_000_000])
def test_nn_descent_ends_exact_at_any_size(spark, monkeypatch, n):
    """What lists do not find is compared in blocks; the number of vectors is no reason to refuse or to go another way."""
    rng = np.random.default_rng(43)
    x = [rng.standard_normal(8) for _ in range(30)]
    x += [x[k] + rng.standard_normal(8) * 0.1 for k in range(10)]
    e = [v / np.linalg.norm(v) for v in np.array([np.float32(v) for v in x], np.float64)]
    units = spark.createDataFrame([(i, 1, 8, bytearray(v.tobytes())) for i, v in enumerate(e)], "node long, weight long, d int, v binary")
    monkeypatch.setattr(nn_descent, "GROWTHS", 0)
    monkeypatch.setattr(nn_descent, "_audit", lambda *a: 0.0)
    monkeypatch.setattr(units, "count", lambda: n)
    _, counts = nn_descent.linked_vectors(units)
    assert {r.node: r.n_links for r in counts.collect()} == dict(enumerate(vectors_by_force(x)[0]))


# Toxicity --------------------------------------------------------------------------------------------------

def test_trees_and_isotonic():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((600, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > -0.5)).astype(float)
    t = toxicity.Trees(40).fit(x[:400], y[:400])
    assert ((t.margin(x[400:]) > 0) == y[400:]).mean() > 0.95
    xs, p = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1, 0, 1, 1]))
    assert (np.diff(p) >= 0).all() and (np.diff(xs) >= 0).all()


def test_toxicity_held_out(spark):
    rng = random.Random(14)
    bad = ["idiot", "scum", "worthless", "zorgling"]
    rows, labels = [], []
    for i in range(900):
        y = i % 6 == 0
        w = prose(rng, 40).split()
        for _ in range(3 * y):
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    d, q = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = toxicity.fit(d, q, allowed=toxicity.may_train(F.col("doc_id")), mined_words=0)
    model = toxicity.fit(d, q, allowed=toxicity.may_train(F.col("doc_id")))
    assert "zorgling" in model.mined and not plain.mined
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert len(got) == 900 and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.7) == bool(labels[i][1]) for i in held)
    assert right / len(held) > 0.97
    kept = {r.doc_id for r in toxicity.reject_toxic(d, q).collect()}
    assert sum(i % 6 == 0 for i in kept) < 15 and sum(i % 6 != 0 for i in kept) == 750


def test_toxicity_folds_do_not_see_their_labels(spark, monkeypatch):
    """A word of one toxic document each tells nothing: held-out margins stay low, so no text is scored high by it."""
    rng = random.Random(34)
    rows, labels = [], []
    for i in range(600):
        y = i % 5 == 0
        rows.append((i, prose(rng, 30) + (f" mark{i // 40}" if y else "")))
        labels.append((i, int(y)))
    d, q = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    real = toxicity.Model.__init__

    def spy(self, mined, x, y, fold, held):
        seen.append((x, y, fold, held))
        real(self, mined, x, y, fold, held)

    monkeypatch.setattr(toxicity.Model, "__init__", spy)
    toxicity.fit(d, q, least_z=2.0)
    x, y, fold, held = seen[0]
    assert sorted(set(fold.tolist())) == list(range(toxicity.FOLDS)) and len(held) == toxicity.FOLDS
    assert any((held[k] != x).any() for k in range(toxicity.FOLDS))


def test_features_against_plain():
    f = toxicity.Features({"zorg": 2.0, "zorgl-": 1.5}, {})
    names = [*toxicity.NAMES, *toxicity.MINED_NAMES, *(f"{n}2" for n in toxicity.MINED_NAMES)]
    got = dict(zip(names, f.row("YOU are an idiot, you id!ot!! zorgling zorg?\nSooo stupiiid"), strict=True))
    words = "YOU are an idiot, you id!ot!! zorgling zorg? Sooo stupiiid".split()
    assert got["lex_count"] == 3 and got["lex_density"] == 3 / len(words) and got["obfuscated_count"] == 2
    assert got["second_density"] == 2 / len(words) and got["second_near"] == 3 and got["second_distance"] == 1
    assert got["exclaims"] == 3 / len(words) and got["questions"] == 1 / len(words) and got["caps_words"] == 1 / len(words)
    assert got["mined_count"] == 2 and got["mined_weight"] == 3.5 and got["mined_max"] == 2.0 and got["mined_count2"] == 0
    assert f.row("") == [0.0] * len(names)


def test_trees_against_plain_walks():
    """Scores of the fitted trees, node by node and row by row."""
    rng = np.random.default_rng(35)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 5).astype(float)
    t = toxicity.Trees(12).fit(x, y)
    for row, got in zip(x, t.margin(x), strict=True):
        bins = [int((c < v).sum()) for c, v in zip(t.cuts, row, strict=True)]
        want = t.start
        for tree in t.trees:
            node = 0
            while node in tree["feature"]:
                node = 2 * node + 1 + (bins[tree["feature"][node]] > tree["cut"][node])
            want += tree["value"][node]
        assert abs(want - got) < 1e-9


def test_toxicity_edges(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    got = toxicity.score(odd, model)
    assert got.count() == len(ODD) and {r.score for r in got.collect()} == {0.0} and got.columns[-1] == "score"
    assert toxicity.score(empty, model).count() == 0 and toxicity.reject_toxic(odd, none).columns == odd.columns


# Decontamination --------------------------------------------------------------------------------------------

def test_decontamination_against_plain(spark):
    rng = random.Random(15)
    items = [(k, prose(rng, n)) for k, n in enumerate((7, 15, 23, 40, 59, 5))] + [(90, None), (91, "")]
    docs = []
    for i in range(80):
        w = prose(rng, 60).split()
        k, t = items[i % 6]
        p = t.split()
        for _ in range(i % 7):
            j, op = rng.randrange(len(p)), rng.randrange(3)
            p[j:j + 1] = [] if op == 0 else [f"new{rng.randrange(999)}"] if op == 1 else [p[j], f"new{rng.randrange(999)}"]
        docs.append((i, " ".join([*w[:25], *p, *w[25:]]).upper() if i % 2 else " ".join([*w[:25], *p, *w[25:]])))
    docs += [(200, None), (201, ""), (202, prose(rng, 300))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc, t in docs:
        w = decontam.words_of(t)
        for k, it in items:
            p = decontam.words_of(it)
            if not p:
                continue
            limit = int(0.15 * len(p))
            best = [0] * (len(w) + 1)
            for i, a in enumerate(p, 1):
                prev, best[0] = best[0], i
                for j, b in enumerate(w, 1):
                    prev, best[j] = best[j], min(best[j] + 1, best[j - 1] + 1, prev + (a != b))
            if min(best) <= limit:
                want.add((doc, k, min(best)))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(d, q).collect()}
    assert got == want and len(want) > 40
    assert got == {(r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(d, q, block_bytes=100, pass_blocks=2).collect()}
    kept = {r.doc_id for r in decontam.remove_leaking(d, q).collect()}
    assert kept == {i for i, _ in docs} - {x for x, *_ in want}


def test_decontamination_edges(spark, odd, empty):
    q = spark.createDataFrame([(1, "tie tie tie"), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.find_leaks(odd, q).collect()) == [5, 5]
    assert decontam.find_leaks(empty, q).count() == 0 and decontam.find_leaks(odd, q.where("item_id = 2")).count() == 0
    left = decontam.remove_leaking(odd, q)
    assert left.columns == odd.columns and left.count() == len(ODD) - 2 and any(r.doc_id is None for r in left.collect())


def test_arrow_texts_with_nulls():
    assert [len(s) for s in jaccard.shingle_sets(pa.array([None, "", "a b c d e f"], pa.string()))] == [0, 0, 2]
    assert [len(w) for w in passages.word_arrays(pa.array([" a  b ", None], pa.string()))] == [2, 0]
