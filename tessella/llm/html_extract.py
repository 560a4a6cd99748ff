"""Main-text extraction from HTML by tree scoring.

A page becomes a tree (implied end tags as browsers add them). Elements that are boilerplate by kind
are cut. Words of class and id only raise a doubt, which the tree settles: words of reader comments
cut; words of sidebars, notices and the like cut unless good words or a word of state ("with-sidebar",
"no-comments") stand beside them or the element holds the page's chief article; loose words ("share",
"related", "tags") cut what has no sentence or is dense with links; a form is cut unless it wraps
half of the page. Then each paragraph passes points, for its length and its commas, to its parent,
half of them to its grandparent and a falling share further up; a container's points are discounted
by its link density. The best container is kept, with those siblings that score well, are long,
link-poor paragraphs, or sentences in an element like it; inside an article or main element a sibling
only has to be poor in links, and so on up to that element. All blocks of what is kept stay, in page
order, but for lists of nothing but short links: character references decoded, white space inside a
block made one space, blocks joined by two \\n.

Defined cases: null, empty or textless pages give ""; cut-off pages are read as far as they come;
pages without a scoring paragraph fall back to article, main or body; equal scores go to the
container that comes first; repeated rows are read each; a page is read in time proportional to its
length; a column with the name of the text column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/[a-zA-Z]((?>[^\s/>]*))[^>]*(?:>|\Z)|([a-zA-Z](?>[^\s/>]*))((?>(?:[^>"'=]|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+))(?:>|\Z))""", re.S)
END = re.compile(r"</([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element kinds and words of class and id names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
CUT = set("script style noscript template iframe object embed svg math canvas audio video nav footer aside button select option textarea input label dialog menu head title noembed noframes xmp map".split())
BLOCK = set("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
BAD_WORDS = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs cookie cookies consent gdpr footer masthead menu menus modal nav navbar navigation newsletter notice notices alert pagination paywall popup promo promotion promoted sidebar sidebars sponsor sponsored sponsors subscribe subscription toolbar overlay".split())
COMMENT_WORDS = set("comment comments commentlist disqus respond reply replies".split())
LOOSE_WORDS = set("byline foot login pager recommended recommendations related share sharing shares side signup skip social tags tagcloud widget widgets".split())
STATE_WORDS = set("no not with without has hide hides is show shows".split())
STATE_AFTER = set("open opened closed enabled disabled status allowed free off".split())
GOOD_WORDS = set("article body content entry hentry main page post story text blog column".split())
PAGE_ONLY = {"header"}
BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
CONTAINERS = {"article": 25, "main": 20, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ol": -3, "ul": -3, "dl": -3, "table": -3, "body": 0, "li": -3, "th": -5, "form": -3}
MARKED = ("article", "main")
PARAGRAPH_CHARS = 25
SIBLING_SHARE = 0.2
LONG_PARAGRAPH = 80
CHIEF_SHARE = 0.4
SENTENCE = re.compile(r"[.!?。](?=[\s\"'”’»)]|$)")
#: Doubts that words and kinds raise, the greatest counts.
LOOSE, FORM, BAD, COMMENT = 1, 2, 3, 4


class Node:
    __slots__ = ("tag", "parent", "kids", "bad", "doubt", "name", "weight", "score", "chars", "links", "anchors", "order")

    def __init__(self, tag, parent, order):
        self.tag, self.parent, self.kids, self.order = tag, parent, [], order
        self.bad, self.doubt, self.name, self.weight, self.score, self.chars, self.links, self.anchors = False, 0, "", 0, None, 0, 0, 0


def _doubt(value: str) -> int:
    """The doubt that a class or id raises. A word beside one of state tells of what the element has or lacks, not of what it is."""
    out = 0
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        for before, w, after in zip([None, *words], words, [*words[1:], None], strict=False):
            if before not in STATE_WORDS and after not in STATE_AFTER:
                out = max(out, COMMENT if w in COMMENT_WORDS else BAD if w in BAD_WORDS else LOOSE if w in LOOSE_WORDS else 0)
    return out


def _judge(node: Node, attrs: str) -> None:
    """Whether the element is boilerplate by kind, the doubt about it, and its weight."""
    if node.tag in CUT:
        node.bad = True
        return
    if node.tag in ("form", "fieldset"):
        node.doubt = FORM
    if not attrs or not attrs.strip(" /\n\t"):
        return
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            doubt, good = _doubt(value), {w.lower() for w in WORDS.findall(value)} & GOOD_WORDS
            node.name = value if name == "class" else node.name
            if doubt == COMMENT and node.tag not in ("body", "html") or doubt and not good and node.tag not in ("body", "html", *MARKED):
                node.doubt = max(node.doubt, doubt)
            if good:
                node.weight += 25
        elif name == "role":
            if value.lower() in BAD_ROLES:
                node.doubt = max(node.doubt, FORM if value.lower() == "form" else BAD)
            node.weight += 25 * (value.lower() in MARKED)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.bad = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.bad = True


def parse(page: str) -> Node:
    root = Node("html", None, 0)
    at, open_, n, end = 0, [root], 1, len(page)
    p_open = 0  # how many p elements are open; saves looking for one
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            open_[-1].kids.append(page[at:])
            break
        m = TAG.match(page, lt)
        if m is None:  # a bare "<" is text
            nxt = page.find("<", lt + 1)
            nxt = end if nxt < 0 else nxt
            open_[-1].kids.append(page[at:nxt])
            at = nxt
            continue
        if lt > at:
            open_[-1].kids.append(page[at:lt])
        at = m.end()
        if m[2] is not None:
            tag = m[2].lower()
            if tag in ("html", "head", "body"):
                if tag == "body":
                    while len(open_) > 1 and any(x.tag == "head" for x in open_):
                        p_open -= open_.pop().tag == "p"
                if tag != "head":
                    continue
            if tag in CLOSES_P:
                if len(open_) > 1 and open_[-1].tag == "head":
                    open_.pop()
                if p_open:
                    k = next(i for i in range(len(open_) - 1, -1, -1) if open_[i].tag == "p")
                    if not any(x.tag in ("td", "th", "button", "caption") for x in open_[k + 1:]):
                        p_open -= sum(x.tag == "p" for x in open_[k:])
                        del open_[k:]
                if tag[0] == "h" and len(tag) == 2 and len(open_[-1].tag) == 2 and open_[-1].tag[0] == "h" and open_[-1].tag[1].isdigit() and tag[1].isdigit():
                    open_.pop()
            closes, stop = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)), "a": (("a",), ("table", "td", "th", "p", "li", "div"))}.get(tag, ((), ()))
            if closes:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag in stop:
                        break
                    if open_[i].tag in closes:
                        while i > 1 and open_[i - 1].tag in closes:
                            i -= 1
                        p_open -= sum(x.tag == "p" for x in open_[i:])
                        del open_[i:]
                        break
            node = Node(tag, open_[-1], n)
            n += 1
            _judge(node, m[3])
            if tag in PAGE_ONLY and not any(x.tag in ("article", "main", "section") for x in open_):
                node.bad = True
            open_[-1].kids.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else end
                if close:
                    gt = page.find(">", at)
                    at = end if gt < 0 else gt + 1
            elif tag not in VOID and not (tag in ("svg", "path") and m[3].rstrip().endswith("/")):
                open_.append(node)
                p_open += tag == "p"
        elif (e := END.match(page, lt)) is not None:
            tag = e[1].lower()
            if tag in ("html", "body"):
                continue
            if tag == "p" and not p_open:
                open_[-1].kids.append(Node("p", open_[-1], n))
                n += 1
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    p_open -= sum(x.tag == "p" for x in open_[i:])
                    del open_[i:]
                    break
                if tag not in BLOCK and open_[i].tag in BLOCK:  # a stray inline end tag does not end a block
                    break
    return root


def _ordered(root: Node) -> list[Node]:
    """The elements that are not cut, in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.bad)
    return order


def _measure(root: Node) -> list[Node]:
    """Characters, link characters and links of each element that is not cut; returns these in page order."""
    order = _ordered(root)
    for x in reversed(order):
        x.chars = x.links = x.anchors = 0
        for k in x.kids:
            if isinstance(k, str):
                x.chars += sum(map(len, k.split())) + k.count(" ")
            elif not k.bad:
                x.chars += k.chars
                x.links += k.chars if k.tag == "a" else k.links
                x.anchors += 1 if k.tag == "a" else k.anchors
    return order


def _has_sentence(x: Node, least: int = PARAGRAPH_CHARS) -> bool:
    """Whether a text inside is long enough for a paragraph and has the end of a sentence."""
    stack = [x]
    while stack:
        y = stack.pop()
        if (y is x or y.tag in BLOCK) and len(text := _own_text(y)) >= least and SENTENCE.search(text):
            return True
        stack.extend(k for k in y.kids if isinstance(k, Node) and not k.bad)
    return False


def _settle(root: Node) -> list[Node]:
    """Cut the elements whose doubt the tree confirms; returns what is left in page order, measured."""
    order = _measure(root)
    if not any(x.doubt for x in order):
        return order
    commented: set[Node] = set()
    for x in order:
        if x.doubt == COMMENT or x.parent in commented:
            commented.add(x)
    chief = max((x for x in order if x.tag in MARKED and x not in commented), key=lambda x: (x.chars - x.links, -x.order), default=None)
    above: set[Node] = set()
    if chief is not None and chief.chars - chief.links >= CHIEF_SHARE * (root.chars - root.links):
        while chief is not None:
            above.add(chief)
            chief = chief.parent
    had, told = _has_sentence(root), root.chars - root.links
    for x in order:
        if x.doubt == COMMENT:
            x.bad = True
        elif x.doubt == BAD:
            x.bad = x not in above
        elif x.doubt == FORM:
            x.bad = x not in above and 2 * (x.chars - x.links) < root.chars - root.links
        elif x.doubt == LOOSE:
            x.bad = x not in above and (_density(x) >= 0.3 or not _has_sentence(x))
    left = _measure(root)
    if had and 2 * (root.chars - root.links) < told and not _has_sentence(root, 1):
        # names that would leave the lesser part of the text, and no sentence in it, are wrong
        for x in order:
            x.bad = False
        left = _measure(root)
    return left


def _density(x: Node) -> float:
    return x.links / x.chars if x.chars else 0.0


def _own_text(x: Node) -> str:
    """The text of a paragraph: its own and that of its inline elements."""
    out, stack = [], [x]
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            out.append(y)
        elif y is x or (y.tag not in BLOCK and not y.bad):
            stack.extend(reversed(y.kids))
    return " ".join("".join(out).split())


def choose(root: Node, order: list[Node]) -> list[Node]:
    """The best container and the siblings that are kept with it, in page order."""
    scored = []
    for x in order:
        paragraph = x.tag in ("p", "pre", "td", "blockquote", "dd") or x.tag in ("div", "section", "article", "main", "li", "body", "html") and any(isinstance(k, str) and len(k) >= PARAGRAPH_CHARS and not k.isspace() for k in x.kids)
        if not paragraph or x.parent is None:
            continue
        text = _own_text(x)
        if len(text) < PARAGRAPH_CHARS:
            continue
        points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - min(1.0, _density(x)))
        up = x if x.tag in ("div", "section", "article", "main") else x.parent
        level = 0
        while up is not None and level < 5:
            if up.score is None:
                up.score = CONTAINERS.get(up.tag, 0) + up.weight
                scored.append(up)
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for x in order:  # a page whose article is short has no paragraph that scores in it
        if x.tag in MARKED and x.score is None and x.chars:
            x.score = CONTAINERS[x.tag] + x.weight
            scored.append(x)
    if not scored:
        return [root]
    final = {x: x.score * (1 - min(1.0, _density(x))) for x in scored}
    best = max(scored, key=lambda x: (final[x], -x.order))
    kept, top = [best], best
    while top.parent is not None:
        inside = _marked_above(top)
        kept += [k for k in top.parent.kids if isinstance(k, Node) and k is not top and not k.bad and (_density(k) < 0.5 if inside else _kept_beside(k, best, final))]
        if not inside:
            break
        top = top.parent
    return sorted(kept, key=lambda x: x.order)


def _marked_above(x: Node) -> bool:
    x = x.parent
    while x is not None and x.tag not in MARKED:
        x = x.parent
    return x is not None


def _kept_beside(k: Node, best: Node, final: dict[Node, float]) -> bool:
    """Whether a sibling of the best container, or of the article around it, belongs to the text."""
    if final.get(k, 0) >= max(10.0, SIBLING_SHARE * final[best]):
        return True
    dense = _density(k)
    if k.tag in ("p", "h1", "h2", "h3", "pre", "blockquote"):
        text = _own_text(k)
        return k.tag[0] == "h" or len(text) > LONG_PARAGRAPH and dense < 0.25 or bool(text) and dense == 0 and SENTENCE.search(text) is not None
    return k.tag == best.tag and k.name == best.name and dense < 0.25 and _has_sentence(k)


def _is_menu(x: Node) -> bool:
    """A list of nothing but short links."""
    return x.anchors >= 3 and x.tag in ("ul", "ol", "div", "section", "table") and x.links >= 0.9 * x.chars and x.links < 40 * x.anchors


def _between_paragraphs(x: Node) -> bool:
    """Whether paragraphs with a sentence stand before and after an element, in the same parent."""
    kids = [k for k in x.parent.kids if isinstance(k, Node) and not k.bad]
    at = kids.index(x)
    told = [k.tag in ("p", "blockquote", "pre") and SENTENCE.search(_own_text(k)) is not None for k in kids]
    return any(told[:at]) and any(told[at + 1:])


def blocks(nodes: list[Node]) -> list[str]:
    out, run = [], []

    def flush():
        if run:
            if text := " ".join("".join(run).split()):
                out.append(text)
            run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(html.unescape(x))  # a reference does not go on in the next element
        elif x.bad or x not in nodes and _is_menu(x) and not _between_paragraphs(x):
            continue
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack.extend(reversed(x.kids))
        else:
            stack.extend(reversed(x.kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return "\n\n".join(blocks(choose(root, _settle(root))))


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the main text of each page; `keep` names the columns that pass through (all by default)."""
    keep = [c for c in (df.columns if keep is None else keep) if c != text_col]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column(html_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), texts], names=[*keep, text_col])

    return df.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)
