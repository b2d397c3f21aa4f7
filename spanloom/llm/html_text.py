"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree (operator 4).

The trees are fitted on pages that a seeded generator lays out in many ways (the true text is known there); they
predict whether a node's subtree holds main text. Decoding takes the likeliest labelling in which nothing under a
rejected node is kept, so that ancestors and descendants never contradict each other.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import slices, table, tidy

#: Generated training pages, trees, their depth, learning rate, bins of a feature.
PAGES, TREES, DEPTH, RATE, BINS = 700, 50, 4, 0.2, 32

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(script|style|textarea|iframe)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:/>|>.*?(?:</\1\s*>|$))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTROLS = frozenset("input button label option".split())
#: Inline elements that are nodes even without attributes, so that the trees decide about their text.
EMBEDDED = frozenset("svg math object select template noscript".split())
ENDS_P = BLOCK - {"td", "th", "tr", "option", "html", "head", "body", "tbody", "thead", "tfoot"}
#: Start tags that end an open element, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
MARK = ""


@dataclass
class Page:
    """Elements that can be told apart (block level, or with attribute tokens) and the pieces of text under them."""

    tag: list = field(default_factory=lambda: ["#root"])
    parent: list = field(default_factory=lambda: [-1])
    tokens: list = field(default_factory=lambda: [()])
    controls: list = field(default_factory=lambda: [0])
    node: list = field(default_factory=list)  # of each piece
    text: list = field(default_factory=list)
    block: list = field(default_factory=list)
    linked: list = field(default_factory=list)


def parse(source: str) -> Page:
    page, at, block = Page(), 0, 0
    stack: list[tuple[str, int]] = [("#root", 0)]  # tag, node
    links = 0

    def close_to(k: int) -> None:
        nonlocal links, block
        for tag, _ in stack[k:]:
            links -= tag == "a"
            block += tag in BLOCK
        del stack[k:]

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            page.node.append(stack[-1][1])
            page.text.append(html.unescape(piece) if "&" in piece else piece)
            page.block.append(block)
            page.linked.append(links > 0)
        elif piece and page.text and page.block[-1] == block:
            page.text[-1] += " "

    for m in TOKEN.finditer(source):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close_to(k)
                    break
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] in ("td", "th", "table", "button"):
                    break
        if name in ENDS:
            found, stop = ENDS[name]
            hit = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in found:
                    hit = k
                elif stack[k][0] in stop:
                    break
            if hit:
                close_to(hit)
        if name == "br" and page.text and page.block[-1] == block:
            page.text[-1] += " "
        block += name in BLOCK
        tokens: tuple = ()
        if m[4] and not m[4].isspace():
            seen = []
            for a in ATTRIBUTE.finditer(m[4]):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key == "hidden" or key == "style" and "none" in value.replace(" ", ""):
                    seen.append("hidden")
                elif key != "style":
                    seen += [w.lower() for w in WORD.findall(value)]
            tokens = tuple(seen)
        node = stack[-1][1]
        if name in CONTROLS:
            page.controls[node] += 1
        if name in VOID:
            continue
        if name in BLOCK or tokens or name in CONTROLS or name in EMBEDDED:
            node = len(page.tag)
            page.tag.append(name)
            page.parent.append(stack[-1][1])
            page.tokens.append(tokens)
            page.controls.append(0)
        if not m[4].rstrip().endswith("/") or name in BLOCK:
            stack.append((name, node))
            links += name == "a"
    if at < len(source):
        text(source[at:])
    return page


FEATURES = 26


def features(page: Page, odds: tuple[dict, dict]) -> np.ndarray:
    """A row a node; ``odds`` are the log odds of tags and of attribute tokens."""
    n = len(page.tag)
    tag_odds, token_odds = odds
    x = np.zeros((n, FEATURES), np.float32)
    direct, linked, marks, stops, start = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    total = 0
    for k, t, a in zip(page.node, page.text, page.linked, strict=True):
        size = len(t)
        direct[k] += size
        linked[k] += size if a else 0
        stops[k] += t.count(". ") + t.count(".")
        marks[k] += t.count(",") + ("©" in t) * 100
        if start[k] < 0:
            start[k] = total
        total += size
    text, link, dots, commas, controls = direct[:], linked[:], stops[:], marks[:], page.controls[:]
    nodes, paragraphs, headings, children = [1] * n, [t == "p" for t in page.tag], [t in ("h1", "h2", "h3") for t in page.tag], [0] * n
    items = [t == "li" for t in page.tag]
    parent, order = page.parent, [0] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        text[p] += text[k]
        link[p] += link[k]
        dots[p] += dots[k]
        commas[p] += commas[k]
        controls[p] += controls[k]
        nodes[p] += nodes[k]
        paragraphs[p] += paragraphs[k]
        headings[p] += headings[k]
        items[p] += items[k]
        if start[k] >= 0 and (start[p] < 0 or start[k] < start[p]):
            start[p] = start[k]
    same: dict = {}
    previous = [0] * n
    following = [0] * n
    last: dict = {}
    for k in range(1, n):
        p = parent[k]
        order[k] = children[p]
        children[p] += 1
        same[p, page.tag[k]] = same.get((p, page.tag[k]), 0) + 1
        if p in last:
            previous[k] = text[last[p]]
            following[last[p]] = text[k]
        last[p] = k
    whole = max(1, total)
    own = [(0.0,) * 5] * n
    depth = [0] * n
    up_tag, up_low, up_high = [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        got = [token_odds[t] for t in page.tokens[k] if t in token_odds]
        low, high, t = min(got, default=0.0), max(got, default=0.0), tag_odds.get(page.tag[k], 0.0)
        up_tag[k], up_low[k], up_high[k] = min(up_tag[p], t), min(up_low[p], low), max(up_high[p], high)
        own[k] = (t, low, high, len(got), len(page.tokens[k]))
    x[:, 0:5] = own
    for j, v in enumerate((up_tag, up_low, up_high, depth, order, [children[max(0, p)] for p in parent], [same.get((p, t), 0) for p, t in zip(parent, page.tag, strict=True)], text, direct, link, nodes, paragraphs, headings, items, controls, dots, commas, start, children, previous, following), 5):
        x[:, j] = v
    size = np.maximum(1, x[:, 12])
    x[:, 14] /= size  # share of linked text
    x[:, 15] /= size  # tags a character
    x[:, 20] /= size
    x[:, 21] /= size
    x[:, 22] /= whole
    for j in (12, 13, 24, 25):
        x[:, j] = np.log1p(x[:, j])
    return x


# --- training pages --------------------------------------------------------------------------------------------

GOOD = "content article post entry body main story text page single copy prose read".split()
#: kind -> (tags, attribute words)
BAD = {
    "menu": (["nav", "div", "ul"], "nav menu navbar navigation topnav links breadcrumb breadcrumbs pagination pager tabs toolbar".split()),
    "head": (["header", "div"], "header masthead branding logo site top banner".split()),
    "foot": (["footer", "div"], "footer foot bottom colophon copyright legal".split()),
    "side": (["aside", "div", "section"], "sidebar side aside widget related recommended trending popular rail more".split()),
    "note": (["div", "section", "p", "aside"], "notice cookie cookies consent alert banner warning newsletter subscribe signup popup modal overlay promo paywall gdpr message hidden".split()),
    "advert": (["div", "aside", "section", "p"], "ad ads advert advertisement adsbygoogle sponsor sponsored promoted banner adbox".split()),
    "form": (["form", "div"], "form search login contact subscribe comment register".split()),
    "comment": (["section", "div", "ol", "ul"], "comments comment discussion responses replies reply disqus thread respond reader".split()),
    "share": (["div", "ul"], "share social sharing tags meta byline author toolbar follow".split()),
}


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(("ka", "lo", "mi", "ten", "ra", "sou", "vi", "der", "ost", "ing", "é")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for k in range(len(out)):
            if r.random() < 0.12:
                out[k] += r.choice(".,.,;")
        return " ".join(out).capitalize() + ("." if r.random() < 0.8 else "")

    def attr(self, words: list[str]) -> str:
        r, v = self.r, self.r.choice(words)
        roll = r.random()
        v = v if roll < 0.5 else f"{r.choice(('site', 'page', 'js', 'block', 'c'))}-{v}" if roll < 0.75 else f"{v}-{r.choice(('wrap', 'box', 'area', 'inner', '1', 'container'))}"
        return f' {r.choice(("class", "class", "id"))}="{v}"'

    def main(self, kinds: float) -> str:
        """Blocks of main text with some boilerplate among them; main text starts with MARK."""
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{MARK}{self.words(3, 12)}</h1>")
        for _ in range(r.randint(1, 14)):
            roll = r.random()
            if roll < 0.72:
                body = MARK + self.words(1, r.choice((3, 20, 90, 200)))
                if r.random() < 0.2:
                    body += f' <a href="#">{self.words(1, 3)}</a> ' + self.words(1, 20)
                if r.random() < 0.15:
                    body = f"<b>{body}<br>"
                out.append(f"<p>{body}" + ("</p>" if r.random() < 0.8 else ""))
            elif roll < 0.79:
                out.append(f"<h{r.randint(2, 4)}>{MARK}{self.words(1, 8)}</h2>")
            elif roll < 0.85:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.words(1, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif roll < 0.89:
                out.append(f"<blockquote>{MARK}{self.words(4, 40)}</blockquote>")
            elif roll < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif roll < 0.94:
                out.append(f"<div>{MARK}{self.words(3, 60)}</div>")
            elif roll < 0.94 + kinds:
                out.append(self.bad(r.choice(("advert", "side", "share", "note", "form", "comment"))))
        return "".join(out)

    def bad(self, kind: str) -> str:
        r = self.r
        tags, words = BAD[kind]
        tag = r.choice(tags)
        attr = self.attr(words) if tag in ("div", "p", "section", "ul", "ol") or r.random() < 0.4 else ""
        if kind in ("menu", "share") or kind == "side" and r.random() < 0.5:
            items = [f'<a href="/">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 9))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if tag != "ul" and r.random() < 0.6 else "".join(f"<li>{x}</li>" if tag == "ul" else x for x in items)
        elif kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input type="text"><button>{self.words(1, 2)}</button>' + (f"<p>{self.words(3, 15)}</p>" if r.random() < 0.5 else "")
        elif kind == "comment":
            inner = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.6)
            for _ in range(r.randint(1, 6)):
                item = f"<p>{self.words(2, 80)}</p>"
                inner += f"<li{self.attr(words)}>{item}</li>" if tag in ("ol", "ul") else f"<div{self.attr(words)}>{self.words(1, 2)} {item}</div>" if r.random() < 0.7 else item
        elif kind == "head":
            inner = r.choice((f'<a href="/">{self.words(1, 3)}</a>', f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 9)}</p>")) + (self.bad("menu") if r.random() < 0.3 else "")
        elif kind == "foot":
            inner = f"&copy; {self.words(1, 5)} &middot; {self.words(2, 25)}" if r.random() < 0.5 else f"<p>{self.words(2, 30)}</p>" + (self.bad("menu") if r.random() < 0.3 else "")
        elif kind == "side":
            inner = f"<h3>{self.words(1, 4)}</h3>" + "".join(f"<p>{self.words(3, 50)}</p>" for _ in range(r.randint(1, 3)))
        else:
            inner = self.words(2, 45) if tag == "p" or r.random() < 0.5 else f"<p>{self.words(2, 60)}</p>"
        return f"<{tag}{attr}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        roll = r.random()
        tag = "article" if roll < 0.45 else "main" if roll < 0.6 else "section" if roll < 0.65 else "div"
        attr = self.attr(GOOD) if tag in ("div", "section") and r.random() < 0.85 or r.random() < 0.3 else ""
        body = f"<{tag}{attr}>{self.main(0.06)}</{tag}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<div{self.attr([*GOOD, 'wrapper', 'container', 'row', 'col']) if r.random() < 0.6 else ''}>{body}{self.bad(r.choice(('side', 'comment', 'share', 'note'))) if r.random() < 0.4 else ''}</div>"
        above = [self.bad(k) for k in ("head", "menu", "note", "advert", "form", "share") if r.random() < 0.45]
        below = [self.bad(k) for k in ("comment", "side", "advert", "form", "note", "menu") if r.random() < 0.35]
        below += [self.bad("foot")] * (r.random() < 0.85)
        r.shuffle(above)
        head = f"<head><title>{self.words(2, 9)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(above)}{body}{''.join(below)}</body></html>"


# --- trees -------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    odds: tuple[dict, dict]
    feature: np.ndarray  # trees x (2**DEPTH - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**DEPTH
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds that a node's subtree holds main text."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Histogram gradient boosting of the logistic loss with complete trees."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    base = float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
    score, out = np.full(n, base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, cut, split_bin = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.full(2**DEPTH - 1, BINS)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            for j in range(m):
                if not len(edges[j]):
                    continue
                slot = (at - first) * BINS + bins[:, j]
                gs = np.bincount(slot, g, wide * BINS).reshape(wide, BINS).cumsum(axis=1)
                hs = np.bincount(slot, h, wide * BINS).reshape(wide, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = np.where((hs > 2) & (ht - hs > 2), gain, 0)[:, : len(edges[j])]
                k = gain.argmax(axis=1)
                v = gain[np.arange(wide), k]
                for q in np.flatnonzero(v > best):
                    best[q], feature[first + q], cut[first + q], split_bin[first + q] = v[q], j, edges[j][k[q]], k[q]
            at = 2 * at + 1 + (bins[np.arange(n), feature[at]] > split_bin[at])
        last = at - (2**DEPTH - 1)
        leaf = -RATE * np.bincount(last, g, 2**DEPTH) / (np.bincount(last, h, 2**DEPTH) + 1)
        score += leaf[last]
        for o, v in zip(out, (feature, cut, leaf), strict=True):
            o.append(v)
    return *(np.asarray(v) for v in out), base


@lru_cache(1)
def model(pages: int = PAGES, seed: int = 11) -> Trees:
    """Fitted trees; the same for every corpus."""
    parsed, labels = [], []
    tags: dict = {}
    words: dict = {}
    for k in range(pages):
        page = parse(Writer(seed * 100_003 + k).page())
        keep = [False] * len(page.tag)
        for node, text in zip(page.node, page.text, strict=True):
            keep[node] |= MARK in text
        page.text = [t.replace(MARK, "") for t in page.text]
        for i in range(len(keep) - 1, 0, -1):
            keep[page.parent[i]] |= keep[i]
        for i in range(1, len(keep)):
            for into, names in ((tags, [page.tag[i]]), (words, page.tokens[i])):
                for name in names:
                    into.setdefault(name, [0.0, 0.0])[keep[i]] += 1
        parsed.append(page)
        labels += keep
    odds = tuple({w: float(np.log((b + 0.5) / (a + 0.5))) for w, (a, b) in t.items()} for t in (tags, words))
    x, y = np.concatenate([features(p, odds) for p in parsed]), np.asarray(labels, float)
    return Trees(odds, *boost(x, y, np.ones(len(y))))


def decode(page: Page, score: np.ndarray) -> list[bool]:
    """The likeliest labels in which every node under a rejected one is rejected."""
    n = len(page.tag)
    keep_gain = score.tolist()  # log odds: rejecting everything counts 0
    best = [0.0] * n
    total = keep_gain[:]
    for k in range(n - 1, 0, -1):
        best[k] = max(0.0, total[k])
        total[page.parent[k]] += best[k]
    kept = [True] * n
    for k in range(1, n):
        kept[k] = kept[page.parent[k]] and total[k] > 0
    return kept


def assemble(page: Page, kept: list[bool]) -> str:
    blocks, now, last = [], [], None
    for node, text, block in zip(page.node, page.text, page.block, strict=True):
        if block != last:
            if now and (s := " ".join("".join(now).split())):
                blocks.append(s)
            now, last = [], block
        if kept[node]:
            now.append(text)
    if now and (s := " ".join("".join(now).split())):
        blocks.append(s)
    return "\n".join(blocks)


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page; empty for null, empty and text-free ones."""
    pages = [parse(s) if s else None for s in sources]
    own = [p for p in pages if p is not None and p.text]
    if not own:
        return [""] * len(sources)
    scores = np.split(trees.score(np.concatenate([features(p, trees.odds) for p in own])), np.cumsum([len(p.tag) for p in own])[:-1])
    found = iter(scores)
    return [assemble(p, decode(p, next(found))) if p is not None and p.text else "" for p in pages]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of (page_id, url, html). Repeated rows give repeated results; other columns are not read."""
    held = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for whole in batches:
            for b in slices(whole, "html", 1 << 20):
                text = extract(b.column("html").to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text (empty if none, as for a null or empty page), n_chars."""
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
