"""Main text of web pages: a linear-chain conditional random field over leaf blocks of the DOM.

A page is cut into blocks: runs of text between block-level tags. Each block has binary features of its ancestors (tags,
and words of their class, id and role) and of its text (length, share of link text, closing punctuation). The chain has two
labels, main text and boilerplate. Elements that HTML doesn't list as blocks, unknown ones and metadata among them, are inline. Weights are trained by forward-backward gradients on labelled pages that this module
builds from page schemes (own invention, seeded), in numpy, at first use; decoding is by Viterbi. Features name no
language and no site. Parsing and decoding see one page at a time, so memory is that of the longest page.

Scripts, styles, templates, comments, form controls, page heads and titles, what browsers show only if they can't show media (in
canvas, iframe, video, audio), unseen parts of formulas and drawings (annotation, desc, defs, metadata, symbol), and elements
with the attribute hidden, aria-hidden=true or style display:none never become blocks; formulas, drawings' text and the
contents of noscript and object do. Character references are decoded; white space in a block becomes one space; blocks are
joined by one newline; nothing else is dropped or capped.

Defined results: null or empty html, or a page with no main block, gives an empty text of no characters; unclosed and
stray tags are read as browsers do in outline (a block start ends an open paragraph, what can't stand in a head ends it);
repeated pages each get their row; a null id or url stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import itertools
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowfeed.llm.common import map_batches

#: `annotation` to `symbol` are parts of formulas and drawings that aren't shown.
SKIPPED = set("script style template canvas iframe select textarea button head video audio title annotation annotation-xml desc defs metadata symbol".split())
RAW = {"script", "style", "textarea", "title", "iframe"}
#: Formulas, drawings, and what stands for scripts and objects: part of the text around them.
FOREIGN = set(
    "noscript object math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "svg g text tspan textpath path line rect circle ellipse polygon polyline use image switch".split()
)
#: Start tags that leave an open head open; any other one, and text, ends it.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head", "html"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What begins and ends blocks. All else is inline, names that HTML doesn't know and elements of metadata among it.
BLOCK = set(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav noframes ol "
    "optgroup option p plaintext pre search section summary table caption colgroup col tbody thead tfoot tr td th ul xmp".split()
)
#: A start tag of the key ends an open tag of these, up to a container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("html body div section article main aside header footer nav form table ul ol dl td th blockquote figure details fieldset dialog object".split())
#: End tags that close an open element beyond containers within it.
CLOSES = BLOCK | FOREIGN | SKIPPED
TAG = re.compile(r"<(?:[!?]|(/?)([A-Za-z][^\s/>]*))")
#: A quote that begins a value, or the end of a tag.
QUOTE_OR_END = re.compile(r"(=\s*)([\"'])|>")
RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
MAY_HIDE = re.compile(r"hidden|style", re.I)
NAME_VALUE = re.compile(r"([^\s\"'=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?|\"[^\"]*\"|'[^']*'")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([^;]*)", re.I)
CSS_COMMENT = re.compile(r"/\*.*?\*/", re.S)
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def is_hidden(attributes: str) -> bool:
    """Has an attribute hidden, aria-hidden=true, or a style whose display is none. Of attributes of one name the first counts."""
    if not MAY_HIDE.search(attributes):
        return False
    found: dict[str, str] = {}
    for m in NAME_VALUE.finditer(attributes):
        if m[1]:
            found.setdefault(m[1].lower(), html_lib.unescape((m[2] or "").strip("\"'")))
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    shown = ["".join(v.lower().split()) for v in DISPLAY.findall(CSS_COMMENT.sub("", found.get("style", "")))]
    shown = [v for v in shown if v.endswith("!important")] or shown
    return bool(shown) and shown[-1].removesuffix("!important") == "none"


#: Words in class, id or role that stand for kinds of page parts (fixed values). Words that parts of articles have, too, aren't among them: more, review, meta, top, search.
KINDS = {
    "advert": "ad ads adv advert advertisement advertising banner sponsor sponsored promo promoted promotion adsense dfp outbrain taboola",
    "comment": "comment comments commentlist disqus respond reply replies discussion reactions",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager skip topbar",
    "side": "sidebar side aside rail widget widgets related recommended recommendation popular trending",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription paywall signup login disclaimer toast",
    "share": "share sharing social follow tweet facebook buttons byline tags taglist",
    "foot": "footer foot copyright colophon contentinfo",
    "head": "header masthead logo branding",
    "form": "form searchbox login",
    "main": "article post entry content main story body text maincontent articlebody postbody prose markdown",
}
KIND_OF = {f".{w}": kind for kind, words in KINDS.items() for w in words.split()}
TAGS = set("article main section aside nav header footer form ul ol li dl table td th h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption div details summary dialog fieldset label address a menu center".split())


class Block:
    __slots__ = ("parts", "link", "path", "tag")

    def __init__(self, path: frozenset[str], tag: str) -> None:
        self.parts: list[str] = []
        self.link = 0
        self.path = path
        self.tag = tag

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


class Tokens:
    """Tags of a page from left to right. Each character is looked at a bounded number of times, whatever is left open."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" or "", name, attributes) of the next tag, with an empty name for comments and declarations."""
        page = self.page
        while at <= self.last["<"]:
            start = page.find("<", at)
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, (len(page) if end < 0 else end + 3), "", "", ""
            m = TAG.match(page, start)
            if m is None:
                at = start + 1
                continue
            end = self.end(m.end())
            if end >= 0:
                return start, end + 1, m[1], m[2] or "", page[m.end() : end] if m[2] else ""
            return None
        return None

    def end(self, at: int) -> int:
        """The place of the > that ends a tag: not one in a quoted value. -1 if there is none."""
        page = self.page
        while at <= self.last[">"]:
            m = QUOTE_OR_END.search(page, at)
            if m[2] is None:
                return m.end() - 1
            # A quote that nothing closes is a character like others.
            at = page.find(m[2], m.end()) + 1 if m.end() <= self.last[m[2]] else m.end()
        return -1


class Open:
    """The open elements, with what is asked about them kept by name, so that no question walks through them."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.hidden: list[bool] = []
        self.paths: list[frozenset[str]] = []  # features of an element and all around it; equal sets are shared
        self.at: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.not_cells: list[int] = []
        self.blocks: list[int] = []
        self.skipped = self.links = 0

    def push(self, tag: str, names: set[str], hidden: bool) -> None:
        i, path = len(self.tags), self.paths[-1] if self.paths else frozenset()
        own = {f"in={n}" if n in TAGS else f"kind={KIND_OF[n]}" for n in names if n in TAGS or n in KIND_OF}
        self.paths.append(path if own <= path else path | own)
        self.tags.append(tag)
        self.hidden.append(hidden)
        self.at.setdefault(tag, []).append(i)
        if tag in CONTAINERS:
            self.containers.append(i)
            if tag not in ("td", "th"):
                self.not_cells.append(i)
        if tag in BLOCK:
            self.blocks.append(i)
        self.skipped += tag in SKIPPED or hidden
        self.links += tag == "a"

    def last(self, *tags: str) -> int:
        """The innermost element of the names, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, i: int) -> bool:
        """Closes element i and all in it; whether a block is among them."""
        block = False
        while len(self.tags) > i:
            tag, hidden = self.tags.pop(), self.hidden.pop()
            self.paths.pop()
            self.at[tag].pop()
            for kept in (self.containers, self.not_cells, self.blocks):
                if kept and kept[-1] == len(self.tags):
                    kept.pop()
            self.skipped -= tag in SKIPPED or hidden
            self.links -= tag == "a"
            block |= tag in BLOCK
        return block


def blocks(page: str | None) -> list[tuple[str, float, frozenset[str], str]]:
    """(text, share of link text, features of the ancestors, block tag) of each leaf block, in page order. Linear in the page."""
    if not page:
        return []
    stack, tokens, out = Open(), Tokens(page), []
    now: Block | None = None

    def close(i: int) -> None:
        nonlocal now
        if stack.close(i):
            now = None

    def end_head() -> None:
        """Closes a head that nothing but noscript is open in."""
        i = stack.last("head")
        if i >= 0 and all(t == "noscript" for t in itertools.islice(stack.tags, i + 1, None)):
            close(i)

    def text(s: str) -> None:
        nonlocal now
        if stack.skipped and s.strip():
            end_head()
        if stack.skipped or not s:
            return
        if now is None:
            if not s.strip():
                return
            now = Block(stack.paths[-1] if stack.paths else frozenset(), stack.tags[stack.blocks[-1]] if stack.blocks else "body")
            out.append(now)
        s = html_lib.unescape(s) if "&" in s else s
        now.parts.append(s)
        if stack.links:
            now.link += len(s.strip())

    at = 0
    while at < len(page):
        token = tokens.next(at)
        if token is None:
            text(page[at:])
            break
        start, end, slash, tag, attributes = token
        text(page[at:start])
        at, tag = end, tag.lower()
        if not tag:
            continue
        if slash:
            i = stack.last(tag)
            if i >= 0 and not (tag not in CLOSES and stack.containers and stack.containers[-1] > i):
                close(i)
            if tag in BLOCK:
                now = None
            continue
        if stack.skipped and tag not in IN_HEAD:
            end_head()
        if tag == "head" and len(stack.tags) > len(stack.at.get("html", ())):
            continue
        if tag in VOID:
            if tag == "br":
                text(" " if now else "")
            elif tag in BLOCK:
                now = None
            continue
        if tag in RAW:
            stop = RAW_END[tag].search(page, at)
            at = stop.start() if stop else len(page)
        if tag in BLOCK:
            now = None
            # A block start ends an open paragraph, some end an open one of their kind, up to a container.
            ends = ENDS.get(tag, ())
            barrier = (stack.not_cells if ends else stack.containers)[-1:]
            i = stack.last(*ends)
            i = i if i > (barrier or [-1])[0] else stack.last("p")
            if i > (barrier or [-1])[0]:
                close(i)
        names, hidden = {tag}, False
        if attributes:
            names |= {f".{w}" for value in ATTRIBUTE.findall(attributes) for w in NAME.findall(value.lower())}
            if attributes.rstrip().endswith("/") and tag not in CONTAINERS and tag not in ("p", "a", "b"):
                continue
            hidden = tag != "head" and is_hidden(attributes)
        if tag == "text" and not hidden:
            text(" " if now else "")
        stack.push(tag, names, hidden)
    found = []
    for b in out:
        if t := b.text():
            found.append((t, min(1.0, b.link / len(t)), b.path, b.tag))
    return found


@lru_cache(4096)
def _path_features(path: frozenset[str], tag: str) -> tuple[str, ...]:
    out = {f"block={tag if tag in TAGS else 'other'}", *path}
    if not out & {"in=article", "in=main", "kind=main"}:
        out.add("outside")
    return tuple(sorted(out))


def features(text: str, link: float, path: frozenset[str], tag: str) -> list[str]:
    size = len(text)
    out = [*_path_features(path, tag), "size=" + ("0" if size < 15 else "1" if size < 40 else "2" if size < 100 else "3" if size < 300 else "4")]
    out.append("link=" + ("0" if link < 0.1 else "1" if link < 0.5 else "2"))
    if text[-1] in ".!?…。！？:;\"'”’)":
        out.append("closed")
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    return out


class Crf:
    """Two labels (1: main text); binary features; weights by averaged gradient steps on the log likelihood."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, page: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.w[[i for f in fs if (i := get(f)) is not None]].sum(0) for fs in page])

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> Crf:
        self.index = {f: i for i, f in enumerate(sorted({f for p, _ in pages for fs in p for f in fs}))}
        self.w = np.zeros((len(self.index), 2))
        ids = [[[self.index[f] for f in fs] for fs in p] for p, _ in pages]
        sums = [np.full_like(x, 1e-8) for x in (self.w, self.trans, self.start)]
        for _ in range(rounds):
            grads = [np.zeros_like(x) for x in (self.w, self.trans, self.start)]
            for page, (_, labels) in zip(ids, pages, strict=True):
                score = np.array([self.w[i].sum(0) for i in page])
                n = len(page)
                alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
                alpha[0] = self.start + score[0]
                for t in range(1, n):
                    alpha[t] = score[t] + np.logaddexp(alpha[t - 1][0] + self.trans[0], alpha[t - 1][1] + self.trans[1])
                for t in range(n - 2, -1, -1):
                    v = score[t + 1] + beta[t + 1]
                    beta[t] = np.logaddexp(self.trans[:, 0] + v[0], self.trans[:, 1] + v[1])
                z = np.logaddexp(*alpha[-1])
                p = np.exp(alpha + beta - z)
                y = np.eye(2)[labels]
                for t in range(n):
                    grads[0][page[t]] += y[t] - p[t]
                grads[2] += y[0] - p[0]
                for t in range(1, n):
                    pair = np.exp(alpha[t - 1][:, None] + self.trans + (score[t] + beta[t])[None, :] - z)
                    grads[1] += np.outer(y[t - 1], y[t]) - pair
            for x, g, s in zip((self.w, self.trans, self.start), grads, sums, strict=True):
                g = g / len(pages) - decay * x
                s += g * g
                x += rate * g / np.sqrt(s)
        return self

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        score = self.scores(page)
        best, back = (self.start + score[0]).tolist(), []
        t00, t01, t10, t11 = self.trans.ravel().tolist()
        for s0, s1 in score[1:].tolist():
            a, b, c, d = best[0] + t00, best[1] + t10, best[0] + t01, best[1] + t11
            back.append((int(b > a), int(d > c)))
            best = [max(a, b) + s0, max(c, d) + s1]
        out = [int(best[1] > best[0])]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages built from schemes, with the label of each leaf block. Text is of random letters: only form can be learned."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("abcdefghijklmnoprstuvwäéñ") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 4, b: int = 30) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "?", "!", ""])

    def links(tag: str, k: int) -> tuple[str, list[int]]:
        items = [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(k)]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", [0] * k
        return f"<div>{' | '.join(items)}</div>", [0]

    def junk(kind: str) -> tuple[str, list[int]]:
        text = f"<p>{sentence()}</p>"
        name = r.choice(KINDS[kind].split())
        tag = {"menu": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form"}.get(kind, "div")
        if tag == "div" or r.random() < 0.4:
            tag = r.choice(["div", "div", "section"])
        attr = "" if tag not in ("div", "section") and r.random() < 0.5 else f' {r.choice(["class", "id"])}="{name}"'
        if kind == "menu":
            inner, y = links(r.choice(["ul", "div"]), r.randint(2, 8))
        elif kind == "side":
            a, y = links("ul", r.randint(1, 5))
            inner, y = f"<h3>{words(1, 3)}</h3>{a}" + (text if r.random() < 0.5 else ""), [0, *y]
            y += [0] if inner.endswith("</p>") else []
        elif kind == "foot":
            inner, y = f"{r.choice(['&copy; ', '© ', ''])}{words(1, 4)} {r.choice(['&middot; ', ''])}{sentence(2, 8)}", [0]
        elif kind == "comment":
            k = r.randint(1, 4)
            inner = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(sentence(5, 40)) for _ in range(k))
            y = [0] * k
        elif kind == "form":
            inner, y = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button>', [0]
        else:
            inner, y = (text, [0]) if r.random() < 0.5 else (sentence(), [0])
        return f"<{tag}{attr}>{inner}</{tag}>", y

    def article() -> tuple[str, list[int]]:
        parts, y = [], []
        for k in range(r.randint(1, 9)):
            kind = r.random()
            if k == 0 and r.random() < 0.8:
                parts.append(f"<h1>{sentence(2, 12)}</h1>")
            elif kind < 0.62:
                inline = r.random()
                text = sentence(3, 80)
                text = f"<b>{text}" if inline < 0.1 else f'{text} <a href="#">{words(1, 3)}</a> {sentence()}' if inline < 0.25 else text
                parts.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else "<br>"))
            elif kind < 0.72:
                parts.append(f"<h2>{words(1, 8)}</h2>")
            elif kind < 0.8:
                items = [f"<li>{sentence(2, 15)}</li>" for _ in range(r.randint(1, 4))]
                parts.append(f"<ul>{''.join(items)}</ul>")
                y += [1] * (len(items) - 1)
            elif kind < 0.86:
                parts.append(f"<blockquote>{sentence()}</blockquote>")
            elif kind < 0.88:
                parts.append(f"<pre>{words(2, 20)}</pre>")
            elif kind < 0.9:
                parts.append(f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>")
                y.append(1)
            else:
                a, z = junk(r.choice(["advert", "share", "side", "notice", "comment", "form"]))
                parts.append(a)
                y += z
                continue
            y.append(1)
        return "".join(parts), y

    pages = []
    for _ in range(n):
        body, y = article()
        form = r.random()
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):  # wrappers without a meaning
            tag = r.choice(["div", "div", "section"])
            body = f'<{tag}{r.choice(["", f" class={words(1, 1)}"])}>{body}</{tag}>'
        if form < 0.45:
            body = f"<article>{body}</article>"
        elif form < 0.6:
            body = f"<main><article>{body}</article></main>"
        elif form < 0.7:
            body = f"<main>{body}</main>"
        elif form > 0.88:
            pass  # nothing around the article's blocks
        else:
            body = f'<div class="{r.choice(KINDS["main"].split())}">{body}</div>'
        before = [junk(k) for k in ("menu", "head", "notice", "advert", "form", "side") if r.random() < 0.45]
        after = [junk(k) for k in ("share", "comment", "advert", "side", "foot", "notice") if r.random() < 0.5]
        parts = [*before, (body, y), *after]
        pages.append((f"<html><head><title>{words(1, 4)}</title></head><body>" + "".join(p for p, _ in parts) + "</body></html>", [x for _, z in parts for x in z]))
    return pages


@lru_cache(1)
def model() -> Crf:
    """The trained field; a pure function of the code, so that every worker has the same."""
    pages = []
    for page, labels in labelled_pages():
        found = [features(*b) for b in blocks(page)]
        if len(found) != len(labels):
            raise AssertionError(f"{len(found)} blocks, {len(labels)} labels: {page}")
        if found:
            pages.append((found, labels))
    return Crf().train(pages)


def extract(page: str | None, crf: Crf) -> str:
    found = blocks(page)
    if not found:
        return ""
    labels = crf.decode([features(*b) for b in found])
    return "\n".join(b[0] for b, y in zip(found, labels, strict=True) if y)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars. The model (some hundred weights) goes with the task."""
    crf = model()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = pa.array((extract(p.as_py(), crf) for p in batch.column(2)), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    read = pages.select("page_id", "url", "html")
    out = map_batches(read, run, f"page_id {read.schema['page_id'].dataType.simpleString()}, url string, text string")
    return out.select("*", F.length("text").cast("bigint").alias("n_chars"))
