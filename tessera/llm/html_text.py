"""Operator 5: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: text between the tags of block elements, with the elements it lies in. Features of a block are its
ancestors' tags and class words, its own tag, the share of its characters in links, its length, punctuation and a few marks.
A two-label chain (text or not) is fitted in numpy to labelled pages and decoded by Viterbi for the whole page.

The labelled pages come from labelled_pages(): page plans with menus, headers, notices, adverts, sidebars, forms, comments and
footers around and inside articles, each block with its label. Words are random, so that only structure and shape are learnt.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Fixed values of the HTML standard: elements whose content is not page text, elements without an end tag, elements inside a line.
RAW = ("script", "style", "template", "iframe", "textarea", "select", "head")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
MATH = ("math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics")
DRAWN = ("canvas", "circle", "defs", "ellipse", "g", "line", "object", "path", "picture", "polygon", "polyline", "rect", "svg", "text", "tspan", "use")
_RAW, _VOID, _INLINE = frozenset(RAW), frozenset(VOID), frozenset(INLINE + MATH + DRAWN)
_NAME, _STOP, _VALUE = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)"), re.compile("[>\"']"), re.compile(r"(?s).*=\s*$")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS, _SPACE = re.compile(r"[a-z]+"), re.compile(r"\s+")
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Raw elements that go on to the page's end where their end tag is missing; of others only the tag is left out.
_TO_END = frozenset(("script", "style", "textarea", "iframe"))


def next_tag(html: str, at: int, last: dict[str, int]) -> tuple[int, int, str, str, str] | None:
    """(begin, end, slash, name, attributes) of the first tag, comment or declaration (these without a name) from a place on.

    A quote after an equals sign opens a value, which may hold `>`; where it is never closed (last: where each quote is last), the tag ends at
    the next `>`. No place is read twice, so a page takes time in proportion to its length.
    """
    n = len(html)

    def after(mark: str, begin: int) -> int:
        found = html.find(mark, begin)
        return found + len(mark) if found >= 0 else n

    while (begin := html.find("<", at)) >= 0:
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if html.startswith(opening, begin):
                return begin, after(closing, begin + len(opening)), "", "", ""
        if m := _NAME.match(html, begin + 1):
            p = m.end()
            while stop := _STOP.search(html, p):
                q, p = stop[0], stop.end()
                if q == ">":
                    break
                if _VALUE.match(html[max(m.end(), p - 9) : p - 1]):
                    p = html.index(q, p) + 1 if last[q] >= p else max(p, after(">", p) - 1)
            return begin, p if stop else n, m[1], m[2].lower(), html[m.end() : p - 1 if stop else n]
        at = begin + 1
    return None


def leaf_blocks(html: str) -> list[tuple[str, tuple, int]]:
    """(text, path, characters in links) of each block with text, in page order; path: own tag, tag above, all tags and all class words around.

    References are decoded, white space is one space, ends are trimmed. Missing end tags are supplied as browsers do for the usual
    elements; an end tag without a beginning is ignored. Time and memory grow with the page's length, whatever its quotes and tags.
    """
    none = ("none", "", frozenset(), frozenset())
    out, stack, parts, linked, in_link, done = [], [], [], 0, 0, 0
    opened: dict[str, int] = {}
    endless: set[str] = set()

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip()
            if text:
                out.append((text, stack[-1] if stack else none, linked))
            parts.clear()
        linked = 0

    def pop():
        opened[stack.pop()[0]] -= 1

    n, last = len(html), {q: html.rfind(q) for q in "\"'"}
    while found := next_tag(html, done, last):
        begin, end, slash, name, attributes = found
        if begin > done:
            parts.append(html[done:begin])
            linked += (begin - done) * (in_link > 0)
        done = end
        if not name:
            continue
        if name in _INLINE:
            if name == "a":
                in_link = max(0, in_link + (-1 if slash else 1)) if slash or not in_link else in_link
            elif name == "br":
                parts.append(" ")
            continue
        if name in _RAW:
            if not slash and not attributes.endswith("/"):
                close = None if name in endless else _RAW_END[name].search(html, end)
                if close:
                    done = close.end()
                elif name in _TO_END:
                    done = n
                else:
                    endless.add(name)
            continue
        flush()
        in_link = 0
        if slash:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in _VOID and not attributes.endswith("/"):
            closes = _CLOSES.get(name, {"p"})
            while stack and stack[-1][0] in closes:
                pop()
            own, up, around, words = stack[-1] if stack else none
            new = {w for g in _CLASS.findall(attributes) for w in _WORDS.findall("".join(g).lower())} if "=" in attributes else set()
            stack.append((name, own if stack else "", around if name in around else around | {name}, words if new <= words else words | new))
            opened[name] = opened.get(name, 0) + 1
    if done < n:
        parts.append(html[done:])
        linked += (n - done) * (in_link > 0)
    flush()
    return out


def block_features(text: str, path: tuple, linked: int, place: int, count: int) -> list[str]:
    own, up, around, classes = path
    out = ["bias", *(f"in:{t}" for t in sorted(around)), *(f"class:{w}" for w in sorted(classes)), f"tag:{own}"]
    if up:
        out.append(f"up:{up}>{own}")
    n = len(text)
    out.append(f"length:{min(n.bit_length(), 10)}")
    out.append(f"links:{min(4, 5 * linked // max(n, 1))}")
    out.append(f"stops:{min(3, text.count('. ') + text.count(', ') + (text[-1] in '.!?'))}")
    out += [f"mark:{c}" for c in "©|·»" if c in text]
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    return out


_PLAN_WORDS = "the of and sun river stone walk letter green seven house late open field under wind paper night cold road".split()
_FRAMES = (("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("section", "article"), ("div", "entry"), ("article", "post"))
_REFUSE = (
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "banner"), ("div", "sponsored"), ("div", "promo"),
    ("div", "sidebar"), ("div", "menu"), ("ul", "nav"), ("div", "cookie"), ("div", "cookie notice"), ("div", "notice"), ("div", "consent"), ("div", "newsletter"), ("div", "subscribe"), ("div", "comments"),
    ("section", "comments"), ("div", "comment"), ("ol", "comment list"), ("div", "related"), ("div", "share"), ("div", "social"), ("div", "footer"), ("div", "header"), ("div", "breadcrumb"), ("div", "login"), ("div", "popup"), ("div", "widget"), ("dialog", ""), ("figure", "ad"), ("div", "copyright"),
)


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """n pages of random plans with the label of each of their leaf blocks (1: article text)."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join(rng.choices(_PLAN_WORDS, k=rng.randint(a, b)))
    prose = lambda: ". ".join(words(4, 14).capitalize() for _ in range(rng.randint(1, 6))) + rng.choice([".", ".", "!", "", " ***"])
    short = lambda: words(1, 12).capitalize() + rng.choice(["", ".", " |", "..."])

    def refuse(inside: bool):
        tag, cls = rng.choice(_REFUSE if not inside else [r for r in _REFUSE if r[1] or r[0] in ("aside", "form", "nav", "footer")])
        rows, body = [], ""
        for _ in range(rng.randint(1, 5)):
            kind = rng.choice(["li", "p", "div", "plain", "h3", "link"]) if "comment" not in cls else rng.choice(["p", "li", "div"])
            text = prose() if rng.random() < 0.5 else short()
            if kind == "plain" and body and not body.endswith(">"):
                kind = "p"
            body += {"li": f"<li><a href='/x'>{text}</a></li>" if rng.random() < 0.7 else f"<li>{text}</li>", "p": f"<p>{text}</p>", "div": f"<div>{text}</div>", "plain": text, "h3": f"<h3>{text}</h3>", "link": f"<div><a href='/y'>{text}</a></div>"}[kind]
            rows.append(0)
        if tag in ("nav", "header", "aside") and rng.random() < 0.6:
            body = f"<ul>{body}</ul>"
        if tag == "footer" or cls in ("footer", "copyright"):
            body += f"<p>&copy; {short()} &middot; {prose()}</p>"
            rows.append(0)
        attrs = f' {rng.choice(["class", "id"])}="{cls}"' if cls else ""
        return f"<{tag}{attrs}>{body}</{tag}>", rows

    pages = []
    for _ in range(n):
        page, labels = "<body>", []
        for _ in range(rng.randint(0, 4)):
            part, rows = refuse(False)
            page, labels = page + part, labels + rows
        tag, cls = rng.choice(_FRAMES)
        page += f'<{tag} class="{cls}">' if cls else f"<{tag}>"
        if rng.random() < 0.85:
            head = f"<h1>{short()}</h1>"
            page += f"<header>{head}</header>" if rng.random() < 0.15 else head
            labels.append(1)
        for _ in range(rng.randint(0 if labels and labels[-1] else 1, 7)):
            kind = rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "pre", "td", "div", "ad"])
            text = prose() if kind not in ("h2", "li", "td") or rng.random() < 0.3 else short()
            if rng.random() < 0.1:
                text = text.replace(" ", " | ")
            if rng.random() < 0.15:
                text = f"<a href='/z'>{text}</a>" if rng.random() < 0.3 else f"{text} <a href='/z'>{words(1, 3)}</a>"
            if kind == "ad":
                part, rows = refuse(True)
                page, labels = page + part, labels + rows
                continue
            page += {"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>", "blockquote": f"<blockquote><p>{text}</p></blockquote>"}.get(kind, f"<{kind}>{text}</{kind}>")
            labels.append(1)
        page += f"</{tag}>"
        for _ in range(rng.randint(0, 4)):
            part, rows = refuse(False)
            page, labels = page + part, labels + rows
        pages.append((page + "</body>", labels))
    return pages


class BlockChain:
    """weights: feature -> (weight of label 0, of label 1); step[a, b]: from label a to label b."""

    def __init__(self, weights: dict[str, tuple[float, float]], step: np.ndarray):
        self.weights, self.step = weights, step.tolist()

    def decode(self, blocks) -> list[int]:
        """Viterbi: the labels of the best path."""
        get, zero, count = self.weights.get, (0.0, 0.0), len(blocks)
        (s00, s01), (s10, s11) = self.step
        back, a, b = [], 0.0, 0.0
        for i, (text, path, linked) in enumerate(blocks):
            e0 = e1 = 0.0
            for f in block_features(text, path, linked, i, count):
                w = get(f, zero)
                e0 += w[0]
                e1 += w[1]
            if i:
                to0, to1 = a + s00 < b + s10, a + s01 < b + s11
                a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
                back.append((int(to0), int(to1)))
            else:
                a, b = e0, e1
        labels = [int(b > a)]
        for to in reversed(back):
            labels.append(to[labels[-1]])
        return labels[::-1] if count else []

    def main_text(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "")
        return "\n".join(b[0] for b, keep in zip(blocks, self.decode(blocks), strict=True) if keep)


def train(pages: list[tuple[str, list[int]]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> BlockChain:
    """Maximum likelihood by forward and backward sums over all pages at once, with Adam."""
    rows, gold = [], []
    for page, labels in pages:
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a label is needed for each block")
        if blocks:
            rows.append([block_features(t, p, k, i, len(blocks)) for i, (t, p, k) in enumerate(blocks)])
            gold.append(labels)
    names = {f: i + 1 for i, f in enumerate(sorted({f for page in rows for b in page for f in b}))}
    n, length, wide = len(rows), max(map(len, rows)), max(len(b) for page in rows for b in page)
    x, y, mask = np.zeros((length, n, wide), int), np.zeros((length, n), int), np.zeros((length, n))
    for j, (page, labels) in enumerate(zip(rows, gold, strict=True)):
        for i, b in enumerate(page):
            x[i, j, : len(b)] = [names[f] for f in b]
        y[: len(page), j], mask[: len(page), j] = labels, 1
    w, step = np.zeros((len(names) + 1, 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, step)]
    lse = lambda v, axis: np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis)) + v.max(axis)
    for k in range(1, steps + 1):
        e = w[x].sum(axis=2)
        alpha, beta = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        alpha[0] = e[0]
        for i in range(1, length):
            alpha[i] = np.where(mask[i][:, None] > 0, lse(alpha[i - 1][:, :, None] + step, 1) + e[i], alpha[i - 1])
        for i in range(length - 2, -1, -1):
            beta[i] = np.where(mask[i + 1][:, None] > 0, lse(step + (e[i + 1] + beta[i + 1])[:, None, :], 2), 0)
        z = lse(alpha[-1], 1)
        node = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
        both = np.exp(alpha[:-1, :, :, None] + step + (e + beta)[1:, :, None, :] - z[None, :, None, None]) * mask[1:, :, None, None]
        de = node - np.eye(2)[y] * mask[:, :, None]
        gw = np.stack([np.bincount(x.ravel(), np.repeat(de[:, :, c].ravel(), wide), len(w)) for c in (0, 1)], axis=1) / n + decay * w
        gold_steps = np.zeros((2, 2))
        np.add.at(gold_steps, (y[:-1].ravel(), y[1:].ravel()), mask[1:].ravel())
        gs = (both.sum(axis=(0, 1)) - gold_steps) / n + decay * step
        gw[0] = 0
        for p, g, m in ((w, gw, moments[0]), (step, gs, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
    return BlockChain({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, step)


def _extract(batches, chain: BlockChain):
    for batch in batches:
        texts = [chain.main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, chain: BlockChain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages. Null and empty html have an empty text; repeated rows are
    extracted each; other columns are not read; an empty table gives no rows."""
    small_batches(pages.sparkSession)
    chain = chain or train(labelled_pages())
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(lambda it: _extract(it, chain), rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
