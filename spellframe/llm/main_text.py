"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags.  Tags are read by the attribute rules of HTML (an unquoted value may hold quotes)
in one pass without backtracking, so any page takes linear time.  Each block has two groups of hashed features, the tags and
class words on its path and all words it holds, with a few numbers (length, share of link text, place).  A bidirectional LSTM in numpy
reads the blocks of the whole page and labels each as main text or not.

The model is trained on generated pages whose layout varies (menus, headers, sidebars, notices, adverts, forms,
comments, footers round an article), so it needs no labelled pages; training has a fixed size.  Every page is labelled over all its blocks.

Cases: null and empty html give empty text and 0 characters; a tag, comment or script that never closes reaches to the end, a quote that never closes is part of its
value, a head ends at the latest before the first tag or text that can't be in it; content of script, style and the head is never
text; each row gives a row, also repeated ones; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS, WORDS, NUMBERS, HIDDEN = 512, 128, 4, 16
PAGES, EPOCHS, RATE = 800, 8, 0.01
#: Blocks that one pass of the network handles at most, over all its pages; a longer page is a pass of its own.
PASS = 20_000

# Fixed values of the markup language.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title textarea select option iframe svg object".split())
#: Tags that leave an open head as it is; any other one, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
NAMING = frozenset(("class", "id", "role"))
REPEATED = frozenset("li tr td th dt dd option h1 h2 h3 h4 h5 h6".split())
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_ATTRIBUTES = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+"
#: Comment; element whose content is no markup; other declaration; tag; text.
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|textarea|title)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)"
                   rf"|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|([^<]++|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
OPEN_VALUE = re.compile(r"=\s*+[^\s\"'][^\s]*+\Z")
SPACE = re.compile(r"\s+")


class Block:
    """Text of a block, its length in links, and the hashed names on its path as bits."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: int, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class Stack:
    """Open elements; every change costs the same at any depth."""

    def __init__(self):
        self.names: list[str] = []
        self.blocks: list[int] = []  # places of those that are not inline
        self.marks: list[list[int]] = []
        self.open: Counter[str] = Counter()
        self.held = [0] * PATHS
        self.path = self.links = self.silent = 0

    def push(self, name: str, words: list[str]) -> None:
        marks = [crc32(w.encode()) % PATHS for w in (name, *words)]
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.marks.append(marks)
        self.open[name] += 1
        for m in marks:
            self.held[m] += 1
            self.path |= 1 << m
        self.links += name == "a"
        self.silent += name in SILENT

    def end(self, depth: int) -> None:
        """The element at this depth and all inside it end."""
        while len(self.names) > depth:
            name = self.names.pop()
            self.open[name] -= 1
            for m in self.marks.pop():
                self.held[m] -= 1
                if not self.held[m]:
                    self.path &= ~(1 << m)
            self.links -= name == "a"
            self.silent -= name in SILENT
            if self.blocks and self.blocks[-1] == len(self.names):
                self.blocks.pop()

    def close(self, name: str) -> None:
        """The innermost element of this name ends, if there is one."""
        if self.open[name]:
            depth = len(self.names) - 1
            while self.names[depth] != name:
                depth -= 1
            self.end(depth)


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with decoded text and single spaces."""
    out: list[Block] = []
    stack, parts, linked = Stack(), [], 0

    def close() -> None:
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append(Block(stack.path, text, linked))
        parts.clear()
        linked = 0

    in_head = lambda: bool(stack.names) and stack.names[-1] == "head"
    for m in TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            if in_head() and not text.isspace():
                stack.end(len(stack.names) - 1)
            if not stack.silent:
                parts.append(text)
                linked += len(text) if stack.links else 0
            continue
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if name not in INLINE:
                close()
            stack.close(name)
            continue
        if name == "body" and stack.open["head"]:
            stack.end(stack.names.index("head"))
        elif in_head() and name not in IN_HEAD:
            stack.end(len(stack.names) - 1)
        if name not in INLINE:
            close()
        held = m.group(4)
        if name in VOID or held.endswith("/") and not OPEN_VALUE.search(held):
            continue
        if name not in INLINE and stack.blocks:
            around = stack.names[stack.blocks[-1]]
            if around == "p" or around == name and name in REPEATED:
                stack.end(stack.blocks[-1])  # an open paragraph or item ends here
        words = [w for key, *values in ATTRIBUTE.findall(held) if key.lower() in NAMING for w in re.split(r"[\s_-]+", "".join(values).lower()) if w] if held else []
        stack.push(name, ["." + w for w in words])
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words as shares of all its words, numbers."""
    x = np.zeros((len(found), PATHS + WORDS + NUMBERS), np.float32)
    if found:
        paths = np.frombuffer(b"".join(b.path.to_bytes(PATHS // 8, "little") for b in found), np.uint8).reshape(len(found), -1)
        x[:, :PATHS] = np.unpackbits(paths, axis=1, bitorder="little")
    for k, block in enumerate(found):
        words = block.text.lower().split(" ")
        at = np.fromiter((crc32(w.encode()) % WORDS for w in words), np.int64, len(words))
        x[k, PATHS:PATHS + WORDS] = np.bincount(at, minlength=WORDS) * (2 / len(words))
        x[k, -NUMBERS:] = (np.log1p(len(words)) / 5, min(1.0, block.linked / len(block.text)), k / len(found), 1.0)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in each direction, and a logistic unit on both states."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = PATHS + WORDS + NUMBERS
        self.w = [rng.normal(0, 0.1, (size, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        self.u = [rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
        self.b = [np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32) for _ in range(2)]
        self.out = rng.normal(0, 0.3, 2 * HIDDEN + 1).astype(np.float32)

    def _run(self, side: int, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction over (pages, steps, features); a masked step leaves the state as it is."""
        pages, steps, _ = x.shape
        pre = x @ self.w[side] + self.b[side]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states, kept = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.u[side]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = mask[:, t, None]
            new = f * c + i * g
            if keep:
                kept.append((t, i, f, o, g, h, c, np.tanh(new), on))
            h, c = np.where(on, o * np.tanh(new), h), np.where(on, new, c)
            states[:, t] = h
        return states, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(s, x, mask, False)[0] for s in range(2)], axis=2)
        return _sigmoid(both @ self.out[:-1] + self.out[-1])

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.w, *self.u, *self.b, self.out]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for number in range(EPOCHS):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 32):
                chosen = [pages[i] for i in order[at:at + 32]]
                x, mask = _padded([p for p, _ in chosen])
                y = _padded([t[:, None] for _, t in chosen])[0][:, :, 0]
                runs = [self._run(s, x, mask, True) for s in range(2)]
                both = np.concatenate([r[0] for r in runs], axis=2)
                delta = ((_sigmoid(both @ self.out[:-1] + self.out[-1]) - y) * mask / mask.sum()).astype(np.float32)
                grads = [np.zeros_like(p) for p in params]
                grads[6][:-1], grads[6][-1] = np.einsum("pt,pth->h", delta, both), delta.sum()
                for s in range(2):
                    up = delta[:, :, None] * self.out[s * HIDDEN:(s + 1) * HIDDEN]
                    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
                    dh, dc = np.zeros_like(up[:, 0]), np.zeros_like(up[:, 0])
                    for t, i, f, o, g, h, c, tc, on in reversed(runs[s][1]):
                        dh = dh + up[:, t]
                        through = np.where(on, dh, 0)
                        dnew = np.where(on, dc, 0) + through * o * (1 - tc * tc)
                        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), through * tc * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                        dz_all[:, t] = dz
                        grads[2 + s] += h.T @ dz
                        dh = np.where(on, 0, dh) + dz @ self.u[s].T
                        dc = np.where(on, 0, dc) + dnew * f
                    flat = dz_all.reshape(-1, 4 * HIDDEN)
                    grads[s] += x.reshape(-1, x.shape[2]).T @ flat
                    grads[4 + s] += flat.sum(0)
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= RATE * (1 - 0.9 * number / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), steps, rows[0].shape[1]), np.float32), np.zeros((len(rows), steps), bool)
    for k, r in enumerate(rows):
        x[k, :len(r)], mask[k, :len(r)] = r, True
    return x, mask


# Layout words of the generated pages.
NAV = ["<nav>", '<div class="nav">', '<div class="menu">', '<ul class="navigation">', '<div id="navbar">', '<div role="navigation">', '<div class="breadcrumb">']
HEADER = ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header top-bar">', '<div role="banner">']
SIDE = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">', '<div class="widget">', '<section class="related-posts">', '<div class="recommended">', '<div class="share social">']
ADVERT = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="banner-ad">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<section class="advertisement">']
NOTICE = ['<div class="cookie">', '<div class="cookie-notice">', '<div id="consent">', '<div class="notice">', '<div class="popup newsletter">', '<div class="alert banner">', '<div class="gdpr privacy">']
FORM = ["<form>", '<form class="search">', '<form class="newsletter subscribe">', '<div class="login"><form>', '<form id="signup">']
COMMENT = ['<div class="comments">', '<section id="comments">', '<div class="comment">', '<ul class="comment-list">', '<div class="discussion replies">', '<section class="reader-comments">']
FOOTER = ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="site-footer copyright">', '<div role="contentinfo">']
MAIN = ["<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="article-body">', '<div class="post entry">', '<article class="post">', '<div class="story">', '<section class="main-text">', '<div role="main">']


def generated_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    sounds = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ä ñ ü".split()
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice(["", ".", ".", "!"])
    page, truth = [], []

    def add(markup: str, main: bool) -> None:
        page.append(markup)
        truth.extend([main] * len(blocks("<div>" + markup)))

    def part(opens: list[str], kind: str) -> None:
        start = rng.choice(opens)
        page.append(start)
        for _ in range(rng.randint(1, 5)):
            text = say(1, 3) if kind == "links" else say(2, 25)
            inner = {"links": f'<li><a href="/{word()}">{text}</a></li>', "text": rng.choice(["{}", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<span>{}</span><br>"]).format(text),
                     "form": f'<label>{text}</label><input name="x"><button>{word()}</button><br>',
                     "comment": f'<li class="comment"><b>{word()}</b><p>{text}</p></li>'}[kind]
            page.append(inner + "<!---->")
        names = re.findall(r"<(\w+)", start)
        page.append("".join(f"</{n}>" for n in reversed(names)))

    def bad(opens: list[str], kind: str) -> None:
        before = len(page)
        part(opens, kind)
        markup = "".join(page[before:])
        del page[before:]
        add(markup, False)

    furniture = [(NAV, "links"), (HEADER, "text"), (ADVERT, "text"), (NOTICE, "text"), (FORM, "form"), (SIDE, "links"), (SIDE, "text")]
    for opens, kind in rng.sample(furniture, rng.randint(1, 4)) + [(NAV, "links")] * rng.randint(0, 1):
        bad(opens, kind)
    start = rng.choice(MAIN)
    page.append(start)
    if rng.random() < 0.8:
        add(f"<h1>{say(2, 10)}</h1>", True)
    for _ in range(rng.randint(1, 10)):
        text = say(1, 8) if rng.random() < 0.2 else say(10, 80)
        form = rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}", "<p>{}<br>", "<div>{}</div>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>",
                           "<table><tr><td>{}</td></tr></table>", '<p><a href="/x">{}</a></p>', "<figure><figcaption>{}</figcaption></figure>"])
        add(form.format(text), True)
        if rng.random() < 0.12:
            bad(*rng.choice([(ADVERT, "text"), (SIDE, "links"), (NOTICE, "text"), (FORM, "form")]))
    page.append("".join(f"</{n}>" for n in reversed(re.findall(r"<(\w+)", start))))
    for opens, kind in rng.sample([(COMMENT, "comment"), (SIDE, "links"), (ADVERT, "text"), (FORM, "form"), (NOTICE, "text"), (COMMENT, "text")], rng.randint(0, 3)) + [(FOOTER, rng.choice(["text", "links"]))]:
        bad(opens, kind)
    return f"<html><head><title>{say(2, 8)}</title></head><body>" + "".join(page) + "</body></html>", truth


def trained(pages: int = PAGES, seed: int = 21) -> Labeller:
    rng, sample = random.Random(seed), []
    while len(sample) < pages:
        page, truth = generated_page(rng)
        found = blocks(page)
        if len(found) == len(truth):
            sample.append((features(found), np.array(truth, np.float32)))
    model = Labeller()
    model.train(sample)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= PASS // 16:
            to += 1
        chosen = order[at:to]
        p = model.probabilities(*_padded([features(pages[k]) for k in chosen]))
        for row, k in enumerate(chosen):
            out[k] = p[row, :len(pages[k])] >= 0.5
        at = to
    return out


def _extract(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    net = pickle.loads(model)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [blocks(x or "") for x in part.column("html").to_pylist()]
            texts = [" ".join(b.text for b, main in zip(page, chosen, strict=True) if main) for page, chosen in zip(found, label(net, found), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", model: Labeller | None = None) -> DataFrame:
    """Per row: id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model or trained()))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(lambda it: _extract(it, shared.value), kinds).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
