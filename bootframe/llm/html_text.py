"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between tags of block elements, in page order. A
block's vector has three parts: its tag path (tags and the words of class, id and role of the open
elements, hashed to signed places, nearer ones weighing more), its words (hashed, their mean)
and a few figures (length, links, place). A bidirectional LSTM reads the sequence of a page's
blocks and says of each whether it belongs to the article, so the whole document is every
block's context. Training and reading are numpy.

No page comes with labels. The model is fitted on a bounded sample of pages (``SAMPLE_PAGES`` of
them, the first ``SAMPLE_CHARS`` characters of each), labelled where element names and class words
are plain, and on pages laid out anew from the sample's texts in other templates (``LAYOUTS`` a
page), whose labels are known. Every page is read whole. Broadcast: the model, some 100 KB.
Memory: the blocks of a slice of pages, ``SLICE_CHARS`` characters or one page.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import opened, shared

#: Pages that the model is fitted on, and how much of each.
SAMPLE_PAGES, SAMPLE_CHARS = 128, 20_000
#: Layouts made of each sampled page.
LAYOUTS = 10
#: Characters of pages that are read at once.
SLICE_CHARS = 2_000_000
#: Places of a tag path's vector, of the words', and figures; units of each direction.
PATH, WORD, FIGURES, HIDDEN = 96, 24, 7, 24
#: Paths (besides those of a slice of pages) and words that a task keeps.
PATHS_KEPT, WORDS_KEPT = 20_000, 200_000

# Elements of HTML that hold no content, that don't end a line, whose content isn't markup
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in "script style textarea title iframe noembed noframes xmp".split()}
#: Elements that an element of the same set ends if it wasn't closed, up to the element around them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What names say of a block, for the labels of the sample.
OUTSIDE = set("nav aside footer form button select dialog noscript head svg template menu fieldset".split())
OUTSIDE_WORDS = set("ad ads advert advertisement adsbygoogle alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies footer form header hint legal login masthead menu message modal nav navbar navigation newsletter notice notification popup promo related reply search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
INSIDE_WORDS = set("article body content entry main post story text".split())

_TOKEN = re.compile(r"""<!-->|<!--->|<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Paths:
    """Open elements as numbers: a path is its last element behind another path. Keeps the
    vector of each path and what its names say (1 inside the article, -1 outside, 0 nothing)."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[int, str, str], int] = {}
        self.vectors, self.says, self.links = [np.zeros(PATH, np.float32)], [0], [False]
        self._matrix = np.empty((0, PATH), np.float32)

    def matrix(self) -> np.ndarray:
        """Vectors of all paths so far, by number."""
        if len(self._matrix) < len(self.vectors):
            self._matrix = np.stack(self.vectors)
        return self._matrix

    def __call__(self, parent: int, tag: str, attributes: str) -> int:
        names = attributes if "=" in attributes and _NAMES.search(attributes) else ""
        at = self.known.get((parent, tag, names))
        if at is None:
            words = [w.lower() for m in _NAMES.finditer(names) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")]
            vector = self.vectors[parent] * np.float32(0.85)
            for token in [tag, *[f".{w}" for w in words]]:
                vector = vector + signed(token, PATH)
            at = self.known[parent, tag, names] = len(self.vectors)
            self.vectors.append(vector)
            self.says.append(self._says(self.says[parent], tag, words))
            self.links.append(self.links[parent] or tag == "a")
        return at

    @staticmethod
    def _says(before: int, tag: str, words: list[str]) -> int:
        if before < 0 or tag in OUTSIDE or not OUTSIDE_WORDS.isdisjoint(words) or (tag == "header" and not before):
            return -1
        return 1 if before or tag in ("article", "main") or not INSIDE_WORDS.isdisjoint(words) else 0


def signed(token: str, size: int) -> np.ndarray:
    """A vector of four places, each +1 or -1, by the token's hash."""
    out = np.zeros(size, np.float32)
    for i in range(4):
        h = zlib.crc32(f"{i} {token}".encode("utf-8", "replace"))
        out[h % size] += 1 if h >> 20 & 1 else -1
    return out


def blocks(page: str, paths: Paths) -> list[tuple[str, int, int]]:
    """Leaf blocks of a page in order: text (references decoded, white space as one space,
    trimmed, never empty), path of its first text, characters of it inside links."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    opened_now: Counter = Counter()
    path, linked, at, end = -1, 0, 0, len(page)

    def text(piece: str) -> None:
        nonlocal path, linked
        if piece and not piece.isspace():
            if path < 0:
                path = stack[-1][1]
            if paths.links[stack[-1][1]]:
                linked += len(piece)
            parts.append(entities.unescape(piece) if "&" in piece else piece)
        elif piece:
            parts.append(" ")

    def flush() -> None:
        nonlocal path, linked
        if path >= 0:
            whole = " ".join("".join(parts).split())
            if whole:
                out.append((whole, path, linked))
        parts.clear()
        path, linked = -1, 0

    def close(i: int) -> None:
        for t, _ in stack[i:]:
            opened_now[t] -= 1
        del stack[i:]

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            for i in range(len(stack) - 1 if opened_now[tag] else 0, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                # the end of an inline element leaves block elements open
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            done = RAW[tag].search(page, at)
            at = done.start() if done else end
            continue
        if tag in VOID:
            continue
        if tag in ENDS:
            same, around = ENDS[tag]
            first = 0
            for i in range(len(stack) - 1 if any(opened_now[t] for t in same) else 0, 0, -1):
                if stack[i][0] in same:
                    first = i
                elif stack[i][0] in around:
                    break
            if first:
                close(first)
        elif not inline:
            # a block element ends an open paragraph, and body an open head
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or (tag == "body" and stack[i][0] == "head"):
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        stack.append((tag, paths(stack[-1][1], tag, attributes)))
        opened_now[tag] += 1
    flush()
    return out


class WordPlaces(dict):
    """Word to its row of the table of hashed vectors."""

    TABLE = 4096

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = place = zlib.crc32(word.lower().encode("utf-8", "replace")) % self.TABLE
        return place


def word_table() -> np.ndarray:
    return np.stack([signed(f"w{i}", WORD) for i in range(WordPlaces.TABLE)])


class Reader:
    """Vectors of pages' blocks, with what a task keeps for it."""

    def __init__(self) -> None:
        self.paths, self.places, self.table = Paths(), WordPlaces(), word_table()

    def blocks(self, page: str) -> list[tuple[str, int, int]]:
        return blocks(page, self.paths)

    def empty(self) -> None:
        """Forget paths if there are many; numbers of blocks read before mean nothing then."""
        if len(self.paths.vectors) > PATHS_KEPT:
            self.paths.clear()

    def vectors(self, pages: list[list[tuple[str, int, int]]]) -> np.ndarray:
        """A row a block, of pages that have blocks, one page after the other."""
        found = [b for page in pages for b in page]
        per_page = np.fromiter(map(len, pages), np.int64, len(pages))
        n = len(found)
        texts = [t for t, _, _ in found]
        chars = np.fromiter(map(len, texts), np.float32, n)
        counts = np.fromiter((t.count(" ") for t in texts), np.int64, n) + 1
        out = np.empty((n, PATH + WORD + FIGURES), np.float32)
        out[:, :PATH] = self.paths.matrix()[np.fromiter((p for _, p, _ in found), np.int64, n)]
        sums, number, step = np.zeros((n, WORD), np.float32), np.repeat(np.arange(n), counts), 500_000
        places = np.fromiter(map(self.places.__getitem__, " ".join(texts).split(" ")), np.int64, len(number))
        for a in range(0, len(places), step):
            where, first = np.unique(number[a : a + step], return_index=True)
            sums[where] += np.add.reduceat(self.table[places[a : a + step]], first, axis=0)
        out[:, PATH : PATH + WORD] = sums / counts[:, None]
        many = np.repeat(per_page, per_page).astype(np.float32)
        place = (np.arange(n) - np.repeat(np.cumsum(per_page) - per_page, per_page)).astype(np.float32)
        linked = np.minimum(np.fromiter((x for _, _, x in found), np.float32, n) / chars, 1)
        out[:, PATH + WORD :] = np.stack([np.log1p(counts) / 3, np.log1p(chars) / 5, linked, place / many, 1 / (1 + place), 1 / (many - place), np.log1p(many) / 5], axis=1)
        return out


class BiLSTM:
    """Bidirectional LSTM with one logit a step, trained by Adam on the mean cross-entropy."""

    def __init__(self, inputs: int, hidden: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = r.normal(0, inputs**-0.5, (inputs, 4 * hidden))
            self.p[f"U{d}"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p[f"b{d}"] = bias
        self.p["V"] = r.normal(0, (2 * hidden) ** -0.5, 2 * hidden)
        self.p["a"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        steps, batch, _ = x.shape
        n, u = self.h, self.p[f"U{d}"]
        z = x.reshape(-1, x.shape[2]) @ self.p[f"W{d}"] + self.p[f"b{d}"]
        z = z.reshape(steps, batch, 4 * n)
        h, c = np.zeros((batch, n), z.dtype), np.zeros((batch, n), z.dtype)
        out, kept = np.empty((steps, batch, n), z.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ u
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * n], -30, 30)))
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(a[:, 3 * n :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """``x``: step, page, input; ``mask``: step, page (steps beyond a page's end are false)."""
        hf, hb = (self._direction(d, x, mask, False)[0] for d in "fb")
        return hf @ self.p["V"][: self.h] + hb @ self.p["V"][self.h :] + self.p["a"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, want: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the weights, and its gradients."""
        n = self.h
        (hf, kf), (hb, kb) = (self._direction(d, x, mask, True) for d in "fb")
        logit = hf @ self.p["V"][:n] + hb @ self.p["V"][n:] + self.p["a"]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        total = max(float(weight.sum()), 1.0)
        loss = float((weight * (np.logaddexp(0, logit) - want * logit)).sum()) / total
        dl = weight * (p - want) / total
        g = {"V": np.concatenate([np.einsum("tb,tbh->h", dl, hf), np.einsum("tb,tbh->h", dl, hb)]), "a": dl.sum(keepdims=True).reshape(1)}
        for d, kept, v in (("f", kf, self.p["V"][:n]), ("b", kb, self.p["V"][n:])):
            u, du = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"])
            dz = np.zeros((x.shape[0], x.shape[1], 4 * n), x.dtype)
            dh, dc = np.zeros((x.shape[1], n), x.dtype), np.zeros((x.shape[1], n), x.dtype)
            for t, h, c, i, f, o, gg, tc, m in reversed(kept):
                dh = dh + dl[t][:, None] * v
                dhm, dcm = np.where(m, dh, 0), np.where(m, dc, 0)
                dnew = dcm + dhm * o * (1 - tc * tc)
                da = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), dhm * tc * o * (1 - o), dnew * i * (1 - gg * gg)], axis=1)
                dz[t] = da
                du += h.T @ da
                dh = np.where(m, 0, dh) + da @ u.T
                dc = np.where(m, 0, dc) + dnew * f
            flat = dz.reshape(-1, 4 * n)
            g[f"U{d}"], g[f"b{d}"], g[f"W{d}"] = du, flat.sum(axis=0), x.reshape(-1, x.shape[2]).T @ flat
        return loss, g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 8e-3, seed: int = 0) -> None:
        """``pages``: vectors, wanted labels and weights of the blocks of each page."""
        r = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        by_length = np.argsort([len(w) for _, w, _ in pages], kind="stable")
        groups = [by_length[a : a + batch] for a in range(0, len(pages), batch)]
        for epoch in range(epochs):
            for at in r.permutation(len(groups)):
                part = [pages[i] for i in groups[at]]
                x, mask = padded([x for x, _, _ in part])
                want, weight = (padded([p[i][:, None] for p in part])[0][:, :, 0] for i in (1, 2))
                _, g = self.gradients(x, mask, want, weight)
                norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, v in g.items():
                    v = v * min(1.0, 1 / (norm + 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages of different lengths as one array (step, page, value), and which steps are real."""
    steps = max(len(x) for x in pages)
    out = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for i, x in enumerate(pages):
        out[: len(x), i], mask[: len(x), i] = x, True
    return out, mask


def articles(model: BiLSTM, reader: Reader, pages: list[str]) -> list[str]:
    """Main text of each page: the blocks that the model keeps, one a line."""
    reader.empty()
    found = [reader.blocks(page) if page else [] for page in pages]
    out = [""] * len(pages)
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    a = 0
    while a < len(order):
        # pages of about a length together, some 10,000 steps
        z = a + 1
        while z < len(order) and z - a < 256 and (z - a + 1) * len(found[order[z]]) <= 10_000:
            z += 1
        part = order[a:z]
        x, mask = padded(np.split(reader.vectors([found[i] for i in part]), np.cumsum([len(found[i]) for i in part])[:-1]))
        keep = model.logits(x, mask) > 0
        for column, i in enumerate(part):
            out[i] = "\n".join([text for (text, _, _), k in zip(found[i], keep[:, column]) if k])
        a = z
    return out


# Fixed values of the layouts: how templates wrap the article and what stands around it ("?": a made-up name)
_MAIN = ["<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post"><div class="entry-content">', '<section class="article-body">', '<div id="main" class="?">', '<article class="post ?">', '<div class="story">', '<div class="?">', '<div class="?"><div class="?">', ""]
_AROUND = {
    "nav": ["<nav>*</nav>", '<ul class="menu">*</ul>', '<div id="navigation">*</div>', '<div class="?"><ul>*</ul></div>', '<div class="breadcrumbs">*</div>', '<nav class="?" role="navigation">*</nav>'],
    "header": ["<header>*</header>", '<div class="header">*</div>', '<div id="masthead">*</div>', '<header class="?"><div class="?">*</div></header>', '<div class="site-header">*</div>'],
    "side": ["<aside>*</aside>", '<div class="sidebar">*</div>', '<div id="sidebar">*</div>', '<aside class="?"><div class="widget">*</div></aside>', '<div class="related">*</div>'],
    "ad": ['<div class="ad">*</div>', '<div class="ads">*</div>', '<div class="advert">*</div>', '<section class="promo">*</section>', '<div class="sponsored">*</div>', '<div id="ad-?">*</div>', '<div class="banner">*</div>'],
    "notice": ['<div class="cookie-notice">*</div>', '<div id="consent" role="dialog">*</div>', '<div class="notice">*</div>', '<div role="alert">*</div>', '<div class="newsletter">*</div>', "<noscript>*</noscript>", '<div class="popup">*</div>'],
    "form": ["<form>*</form>", '<form class="search">*</form>', '<form id="?" action="/x">*</form>', '<div class="login"><form>*</form></div>'],
    "comments": ['<section class="comments">*</section>', '<div id="comments">*</div>', '<ol class="commentlist">*</ol>', '<div class="comment">*</div>', '<article class="comment">*</article>', '<section id="comments"><article>*</article></section>'],
    "footer": ["<footer>*</footer>", '<div class="footer">*</div>', '<div id="footer">*</div>', '<footer class="?"><div class="?">*</div></footer>'],
}
_PHRASES = ["Menu", "Home", "Search", "Log in", "Subscribe", "Share this", "We use cookies", "Accept", "Advertisement", "Comments", "Reply", "Related", "Contact", "Imprint", "All rights reserved", "Read more"]


class Layouts:
    """Pages laid out anew from texts of the sample, with the label of each block."""

    def __init__(self, prose: list[str], seed: int) -> None:
        self.prose, self.r = prose, random.Random(seed)

    def _name(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(2, 8)))

    def _wrap(self, template: str) -> str:
        return re.sub(r"\?", lambda _: self._name(), template)

    def _short(self) -> str:
        if self.r.random() < 0.4:
            return self.r.choice(_PHRASES)
        words = self.r.choice(self.prose).split()
        at = self.r.randrange(len(words))
        return " ".join(words[at : at + self.r.randint(1, 12)])

    def _around(self, kind: str) -> tuple[str, list[int]]:
        r = self.r
        items = []
        for _ in range(r.randint(1, 6) if kind in ("nav", "side", "comments") else r.randint(1, 3)):
            text = entities.escape(r.choice(self.prose) if kind in ("comments", "side", "ad") and r.random() < 0.5 else self._short())
            if kind == "nav":
                items.append(f'<li><a href="/{self._name()}">{text}</a></li>')
            elif kind == "form":
                items.append(r.choice([f"<label>{text}</label><div><input name=x></div>", f"<p>{text}</p>", f"<button>{text}</button>", f"<select><option>{text}</option></select>"]))
            else:
                items.append(r.choice([f"<p>{text}</p>", f"<div>{text}</div>", f"<h3>{text}</h3>", f'<p><a href="/x">{text}</a></p>', f"<li>{text}</li>", f'<div class="{self._name()}">{text}</div>']))
        inner = "".join(items)
        if len(items) == 1 and r.random() < 0.5 and kind not in ("nav", "form"):
            inner = re.sub(r"<[^<>]*>", "", inner)
        return self._wrap(r.choice(_AROUND[kind])).replace("*", inner), [0] * len(items)

    def _article(self, texts: list[str]) -> list[tuple[str, list[int]]]:
        r, out = self.r, []
        for i, text in enumerate(texts):
            text, shape = entities.escape(text), r.random()
            if not i and shape < 0.7:
                piece = f"<h1>{text}</h1>"
            elif shape < 0.7:
                piece = r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p class='{self._name()}'>{text}</p>", f"<div>{text}</div>"])
            else:
                piece = r.choice([f"<h2>{text}</h2>", f"<ul><li>{text}</li></ul>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<table><tr><td>{text}</td></tr></table>", f"<figure><figcaption>{text}</figcaption></figure>", f"<p><a href=/x>{text}</a></p>"])
            out.append((piece, [1]))
        return out

    def page(self, texts: list[str]) -> tuple[str, list[int]]:
        """A page whose article has the given texts (no empty ones) as blocks, and each block's label."""
        r = self.r
        start = self._wrap(r.choice(_MAIN))
        inner = self._article(texts)
        for kind in r.sample(["ad", "side", "form", "notice", "nav"], r.choice([0, 0, 0, 1, 2])):
            inner.insert(r.randint(1, len(inner)), self._around(kind))
        before = [self._around(k) for k in r.sample(["nav", "header", "notice", "ad", "form"], r.randint(0, 4))]
        behind = [self._around(k) for k in r.sample(["side", "ad", "comments", "form", "notice", "nav"], r.randint(0, 4)) + r.choice([[], ["footer"]])]
        ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", start)))
        pieces = [*before, (start, []), *inner, (ends, []), *behind]
        return f"<html><head><title>x</title></head><body>{''.join(p for p, _ in pieces)}</body></html>", [x for _, labels in pieces for x in labels]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES, seed: int = 0) -> BiLSTM | None:
    """A model fitted on ``sample`` pages, chosen by a hash of id and page (shorter than
    ``SAMPLE_CHARS`` characters if there are as many). No page with text: None."""
    page = F.col(html_col).cast("string")
    rows = pages.select(page.alias("page"), F.xxhash64(F.col(id_col).cast("string"), page).alias("luck")).where("page is not null and page <> ''")
    rows = rows.withColumn("long", F.length("page") > SAMPLE_CHARS)
    # numbers first: each task sends the driver a sample's worth of rows, so they must be narrow
    lucky = rows.select("long", "luck").distinct().orderBy("long", "luck").limit(sample).collect()
    few = rows.join(F.broadcast(pages.sparkSession.createDataFrame(lucky, "long boolean, luck long")), ["long", "luck"])
    chosen = few.groupBy("luck").agg(F.min(F.substring("page", 1, SAMPLE_CHARS)).alias("page")).orderBy("luck").collect()
    return fitted([r["page"] for r in chosen], seed)


def fitted(sample: list[str], seed: int = 0) -> BiLSTM | None:
    reader, examples, prose = Reader(), [], []
    for page in sample:
        found = reader.blocks(page)
        says = np.array([reader.paths.says[p] for _, p, _ in found], np.float32)
        if len(found):
            examples += [(reader.vectors([found]), (says > 0).astype(np.float32), (says != 0).astype(np.float32))] * 2
            prose.append([t for (t, _, _), x in zip(found, says) if x > 0] or [t for t, _, _ in found])
    if not examples:
        return None
    layouts = Layouts([t for texts in prose for t in texts], seed)
    r = random.Random(seed)
    for texts in prose * LAYOUTS:
        start = r.randrange(len(texts))
        page, labels = layouts.page(texts[start : start + r.randint(1, 20)])
        found = reader.blocks(page)
        if len(found) == len(labels):
            examples.append((reader.vectors([found]), np.array(labels, np.float32), np.ones(len(labels), np.float32)))
    model = BiLSTM(PATH + WORD + FIGURES, HIDDEN, seed)
    # few pages: as many steps as 40 batches an epoch would give, over more epochs
    model.train(examples, epochs=max(10, min(60, 12_800 // len(examples))), seed=seed)
    return model


def main_text(pages: DataFrame, model: BiLSTM | None, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with text (the blocks of the article, one a line; empty if
    none) and n_chars (its code points).

    Blocks have their references decoded, white space as one space and no space at the ends.
    A null page counts as empty; without a model every text is empty. Rows that repeat get equal texts. Other
    columns pass through whatever their names; text and n_chars are replaced.
    """
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    if model is None:
        return pages.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    sent = shared(pages.sparkSession, model)

    @F.pandas_udf("text string, n_chars long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, reader = opened(sent), Reader()
        for batch in batches:
            out, part, size = [], [], 0
            for page in batch:
                part.append(page or "")
                size += len(part[-1])
                if size > SLICE_CHARS:
                    out += articles(model, reader, part)
                    part, size = [], 0
            out += articles(model, reader, part)
            yield pd.DataFrame({"text": out, "n_chars": [len(t) for t in out]})

    met = pages.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(kept)], read(F.col(f"`{html_col}`").cast("string")).alias("__read"))
    return met.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], F.col("__read.text").alias("text"), F.col("__read.n_chars").alias("n_chars"))
