"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: text between tags that start or end a block, with the path of open elements.
A numpy bidirectional LSTM reads, for each block, a vector of its hashed tag path (names, classes and ids of the open
elements) and of its hashed words with a few measures, and labels every block with the whole page before and behind it
in view. Every mark of the path and every word counts, however deep or long; the vectors' lengths alone bound them.
Blocks labelled as article are joined. Scanning takes time in proportion to the page: the open path is kept as a count
of each place of its vector, and no part of a page is searched twice for an end that isn't there. Long pages are turned
into vectors ``STEPS`` blocks at a time, and pages are labelled side by side while ``TOGETHER`` blocks hold them.

There are no labelled pages, so the network learns from pages that a rule makes up: menus, headers, adverts, notices,
forms, side columns, reader comments and footers in varied markup, flat or in deep wrappers of many classes, around
articles whose blocks are known.

Defined results: null or empty pages, and pages without an article, give an empty text. Comments, scripts, styles and
other raw elements never give text; what is open at the end counts as closed there. A quote in a tag without another one
behind it is an ordinary character; from the first tag on whose quotes leave it without an end, tags end at the next >;
without one, < is text. Character references are decoded,
white space within a block becomes one space, blocks are joined by one space. Nothing else is dropped or cut. Repeated
rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

RAW = frozenset("script style noscript template textarea title svg iframe select object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var button img input wbr".split())
#: An element of the first kind ends when one of the second kind starts.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table body".split())
STOP = re.compile(r"[>\"']")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PATH_DIMS, WORD_DIMS, MEASURES = 1024, 24, 4
INPUT = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
EPOCHS = 14
PAGES = 1000
#: Blocks of one page that are turned into vectors at once, and blocks with their padding that are labelled at once.
STEPS = 4096
TOGETHER = 1 << 15


@dataclass(frozen=True)
class Block:
    path: int  # places of the open path's vector, as bits
    marks: int  # how many marks the open path has
    text: str
    linked: float


class Scanner:
    """Finds where tags end; what isn't found once from some place isn't looked for again behind it."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.gone: set[str] = set()
        self.plain = False

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.gone.add(what)
        return got

    def tag_end(self, at: int) -> int:
        """Behind the > that ends the tag whose name starts at ``at``, or -1."""
        start = at
        while not self.plain:
            m = STOP.search(self.page, at)
            if m is None:
                self.plain = True
                break
            at = m.end()
            if m.group() == ">":
                return at
            close = self.find(m.group(), at)
            at = close + 1 if close >= 0 else at
        return self.find(">", start) + 1 or -1


class Path:
    """The open elements, with a count of each place that their marks have."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: list[tuple[int, list[int]]] = []
        self.at: dict[str, list[int]] = {}
        self.counts = [0] * PATH_DIMS
        self.bits = self.marks = 0

    def open(self, name: str) -> bool:
        return bool(self.at.get(name))

    def last(self, name: str) -> int:
        return self.at[name][-1] if self.at.get(name) else -1

    def push(self, name: str, marks: list[str]) -> None:
        places = [place(x, PATH_DIMS) for x in marks] + [place("." + x.split(".", 1)[1], PATH_DIMS) for x in marks if "." in x]
        for k in places:
            self.counts[k] += 1
            if self.counts[k] == 1:
                self.bits |= 1 << k
        self.marks += len(marks)
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.places.append((len(marks), places))

    def cut(self, depth: int) -> None:
        while len(self.names) > depth:
            self.at[self.names.pop()].pop()
            marks, places = self.places.pop()
            self.marks -= marks
            for k in places:
                self.counts[k] -= 1
                if not self.counts[k]:
                    self.bits &= ~(1 << k)

    def starts(self, name: str) -> None:
        """End the innermost element that cannot hold a new block of this name, unless a list or table stands between."""
        ends = max(self.last(x) for x, by in ENDS.items() if by is None or name in by)
        if ends > max(map(self.last, LISTS)):
            self.cut(ends)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    path, scan = Path(), Scanner(page)
    text: list[str] = []
    linked = at = 0
    size = len(page)

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            out.append(Block(path.bits, path.marks, words, min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        text.append(entities.unescape(piece))
        if path.open("a"):
            linked += len(text[-1].strip())

    while at < size:
        tag = scan.find("<", at)
        if tag != at:
            say(page[at : tag if tag >= 0 else size])
            at = tag if tag >= 0 else size
            continue
        if page.startswith("<!--", at):
            end = scan.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            at = scan.find(">", at) + 1 or size
            continue
        named = NAME.match(page, at)
        end = scan.tag_end(named.end()) if named else -1
        if end < 0:
            say("<")
            at += 1
            continue
        got = page[at:end]
        at = end
        name = named.group(1).lower()
        inline = name in INLINE or name in RAW
        if not inline:
            if name == "br":
                text.append(" ")
                continue
            flush()
        if got[1] == "/":
            if path.open(name):
                path.cut(path.last(name))
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in VOID or got.endswith("/>") and inline:
            continue
        if not inline:
            path.starts(name)
        marks = [name]
        for a, b, c in MARKED.findall(got):
            marks += [f"{name}.{w.lower()}" for w in re.split(r"[\s_-]+", a or b or c) if w]
        path.push(name, marks)
    flush()
    return out


@lru_cache(maxsize=200_000)
def place(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % dims


def vectors(page: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Of the blocks lo to hi of a page."""
    some = page[lo:hi]
    x = np.zeros((len(some), INPUT), np.float32)
    for k, b in enumerate(some):
        row = x[k]
        row[:PATH_DIMS] = np.unpackbits(np.frombuffer(b.path.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little")
        words = b.text.split(" ")
        for w in words:
            row[PATH_DIMS + place(w, WORD_DIMS)] += 1 / len(words)
        row[-4:] = (np.log1p(len(b.text)) / 6, b.linked, (lo + k) / len(page), float(b.text[-1:] in ".!?"))
    return x


@dataclass
class Labeller:
    """Weights of both directions (gates i, f, g, o side by side) and of the output."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: float

    def into(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to the gates of both directions, side by side."""
        return np.concatenate([x @ w + b for w, b in zip(self.w, self.b)], -1)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: time, pages, ``into`` of inputs. Where the mask is 0 the state stays; so padding behind a page changes nothing."""
        hs = []
        for d in (0, 1):
            xs, ms = (x, mask) if d == 0 else (x[::-1], mask[::-1])
            steps, pages = xs.shape[:2]
            h = np.zeros((pages, HIDDEN), np.float32)
            c = np.zeros_like(h)
            all_h = np.empty((steps, pages, HIDDEN), np.float32)
            inner = xs[..., d * 4 * HIDDEN : (d + 1) * 4 * HIDDEN]
            trace = []
            for t in range(steps):
                z = inner[t] + h @ self.u[d]
                gates = 1 / (1 + np.exp(-np.clip(z, -15, 15)))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 3 * HIDDEN :]
                g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
                m = ms[t][:, None]
                c2 = f * c + i * g
                tc = np.tanh(c2)
                h2 = o * tc
                if keep is not None:
                    trace.append((h, c, i, f, g, o, tc, m))
                h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
                all_h[t] = h
            hs.append(all_h if d == 0 else all_h[::-1])
            if keep is not None:
                keep.append(trace)
        both = np.concatenate(hs, 2)
        if keep is not None:
            keep.append(both)
        return 1 / (1 + np.exp(-np.clip(both @ self.out + self.bias, -30, 30)))

    def label(self, pages: Iterable[list[Block]]) -> list[np.ndarray]:
        """Probabilities of each page's blocks; pages of like length are read side by side."""
        inner = [np.concatenate([self.into(vectors(p, lo, lo + STEPS)) for lo in range(0, len(p) or 1, STEPS)]) for p in pages]
        got: list[np.ndarray] = [np.zeros(0)] * len(inner)
        order = sorted((k for k in range(len(inner)) if len(inner[k])), key=lambda k: len(inner[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and len(inner[order[hi]]) * (hi + 1 - lo) <= TOGETHER:
                hi += 1
            x, mask = padded([inner[k] for k in order[lo:hi]])
            p = self.forward(x, mask)
            for j, k in enumerate(order[lo:hi]):
                got[k] = p[: len(inner[k]), j]
            lo = hi
        return got


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = 1
    return x, mask


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """Cross entropy by back-propagation through time, Adam steps."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    net = Labeller([f32(INPUT, 4 * HIDDEN, by=0.1) for _ in (0, 1)], [f32(HIDDEN, 4 * HIDDEN, by=0.2) for _ in (0, 1)], [bias.copy(), bias.copy()], f32(2 * HIDDEN, by=0.2), 0.0)
    params = [*net.w, *net.u, *net.b, net.out]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        for lo in range(0, len(order), 24):
            some = order[lo : lo + 24]
            x, mask = padded([pages[k] for k in some])
            y = np.zeros_like(mask)
            for j, k in enumerate(some):
                y[: len(labels[k]), j] = labels[k]
            keep: list = []
            p = net.forward(net.into(x), mask, keep)
            both = keep[2]
            d = (p - y) * mask / mask.sum()
            grads_w, grads_u, grads_b = [], [], []
            g_out, g_bias = np.einsum("tp,tph->h", d, both), float(d.sum())
            for side in (0, 1):
                xs, trace = x if side == 0 else x[::-1], keep[side]
                dh_all = d[:, :, None] * net.out[side * HIDDEN : (side + 1) * HIDDEN]
                dh_all = dh_all if side == 0 else dh_all[::-1]
                dh = np.zeros_like(trace[0][0])
                dc = np.zeros_like(dh)
                dz_all = np.empty((len(trace), dh.shape[0], 4 * HIDDEN), np.float32)
                gu = np.zeros_like(net.u[side])
                for t in range(len(trace) - 1, -1, -1):
                    h, c, i, f, g, o, tc, m = trace[t]
                    dh = dh + dh_all[t]
                    dh2, dc2 = dh * m, dc * m + dh * m * o * (1 - tc * tc)
                    dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dc2 * i * (1 - g * g), dh2 * tc * o * (1 - o)], 1)
                    dz_all[t] = dz
                    gu += h.T @ dz
                    dh, dc = dz @ net.u[side].T + dh * (1 - m), dc2 * f + dc * (1 - m)
                grads_w.append(xs.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN))
                grads_u.append(gu)
                grads_b.append(dz_all.sum((0, 1)))
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 5e-4
            for q, g, mo in zip(params, [*grads_w, *grads_u, *grads_b, g_out], moments):
                g = np.clip(g, -1, 1)
                mo[0] = 0.9 * mo[0] + 0.1 * g
                mo[1] = 0.999 * mo[1] + 0.001 * g * g
                q -= (rate * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.bias -= rate * g_bias
    return net


#: Classes that say nothing of what an element is for.
NEUTRAL = "row container container-fluid col-md-8 col-sm-12 col-lg-9 col-xs-6 wrapper inner outer d-flex justify-content-between align-items-center p-3 mb-4 mt-auto grid grid__item block region layout-main layout__inner u-clearfix js-track w-full max-w-screen-lg md:flex section-inner is-wide has-bg".split()


def made_up_page(rng: random.Random, deep: bool | None = None) -> tuple[str, list[str]]:
    """A page and the blocks of its article; in a deep one (half of them, if not said) wrappers of many classes stand around and in each part."""
    deep = rng.random() < 0.5 if deep is None else deep
    word = lambda: "".join(rng.choice("aabcdeefghiilmnooprsttuvéüñ") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    pick = rng.choice
    article: list[str] = []

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(n))

    def noise(kind: str) -> str:
        if kind == "menu":
            tag = pick(["nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"'])
            return f"<{tag}>{wrapped(f'<ul>{links(rng.randint(2, 8))}</ul>')}</{tag.split()[0]}>"
        if kind == "header":
            tag = pick(["header", 'div class="header"', 'div id="site-header"', 'div class="masthead"'])
            within = pick(["h1", "p", "div"])
            return f"<{tag}>{wrapped(f'<{within}>{words(1, 5)}' + f'</{within}>' * deep)}</{tag.split()[0]}>"
        if kind == "footer":
            tag = pick(["footer", "footer", 'div class="footer"', 'div id="page-footer"', 'div class="copyright"'])
            return f"<{tag}>{wrapped(pick(['&copy; ', '', '<p>']) + words(2, 30))}</{tag.split()[0]}>"
        if kind == "ad":
            tag = pick(['div class="ad"', 'div class="ads banner"', 'div class="advert"', 'aside class="promo"', 'div id="ad-1"', 'div class="sponsored"'])
            return f"<!-- ad --><{tag}>{wrapped(pick(['', '<p>', '<a href=x>']) + words(2, 25) + '.')}</{tag.split()[0]}>"
        if kind == "notice":
            tag = pick(['div class="cookie notice"', 'div class="cookie-banner"', 'div role="alert"', 'div class="consent"', 'div class="notice"', 'div class="newsletter"'])
            return f"<{tag}>{wrapped(f'<p>{words(4, 25)}.</p><button>{word()}</button>')}</{tag.split()[0]}>"
        if kind == "form":
            return f"<form class='{pick(['search', 'login', 'subscribe'])}'><p>{words(1, 8)}</p><label>{words(1, 3)}</label><input><button>{word()}</button></form>"
        if kind == "side":
            tag = pick(["aside", 'div class="sidebar"', 'aside class="related"', 'div class="widget"', 'section class="related-posts"'])
            body = pick([f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{words(5, 30)}.</p>"])
            return f"<{tag}>{wrapped(f'<h3>{words(1, 3)}</h3>{body}')}</{tag.split()[0]}>"
        tag = pick(['section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="discussion comments"'])
        each = "".join(f"<{pick(['div', 'li', 'article'])} class='comment'>{wrapped(f'<p>{words(3, 30)}.</p>')}" for _ in range(rng.randint(1, 5)))
        return f"<{tag}>{wrapped(f'<h3>{words(1, 3)}</h3>{each}')}</{tag.split()[0]}>"

    def wrapped(inner: str, most: int = 5) -> str:
        if not deep:
            return inner
        count = rng.randint(0, most)
        made = lambda: pick(NEUTRAL) if rng.random() < 0.9 else f"{word()}-{word()}"
        opened = "".join(f"<div class='{' '.join(made() for _ in range(rng.randint(1, 5)))}'>" for _ in range(count))
        return opened + inner + "</div>" * count

    def own(text: str) -> str:
        article.append(text)
        return text

    def body() -> str:
        out = [f"<h1>{own(words(2, 10))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            end = pick(["", ".", ".", "."])
            if kind < 0.66:
                if rng.random() < 0.2:
                    out.append(f"<p><b>{own(words(1, 60) + end)}<br>")
                else:
                    out.append(wrapped(f"<p>{own(words(1, 70) + end)}</p>", 3))
            elif kind < 0.74:
                out.append(f"<h{pick('234')}>{own(words(1, 6))}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{own(words(2, 14))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{own(words(4, 30) + end)}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table><tr>" + "".join(f"<td>{own(words(1, 4))}</td>" for _ in range(rng.randint(2, 6))) + "</tr></table>")
            elif kind < 0.95:
                out.append(f"<pre>{own(words(3, 20))}</pre>")
            else:
                out.append(noise(pick(["ad", "side", "notice"])))
        return "".join(out)

    before = [noise(k) for k in ("notice", "header", "menu", "ad", "form") if rng.random() < 0.55]
    after = [noise(k) for k in ("ad", "comments", "side", "menu", "form") if rng.random() < 0.4] + [noise("footer")] * (rng.random() < 0.85)
    tag = pick(["article", "article", "article", "main", 'div class="content"', 'div class="entry-content"', 'div id="article-body"', 'div class="post"'])
    inner = f"<{tag}>{wrapped(body())}</{tag.split()[0]}>" if rng.random() < 0.96 else ""
    rng.shuffle(before)
    page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{wrapped(''.join(before) + wrapped(inner) + ''.join(after))}"
    return page + "</body></html>" * (rng.random() < 0.9), article


@lru_cache(maxsize=1)
def learn(count: int = PAGES) -> Labeller:
    rng = random.Random(23)
    pages, labels = [], []
    while len(pages) < count:
        page, article = made_up_page(rng)
        found = blocks(page)
        mine = set(article)
        if found:
            pages.append(vectors(found))
            labels.append(np.array([b.text in mine for b in found], np.float32))
    return train(pages, labels)


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    out: list[str] = []
    held: list[list[Block]] = []

    def read() -> None:
        out.extend(" ".join(b.text for b, p in zip(page, ps) if p >= 0.5) for page, ps in zip(held, net.label(held)))
        held.clear()

    for page in pages:
        held.append(blocks(page or ""))
        if sum(map(len, held)) >= TOGETHER // 2:
            read()
    read()
    return out


def extract(pages: DataFrame, net: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    batches(pages.sparkSession)
    net = net or learn()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            texts = main_texts(batch.column("html").to_pylist(), net)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
