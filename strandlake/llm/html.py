"""Main text of pages from a recurrent labeller of their blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block's vector
holds the hashed elements of its tag path, its hashed words and some measures. A
bidirectional LSTM in numpy reads the whole sequence of blocks and labels each one as
main text or not, so every decision sees the document on both sides. Paths are kept as
sets of bits that a child takes over from its parent, so deep pages cost no more than
flat ones; pages of very many blocks are read piece by piece with the states carried on.

The labeller is trained on a bounded sample of pages and on pages made from their
blocks with menus, notices, adverts, forms, comments and the like put in. Training
labels come from the names of the elements on a block's path; but in a part of the
training pages the vectors see other names, or plain boxes in place of telling elements too, so that
the labeller learns what main text looks like as well as a list of names.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded, texts_of, tidy

#: Pages that the labeller is trained on, those of the smallest hashes of such as have at most so many characters and blocks; and pages made from them.
SAMPLE = 160
CHARACTERS, BLOCKS = 200_000, 1_000
MADE = 900
#: Blocks from which on a page is read piece by piece.
LONG = 4_096
PATHS, WORDS, EXTRA = 256, 32, 6
HIDDEN = 16
EPOCHS = 20

#: Elements that don't end a block, that hold no text of the page, that have no end tag, and that end an open one.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe", "template"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Names of elements, classes, ids and roles that training takes for other than main text, or for it.
ASIDE_TAGS = ("nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset")
ASIDE_NAMES = (
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget notice cookie cookies consent gdpr alert banner popup modal "
    "ad ads advert adverts advertisement sponsor sponsored promo promotion newsletter subscribe signup login form search comment comments reply replies discussion disqus "
    "related recommended share sharing social pagination pager copyright legal tags toolbar"
).split()
MAIN_NAMES = "article main content post entry story body text".split()

#: Elements of short main text in the pages made for training.
SHORT = (("p",), ("p",), ("p",), ("p",), ("ul", "li"), ("ul", "li"), ("ul", "li"), ("ol", "li"), ("table", "tr", "td"), ("table", "tr", "th"), ("pre",), ("h2",), ("h3",), ("blockquote",), ("dl", "dt"), ("dl", "dd"), ("figure", "figcaption"), ("div",))

#: Elements that training pages show as plain boxes.
TELLING = frozenset((*ASIDE_TAGS, "article", "main", "section", "header", "figure", "details", "summary"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.S)
_APART = re.compile(r"[\s_-]+")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)


class Block(NamedTuple):
    """A leaf block: its text, its path's bits, its innermost element, the share of linked characters, and what the path's names say."""

    text: str
    path: int
    inner: str
    linked: float
    said: bool | None


class Path(NamedTuple):
    """The bits of a path, its innermost block-level element, and what its names say: main text (True), not (False), or nothing (None)."""

    bits: int = 0
    inner: str = ""
    said: bool | None = None

    def into(self, tag: str, names: tuple[str, ...], shown=None) -> Path:
        """The path of a child; its bits are those of what `shown` makes of it."""
        tag_, names_ = shown(tag, names) if shown else (tag, names)
        return Path(self.bits | _bits(tag_, names_), tag_, _said(self.said, tag, names))


def _said(said: bool | None, tag: str, names: tuple[str, ...]) -> bool | None:
    if said is False or tag in ASIDE_TAGS or tag == "header" and not said:
        return False
    if tag not in ("html", "body", "article", "main") and any(n in _ASIDE or n.rstrip("0123456789") in _ASIDE for n in names):
        return False
    return True if tag in ("article", "main") or any(n in MAIN_NAMES for n in names) else said


_ASIDE = frozenset(ASIDE_NAMES)


@lru_cache(50_000)
def _bits(tag: str, names: tuple[str, ...]) -> int:
    out = 0
    for token in (tag, *(f".{n.rstrip('0123456789')}" for n in names)):
        out |= 1 << zlib.crc32(token.encode()) % PATHS
    return out


def disguised(salt: int, boxes: bool):
    """What to show of elements: other names, and with `boxes` no telling elements."""

    def shown(tag: str, names: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
        return ("div" if boxes and tag in TELLING else tag), tuple(f"{zlib.crc32(f'{salt} {n}'.encode()):x}" for n in names)

    return shown


def blocks(page: str, shown=None) -> list[Block]:
    """Each leaf block that isn't blank, in page order. References are decoded and white space within a block becomes one space."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []  # inline elements stand on their parent's path
    solid: list[int] = []  # where the others are
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = silent = links = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = stack[-1][1] if stack else Path()
                out.append(Block(text, path.bits, path.inner, min(1.0, linked / len(text)), path.said))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not silent:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)

    def leave(depth: int) -> None:
        nonlocal silent, links
        for tag, _ in stack[depth:]:
            opened[tag] -= 1
            silent -= tag in SILENT
            links -= tag == "a"
        del stack[depth:]
        while solid and solid[-1] >= depth:
            solid.pop()

    while at < len(page):
        m = _TOKEN.search(page, at)
        say(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if not opened[tag]:
                if tag == "p":
                    close()
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag not in INLINE:
                close()
            depth = len(stack) - 1
            while stack[depth][0] != tag:
                depth -= 1
            leave(depth)
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
                continue
        else:
            close()
            ends = CLOSES.get(tag, ())
            for i in reversed(solid):
                open_ = stack[i][0]
                if open_ == "p" or open_ in ends or open_ in HEADINGS and tag in HEADINGS:
                    leave(i)
                    break
                if not ends or open_ not in ("tbody", "thead"):
                    break
            if tag == "body" and silent:
                leave(next((i for i, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        if tag in VOID or m["rest"].endswith("/"):
            continue
        if tag in RAW:
            # its end tag, then once the bracket that ends that: if there is none here, there is none after a later end tag
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            shut = page.find(">", end.end()) if end else -1
            at = shut + 1 if shut >= 0 else len(page)
            continue
        path = stack[-1][1] if stack else Path()
        if tag not in INLINE:
            names = tuple(w for _, v in _NAMES.findall(m["rest"]) for w in _APART.split(v.strip("\"'").lower()) if w) if "=" in m["rest"] else ()
            solid.append(len(stack))
            path = path.into(tag, names, shown)
        stack.append((tag, path))
        opened[tag] += 1
        silent += tag in SILENT
        links += tag == "a"
    close()
    return out


def labels(page: list[Block]) -> np.ndarray:
    """Training labels: what is named main text if the page has any, else all that isn't named otherwise."""
    some = any(b.said for b in page)
    return np.array([bool(b.said) if some else b.said is None for b in page], float)


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATHS + WORDS + EXTRA))
    if page:
        paths = b"".join((b.path | _bits(f"0{b.inner}", ())).to_bytes(PATHS // 8, "little") for b in page)
        out[:, :PATHS] = np.unpackbits(np.frombuffer(paths, np.uint8), bitorder="little").reshape(-1, PATHS)
    for row, (text, _, _, linked, _) in zip(out, page, strict=True):
        words = text.lower().encode("utf-8", "replace").split() or [b""]
        count = np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS)
        row[PATHS : PATHS + WORDS] = count / np.sqrt((count * count).sum())
        row[PATHS + WORDS :] = (np.log1p(len(text)) / 8, linked, min(1.0, sum(map(text.count, ".,;!?")) / len(words)), min(1.0, len(words) / 50), text[-1:] in ".!?", 1)
    return out


class Labeller:
    """One LSTM for each direction and a logistic layer over both states."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = [rng.normal(0, 0.15, (size + hidden + 1, 4 * hidden)) for _ in range(2)]
        for w in self.w:
            w[-1, hidden : 2 * hidden] = 1.0  # forget gates start open
        self.out = rng.normal(0, 0.15, 2 * hidden + 1)

    def _run(self, w: np.ndarray, x: np.ndarray, keep: list | None, state: list | None = None) -> np.ndarray:
        """States for x (time, pages, size); `state` carries the last one of a piece on to the next."""
        steps, n, size = x.shape
        h, c = state or (np.zeros((n, self.h)), np.zeros((n, self.h)))
        into = (x.reshape(-1, size) @ w[:size] + w[-1]).reshape(steps, n, -1)
        states = np.empty((steps, n, self.h))
        for t in range(steps):
            z = into[t] + h @ w[size:-1]
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * self.h], -30, 30)))
            i, f, o = np.split(gate, 3, 1)
            g = np.tanh(z[:, 3 * self.h :])
            before, c = c, f * c + i * g
            last, h = h, o * np.tanh(c)
            states[t] = h
            if keep is not None:
                keep.append((i, f, o, g, before, c, last))
        if state is not None:
            state[:] = [h, c]
        return states

    def read(self, x: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Both states of every block; x (pages, time, size) is padded."""
        ahead = np.ascontiguousarray(x.transpose(1, 0, 2))
        turn = self.turned(x.shape[1], lengths)
        back = np.take_along_axis(x, turn[:, :, None], 1).transpose(1, 0, 2)
        runs = [[], []] if keep is not None else [None, None]
        a = self._run(self.w[0], ahead, runs[0]).transpose(1, 0, 2)
        b = np.take_along_axis(self._run(self.w[1], back, runs[1]).transpose(1, 0, 2), turn[:, :, None], 1)
        if keep is not None:
            keep += [ahead, back, turn, runs]
        return np.concatenate([a, b], 2)

    @staticmethod
    def turned(steps: int, lengths: np.ndarray) -> np.ndarray:
        """Positions that reverse each page and leave its padding behind."""
        t = np.arange(steps)[None]
        return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            if len(pages[order[at]]) > LONG:
                out[order[at]] = self._long(pages[order[at]])
                at += 1
                continue
            n = 1
            while at + n < len(order) and n < 128 and (n + 1) * len(pages[order[at + n]]) <= 6000:
                n += 1
            part = order[at : at + n]
            lengths = np.array([len(pages[i]) for i in part])
            x = np.zeros((n, lengths.max(), PATHS + WORDS + EXTRA))
            for row, i in zip(x, part, strict=True):
                row[: len(pages[i])] = vectors(pages[i])
            for row, i in zip(self._chance(self.read(x, lengths) @ self.out[:-1]), part, strict=True):
                out[i] = row[: len(pages[i])]
            at += n
        return out

    def _chance(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score + self.out[-1], -30, 30)))

    def _long(self, page: list[Block]) -> np.ndarray:
        """As probabilities(), for one page of any length: vectors and states of LONG blocks at once."""
        score = np.zeros(len(page))
        for k in range(2):
            state = [np.zeros((1, self.h)), np.zeros((1, self.h))]
            pieces = range(0, len(page), LONG)
            for at in pieces if k == 0 else reversed(pieces):
                x = vectors(page[at : at + LONG])[:, None]
                turn = slice(None, None, -1 if k else 1)
                states = self._run(self.w[k], x[turn], None, state)[turn, 0]
                score[at : at + LONG] += states @ self.out[k * self.h : (k + 1) * self.h]
        return self._chance(score)

    def train(self, pages: list[np.ndarray], wanted: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02) -> None:
        params = [*self.w, self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        groups = [order[i : i + 32] for i in range(0, len(order), 32)]
        rng = np.random.default_rng(5)
        step = 0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)).tolist():
                part = groups[g]
                lengths = np.array([len(pages[i]) for i in part])
                x = np.zeros((len(part), lengths.max(), pages[part[0]].shape[1]))
                y = np.zeros(x.shape[:2])
                for r, i in enumerate(part):
                    x[r, : len(pages[i])], y[r, : len(pages[i])] = pages[i], wanted[i]
                there = np.arange(x.shape[1]) < lengths[:, None]
                keep: list = []
                both = self.read(x, lengths, keep)
                p = 1 / (1 + np.exp(-np.clip(both @ self.out[:-1] + self.out[-1], -30, 30)))
                d = np.where(there, p - y, 0) / there.sum()
                grads = self._back(x, d, keep)
                grads.append(np.append((both * d[:, :, None]).sum((0, 1)), d.sum()))
                norm = np.sqrt(sum((q * q).sum() for q in grads))
                step += 1
                for k, (param, q) in enumerate(zip(params, grads, strict=True)):
                    q = q * min(1.0, 1.0 / (norm + 1e-12)) + 1e-5 * param
                    m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.99 * v[k] + 0.01 * q * q
                    param -= rate * (0.1 + 0.9 * (1 - epoch / epochs)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def _back(self, x: np.ndarray, d: np.ndarray, keep: list) -> list[np.ndarray]:
        ahead, back, turn, runs = keep
        size, grads = x.shape[2], []
        for k, (inputs, run) in enumerate(zip((ahead, back), runs, strict=True)):
            w = self.w[k]
            dd = d if k == 0 else np.take_along_axis(d, turn, 1)
            grad = np.zeros_like(w)
            dh, dc = np.zeros((len(d), self.h)), np.zeros((len(d), self.h))
            deltas = np.empty((len(run), len(d), 4 * self.h))
            for t in range(len(run) - 1, -1, -1):
                i, f, o, g, before, c, last = run[t]
                dh = dh + dd[:, t, None] * self.out[k * self.h : (k + 1) * self.h]
                tc = np.tanh(c)
                dc = dc + dh * o * (1 - tc * tc)
                z = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                deltas[t] = z
                grad[size:-1] += last.T @ z
                dh, dc = z @ w[size:-1].T, dc * f
            grad[:size] = inputs.reshape(-1, size).T @ deltas.reshape(-1, 4 * self.h)
            grad[-1] = deltas.sum((0, 1))
            grads.append(grad)
        return grads


def made_pages(pages: list[list[Block]], n: int, seed: int = 3) -> list[list[Block]]:
    """Pages from the blocks of others: their main text under other paths, and named side matter around and within it."""
    rng = np.random.default_rng(seed)
    texts = [b.text for p in pages for b in p]
    mains = [[b for b, y in zip(p, labels(p), strict=True) if y] for p in pages]
    mains = [m for m in mains if m]
    if not mains:
        return []
    sides = [*ASIDE_TAGS, *(f"{t} {n}" for n in ASIDE_NAMES for t in ("div", "section", "ul", "p", "span"))]
    holders = [("article",), ("main",), ("main", "article"), *(("div " + m,) for m in MAIN_NAMES), ("div content", "article"), ("div",), ("div wrapper", "main"), ()]
    out = []
    for number in range(n):
        shown = (None, None, None, None, disguised(number, False), disguised(number, True))[number % 6]
        plain = number % 6 == 5
        top = ("html", "body")
        holder = holders[rng.integers(len(holders))]
        page: list[Block] = []

        def put(text: str, path: tuple[str, ...], linked: float, page=page, shown=shown) -> None:
            at = Path()
            for element in path:
                tag, *names = element.split()
                at = at.into(tag, tuple(names), shown)
            page.append(Block(text, at.bits, at.inner, linked, at.said))

        def side(within: tuple[str, ...], top=top, put=put) -> None:
            element = sides[rng.integers(len(sides))]
            inner = [("p",), ("ul", "li"), ("div",), (), ("h3",), ("div", "p")][rng.integers(6)]
            for _ in range(int(rng.integers(1, 7))):
                text = texts[rng.integers(len(texts))]
                words = text.split()
                short = " ".join(words[: int(rng.integers(1, 4 + len(words) // 2))]) if rng.random() < 0.6 else text
                put(short, (*top, *within, element, *inner), float(rng.random() < 0.5))

        def brief(own: list[Block], holder: tuple[str, ...], top=top, put=put, plain=plain) -> None:
            # lists, tables, code and links are as short in main text as in menus; only among plain boxes are links a sign
            inner = SHORT[rng.integers(len(SHORT))] if rng.random() < 0.7 else ("p",)
            link = float(rng.random() < (0.1 if plain else 0.6))
            for _ in range(int(rng.integers(1, 9))):
                words = own[rng.integers(len(own))].text.split() or ["x"]
                at = int(rng.integers(len(words)))
                put(" ".join(words[at : at + int(rng.integers(1, 13))]), (*top, *holder, *inner), link if rng.random() < 0.8 else float(rng.random()))

        for _ in range(int(rng.integers(0, 5))):
            side(() if rng.random() < 0.7 else ("header",))
        own = mains[rng.integers(len(mains))]
        terse = 0.4 * float(rng.random() < 0.8) if holder else 0.0
        for k, (text, _, last, linked, _) in enumerate(own):
            last = last if last in ("p", "li", "h1", "h2", "h3", "td", "blockquote", "pre", "dd") else "p"
            if rng.random() < 0.1:
                last = ["h2", "li", "blockquote", "pre", "td", "h3", "figcaption", "div", "section"][rng.integers(9)]
            inner = {"li": ("ul", "li"), "td": ("table", "tr", "td"), "figcaption": ("figure", "figcaption")}.get(last, (last,))
            put(text, (*top, *holder, *inner), linked)
            if rng.random() < terse:
                brief(own, holder)
            if holder and k and rng.random() < 0.15:
                side(holder)
        if holder and rng.random() < 0.4:
            side(holder)
        for _ in range(int(rng.integers(0, 5))):
            side(())
        out.append(page)
    return out


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """The labeller, trained on `sample` pages of CHARACTERS and BLOCKS at most; each is seen as it is, and with other names or, every second one, with plain boxes as well."""
    fit = F.length("html").between(1, CHARACTERS)
    rows = bounded(pages).where(fit).select("html", F.xxhash64("url", "page_id").alias("h")).orderBy("h", "html").limit(sample).select("html").toArrow()
    texts = [t.decode() for t in texts_of(rows.column(0))]
    real = [p for p in map(blocks, texts) if 0 < len(p) <= BLOCKS]
    hidden = [blocks(t, disguised(k, k % 2 > 0)) for k, t in enumerate(texts)]
    every = real + [p for p in hidden if 0 < len(p) <= BLOCKS] + made_pages(real, MADE)
    model = Labeller(PATHS + WORDS + EXTRA)
    if every:
        model.train([vectors(p) for p in every], [labels(p) for p in every])
    return model


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    Blocks labelled as main text are joined by two line feeds. Null and empty html, and
    pages without main text, have an empty text. Repeated rows stay; null ids and urls
    stay; other columns are ignored; an empty table gives an empty result. Pages may be of any
    depth and length. The labeller is trained while the result is declared.
    """
    model = train(pages, sample)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                parsed = [blocks(t.decode()) for t in texts_of(b.column(2))]
                found = model.probabilities(parsed)
                texts = ["\n\n".join(block[0] for block, y in zip(p, q.tolist(), strict=True) if y >= 0.5) for p, q in zip(parsed, found, strict=True)]
                yield batch(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
