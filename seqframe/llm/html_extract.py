"""Main text of HTML pages by a recurrent block labeller.

A page is read tag by tag into blocks (the text between two block-level boundaries) in page order. Each block is a vector
of its tag path (tags, classes and ids of all open elements, hashed), of its words (hashed, the mean of learned vectors) and of
a few numbers (length, share of link text, place). A bidirectional LSTM in numpy reads the sequence of a page's blocks and gives
each the probability to be main text with the whole page as context; blocks of more than a half are kept.

The labeller is trained on the driver, once for a seed, on pages made by rule (`made_page`): articles of varied markup among menus,
headers, footers, sidebars, notices, adverts, forms and reader comments, whose labels are known as they are made. No page of
the input is trained on. Weights are a few hundred kB and are broadcast.

Text of script, style, head and the like is never a block. Character references are decoded; white space inside a block becomes one space; blocks
are joined by a line feed. <br> is white space inside its block.

Quoted attribute values may have any length and hold >.

Time and memory are in proportion to a page. Pages are read in groups of GROUP_CHARS characters (a longer one alone), and
the network runs over pages of like length, CELLS blocks at once (or one page).

Defined cases: a null or empty page, or one without main text, has an empty text. Unclosed and stray tags are put up with;
an unclosed comment, script or style lasts to the page's end. Repeated rows and null ids are returned as they are; an
empty table gives an empty result. Other columns are left out unless in `keep`.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column
from .words import words

PATHS, WORDS, WORD_SIZE, NUMBERS, HIDDEN = 2048, 1024, 6, 6, 16
PAGES, PASSES, BATCH, RATE, SEED = 900, 8, 20, 0.012, 5
GROUP_CHARS, CELLS = 1 << 21, 1 << 14
#: A comment, declaration or the head of a tag; a tag's end is found by TagEnds.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)""", re.S)
SPECIAL = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
# Element names of HTML.
RAW = frozenset("script style title textarea noframes noembed iframe xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}


def _hash(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


class TagEnds:
    """Where a tag of the page ends: at the first > outside quoted values, of any length; if there is none, at the first > of all.

    Time is linear in the page: a scan that finds no end leaves its places in `failed`, where later ones stop, and no two scans
    cross the same stretch of a quoted value unless the first found its end.
    """

    def __init__(self, page: str, last: int):
        self.page, self.last = page, last
        self.failed: set[int] = set()

    def after(self, at: int) -> int:
        seen = []
        place = at
        while m := SPECIAL.search(self.page, place, self.last):
            place = m.start()
            if m[0] == ">":
                return place + 1
            if place in self.failed:
                break
            seen.append(place)
            place = self.page.find(m[0], place + 1, self.last) + 1
            if not place:
                break
        self.failed.update(seen)
        return self.page.index(">", at) + 1


class Blocks:
    """A page's blocks: text, path features, characters inside links."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.paths: list[tuple[int, ...]] = []
        self.links: list[int] = []
        self._path: tuple[int, ...] = ()
        self._parts: list[str] = []
        self._filled = False
        self._linked = 0
        self._read(page)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.texts.append(text)
                self.paths.append(self._path)
                self.links.append(self._linked)
            self._parts, self._linked, self._filled = [], 0, False

    def _read(self, page: str) -> None:
        stack: list[tuple[str, frozenset[int]]] = [("", frozenset())]
        open_: Counter[str] = Counter()
        at, last = 0, page.rfind(">") + 1  # no tag ends later: a search never runs on in vain
        ends = TagEnds(page, last)
        while at < len(page):
            m = TAG.search(page, at, last) if at < last else None
            if m is None or m.start() > at:
                raw = page[at : m.start() if m else len(page)]
                if not open_["head"]:
                    text = html.unescape(raw)
                    if text.strip():
                        if not self._filled:
                            self._path, self._filled = tuple(sorted(stack[-1][1])), True
                        if open_["a"]:
                            self._linked += len(text)
                    self._parts.append(text)
            if m is None:
                break
            at = ends.after(m.end()) if m[2] else m.end()
            if page.startswith("<!--", m.start()) and page[at - 3 : at] != "-->":
                break  # an unclosed comment
            name = (m[2] or "").lower()
            if not name:
                continue
            if name not in INLINE:
                self._flush()
            elif name == "br":
                self._parts.append(" ")
            if m[1]:
                if open_[name]:
                    while True:
                        top = stack.pop()[0]
                        open_[top] -= 1
                        if top == name:
                            break
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in VOID:
                continue
            if name == "body" and open_["head"]:
                while stack[-1][0] != "head":
                    open_[stack.pop()[0]] -= 1
                open_[stack.pop()[0]] -= 1
            closed = "p" if name not in INLINE and open_["p"] else CLOSES.get(name)
            if closed and open_[closed] and closed in [s[0] for s in stack[-6:]]:
                while stack[-1][0] != closed:
                    open_[stack.pop()[0]] -= 1
                open_[stack.pop()[0]] -= 1
            found = {_hash(name, PATHS)}
            inside = page[m.end() : at - 1]
            for kind, *values in NAMES.findall(inside) if "=" in inside else ():
                for word in re.findall(r"[a-z]+", "".join(values).lower()):
                    found.add(_hash(f"{'role' if kind.lower() == 'role' else ''}.{word}", PATHS))
            above = stack[-1][1]
            stack.append((name, above if found <= above else above | found))
            open_[name] += 1
        self._flush()


def features(pages: list[Blocks]):
    """Path ids end to end and their bounds by block; mean word vectors' ids likewise; numbers; block bounds by page."""
    sizes = np.cumsum([0, *(len(p.texts) for p in pages)])
    ids = np.array([i for p in pages for path in p.paths for i in (*path, PATHS)], np.int64)
    bounds = np.cumsum([0, *(len(path) + 1 for p in pages for path in p.paths)])
    raw = [t.encode() for p in pages for t in p.texts]
    w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    length = np.array([len(t) for p in pages for t in p.texts], np.float32)
    linked = np.array([n for p in pages for n in p.links], np.float32)
    place = np.concatenate([np.arange(len(p.texts)) / max(1, len(p.texts) - 1) for p in pages]) if len(length) else length
    stop = np.array([t[-1] in ".!?" for p in pages for t in p.texts], np.float32)
    n_words = np.diff(w.first)
    numbers = np.stack([np.log1p(length) / 6, np.minimum(linked / np.maximum(length, 1), 1), place, stop, np.log1p(n_words) / 5, np.ones(len(length))], 1).astype(np.float32) if len(length) else np.zeros((0, NUMBERS), np.float32)
    return ids, bounds, (w.hashes % np.uint64(WORDS)).astype(np.int64), w.first, numbers, sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """path: (PATHS + 1) x 8H; word: WORDS x WORD_SIZE; word_in: WORD_SIZE x 8H; number: NUMBERS x 8H; two recurrent H x 4H; out."""

    def __init__(self, seed: int = SEED):
        rng, h = np.random.default_rng(seed), HIDDEN
        shapes = ((PATHS + 1, 8 * h), (WORDS, WORD_SIZE), (WORD_SIZE, 8 * h), (NUMBERS, 8 * h), (2, h, 4 * h), (2 * h + 1,))
        self.params = [(rng.normal(0, 0.1, s)).astype(np.float32) for s in shapes]

    def inputs(self, feats):
        """What reaches the gates from each block itself: blocks x 8H, and the mean word vectors."""
        ids, bounds, word_ids, word_bounds, numbers, _ = feats
        path, word, word_in, number = self.params[:4]
        z = np.zeros((len(numbers), path.shape[1]), np.float32)
        for a in range(0, len(z), 4096):  # rows of `path` are wide: gathered for some blocks at a time
            ends = bounds[a : a + 4097]
            z[a : a + 4096] = np.add.reduceat(path[ids[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)
        sums = np.zeros((len(numbers), WORD_SIZE), np.float32)
        some = np.flatnonzero(np.diff(word_bounds))
        if len(some):
            sums[some] = np.add.reduceat(word[word_ids], word_bounds[some], axis=0) / np.diff(word_bounds)[some, None]
        return z + sums @ word_in + numbers @ number, sums

    def _walk(self, z: np.ndarray, mask: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """States of one direction; z: pages x steps x 4H."""
        w, h_size = self.params[4][direction], HIDDEN
        h = np.zeros((len(z), h_size), np.float32)
        c = h.copy()
        out = np.zeros((*z.shape[:2], h_size), np.float32)
        for t in range(z.shape[1]) if direction == 0 else range(z.shape[1] - 1, -1, -1):
            gates = z[:, t] + h @ w
            s = _sigmoid(gates[:, : 3 * h_size])
            i, f, o, g = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :], np.tanh(gates[:, 3 * h_size :])
            m = mask[:, t, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[:, t] = h
        return out

    def _pad(self, z: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        n = np.diff(sizes)[rows]
        steps = np.arange(max(1, n.max(initial=0)))
        mask = steps < n[:, None]
        index = np.where(mask, sizes[:-1][rows][:, None] + steps, 0)
        return z[index], mask, index

    def score(self, pages: list[Blocks], most: int = 64, cells: int = CELLS) -> list[np.ndarray]:
        """A probability for each block of each page. Pages of like length are run together: at most `most`, and `cells` blocks unless it is one page."""
        feats = features(pages)
        sizes = feats[-1]
        z, _ = self.inputs(feats)
        out = np.zeros(len(z))
        order = np.argsort(np.diff(sizes), kind="stable")
        order = order[np.diff(sizes)[order] > 0]
        lengths, at = np.diff(sizes)[order], 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < most and (to + 1 - at) * lengths[to] <= cells:
                to += 1
            rows, at = order[at:to], to
            padded, mask, index = self._pad(z, sizes, rows)
            h = 4 * HIDDEN
            both = np.concatenate([self._walk(padded[:, :, :h], mask, 0), self._walk(padded[:, :, h:], mask, 1)], axis=2)
            p = _sigmoid(both @ self.params[5][:-1] + self.params[5][-1])
            out[index[mask]] = p[mask]
        return [out[a:b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

    def gradients(self, feats, labels: np.ndarray) -> list[np.ndarray]:
        ids, bounds, word_ids, word_bounds, numbers, sizes = feats
        h = HIDDEN
        z, sums = self.inputs(feats)
        padded, mask, index = self._pad(z, sizes, np.arange(len(sizes) - 1))
        kept: tuple[list, list] = ([], [])
        both = np.concatenate([self._walk(padded[:, :, d * 4 * h : (d + 1) * 4 * h], mask, d, kept[d]) for d in (0, 1)], axis=2)
        p = _sigmoid(both @ self.params[5][:-1] + self.params[5][-1])
        d_out = np.where(mask, p - labels[index], 0) / mask.sum()
        grads = [np.zeros_like(x) for x in self.params]
        grads[5][:-1] = np.einsum("bt,bth->h", d_out, both)
        grads[5][-1] = d_out.sum()
        d_both = d_out[:, :, None] * self.params[5][:-1]
        d_z = np.zeros((len(z), 8 * h), np.float32)
        for d in (0, 1):
            w = self.params[4][d]
            d_h, d_c = np.zeros((len(mask), h), np.float32), np.zeros((len(mask), h), np.float32)
            for t, h_old, c_old, i, f, o, g, tc, m in reversed(kept[d]):
                d_h = d_h + d_both[:, t, d * h : (d + 1) * h]
                dh, dc = np.where(m, d_h, 0), np.where(m, d_c, 0)
                dc = dc + dh * o * (1 - tc * tc)
                gates = np.concatenate([dc * g * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                grads[4][d] += h_old.T @ gates
                rows = index[:, t][mask[:, t]]
                d_z[rows, d * 4 * h : (d + 1) * 4 * h] += gates[mask[:, t]]
                d_h, d_c = np.where(m, gates @ w.T, d_h), np.where(m, dc * f, d_c)
        np.add.at(grads[0], ids, d_z[np.repeat(np.arange(len(z)), np.diff(bounds))])
        grads[2], grads[3] = sums.T @ d_z, numbers.T @ d_z
        d_sums = d_z @ self.params[2].T
        n_words = np.diff(word_bounds)
        np.add.at(grads[1], word_ids, (d_sums / np.maximum(n_words, 1)[:, None])[np.repeat(np.arange(len(z)), n_words)])
        return grads


# Fixed values for the made pages: class names that are common on the web.
MAIN = "content article post entry story body text main single blog document copy prose detail".split()
ASIDE = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs pagination topbar toc tabs links".split(), "header": "header masthead site head logo branding top tagline".split(), "footer": "footer foot bottom copyright legal colophon imprint".split(), "aside": "sidebar side widget related recommended trending popular archive aside rail".split(),
    "notice": "cookie consent banner notice alert gdpr privacy popup modal newsletter subscribe paywall".split(), "ad": "ad ads advert advertisement sponsor sponsored promo promoted commercial teaser".split(), "form": "form search login signup contact feedback poll".split(), "comment": "comment comments reply replies discussion respond thread disqus reactions".split(), "share": "share social follow sharing buttons tools".split(),
}


def made_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page by rule, and for each of its blocks whether it is main text."""
    labels: list[int] = []
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "ing", "ou", "le", "de", "st", "ch", "en", "ver", "ión", "que", "aux", "lo", "mi", "ta", "ä", "é"]
    pick = lambda x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p

    def text(n: int) -> str:
        out = " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(n))
        if chance(0.15):
            out = out.upper() if chance(0.3) else out.replace(" ", pick(["!! ", "*** ", "%%% ", " | ", ", "]))
        return out[:1].upper() + out[1:] + pick([".", ".", ".", "", "!"])

    def names(words_: list[str]) -> str:
        return pick(["class", "class", "class", "id"]) + '="' + " ".join(pick(words_) + pick(["", "", "-box", "-1", "_wrap", " block", "-area", "-list"]) for _ in range(int(rng.integers(1, 3)))) + '"'

    def block(tag: str, n: int, label: int, inner: str = "") -> str:
        labels.append(label)
        body = inner or text(n)
        if chance(0.15):
            body = f"<{(t := pick(['b', 'em', 'span', 'a', 'strong', 'i']))}>{body}</{t}>"
        close = f"</{tag}>" if tag not in ("p", "li") or chance(0.8) else ""
        return f"<{tag}>{pick(['', '<b>']) if chance(0.1) else ''}{body}{'<br>' if chance(0.05) else ''}{close}"

    def off(kind: str) -> str:
        n = int(rng.integers(1, 6))
        if kind in ("nav", "share") or (kind in ("aside", "footer", "header") and chance(0.4)):
            inner = "<ul>" + "".join(block("li", int(rng.integers(1, 4)), 0, f'<a href="/{i}">{text(int(rng.integers(1, 4)))}</a>') for i in range(n)) + "</ul>"
        elif kind == "form":
            inner = "".join(block(pick(["p", "div", "legend"]), int(rng.integers(1, 6)), 0) + '<input name="q">' for _ in range(n))
        elif kind == "ad" and chance(0.6):
            labels.append(0)
            inner = text(int(rng.integers(2, 25)))
        elif kind == "footer" and chance(0.5):
            labels.append(0)
            inner = "&copy; " + text(int(rng.integers(1, 25)))
        else:
            inner = "".join(block(pick(["p", "p", "div", "h3", "h4", "li"]), int(rng.integers(2, 40)), 0) for _ in range(n))
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if own and chance(0.6):
            return f"<{own}{' ' + names(ASIDE[kind]) if chance(0.5) else ''}>{inner}</{own}>"
        return f"<{(t := pick(['div', 'div', 'section']))} {names(ASIDE[kind])}>{inner}</{t}>"

    def article() -> str:
        tag, own = pick([("article", ""), ("article", ""), ("article", names(MAIN)), ("main", ""), ("div", names(MAIN)), ("div", names(MAIN)), ("section", names(MAIN))])
        out = [block("h1", int(rng.integers(2, 12)), 1)] if chance(0.8) else []
        again = text(int(rng.integers(1, 12))) if chance(0.15) else ""
        for _ in range(int(rng.integers(1, pick([3, 10, 10, 20, 50])))):
            out.append(block(pick(["p"] * 12 + ["h2", "h3", "li", "blockquote", "pre", "div"]), int(rng.integers(1, pick([4, 12, 40, 120]))), 1, again if chance(0.7) else ""))
            if chance(0.06):
                out.append(off(pick(["ad", "share", "aside", "notice", "comment", "form"])))
        if chance(0.1):
            out.append(off("comment"))
        return f"<{tag} {own}>{''.join(out)}</{tag}>"

    parts = [off(pick(["nav", "header", "notice", "ad", "share"])) for _ in range(int(rng.integers(0, 4)))]
    if chance(0.6):
        parts.insert(0, off("nav"))
    if chance(0.96):
        wrap = chance(0.3)
        parts.append((f"<div {names(MAIN)}>" if wrap else "") + article() + ("</div>" if wrap else ""))
    parts += [off(pick(["aside", "comment", "footer", "ad", "share", "form", "nav"])) for _ in range(int(rng.integers(0, 4)))]
    if chance(0.6):
        parts.append(off("footer"))
    return f"<!DOCTYPE html><html><head><title>{text(4)}</title><script>var a='<p>';</script></head><body>{''.join(parts)}</body></html>", labels


@lru_cache(4)
def trained(seed: int = SEED, n_pages: int = PAGES, passes: int = PASSES) -> Labeller:
    rng = np.random.default_rng(seed)
    made = []
    while len(made) < n_pages:
        page, labels = made_page(rng)
        blocks = Blocks(page)
        if len(blocks.texts) == len(labels) and labels:
            made.append((blocks, np.array(labels, np.float32)))
    net = Labeller(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params]
    turn = 0
    for epoch in range(passes):
        order = rng.permutation(len(made))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            grads = net.gradients(features([made[i][0] for i in rows]), np.concatenate([made[i][1] for i in rows]))
            turn += 1
            rate = RATE * (1 - 0.9 * epoch / passes)
            for param, grad, (m, v) in zip(net.params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.005 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.995**turn)) + 1e-8)
    return net


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), net: Labeller | None = None) -> DataFrame:
    """The columns in `keep`, text, n_chars: a row for each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(net or trained())
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    out = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes, at = np.cumsum([0, *(len(t or "") for t in column(whole, "__html").to_pylist())]), 0
            while at < whole.num_rows:
                to = max(at + 1, min(at + 200, int(np.searchsorted(sizes, sizes[at] + GROUP_CHARS, "right")) - 1))
                batch, at = whole.slice(at, to - at), to
                read = [Blocks(t or "") for t in column(batch, "__html").to_pylist()]
                texts = ["\n".join(t for t, p in zip(page.texts, marks.tolist(), strict=True) if p > 0.5) for page, marks in zip(read, shared.value.score(read), strict=True)]
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return source.mapInArrow(run, out)
