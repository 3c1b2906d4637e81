"""Main text of HTML pages: a bidirectional LSTM in numpy labels the page's leaf blocks, each in the light of all others.

A page becomes the sequence of its leaf blocks: the runs of text between tags that start or end a block, with the path of the
elements around each.  A block's vector holds all hashed path parts (tags, and words of class, id and role; once with the near ones weighing most,
once alike), all its hashed words and a few figures (length, share of link text, place, signs).  Two LSTMs read the sequence in either direction; a logistic layer
on both states gives the chance that a block belongs to the article.

Training.  A bounded sample of pages is labelled by their own mark-up (blocks in an element that names an article are text,
unless an element between says otherwise; pages without one are left out), and each sampled page is set again in several made-up layouts that have the same words in
other elements (named divisions, side columns, forms, notices, comments), so that the network learns from names and
neighbours, too, not from one tag.  Weights start from a fixed seed and the sample is chosen by hash.

Defined cases.  A null page is empty; one without blocks has empty text.  Mark-up that isn't closed or nested properly is read
as browsers do for paragraphs, list items and heads (a head ends where something stands that can't be in one), and otherwise closed with its parent; a tag that never ends is text.  What stands in script, style, head and
like elements and in comments is no text.  Any length of page is read whole.  Repeated rows are judged one by one; a null id
or url is carried through.  Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from customsloom.llm.common import blocks as text_blocks
from customsloom.llm.common import tokenise

#: Elements that start and end a block.  Fixed values.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text.  Fixed values.
HIDDEN = set("head script style noscript template title svg iframe object canvas audio video textarea".split())
#: Elements that may stand in a head; any other, and text, ends it.  Fixed values.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag of the key closes an open element of the value.  Fixed values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose content is read up to their end tag, whatever stands in it.  Fixed values.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style textarea title noscript template iframe".split()}
#: Elements that an end tag of an inline element doesn't reach beyond.  Fixed values.
SCOPE = set("td th table body article section div".split())
_TAG = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
_NAMED = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")

#: Words in tags, classes, ids and roles that mark what isn't the article, for the labels of the training sample.
ASIDE = set(
    "nav navigation menu menubar breadcrumb breadcrumbs header masthead banner footer foot sidebar aside complementary notice alert cookie cookies consent ad ads advert advertisement sponsor sponsored promo "
    "form search login signup subscribe newsletter comment comments reply replies respond share social related recommended popup modal".split()
)
#: A part's weight in the first sum of a path falls by this factor for each element between it and the block.
NEAR = 0.6
PATH_DIMS, WORD_DIMS, FIGURES = 48, 24, 8
DIMS = 2 * PATH_DIMS + WORD_DIMS + FIGURES
HIDDEN_SIZE = 24
#: Pages of the training sample, and most bytes of one that is in it (longer ones are judged like all others).
SAMPLE_PAGES, SAMPLE_PAGE_BYTES = 160, 1 << 18
LAYOUTS = 4
ROUNDS = 5
#: Blocks of a page that a training sequence has at most; longer sampled pages give several.
TRAIN_BLOCKS = 64
#: Blocks that are worked on at once.
STEP_BLOCKS = 1 << 14


class Element:
    """An element of a page: its own parts (tag, and words of class, id and role), and what follows from those of the elements around."""

    __slots__ = ("around", "own", "depth", "told", "sums")

    def __init__(self, around: Element | None, own: list[str]):
        self.around, self.own, self.depth = around, own, around.depth + 1 if around else 0
        self.told = around.told if around else None  # by the innermost telling part
        for part in own:
            if part in ("article", "main") or part in INSIDE:
                self.told = True
            elif part.removeprefix(".") in ASIDE:
                self.told = False
        self.sums: np.ndarray | None = None

    @classmethod
    def of(cls, parts: list[str]) -> Element | None:
        """Of parts, outermost first; each that isn't a word of a name starts an element."""
        out: Element | None = None
        for k, part in enumerate(parts):
            if not part.startswith("."):
                end = next((j for j in range(k + 1, len(parts)) if not parts[j].startswith(".")), len(parts))
                out = cls(out, parts[k:end])
        return out

    @property
    def parts(self) -> list[str]:
        chain, at = [], self
        while at:
            chain.append(at.own)
            at = at.around
        return [x for own in reversed(chain) for x in own]

    def hashed(self) -> np.ndarray:
        """Sums of all hashed parts: those near count most in the first half, all alike in the second."""
        todo, known = [], self
        while known and known.sums is None:
            todo.append(known)
            known = known.around
        sums = known.sums if known else np.zeros(2 * PATH_DIMS, np.float32)
        for e in reversed(todo):
            sums = np.concatenate([sums[:PATH_DIMS] * NEAR, sums[PATH_DIMS:]])
            for part in e.own:
                at, sign = _part_hash(part)
                sums[at] += sign
                sums[PATH_DIMS + at] += sign
            if e.depth < 1_000 or e.depth % 16 == 0:  # so that a page of one deep nest stays small
                e.sums = sums
        return sums


@dataclass
class Leaf:
    element: Element | None  # the innermost around
    text: str
    linked: int  # characters in links

    @property
    def path(self) -> list[str]:
        """Parts of the elements around, outermost first: tag, or .word for each of its names."""
        return self.element.parts if self.element else []

    @property
    def told(self) -> bool:
        """Whether the innermost telling element around is an article's."""
        return bool(self.element and self.element.told)


def _names(tag: str, attributes: str) -> list[str]:
    out = [tag]
    for _, value in _NAMED.findall(attributes):
        out += [f".{w}" for w in _PART.findall(value.lower())]
    return out


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of a page's tags in order; an end tag's name begins with /, comments and the like have none.

    Every search starts where the last one ended, or isn't made again once it has failed, so the time grows with the page's length.
    """
    at, size, known = 0, len(page), {}

    def find(what: str, start: int) -> int:
        if start > known.get(what, -1) >= 0 or what not in known:
            known[what] = page.find(what, start)
        return known[what]

    while (start := page.find("<", at)) >= 0:
        m = _TAG.match(page, start + 1)
        if m is None:
            if page.startswith("!--", start + 1):
                ends = [e + n for e, n in ((find("-->", start + 2), 3), (find("--!>", start + 4), 4)) if e >= 0]
                at = min(ends, default=size)
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                at = start + 1  # a sign of its own
                continue
            yield start, at, "", ""
            continue
        name, end, close = m[0].lower(), m.end(), -1
        while True:  # to the next > that isn't quoted
            if close < end and (close := find(">", end)) < 0:
                return  # what is left is text
            quote = _QUOTE.search(page, end, close)
            if quote is None:
                break
            other = find(page[quote.start()], quote.end())
            if other < 0:
                break
            end = other + 1
        at = close + 1
        yield start, at, name, page[m.end() : close]
        if name in RAW:
            stop = RAW[name].search(page, at)
            yield (stop.start(), stop.end(), f"/{name}", "") if stop else (size, size, f"/{name}", "")
            at = stop.end() if stop else size


_QUOTE = re.compile("[\"']")


def leaves(page: str | None) -> list[Leaf]:
    """The leaf blocks of a page that have text, in page order."""
    page = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, Element]] = []
    # places in the stack: of each name, of elements that start a block, of those that inline end tags don't reach beyond
    named, of_block, of_scope = {}, [], []
    held: list[str] = []
    linked, hidden, links = 0, 0, 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Leaf(stack[-1][1] if stack else None, text, linked))
            held.clear()
        linked = 0

    def close(to: int):
        nonlocal hidden, links
        while len(stack) > to:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
                of_block.pop()
            if tag in SCOPE:
                of_scope.pop()
            named[tag].pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"
            stack.pop()

    def end_head(by: str):
        """A head without an end tag ends where something stands that can't be in one."""
        if stack and stack[-1][0] == "head" and by not in IN_HEAD:
            close(len(stack) - 1)

    at = 0
    for start, end, name, attributes in tags(page):
        if start > at and not page[at:start].isspace():
            end_head("text")
        if name and name[0] != "/":
            end_head(name)
        if start > at and not hidden:
            held.append(page[at:start])
            linked += links > 0 and start - at
        at = end
        if not name:
            continue
        if name[0] == "/":
            tag = name[1:]
            place = named[tag][-1] if named.get(tag) else -1
            if place >= 0 and (tag in BLOCK or not of_scope or place >= of_scope[-1]):
                close(place)
            if tag in BLOCK:
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if name == "head" and any(tag != "html" for tag, _ in stack[-2:]):
            continue  # a second one
        if name in BLOCK:
            flush()
            if of_block and ((top := stack[of_block[-1]][0]) == "p" or top in CLOSES.get(name, ())):
                close(of_block[-1])  # an open paragraph ends where any block starts, list items at the next
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK and name not in RAW:
            if name == "br":
                held.append(" ")
            continue
        for places, member in ((of_block, name in BLOCK), (of_scope, name in SCOPE), (named.setdefault(name, []), True)):
            if member:
                places.append(len(stack))
        stack.append((name, Element(stack[-1][1] if stack else None, _names(name, attributes))))
        hidden += name in HIDDEN
        links += name == "a"
    if at < len(page) and not page[at:].isspace():
        end_head("text")
    if not hidden and at < len(page):
        held.append(page[at:])
    flush()
    return out


_part_cache: dict[str, tuple[int, float]] = {}


def _part_hash(part: str) -> tuple[int, float]:
    if part not in _part_cache:
        if len(_part_cache) >= 100_000:
            _part_cache.clear()
        h = zlib.crc32(part.encode("utf-8", "surrogatepass"))
        _part_cache[part] = (h % PATH_DIMS, 1.0 if h & 0x10000 else -1.0)
    return _part_cache[part]


def vectors(blocks: list[Leaf], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block, of the blocks from ``first`` on of a page of ``total``."""
    n, total = len(blocks), total or len(blocks)
    out = np.zeros((n, DIMS), np.float32)
    for row, data, offsets in text_blocks(pa.array([b.text for b in blocks], pa.large_string())):
        t = tokenise(data, offsets)
        size, block = np.diff(t.doc_start), t.doc_of
        cell = block * WORD_DIMS + (t.hashes % np.uint64(WORD_DIMS)).astype(np.int64)
        sign = np.where(t.hashes & np.uint64(1 << 40), 1.0, -1.0)
        k = len(offsets) - 1
        sums = np.bincount(cell, sign, k * WORD_DIMS).reshape(k, WORD_DIMS)
        out[row : row + k, 2 * PATH_DIMS : 2 * PATH_DIMS + WORD_DIMS] = sums / (4 * np.sqrt(np.maximum(1, size / 24)))[:, None]
        out[row : row + k, -FIGURES + 1] = np.log1p(size) / 3
        out[row : row + k, -FIGURES + 6] = size
    for i, b in enumerate(blocks):
        size = len(b.text)
        if b.element:
            out[i, : 2 * PATH_DIMS] = b.element.hashed()
        row, words = out[i, -FIGURES:], out[i, -FIGURES + 6]
        row[0], row[2], row[3], row[4], row[5] = np.log1p(size) / 4, b.linked / max(size, 1), (first + i) / total, (total - first - i) / total, b.text[-1] in ".!?…"
        row[6], row[7] = sum(map(b.text.count, "©|·»›")) / max(words, 1), 1.0
    far = out[:, PATH_DIMS : 2 * PATH_DIMS]
    out[:, PATH_DIMS : 2 * PATH_DIMS] = np.sign(far) * np.log1p(np.abs(far))
    return out


#: Words of classes, ids and roles that mark the article, for the labels of the training sample.
INSIDE = {".article", ".main", ".content", ".post", ".entry", ".story"}

_ARTICLE = [["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".post", ".body"], ["section", ".entry", ".content"], ["div", ".article", ".text"], ["div", ".main", ".story"]]
_PLAIN = "row col md lg sm widget box container inner outer wrap wrapper grid flex block item left right top section panel card layout holder area group".split()
_ASIDE_BEFORE = [["nav", "ul", "li"], ["header"], ["div", ".menu", "ul", "li"], ["header", "div", ".masthead"], ["div", ".ad"], ["div", ".cookie", ".notice"], ["aside", ".sidebar"], ["form", ".search"], ["div", ".breadcrumb"], ["div", ".banner", ".alert", "p"]]
_ASIDE_AFTER = [["footer"], ["div", ".footer", "p"], ["section", ".comments", "div", ".comment", "p"], ["div", ".comment", "p"], ["aside", "p"], ["div", ".sidebar", "div"], ["div", ".related", "ul", "li"], ["form", ".newsletter", "p"], ["div", ".advert"], ["div", ".share", ".social"]]


def wrapping(rng: np.random.Generator) -> list[str]:
    """Elements that tell nothing: mostly none, at times a few, at times many, of one to five names each."""
    depth = rng.choice([0, 0, 0, 1, 2, 4, 8])
    return [x for _ in range(depth) for x in (("div", "div", "section", "span")[rng.integers(4)], *(f".{_PLAIN[k]}" for k in rng.permutation(len(_PLAIN))[: rng.integers(0, 6)]))]


def relaid(blocks: list[Leaf], label: np.ndarray, rng: np.random.Generator) -> tuple[list[Leaf], np.ndarray]:
    """The same words in a made-up layout: the article in another element, the rest around and within it, with comments and asides of prose."""
    text = [b for b, y in zip(blocks, label, strict=True) if y]
    rest = [b for b, y in zip(blocks, label, strict=True) if not y]
    out, truth, inner = [], [], []

    outer = wrapping(rng)

    def add(path: list[str], b: Leaf, y: int, linked: bool = False):
        out.append(Leaf(Element.of(["html", "body", *outer, *path, *inner]), b.text, len(b.text) if linked else 0))
        truth.append(y)

    def some(kinds: list[list[str]]):
        nonlocal inner
        for kind in rng.permutation(len(kinds))[: rng.integers(1, 5)]:
            path, inner = kinds[kind], wrapping(rng)
            for _ in range(rng.integers(1, 6) if "li" in path or ".comment" in path else 1):
                pool = rest if rest and rng.random() < 0.6 else text or rest
                if pool:
                    b = pool[rng.integers(len(pool))]
                    add(path, b, 0, linked="li" in path)

    around = [["div", ".page"], ["div"], [], ["div", ".wrapper", "div"]][rng.integers(4)]
    some(_ASIDE_BEFORE)
    start = len(out)
    article, inner = [*around, *_ARTICLE[rng.integers(len(_ARTICLE))], *wrapping(rng)], []
    for i, b in enumerate(text):
        own = b.element.own[0] if b.element and b.element.own[0] in ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "td") else "p"
        if rng.random() < 0.15:
            own = ("h1", "h2", "h3", "li", "li", "blockquote", "pre", "td")[rng.integers(8)]
        add([*article, *(["ul"] if own == "li" else []), own], b, 1)
        if i and rng.random() < 0.06:
            pool = rest or text
            path, inner = [["div", ".ad"], ["aside"], ["div", ".notice"], ["form", "p"], ["figure", ".advert"]][rng.integers(5)], wrapping(rng)
            add([*article, *path], pool[rng.integers(len(pool))], 0)
            inner = []
    if len(out) > start or rest:
        some(_ASIDE_AFTER)
    return out, np.array(truth, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs and a logistic layer."""

    def __init__(self, size: int = HIDDEN_SIZE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = size
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.standard_normal((DIMS + size, 4 * size)) * 0.15).astype(np.float32)
            bias = np.zeros(4 * size, np.float32)
            bias[size : 2 * size] = 1  # of the forget gate
            self.p[f"b{d}"] = bias
        self.p["out"] = (rng.standard_normal(2 * size) * 0.1).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(states of one direction, last state) from a state on; x is (time, batch, dims).  Padding leaves the state as it is."""
        n, zero = self.size, np.zeros((x.shape[1], self.size), np.float32)
        (h, c), out = state or (zero, zero), np.zeros((x.shape[0], x.shape[1], self.size), np.float32)
        own = x @ self.p[f"w{d}"][:DIMS] + self.p[f"b{d}"]
        back = self.p[f"w{d}"][DIMS:]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = own[t] + h @ back
            g = _sigmoid(z[:, : 3 * n])
            i, f, o, a = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new = f * c + i * a
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, a, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        f, _ = self.run(x, mask, "f", keep["f"] if keep else None)
        b, _ = self.run(x, mask, "b", keep["b"] if keep else None)
        both = np.concatenate([f, b], 2)
        if keep:
            keep["both"] = both
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {"f": [], "b": [], "both": None}
        logits = self.logits(x, mask, keep)
        chance, total = _sigmoid(logits), mask.sum()
        loss = -(np.log(np.where(truth > 0, chance, 1 - chance) + 1e-9) * mask).sum() / total
        delta = (chance - truth) * mask / total
        g = {"out": np.einsum("tbh,tb->h", keep["both"], delta), "bias": np.array([delta.sum()], np.float32)}
        outer = delta[:, :, None] * self.p["out"]
        for d, part in (("f", outer[:, :, : self.size]), ("b", outer[:, :, self.size :])):
            w, gw = self.p[f"w{d}"], np.zeros_like(self.p[f"w{d}"])
            gb = np.zeros_like(self.p[f"b{d}"])
            dh_next = np.zeros((x.shape[1], self.size), np.float32)
            dc_next = dh_next
            for t, h, c, i, f, o, a, tanh, m in reversed(keep[d]):
                dh = part[t] + dh_next
                dn = dh * m
                dc = dn * o * (1 - tanh * tanh) + dc_next * m
                z = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dn * tanh * o * (1 - o), dc * i * (1 - a * a)], 1)
                gw[:DIMS] += x[t].T @ z
                gw[DIMS:] += h.T @ z
                gb += z.sum(0)
                dh_next = z @ w[DIMS:].T + dh * (1 - m)
                dc_next = dc * f + dc_next * (1 - m)
            g[f"w{d}"], g[f"b{d}"] = gw, gb
        return float(loss), g


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, parts))
    x, mask = np.zeros((longest, len(parts), DIMS), np.float32), np.zeros((longest, len(parts)), np.float32)
    for j, p in enumerate(parts):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def train(pages: list[str], layouts: int = LAYOUTS, rounds: int = ROUNDS, seed: int = 5) -> Labeller:
    """Adam over the pages as they are and in made-up layouts."""
    rng, data = np.random.default_rng(seed), []
    for page in pages:
        blocks = leaves(page)
        if not blocks:
            continue
        label = np.array([b.told for b in blocks], np.float32)
        if not label.any():
            continue  # its mark-up doesn't tell
        for b, y in [(blocks, label), *(relaid(blocks, label, rng) for _ in range(layouts))]:
            x = vectors(b)
            data += [(x[i : i + TRAIN_BLOCKS], y[i : i + TRAIN_BLOCKS]) for i in range(0, len(b), TRAIN_BLOCKS)]
    model = Labeller()
    if not data:
        return model
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    for r in range(rounds):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][0]) // 8 for i in order], kind="stable")]
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        for g in rng.permutation(len(groups)):
            part = [data[i] for i in groups[g]]
            x, mask = _padded([a for a, _ in part])
            truth = np.zeros(mask.shape, np.float32)
            for j, (_, y) in enumerate(part):
                truth[: len(y), j] = y
            _, grad = model.gradients(x, mask, truth)
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in grad.values()))
            for k, a in grad.items():
                a = a * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                model.p[k] = (model.p[k] - 0.01 * (0.5 ** (r // 2)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list[Leaf]], most: int = STEP_BLOCKS) -> list[np.ndarray]:
    """For each page, which blocks are the article's.  Pages of like length run together, at most about ``most`` blocks at once; longer pages run in steps."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        if len(pages[order[lo]]) > most:
            out[order[lo]] = _label_long(model, pages[order[lo]], most)
            lo += 1
            continue
        hi = lo + 1
        while hi < len(order) and len(pages[order[hi]]) * (hi - lo + 1) <= most:
            hi += 1
        x, mask = _padded([vectors(pages[i]) for i in order[lo:hi]])
        hit = model.logits(x, mask) > 0
        for j, i in enumerate(order[lo:hi]):
            out[i] = hit[: len(pages[i]), j]
        lo = hi
    return out


def _label_long(model: Labeller, page: list[Leaf], most: int) -> np.ndarray:
    """The same, with vectors and states of ``most`` blocks at a time."""
    logits, starts = np.full(len(page), model.p["bias"][0], np.float32), range(0, len(page), most)
    for d, weights in (("f", model.p["out"][: model.size]), ("b", model.p["out"][model.size :])):
        state = None
        for lo in starts if d == "f" else reversed(starts):
            x = vectors(page[lo : lo + most], lo, len(page))[:, None, :]
            states, state = model.run(x, np.ones((len(x), 1), np.float32), d, None, state)
            logits[lo : lo + len(x)] += states[:, 0] @ weights
    return logits > 0


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, page_bytes: int = SAMPLE_PAGE_BYTES) -> Labeller:
    """Trains on the ``sample_pages`` non-empty pages of at most ``page_bytes`` whose hash is least."""
    pages = pages.where(F.octet_length(F.col(html_col)) <= page_bytes)
    key = F.xxhash64(F.col(id_col), F.octet_length(F.col(html_col)))
    picked = pages.where(F.octet_length(F.col(html_col)) > 0).select(key.alias("key"), F.col(id_col).alias("id")).orderBy("key", "id").limit(sample_pages)
    ids = [r["id"] for r in picked.collect() if r["id"] is not None]
    rows = pages.where(F.col(id_col).isin(ids)).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).orderBy("id", "html").limit(sample_pages).collect()
    return train([r["html"] for r in rows])


def runs(b: pa.RecordBatch, at: int, most: int = 4 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``rows`` rows and about ``most`` bytes of column ``at``."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(b.column(at)).to_numpy(zero_copy_only=False).astype(float)))
    lo = 0
    while lo < b.num_rows:
        before = ends[lo - 1] if lo else 0.0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield b.slice(lo, hi - lo)
        lo = hi


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars, n_blocks, n_kept."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in runs(b, 2):
                blocks = [leaves(p) for p in s.column(2).to_pylist()]
                hits = label(shared.value, blocks)
                texts = ["\n".join(x.text for x, y in zip(page, hit, strict=True) if y) for page, hit in zip(blocks, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int32()), pa.array([int(h.sum()) for h in hits], pa.int32())], ["id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    kind = dict(pages.select(id_col).dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extracted, f"id {kind}, url string, text string, n_chars bigint, n_blocks int, n_kept int").withColumnRenamed("id", id_col)


def extract_pages(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
