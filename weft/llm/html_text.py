"""Main text of web pages by a maximum-scoring run of words and tags.

A page is one sequence of tags and words. Tags score negative, by their name. Words score what a linear model says of where they
stand: the elements around them with their classes, and the length, links and punctuation of their block; in running text that
is positive, in what looks like a menu, form, notice or comment it is negative. All weights are fitted on labelled pages (``html_labels``,
at most ``html_labels.PAGES``). A linear scan finds the run with the highest sum, which is the content region. Between its first and
last content, blocks whose words score clearly negative are left out (an advert or form between two paragraphs); the ends are the scan's alone.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .html_labels import MARK, labelled_pages

SCHEMA = "page_id long, url string, text string, n_chars long"

# HTML elements by role.
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
# What a p element ends with.
_ENDS_P = BLOCKS - {"br", "body", "button", "html", "head", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "legend", "summary", "title"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDED = re.compile(r"[.!?:;…。！？][\"'”’»)]*\s*$")

#: Weight of the squared weights against the labelled words, and bound of a word's score.
RIDGE, LARGEST = 1.0, 6.0
#: Words that score less than this between content are left out.
CUT = -1.0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) in page order: kind is open, close or text; what raw elements hold, comments and declarations are left
    out. Where a page breaks off within a tag, so does the tag; a lone ``<`` is text."""
    at, raw = 0, ""
    ends: dict[str, int] = {}  # where the next end tag of a raw element is, as far as looked for

    def has_end(name: str) -> bool:
        if ends.get(name, -1) < at:
            m = re.compile(rf"</{name}", re.I).search(page, at)
            ends[name] = m.start() if m else len(page) + 1
        return ends[name] <= len(page)

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if raw:
            if not (m[1] and m[2].lower() == raw):
                continue
            raw = ""
        elif m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
            else:
                yield "open", name, m[3]
                if name in RAW and not m[3].endswith("/"):
                    # an element that is never closed holds the rest of the page, unless it is one whose end is often left out
                    raw = name if name in ("script", "style", "textarea") or has_end(name) else ""
        elif m[0] == "<":
            yield "text", "", "<"
    if not raw and at < len(page):
        yield "text", "", page[at:]


@functools.lru_cache(maxsize=4096)
def element_features(name: str, attributes: str) -> tuple[str, ...]:
    """What the model knows of an element: its name, each word of its class, id and role, and the letters in them."""
    out = {"<" + name}
    for m in _ATTRIBUTE.finditer(attributes):
        value, which = m[2] or m[3] or m[4] or "", m[1].lower()
        if which == "hidden" or which == "aria-hidden" and value.lower() == "true":
            out.add("hidden")
        elif which in ("class", "id", "role"):
            for word in value.split():
                out.add("." + word.lower())
                out.update("~" + p.lower() for p in _PART.findall(word))
    return tuple(sorted(out))


class Block(NamedTuple):
    """Text between two block tags, in lines that ``br`` parts."""

    around: object  # what the elements around it come to
    own: tuple[str, ...]
    n: int  # words
    text: str  # as in the page, with line feeds only where br stands


def _own_features(tag: str, n: int, linked: int, text: str) -> tuple[str, ...]:
    size = 0 if n < 3 else 1 if n < 6 else 2 if n < 11 else 3 if n < 21 else 4 if n < 41 else 5
    share = 0 if not linked else 1 if 3 * linked < n else 2 if 3 * linked < 2 * n else 3
    return (f"in {tag}", f"words {size}", f"links {share}", "ended" if _ENDED.search(text[-8:]) else "open")


class _Weights:
    """Sum of the weights of the features that hold in the elements around, each counted once."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.held, self.total = weights, Counter(), 0.0

    def enter(self, features: tuple[str, ...]) -> None:
        for f in features:
            if f in self.weights:
                self.held[f] += 1
                if self.held[f] == 1:
                    self.total += self.weights[f]

    def leave(self, features: tuple[str, ...]) -> None:
        for f in features:
            if f in self.weights:
                self.held[f] -= 1
                if not self.held[f]:
                    self.total -= self.weights[f]

    def now(self) -> object:
        return self.total


class _Features(_Weights):
    """The features themselves, for the fit."""

    def __init__(self):
        self.held = Counter()

    def enter(self, features: tuple[str, ...]) -> None:
        self.held.update(features)

    def leave(self, features: tuple[str, ...]) -> None:
        self.held.subtract(features)

    def now(self) -> object:
        return tuple(f for f, n in self.held.items() if n > 0)


def read(page: str, around: _Weights) -> Iterator[str | Block]:
    """Names of tags and blocks of text, in page order. Each element is entered and left once, so the work is linear."""
    opened: list[tuple[str, tuple[str, ...]]] = []
    counts: Counter[str] = Counter()
    own: list[str] = []
    n = linked = 0

    def leave() -> str:
        name, features = opened.pop()
        counts[name] -= 1
        around.leave(features)
        return name

    def flush() -> Iterator[Block]:
        nonlocal n, linked
        text = "".join(own)
        own.clear()
        if n:
            tag = next((t for t, _ in reversed(opened[-8:]) if t in BLOCKS), "body")
            words = max(n, len(text) // 12)  # some languages don't part words
            yield Block(around.now(), _own_features(tag, words, linked, text), words, text)
        n = linked = 0

    for kind, name, text in tokens(page):
        if kind == "text":
            text = html.unescape(_SPACE.sub(" ", text))
            own.append(_SPACE.sub(" ", text))
            k = len(text.split())
            n += k
            linked += k if counts["a"] else 0
            continue
        if name == "br":
            own.append("\n")
            yield name
            continue
        if name in BLOCKS:
            yield from flush()
        if kind == "open":
            if name in _ENDS_P and counts["p"]:
                while opened[-1][0] != "p" and opened[-1][0] not in BLOCKS:
                    leave()
                if opened[-1][0] == "p":
                    leave()
            if name not in VOID and not text.endswith("/"):
                features = element_features(name, text)
                opened.append((name, features))
                counts[name] += 1
                around.enter(features)
        elif counts[name]:
            while leave() != name:
                pass
        yield name
    yield from flush()


class Model(NamedTuple):
    bias: float
    words: dict[str, float]
    tags: dict[str, float]

    def score(self, b: Block) -> float:
        """Weight of each word of a block."""
        z = self.bias + b.around + sum(self.words.get(f, 0.0) for f in b.own)
        return max(-LARGEST, min(LARGEST, z))


def fit(pages: list[str], ridge: float = RIDGE) -> Model:
    """Weights from labelled pages: of words by penalised logistic regression on their blocks (each weighs up to 20 words), of tags by the log odds that
    one of its name lies in the article, kept under zero."""
    index: dict[str, int] = {}
    rows, y, size = [], [], []
    inside, outside = Counter(), Counter()
    for page in pages:
        items = list(read(page, _Features()))
        marked = [i for i, x in enumerate(items) if isinstance(x, Block) and MARK in x.text]
        for i, x in enumerate(items):
            if isinstance(x, Block):
                rows.append([index.setdefault(f, len(index)) for f in (*x.around, *x.own)])
                y.append(MARK in x.text)
                size.append(min(x.n, 20))
            else:
                (inside if marked and marked[0] <= i <= marked[-1] else outside)[x] += 1
    n, m = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 1) / (n + 1)) - math.log((outside[k] + 1) / (m + 1)) for k in inside | outside}
    x = np.zeros((len(rows), len(index) + 1))
    x[:, -1] = 1
    for i, own in enumerate(rows):
        x[i, own] = 1
    y, size = np.array(y, float), np.array(size, float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(12):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (size * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        w += np.linalg.solve(h, x.T @ (size * (y - p)) - penalty * w)
    return Model(float(w[-1]), {f: float(w[i]) for f, i in index.items()}, {k: min(v, 0.0) - 0.05 for k, v in odds.items()})


@functools.lru_cache(maxsize=1)
def model() -> Model:
    return fit(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """First of the runs with the highest sum, as (start, end); empty if nothing is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def extract(page: str | None, by: Model | None = None) -> str:
    """The main text: white space within a block is one space, blocks are joined by one line feed."""
    if not page:
        return ""
    by = by or model()
    items = list(read(page, _Weights(by.words)))
    least = min(by.tags.values())
    weights = [by.score(x) if isinstance(x, Block) else 0.0 for x in items]
    start, end = best_run([x.n * w if isinstance(x, Block) else by.tags.get(x, least / 2) for x, w in zip(items, weights, strict=True)])
    content = [i for i in range(start, end) if weights[i] > 0]
    out: list[str] = []
    for i in range(start, end):
        if isinstance(items[i], Block) and not (content and content[0] < i < content[-1] and weights[i] < CUT):
            out += filter(None, (_SPACE.sub(" ", line).strip() for line in items[i].text.split("\n")))
    return "\n".join(out)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page and its number of code points; one row out per row in.

    Null or empty html has an empty text. A page that breaks off counts as far as it goes; one without any word that scores positive has no text. Pages of any length are
    read whole, and reading, scoring and the scan are linear. Null ids and urls stay null, repeated rows stay; other columns are ignored, an empty table stays empty.
    """
    by = model()  # fitted once, on the driver

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [extract(x.as_py(), by) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = text_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(worker, SCHEMA)
