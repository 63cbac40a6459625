"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is read as its lower-cased runs of letters; each is a sequence of characters between a start and an end mark, and a
model's context stays within it. The models are fitted on a bounded sample of labelled texts. Their n-grams lie in sorted arrays
of 64-bit hashes shared by all languages, with one column of discounted probabilities for each. A text gets the language
with the lowest cross-entropy per character; it is rejected where that is beyond what nearly all texts of this language, kept
out of the fit, had by a margin.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import take_memory, text_batches

ORDER = 4
#: Bound of the sample that the models are fitted on: characters for each language and for all together, and the share of a language's that one text may give;
#: with very many languages each still gets ``LEAST_CHARS``.
SAMPLE_CHARS, TOTAL_CHARS, PIECE, LEAST_CHARS = 1_500_000, 8_000_000, 50, 5_000
#: One of so many sampled texts calibrates the rejection in place of the fit.
CALIBRATE = 5
#: Rejection begins so many nats a character beyond this quantile of the calibration texts' cross-entropies, and further
#: beyond for a short text: its cross-entropy deviates with one over the root of its length.
QUANTILE, MARGIN, SHORT = 0.99, 0.9, 4.0
#: Nats a character to log-odds, for the score.
SHARPNESS = 12.0
UNKNOWN = "und"
#: Scores that a worker remembers: words times languages.
CACHE_SCORES = 400_000
#: Longer runs of letters (no spaces between words) are scored each time, without a place in the memory.
LONG_WORD = 64

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
_WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def hashes(chars: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram of ``order`` characters that ends at each place."""
    h = np.zeros(len(chars), np.uint64)
    for back in range(order - 1, -1, -1):
        c = np.zeros(len(chars), np.uint64)
        c[back:] = chars[: len(chars) - back]
        h = (h ^ (c + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h * np.uint64(8) + np.uint64(order)  # the order tells apart n-grams of different lengths


def laid_out(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each after ``order - 1`` start marks and before an end mark; the word of each place; whether
    the place is to be predicted."""
    text = "".join(START * (order - 1) + w + END for w in words)
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = np.array([len(w) + order for w in words])
    return chars, np.repeat(np.arange(len(words)), n), chars != ord(START)


@dataclass
class Model:
    """Tables by order: sorted hashes, and a column for each language. ``term``: discounted probability of an n-gram;
    ``back``: weight of the lower order after a context."""

    langs: list[str]
    order: int
    floor: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    limits: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def forget(self) -> None:
        self.cache, self.scores = {}, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "scores": None}

    @staticmethod
    def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], keys), max(len(table[0]) - 1, 0))
        if not len(table[0]):
            return np.full((len(keys), table[1].shape[1]), missing)
        out = table[1][at]
        out[table[0][at] != keys] = missing
        return out

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Sum of log probabilities of each word's characters and its end, for each language."""
        chars, owner, wanted = laid_out(words, self.order)
        before = np.concatenate([np.zeros(1, np.uint64), chars[:-1]])
        owner = owner[wanted]
        p = np.broadcast_to(self.floor, (int(wanted.sum()), len(self.langs))).copy()
        for k in range(1, self.order + 1):
            p *= self._look_up(self.contexts[k - 1], hashes(before, k - 1)[wanted], 1.0)
            p += self._look_up(self.grams[k - 1], hashes(chars, k)[wanted], 0.0)
        return np.add.reduceat(np.log(p), np.searchsorted(owner, np.arange(len(words))))

    def score_texts(self, texts: list[list[str]]) -> np.ndarray:
        """Cross-entropy per character of each text's words, for each language; nan without words."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        for lo in range(0, len(texts), 200):
            block = texts[lo : lo + 200]
            new = {w for ws in block for w in ws if w not in self.cache}
            if self.scores is None or len(self.cache) + len(new) > CACHE_SCORES // len(self.langs):
                self.cache, new = {}, {w for ws in block for w in ws}
                self.scores = np.zeros((0, len(self.langs)))
            if new:
                own = sorted(new)
                parts = [self.log_probs(own[i : i + 20_000]) for i in range(0, len(own), 20_000)]
                self.cache.update(zip(own, range(len(self.scores), len(self.scores) + len(own)), strict=True))
                self.scores = np.concatenate([self.scores, *parts])
            for i, ws in enumerate(block, lo):
                if ws:
                    got = self.scores[np.fromiter(map(self.cache.__getitem__, ws), np.int64, len(ws))]
                    out[i] = -got.sum(0) / (sum(map(len, ws)) + len(ws))
        return out

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        own = [words_of(t) for t in texts]
        own = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in own]
        if not self.langs:
            return [(UNKNOWN, 0.0, None, True)] * len(texts)
        ce = self.score_texts(own)
        out = []
        for row, ws in zip(ce, own, strict=True):
            if not ws:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            best = int(row.argmin())
            score = 1.0 / float(np.exp(np.clip((row[best] - row) * SHARPNESS, -700, 0)).sum())
            out.append((self.langs[best], score, float(row[best]), bool(row[best] > self.limits[best] + SHORT / math.sqrt(sum(map(len, ws))))))
        return out


def _tables(counts: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(set().union(*counts)), np.uint64)
    values = np.zeros((len(keys), len(counts)))
    for j, c in enumerate(counts):
        if c:
            k = np.fromiter(c.keys(), np.uint64, len(c))
            values[np.searchsorted(keys, k), j] = np.fromiter(c.values(), float, len(c))
    return keys, values


def _fit_language(words: Counter, order: int, vocabulary: int) -> tuple[float, list[dict], list[dict]]:
    """Interpolated Kneser-Ney over word types with counts: n-gram terms and context weights by order."""
    own = list(words)
    weight = np.array([words[w] for w in own], float)
    chars, owner, wanted = laid_out(own, order)
    grams, contexts = [], []
    higher: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(order, 0, -1):
        h = hashes(chars, k)[wanted]
        ctx = hashes(np.concatenate([np.zeros(1, np.uint64), chars[:-1]]), k - 1)[wanted]
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if higher is None:
            count = np.bincount(inverse, weight[owner[wanted]], len(keys))
        else:  # continuation counts: how many distinct longer n-grams end with it
            count = np.bincount(np.searchsorted(keys, h[higher[0]]), minlength=len(keys)).astype(float)
        higher = (first, count)
        n1, n2 = float((count == 1).sum()), float((count == 2).sum())
        discount = min(max(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.1), 0.9)
        ckeys, cinv = np.unique(ctx[first], return_inverse=True)
        total = np.bincount(cinv, count, len(ckeys))
        kinds = np.bincount(cinv, (count > 0).astype(float), len(ckeys))
        term = np.maximum(count - discount, 0) / total[cinv]
        grams.append(dict(zip(keys.tolist(), term.tolist(), strict=True)))
        contexts.append(dict(zip(ckeys.tolist(), (discount * kinds / total).tolist(), strict=True)))
    return 1.0 / vocabulary, grams[::-1], contexts[::-1]


def fit_model(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """Fit on {language: texts}. Every ``CALIBRATE``-th text of a language sets its rejection limit instead (all, if few)."""
    langs = sorted(samples)
    kept = {g: [t for i, t in enumerate(samples[g]) if len(samples[g]) < CALIBRATE or i % CALIBRATE] for g in langs}
    counts = {g: Counter(w for t in kept[g] for w in words_of(t)) for g in langs}
    langs = [g for g in langs if counts[g]]
    vocabulary = len({c for g in langs for w in counts[g] for c in w}) + 2
    fitted = [_fit_language(counts[g], order, vocabulary) for g in langs]
    model = Model(
        langs,
        order,
        np.array([f[0] for f in fitted]),
        [_tables([f[1][k] for f in fitted]) for k in range(order)] if fitted else [],
        [_with_default([f[2][k] for f in fitted]) for k in range(order)] if fitted else [],
        np.full(len(langs), math.inf),
    )
    for j, g in enumerate(langs):
        texts = [ws for i, t in enumerate(samples[g]) if (i % CALIBRATE == 0 or len(samples[g]) < CALIBRATE) and len(ws := words_of(t)) > 0]
        if texts:
            model.limits[j] = np.nanquantile(model.score_texts(texts)[:, j], QUANTILE) + MARGIN
    model.forget()
    return model


def _with_default(counts: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts: one that a language hasn't seen hands all weight to the lower order."""
    keys, values = _tables(counts)
    for j, c in enumerate(counts):
        seen = np.isin(keys, np.fromiter(c.keys(), np.uint64, len(c)))
        values[~seen, j] = 1.0
    return keys, values


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit the models on labelled texts of ``docs`` that are not held out, for every label that has any.

    The sample is picked by a hash of the id: about ``sample_chars`` characters for each language, less where ``TOTAL_CHARS`` are divided among many, so
    what reaches the driver grows with the languages only. Of a text longer than a fiftieth of that a piece of this length is taken, at a place that its hash says, so a language of long texts
    is learned too. Null ids, texts and labels are left out; repeated rows count as often as they occur; without labels no language is known.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    rows = rows.withColumn("n", F.length("text"))
    # Sums of what texts of each language can give, for pieces of the widest length and of half, a quarter and so on of it.
    widths = [max(1, sample_chars // PIECE >> i) for i in range(12)]
    sizes = {r[0]: r[1:] for r in rows.groupBy("lang").agg(*[F.sum(F.least("n", F.lit(w)).cast("long")) for w in widths]).collect()}
    if not sizes:
        return fit_model({})
    each = max(min(sample_chars, TOTAL_CHARS // len(sizes)), min(sample_chars, LEAST_CHARS))
    at = next((i for i, w in enumerate(widths) if w * PIECE <= each), len(widths) - 1)
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, each / max(n[at], 1)))])
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * float(1 << 30))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.col("n") - widths[at] + 1, F.lit(1))).cast("int") + 1
    picked = picked.select("lang", "id", F.substring(F.col("text"), start, F.lit(widths[at])).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", F.xxhash64("id"), "text").collect():
        samples.setdefault(r[0], []).append(r[2])
    return fit_model(samples)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text; ``und``, score 0 and rejected where it is null or has no letter.

    Only the text is an input of the prediction. One row out per row in, repeated rows included; a null id counts as not held out;
    other columns are ignored; ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("langid", shared.value.forget)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = shared.value.predict_all(part.column(2).to_pylist())
                cols = zip(*got, strict=True)
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                arrays = [part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    own = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(worker, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is rejected: no letters, or unlike every learned language. All columns pass through;
    nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("langid", shared.value.forget)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield part.filter(pa.array([not rejected for *_, rejected in shared.value.predict_all(part.column(at).to_pylist())], pa.bool_()))

    return text_batches(docs).mapInArrow(worker, docs.schema)
