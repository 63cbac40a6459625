"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once per worker, by encoding each of them. Which places of a text no
piece spans is proved from the vocabulary too: no piece has a space mark after another character, and none mixes Latin letters
with other characters. Merges never cross such a place, so a text's count is the sum over its pre-tokens: one for a proven
string, found by a dictionary look-up, and a merge by the library for the rest only, remembered while memory allows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take_memory, text_batches

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Merged pre-tokens that a worker remembers, besides the proven ones.
CACHE_WORDS = 800_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_merged long"

SPACE = "▁"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PRE = re.compile(f"{SPACE}*[{LETTER}]+|{SPACE}*[^{LETTER}{SPACE}]+|{SPACE}+")
#: A character that is in no piece; it parts what is encoded in one call, and keeps the leading space mark from it.
_GUARD = "\0"


class TokenCounter:
    """Number of tokens of whole texts, without begin or end, as sentencepiece counts them."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit = cache_words
        self.guard = self.sp.encode(_GUARD)[-1]
        self.proven, self.separable = self._prove()
        self.counts: dict[str, int] = dict.fromkeys(self.proven, 1)
        self.merged: dict[str, int] = {}

    def _prove(self) -> tuple[frozenset[str], bool]:
        """Pieces that encode alone as themselves; whether every boundary of ``_PRE`` is one that no piece spans."""
        sp = self.sp
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        mixed = re.compile(f"[^{SPACE}]{SPACE}|[{LETTER}][^{LETTER}]|[^{LETTER}{SPACE}][{LETTER}]|{_GUARD}")
        separable = not any(map(mixed.search, pieces)) and sp.encode(f"a {SPACE}", out_type=str)[-1:] == [SPACE * 2]
        return frozenset(p for p, n in zip(pieces, self._merge(pieces), strict=True) if n == 1), separable

    def _merge(self, pre: list[str]) -> list[int]:
        """Tokens of each pre-token, by the library, from few calls: a character that is in no piece parts them."""
        out: list[int] = []
        for i in range(0, len(pre), 2000):
            own = pre[i : i + 2000]
            if any(_GUARD in p for p in own):
                out += [len(ids) - 2 for ids in self.sp.encode([_GUARD + p for p in own], num_threads=1)]
                continue
            ids = np.array(self.sp.encode(_GUARD + _GUARD.join(own)))
            at = np.flatnonzero(ids == self.guard)
            out += (np.diff(at, append=len(ids)) - 1).tolist()
        return out

    def __call__(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens that had to be merged)."""
        if not text:
            return 0, 0
        if not self.separable:
            return len(self.sp.encode(text)), 1
        pre = _PRE.findall(SPACE + text.replace(" ", SPACE))
        got = list(map(self.counts.get, pre))
        rest = [p for p, n in zip(pre, got, strict=True) if n is None] if None in got else []
        if not rest:
            return sum(got), 0
        new = [p for p in set(rest) if p not in self.merged]
        if len(self.merged) + len(new) > self.limit:
            self.merged.clear()
            new = list(set(rest))
        self.merged.update(zip(new, self._merge(new), strict=True))
        return len(pre) - len(rest) + sum(map(self.merged.__getitem__, rest)), len(rest)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document; ``over_limit`` where there are more than ``limit``; ``n_merged``: pre-tokens merged.

    A null text counts as empty: no bytes, no tokens. One row out per row in, so repeated rows stay; a null id stays null; other
    columns are ignored. Nothing is shuffled, and a worker's memory is bounded by its two dictionaries and one text.
    """

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("tokens", counter.cache_clear)
        count = counter(model)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([x for x, _ in n], pa.int64()),
                    pa.array([x > limit for x, _ in n], pa.bool_()),
                    pa.array([m for _, m in n], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_merged"],
            )

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(worker, SCHEMA)
