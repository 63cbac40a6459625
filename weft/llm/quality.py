"""Quality rules under weak supervision.

Each rule votes that a text is good or bad, or abstains. How often each combination of votes occurs is counted over all texts;
expectation-maximisation over these counts (at most 3 ** rules of them) estimates without labels how often each rule is right about good
and about bad texts, and a text's posterior probability of being good replaces a filter that all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words

MIN_WORDS = 50
ROUNDS = 50
THRESHOLD = 0.5
#: Belief before the first round: share of good texts, and how often a rule is right; the latter's weight as a share of all texts.
GOOD_SHARE, ACCURACY, PRIOR = 0.8, 0.8, 0.01
#: No rule is taken to be surer than this, of good or of bad texts.
MOST = 0.99

# The characters that count as symbols, a word of running text, and the end of a sentence before the next one.
SYMBOLS = r"[#*$%&|<>]"
PLAIN = r"^[\"'(]?\p{L}[\p{Ll}'-]*[.,;:!?\"')]{0,2}\z"
SENTENCE = r"[.!?][\"')]*[\x20\x09-\x0D]+[\"'(]*\p{Lu}"
CAPITALS = r"\p{Lu}{2,}"

#: name -> (when it votes good, when it votes bad), in whole numbers, so that every engine decides alike; otherwise it abstains.
RULES = {
    "symbols": ("50 * n_symbols <= n_words", "20 * n_symbols >= 3 * n_words"),
    "letters": ("100 * n_letters >= 92 * word_chars", "100 * n_letters <= 80 * word_chars"),
    "word_length": ("10 * word_chars BETWEEN 44 * n_words AND 70 * n_words", "word_chars <= 3 * n_words OR word_chars >= 10 * n_words"),
    "sentences": ("100 * n_sentences BETWEEN 4 * n_words AND 25 * n_words", "100 * n_sentences <= n_words"),
    "prose": ("10 * n_plain >= 9 * n_words", "10 * n_plain <= 6 * n_words"),
    "dup_lines": ("n_lines > 1 AND 20 * n_dup_lines <= n_lines", "10 * n_dup_lines >= 3 * n_lines"),
    "repetition": ("50 * n_repeat_words <= n_words", "10 * n_repeat_words >= 3 * n_words"),
    "upper_case": ("20 * n_upper_runs <= n_words", "10 * n_upper_runs >= 3 * n_words"),
}


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<long>"))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(F.array_sort(F.transform(same, lambda x: x["p"])), covered)

    def count(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(by_hash, repeated))

    return let(hashes, count)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules look at, for every whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain"),
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", let(words(F.col("text")), of_words).alias("w"))
    return rows.select(
        "doc_id",
        "w.n_words",
        "w.word_chars",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        "w.n_repeat_words",
        "w.n_plain",
        (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(CAPITALS)).cast("long").alias("n_upper_runs"),
        F.regexp_count("text", F.lit(SENTENCE)).cast("long").alias("n_sentences"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


def vote_sql(name: str) -> str:
    """1 good, -1 bad, 0 abstains (also where there are no words)."""
    good, bad = RULES[name]
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END"


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good texts, for each rule how often its votes on good texts say good, and those on bad ones bad), by expectation-maximisation
    over counts of vote combinations. A prior of ``PRIOR`` of all texts holds a rule with few votes near ``ACCURACY``."""
    total, n_rules = sum(patterns.values()), len(next(iter(patterns), ()))
    prior = PRIOR * total + 1
    share, right = GOOD_SHARE, [(ACCURACY, ACCURACY)] * n_rules

    def rate(hits: float, votes: float) -> float:
        return min(MOST, max(1 - MOST, (hits + ACCURACY * prior) / (votes + prior)))

    for _ in range(rounds):
        good = {v: n * posterior(v, share, right) for v, n in patterns.items()}
        bad = {v: n - good[v] for v, n in patterns.items()}
        share = (sum(good.values()) + 10 * GOOD_SHARE) / (total + 10)
        right = [
            (
                rate(sum(x for v, x in good.items() if v[j] > 0), sum(x for v, x in good.items() if v[j])),
                rate(sum(x for v, x in bad.items() if v[j] < 0), sum(x for v, x in bad.items() if v[j])),
            )
            for j in range(n_rules)
        ]
    return share, right


def evidence(right: tuple[float, float]) -> tuple[float, float]:
    """Log odds that a good and a bad vote of a rule bring."""
    on_good, on_bad = right
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def posterior(v: tuple[int, ...], share: float, right: list[tuple[float, float]]) -> float:
    """Probability that a text with these votes is good; a rule that abstains says nothing."""
    z = math.log(share / (1 - share))
    for x, r in zip(v, right, strict=True):
        if x:
            z += evidence(r)[0 if x > 0 else 1]
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Measures and verdict of every document: ``kept`` unless the base filter fails or the posterior is under ``threshold``.

    The base fails with fewer than 50 words, or where more than half of the words are in repeated 3-word windows. A null or
    empty text has no words, so it fails. One row out per row in; null ids and repeated rows stay; other columns are ignored.
    Measures are made once, into a table of numbers; votes and the verdict read that.
    """
    rows = materialize(measured(docs, id_col=id_col, text_col=text_col), "quality")
    votes = [F.expr(vote_sql(r)).alias(f"v_{r}") for r in RULES]
    counted = rows.select(*votes).groupBy(*[f"v_{r}" for r in RULES]).count().collect()  # at most 3 ** rules rows
    share, right = estimate(dict(sorted((tuple(r[:-1]), r[-1]) for r in counted)))
    z = F.lit(math.log(share / (1 - share)))
    for name, r in zip(RULES, right or [(ACCURACY, ACCURACY)] * len(RULES), strict=True):
        good, bad = evidence(r)
        v = F.expr(vote_sql(name))
        z = z + F.when(v > 0, good).when(v < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.withColumn("p", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("p") >= threshold)).alias("kept"), F.round("p", 4).alias("quality"),
    )
