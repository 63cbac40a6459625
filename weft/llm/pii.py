"""Personal data by weak supervision.

Base patterns give spans that always stay. Beside them, candidate spans (tokens that might identify a person or give access to an
account) get votes from labelers: patterns, gazetteers and context words, each of which says yes, says no or abstains. How often each
combination of votes occurs is counted over all documents; expectation-maximisation over these counts estimates each labeler's
reliability without labels. Its posteriors, on a bounded sample of candidates, train a logistic classifier of spans, which adds
those it finds likely.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, text_batches

#: Bound of the sample of candidates that the span classifier is trained on, in all and for each combination of votes.
SAMPLE_CANDIDATES, SAMPLE_EACH = 20_000, 200
#: Parts in which a combination's candidates are thinned out first.
PARTS = 64
ROUNDS = 60
THRESHOLD = 0.5

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

# The base kinds and their patterns, in order.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A text without one of these has no span of the kind: a cheap test before the pattern.
_NEEDS = {"email": "@", "phone": "+"}
_DIGIT = re.compile("[0-9]")
_NON_DIGIT = re.compile("[^0-9]+")
_LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
#: Numbers that single dots join. Each begins where no digit is before, and nothing is tried twice, so a long run of digits is read once.
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _accepted(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in text.split("."))
    if kind == "card":
        digits = _NON_DIGIT.sub("", text)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(_NON_DIGIT.sub("", text)) <= 15
    return True


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind in _NEEDS:
        if _NEEDS[kind] not in text:
            return
    elif kind == "card" and not _LONG_NUMBER.search(text) or kind == "ip" and not _DOTTED.search(text):
        return
    if kind == "ip":  # the matches of a chain are its numbers, four by four
        for m in _CHAIN.finditer(text):
            ends = [m.start() - 1, *(m.start() + k for k, c in enumerate(m[0]) if c == "."), m.end()]
            for k in range(0, len(ends) - 4, 4):
                yield ends[k] + 1, ends[k + 4]
        return
    if kind != "email":
        for m in BASE[kind].finditer(text):
            yield m.span()
        return
    # A match's name part is what lies before an @, back to the first other character or the end of the last match: the same
    # spans as finditer, without trying every place of a long text.
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and _EMAIL_RUN.match(text[lo - 1]):
            lo -= 1
        m = BASE["email"].match(text, lo) if lo < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start: leftmost matches of each kind that don't overlap; failing ones are dropped."""
    return [(k, a, b) for k in BASE for a, b in _matches(k, text) if _accepted(k, text[a:b])]


# Candidates: assignments of secrets, keys, account numbers, numbers in groups, handles, addresses, and names after a title or with a known first name.
# kind -> (a part that each match holds, for a quick search before; the pattern). Where matches of two kinds overlap, the one that begins first counts, of equal
# beginnings the kind that comes first here.
_PATTERNS = {
    "assigned": (re.compile("[=:]"), re.compile(r"\b[A-Za-z_]{2,20}[ ]?[=:][ ]?[\"']?[A-Za-z0-9+/_.@-]{6,}[\"']?")),
    "account": (re.compile("[A-Z]{2}[0-9]{2}"), re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b")),
    "key": (re.compile("[A-Z][A-Z0-9]{11}"), re.compile(r"\b(?=[A-Z0-9]*[0-9])[A-Z][A-Z0-9]{11,}\b")),
    "hex": (re.compile("[0-9a-f]{16}"), re.compile(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{16,}\b")),
    "address": (
        re.compile("[0-9][ ][A-Z]|[a-zà-ÿ],?[ ][0-9]"),
        re.compile(
            r"\b[0-9]{1,5}[ ][A-Z][a-z]{2,20}(?:[ ][A-Z][a-z]{2,20})?[ ](?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Ct|Square|Way)\b"
            r"|\b[A-ZÄÖÜ][a-zäöüß]{2,25}(?:straße|strasse|weg|platz|allee|gasse)[ ][0-9]{1,4}[a-z]?\b"
            r"|\b(?:[Rr]ue|[Cc]alle|[Aa]venida|[Pp]laza|[Aa]venue|[Vv]ia)[ ](?:(?:de|del|la|du|des)[ ]){0,2}[A-ZÀ-Þ][a-zà-ÿ]{2,20},?[ ][0-9]{1,4}\b"
        ),
    ),
    "number": (re.compile("[0-9][ -][0-9]"), re.compile(r"\b[0-9]{2,4}(?:[ -][0-9]{2,6}){1,4}\b")),
    "identity": (re.compile("[0-9]{8}-?[A-Z]"), re.compile(r"\b[0-9]{8}-?[A-Z]\b")),
    "handle": (re.compile("@"), re.compile(r"(?<!\S)@[A-Za-z0-9_]{3,30}\b")),
    "name": (None, re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme|Mlle)\.?[ ])?[A-ZÀ-Þ][a-zà-ÿ]{1,20}(?:[ ][A-ZÀ-Þ][a-zà-ÿ]{1,20}){1,6}\b")),
}
#: Kinds whose matches hold a digit.
_WITH_DIGIT = frozenset("account key hex address number identity".split())
_CAPITALISED = re.compile("[A-ZÀ-Þ][a-zà-ÿ]+")
_ALNUM = re.compile(r"[A-Za-z0-9]")
# Gazetteers of the words that name a secret or a person's number, of those that name something else, and of those around a person's name.
_SECRET_WORDS = frozenset("password passwd pwd token secret apikey api_key access_key auth bearer credential pin passcode clave passwort kennwort".split())
_PERSON_WORDS = frozenset("phone tel telephone mobile call fax ssn passport account iban id konto telefon compte tarjeta social security insurance licence dni nif patient employee".split())
_OTHER_WORDS = frozenset("version page pages isbn issn vol no figure fig table section chapter year years http https license line lines v part room born since until".split())
_NAME_WORDS = frozenset("name named signed sincerely regards dear contact patient customer employee author called by from attn nombre nom".split())
_TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Sr Sra Mme Mlle".split())
# Common first names of four languages.
_FIRST_NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Kevin Brian George Edward Peter Henry Jack Oliver Harry "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Laura Emma Olivia Alice Anna Jane Kate Helen "
    "Hans Klaus Jürgen Wolfgang Uwe Stefan Andreas Matthias Tobias Florian Lukas Jonas Felix Greta Heike Ursula Monika Sabine Petra Claudia Katharina Ingrid Lena "
    "José Juan Antonio Manuel Francisco Javier Carlos Miguel Alejandro Pedro Pablo Diego Luis María Carmen Josefa Isabel Dolores Pilar Lucía Elena Marta Sofía "
    "Jean Pierre Michel André Philippe Jacques Bernard Alain Claude Nicolas Julien Antoine Louis Marie Jeanne Françoise Monique Catherine Nathalie Isabelle Sylvie Camille Chloé Manon".split()
)
_KEY_HEADS = ("AKIA", "ASIA", "AIZA", "SK", "PK", "GH", "XOX")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ -][0-9]{1,2}(?:[ -][0-9]{1,2})?$|(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2}$|[0-9]{1,2}-[0-9]{1,2}-(?:19|20)[0-9]{2}$")
_SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
_DIALLED = re.compile(r"\+[0-9][0-9 ().-]*$")
_WORD_BEFORE = re.compile(r"([A-Za-z_]+)[^A-Za-z_]{0,4}$")

KINDS = tuple(_PATTERNS)
#: Kinds of added spans by kind of candidate.
ADDED = {"assigned": "secret", "key": "secret", "hex": "secret", "account": "account", "address": "address", "identity": "number", "number": "number", "handle": "handle", "name": "name"}
LABELERS = ("shape", "head", "gazetteer", "context", "entropy", "not_date", "checksum")
FEATURES = len(KINDS) + len(LABELERS) * 2 + 4


def _named(m: re.Match) -> tuple[int, int] | None:
    """The part of a run of capitalised words from a title or known first name on."""
    words = [(w[0].rstrip("."), m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m[0])]
    known = next((k for k, (w, _, _) in enumerate(words[:-1]) if w in _TITLES or w in _FIRST_NAMES), None)
    if known is None:
        return None
    return words[known][1], words[min(known + (3 if words[known][0] in _TITLES else 2), len(words)) - 1][2]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that labelers vote on, besides those that overlap a base span."""
    digits, found = _DIGIT.search(text), []
    for place, (kind, (part, pattern)) in enumerate(_PATTERNS.items()):
        if kind == "name":
            seen = _CAPITALISED.findall(text)
            if not (_TITLES.isdisjoint(seen) and _FIRST_NAMES.isdisjoint(seen)):
                found += [(*span, place) for span in map(_named, pattern.finditer(text)) if span]
        elif (digits or kind not in _WITH_DIGIT) and part.search(text):
            found += [(m.start(), m.end(), place) for m in pattern.finditer(text)]
    if not found:
        return []
    found.sort(key=lambda x: (x[0], x[2]))
    spans: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in taken):  # joined where they overlap
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, at, end = [], 0, 0
    for a, b, place in found:
        if a < end:
            continue
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if at == len(spans) or spans[at][0] >= b:
            out.append((KINDS[place], a, b))
            end = b
    return out


def _remainder(account: str) -> int:
    """Of an account number in the international form, by 97: 1 in a right one."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """One of 1 (personal), -1 (not) and 0 (abstains) from each of ``LABELERS``."""
    span = text[a:b]
    before = _WORD_BEFORE.search(text[max(0, a - 40) : a])
    prior = before[1].lower() if before else ""
    name, _, value = re.split(r"([=:])", span, maxsplit=1) if kind == "assigned" else ("", "", span)
    name, value = name.strip().lower(), value.strip(" \"'")
    has_digit, has_alpha = bool(_DIGIT.search(value)), any(c.isalpha() for c in value)
    shape = 1 if kind in ("key", "hex", "address", "account") or kind == "assigned" and has_digit and has_alpha and len(value) >= 10 else -1 if kind == "assigned" and not has_digit else 0
    head = 1 if value.upper().startswith(_KEY_HEADS) and len(value) >= 16 and has_digit and kind in ("key", "assigned") else 0
    if kind == "name":
        words = value.replace(".", "").split()
        gazetteer = 1 if any(w in _FIRST_NAMES for w in words[:-1]) else 0
        head = 1 if words[0] in _TITLES else 0
        context = 1 if prior in _NAME_WORDS else 0
    else:
        gazetteer = 1 if name in _SECRET_WORDS or name in _PERSON_WORDS else -1 if name in _OTHER_WORDS else 0
        context = 1 if prior in _SECRET_WORDS or prior in _PERSON_WORDS or _DIALLED.search(text[max(0, a - 20) : a]) else -1 if prior in _OTHER_WORDS else 0
    e = _entropy(value)
    entropy = 0 if kind in ("name", "address") else 1 if e >= 3.2 and has_digit and len(value) >= 12 else -1 if e < 2.2 else 0
    digits = _NON_DIGIT.sub("", value)
    date = 0 if kind != "number" else -1 if _DATE.search(value) else 1 if len(digits) in (9, 10) else 0
    checksum = 0
    if kind == "account":
        checksum = 1 if _remainder(value.replace(" ", "")) == 1 else -1
    elif kind == "identity":
        checksum = 1 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == value[-1] else -1
    elif kind == "number" and len(digits) == 9:
        checksum = 1 if _SOCIAL.match(value) else 0
    return shape, head, gazetteer, context, entropy, date, checksum


def features(text: str, kind: str, a: int, b: int, v: tuple[int, ...]) -> list[float]:
    span = text[a:b]
    n = len(span)
    digits = len(_DIGIT.findall(span))
    return (
        [float(kind == k) for k in KINDS]
        + [float(x == y) for x in v for y in (1, -1)]
        + [min(n, 60) / 60, digits / n, len(_ALNUM.findall(span)) / n, _entropy(span) / 6]
    )


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]]]:
    """Expectation-maximisation over counts of vote combinations: (share of personal spans, for each labeler how likely each
    vote is given a personal and another span). The prior counts keep a labeler better than chance."""
    m = len(LABELERS)
    share, tables = 0.5, [({1: 0.5, 0: 0.4, -1: 0.1}, {1: 0.1, 0: 0.4, -1: 0.5}) for _ in range(m)]
    total = sum(patterns.values())
    if not total:
        return share, tables
    strength = 0.02 * total + 1
    for _ in range(rounds):
        post = {v: posterior(v, share, tables) for v in patterns}
        yes = sum(n * post[v] for v, n in patterns.items())
        share = (yes + 1) / (total + 2)
        new = []
        for j in range(m):
            pair = []
            for side, prior in ((1, {1: 0.5, 0: 0.4, -1: 0.1}), (0, {1: 0.1, 0: 0.4, -1: 0.5})):
                mass = {x: strength * p for x, p in prior.items()}
                for v, n in patterns.items():
                    mass[v[j]] += n * (post[v] if side else 1 - post[v])
                s = sum(mass.values())
                pair.append({x: y / s for x, y in mass.items()})
            new.append(tuple(pair))
        tables = new
    return share, tables


def posterior(v: tuple[int, ...], share: float, tables: list) -> float:
    """Probability that a span with these votes is personal. Without a yes from any labeler it is not."""
    if 1 not in v:
        return 0.0
    z = math.log(share) - math.log(1 - share) + sum(math.log(t[0][x]) - math.log(t[1][x]) for x, t in zip(v, tables, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on posteriors as soft labels; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(y) + decay * w)
    return w


def learn(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE_CANDIDATES) -> np.ndarray:
    """Weights of the span classifier. Vote combinations (at most 3 ** labelers) are counted over all documents; the classifier
    is trained on at most ``sample`` candidates: of each combination, ``SAMPLE_EACH`` or fewer, those with the smallest hashes, whatever the order of rows."""
    each = SAMPLE_EACH

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        held: dict[tuple, dict[int, list[float]]] = {}
        for b in batches:
            for x in b.column(0):
                text = x.as_py() or ""
                for kind, lo, hi in candidates(text, base_spans(text)):
                    v = votes(text, kind, lo, hi)
                    counts[v] += 1
                    own = held.setdefault(v, {})
                    h = int.from_bytes(hashlib.blake2b(f"{kind}:{text[max(0, lo - 20) : hi]}".encode(), digest_size=7).digest(), "big")
                    if h not in own and (len(own) < each or h < max(own)):
                        own[h] = features(text, kind, lo, hi, v)
                        if len(own) > each:
                            del own[max(own)]
        rows = [(",".join(map(str, v)), counts[v] if i == 0 else 0, h, f) for v in counts for i, (h, f) in enumerate(held[v].items())]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["v", "n", "h", "f"])

    seen = materialize(text_batches(docs).select(F.col(text_col).cast("string").alias("text")).mapInArrow(worker, "v string, n long, h long, f array<double>"), "pii-votes")
    patterns = {tuple(map(int, r[0].split(","))): r[1] for r in seen.groupBy("v").agg(F.sum("n")).collect()}
    each = max(1, min(each, sample // max(len(patterns), 1)))
    by_hash = Window.partitionBy("v").orderBy("h", "f")
    # In two steps, since workers send so many of each combination: no task sees more than the smallest of each part of a combination.
    by_part = Window.partitionBy("v", F.pmod("h", F.lit(PARTS))).orderBy("h", "f")
    rows = seen.select("v", "h", "f").withColumn("k", F.row_number().over(by_part)).where(F.col("k") <= each).select("v", "h", "f")
    rows = rows.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= each).select("v", "h", "f").collect()
    discard(seen)
    if not rows:
        return np.zeros(FEATURES + 1) - 1.0
    share, tables = estimate(patterns)
    rows.sort()
    y = [posterior(tuple(map(int, r[0].split(","))), share, tables) for r in rows]
    return train(np.array([r[2] for r in rows]), np.array(y))


def find(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts of base spans, a digest of them, and all spans of every document: ``kind:start:end`` in code points, end exclusive.

    Added spans have the kind ``secret`` (assignments, keys, hexadecimal strings), ``account``, ``number`` (groups of digits, identity numbers), ``name``, ``address`` or
    ``handle`` and come after the base ones. A null text counts as empty. One row out per row in, repeated rows included; a null id stays null; other columns
    are ignored; nothing is shuffled.
    """

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for x in b.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                added = []
                for kind, lo, hi in candidates(text, base):
                    v = votes(text, kind, lo, hi)
                    if 1 in v:
                        z = float(np.dot(w[:-1], features(text, kind, lo, hi, v)) + w[-1])
                        if 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) >= threshold:
                            plain = kind == "hex" and not any(map(str.isalpha, text[lo:hi]))
                            added.append(("number" if plain else ADDED[kind], lo, hi))
                n = Counter(k for k, _, _ in base)
                line = ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in base)
                rest = ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in sorted(added))
                row = (*(n[k] for k in BASE), hashlib.sha256(line.encode()).hexdigest(), ",".join(filter(None, (line, rest))), len(added))
                for c, value in zip(cols, row, strict=True):
                    c.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    own = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(worker, SCHEMA)
