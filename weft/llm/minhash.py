"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document is its set of word shingles. Equal sets form a class at once; the rest is about classes. Banded signatures give buckets of
candidates. Within a bucket not all pairs are made: members are held against one member of their part of the bucket, these
against one of the bucket, chosen anew in every band, so a bucket of any size gives as many pairs as it has members. Members of buckets that
are still in different components afterwards are paired by an exact filter on their rarest shingles, so no link is lost and no
group is expanded into all pairs.

A pair is compared signature batch by signature batch; it is dropped as soon as the posterior probability that its similarity
reaches the threshold is under ``MISS``. Survivors are verified on the full sets, made from the texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.components import connected_components

from .common import discard, looked_up, materialize, take_memory, text_batches

SIMILARITY = 80
BANDS, ROWS = 28, 4
#: Signature values compared at a time, and the probability of losing a pair that is allowed at each such step.
BATCH, MISS = 16, 1e-7
#: Parts of a bucket with a member of their own that the others are held against.
PARTS = 32
CACHE_WORDS = 150_000
#: Members of a group for each task that makes its remaining pairs, and the ratio of sizes within a size class.
SPREAD, CLASS = 256, 1.05
#: Pairs of one member for each task that verifies them.
VERIFY = 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_XOR = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None]
_ODD = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_words: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size`` words in a row; a shorter text is one shingle, one without words none."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    try:
        own = list(map(_words.__getitem__, words))
    except KeyError:
        new = [w for w in set(words) if w not in _words]
        if len(_words) + len(new) > CACHE_WORDS:
            _words.clear()
            new = list(set(words))
        _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        own = list(map(_words.__getitem__, words))
    w = np.array(own, np.uint64)
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _P + w[i : len(w) - size + 1 + i]
    return np.unique(_mixed(h))


def set_key(s: np.ndarray) -> int:
    """64-bit key of a set: equal sets have equal keys."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signature(s: np.ndarray) -> np.ndarray:
    """Upper halves of the smallest values under ``BANDS * ROWS`` hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, lo : lo + 4096] ^ _XOR) * _ODD).min(1))
    return (least >> np.uint64(32)).astype("<u4")


def fewest(n: int, similarity: int = SIMILARITY, miss: float = MISS) -> int:
    """Fewest equal values among ``n`` with which a pair stays: the posterior of reaching the threshold, from a uniform prior, is
    the probability of at most that many successes in n + 1 draws at the threshold."""
    t, total = similarity / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("minhash", _words.clear)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                n, keys, sigs = [], [], []
                for x in part.column(1):
                    s = shingle_set(x.as_py(), size)
                    n.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                made = [part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary()), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "node", "sig", *extra])

    extra = docs.columns[2:]
    return docs.mapInArrow(worker, ", ".join(["doc_id long, n_shingles long, node long, sig binary", *(f"{c} long" for c in extra)]))


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``a, b`` that stay after the sequential comparison of signatures, with their equal values."""
    steps = [(n, fewest(n, similarity)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<u4").reshape(part.num_rows, -1) for i in (2, 3))
                left, same = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                for n, least in steps:
                    same[left] += (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(1)
                    left = left[same[left] >= least]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(left)), part.column(1).take(pa.array(left)), pa.array(same[left], pa.int64())], ["a", "b", "same"])

    first = nodes.select(F.col("node").alias("a"), F.col("sig").alias("x"))
    second = nodes.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(worker, "a long, b long, same long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough.

    Texts travel, not sets: they are smaller. Pairs are dealt by ``b`` (over several tasks where it has more than ``VERIFY``), its text in
    front of those of its pairs, so it is sent once to each task, and a task holds one set at a time.
    """

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("minhash", _words.clear)
        at, held = None, None
        for batch in batches:
            out_a, out_b = [], []
            for b, a, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingle_set(text, size)
                if a is None:
                    if set_key(s) == b:  # else another text with the same id
                        at, held = b, s
                elif at == b and len(s) and set_key(s) == a:
                    shared = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * shared >= similarity * (len(held) + len(s) - shared):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(ends.join(nodes.select("node", F.col("rep").alias("doc_id")), "node"), "wanted")
    texts = materialize(looked_up(docs, wanted, "doc_id").select("node", "text"), "texts")
    tasks = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / VERIFY).alias("tasks")), "tasks")
    heads = tasks.join(texts.withColumnRenamed("node", "b"), "b").select("b", F.lit(None).cast("long").alias("a"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"))
    rows = looked_up(pairs.select("a", "b"), tasks, "b", salts=16).join(texts.withColumnRenamed("node", "a"), "a")
    rows = rows.select("b", "a", "text", F.pmod(F.xxhash64("a"), F.col("tasks")).alias("task"))
    dealt = heads.union(rows).repartition("b", "task").sortWithinPartitions("b", "task", F.asc_nulls_first("a")).drop("task")
    out = materialize(dealt.mapInArrow(worker, "a long, b long").distinct(), "links")
    for old in (wanted, texts, tasks):
        discard(old)
    return out


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, n, hub, top`` for the buckets with two members or more: n members, the member that this part of the bucket is
    held against, and the one that those are."""
    values = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    rows = nodes.select("node", F.explode(values).alias("key")).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    # A member's rank differs from bucket to bucket, so each band holds it against others.
    ranked = F.struct(F.xxhash64("node", "key").alias("r"), F.col("node").alias("v"))
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("m"), F.min(ranked).alias("hub"))
    whole = Window.partitionBy("key")  # at most PARTS rows
    parts = parts.withColumn("n", F.sum("m").over(whole)).withColumn("top", F.min("hub").over(whole)).where("n > 1")
    parts = parts.select(F.col("key").alias("_k"), F.col("part").alias("_p"), "n", F.col("hub.v").alias("hub"), F.col("top.v").alias("top"))
    return rows.join(parts, (F.col("key") == F.col("_k")) & (F.col("part") == F.col("_p"))).select("key", "node", "n", "hub", "top")


def _other(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if roots is None:
        return pairs
    out = looked_up(pairs, roots.select(F.col("id").alias("a"), F.col("root").alias("_a")), "a", of=roots, how="left")
    out = looked_up(out, roots.select(F.col("id").alias("b"), F.col("root").alias("_b")), "b", of=roots, how="left")
    return out.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(*pairs.columns)


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of the groups ``key`` whose members ``node`` are in several components, with the member's ``root``, the number ``m``
    of the group's rows and its largest component ``top``."""
    own = looked_up(rows, roots.select(F.col("id").alias("node"), "root"), "node", of=roots, how="left")
    own = materialize(own.withColumn("root", F.coalesce("root", "node")), "members")
    sizes = own.groupBy("key", "root").agg(F.count("*").alias("m"))
    keys = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("top"))
    keys = materialize(keys.where("roots > 1").select("key", "m", F.col("top.root").alias("top")), "open-keys")
    return looked_up(own, keys, "key")


def _central(members: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs ``a, b``: of each bucket the members outside its largest component, with this component's member that has most links."""
    rows = materialize(_open(members.where("n > 2").select("key", "node"), roots), "open")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("d"))
    degree = materialize(degree, "degrees")
    inside = looked_up(rows.where("root = top").select("key", "node"), degree, "node", how="left")
    best = inside.groupBy("key").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), "node")).alias("h"))
    best = materialize(best.select("key", F.col("h.node").alias("b")), "hubs")
    pairs = looked_up(rows.where("root <> top").select("key", F.col("node").alias("a")), best, "key")
    return pairs.select("a", "b").distinct()


def _class(n: int) -> int:
    """Size class: sizes in one are within ``CLASS`` of each other."""
    return int(math.log(n) / math.log(CLASS) + 1e-9)


def _prefix(tokens: np.ndarray, counts: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sides, places): keys of which a set has one in common with every set that is similar enough. They are its rarest tokens, as
    many as such a partner can lack and one more, for each size class that a partner may be in. A key is for one pair of classes;
    side 0 meets 0 (one class), 1 meets 2."""
    n = len(tokens)
    own = tokens[np.lexsort((tokens, counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]))]
    mine, keys, sides, places = _class(n), [], [], []
    for other in range(_class(-(-similarity * n // 100)), _class(100 * n // similarity) + 1):
        smallest = max(int(CLASS**other), -(-similarity * n // 100))
        length = n + 1 - -(-similarity * (n + smallest) // (100 + similarity))
        salt = np.uint64((min(mine, other) * 4096 + max(mine, other)) * 0x9E3779B97F4A7C15 % 2**64)
        keys.append(_mixed(own[:length] ^ salt))
        sides.append(np.full(length, 0 if other == mine else 1 if other > mine else 2, np.int32))
        places.append(np.arange(length, dtype=np.int32))
    return np.concatenate(keys).view(np.int64), np.concatenate(sides), np.concatenate(places)


def _apart(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """Pairs ``a, b`` in different components that may still be similar enough, of all members of buckets with several components.

    Members of a bucket aren't paired with each other; an exact filter does it: similar sets have one of their rarest tokens in
    common. What keeps a member out of a large component of copies is that it has many tokens that these lack, and those
    come first, so it doesn't meet the copies. Of the members with a key, only those outside its largest component are paired with
    the others, dealt over as many tasks as there are ``SPREAD`` of them.
    """
    slots = 1 << 17

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("minhash", _words.clear)
        for b in batches:
            found = [(k, s) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(s := shingle_set(t, size)) and set_key(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["node", "tokens"])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for b in batches:
            flat = b.column(0).flatten().to_numpy()
            total += np.bincount(flat & (slots - 1), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "m"])

    several = members.where("n > 2").select("key", "node")  # the pair of a bucket of two was tried
    opened = _open(several, roots).select("node").distinct()
    wanted = materialize(opened.join(nodes.select("node", F.col("rep").alias("doc_id")), "node"), "wanted")
    own = materialize(looked_up(docs, wanted, "doc_id").select("node", "text").mapInArrow(sets, "node long, tokens array<long>").dropDuplicates(["node"]), "sets")
    counts = np.zeros(slots, np.int64)  # how often tokens occur, by a hash: bounded, and only the order of a prefix depends on it
    seen = own.select("tokens").mapInArrow(counted, "slot long, m long").groupBy("slot").agg(F.sum("m").alias("m")).toArrow()
    counts[seen["slot"].to_numpy()] = seen["m"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                cols: list[list] = [[], [], [], [], []]
                for node, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    key, side, place = _prefix(x.values.to_numpy().view(np.uint64), shared.value, similarity)
                    for c, v in zip(cols, (key, np.full(len(key), node), side, place, np.full(len(key), len(x.values), np.int32)), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["key", "node", "side", "place", "size"])

    rows = own.mapInArrow(prefixes, "key long, node long, side int, place int, size int")
    found = materialize(_open(rows, roots), "open")
    tasks = F.ceil(F.col("m") / SPREAD)
    named = lambda end: [F.col(c).alias(f"{c}_{end}") for c in ("root", "place", "size")]
    each = found.where("root <> top").select("key", F.col("node").alias("a"), *named("a"), ((3 - F.col("side")) % 3).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"))
    every = found.select("key", F.col("node").alias("b"), *named("b"), "side", F.pmod(F.xxhash64("node"), tasks).alias("task"))
    # At the first token in common, no more than the rest of the shorter remainder can be shared.
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = (each["root_a"] != every["root_b"]) & ((100 + similarity) * most >= similarity * (F.col("size_a") + F.col("size_b")))
    on = (each["key"] == every["key"]) & (each["task"] == every["task"]) & (each["side"] == every["side"])
    pairs = each.join(every, on & fits)
    discard(wanted)
    discard(own)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col).cast("string"), "utf-8").alias("text"))


def _grouped(docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """``doc_id, n_shingles, node, root, component_id`` and further columns of integers for every row of ``doc_id, text, ...``: a component is
    its ``root``, as an id with several texts may name several. Without links ``root`` is null, and without copies ``component_id`` too."""
    signed = materialize(_signed(docs, size), "signatures")
    own = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = materialize(own.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")
    members = materialize(_buckets(nodes), "buckets")

    # Pairs with the members that others are held against.
    stars = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    stars = stars.union(members.where("node = hub AND hub <> top").select(F.col("node").alias("a"), F.col("top").alias("b")))
    tried = materialize(stars.distinct(), "tried")
    alike = materialize(_alike(tried, nodes, similarity), "alike")
    best = alike.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b"))
    links = _verified(best, nodes, docs, size, similarity)
    roots = connected_components(links)

    # What is still apart: the other pairs that were alike, and members outside the largest component of a bucket with the one that has most links in it,
    # since copies lie around their source.
    central = materialize(_central(members, roots, links).join(tried, ["a", "b"], "left_anti"), "central")
    rest = _other(alike, roots).join(best, ["a", "b"], "left_anti").select("a", "b").union(_alike(central, nodes, similarity).select("a", "b"))
    links = links.union(_verified(materialize(rest, "rest"), nodes, docs, size, similarity))
    discard(roots)
    roots = connected_components(links)

    # Members of one bucket that are still apart.
    done = tried.union(central).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = materialize(_apart(members, roots, nodes, docs, size, similarity).join(done, ["a", "b"], "left_anti"), "apart")
    more = materialize(_alike(left, nodes, similarity), "alike")
    if more.take(1):
        links = links.union(_verified(more, nodes, docs, size, similarity))
        discard(roots)
        roots = connected_components(links)

    named = looked_up(nodes.select("node", "rep", "copies"), roots.withColumnRenamed("id", "node"), "node", of=roots, how="left")
    smallest = named.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("component_id"))
    named = looked_up(named, smallest, "root", of=roots, how="left").where("root IS NOT NULL OR copies > 1")
    named = materialize(named.select("node", "root", F.coalesce("component_id", "rep").alias("component_id")), "components")
    return looked_up(signed.drop("sig"), named, "node", how="left")


def near_duplicates(docs: DataFrame, *, size: int = 5, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents are linked where ``100 * shared >= similarity * total`` holds for their sets; ``component_id`` is the smallest id
    that links lead to. Documents without words are linked with nothing. Rows with one id and text count once for links but all
    come back. A null id can't name a component: such rows are linked with nothing, kept, and their component is null. An empty table
    gives no rows; other columns are ignored. A pair at the threshold shares no bucket with a probability of 4e-7.
    """
    out = _grouped(_texts(docs, id_col, text_col), size, similarity)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, *, size: int = 5, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id.

    Rows are told apart by id and text. An id with several texts may be in several groups, and each text is judged by its own; where a
    group has several texts under its smallest id, the one with the smallest hash stays. Of repeated rows (one id and text) one stays,
    without words too, and whatever the other columns: the one that sorts first as JSON. Rows with a null id are in no group and all stay,
    exact copies included. Texts are compared by 64-bit hashes.
    """
    rows = _grouped(_texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text")), size, similarity).where("doc_id IS NOT NULL")
    rows = rows.groupBy("doc_id", "h").agg(F.first(F.coalesce("root", "node")).alias("root"), F.count("*").alias("m"))
    rows = materialize(rows, "texts-of-ids")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "h")).alias("first")).where("k > 1")
    first = materialize(first.select("root", "first"), "first")
    rest = looked_up(rows, first, "root").where(F.struct("doc_id", "h") != F.col("first"))
    gone = materialize(rest.select(F.col("doc_id").alias("_gone"), F.col("h").alias("_hash")), "duplicates")
    again = materialize(rows.where("m > 1").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_hash")), "repeated")
    n_gone, n_again = gone.count(), again.count()
    ids, texts = docs[id_col].cast("long"), F.xxhash64(F.encode(docs[text_col].cast("string"), "utf-8"))

    def held(rows: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
        keys = F.broadcast(keys) if n <= 1_000_000 else keys
        return rows.join(keys, (ids == keys["_gone"]) & (texts == keys["_hash"]), how)

    kept = held(docs, gone, n_gone, "left_anti")
    if not n_again:
        return kept
    row = F.struct("*")
    one = held(kept, again, n_again, "left_semi").groupBy(ids.alias("_id"), texts.alias("_h")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return held(kept, again, n_again, "left_anti").unionByName(one.select("row.*"))
