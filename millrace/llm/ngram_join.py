"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two documents are linked when the Jaccard similarity of their sets of word n-grams (five words) is at least 0.8.

1. Sketch. Each document's n-gram hashes give HASHES MinHash values of 16 bits, in BANDS bands of ROWS, and 64 bits
   that name the n-gram set. One pass over the texts, no shuffle.
2. Classes. Documents with the same set are copies; one row of each class goes on.
3. Candidates. Classes that share a band's values meet. A band of r values of similarity s is shared with
   probability s^r, so a pair at 0.8 escapes all 24 bands of 4 with probability 3e-6, and fewer above.
4. Pruning. A pair's MinHash values are compared a few at a time. After m matches of n the posterior probability that
   the similarity reaches the threshold follows from a uniform prior (regularised incomplete beta function); a pair
   goes when that falls below TOLERANCE. The smallest number of matches to go on is tabulated beforehand.
5. Clusters. Survivors only leave a spanning forest for each block: at most one edge for each document in it, never all
   pairs. Connected components of the forest are the candidate clusters.
6. Verification. Each cluster's n-gram sets meet once; pairs are pruned as in 4 and the rest are verified exactly, by
   intersecting the sets. Out come each document's number of links and a spanning forest of the true links, whose
   components are the groups.

Buckets and clusters above BLOCK members are cut into blocks, and each two blocks meet in a task of their own, so no
task holds more than two blocks, whatever a group's size. Nothing is capped: every pair of blocks is compared.

Defined results: a text without words (null, empty) has no links and is its own class and group; a text of fewer words
than n is one n-gram; repeated rows are copies; a row with a null doc_id counts as a document, but an id stands for its
class wherever there is one. Words are those of the lower-cased text, letters and digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, free_shuffles, slices, stage_table

NGRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Probability with which pruning may drop a pair that reaches the threshold, at each look at its values.
TOLERANCE, LOOK = 1e-6, 16
BLOCK = 512
#: Class rows (about 60 bytes each) up to which those in clusters are broadcast to their texts; beyond, both are shuffled.
BROADCAST_ROWS = 500_000
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words of up to 64 letters."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str | None, hashes: WordHashes, n: int = NGRAM) -> np.ndarray:
    """The distinct hashes of the text's word n-grams, sorted."""
    words = WORDS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(ids))
    out = np.full(len(ids) - size + 1, len(ids) if len(ids) < n else 0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + ids[k : len(ids) - size + 1 + k]
            out ^= out >> _U(29)
        return np.unique(_mixed(out))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    return draw.integers(0, 2**64, HASHES, np.uint64) | _U(1), draw.integers(0, 2**64, HASHES, np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    times, plus = _coefficients_held()
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 2048):
            np.minimum(out, (grams[at : at + 2048, None] * times + plus).min(axis=0), out=out)
    return out.astype(np.uint16)


@lru_cache(1)
def _coefficients_held() -> tuple[np.ndarray, np.ndarray]:
    return _coefficients()


@lru_cache(8)
def least_matches(threshold: float, tolerance: float, look: int = LOOK, hashes: int = HASHES) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches to go on): the posterior of reaching the threshold is at least the tolerance there.

    With m matches of n and a uniform prior the similarity has a Beta(m + 1, n - m + 1) distribution, and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    from math import comb

    out = []
    for n in range(look, hashes + 1, look):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def class_key(grams: np.ndarray) -> int:
    """64 bits that name a set of n-grams: documents with the same set are copies."""
    with np.errstate(over="ignore"):
        two = np.array([np.bitwise_xor.reduce(_mixed(grams ^ _BASE)), grams.sum(dtype=np.uint64) + _U(len(grams))])
        return int(_mixed(two[:1] * _BASE + _mixed(two[1:])).view(np.int64)[0])


def sketches(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """doc_id, h (the text's hash), v (the class key, null without words), sig (MinHash values), keys (band keys)."""
    names = ["doc_id", "h", "v", "sig", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bands = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)
        for part in slices(batches, 256):
            found: list[tuple] = []
            for text in part.column(1).to_pylist():
                grams = shingles(text, hashes, n)
                if not len(grams):
                    found.append((None, None, None))
                    continue
                sig = signature(grams)
                with np.errstate(over="ignore"):
                    found.append((class_key(grams), sig.tobytes(), _mixed(sig.view(np.uint64) + bands).view(np.int64).tolist()))
            columns = [list(x) for x in zip(*found, strict=True)] if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True))], names=names)

    return _keyed_texts(docs).mapInArrow(run, "doc_id long, h long, v long, sig binary, keys array<long>")


def _keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def _with_grams(n: int, remember: int = 100_000):
    """Rows (text, cluster, low, high, side, v, copies) -> (..., sig, grams), once for each v in a task, though its text may
    repeat; a text of another class, whose hash and id happen to be the same, is left out."""
    names = ["cluster", "low", "high", "side", "v", "copies", "sig", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done, last = WordHashes(), set(), None
        for part in slices(batches, 256):
            keep, sigs, sets = [], [], []
            for text, *place in zip(part.column(0).to_pylist(), *(part.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if keep_it := (place := tuple(place)) not in done:
                    if text != last:  # a text's rows for its blocks come together
                        last, grams = text, shingles(text, hashes, n)
                        key, sig = (class_key(grams), signature(grams).tobytes()) if len(grams) else (None, b"")
                    if keep_it := key == place[-1]:
                        sigs.append(sig)
                        sets.append(grams.tobytes())
                    if len(done) >= remember:
                        done.clear()
                    done.add(place)
                keep.append(keep_it)
            rest = part.select(range(1, 7)).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=names)

    return run


def _blocks(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """The members with `task` and `side`: those of a key with up to `block` members meet in one task; a larger key's are
    dealt into blocks by hash, and each pair of blocks (a block with itself included) is a task; side tells which block."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("v", F.lit(3)), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda other: F.struct(F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"), F.when(mine <= other, 0).otherwise(1).alias("side")))
    return members.withColumn("n_blocks", n).withColumn("meet", F.explode(pairs)).select("*", "meet.low", "meet.high", "meet.side").drop("meet", "n_blocks")


class _Forest:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _likely(left: np.ndarray, right: np.ndarray, same: bool, looks: tuple[tuple[int, int], ...], stripe: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (a stripe of left rows at a time) that pass every look; a < b within one block."""
    for top in range(0, len(left), stripe):
        rows = left[top : top + stripe]
        first, need = looks[0]
        close = (rows[:, None, :first] == right[None, :, :first]).sum(axis=2) >= need
        if same:
            close &= np.arange(top, top + len(rows))[:, None] < np.arange(len(right))[None, :]
        a, b = np.nonzero(close)
        a += top
        for enough, need in looks[1:]:
            if not len(a):
                break
            keep = (left[a, :enough] == right[b, :enough]).sum(axis=1) >= need
            a, b = a[keep], b[keep]
        if len(a):
            yield a, b


def _groups(batches: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows that agree in the first columns; rows come sorted by them. Only the run at hand is held."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in slices(batches, 4096):
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(key_columns)), strict=True))
        start = 0
        for at, now in enumerate(keys):
            if now != key:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield key, held
                held, key, start = [], now, at
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield key, held


def _column(parts: list[pa.RecordBatch], k: int) -> list:
    return [x for p in parts for x in p.column(k).to_pylist()]


def _candidate_forest(looks: tuple[tuple[int, int], ...]):
    """For each task's rows (key, low, high, side, id, sig): edges of a spanning forest over the pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for (_, low, high), parts in _groups(batches, 3):
            side, ids = _column(parts, 3), _column(parts, 4)
            sig = np.frombuffer(b"".join(_column(parts, 5)), np.uint16).reshape(len(ids), HASHES)
            _forest_of(np.array(side), ids, sig, low == high, looks, out)
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return run


def _forest_of(side: np.ndarray, ids: list, sig: np.ndarray, same: bool, looks: tuple, out: tuple[list, list]) -> None:
    if len(ids) == 2 and same:
        if all((sig[0, :n] == sig[1, :n]).sum() >= m for n, m in looks):
            out[0].append(ids[0]), out[1].append(ids[1])
        return
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    forest = _Forest(len(ids))
    for a, b in _likely(sig[left], sig[left if same else right], same, looks):
        for x, y in zip(left[a].tolist(), (left if same else right)[b].tolist(), strict=True):
            if forest.join(x, y):
                out[0].append(ids[x]), out[1].append(ids[y])


def _verify(threshold: float, looks: tuple[tuple[int, int], ...]):
    """For each task's rows (cluster, low, high, side, id, copies, sig, grams): links of each id and a spanning forest of them.

    Emits (id, other, links): other is an id that it is linked with (an edge of the forest) or null, links is the number of
    documents linked with id in this task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), parts in _groups(batches, 3):
            same = low == high
            rows = dict(zip(zip(_column(parts, 3), _column(parts, 4), strict=True), zip(_column(parts, 5), _column(parts, 6), _column(parts, 7), strict=True), strict=True))
            side, ids = np.array([k for k, _ in rows]), [v for _, v in rows]  # a class once, though its row may repeat
            copies = np.array([x[0] for x in rows.values()], np.int64)
            sig = np.frombuffer(b"".join([x[1] for x in rows.values()]), np.uint16).reshape(len(ids), HASHES)
            sets = [np.frombuffer(x[2], np.uint64) for x in rows.values()]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            other = left if same else right
            links, forest, edges = np.zeros(len(ids), np.int64), _Forest(len(ids)), []
            for a, b in _likely(sig[left], sig[other], same, looks):
                a, b = left[a], other[b]
                for x in np.unique(a):
                    mine, partners = sets[x], b[a == x]
                    sizes = np.array([len(sets[y]) for y in partners])
                    able = (np.minimum(sizes, len(mine)) >= threshold * np.maximum(sizes, len(mine)))
                    for y, size in zip(partners[able].tolist(), sizes[able].tolist(), strict=True):
                        theirs = sets[y]
                        at = np.searchsorted(mine, theirs)
                        at[at == len(mine)] = 0
                        common = int((mine[at] == theirs).sum())
                        if common >= threshold * (len(mine) + size - common) - 1e-9:
                            links[x] += copies[y]
                            links[y] += copies[x]
                            if forest.join(int(x), y):
                                edges.append((ids[x], ids[y]))
            rows = [(i, None, int(n)) for i, n in zip(ids, links, strict=True) if n] + [(a, b, 0) for a, b in edges]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=["id", "other", "links"])

    return run


def components(edges: DataFrame, rounds: int = 60, rows: int = 200_000) -> DataFrame:
    """id, group: the smallest id of each connected component of `edges` (a, b), by alternating large-star and small-star
    steps. Each round shuffles at most the edges there are, four times; rounds grow with the logarithm of the longest chain.
    Edges are kept in partitions of about `rows`, so that a round over few of them writes few files."""
    now = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()
    now, before = cut(now), None
    for _ in range(rounds):
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if (count, total) == before:
            break
        before = (count, total)
        now = now.coalesce(max(1, -(-count // rows)))
        # large star: what hangs below an id that has a smaller neighbour is hung below the smallest of those
        least = now.groupBy(F.col("high").alias("at")).agg(F.min("low").alias("m"))
        up = now.join(least, now["low"] == least["at"], "left")
        up = up.select(F.explode(F.when(F.col("m").isNull(), F.array(F.struct("low", "high"))).otherwise(F.array(F.struct(F.col("m").alias("low"), "high"), F.struct(F.col("m").alias("low"), F.col("low").alias("high"))))).alias("e"))
        up = up.select("e.low", "e.high")
        # small star: an id with several smaller neighbours hangs them all below the smallest
        smallest = up.groupBy("high").agg(F.min("low").alias("m"))
        first = F.col("low") == F.col("m")
        now = cut(up.join(smallest, "high").select(F.col("m").alias("low"), F.when(first, F.col("high")).otherwise(F.col("low")).alias("high")).distinct())
    else:
        raise RuntimeError("components did not settle")
    free_shuffles(edges.sparkSession)
    return now.select(F.col("high").alias("id"), F.col("low").alias("group"))


def cluster_texts(docs: DataFrame, inside: DataFrame) -> DataFrame:
    """Each row of `inside` with its class's text: the document of that id and text hash, so that neither null ids nor ids
    that repeat meet more than the rows that hold that very text."""
    wanted = F.broadcast(inside) if inside.count() <= BROADCAST_ROWS else inside
    same = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
    return _keyed_texts(docs).join(wanted, same).select("text", "cluster", "low", "high", "side", "v", "copies")


def link_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, copies, n_links, group_id for each row of `docs`.

    class_id: the smallest doc_id with the same n-gram set; copies: how many rows have it; n_links: other rows linked
    with the row, copies included; group_id: the smallest doc_id that a chain of links leads to.
    """
    looks = least_matches(threshold, tolerance)
    made = stage_table(sketches(docs, n), "sketches")
    # copies collapse before the shuffle, so the largest class costs a row for each task; (class_id, class_h) finds its text
    text_of = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("its")
    classes = made.where("v is not null").groupBy("v").agg(text_of, F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = classes.select("v", F.col("its.doc_id").alias("class_id"), F.col("its.h").alias("class_h"), "copies", "sig", "keys")
    classes = stage_table(classes, "classes")
    bands = classes.select("v", F.explode("keys").alias("key"))
    # many bands are shared by the very same classes; one band of each such set is enough
    shared = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("v").alias("least"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("sum")).where("members > 1")
    shared = shared.groupBy("members", "least", "sum").agg(F.min("key").alias("key")).select("key", "members")
    met = _blocks(bands.join(shared, "key"), "key", "members", block).join(classes.select("v", "sig"), "v")
    met = met.select("key", "low", "high", "side", "v", "sig").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side", "v")
    clusters = components(met.mapInArrow(_candidate_forest(looks), "a long, b long"))
    clusters = clusters.union(clusters.select(F.col("group").alias("id"), "group").distinct()).select(F.col("id").alias("v"), F.col("group").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    inside = _blocks(clusters.join(sizes, "cluster"), "cluster", "members", block).join(classes.select("v", "class_id", "class_h", "copies"), "v")
    inside = cut(inside.select("class_id", "class_h", "cluster", "low", "high", "side", "v", "copies"))
    sets = cluster_texts(docs, inside).mapInArrow(_with_grams(n), "cluster long, low int, high int, side int, v long, copies long, sig binary, grams binary")
    sets = sets.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "side", "v")
    found = cut(sets.mapInArrow(_verify(threshold, looks), "id long, other long, links long"))
    links = found.where("other is null").groupBy(F.col("id").alias("v")).agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "v")
    named = classes.select("v", "class_id", "copies").join(links, "v", "left").join(groups, "v", "left").withColumn("group", F.coalesce("group", "v"))
    least = named.where((F.col("group") != F.col("v")) | F.col("links").isNotNull()).groupBy("group").agg(F.min("class_id").alias("least"))
    named = cut(named.join(least, "group", "left").select("v", "class_id", "copies", "links", F.coalesce("least", "class_id").alias("group_id")))
    copies = F.coalesce("copies", F.lit(1))
    out = made.select("doc_id", "v").join(named, "v", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), copies.alias("copies"), (copies - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group_id", "doc_id").alias("group_id"))
