"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of its features. The weights are learned from preference pairs, a document of
label 1 against one of label 0, by logistic loss on the difference of their features (the Bradley-Terry likelihood
that the first is preferred). The decision threshold is a quantile of the scores: the share of label 0 among all
labelled rows. Scores are mapped to 0..1 so that the threshold lies at THRESHOLD.

Features are counts of the text alone: its length, punctuation, symbols, digits, capitals, line and word repetition,
word lengths. All labelled rows are learned from. They are dealt by a hash into blocks of about BLOCK rows of the more
frequent label, in which each meets PARTNERS of the other label at least; where that label is rare, its rows come to
several blocks, so that each has about LEAST of them. Every step of Newton's method sums over all blocks, and so do the
means and the digits of the threshold; the driver gets sums alone.

Defined results: a null text is an empty one and gets the score of its (zero) features; rows with a null label are
not learned from; several labels of a document are several examples; of several texts under one doc_id the one with the
smallest hash is learned from; without examples of both labels every score is
THRESHOLD, which predicts 1. Labels, languages, sources and ids are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from millrace.llm.common import bucket_of, slices, stage_table

THRESHOLD, PARTNERS, PENALTY = 0.7, 8, 1e-3
#: Rows of the more frequent label in a block, rows of the other at least, and equal labels of one document in a row.
BLOCK, LEAST, EQUAL = 512, 64, 8
_SYMBOLS, _WORD_END = re.compile(r"[#*$%&|<>{}\\^~=_+@]"), re.compile(r"[.!?]+$")
FEATURES = ("log_words", "word_length", "long_words", "short_words", "symbols", "bars", "digits", "capitals", "capital_words", "commas", "ends", "sentence", "distinct", "top_word", "same_next", "same_pair", "line_words", "lines_alone", "dup_lines", "odd_letters", "alpha_words", "log_chars")


def features(text: str | None) -> list[float]:
    """FEATURES of a text; zeros without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars, sizes, counts = len(text), list(map(len, words)), Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = sum(sizes)
    ends = sum(1 for w in words if _WORD_END.search(w[-3:]))
    pairs = Counter(zip(words, words[1:], strict=False))
    alpha = sum(map(str.isalpha, words))
    return [
        np.log1p(n), letters / n, sum(1 for s in sizes if s > 12) / n, sum(1 for s in sizes if s <= 3) / n,
        len(_SYMBOLS.findall(text)) / letters, counts["|"] / n, sum(map(text.count, "0123456789")) / letters, sum(1 for c in text if c.isupper()) / letters,
        sum(1 for w in words if w[0].isupper()) / n, text.count(",") / n, ends / n, np.log1p(n / (ends + 1)),
        len(counts) / n, max(counts.values()) / n, sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n, 1 - len(pairs) / max(n - 1, 1),
        np.log1p(n / len(lines)), sum(1 for x in lines if " " not in x.strip()) / len(lines), 1 - len(set(lines)) / len(lines), 1 - text.isascii(), alpha / n, np.log1p(chars),
    ]


def with_squares(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, rows**2], axis=1)


class Block(NamedTuple):
    """Feature rows of label 1 and of label 0 that meet each other. The first `own` of each are this block's; the others are copies of rows of other blocks."""

    good: np.ndarray
    bad: np.ndarray
    own: tuple[int, int]
    number: int = 0

    def owned(self) -> tuple[np.ndarray, np.ndarray]:
        return self.good[: self.own[0]], self.bad[: self.own[1]]

    def pairs(self, partners: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in good and in bad: each row meets `partners` of the other label at least."""
        draw = np.random.default_rng(self.number)
        n = max(len(self.good), len(self.bad)) * partners if len(self.good) and len(self.bad) else 0
        return draw.permutation(n) % max(len(self.good), 1), draw.permutation(n) % max(len(self.bad), 1)


#: Applies a function (block -> numbers) to every block and adds the results, or joins them by another function.
Total = Callable[..., np.ndarray]


def _keys(scores: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores."""
    bits = (scores + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _score_of(key: int) -> float:
    return float(np.array([key ^ (1 << 63) if key >> 63 else key ^ (1 << 64) - 1], np.uint64).view(np.float64)[0])


def _histogram(keys: np.ndarray, low: int, shift: int, bins: int) -> np.ndarray:
    """How many keys from `low` on have each digit, of the digit `shift` bits from the right."""
    digit = (keys[keys >= np.uint64(low)] - np.uint64(low)) >> np.uint64(shift)
    return np.bincount(digit[digit < bins].astype(np.int64), minlength=bins).astype(float)


class Ranker:
    """Standardised features and their squares, Bradley-Terry weights, and the threshold's place."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, share: float, partners: int = PARTNERS, penalty: float = PENALTY):
        good, bad = rows[labels == 1], rows[labels == 0]
        block = Block(good, bad, (len(good), len(bad)))
        self._learn(lambda find, join=np.add: find(block), len(good), len(bad), share, partners, penalty)

    @classmethod
    def over(cls, total: Total, good: int, bad: int, share: float, partners: int = PARTNERS, penalty: float = PENALTY) -> Ranker:
        """Learned from blocks with that many own rows of each label."""
        made = cls.__new__(cls)
        made._learn(total, good, bad, share, partners, penalty)
        return made

    def _learn(self, total: Total, good: int, bad: int, share: float, partners: int, penalty: float) -> None:
        self.known = good > 0 and bad > 0
        if not self.known:
            return
        self.mean = total(lambda block: np.concatenate(block.owned()).sum(axis=0)) / (good + bad)
        self.scale = np.sqrt(total(lambda block: ((np.concatenate(block.owned()) - self.mean) ** 2).sum(axis=0)) / (good + bad)) + 1e-9
        size = len(self.mean) * 2
        self.weights = np.zeros(size)
        for _ in range(25):  # Newton's method on the mean logistic loss of the pairs
            n, *sums = total(lambda block: self._pair_sums(block, partners))
            slope = np.array(sums[:size]) / n + penalty * self.weights
            curve = np.array(sums[size:]).reshape(size, size) / n + penalty * np.eye(size)
            step = np.linalg.solve(curve, slope)
            self.weights -= step * min(1, 3 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        self.threshold = self._quantile(total, good, bad, share)

    def _pair_sums(self, block: Block, partners: int) -> np.ndarray:
        """The number of pairs, and the sums of their loss's slope and curvature."""
        left, right = block.pairs(partners)
        diff = self._inputs(block.good)[left] - self._inputs(block.bad)[right]
        p = 1 / (1 + np.exp(np.clip(diff @ self.weights, -30, 30)))
        curve = (diff * (p * (1 - p))[:, None]).T @ diff
        return np.concatenate([[len(diff)], -(diff * p[:, None]).sum(axis=0), curve.ravel()])

    def _quantile(self, total: Total, good: int, bad: int, share: float) -> float:
        """Between the score at which `share` of all labelled rows is reached, and the next: found digit by digit.

        The rows at hand weigh as their label is frequent among the labelled. Of equal scores those of label 0 come first.
        """
        each, target = ((1 - share) / good, share / bad), max(share - 1e-12, 1e-300)
        low, below = 0, np.zeros((2, 1))
        for shift in (51, 38, 25, 12, 0):
            bins = 1 << (13 if shift else 12)
            counts = total(lambda block: np.concatenate([_histogram(_keys(self._raw(rows)), low, shift, bins) for rows in block.owned()])).reshape(2, bins)  # noqa: B023
            upto = below + counts.cumsum(axis=1)
            reached = each[0] * upto[0] + each[1] * upto[1]
            place = min(int(np.searchsorted(reached, target)), bins - 1)  # beyond only by rounding
            low, below = low + (place << shift), (upto - counts)[:, place : place + 1]
        at = _score_of(low)
        last = each[0] if counts[0, place] else each[1]
        if reached[place] - last >= target:
            return at  # the next has the same score
        over = total(lambda block: np.array([min((s[s > at].min(initial=np.inf) for s in map(self._raw, block.owned())))]), np.minimum)[0]
        return (at + over) / 2 if np.isfinite(over) else at

    def _raw(self, rows: np.ndarray) -> np.ndarray:
        return self._inputs(rows) @ self.weights

    def _inputs(self, rows: np.ndarray) -> np.ndarray:
        return with_squares(np.clip((rows - self.mean) / self.scale, -8, 8))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(rows), THRESHOLD)
        margin = self._raw(rows) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _map_features(docs: DataFrame) -> DataFrame:
    """The columns of `docs` with the features x in place of text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = pa.array([features(t) for t in part.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), x], names=[*(f.name for f in kept), "x"])

    return docs.mapInArrow(run, StructType([*kept, StructField("x", ArrayType(DoubleType()))]))


def _matrix(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _least(rows: DataFrame, value: str) -> DataFrame:
    """doc_id and `value` of the row with the smallest hash h of its text, for each doc_id."""
    found = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h", value)).alias("least"))
    return found.select("doc_id", f"least.{value}")


def _marked(labels: DataFrame, label: str) -> DataFrame:
    return labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")


def _packed(found: pa.Table) -> pa.Table:
    """The block of those rows."""
    x = _matrix(found["x"].combine_chunks())
    y, own, times = (found[c].to_numpy() for c in ("y", "own", "times"))
    order = np.lexsort((*x.T, ~own))  # rows come in any order; the pairs must not depend on it
    out = {"block": [found["block"][0].as_py()]}
    for name, label in (("good", 1), ("bad", 0)):
        rows = order[y[order] == label]
        out[name] = [np.repeat(x[rows], times[rows], axis=0).tobytes()]
        out[f"own_{name}"] = [int(times[rows][own[rows]].sum())]
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("good", pa.binary()), ("own_good", pa.int64()), ("bad", pa.binary()), ("own_bad", pa.int64())]))


def _total(blocks: DataFrame) -> Total:
    """Adds over a table of blocks: within each task, then on the driver."""

    def total(find: Callable[[Block], np.ndarray], join: Callable = np.add) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for part in slices(batches, 1):
                (row,) = part.to_pylist()
                good, bad = (np.frombuffer(row[c]).reshape(-1, len(FEATURES)) for c in ("good", "bad"))
                one = find(Block(good, bad, (row["own_good"], row["own_bad"]), row["block"]))
                found = one if found is None else join(found, one)
            if found is not None:
                yield pa.RecordBatch.from_pydict({"found": [found.tobytes()]}, schema=pa.schema([("found", pa.binary())]))

        return reduce(join, [np.frombuffer(r["found"]) for r in blocks.mapInArrow(run, "found binary").collect()])

    return total


def _dealt(rows: DataFrame, marked: DataFrame) -> tuple[DataFrame | None, dict[int, int]]:
    """All examples in blocks, none without both labels, and how many there are of each label. `rows` (doc_id, x) has a doc_id once."""
    equal = marked.groupBy("doc_id", "y").agg(F.count("*").alias("times")).join(rows, "doc_id")
    some = equal.withColumn("part", F.explode(F.expr(f"sequence(0, (times - 1) div {EQUAL})")))
    some = stage_table(some.withColumn("times", F.least(F.lit(EQUAL), F.col("times") - F.col("part") * EQUAL)), "quality_examples")
    sizes = {r["y"]: r for r in some.groupBy("y").agg(F.count("*").alias("rows"), F.sum("times").alias("times")).collect()}
    if len(sizes) < 2:
        return None, {y: r["times"] for y, r in sizes.items()}
    count = -(-max(r["rows"] for r in sizes.values()) // BLOCK)
    copies = {y: min(count, -(-LEAST * count // r["rows"])) for y, r in sizes.items()}
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 1, copies[1] - 1).otherwise(copies[0] - 1)))
    block = F.pmod(F.pmod(F.xxhash64("doc_id", "y", "part"), F.lit(count)) + F.col("copy"), F.lit(count)).cast("long")
    spread = some.withColumn("copy", copy).select(block.alias("block"), (F.col("copy") == 0).alias("own"), "y", "times", "x")
    packed = spread.groupBy("block").applyInArrow(_packed, "block long, good binary, own_good long, bad binary, own_bad long")
    return stage_table(packed, "quality_blocks"), {y: r["times"] for y, r in sizes.items()}


def _learned(rows: DataFrame, marked: DataFrame) -> Ranker:
    """Learned from all of `marked` (doc_id, y) and `rows` (doc_id, x), which has a doc_id once."""
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    blocks, sizes = _dealt(rows, marked)
    total = None if blocks is None else _total(blocks)
    return Ranker.over(total, sizes.get(1, 0), sizes.get(0, 0), counts.get(0, 0) / max(sum(counts.values()), 1))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker:
    """Learns from all of `labels` (doc_id, `label` 0 or 1) and the texts of `docs`. The driver gets sums alone."""
    marked = _marked(labels, label)
    known = docs.join(marked.select("doc_id"), "doc_id", "left_semi")
    return _learned(_map_features(_least(known.select("doc_id", F.xxhash64("text").alias("h"), "text"), "text")), marked)


def _scored(found: DataFrame, ranker: Ranker) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = shared.value(_matrix(part.column("x")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score, predicted for each row."""
    return _scored(_map_features(docs.select(F.col("doc_id").cast("long"), "text")), ranker)


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op4: learned from labels whose crc32 bucket of 4 is not 2, applied to every row.

    The features of all rows are found once and written, as learn() and score() each need them.
    """
    held = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    found = stage_table(_map_features(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")), "quality_features")
    ranker = _learned(_least(found, "x"), _marked(labels.where(~held), "quality"))
    return _scored(found, ranker).select("doc_id", held.alias("held_out"), "score", "predicted")
