"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of its pieces' probabilities, by the forward algorithm; a
document's is the product over its words. Piece probabilities are learned by expectation-maximisation with the
matching forward-backward sums, from a bounded sample of labelled documents (`docs_per_language` of each language, those
with the smallest hashes of doc_id). Every language that a label names is learned, in blocks of BLOCK_LANGUAGES, so that
neither the driver nor a task holds probabilities of more than one block at a time.

Words are `\\p{L}[\\p{L}\\p{M}]*` of the lower-cased text, marked at their start as the vocabulary marks it, and scored
whole, whatever their length: the forward sums of a word need no more than the last `longest piece` of them, scaled as
they go. Letters without a piece of their own share one unknown piece. (Words of a training document beyond CHUNK letters
are learned from in stretches.)

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled text every text is
`und`; equal scores go to the language first in order; languages, sources and ids are no inputs of a prediction; of
several training rows under one doc_id and language one is learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from math import exp, log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Held, bucket_of, cut, drawn, map_rows, map_slices, one_text, quoted, slices, slices_by_bytes

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
CHUNK, MARK = 4096, "▁"
DOCS_PER_LANGUAGE, BLOCK_LANGUAGES, ROUNDS = 300, 200, 2
#: Words up to so many letters are scored many at a time and remembered; the probability of a longer one needs scaling.
SHORT = 32
#: Characters of a text up to which its words are scored with its neighbours'; a longer one goes by SLICE_WORDS words.
LONG_TEXT, SLICE_WORDS = 50_000, 10_000
#: Bytes of texts that meet a block of languages before the next is loaded, where there are several.
SLICE_BYTES = 8_000_000
#: Values that a worker's cache of word scores holds before it starts anew (8 bytes each).
CACHE_VALUES = 4_000_000


def vocabulary(path: str | None = None) -> list[str]:
    """The vocabulary's pieces that are made of lower-case letters, with or without the mark of a word's start."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    return sorted({p for p in pieces if (q := p.removeprefix(MARK)).isalpha() and q == q.lower() and len(q) <= 24} | {MARK})


def chunks(text: str) -> list[str]:
    """The words of a training text, in stretches of at most CHUNK letters."""
    words = WORD.findall(text.lower())
    if any(len(w) > CHUNK for w in words):
        words = [w[k : k + CHUNK] for w in words for k in range(0, len(w), CHUNK)]
    return words


class Pieces:
    """The vocabulary as a table from piece to number; number 0 is the unknown piece."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: k for k, p in enumerate(pieces, 1)}
        self.longest = max(map(len, pieces))

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece in the marked word, by end; a letter that is no piece is unknown."""
        word, ids, longest = MARK + word, self.ids, self.longest
        out = []
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                piece = ids.get(word[start:end], 0)
                if piece or start == end - 1:
                    out.append((start, end, piece))
        return out


def forward(edges: list[tuple[int, int, int]], size: int, probabilities: np.ndarray) -> np.ndarray:
    """Forward sums at each place, a row for each place and a column for each language."""
    sums = np.zeros((size + 1, probabilities.shape[1]))
    sums[0] = 1
    for start, end, piece in edges:
        sums[end] += sums[start] * probabilities[piece]
    return sums


def _expected(counts: Iterator[pa.RecordBatch], pieces: Pieces, probabilities: np.ndarray, languages: dict[str, int]) -> np.ndarray:
    """Expected uses of every piece (rows) by language (columns) in counted words (lang, word, n)."""
    out, by_language = np.zeros(probabilities.shape), probabilities.T.tolist()
    for batch in counts:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = languages[lang]
            p, edges, size = by_language[k], pieces.edges(word), len(word) + 1
            weights = [p[piece] for _, _, piece in edges]
            if size > SHORT:
                _expected_of_long(edges, [log(w) for w in weights], size, n, k, out)
                continue
            alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
            alpha[0] = beta[size] = 1.0
            for (start, end, _), w in zip(edges, weights, strict=True):
                alpha[end] += alpha[start] * w
            for (start, end, _), w in zip(reversed(edges), reversed(weights), strict=True):
                beta[start] += beta[end] * w
            for (start, end, piece), w in zip(edges, weights, strict=True):
                out[piece, k] += n * alpha[start] * w * beta[end] / alpha[size]
    return out


def _expected_of_long(edges: list[tuple[int, int, int]], logs: list[float], size: int, n: int, k: int, out: np.ndarray) -> None:
    """Adds a long word's expected uses, whose sums would underflow, by their logarithms."""
    none = float("-inf")
    alpha, beta = [none] * (size + 1), [none] * (size + 1)
    alpha[0] = beta[size] = 0.0
    for (start, end, _), w in zip(edges, logs, strict=True):
        alpha[end] = _log_sum(alpha[end], alpha[start] + w)
    for (start, end, _), w in zip(reversed(edges), reversed(logs), strict=True):
        beta[start] = _log_sum(beta[start], beta[end] + w)
    for (start, end, piece), w in zip(edges, logs, strict=True):
        out[piece, k] += n * exp(min(0.0, alpha[start] + w + beta[end] - alpha[size]))


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == float("-inf") else a + log(1 + exp(b - a))


def smoothed(counts: np.ndarray, add: float = 0.05) -> np.ndarray:
    return (counts + add) / (counts.sum(axis=0) + add * len(counts))


#: Languages, pieces and piece probabilities by language, of one block of languages.
Block = tuple[list[str], list[str], np.ndarray]


def learn(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, block: int = BLOCK_LANGUAGES, rounds: int = ROUNDS, path: str | None = None) -> list[Block]:
    """The model, a block for each `block` languages, from the labelled rows (lang, text, doc_id).

    Ids are ranked without their texts; a block's `block` * `docs_per_language` ids are broadcast at most. The driver
    gets a row for each language.
    """
    known = labelled.select("lang", "doc_id", "text").where("lang is not null and text is not null and doc_id is not null")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    pieces, out = vocabulary(path), []
    for at in range(0, len(languages), block):
        mine = languages[at : at + block]
        rows = known if len(mine) == len(languages) else known.where(F.col("lang").isin(mine))
        found = _learn_block(rows, mine, pieces, docs_per_language, rounds)
        if found is not None:
            out.append(found)
    return out


def _learn_block(known: DataFrame, languages: list[str], pieces: list[str], docs_per_language: int, rounds: int) -> Block | None:
    """The expected counts are summed by tasks over the sample's distinct words; the driver gets (language, piece) sums."""

    def split(part: pa.RecordBatch) -> dict:
        counted = [(lang, w, n) for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True) for w, n in Counter(chunks(text)).items()]
        return dict(zip(("lang", "word", "n"), map(list, zip(*counted, strict=True)), strict=True)) if counted else {"lang": [], "word": [], "n": []}

    ids = cut(drawn(known.select("lang", "doc_id"), "lang", docs_per_language).distinct())
    sample = one_text(known, ids, ["lang", "doc_id"]).select("lang", "text")
    words = map_slices(sample, split, "lang string, word string, n long", ["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()])
    words = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not languages:
        return None
    index = {x: k for k, x in enumerate(languages)}
    probabilities = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    for _ in range(rounds):
        shared = known.sparkSession.sparkContext.broadcast(probabilities)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = _expected(batches, Pieces(pieces), shared.value, index)
            at, k = np.nonzero(found)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int64()), "k": pa.array(k, pa.int64()), "n": pa.array(found[at, k])})

        sums = words.mapInArrow(count, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(probabilities.shape)
        counts[sums["piece"].to_numpy(), sums["k"].to_numpy()] = np.round(sums["n"].to_numpy(), 6)
        probabilities = smoothed(counts)
        shared.unpersist()
    return languages, pieces, probabilities


class Scorer:
    """Scores texts; keeps the log probabilities of words it has met in a table of bounded size."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray):
        self.languages, self.pieces, self.probabilities = languages, Pieces(pieces), probabilities
        self.most = max(1000, CACHE_VALUES // max(len(languages), 1))
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, len(languages)))

    def _add(self, words: Iterable[str]) -> None:
        """Scores new words, all of one length at a time, so many at once that their sums stay small."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            step = max(1, 1_000_000 // ((size + 2) * len(self.languages)))
            for at in range(0, len(group), step):
                self._add_some(size, group[at : at + step])

    def _add_some(self, size: int, group: list[str]) -> None:
        ids, longest, first = self.pieces.ids, self.pieces.longest, len(self.rows)
        if first + len(group) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(len(self.logs), len(group)), self.logs.shape[1]))])
        sums = np.zeros((size + 2, len(group), len(self.languages)))
        sums[0] = 1
        for end in range(1, size + 2):
            for start in range(max(0, end - longest), end):
                which = np.array([ids.get(w[start - 1 : end - 1] if start else MARK + w[: end - 1], 0) for w in group])
                if start == end - 1:
                    sums[end] += sums[start] * self.probabilities[which]
                elif len(some := np.flatnonzero(which)):
                    sums[end, some] += sums[start, some] * self.probabilities[which[some]]
        self.rows.update(zip(group, range(first, first + len(group)), strict=True))
        self.logs[first : first + len(group)] = np.log(np.maximum(sums[size + 1], 1e-300))

    def whole(self, word: str) -> np.ndarray:
        """The log probabilities of a word of any length. The last sums are held alone, each language's scaled to its newest."""
        word, ids, longest = MARK + word, self.pieces.ids, self.pieces.longest
        sums, scale = np.zeros((longest + 1, len(self.languages))), np.zeros(len(self.languages))
        sums[0] = 1
        for end in range(1, len(word) + 1):
            new = np.zeros(len(self.languages))
            for start in range(max(0, end - longest), end):
                piece = ids.get(word[start:end], 0)
                if piece or start == end - 1:
                    new += sums[start % (longest + 1)] * self.probabilities[piece]
            sums[end % (longest + 1)] = new
            if end % 16 == 0:
                sums /= new
                scale += np.log(new)
        return np.log(sums[len(word) % (longest + 1)]) + scale

    def _sums(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """The sum of the words' log probabilities for each list of words, nothing for an empty one."""
        new = {w for words in texts for w in words if len(w) <= SHORT} - self.rows.keys()
        if len(self.rows) + len(new) > self.most:
            self.rows.clear()
            self.logs = self.logs[:1024]
            new = {w for words in texts for w in words if len(w) <= SHORT}
        self._add(new)
        out: list[np.ndarray | None] = []
        for words in texts:
            total = self.logs[[self.rows[w] for w in words if len(w) <= SHORT]].sum(axis=0)
            for w, n in Counter(w for w in words if len(w) > SHORT).items():
                total = total + n * self.whole(w)
            out.append(total if words else None)
        return out

    def totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The log probabilities of each text by language, nothing for a text without words."""
        out = self._sums([WORD.findall(t.lower()) if t and len(t) <= LONG_TEXT else [] for t in texts])
        for k, text in enumerate(texts):
            if text and len(text) > LONG_TEXT:
                words = (m[0] for m in WORD.finditer(text.lower()))
                while some := list(islice(words, SLICE_WORDS)):
                    more = self._sums([some])[0]
                    out[k] = more if out[k] is None else out[k] + more
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return judged([lambda: self], texts)


def judged(scorers: list, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Each text's likeliest language and its posterior over the languages of all blocks, by what gives each block's scorer."""
    names, tops, mass = ["und"] * len(texts), [None] * len(texts), [0.0] * len(texts)
    for scorer in scorers:
        block = scorer()
        if not block.languages:
            continue
        for k, total in enumerate(block.totals(texts)):
            if total is None:
                continue
            best = int(np.argmax(total))
            top = float(total[best])
            here = float(np.exp(total - top).sum())
            if tops[k] is None or top > tops[k]:
                mass[k] = here + (mass[k] * exp(max(tops[k] - top, -700.0)) if tops[k] is not None else 0.0)
                names[k], tops[k] = block.languages[best], top
            else:
                mass[k] += here * exp(max(top - tops[k], -700.0))
    return names, [0.0 if top is None else 1 / m for top, m in zip(tops, mass, strict=True)]


def identify(docs: DataFrame, model: list[Block], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of `docs` with the prediction and its score, named so, in place of whatever columns had those names."""
    blocks = [docs.sparkSession.sparkContext.broadcast(Held(Scorer, *block)) for block in model]
    keep = [c for c in docs.columns if c not in names]
    docs = docs.select(*map(quoted, keep))
    place, columns = keep.index("text"), [*keep, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = len(blocks) == 1
        scorers = [lambda b=b: b.value() if alone else b.load_from_path(b._path)() for b in blocks]  # one block in memory at a time
        for part in slices(batches) if alone else slices_by_bytes(batches, place, SLICE_BYTES):
            lang, score = judged(scorers, part.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=columns)

    return map_rows(docs, run, docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """The columns of query op2: learned from rows whose crc32 bucket of 3 is not 1, applied to every row."""
    held = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))
    model = learn(docs.where(~held))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
