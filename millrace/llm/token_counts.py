"""Token counts by the whole-token shortcut.

A byte-pair vocabulary's merges send many strings to one token by themselves. Which ones is proved once, offline,
on the driver: every vocabulary string that ends a word is turned back into text and run through the model; those
that come out as one token form the whole-token table. Counting then looks each pre-token up in that table and runs
the merges only for the rest, whose counts are memoised for a bounded number of strings.

The text's way to pre-tokens follows the tokenizer file: special strings are split off first and count as one token,
what is between them is normalised and cut by the file's own pattern. Text of Latin letters takes Python's
lower-casing, which agrees there with the library's; any other text takes the library's normaliser.

Defined results: a null text is an empty one; rows are counted one by one, whatever their ids; texts are neither cut
nor padded, and no begin or end tokens are added.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import Held

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Strings, beside the whole tokens, of which a worker remembers the count, and their letters at most: 40 MB or so.
MEMO, MEMO_LETTERS = 300_000, 40
#: Texts beyond so many characters are counted pre-token by pre-token, without a list of them.
LONG = 1_000_000
_OTHER_SCRIPTS = regex.compile(r"[^\x00-ɏ]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next free one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Counts(dict):
    """Pre-token -> number of tokens; unknown ones are merged by the model and remembered."""

    def __init__(self, model, letters: dict[int, str], whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.letters, self.most = model, letters, len(whole) + MEMO

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            for key in [k for k, n in self.items() if n != 1]:
                del self[key]
        n = len(self.model.tokenize("".join([self.letters[b] for b in word.encode()])))
        if len(word) <= MEMO_LETTERS:
            self[word] = n
        return n


class Counter:
    def __init__(self, source: str, whole: list[str] | None = None):
        file = json.loads(source)
        self.library = Tokenizer.from_str(source)
        kinds = [x["type"] for x in file["normalizer"]["normalizers"]], [x["type"] for x in file["pre_tokenizer"]["pretokenizers"]], file["model"]["type"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE"):
            raise ValueError(f"a tokenizer of another make: {kinds}")
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("special strings that take in their surroundings")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = byte_letters()
        self.counts = Counts(self.library.model, self.letters, whole if whole is not None else [])

    def prove_whole(self) -> list[str]:
        """The texts of the vocabulary strings that the normaliser keeps, that are one pre-token, and that the merges make that one token."""
        bytes_of = {letter: b for b, letter in self.letters.items()}
        out = []
        for piece, number in self.library.get_vocab(with_added_tokens=False).items():
            body = piece.removesuffix("</w>")
            if body == piece or not body:
                continue
            try:
                text = bytes(bytes_of[c] for c in body).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            stays = self.library.normalizer.normalize_str(text) == text and self.words.findall(text) == [text]
            if stays and [t.id for t in self.library.model.tokenize(body)] == [number]:
                out.append(text)
        return sorted(out)

    def _part(self, text: str) -> int:
        text = self.library.normalizer.normalize_str(text) if _OTHER_SCRIPTS.search(text) else text.lower()
        if len(text) > LONG:
            return sum(self.counts[m[0]] for m in self.words.finditer(text))
        return sum(map(self.counts.__getitem__, self.words.findall(text)))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text or not (found := self.special.findall(text)):
            return self._part(text)
        return len(found) + sum(self._part(x) for x in self.special.split(text) if x)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. The tokenizer file (of fixed size) is broadcast with the proved table."""
    with open(path or tokenizer_path(), encoding="utf-8") as file:
        source = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(Held(Counter, source, Counter(source).prove_whole()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                n = [count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
