"""Benchmark decontamination with a generalised suffix automaton over item words.

The normalised benchmark items go into one suffix automaton whose letters are words. Documents stream through it:
at each word the automaton follows a transition, or falls back along suffix links, and so knows the longest run of
words ending there that occurs in any item. A run of at least `window` words means that a whole window of some item
ends there; the state of its last `window` words names the items. Items shorter than a window are matched whole.

The automaton is built on the driver from blocks of at most BLOCK_WORDS item words and broadcast; benchmarks beyond
that make several blocks, each of which a task loads, runs over its slice of documents, and drops. Documents are
never shuffled, and a slice's memory does not depend on the benchmark's size.

Defined results: null text has no words; an empty benchmark hits nothing; items without words never occur; a null
item_id is named "null"; rows with the same item_id are one item; documents keep their rows, repeated ones included.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, slices, slices_by_bytes

WINDOW = 8
#: Words of benchmark items in one automaton: about 150 MB of Python objects at most.
BLOCK_WORDS = 300_000
#: Bytes of texts that meet a block before the next is loaded, where there are several.
SLICE_BYTES = 16_000_000
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """The words of a text: A-Z lower-cased, cut at every ASCII character but letters and digits."""
    return WORDS.findall(text.translate(_LOWER)) if text else []


class Automaton:
    """Suffix automaton of the items; states are numbers, words are numbers, `next` maps state << 32 | word to a state."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        self.word_ids: dict[str, int] = {}
        self.next: dict[int, int] = {}
        self.length, self.link = array("q", [0]), array("q", [-1])
        out: list[list[int]] = [[]]  # words that leave each state, needed when a state is cloned
        runs = [[self.word_ids.setdefault(w, len(self.word_ids)) for w in words] for _, words in items]
        for run in runs:
            last = 0
            for word in run:
                last = self._extend(last, word, out)
        #: Items whose window is the run of `self.ends_length` words that a state stands for.
        self.ends: dict[int, list[tuple[int, set[int]]]] = {}
        for k, run in enumerate(runs):
            need = min(window, len(run))
            at = held = 0
            for word in run:
                at, held = self.step(at, held, word)
                if held >= need and need:
                    self._mark(self._state_of(at, need), need, k)
        self.reach = self._reach()

    def _extend(self, last: int, word: int, out: list[list[int]]) -> int:
        following = self.next.get(last << 32 | word)
        if following is not None and self.length[following] == self.length[last] + 1:
            return following
        if following is not None:
            return self._clone(last, word, following, out)
        state = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        out.append([])
        p = last
        while p >= 0 and (p << 32 | word) not in self.next:
            self.next[p << 32 | word] = state
            out[p].append(word)
            p = self.link[p]
        if p >= 0:
            q = self.next[p << 32 | word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q, out)
        return state

    def _clone(self, p: int, word: int, q: int, out: list[list[int]]) -> int:
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        out.append(list(out[q]))
        for w in out[q]:
            self.next[clone << 32 | w] = self.next[q << 32 | w]
        self.link[q] = clone
        while p >= 0 and self.next.get(p << 32 | word) == q:
            self.next[p << 32 | word] = clone
            p = self.link[p]
        return clone

    def step(self, state: int, held: int, word: int) -> tuple[int, int]:
        """The state and the number of words matched after one more word."""
        following = self.next.get(state << 32 | word)
        while following is None:
            state = self.link[state]
            if state < 0:
                return 0, 0
            held = self.length[state]
            following = self.next.get(state << 32 | word)
        return following, held + 1

    def _state_of(self, state: int, need: int) -> int:
        """The state that stands for the last `need` words of what `state` has matched."""
        while self.length[self.link[state]] >= need:
            state = self.link[state]
        return state

    def _mark(self, state: int, need: int, item: int) -> None:
        marks = self.ends.setdefault(state, [])
        for length, found in marks:
            if length == need:
                found.add(item)
                return
        marks.append((need, {item}))

    def _reach(self) -> dict[int, tuple[tuple[int, tuple[int, ...]], ...]]:
        """For each state, the windows that can end where it is reached: its own and its suffixes', by length."""
        reach: dict[int, tuple] = {0: ()}
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            own = tuple((length, tuple(sorted(found))) for length, found in self.ends.get(state, ()))
            reach[state] = reach[self.link[state]] + own
        return {state: tuple(sorted(x)) for state, x in reach.items() if x}

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit runs of words, as merged (start, end) pairs, and the names of the items whose windows occur."""
        following, get_id, reach, link, length = self.next.get, self.word_ids.get, self.reach, self.link, self.length
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = held = 0
        for at, text in enumerate(words, 1):
            word = get_id(text)
            if word is None:
                state = held = 0
                continue
            to = following(state << 32 | word)
            while to is None:
                state = link[state]
                if state < 0:
                    break
                held = length[state]
                to = following(state << 32 | word)
            if to is None:
                state = held = 0
                continue
            state, held = to, held + 1
            windows = reach.get(state)
            if windows:
                longest = 0
                for size, items in windows:
                    if size <= held:
                        found.update(items)
                        longest = size if size > longest else longest
                if longest:
                    start = at - longest
                    while spans and spans[-1][1] >= start:  # a longer window may reach back over earlier spans
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, {self.names[k] for k in found}


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The items in blocks of at most `block_words` words (a single longer item is a block of its own)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text").where("text is not null")
    held, size = [], 0
    for row in rows.orderBy("name", "text").toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if held and size + len(words) > block_words:
            yield held
            held, size = [], 0
        held.append((row["name"], words))
        size += len(words)
    if held:
        yield held


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(Automaton(block, window)) for block in _blocks(benchmark, block_words)]


def _match_all(blocks: list[Broadcast], texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """The number of words, and match() against every block, of each text; with several blocks, one is in memory at a time."""
    found: list[tuple[int, list, set]] = [(0, [], set()) for _ in texts]
    for block in blocks or [None]:
        automaton = block and (block.value if len(blocks) == 1 else block.load_from_path(block._path))
        for k, text in enumerate(texts):
            words = words_of(text)
            spans, names = automaton.match(words) if automaton else ([], set())
            found[k] = (len(words), _merged(found[k][1] + spans) if found[k][1] and spans else found[k][1] or spans, found[k][2] | names)
    return found


def _pieces(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast], place: int) -> Iterator[pa.RecordBatch]:
    return slices(batches) if len(blocks) <= 1 else slices_by_bytes(batches, place, SLICE_BYTES)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (word positions hit, ends exclusive), items (names of items that occur, sorted) for each row."""
    blocks = automata(benchmark, window, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, blocks, 1):
            found = _match_all(blocks, part.column(1).to_pylist())
            hits = [[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(hits, span), pa.array([sorted(names) for _, _, names in found], pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of query op3, from contamination()."""
    found = contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the runs of words `spans`, put together once."""
    out, done, edges = [], 0, {k for a, b in spans for k in (a, b - 1)}
    at = {k: m.span() for k, m in enumerate(WORDS.finditer(text.translate(_LOWER))) if k in edges}
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, max_run: int = WINDOW, max_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """`docs` without contaminated passages: same columns, n_chars brought up to date.

    A document of which hits cover more than `max_coverage`, items of a few words included, goes. Of the others a hit
    run of at least `max_run` words is cut out of the text; shorter hits stay, and so does every document without hits.
    """
    blocks = automata(benchmark, window)
    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, blocks, place):
            texts = part.column(place).to_pylist()
            keep = []
            for k, (n_words, spans, _) in enumerate(_match_all(blocks, texts)):
                keep.append(True)
                if not spans:
                    continue
                keep[-1] = sum(b - a for a, b in spans) <= max_coverage * n_words
                texts[k] = _without(texts[k], [x for x in spans if x[1] - x[0] >= max_run])
            columns = list(part.columns)
            columns[place] = pa.array(texts, part.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep, pa.bool_()))

    out = map_rows(docs, clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


#: Query op3 in SQL. Windows are joined as joined words, which contain no space.
SQL = """
WITH item AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS name, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT name, len(w[i:i + 7]) AS k, array_to_string(w[i:i + 7], ' ') AS run
  FROM (SELECT name, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM win),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
place AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
run AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM place, size WHERE i + k - 1 <= len(w)),
hit AS (SELECT r, i, run.k, name FROM run JOIN win ON run.run = win.run AND run.k = win.k),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
