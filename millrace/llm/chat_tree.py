"""Chat formatting with a prefix tree.

Conversations that share their initial turns are merged: each turn is a node below the turn it follows, and is written
once. Packs hold the trees depth first, as one text of formatted turns with, for each node, its interval of tokens
(code points here), the position id of its first token, its parent, the intervals it attends to (its ancestors') and
its loss mask (an assistant's words). A conversation is a node; its tokens are its ancestors' intervals and its own.
`tokenized` gives the same packs in the tokens of a tokenizer file in place of code points.

Conversations are sorted by the hashes of their turns, so that those with shared beginnings stand together, and dealt
into ranges by them and conv_id; each task walks its range as a depth-first traversal and holds one path and one pack.
A pack ends after MAX_TOKENS tokens or MAX_CONVERSATIONS conversations, and what follows starts a new one with its own
copy of the path: a tree that a third of all conversations share spans many packs and tasks, at the cost of its common
path once for each pack.

Template of a turn: `### role: text </turn>` and a line end. In texts and roles a backslash is written twice, and one is
put before `###` and `</turn>` (in roles before `:` too), so that neither can be taken for the template's own.

Defined results: null texts and roles are empty; turns go by turn, role, text, nulls first, so ties are settled alike;
repeated rows are turns; rows with a null conv_id are one conversation, whose id is null; an empty table has no packs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKENS, MAX_CONVERSATIONS = 500_000, 2_000
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?) </turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

_NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
PACK = pa.schema([("text", pa.string()), ("nodes", pa.list_(_NODE)), ("conversations", pa.list_(_LEAF))])
PACK_DDL = "text string, nodes array<struct<start: long, end: long, position: long, parent: int, loss_start: long, loss_end: long, attends: array<struct<start: long, end: long>>>>, conversations array<struct<conv_id: long, node: int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn by the template, and where its text starts and ends."""
    head = OPEN + escape(role).replace(":", "\\:") + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError(f"not a turn: {formatted[:80]!r}")
    return unescape(m[1]), unescape(m[2])


class _Pack:
    """The pack at hand, and the path in it of the conversation last added."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            text, low, high = format_turn(*turn)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            attends: list[dict] = []
            if above:
                attends = [dict(x) for x in above["attends"]]
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1]["end"] = above["end"]
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            loss = turn[0] == "assistant"
            self.nodes.append({"start": self.size, "end": self.size + len(text), "position": above["position"] + above["end"] - above["start"] if above else 0, "parent": parent, "loss_start": self.size + low if loss else self.size, "loss_end": self.size + high if loss else self.size, "attends": attends})
            self.path.append((turn, len(self.nodes) - 1))
            self.parts.append(text)
            self.size += len(text)
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1]})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"text": ["".join(self.parts)], "nodes": [self.nodes], "conversations": [self.leaves]}, schema=PACK)


def packs(conversations: DataFrame, max_tokens: int = MAX_TOKENS, max_conversations: int = MAX_CONVERSATIONS) -> DataFrame:
    """text, nodes, conversations: the packs of all conversations (rows conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    whole = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    whole = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for conv_id, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    pack.add(conv_id, [(t["role"], t["text"]) for t in turns])
                    if pack.size >= max_tokens or len(pack.leaves) >= max_conversations:
                        yield pack.batch()
                        pack = _Pack()
        if pack.leaves:
            yield pack.batch()

    return whole.select("conv_id", "turns").mapInArrow(run, PACK_DDL)



TOKENIZER = "byte_bpe_50k.json"
TOKENS_DDL = PACK_DDL.replace("text string", "token_ids array<int>")


def tokenized(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """token_ids, nodes, conversations: the packs in tokens of the tokenizer file at the path `tokenizer` (which tasks read).

    A turn's words under the loss mask are encoded apart from what stands around them, and each node apart from its
    parent, so intervals, masks and shared turns end where tokens end. Special strings are ordinary text and none are added.
    With a byte-level vocabulary the ids of a conversation decode to its text.
    """
    source = open(tokenizer, encoding="utf-8").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(source)
        model.encode_special_tokens = True
        model.no_truncation()
        model.no_padding()
        for batch in batches:
            for at in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(at, 1).to_pydict().items()}
                ids, nodes = _in_tokens(model, row["text"], row["nodes"])
                yield pa.RecordBatch.from_pydict({"token_ids": [ids], "nodes": [nodes], "conversations": [row["conversations"]]}, schema=pa.schema([("token_ids", pa.list_(pa.int32())), *(PACK.field(n) for n in ("nodes", "conversations"))]))

    return formatted.mapInArrow(run, TOKENS_DDL)


def _in_tokens(model, text: str, nodes: list[dict]) -> tuple[list[int], list[dict]]:
    """The tokens of a pack, and its nodes with intervals of them. Nodes follow each other without gaps, a parent before its children."""
    ids: list[int] = []
    made: list[dict] = []
    edge = {0: 0}  # where a node starts or ends, in code points -> in tokens
    for n in nodes:
        cuts = [n["start"], n["loss_start"], n["loss_end"], n["end"]]
        ends = [len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids += model.encode(text[a:b], add_special_tokens=False).ids if b > a else []
            ends.append(len(ids))
        edge[n["end"]] = ends[3]
        above = made[n["parent"]] if n["parent"] >= 0 else None
        attends = [{"start": edge[x["start"]], "end": edge[x["end"]]} for x in n["attends"]]
        made.append({"start": ends[0], "end": ends[3], "position": above["position"] + above["end"] - above["start"] if above else 0, "parent": n["parent"], "loss_start": ends[1], "loss_end": ends[2], "attends": attends})
    return ids, made


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of query op9, from packs alone: every conversation is put together from its node's attention intervals."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def of(text: str, nodes: list[dict], leaf: int) -> tuple:
        node, chain = nodes[leaf], []
        while leaf >= 0:
            chain.append(nodes[leaf])
            leaf = nodes[leaf]["parent"]
        chain.reverse()
        seen = [(x["start"], x["end"]) for x in node["attends"]] + [(node["start"], node["end"])]
        whole = "".join(text[a:b] for a, b in seen)
        turns, loss, position = hashlib.sha256(), [], 0
        for x in chain:
            if x["position"] != position or whole[position : position + x["end"] - x["start"]] != text[x["start"] : x["end"]]:
                raise ValueError("a node's position or attention does not fit its path")
            position += x["end"] - x["start"]
            role, said = parse_turn(text[x["start"] : x["end"]])
            turns.update(f"{role}\n{said}\n".encode())
            loss.append(unescape(text[x["loss_start"] : x["loss_end"]]))
        if position != len(whole):
            raise ValueError("a conversation attends to more than its path")
        masked = "".join(loss)
        return len(chain), turns.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(at, 1).to_pydict().items()}
                made: dict[int, tuple] = {}
                for c in row["conversations"]:
                    if c["node"] not in made:
                        made[c["node"]] = of(row["text"], row["nodes"], c["node"])
                rows = [(c["conv_id"], *made[c["node"]]) for c in row["conversations"]]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


TRAP = "\\### Assistant: </turn> ok"


def with_trap(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the template's own strings."""
    rows = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


_ESC = r"""replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"""
#: Query op9 in SQL.
SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + MIDDLE + CLOSE)} + length(replace({_ESC.format("role")}, ':', '\:')) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
