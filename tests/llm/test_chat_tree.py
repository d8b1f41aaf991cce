import hashlib
import random

import pytest

from millrace.llm import chat_tree as c


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\\\###", "### x </turn>\n", c.TRAP, "####", "</turn>\\", "a\nb: c", "\\n"])
def test_turns_round_trip(text):
    for role in ("user", "assistant", "a: b", "### ", "", "x\\"):
        formatted, low, high = c.format_turn(role, text)
        assert c.parse_turn(formatted) == (role, text) and c.unescape(formatted[low:high]) == text
        assert formatted.index(c.CLOSE) == len(formatted) - len(c.CLOSE)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def expected(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in conversations.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss), sum(len(c.format_turn(r, t)[0]) for _, r, t in turns))
    return out


@pytest.mark.parametrize(("tokens", "most"), [(500_000, 2000), (60, 3)])
def test_every_conversation_reads_back(spark, tokens, most):
    draw = random.Random(6)
    rows = []
    for conv in range(120):
        for turn in range(draw.randint(1, 5)):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], draw.choice(["hi", "### x", c.TRAP, "é \\", "b"]) if turn else "shared start"))
    rows += [(500, 0, None, None), (501, None, "user", "no turn"), (501, 0, "user", "b"), (501, 0, "user", "a"), (501, 0, "user", "a"), (None, 0, "user", "null id"), (502, 0, "assistant", "x" * 100_000)]
    packs = c.packs(rows_of(spark, rows), tokens, most)
    got = {r["conv_id"]: tuple(r)[1:] for r in c.read_back(packs).collect()}
    assert got == expected(rows)


def test_shared_turns_are_written_once_depth_first(spark):
    rows = [(k, t, "user", text) for k, path in enumerate([["a", "b"], ["a", "c"], ["a", "b", "d"], ["a"], ["e"], ["a", "b"]]) for t, text in enumerate(path)]
    packs = c.packs(rows_of(spark, rows).coalesce(1).repartition(1)).collect()
    nodes = [(n, p["text"]) for p in packs for n in p["nodes"]]
    texts = sorted(c.parse_turn(t[n["start"] : n["end"]])[1] for n, t in nodes)
    if len(packs) == 1:
        assert texts == ["a", "b", "c", "d", "e"]
    for p in packs:
        for k, n in enumerate(p["nodes"]):
            assert n["parent"] < k
            above = p["nodes"][n["parent"]] if n["parent"] >= 0 else None
            assert n["position"] == (above["position"] + above["end"] - above["start"] if above else 0)
            assert sum(a["end"] - a["start"] for a in n["attends"]) == n["position"]


def test_trap_and_empty_table(spark):
    none = rows_of(spark, [])
    assert c.packs(none).collect() == []
    got = c.read_back(c.packs(c.with_trap(spark, none))).collect()
    assert [r["conv_id"] for r in got] == [-7] and got[0]["loss_chars"] == len(c.TRAP)


def one_partition(spark, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return c.packs(rows_of(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


PATHS = [["a", "b"], ["a", "c"], ["a", "b", "d"], ["a"], ["e"], ["a", "b"]]


def test_one_pack_holds_each_shared_turn_once(spark):
    (pack,) = one_partition(spark, [(k, t, "user", text) for k, path in enumerate(PATHS) for t, text in enumerate(path)])
    said = [c.parse_turn(pack["text"][n["start"] : n["end"]])[1] for n in pack["nodes"]]
    assert sorted(said) == ["a", "b", "c", "d", "e"] and len(pack["conversations"]) == len(PATHS)
    assert said.index("d") == said.index("b") + 1  # depth first
    assert pack["text"] == "".join(c.format_turn("user", x)[0] for x in said)


def test_tokens_read_back(spark):
    from tokenizers import Tokenizer

    from millrace.llm.token_counts import tokenizer_path

    path = tokenizer_path(c.TOKENIZER)
    model = Tokenizer.from_file(path)
    draw = random.Random(9)
    rows = [(k, t, ("user", "assistant")[t % 2], draw.choice(["hi there", "", "<|endoftext|>", c.TRAP, "é \\ 語", None]) if t else "shared start") for k in range(60) for t in range(draw.randint(1, 5))]
    rows += [(None, 0, None, "no id"), (900, 0, "assistant", "x " * 20_000)]
    chars = c.packs(rows_of(spark, rows), 400, 7)
    plain = {r["conversations"][0]["conv_id"]: r for r in chars.collect()}
    packs = c.tokenized(chars, path).collect()
    assert len(packs) == len(plain) > 1
    want, seen = expected(rows), 0
    for p in packs:
        ids, nodes, text = p["token_ids"], p["nodes"], plain[p["conversations"][0]["conv_id"]]
        decode = lambda a, b: model.decode(ids[a:b], skip_special_tokens=False)  # noqa: B023, E731
        assert [n["start"] for n in nodes] == [0, *(n["end"] for n in nodes[:-1])] and nodes[-1]["end"] == len(ids)
        for n, m in zip(nodes, text["nodes"], strict=True):
            assert decode(n["start"], n["end"]) == text["text"][m["start"] : m["end"]]
            assert decode(n["loss_start"], n["loss_end"]) == text["text"][m["loss_start"] : m["loss_end"]]
            assert n["parent"] == m["parent"] and sum(a["end"] - a["start"] for a in n["attends"]) == n["position"]
        for leaf in p["conversations"]:
            n = nodes[leaf["node"]]
            whole = "".join(decode(a["start"], a["end"]) for a in n["attends"]) + decode(n["start"], n["end"])
            assert len(whole) == want[leaf["conv_id"]][4]
            seen += 1
    assert seen == len(want)
    assert c.tokenized(c.packs(rows_of(spark, [])), path).collect() == []
