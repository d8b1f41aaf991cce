import hashlib
import random

import pytest

from millrace.llm.decontam import Automaton, contamination, contamination_digest, remove_contamination, words_of


def brute(words, items, window=8):
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        for at in range(len(item) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == item[at : at + n]:
                    hit |= set(range(k, k + n))
                    found.add(name)
    return hit, found


@pytest.mark.parametrize("seed", range(60))
def test_automaton_finds_every_window(seed):
    draw = random.Random(seed)
    letters = "abc"[: 2 + seed % 2]
    items = [(str(k), draw.choices(letters, k=draw.randint(0, 14))) for k in range(draw.randint(1, 6))]
    window = draw.randint(1, 8)
    automaton = Automaton(items, window)
    for _ in range(20):
        words = draw.choices(letters + "z", k=draw.randint(0, 40))
        spans, found = automaton.match(words)
        hit, named = brute(words, items, window)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == named
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_words():
    assert words_of("Ab-C9 ÉÀ_x\ty") == ["ab", "c9", "ÉÀ", "x", "y"]
    assert words_of(None) == [] == words_of("")


@pytest.fixture
def benchmark(spark):
    rows = [(1, "one two three four five six seven eight nine"), (2, "red green blue"), (3, None), (4, "..."), (2, "red green blue"), (None, "a lonely item of exactly eight words is")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_digest(spark, docs, benchmark):
    text = "x One two, three four five six seven EIGHT y red green blue z"
    rows = docs((1, text), (2, None), (3, ""), (4, "one two three four five six seven"), (5, "red green blue " * 5000), (1, text))
    got = contamination_digest(rows, benchmark).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and (by[1]["n_words"], by[1]["n_hit"], by[1]["n_items"], by[1]["contaminated"]) == (14, 11, 2, True)
    assert by[1]["items_sha256"] == hashlib.sha256(b"1,2").hexdigest() and by[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[4]["n_hit"] == 0 and by[5]["n_hit"] == 15000 and not by[5]["contaminated"]


def test_several_blocks_agree_with_one(spark, docs, benchmark):
    rows = docs((1, "one two three four five six seven eight nine red green blue"), (2, "a lonely item of exactly eight words is here"))
    assert contamination(rows, benchmark, block_words=5).collect() == contamination(rows, benchmark).collect()


def test_no_benchmark(spark, docs, benchmark):
    assert [r["n_hit"] for r in contamination_digest(docs((1, "a b c")), benchmark.limit(0)).collect()] == [0]
    assert contamination_digest(docs((1, "a")).limit(0), benchmark).collect() == []


def test_removal(spark, docs, benchmark):
    clean = "nothing to see here, " * 10
    passage = "One two three four five six seven eight nine"
    rows = docs((1, clean), (2, clean + passage + ". The end"), (3, passage), (4, None), (5, "red green blue and some more"))
    got = {r["doc_id"]: r for r in remove_contamination(rows, benchmark).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1]["text"] == clean and got[2]["text"] == clean + ". The end" and got[2]["n_chars"] == len(got[2]["text"]) and got[5]["text"].startswith("red")


def test_documents_of_short_items_go(spark, docs):
    items = ["which planet is the red one", "name the capital of old france", "how many legs has a spider"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    passage = "a long passage that is put in with nine words"
    benchmark = benchmark.union(spark.createDataFrame([(9, passage)], "item_id long, text string"))
    rest = "nothing of this is in any item at all"
    rows = docs((1, ", then ".join(items)), (2, f"{rest} {items[0]} {rest}"), (3, f"{items[0]} x {items[1]} y {passage} z and then"), (4, f"{items[0]} {rest} {passage} {rest} end"))
    assert {r["doc_id"]: r["contaminated"] for r in contamination_digest(rows, benchmark).collect()}[1]
    got = {r["doc_id"]: r["text"] for r in remove_contamination(rows, benchmark).collect()}
    assert got == {2: f"{rest} {items[0]} {rest}", 4: f"{items[0]} {rest}  {rest} end"}


def test_several_blocks_and_small_slices_give_the_same(spark, docs, monkeypatch):
    import random

    from millrace.llm import decontam as d

    draw = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(draw.choices(words, k=draw.randint(3, 30)))) for k in range(12)]
    texts = [(k, " ".join(draw.choices(words, k=20)) + " " + draw.choice(items)[1] + " " + " ".join(draw.choices(words, k=20)) if k % 3 else None) for k in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = {str(r) for r in d.contamination(docs(*texts), benchmark).collect()}
    monkeypatch.setattr(d, "SLICE_BYTES", 700)
    assert len(d.automata(benchmark, block_words=70)) >= 3
    assert {str(r) for r in d.contamination(docs(*texts), benchmark, block_words=70).collect()} == one
