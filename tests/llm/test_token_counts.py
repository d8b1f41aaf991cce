import random
import unicodedata

import pytest

from millrace.llm.token_counts import Counter, count_tokens, tokenizer_path


@pytest.fixture(scope="module")
def counter():
    with open(tokenizer_path(), encoding="utf-8") as file:
        source = file.read()
    return Counter(source, Counter(source).prove_whole())


def test_counts_are_the_librarys(counter):
    draw = random.Random(4)
    pool = [c for c in map(chr, range(32, 0x2100)) if unicodedata.category(c) != "Cn"] + ["'s", "'LL", "<|endoftext|>", "<|endoftext", "İ", "ΑΣ ", "ﬁ", "😀", "é", "\x85", "\x1c", " ", "the ", "Ordinary words, here. "]
    texts = ["", " ", "don't <|startoftext|>x<|endoftext|>"] + ["".join(draw.choices(pool, k=draw.randint(1, 40))) for _ in range(3000)]
    for text, found in zip(texts, counter.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert counter(text) == len(found.ids), text


def test_whole_tokens_are_proved(counter):
    assert "the" in counter.counts and len(counter.counts) > 30000
    for word in random.Random(1).sample(sorted(w for w, n in counter.counts.items() if n == 1), 500):
        assert len(counter.library.encode(word, add_special_tokens=False).ids) == 1


def test_rows(spark, docs):
    got = count_tokens(docs((1, "The cat's hat"), (2, None), (3, ""), (4, "é " * 3000), (1, "The cat's hat"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1]["n_tokens"] == 4 and by[1]["n_bytes"] == 13
    assert (by[2]["n_tokens"], by[2]["n_bytes"], by[3]["n_tokens"]) == (0, 0, 0)
    assert by[4]["n_tokens"] == 3000 and by[4]["over_limit"] and by[4]["n_bytes"] == 9000
    assert count_tokens(docs((1, "a")).limit(0)).collect() == []


def test_long_texts_and_long_words(counter):
    text = "Some words, and_then " * 60_000 + "x" * 50_000
    assert counter(text) == len(counter.library.encode(text, add_special_tokens=False).ids)
    assert max(map(len, counter.counts)) < 200
