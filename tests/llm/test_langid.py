import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.langid import MARK, Pieces, Scorer, chunks, forward, held_out_languages, identify, learn, vocabulary

WORDS = {"xx": ["the", "and", "thing", "other", "rather", "with"], "yy": ["que", "les", "eaux", "dans", "ment", "nous"]}


def brute(word, pieces, probabilities, language):
    """The sum over all segmentations, one by one."""
    word = MARK + word

    def rest(at):
        if at == len(word):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(word) + 1):
            piece = pieces.ids.get(word[at:end], 0)
            if piece or end == at + 1:
                total += probabilities[piece, language] * rest(end)
        return total

    return rest(0)


def test_scores_sum_over_all_segmentations():
    pieces = [MARK, MARK + "th", "t", "h", "e", "he", "the", MARK + "the", "r"]
    p = np.random.default_rng(0).random((len(pieces) + 1, 2))
    table, scorer = Pieces(pieces), Scorer(["a", "b"], pieces, p)
    scorer(["the there tré x"])
    for word in ("the", "there", "tré", "x"):
        for k in range(2):
            want = brute(word, table, p, k)
            assert math.exp(scorer.logs[scorer.rows[word], k]) == pytest.approx(want)
            assert forward(table.edges(word), len(word) + 1, p)[-1, k] == pytest.approx(want)


def test_long_words_are_scored_whole():
    assert "".join(chunks("a" * 100 + " b")) == "a" * 100 + "b"


def test_vocabulary_is_fixed():
    found = vocabulary()
    assert found == sorted(set(found)) and MARK in found and len(found) > 5000


def made(spark, n=60, extra=()):
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choices(WORDS[lang], k=12)), lang) for k in range(n) for lang in [("xx", "yy")[k % 2]]]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")


def test_held_out_predictions(spark):
    extra = [(100, None, "xx"), (101, "", None), (102, "12 34 !!", "yy"), (103, "the thing", None), (104, "eaux " * 20000, None), (105, "the", "xx"), (105, "the", "xx"), (None, "dans les eaux", None)]
    rows = made(spark, extra=extra).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(-1))
    got = held_out_languages(rows).collect()
    assert len(got) == 68
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and by[103]["lang_pred"] == "xx" and by[104]["lang_pred"] == "yy"
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert all(r["lang_pred"] == ("xx", "yy")[r["doc_id"] % 2] for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in identify(rows, learn(rows)).collect()] == ["und"]
    assert identify(rows.limit(0), learn(rows.limit(0))).collect() == []


def test_words_of_any_length_are_scored_whole():
    pieces = [MARK, MARK + "th", "t", "h", "e", "he", "the", MARK + "the", "r"]
    p = np.random.default_rng(3).random((len(pieces) + 1, 2)) / 50
    scorer, table = Scorer(["a", "b"], pieces, p), Pieces(pieces)
    for size in (33, 60, 400):
        word = ("thether" * size)[:size]
        want = [_log_brute(word, table, p, k) for k in range(2)]
        assert scorer.whole(word) == pytest.approx(want)
        assert scorer.totals([word + " " + word])[0] == pytest.approx([2 * w for w in want])
    assert len(scorer.rows) == 0


def _log_brute(word, pieces, probabilities, k):
    """The forward sums by exact fractions."""
    from fractions import Fraction

    word, sums = MARK + word, [Fraction(1)]
    for end in range(1, len(word) + 1):
        parts = [(start, pieces.ids.get(word[start:end], 0)) for start in range(end)]
        sums.append(sum(sums[start] * Fraction(probabilities[piece, k]) for start, piece in parts if piece or start == end - 1))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_training_sums_of_long_words_are_those_of_short_ones():
    from millrace.llm import langid

    pieces = [MARK, MARK + "th", "t", "h", "e", "he", "the"]
    p = np.random.default_rng(5).random((len(pieces) + 1, 1))
    edges, out = Pieces(pieces).edges("thethehe"), np.zeros((len(pieces) + 1, 1))
    langid._expected_of_long(edges, [math.log(p[x, 0]) for _, _, x in edges], 9, 3, 0, out)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"lang": ["a"], "word": ["thethehe"], "n": [3]})
    assert out == pytest.approx(langid._expected(iter([batch]), Pieces(pieces), p, {"a": 0}))


def test_long_texts_go_by_slices():
    draw = random.Random(2)
    text = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(30_000))
    pieces = list("abcdefgh") + [MARK]
    p = np.random.default_rng(0).random((len(pieces) + 1, 3)) / 20
    whole = Scorer(["a", "b", "c"], pieces, p).totals([text])[0]
    few = Scorer(["a", "b", "c"], pieces, p)
    few.most = 500
    assert whole == pytest.approx(sum(few._sums([[w]])[0] for w in text.split()))


def test_blocks_of_languages_give_the_same(spark):
    rows = made(spark, extra=[(200, "zzz zut zig", "zz"), (203, "zzz zut zig zag", "zz")])
    one, many = learn(rows), learn(rows, block=1)
    assert [b[0] for b in one] == [["xx", "yy", "zz"]] and [b[0] for b in many] == [["xx"], ["yy"], ["zz"]]
    a, b = ({(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in identify(rows, model).collect()} for model in (one, many))
    assert a == b
