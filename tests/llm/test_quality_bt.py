import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.quality_bt import FEATURES, THRESHOLD, Ranker, features, held_out_quality


def test_features_of_odd_texts():
    for text in (None, "", " \n", "|", "a", "é" * 50000, "a b\n" * 20000):
        assert len(features(text)) == len(FEATURES) and np.isfinite(features(text)).all()


def test_ranker_orders_pairs_and_places_the_threshold():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(1, 1, (300, 3)), draw.normal(-1, 1, (100, 3))
    ranker = Ranker(np.vstack([good, bad]), np.array([1] * 300 + [0] * 100), 0.25)
    scores = ranker(np.vstack([good, bad]))
    assert (scores[:300] >= THRESHOLD).mean() > 0.9 and (scores[300:] < THRESHOLD).mean() > 0.85
    assert abs((scores < THRESHOLD).mean() - 0.25) < 0.02


def test_without_both_labels():
    ranker = Ranker(np.ones((3, 2)), np.array([1, 1, 1]), 0.0)
    assert (ranker(np.ones((2, 2))) == THRESHOLD).all()


def test_held_out(spark):
    draw = random.Random(0)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 8)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(draw.randint(30, 80))]
        good = k % 4 != 0
        rows.append((k, " ".join(words[:20]).capitalize() + ". " + " ".join(words[20:]) + "." if good else " | ".join(words[:9]) + "### " + "$$$ ".join(words)))
        labels.append((k, int(good)))
    rows += [(1000, None), (1001, ""), (1, rows[1][1]), (None, "a b c")]
    labels += [(1000, None), (5000, 1), (None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = held_out_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= THRESHOLD) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 400]
    assert len(held) > 60 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert held_out_quality(docs.limit(0), spark.createDataFrame(labels[:0], "doc_id long, quality int")).collect() == []


def test_weights_are_where_the_loss_has_no_slope():
    """Brute force: every pair's loss, one by one, on small moves of each weight."""
    draw = np.random.default_rng(4)
    rows, labels = np.vstack([draw.normal(0.5, 1, (12, 2)), draw.normal(-0.5, 1, (9, 2))]), np.array([1] * 12 + [0] * 9)
    ranker = Ranker(rows, labels, 0.4, partners=3, penalty=0.01)
    x = ranker._inputs(rows)
    good, bad = x[labels == 1], x[labels == 0]
    order = np.random.default_rng(0)
    n = 12 * 3
    pairs = list(zip((order.permutation(n) % 12).tolist(), (order.permutation(n) % 9).tolist(), strict=True))

    def loss(weights):
        total = 0.0
        for a, b in pairs:
            total += np.log(1 + np.exp(-float((good[a] - bad[b]) @ weights)))
        return total / len(pairs) + 0.01 / 2 * float(weights @ weights)

    for k in range(x.shape[1]):
        step = np.zeros(x.shape[1])
        step[k] = 1e-3
        assert abs(loss(ranker.weights + step) - loss(ranker.weights - step)) / 2e-3 < 1e-4
        assert loss(ranker.weights + step) > loss(ranker.weights) < loss(ranker.weights - step)


def test_threshold_is_the_quantile_of_labelled_scores():
    draw = np.random.default_rng(6)
    rows, labels = draw.normal(0, 1, (200, 3)), np.array([1] * 150 + [0] * 50)
    rows[:150] += 1
    ranker = Ranker(rows, labels, 0.25)
    scores = sorted(float(s) for s in ranker._inputs(rows) @ ranker.weights)
    assert scores[49] < ranker.threshold < scores[50]


def test_a_doc_id_that_repeats_is_learned_from_once(spark):
    from millrace.llm import quality_bt

    held, seen = quality_bt._map_features, []

    def counted(docs, *rest):
        seen.append(docs.count())
        return held(docs, *rest)

    texts = [(k, f"some words of text {k}, and more.") for k in range(20)]
    docs = spark.createDataFrame([*texts, *[(3, f"text number {k}") for k in range(3000)]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    quality_bt._map_features = counted
    try:
        a, b = (quality_bt.learn(d, labels) for d in (docs, docs.orderBy(F.desc("text"))))
    finally:
        quality_bt._map_features = held
    assert seen == [20, 20] and np.allclose(a.weights, b.weights)


def _labelled(n, bad, seed=5):
    """Texts of which those of label 0 have more symbols, most times; `bad` tells who has label 0."""
    draw = random.Random(seed)
    texts, marks = [], []
    for k in range(n):
        odd = draw.gauss(0.25 if bad(k) else 0.1, 0.08)
        texts.append((k, " ".join("".join(draw.choices("abcdef", k=draw.randint(2, 9))) + ("#" if draw.random() < odd else "") for _ in range(draw.randint(20, 40))) + "."))
        marks.append((k, int(not bad(k))))
    return texts, marks


def test_every_labelled_row_is_learned_from(spark):
    from millrace.llm import quality_bt

    texts, marks = _labelled(5000, lambda k: k % 10 == 0)
    ranker = quality_bt.learn(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    x = np.array([features(t) for _, t in texts])
    assert np.allclose(ranker.mean, x.mean(axis=0)) and np.allclose(ranker.scale, x.std(axis=0))
    scores = np.sort(ranker._inputs(x) @ ranker.weights)
    assert scores[499] < ranker.threshold < scores[500]


def test_blocks_hold_every_example_once_and_pair_it(spark):
    """A rare label, whose rows come to several blocks, and documents of many equal labels."""
    from millrace.llm import quality_bt

    texts, marks = _labelled(2600, lambda k: k % 500 == 0)
    marks += [(7, 1)] * 1000 + [(500, 0)] * 19 + [(8, 0), (9999, 1)]
    x = {k: [float(v) for v in features(t)] for k, t in texts}
    rows = spark.createDataFrame(list(x.items()), "doc_id long, x array<double>")
    marked = spark.createDataFrame(marks, "doc_id long, y int")
    table, sizes = quality_bt._dealt(rows, marked)
    found = [[np.frombuffer(r[c]).reshape(-1, len(FEATURES)) for c in ("good", "bad")] + [(r["own_good"], r["own_bad"]), r["block"]] for r in table.collect()]
    blocks = [quality_bt.Block(*f) for f in found]
    assert len(blocks) > 4 and sorted(b.number for b in blocks) == list(range(len(blocks)))
    for label in (0, 1):
        own = sorted(r for b in blocks for r in b.owned()[1 - label].tolist())
        assert own == sorted(x[k] for k, y in marks if y == label and k in x) and len(own) == sizes[label]
    for b in blocks:
        for places, side in zip(b.pairs(quality_bt.PARTNERS), (b.good, b.bad), strict=True):
            assert np.bincount(places, minlength=len(side)).min() >= quality_bt.PARTNERS

    total = quality_bt._total(table)
    share = (len(marks) - sum(y for _, y in marks)) / len(marks)
    ranker = Ranker.over(total, sizes[1], sizes[0], share)
    n, *sums = sum(ranker._pair_sums(b, quality_bt.PARTNERS) for b in blocks)
    slope = np.array(sums[: len(ranker.weights)]) / n + quality_bt.PENALTY * ranker.weights
    assert np.abs(slope).max() < 1e-6
    again = quality_bt._learned(rows.orderBy(F.desc("doc_id")), marked.orderBy("y", F.desc("doc_id")))
    assert np.allclose(again.weights, ranker.weights) and np.isclose(again.threshold, ranker.threshold)


def test_threshold_with_equal_scores_and_another_share():
    """Brute force: the rows one by one in the order of their scores, label 0 first among equal ones."""
    draw = np.random.default_rng(8)
    for _ in range(40):
        y = draw.integers(0, 2, draw.integers(4, 60))
        y[:2] = 0, 1
        rows = draw.integers(0, 4, (len(y), 1)) + 0.0 + y[:, None]
        share = float(draw.choice([0.01, 0.1, 0.25, 0.5, 0.9, (y == 0).mean()]))
        ranker = Ranker(rows, y, share)
        ranked = sorted((float(s), int(k)) for s, k in zip(ranker._raw(rows), y, strict=True))
        reached, place = 0.0, -1
        while reached < share - 1e-12:
            place += 1
            reached += (1 - share) / (y == 1).sum() if ranked[place][1] else share / (y == 0).sum()
        over = ranked[min(place + 1, len(ranked) - 1)][0]
        assert np.isclose(ranker.threshold, (ranked[place][0] + over) / 2)
