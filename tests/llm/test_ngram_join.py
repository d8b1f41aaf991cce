import random
from math import comb

import numpy as np
import pytest

from millrace.llm import ngram_join as g


def brute(texts):
    """Sets, links and groups by comparing all pairs of texts."""
    hashes = g.WordHashes()
    sets = {k: set(g.shingles(t, hashes).tolist()) for k, t in texts.items()}
    up = {k: k for k in texts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links = dict.fromkeys(texts, 0)
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return links, {k: root(k) for k in texts}


def made(seed, families=12, most=30):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=4))
    texts, shared = {}, [word() for _ in range(60)]
    for _ in range(families):
        base = [word() for _ in range(draw.randint(30, 120))]
        for _ in range(draw.randint(1, most)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3, 6])):
                text[draw.randrange(len(text))] = word()
            if draw.random() < 0.2:
                text += shared
            texts[len(texts)] = " ".join(text)
    return texts


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 8), (3, 2)])
def test_links_and_groups_are_those_of_brute_force(spark, docs, seed, block):
    texts = made(seed)
    links, groups = brute(texts)
    got = {r["doc_id"]: r for r in g.link_groups(docs(*texts.items()), block=block).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == links
    assert {k: r["group_id"] for k, r in got.items()} == groups


def test_odd_rows(spark, docs):
    same = "One two three four five six seven"
    rows = docs((1, same), (2, same.upper() + "!"), (3, None), (4, ""), (5, "..."), (6, "two words"), (7, "Two, words"), (8, "two word"), (9, "long " * 30000), (1, same), (None, same), (None, "other text of six plain words"))
    got = g.link_groups(rows).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert {k: (r["class_id"], r["copies"], r["n_links"], r["group_id"]) for k, r in by.items()} == {
        1: (1, 4, 3, 1), 2: (1, 4, 3, 1), 3: (3, 1, 0, 3), 4: (4, 1, 0, 4), 5: (5, 1, 0, 5), 6: (6, 2, 1, 6), 7: (6, 2, 1, 6), 8: (8, 1, 0, 8), 9: (9, 1, 0, 9),
    }
    assert g.link_groups(rows.limit(0)).collect() == []


def test_pruning_table_is_the_posterior():
    for n, m in g.least_matches(0.8, 1e-6):
        tail = lambda m, n=n: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 2**63, 1000, np.uint64)
    b = np.concatenate([a[:800], draw.integers(0, 2**63, 200, np.uint64)])
    assert abs((g.signature(a) == g.signature(b)).mean() - 800 / 1200) < 0.17


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["id"]: r["group"] for r in g.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {101: 100, 103: 100}
    assert g.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_null_and_repeated_ids_meet_their_own_texts_alone(spark, docs, monkeypatch):
    texts = made(11, families=6, most=20)
    links, groups = brute(texts)
    seen, whole = [], g.cluster_texts

    def counted(rows, inside):
        out = whole(rows, inside)
        seen.append((inside.count(), out.count()))
        return out

    monkeypatch.setattr(g, "cluster_texts", counted)
    got = g.link_groups(docs(*((None, t) for t in texts.values()))).collect()
    assert sorted(r["n_links"] for r in got) == sorted(links.values()) and all(r["class_id"] is None for r in got)
    got = g.link_groups(docs(*((k // 3, t) for k, t in texts.items()))).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted((k // 3, links[k]) for k in texts)
    distinct = len({frozenset(g.shingles(t, g.WordHashes()).tolist()) for t in texts.values()})
    assert len(seen) == 2 and all(rows <= 2 * inside <= 2 * distinct * 2 for inside, rows in seen)


def test_a_text_that_repeats_under_no_id_is_read_once_a_task(spark, docs):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(None, base)] * 500 + [(None, base + " more")] * 500
    made_rows = []
    import pyarrow as pa

    run = g._with_grams(5)
    key = g.class_key(g.shingles(base, g.WordHashes()))
    batch = pa.RecordBatch.from_pydict({"text": [base] * 500, "cluster": [1] * 500, "low": [0] * 500, "high": [0] * 500, "side": [0] * 500, "v": [key] * 500, "copies": [500] * 500})
    for out in run(iter([batch])):
        made_rows += out.to_pylist()
    assert len(made_rows) == 1
    got = g.link_groups(docs(*rows)).collect()
    assert {r["n_links"] for r in got} == {999} and {r["copies"] for r in got} == {500}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_union_find(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(90)] + [(5, 5)] * 3
    up = {x: x for e in edges for x in e}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["id"]: r["group"] for r in g.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert g.components(spark.createDataFrame([], "a long, b long")).collect() == []
