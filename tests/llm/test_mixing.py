import random

import pytest

from millrace.llm.mixing import mix, source_targets


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by handing the excess of capped sources on until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: cap * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets_follow_the_rule(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, None: 40, "é": 7}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_mix_keeps_words_near_targets_and_every_row(spark, docs):
    draw = random.Random(2)
    rows = [(k, "w " * draw.randint(1, 40), None, draw.choice(["a", "b", "c", "c", "c", None])) for k in range(1500)] + [(2000, None, None, "a"), (2001, "", None, "b"), (7, "same words here", None, "c"), (7, "same words here", None, "c"), (None, "no id", None, "a")]
    got = mix(docs(*rows), fan=16).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target = water_fill(sizes)
    for source in sizes:
        mine = [r for r in got if r["source"] == source]
        assert mine[0]["source_size"] == sizes[source] and mine[0]["target"] == pytest.approx(target[source])
        assert abs(sum(r["taken"] for r in mine) - target[source]) <= 40
    assert all(r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] for r in got)
    again = mix(docs(*reversed(rows)), fan=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_each_document_keeps_its_expectation(spark, docs):
    rows = docs(*[(k, "w " * (1 + k % 3), None, "ab"[k % 2]) for k in range(64)])
    counts = [0] * 64
    for seed in range(12):
        for r in mix(rows, fan=8, seed=1000 * seed).collect():
            counts[r["doc_id"]] += r["copies"]
    a, b = sum(counts[0::2]) / 32 / 12, sum(counts[1::2]) / 32 / 12
    sizes = {"a": sum(1 + k % 3 for k in range(0, 64, 2)), "b": sum(1 + k % 3 for k in range(1, 64, 2))}
    target = water_fill(sizes)
    assert a == pytest.approx(target["a"] / sizes["a"], abs=0.1) and b == pytest.approx(target["b"] / sizes["b"], abs=0.1)


def test_empty_table(spark, docs):
    assert mix(spark.createDataFrame([], docs((1, "a")).schema)).collect() == []


def test_carried_columns(spark, docs):
    got = mix(docs(*[(k, f"text {k}", "en", "ab"[k % 2]) for k in range(50)]), carry=("text", "lang")).collect()
    assert len(got) == 50 and all(r["text"] == f"text {r['doc_id']}" and r["lang"] == "en" for r in got)


def test_null_ids_and_equal_rows_fill_no_leaf(spark, docs, monkeypatch):
    from millrace.llm import mixing

    largest, folded = [], mixing._folded

    def watched(units, *rest):
        out = folded(units, *rest)
        largest.append(out.selectExpr("max(size(items))").first()[0] or 0)
        return out

    monkeypatch.setattr(mixing, "_folded", watched)
    rows = [(None, "one two three", None, "a")] * 3000 + [(k, "w " * (k % 7), None, "b") for k in range(1500)] + [(9, "same", None, "c")] * 500
    got = mix(docs(*rows), fan=64).collect()
    assert len(got) == 5000 and max(largest) <= 2 * 64
    words = sum(len(r[1].split()) for r in rows)
    assert abs(sum(r["taken"] for r in got) - words) <= 9 * 3


def test_large_counts_are_dealt_in_chunks(spark):
    from millrace.llm.mixing import _spread

    rows = _spread(spark.createDataFrame([(1, 5, 3), (2, 5, 95), (None, 5, 20)], "doc_id long, size long, n long"), chunk=10).collect()
    assert sorted((r["doc_id"] or 0, r["ordinal"]) for r in rows) == sorted([(1, k) for k in range(3)] + [(2, k) for k in range(95)] + [(0, k) for k in range(20)])


def test_carried_columns_of_rows_with_one_id(spark, docs):
    rows = [(k // 4 if k % 2 else None, f"text {k % 30} " * (1 + k % 3), None, "ab"[k % 2]) for k in range(200)]
    table = docs(*rows).selectExpr("*", "n_chars as `a.b`", "'mine' as target")
    plain, got = mix(table).collect(), mix(table, carry=("text", "lang", "a.b", "target")).collect()
    assert sorted(r["text"] for r in got) == sorted(r[1] for r in rows) and all(r["a.b"] == len(r["text"]) and isinstance(r["target"], float) for r in got)
    assert [sum(r["taken"] for r in x if r["source"] == "a") for x in (plain, got)] == pytest.approx([sum(r["taken"] for r in plain if r["source"] == "a")] * 2, abs=8)
    again = mix(table.orderBy("n_chars"), carry=("text", "lang", "a.b")).collect()
    assert sorted(str(r.asDict() | {"target": 0}) for r in again) == sorted(str(r.asDict() | {"target": 0}) for r in got)
