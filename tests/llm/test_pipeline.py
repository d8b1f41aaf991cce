import json
import os
import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(9)
    path = str(tmp_path_factory.mktemp("tables"))
    english = ["the", "and", "thing", "other", "rather", "with", "where", "after", "again", "house"]
    french = ["les", "que", "dans", "nous", "maison", "encore", "toujours", "avec", "pour", "autre"]
    item = "an item of the benchmark that has more than eight words in it"
    rows = []
    for k in range(120):
        lang = ("en", "fr")[k % 3 == 0]
        words = [draw.choice(english if lang == "en" else french) + draw.choice(["", "s", "er", "ing", "ou"]) for _ in range(draw.randint(30, 90))]
        rows.append([k, " ".join(words) + ".", lang, f"s{k % 3}"])
    rows[10][1] = rows[4][1]
    near = rows[5][1].split()
    rows[20][1] = " ".join([*near[:-1], "changed."])
    rows[30][1] += " " + item + " tail"
    rows[31][1] = item
    rows[32][1] += " write to someone@example.com or 10.1.2.3"
    rows[33][1] = "12345 67890 !!!"
    rows[34][1] = None
    rows[35][2] = None
    rows.append(list(rows[50]))
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r for r in rows}


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixture":
            assert docs.columns == columns
    every = set(rows)
    assert set(kept["language"]) == every - {33, 34} and kept["language"][35]["lang"] == "en"
    assert set(kept["near_copies"]) == every - {33, 34, 10, 20}
    assert set(kept["decontaminate"]) == every - {33, 34, 10, 20, 31}
    assert kept["decontaminate"][30]["text"].endswith(" tail") and "benchmark" not in kept["decontaminate"][30]["text"]
    assert kept["personal_data"][32]["text"].endswith("write to <EMAIL> or <IP>") and all(kept["personal_data"][k]["text"] == rows[k][1] for k in kept["personal_data"] if k not in (30, 32))
    taken = docs.collect()
    size = lambda text: len(text.split())
    total = sum(size(r["text"]) for r in kept["personal_data"].values())
    assert abs(sum(r["size"] for r in taken) - total) < 3 * 90 and {r["copy"] for r in taken} <= {1, 2, 3}


def test_near_copies_without_a_usable_doc_id(spark, docs):
    draw = random.Random(4)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(7)]
    rows = docs(
        (None, texts[0]), (None, texts[0]), (None, texts[0] + " more"),  # copies under no id: one stays
        (5, texts[1]), (None, texts[1]),  # the row with an id stays
        (1, texts[2]), (2, texts[2]), (2, texts[3]),  # the copy under id 2 goes, the other text stays
        (3, texts[4]), (3, texts[5]), (3, texts[5]),  # two texts under one id stay
        (9, texts[6]), (-4, texts[6]), (7, "!!!"), (7, "!!!"), (8, "!!!"), (None, None), (None, None),
    )
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, rows, "").collect()), key=str)
    alone = [x for x in got if x[0] is None and x[1]]
    assert len(alone) == 1 and alone[0][1].startswith(texts[0])
    want = [(5, texts[1]), (1, texts[2]), (2, texts[3]), (3, texts[4]), (3, texts[5]), (-4, texts[6]), (7, "!!!"), (8, "!!!"), (None, None), (None, None)]
    assert sorted(got, key=str) == sorted([*want, *alone], key=str)


def test_run_applies_the_stages(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 50 and set(got.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "copy"}


def test_columns_and_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_contract():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    assert os.path.exists(corpus_pipeline.__file__) and json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_extra_columns_go_through(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "-7.0D as score", "'mine' as lang_pred", "doc_id as `a.b`", "1 as _row", "2 as copies")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "mixture":
            assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r["score"] == -7 and r["lang_pred"] == "mine" and r["a.b"] == r["doc_id"] and r["_row"] == 1 for r in got)
        if name != "mixture":
            docs = spark.createDataFrame(got, out.schema)
