import random

import duckdb
from pyspark.sql import functions as F

from millrace.llm.quality_rules import SQL, measured, rule_verdicts

PROSE = "This is a plain sentence of some length, and it ends here. Another one follows it at once."
MORE = "Quite different words make up the second paragraph of it. They are as plain as those before them, though."
TEXTS = [
    None, "", " \n\t", PROSE, PROSE + "\n" + PROSE, "a b c d e f g h " * 10, "x " * 19, PROSE + "\nHome | News | About | Contact | Help\n" + MORE,
    "### $$$ %%% words&&& between*** them### and$$$ more%%% of&&& these*** here### there$$$ some%%% other&&& ones*** too###", "one word\n" * 40, PROSE + "\nAll rights reserved.\nRead more.",
    "no sentence ends anywhere in this text of more than twenty words so the line is removed and the document goes with it all", "\x0b\x0c" + PROSE + "\r\n" + PROSE, "é" * 3000 + " " + PROSE, (PROSE + "\n") * 300, "word " * 20000,
]


def rows_of(texts):
    return [(k, t) for k, t in enumerate(texts)]


def test_spark_and_sql_agree(spark):
    draw = random.Random(5)
    bits = ["a", "the", "|", "#", "end.", "end!", "\n", "\n", ",", "cookie", "$%", " ", "x…", "»", "yes.)", "\t"]
    texts = TEXTS + [" ".join(draw.choices(bits, k=draw.randint(0, 80))) for _ in range(300)]
    rows = rows_of(texts) + [(3, PROSE), (None, PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(SQL)
    names = [c[0] for c in found.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in rule_verdicts(docs).collect()))) == sorted(map(str, found.fetchall()))


def repeated_words(words, n=8):
    windows = {}
    for k in range(len(words) - n + 1):
        windows.setdefault(tuple(words[k : k + n]), []).append(k)
    return len({p for places in windows.values() if len(places) > 1 for k in places for p in range(k, k + n)})


def test_verdicts(spark):
    got = {r["doc_id"]: r for r in rule_verdicts(spark.createDataFrame(rows_of(TEXTS), "doc_id long, text string")).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k]["n_repeat_words"] == repeated_words((text or "").split()), k
        assert got[k]["n_words"] == len((text or "").split())
    assert got[7]["kept"] and got[10]["kept"] and not got[0]["kept"] and not got[4]["kept"] and not got[5]["kept"] and not got[8]["kept"] and not got[11]["kept"]


def test_cleaned_text_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, TEXTS[7], "old", 9)], "doc_id long, text string, kept string, n_words int").withColumn("a.b", F.lit(1))
    got = measured(rows).collect()[0]
    assert got["cleaned"] == PROSE + "\n" + MORE and got["kept"] is True and got["a.b"] == 1 and got["text"] == TEXTS[7]


def test_empty_table(spark):
    assert rule_verdicts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
