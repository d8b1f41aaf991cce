"""Sources, storage, gates, upserts, pipeline, streaming, CLI."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.cli import main, parser
from millrace.config import LARGE, QUARANTINE, SMALL, VALIDATED, Settings
from millrace.operators.dedup import duplicate_groups, flag_duplicates
from millrace.operators.metrics import status_samples, top
from millrace.plans import pipeline
from millrace.schema import CORRUPT, ERROR_CODES, RAW_COLUMNS, RULE_CODES, csv_schema
from millrace.sources.csv import SchemaError, check_schema, count_rows, create_sample, numbered, read_large, read_small
from millrace.sources.ingest import GateError, check_run_id, load_csv, new_run_id
from millrace.sources.router import choose_engine, normalize_engine, resolve_route
from millrace.sources.storage import Storage
from test_classify import BASE, items


def csv_text(*changes, header=True):
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if header:
        writer.writerow(RAW_COLUMNS)
    for k, c in enumerate(changes):
        row = BASE | {"order_id": f"o-{k}", "items_json": items({})} | c
        writer.writerow([row[x] for x in RAW_COLUMNS])
    return out.getvalue()


@pytest.fixture
def orders(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(csv_text({}, {"total_amount": "9999"}, {"order_id": "same"}, {"order_id": " same "}, {"status": "x"}, {"order_id": ""}, {"order_id": ""}), encoding="utf-8")
    return str(path)


def test_vocabularies_and_schema():
    assert len(RAW_COLUMNS) == 17 and len(ERROR_CODES) == 16 and len(RULE_CODES) == 18
    assert [f.name for f in csv_schema().fields] == [*RAW_COLUMNS, CORRUPT] and all(f.dataType.typeName() == "string" and f.nullable for f in csv_schema().fields)


def test_router(tmp_path):
    small, large = tmp_path / "s.csv", tmp_path / "l.csv"
    small.write_bytes(b"x" * 2**20)
    large.write_bytes(b"x" * (2**20 + 1))
    settings = Settings(small_file_mb=1)
    assert choose_engine(small, settings)[0] == SMALL and choose_engine(large, settings)[0] == LARGE
    assert resolve_route(large, settings).engine == LARGE
    assert [normalize_engine(x) for x in (SMALL, {"engine": LARGE}, {"selected_engine": SMALL}, (LARGE, 3.0), [1, SMALL])] == [SMALL, LARGE, SMALL, LARGE, SMALL]
    for bad in (None, "spark", {}, (), 3):
        with pytest.raises(RuntimeError):
            normalize_engine(bad)
    with pytest.raises(RuntimeError):
        resolve_route(small, settings, decide=lambda *_: LARGE)
    with pytest.raises(FileNotFoundError):
        choose_engine(tmp_path / "none.csv")
    with pytest.raises(ValueError):
        choose_engine(tmp_path)


def test_run_ids():
    import re

    assert re.fullmatch(r"run-\d{8}T\d{6}Z-[0-9a-f]{8}", new_run_id("run"))
    assert check_run_id(" a-1 ") == "a-1"
    for bad in ("", " ", "a b", "x" * 129):
        with pytest.raises(ValueError):
            check_run_id(bad)


def test_csv_profiles(spark, tmp_path):
    path = tmp_path / "odd.csv"
    rows = csv_text({"city": "two\nlines"}, {"city": "", "district": 'a "quoted", comma'})
    short = "o-short,2025-01-01\n"
    wide = csv_text({"order_id": "o-long"}, header=False).strip("\r\n") + ",more,,last\n"
    path.write_bytes(b"\xef\xbb\xbf" + (rows + short + wide).encode())
    small = {r["order_id"]: r for r in read_small(spark, str(path)).collect()}
    assert set(small) == {"o-0", "o-1", "o-short", "o-long"} and small["o-0"]["city"] == "two\nlines" and small["o-1"]["district"] == 'a "quoted", comma' and small["o-1"]["city"] == ""
    assert small["o-short"]["status"] is None and small["o-long"]["extra_values"] == ["more", None, "last"] and small["o-long"]["items_json"] == items({})
    assert count_rows(read_large(spark, str(path)))[1] >= 2


def test_csv_surplus_of_any_length(spark, tmp_path):
    path = tmp_path / "wide.csv"
    record = lambda name: csv_text({"order_id": name}, header=False).strip("\r\n")
    extra = [f"x{k}" for k in range(199)]
    path.write_text(csv_text({}) + record("many") + "," + ",".join(extra) + ',"a ""b"",\nc"\n' + record("ends") + ",more,,\n")
    got = {r["order_id"]: r["extra_values"] for r in read_small(spark, str(path)).collect()}
    assert got == {"o-0": None, "many": [*extra, 'a "b",\nc'], "ends": ["more", None, None]}


def test_schema_gate(spark):
    with pytest.raises(SchemaError):
        check_schema(spark.createDataFrame([(1,)], "order_id int"))


def test_row_numbers_are_contiguous(spark):
    df = numbered(spark.range(0, 1000, 1, 7))
    assert [r["source_row_number"] for r in df.orderBy("id").collect()] == list(range(2, 1002))


def test_sample(spark, tmp_path, orders):
    assert create_sample(spark, orders, str(tmp_path / "sample"), 3) == 3
    assert sorted(r["order_id"] for r in read_large(spark, str(tmp_path / "sample")).collect()) == ["o-0", "o-1", "same"]
    with pytest.raises(ValueError):
        create_sample(spark, orders, str(tmp_path / "none"), 0)


def test_pipeline_is_idempotent_and_updates(spark, tmp_path, orders):
    settings = Settings(warehouse=str(tmp_path / "wh"), reports=str(tmp_path / "reports"))
    out = pipeline.run_pipeline(spark, orders, settings)
    storage, run = Storage(spark, settings.warehouse), out["raw"]["run_id"]
    quality = out["quality"]
    assert out["route"]["engine"] == SMALL and out["raw"]["rows_read"] == 7
    assert quality["classification"] == {"valid_count": 1, "corrected_count": 1, "quarantine_count": 5, "classified_total": 7}
    assert quality["validated_write"]["inserted_count"] == 2 and quality["quarantine_write"]["inserted_count"] == 5
    assert quality["duplicates"] == {"group_count": 1, "record_count": 2, "group_size_distribution": {"2": 1}}
    report = json.loads((tmp_path / "reports" / "elt_write_report.json").read_text())
    assert report["raw_run_id"] == run
    contract = tmp_path / "dry.json"
    dry = pipeline.dry_run(storage, run, contract)
    assert dry["error_code_counts"]["DUPLICATE_ORDER_ID"] == 2 and dry["raw_count"] == 7
    again = pipeline.run_quality(storage, run, contract, strict=True)
    assert again["validated_write"] == {"inserted_count": 0, "updated_count": 0, "unchanged_count": 2} and again["quarantine_write"]["unchanged_count"] == 5 and again["consistency"]["matches_dry_run"]
    before = {r["order_id"]: r for r in storage.snapshot(VALIDATED).collect()}
    other = tmp_path / "next.csv"
    other.write_text(csv_text({"city": "عدن"}, {"order_id": "o-9"}), encoding="utf-8")
    third = pipeline.run_pipeline(spark, str(other), settings)["quality"]
    assert third["validated_write"] == {"inserted_count": 1, "updated_count": 1, "unchanged_count": 0}
    after = {r["order_id"]: r for r in storage.snapshot(VALIDATED).collect()}
    assert after["o-0"]["city"] == "عدن" and after["o-0"]["first_processed_at"] == before["o-0"]["first_processed_at"] and after["o-1"] == before["o-1"] and len(after) == 3
    assert storage.latest_run() != run and storage.snapshot(QUARANTINE).count() == 5
    with pytest.raises(GateError):
        load_csv(spark, storage, orders, run_id=run)
    with pytest.raises(RuntimeError):
        pipeline.run_quality(storage, "no-such-run")
    contract.write_text(json.dumps(json.loads(contract.read_text()) | {"classification": {"valid_count": 0, "corrected_count": 0, "quarantine_count": 7}}))
    with pytest.raises(GateError):
        pipeline.run_quality(storage, run, contract)


def test_load_gates(spark, tmp_path, orders):
    storage = Storage(spark, str(tmp_path / "wh"))
    with pytest.raises(GateError):
        load_csv(spark, storage, orders, expected_rows=8)
    bad = tmp_path / "bad.csv"
    bad.write_text(csv_text({}) + "only,two\n", encoding="utf-8")
    with pytest.raises(GateError):
        load_csv(spark, storage, str(bad), LARGE)
    assert storage.raw().count() == 0
    assert load_csv(spark, storage, str(bad), LARGE, on_malformed="permissive")["corrupt_rows"] == 1
    with pytest.raises(RuntimeError):
        storage.drop_test_table("orders_raw")


def test_duplicates(spark):
    raw = spark.createDataFrame([(k,) for k in ("a", " a", "b", "", "", None, "c", "c", "c")], "order_id string").select(F.struct("order_id").alias("raw_record"))
    assert {r["order_id"]: r["record_count"] for r in duplicate_groups(raw).collect()} == {"a": 2, "c": 3}
    assert sorted((r["raw_record"]["order_id"] or "", r["is_duplicate"]) for r in flag_duplicates(raw).collect()) == sorted([("a", True), (" a", True), ("b", False), ("", False), ("", False), ("", False), ("c", True), ("c", True), ("c", True)])


def test_top_and_samples(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "code string, n long")
    assert [r["code"] for r in top(counts, 2).collect()] == ["c", "a"]
    rows = spark.createDataFrame([(k, "valid", ["x"] * 9, ["y"]) for k in range(20)], "k int, quality_status string, corrections array<string>, details_error array<string>")
    got = status_samples(rows, "k").collect()
    assert [r["k"] for r in got] == [0, 1, 2, 3, 4] and len(got[0]["corrections"]) == 8


def test_upsert_proof(spark, tmp_path):
    assert pipeline.upsert_proof(spark, str(tmp_path))["actions"] == ["inserted", "updated", "unchanged"]


def test_streaming_is_idempotent(spark, tmp_path):
    from millrace.streaming.ingest import start

    inbox, storage = tmp_path / "in", Storage(spark, str(tmp_path / "wh"))
    inbox.mkdir()
    (inbox / "a.csv").write_text(csv_text({}, {}), encoding="utf-8")
    start(spark, str(inbox), storage, str(tmp_path / "cp")).awaitTermination(300)
    assert storage.snapshot(VALIDATED).count() == 2
    (inbox / "b.csv").write_text(csv_text({"city": "عدن"}), encoding="utf-8")
    start(spark, str(inbox), storage, str(tmp_path / "cp")).awaitTermination(300)
    assert storage.raw().count() == 3 and storage.snapshot(VALIDATED).where("city = 'عدن'").count() == 1


def test_cli(tmp_path, orders, capsys):
    assert main(["route", "--input", orders]) == 0 and json.loads(capsys.readouterr().out)["engine"] == SMALL
    assert main(["run", "--input", orders, "--dry-route"]) == 0
    with pytest.raises(SystemExit):
        main(["quality", "--skip-dry-run-contract"])
    with pytest.raises(SystemExit):
        main(["load", "--input", orders, "--drop-target"])
    assert parser().parse_args(["sample", "--input", "a", "--output", "b"]).rows == 100_000


def test_a_replacement_that_stops_leaves_one_table_or_the_other(spark, tmp_path, monkeypatch):
    from pyspark.sql import types as T

    from millrace.sources import storage as module

    monkeypatch.setitem(module.SCHEMAS, "t", "k int")
    store = Storage(spark, str(tmp_path))
    rows = lambda k: spark.createDataFrame([(k,)], T.StructType([T.StructField("k", T.IntegerType())]))
    read = lambda: [r["k"] for r in Storage(spark, str(tmp_path)).snapshot("t").collect()]
    store.replace("t", rows(1))

    def stop(*_):
        raise KeyboardInterrupt

    for step, after in (("_point", 1), ("_clean", 3)):
        with monkeypatch.context() as broken:
            broken.setattr(Storage, step, stop)
            with pytest.raises(KeyboardInterrupt):
                store.replace("t", rows(after if step == "_clean" else 2))
        assert read() == [after]
    (tmp_path / "t" / "_CURRENT.00000009").write_text("")  # cut off while it was written
    assert read() == [3]
    store.replace("t", rows(4))
    store.replace("t", rows(5))
    names = sorted(x.name for x in (tmp_path / "t").iterdir() if not x.name.startswith("."))
    assert read() == [5] and sum(n.startswith("snapshot-") for n in names) == 2


def test_pointers_of_the_older_layout_are_read(spark, tmp_path, monkeypatch):
    from millrace.sources import storage as module

    monkeypatch.setitem(module.SCHEMAS, "t", "k int")
    spark.range(1).selectExpr("cast(id as int) k").write.parquet(str(tmp_path / "t" / "snapshot-a"))
    (tmp_path / "t" / "_CURRENT").write_text("snapshot-a")
    store = Storage(spark, str(tmp_path))
    assert store.snapshot("t").count() == 1
    store.replace("t", spark.range(2).selectExpr("cast(id as int) k"))
    assert store.snapshot("t").count() == 2


def test_two_writers_of_a_table(spark, tmp_path, monkeypatch):
    store = Storage(spark, str(tmp_path))
    (tmp_path / "t").mkdir()
    store._point("t", 1, "snapshot-a")
    with pytest.raises(RuntimeError):
        store._point("t", 1, "snapshot-b")


def test_loads_of_a_test_go_to_an_empty_test_table(spark, tmp_path, orders):
    storage = Storage(spark, str(tmp_path / "wh"))
    with pytest.raises(GateError):
        load_csv(spark, storage, orders, table="orders_elsewhere")
    assert load_csv(spark, storage, orders, table="_spark_try")["inserted"] == 7
    with pytest.raises(GateError):
        load_csv(spark, storage, orders, table="_spark_try")
    storage.drop_test_table("_spark_try")
    assert load_csv(spark, storage, orders, table="_spark_try")["inserted"] == 7


def test_stored_rows_are_looked_at():
    from pyspark.sql import Row

    from millrace.sources.ingest import _check_stored

    good = dict(run_id="r", source_file="f", source_path="p", source_row_number=2, ingested_at=1, spark_partition_id=0, engine_used=LARGE, raw_record=Row(**dict.fromkeys(RAW_COLUMNS, "x")))
    _check_stored(Row(**good), LARGE, 1)
    _check_stored(None, LARGE, 0)
    for bad in (good | {"source_file": None}, good | {"raw_record": Row(order_id="x")}, good | {"engine_used": SMALL}):
        with pytest.raises(GateError):
            _check_stored(Row(**bad), LARGE, 1)
    with pytest.raises(GateError):
        _check_stored(None, LARGE, 1)


def test_duplicates_beyond_a_broadcast(spark):
    ids = ["hot"] * 50 + ["two", " two", "one", "", None, "  "]
    rows = spark.createDataFrame([(k, (x,)) for k, x in enumerate(ids)], "k int, raw_record struct<order_id: string>")
    wide = flag_duplicates(rows, most_broadcast=0, hot_rows=50)
    few = {r["k"]: r["is_duplicate"] for r in flag_duplicates(rows).collect()}
    assert {r["k"]: r["is_duplicate"] for r in wide.collect()} == few == {k: k < 52 for k in range(len(ids))}
    assert wide.columns == ["k", "raw_record", "is_duplicate"]


def test_row_numbers_follow_the_files(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for name, low, high in (("a", 0, 3), ("b", 3, 400), ("c", 400, 405)):  # Spark reads the largest file first
        (folder / f"{name}.csv").write_text(csv_text(*({"order_id": str(k)} for k in range(low, high))), encoding="utf-8")
    for read in (read_large, read_small):
        found = numbered(read(spark, str(folder), places=True))
        assert not {"_file", "_block"} & set(found.columns)
        assert sorted((r["source_row_number"], int(r["order_id"])) for r in found.collect()) == [(k + 2, k) for k in range(405)]


def test_row_numbers_follow_the_parts_of_a_file(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text(csv_text(*({"order_id": str(k)} for k in range(3000))), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = numbered(read_large(spark, str(path), places=True))
        assert found.rdd.getNumPartitions() > 4
        assert sorted((r["source_row_number"], int(r["order_id"])) for r in found.collect()) == [(k + 2, k) for k in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sample_is_one_file(spark, tmp_path):
    source, target = tmp_path / "in.csv", tmp_path / "out" / "sample.csv"
    source.write_text('a,b\n1,"two\nlines"\n3\n4,5,6\n', encoding="utf-8-sig")
    assert create_sample(spark, str(source), target, 2) == 2
    assert target.read_bytes() == b'\xef\xbb\xbfa,b\r\n1,"two\nlines"\r\n3\r\n'
    with pytest.warns(UserWarning, match="3 records"):
        assert create_sample(spark, source.as_uri(), target, 9) == 3
    with pytest.raises(FileNotFoundError):
        create_sample(spark, str(tmp_path / "absent.csv"), target)
    source.write_text("")
    with pytest.raises(ValueError):
        create_sample(spark, str(source), target)


def test_connector_jars(tmp_path, monkeypatch):
    from millrace.sources.documents import REQUIRED_JARS, connector_jars, insert_options

    monkeypatch.delenv("MONGO_SPARK_JARS", raising=False)
    cache = tmp_path / "cache"
    cache.mkdir()
    names = ["org.mongodb.spark_mongo-spark-connector_2.13-11.1.0.jar", "mongodb-driver-sync-5.1.4.jar", "mongodb-driver-core-5.1.4.jar", "bson-record-codec-5.1.4.jar"]
    for name in names:
        (cache / name).touch()
    with pytest.raises(RuntimeError, match="bson-"):
        connector_jars([cache, tmp_path / "absent"])
    (cache / "bson-5.1.4.jar").touch()
    assert [x.rsplit("/", 1)[1] for x in connector_jars([cache])] == [*names[:3], "bson-5.1.4.jar", names[3]] and len(REQUIRED_JARS) == 4
    monkeypatch.setenv("MONGO_SPARK_JARS", f"{cache / names[0]}; {cache / names[1]},")
    assert connector_jars([]) == [str(cache / names[0]), str(cache / names[1])]
    monkeypatch.setenv("MONGO_SPARK_JARS", str(tmp_path / "no.jar"))
    with pytest.raises(RuntimeError, match="no.jar"):
        connector_jars()
    got = insert_options("orders", Settings(batch_size=7))
    assert got["maxBatchSize"] == "7" and got["operationType"] == "insert" and got["ordered"] == "false" and got["collection"] == "orders"


def test_store_client_answers():
    from millrace.sources.documents import store_client

    asked = []

    class Client:
        def __init__(self, uri, serverSelectionTimeoutMS):
            self.admin = self
            asked.append((uri, serverSelectionTimeoutMS))

        def command(self, name):
            asked.append(name)

    assert isinstance(store_client(Settings(mongo_uri="mongodb://h"), 9, Client), Client) and asked == [("mongodb://h", 9), "ping"]

    class Silent(Client):
        def command(self, name):
            raise TimeoutError

    with pytest.raises(TimeoutError):
        store_client(connect=Silent)


def test_loads_leave_other_tables(spark, tmp_path, orders, monkeypatch):
    from millrace.sources import ingest

    storage = Storage(spark, str(tmp_path / "tables"))
    append = storage.append_raw

    def meddling(rows, table):
        append(rows, table)
        storage.replace(VALIDATED, storage.snapshot(VALIDATED))

    monkeypatch.setattr(storage, "append_raw", meddling)
    with pytest.raises(GateError, match="other tables"):
        load_csv(spark, storage, orders)
    monkeypatch.setattr(storage, "append_raw", append)
    assert load_csv(spark, storage, orders, run_id="again")["inserted"] == 7
    monkeypatch.chdir(tmp_path)
    made = ingest.raw_rows(read_large(spark, orders, places=True), "orders.csv", "r", LARGE)
    assert made.first()["source_path"] == str(tmp_path / "orders.csv")


def test_cli_batch_size_and_targets():
    assert parser().parse_args(["run", "--input", "a", "--batch-size", "9"]).batch_size == 9
    with pytest.raises(SystemExit):
        main(["run", "--input", "a", "--batch-size", "0"])
    with pytest.raises(SystemExit):
        parser().parse_args(["load", "--input", "a", "--production-raw", "--table", "_spark_x"])
