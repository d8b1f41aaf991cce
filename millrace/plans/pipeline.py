"""The quality run: raw rows of a run -> classified -> validated and quarantine tables, gates, report; and the dry run."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import QUARANTINE, VALIDATED, Settings
from millrace.operators import metrics
from millrace.operators.classify import classify
from millrace.operators.dedup import duplicate_groups, flag_duplicates, group_sizes
from millrace.operators.upsert import ACTIONS, KEYS, actions, merged, quarantine_documents, validated_documents
from millrace.schema import CORRECTED, QUARANTINED, VALID
from millrace.sources.ingest import GateError, load_csv, new_run_id
from millrace.sources.router import resolve_route
from millrace.sources.storage import Storage


def classified_run(raw: DataFrame) -> DataFrame:
    """Raw rows with the duplicate flag applied and every record classified."""
    return classify(flag_duplicates(raw), "is_duplicate")


def write_report(report: dict, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def _counts(classified: DataFrame) -> dict[str, int]:
    found = metrics.as_dict(metrics.status_counts(classified))
    return {"valid_count": found.get(VALID, 0), "corrected_count": found.get(CORRECTED, 0), "quarantine_count": found.get(QUARANTINED, 0), "classified_total": sum(found.values())}


def _duplicates(raw: DataFrame) -> dict:
    sizes = {r["record_count"]: r["groups"] for r in group_sizes(duplicate_groups(raw)).collect()}
    return {"group_count": sum(sizes.values()), "record_count": sum(k * n for k, n in sizes.items()), "group_size_distribution": {str(k): sizes[k] for k in sorted(sizes)}}


def load_contract(path: str | Path, run_id: str) -> dict:
    """The approved dry run's classification of the same run."""
    path = Path(path)
    if not path.exists():
        raise RuntimeError(f"no dry run report at {path}")
    report = json.loads(path.read_text(encoding="utf-8"))
    if report.get("run_id") != run_id:
        raise RuntimeError(f"the dry run is of run {report.get('run_id')}, not {run_id}")
    if not report.get("consistency", {}).get("raw_equals_classified"):
        raise RuntimeError("the dry run's counts do not add up")
    return report["classification"]


def dry_run(storage: Storage, run_id: str | None = None, report_path: str | Path | None = None) -> dict:
    """Classifies a run without writing to any table, and reports its counts, histograms and samples."""
    run_id = storage.require_run(run_id) if run_id else storage.latest_run()
    before = {t: storage.snapshot(t).count() for t in (VALIDATED, QUARANTINE)}
    began = time.perf_counter()
    raw = storage.raw(run_id)
    classified = classified_run(raw).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, counts, duplicates = raw.count(), _counts(classified), _duplicates(raw)
        if n != counts["classified_total"]:
            raise GateError(f"{n} raw rows, {counts['classified_total']} classified")
        seen = classified.where(F.array_contains("codes_error", "DUPLICATE_ORDER_ID")).count()
        if seen != duplicates["record_count"]:
            raise GateError(f"{seen} duplicates classified, {duplicates['record_count']} counted")
        samples = {s: [r.asDict(recursive=True) for r in rows] for s, rows in _samples(classified).items()}
        report = {
            "phase": "classification_dry_run", "mode": "read_only", "run_id": run_id, "raw_count": n, "classification": counts, "duplicates": duplicates,
            "error_code_counts": metrics.as_dict(metrics.error_code_counts(classified)), "correction_rule_counts": metrics.as_dict(metrics.rule_counts(classified)),
            "error_combination_counts": metrics.as_dict(metrics.error_combinations(classified)), "corrections_per_record": _histogram(metrics.corrections_histogram(classified)),
            "errors_per_record": _histogram(metrics.errors_histogram(classified)), "samples": samples,
        }
    finally:
        classified.unpersist()
    after = {t: storage.snapshot(t).count() for t in (VALIDATED, QUARANTINE)}
    if before != after:
        raise GateError("a dry run changed the tables")
    elapsed = time.perf_counter() - began
    report |= {"consistency": {"raw_equals_classified": True, "duplicate_records_expected": duplicates["record_count"], "duplicate_records_seen": seen, "validated_unchanged": True, "quarantine_unchanged": True}, "performance": _speed(n, elapsed)}
    if report_path:
        write_report(report, report_path)
    return report


def _samples(classified: DataFrame) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in metrics.status_samples(classified, "source_row_number").orderBy("quality_status", "rank").collect():
        out.setdefault(r["quality_status"], []).append(r)
    return out


def _histogram(counts: DataFrame) -> dict[str, int]:
    return {str(r[0]): r["n"] for r in sorted(counts.collect())}


def _speed(n: int, elapsed: float) -> dict:
    return {"elapsed_seconds": round(elapsed, 4), "throughput_records_per_second": round(n / elapsed, 2) if elapsed > 0 else 0}


def run_quality(storage: Storage, run_id: str | None = None, contract: str | Path | None = None, strict: bool = False, report_path: str | Path | None = None) -> dict:
    """Classifies a run and upserts its documents.

    Gates: raw = valid + corrected + quarantined; the approved dry run's counts, where a contract is given; no validated
    document without an order id or twice; documents in the tables of this run as many as classified (with `strict`, the
    validated table holds this run's documents and no others); as many documents inserted as there are new keys.
    """
    selection = "explicit" if run_id else "latest"
    run_id = storage.require_run(run_id) if run_id else storage.latest_run()
    expected = load_contract(contract, run_id) if contract else None
    processing = new_run_id("quality")
    began = time.perf_counter()
    raw = storage.raw(run_id)
    classified = classified_run(raw).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, counts, duplicates = raw.count(), _counts(classified), _duplicates(raw)
        if n != counts["classified_total"]:
            raise GateError(f"{n} raw rows, {counts['classified_total']} classified")
        if expected is not None and any(counts[k] != int(expected[k]) for k in ("valid_count", "corrected_count", "quarantine_count")):
            raise GateError("the classification is not that of the approved dry run")
        made = {VALIDATED: validated_documents(classified, processing), QUARANTINE: quarantine_documents(classified, processing)}
        writes, totals = {}, {}
        for name, documents in made.items():
            key, existing = KEYS[name], storage.snapshot(name)
            ruled = actions(documents, existing, key).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                found = ruled.groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(key), F.lit("")) == "").alias("blank")).collect()
                if any(r["blank"] for r in found):
                    raise GateError(f"{name}: documents without {key}")
                writes[name] = {f"{a}_count": 0 for a in ACTIONS} | {f"{r['action']}_count": r["n"] for r in found}
                before = existing.count()
                if writes[name]["inserted_count"] + writes[name]["updated_count"]:
                    storage.replace(name, merged(ruled, existing, key))
            finally:
                ruled.unpersist()
            after = storage.snapshot(name)
            totals[name], distinct = after.agg(F.count("*"), F.count_distinct(key)).first()
            if totals[name] != before + writes[name]["inserted_count"] or distinct != totals[name]:
                raise GateError(f"{name}: {before} documents and {writes[name]['inserted_count']} inserted make {totals[name]}, {distinct} distinct")
        ours = storage.snapshot(VALIDATED)
        ours = ours.count() if strict else ours.where(F.col("lineage.raw_run_id") == run_id).count()
        held = storage.snapshot(QUARANTINE).where(F.col("source_run_id") == run_id).count()
        unchanged_elsewhere = writes[VALIDATED]["unchanged_count"]
        if strict and ours != counts["valid_count"] + counts["corrected_count"] or not strict and not counts["valid_count"] + counts["corrected_count"] - unchanged_elsewhere <= ours:
            raise GateError(f"{ours} validated documents, {counts['valid_count'] + counts['corrected_count']} expected")
        if held != counts["quarantine_count"]:
            raise GateError(f"{held} quarantined documents, {counts['quarantine_count']} expected")
        codes, rules = metrics.as_dict(metrics.error_code_counts(classified)), metrics.as_dict(metrics.rule_counts(classified))
    finally:
        classified.unpersist()
    report = {
        "phase": "elt_final_write", "raw_run_id": run_id, "processing_run_id": processing, "raw_count": n, "classification": counts, "validated_write": writes[VALIDATED], "quarantine_write": writes[QUARANTINE],
        "collection_counts": {VALIDATED: totals[VALIDATED], "orders_quarantine_current_run": held}, "duplicates": duplicates, "error_code_counts": codes, "correction_rule_counts": rules,
        "consistency": {"raw_equals_classified": True, "matches_dry_run": True if expected is not None else None, "dry_run_contract_used": expected is not None, "raw_run_selection": selection, "validated_count_correct": True, "quarantine_count_correct": True},
        "performance": _speed(n, time.perf_counter() - began),
    }
    if report_path:
        write_report(report, report_path)
    return report


def run_pipeline(spark: SparkSession, path: str, settings: Settings | None = None, raw_only: bool = False, dry_route: bool = False) -> dict:
    """Route, load, classify, upsert: one CSV from end to end."""
    settings = settings or Settings()
    route = resolve_route(path, settings)
    out: dict = {"route": {"path": str(route.path), "file_size_mb": route.file_size_mb, "engine": route.engine, "reason": route.reason}}
    if dry_route:
        return out
    storage = Storage(spark, settings.warehouse)
    out["raw"] = load_csv(spark, storage, str(route.path), route.engine, new_run_id("pipeline"), on_malformed="permissive" if route.engine != "pyspark" else "fail")
    if not raw_only:
        out["quality"] = run_quality(storage, out["raw"]["run_id"], report_path=Path(settings.reports) / "elt_write_report.json")
    return out


def upsert_proof(spark: SparkSession, folder: str) -> dict:
    """Shows in a table of its own that a document is inserted once, then updated in place, then left unchanged."""
    storage = Storage(spark, folder)
    schema = storage.snapshot(VALIDATED).schema
    empty = {f.name: None for f in schema.fields}
    steps = []
    for status, print_ in (("valid", "a"), ("corrected", "b"), ("corrected", "b")):
        new = spark.createDataFrame([tuple((empty | {"order_id": "proof-1", "quality_status": status, "record_fingerprint": print_}).values())], schema)
        existing = storage.snapshot(VALIDATED)
        ruled = actions(new, existing, "order_id")
        steps.append(ruled.first()["action"])
        if steps[-1] != "unchanged":
            storage.replace(VALIDATED, merged(ruled, existing, "order_id"))
        found = storage.snapshot(VALIDATED).collect()
        if len(found) != 1 or found[0]["quality_status"] != status:
            raise GateError(f"the table holds {found}")
    if steps != ["inserted", "updated", "unchanged"]:
        raise GateError(f"the actions were {steps}")
    return {"actions": steps, "documents": 1}
