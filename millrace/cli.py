"""Command line: run, load, quality, dry-run, route, sample, upsert-proof."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from millrace.config import LARGE, SMALL, Settings
from millrace.sources.router import resolve_route


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="load a CSV and bring its records into the tables")
    run.add_argument("--input", required=True)
    run.add_argument("--batch-size", type=int, help="documents that one insert sends to the document store")
    run.add_argument("--dry-route", action="store_true", help="only say which profile would read it")
    run.add_argument("--raw-only", action="store_true", help="stop after loading")
    load = sub.add_parser("load", help="load a CSV into the raw table")
    load.add_argument("--input", required=True)
    load.add_argument("--profile", choices=(SMALL, LARGE), default=LARGE)
    load.add_argument("--run-id")
    load.add_argument("--expected-rows", type=int)
    load.add_argument("--on-malformed", choices=("fail", "permissive"), default="fail")
    target = load.add_mutually_exclusive_group()
    target.add_argument("--production-raw", action="store_true", help="into the raw table, as without --table")
    target.add_argument("--table", help="a test table (_spark_*) instead of the raw table")
    load.add_argument("--drop-target", action="store_true")
    load.add_argument("--cleanup-after", action="store_true")
    quality = sub.add_parser("quality", help="classify a raw run and upsert its documents")
    quality.add_argument("--raw-run-id")
    quality.add_argument("--skip-dry-run-contract", action="store_true", help="needs --raw-run-id")
    quality.add_argument("--strict", action="store_true")
    sub.add_parser("dry-run", help="classify without writing").add_argument("--raw-run-id")
    sub.add_parser("route", help="which profile reads a file").add_argument("--input", required=True)
    sample = sub.add_parser("sample", help="the first records of a CSV")
    sample.add_argument("--input", required=True)
    sample.add_argument("--output", required=True)
    sample.add_argument("--rows", type=int, default=100_000)
    sub.add_parser("upsert-proof", help="insert, update, leave unchanged")
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    size = getattr(args, "batch_size", None)
    if size is not None and size <= 0:
        raise SystemExit("--batch-size must be positive")
    settings = Settings() if size is None else Settings(batch_size=size)
    if args.command == "route" or args.command == "run" and args.dry_route:
        route = resolve_route(args.input, settings)
        print(json.dumps({"path": str(route.path), "file_size_mb": round(route.file_size_mb, 2), "engine": route.engine, "reason": route.reason}, ensure_ascii=False))
        return 0
    if args.command == "quality" and args.skip_dry_run_contract and not args.raw_run_id:
        raise SystemExit("--skip-dry-run-contract needs --raw-run-id")
    if args.command == "load" and (args.drop_target or args.cleanup_after) and not args.table:
        raise SystemExit("the raw table is neither dropped nor cleaned up")
    from millrace.plans import pipeline
    from millrace.session import create_session
    from millrace.sources.csv import create_sample
    from millrace.sources.ingest import load_csv
    from millrace.sources.storage import Storage

    spark = create_session(settings)
    storage, contract = Storage(spark, settings.warehouse), Path(settings.reports) / "classification_dry_run.json"
    if args.command == "run":
        out = pipeline.run_pipeline(spark, args.input, settings, raw_only=args.raw_only)
    elif args.command == "load":
        if args.drop_target:
            storage.drop_test_table(args.table)
        out = load_csv(spark, storage, args.input, args.profile, args.run_id, args.expected_rows, args.on_malformed, args.table or "orders_raw")
        if args.cleanup_after:
            storage.drop_test_table(args.table)
    elif args.command == "quality":
        out = pipeline.run_quality(storage, args.raw_run_id, None if args.skip_dry_run_contract else contract, args.strict, Path(settings.reports) / "elt_write_report.json")
    elif args.command == "dry-run":
        out = pipeline.dry_run(storage, args.raw_run_id, contract)
    elif args.command == "sample":
        out = {"rows": create_sample(spark, args.input, args.output, args.rows)}
    else:
        out = pipeline.upsert_proof(spark, f"{settings.warehouse}/_spark_upsert_proof")
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
