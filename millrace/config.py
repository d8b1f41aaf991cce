"""Settings, each of which an environment variable may override."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default: str) -> str:
    return os.environ.get(name, default)


@dataclass(frozen=True)
class Settings:
    #: Folder or URI of the storage tables (Parquet), or of reports.
    warehouse: str = field(default_factory=lambda: _env("MILLRACE_WAREHOUSE", "warehouse"))
    reports: str = field(default_factory=lambda: _env("MILLRACE_REPORTS", "reports"))
    small_file_mb: int = field(default_factory=lambda: int(_env("SMALL_FILE_THRESHOLD_MB", "200")))
    batch_size: int = field(default_factory=lambda: int(_env("BATCH_SIZE", "5000")))
    spark_master: str = field(default_factory=lambda: _env("SPARK_MASTER", "local[*]"))
    app_name: str = "millrace"
    mongo_uri: str = field(default_factory=lambda: _env("MONGO_URI", "mongodb://127.0.0.1:27017"))
    mongo_database: str = field(default_factory=lambda: _env("MONGO_DATABASE", "millrace"))


RAW, VALIDATED, QUARANTINE = "orders_raw", "orders_validated", "orders_quarantine"
SMALL, LARGE = "python_batch", "pyspark"
