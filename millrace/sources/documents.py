"""The document store: its connector's jars, a check that it answers, and collections as sources and sinks."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.config import Settings

#: How the names of the connector's jar and of those it needs begin, in the order they are given to Spark.
REQUIRED_JARS = ("mongo-spark-connector_2.13", "mongodb-driver-sync", "mongodb-driver-core", "bson-")
OPTIONAL_JARS = ("bson-record-codec",)
#: Folders below the home directory where build tools keep jars.
JAR_CACHES = (".ivy2/jars", ".ivy2/cache", ".m2/repository", ".cache/coursier")
JARS_VARIABLE = "MONGO_SPARK_JARS"


def connector_jars(caches: Iterable[str | Path] | None = None) -> list[str]:
    """The absolute paths of the connector's jars.

    The variable MONGO_SPARK_JARS names them, separated by commas or semicolons, all of which must exist; where it is unset
    they are looked for in `caches`, the build tools' own by default. RuntimeError names what is missing.
    """
    named = [Path(x.strip()) for x in os.environ.get(JARS_VARIABLE, "").replace(";", ",").split(",") if x.strip()]
    if named:
        if absent := [str(p) for p in named if not p.is_file()]:
            raise RuntimeError(f"{JARS_VARIABLE} names files that do not exist: {', '.join(absent)}")
        return [str(p.resolve()) for p in named]
    folders = [Path(c) for c in (caches if caches is not None else (Path.home() / c for c in JAR_CACHES))]
    jars = sorted(p for folder in folders if folder.is_dir() for p in folder.rglob("*.jar"))
    found = {}
    for start in REQUIRED_JARS + OPTIONAL_JARS:
        fits = [p for p in jars if _is_jar(p.name.lower(), start)]
        if fits:
            found[start] = str(fits[0].resolve())
    if absent := [start for start in REQUIRED_JARS if start not in found]:
        raise RuntimeError(f"no jars of {', '.join(absent)} in {', '.join(map(str, folders)) or 'any folder'}")
    return list(found.values())


def _is_jar(name: str, start: str) -> bool:
    """Whether a jar, which a cache may name with its group in front, is the one that `start` begins."""
    at = name.find(start)
    return at >= 0 and (at == 0 or name[at - 1] in "._") and (start != "bson-" or name[at + 5 : at + 6].isdigit())


def store_client(settings: Settings | None = None, timeout_ms: int = 5000, connect: Any = None) -> Any:
    """A client of the document store that has answered a ping; what the driver raises if it does not answer in time.

    `connect` makes a client; by default the store's Python driver does, which must be installed.
    """
    settings = settings or Settings()
    if connect is None:
        try:
            from pymongo import MongoClient as connect
        except ImportError as e:
            raise RuntimeError("the document store's Python driver is not installed") from e
    client = connect(settings.mongo_uri, serverSelectionTimeoutMS=timeout_ms)
    client.admin.command("ping")
    return client


def connection(collection: str, settings: Settings) -> dict[str, str]:
    return {"connection.uri": settings.mongo_uri, "database": settings.mongo_database, "collection": collection}


def insert_options(collection: str, settings: Settings) -> dict[str, str]:
    """Unordered inserts, in batches of the size that is set."""
    return connection(collection, settings) | {"operationType": "insert", "ordered": "false", "maxBatchSize": str(settings.batch_size)}


def write_documents(rows: DataFrame, collection: str, settings: Settings | None = None) -> None:
    """Appends rows to a collection through the Spark connector, whose jars the session must have."""
    rows.write.format("mongodb").mode("append").options(**insert_options(collection, settings or Settings())).save()


def read_documents(spark: SparkSession, collection: str, settings: Settings | None = None) -> DataFrame:
    return spark.read.format("mongodb").options(**connection(collection, settings or Settings())).load()
