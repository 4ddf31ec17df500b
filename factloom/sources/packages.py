"""Packages of several tables that appear as a whole: parts first, then one manifest that names them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """Whole manifests, the newest first; one that was cut off while it was written is passed over."""
    out = []
    for name in reversed(_names(spark, f"{path}/manifests")):
        text = "".join(r.value for r in spark.read.text(f"{path}/manifests/{name}", wholetext=True).collect())
        try:
            out.append(json.loads(text))
        except ValueError:
            continue
    return out


def commit_package(parts: dict[str, DataFrame], path: str, about: dict | None = None) -> int:
    """Write the parts into a folder of their own, then a manifest with the next free number that names them; the number.

    Readers take only what a whole manifest names, so a run that stops before leaves the last package as it is.  A
    manifest is created, never overwritten: of two runs that end at once the second takes the next number."""
    spark, path, run = next(iter(parts.values())).sparkSession, path.rstrip("/"), uuid.uuid4().hex
    for name, df in parts.items():
        df.write.parquet(f"{path}/parts/{run}/{name}")
    version = max([int(n.split(".")[0]) for n in _names(spark, f"{path}/manifests")], default=0)
    while True:
        version += 1
        fs, at = _fs(spark, f"{path}/manifests/{version:08d}.json")
        if fs.exists(at):
            continue
        try:
            out = fs.create(at, False)
        except Exception:
            if fs.exists(at):  # another run was first
                continue
            raise
        out.write(bytearray(json.dumps({"version": version, "run": run, "parts": sorted(parts), "about": about or {}}, sort_keys=True).encode()))
        out.close()
        return version


def read_package(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The parts of the newest whole package, or of one version; none where there is no such package."""
    path = path.rstrip("/")
    found = next((m for m in _manifests(spark, path) if version in (None, m["version"])), None)
    return {name: spark.read.parquet(f"{path}/parts/{found['run']}/{name}") for name in found["parts"]} if found else {}


def purge_packages(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete parts that none of the newest `keep` packages names; their folders.  No run may be writing meanwhile."""
    path = path.rstrip("/")
    kept = {m["run"] for m in _manifests(spark, path)[:keep]}
    gone = [n for n in _names(spark, f"{path}/parts") if n not in kept]
    for name in gone:
        fs, at = _fs(spark, f"{path}/parts/{name}")
        fs.delete(at, True)
    return gone
