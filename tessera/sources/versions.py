"""Several tables that change together: versions in folders of their own, and one manifest that names the current one.

A change writes all tables to a new folder and renames a manifest onto the old one last. Readers go by the manifest, so they see all
tables before the change or all after it; what a lost run has written is named by no manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _context(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(conf)


def manifest(spark: SparkSession, root: str) -> dict:
    """The current manifest; version 0 without tables where there is none."""
    _, at, fs = _context(spark, f"{root}/{MANIFEST}")
    if not fs.exists(at):
        return {"version": 0, "folder": None, "tables": []}
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/{MANIFEST}").collect()))


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    m = manifest(spark, root)
    return {t: spark.read.parquet(f"{root}/{m['folder']}/{t}") for t in m["tables"]}


def commit(spark: SparkSession, tables: dict[str, DataFrame], root: str, after: int) -> int:
    """Writes the next version of all tables; `after` is the version that they were made from, and must still be the current one."""
    folder, draft = f"v{after + 1:06d}-{uuid.uuid4().hex}", f"{root}/.{uuid.uuid4().hex}.json"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    jvm, at, fs = _context(spark, draft)
    out = fs.create(at)
    out.write(bytearray(json.dumps({"version": after + 1, "folder": folder, "tables": sorted(tables)}).encode()))
    out.close()
    if manifest(spark, root)["version"] != after:
        fs.delete(at, False)
        raise RuntimeError("the tables changed meanwhile; nothing was put in place")
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), fs.getConf()).rename(at, final, kinds)
    return after + 1
