"""State files, manifests and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT, PROGRESS = "[RESULT_JSON]", "[PROGRESS]"


def media_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size and time of every file below root; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    return f.select(F.regexp_replace("path", f"^(file:/*)?/?{base.lstrip('/')}/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON state file by schema; missing or broken files give no row, missing fields null."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    broken = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("value", broken, {"columnNameOfCorruptRecord": "_broken"})
    return spark.read.text(path, wholetext=True).where(F.trim("value").startswith("{")).select(parsed.alias("r")).where("r._broken is null").select("r.*").drop("_broken")


def identity_records(raw: DataFrame, auto: float = 0.82, suggest: float = 0.74) -> DataFrame:
    """Identity rows with defaults: counts not negative, thresholds in [0, 1], labels trimmed; consistency, adaptive threshold and
    trend are worked out anew from the counts, whatever was stored."""
    from tessera.functions.scalar import clamp, label_key
    from tessera.operators.memory import learned

    count = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c)
    rows = raw.select(F.trim("label").alias("label"), label_key(F.col("label")).alias("label_key"), "prototype", count("sample_count"), F.coalesce(F.col("confidence_sum").cast("double"), F.lit(0.0)).alias("confidence_sum"), F.coalesce("locked", F.lit(False)).alias("locked"), count("pos_count"), count("neg_count"), clamp(F.col("same_threshold").cast("double")).alias("same_threshold"))
    return learned(rows.where("label_key <> ''"), auto, suggest)


def result_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Payloads of log lines that carry a JSON object after the result mark; other lines go."""
    line = F.trim(F.col(column))
    body = F.trim(F.expr(f"substring(trim({column}), {len(RESULT) + 1})"))
    return lines.where(line.startswith(RESULT) & body.startswith("{")).select(F.from_json(body, schema).alias("r")).where("r is not null").select("r.*")


def progress(line: Column) -> Column:
    """Map of whole numbers of a `k=v` progress line; others are left out."""
    pairs = F.str_to_map(F.trim(F.regexp_replace(line, r"^\s*\[PROGRESS\]", "")), F.lit(" "), F.lit("="))
    return F.map_filter(F.transform_values(pairs, lambda k, v: v.try_cast("int")), lambda k, v: v.isNotNull())


def payload(rows: DataFrame) -> DataFrame:
    """One JSON line for each result row, after the result mark."""
    return rows.select(F.concat(F.lit(RESULT + " "), F.to_json(F.struct("*"))).alias("value"))
