"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, arrow_tokens, chat, decontam, hilbert, lines, media, packing, quality, repeats, runs, simhash, toxicity
from tessera.llm.common import saved, table
from tessera.session import Shelf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def remainder(by: int):
    """crc32 of doc_id as text, modulo `by`."""
    return F.crc32(F.col("doc_id").cast("string")) % by


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality.score(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


ORACLES["op1_packing"] = packing.oracle()


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.placed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op5_decontamination"] = decontam.ORACLE


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_ld_lines").cast("long").alias("n_lines"), F.col("_ld_removed").cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLES["op10_line_dedup"] = lines.ORACLE


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.read(media.store(table(spark, sf_dir, "documents")))
    return out.withColumn("clips", F.to_json("clips")).drop("error")


@query
def op9_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return arrow_tokens.read(spark, *arrow_tokens.write(docs, arrow_tokens.default_tokenizer()), kind=dict(docs.dtypes)["doc_id"])


@query
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(*chat.exchanges(table(spark, sf_dir, "conversations")), chat.REPLY)


ORACLES["op7_tool_calls"] = chat.ORACLE


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Shelf(spark, "op12") as shelf:
        out = repeats.cleaned(table(spark, sf_dir, "documents"), shelf)
        return saved(out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")), "op12-result")


def with_runs(docs: DataFrame) -> DataFrame:
    """The documents that op11 looks at: by its contract every tenth repeats a stretch of its own words up to its end; those without
    a word stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    d = docs.select("doc_id", "text", words.alias("_w"), F.floor(h / 10).alias("_g")).withColumn("_n", F.size("_w")).withColumn("_a", F.try_mod(F.col("_g"), F.col("_n").cast("bigint")).cast("int"))
    d = d.withColumn("_p", (F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1).cast("int"))
    rest = F.col("_n") - F.col("_a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    return d.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.detected(with_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines_ = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.array_join(lines_, "\n").alias("_lines"), "text")
    b = lambda c: F.col(f"_b.{c}")
    return out.select(
        "doc_id", "n_runs", (-b("start")).alias("start"), b("length").alias("length"), (-b("period")).alias("period"), F.floor(b("length") * 1000 / -b("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("_lines", F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = align.tokenizers()
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = align.aligned(table(spark, sf_dir, "documents"), a, b).withColumn("groups_sha256", digest).drop("groups")
    with Shelf(spark, "op13") as shelf:
        out = align.scored(rows, align.vocabulary(b), shelf)
        return saved(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "op13-result")
