"""Merging and splitting identities: the change of files, decision log, vector cache and identities as one.

The tables (paths are relative to the root, `folder/name`; a folder bears its identity's label):
files(path, ...); log(event_id, ts, event_type, label, match_label, from_label, to_label, predicted_label, negative_label, confidence,
source_path, final_path); cache(path, embedding, confidence, updated_at and, where vectors come in pairs, aux_embedding);
identities as `memory.merged` has them, with pos_count, neg_count, locked, locked_at and last_corrected_at.
Labels are equal whatever their case. Both changes return new tables; `sources.versions` puts them in place together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.functions.scalar import base_name, folder_name, label_key, suffix
from tessera.operators import media, memory
from tessera.operators.ordered import numbered
from tessera.session import cut, small

Tables = dict[str, DataFrame]
LABELS = ["label", "match_label", "from_label", "to_label"]


def _inside(path: Column, folder: str) -> Column:
    """Whether a path is a media file that lies directly in the folder."""
    return path.startswith(folder + "/") & ~F.expr(f"substring(path, {len(folder) + 2})").contains("/") & F.lower(suffix(path)).isin(*media.EXTENSIONS)


def _moves(files: DataFrame, chosen: DataFrame, target: str) -> DataFrame:
    """(old, new, nth): chosen files under the first free names of the target's folder, numbered by name."""
    taken = files.where(F.col("path").startswith(target + "/")).select(F.lit(target).alias("folder"), F.expr(f"substring(path, {len(target) + 2})").alias("name"))
    wishes = chosen.select("path", F.lit(target).alias("folder"), base_name(F.col("path")).alias("name"))
    plan = media.move_plan(wishes, taken).select(F.col("path").alias("old"), F.concat("folder", F.lit("/"), "target").alias("new"))
    return cut(numbered(plan.withColumn("_g", F.lit(0)), ["_g"], [F.lower(base_name(F.col("old"))), "old"], "nth").drop("_g"))


def _moved(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """Adds _new: where the path of a column went, null if it stayed."""
    return rows.join(small(moves.select(F.col("old").alias("_old"), F.col("new").alias("_new"))), F.col(column) == F.col("_old"), "left").drop("_old")


def _cached(cache: DataFrame, moves: DataFrame, at: str) -> DataFrame:
    """The cache after the moves: a moved file's entry goes along and replaces what was at its new path; else that one stays, touched."""
    held = cache.columns
    went = _moved(cache, moves, "path")
    gone = went.where("_new IS NOT NULL").select("*", F.lit(at).cast("timestamp").alias("_at"))
    gone = gone.select(*(F.col("_new").alias(c) if c == "path" else F.col("_at").alias(c) if c == "updated_at" else F.col(c) for c in held))
    stay = went.where("_new IS NULL").drop("_new").join(gone.select("path"), "path", "left_anti")
    touched = stay.join(moves.select(F.col("new").alias("path"), F.lit(True).alias("_hit")), "path", "left")
    return gone.unionByName(touched.withColumn("updated_at", F.when(F.col("_hit"), F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))).select(*held))


def feedback(cache: DataFrame, moves: DataFrame, action: str, source: str, target: str, at: str) -> DataFrame:
    """The events of moved files that have a usable vector in the cache, at the old path or else the new: a positive one for the
    target, with the vectors, and a negative one for the source."""
    found = memory.cache_lookup(moves.select("nth", F.col("old").alias("source_path"), F.col("new").alias("final_path")), cache)
    pick = lambda c: vec.normalized(F.col(c)) if c in cache.columns else F.lit(None).cast("array<double>")
    usable = found.select("nth", "source_path", "final_path", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), pick("embedding").alias("embedding"), pick("aux_embedding").alias("aux_embedding")).where("embedding IS NOT NULL OR aux_embedding IS NOT NULL")
    both = usable.withColumn("event_type", F.explode(F.array(F.lit("positive"), F.lit("negative"))))
    first = F.col("event_type") == "positive"
    return both.select(
        F.concat_ws("-", F.lit(action), F.lit(at), F.format_string("%09d", "nth"), "event_type").alias("event_id"), F.lit(at).cast("timestamp").alias("ts"), "event_type", F.lit(action).alias("action"), F.lit(target).alias("label"), F.lit(source).alias("predicted_label"),
        F.lit(source).alias("from_label"), F.lit(target).alias("to_label"), F.when(~first, F.lit(source)).alias("negative_label"), "confidence", "source_path", "final_path", *(F.when(first, F.col(c)).alias(c) for c in ("embedding", "aux_embedding")),
    )


def learn(identities: DataFrame, events: DataFrame, source: str, target: str, at: str) -> DataFrame:
    """Identities after feedback(): vectors folded into the target's, counts of both labels, new identities for labels without one."""
    spark = identities.sparkSession
    some = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    wanted = some.select(F.when(F.col("event_type") == "positive", F.lit(target)).otherwise(F.lit(source)).alias("label"))
    out = cut(memory.with_labels(identities, wanted.unionByName(spark.createDataFrame([(target,)], "label string"))))
    own = label_key(F.col("label")) == target.strip().lower()
    for vector, proto, count, total in (("embedding", "prototype", "sample_count", "confidence_sum"), ("aux_embedding", "aux_prototype", "aux_sample_count", None)):
        if proto not in out.columns:
            continue
        start = out.where(own).select("label", F.col(proto).alias("prototype"), F.col(count).alias("sample_count"), (F.col(total) if total else F.lit(0.0)).alias("confidence_sum"))
        name = start.select(F.col("label").alias("_label"))
        log = events.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(name)).select(F.col("_label").alias("label"), "ts", "event_id", "confidence", vector)  # one row
        new = memory.prototypes(log, start, vector).select(F.col("label").alias("_l"), F.col("prototype").alias("_p"), F.col("sample_count").alias("_n"), F.col("confidence_sum").alias("_c"))
        out = out.join(F.broadcast(new), out["label"] == new["_l"], "left")  # the target alone
        out = out.withColumns({proto: F.coalesce("_p", proto), count: F.coalesce("_n", count).cast(dict(identities.dtypes)[count]), **({total: F.coalesce("_c", total)} if total else {})}).drop("_l", "_p", "_n", "_c")
    n = {r["event_type"]: r["n"] for r in some.collect()}  # two rows at most
    for kind, label, count in (("positive", target, "pos_count"), ("negative", source, "neg_count")):
        hit = (label_key(F.col("label")) == label.strip().lower()) & F.lit(n.get(kind, 0) > 0)
        out = out.withColumn(count, (F.coalesce(count, F.lit(0)) + F.when(hit, F.lit(n.get(kind, 0))).otherwise(0)).cast(dict(identities.dtypes)[count]))
        out = out.withColumn("last_corrected_at", F.when(hit, F.lit(at).cast(dict(identities.dtypes)["last_corrected_at"])).otherwise(F.col("last_corrected_at")))
    return out


def _logged(log: DataFrame, events: DataFrame, action: str, source: str, target: str, at: str, keep: int | None) -> DataFrame:
    """The log after a structural event and the feedback, cut to the newest."""
    one = log.sparkSession.createDataFrame([(f"{action}-{at}", "structural", action, target, source, target, source, target)], "event_id string, event_type string, action string, label string, from_label string, to_label string, source_path string, final_path string")
    new = one.withColumn("ts", F.lit(at).cast("timestamp")).unionByName(events.drop("embedding", "aux_embedding"), allowMissingColumns=True)
    return memory.appended(log.withColumn("event_id", F.col("event_id").cast("string")), new, keep)


def merge(tables: Tables, source: str, target: str, at: str, keep: int | None = 7000) -> tuple[Tables, DataFrame]:
    """The tables after all of the source's files and what is known of it go to the target, and (old, new, nth) of the files.

    Files get the first free names there; log rows under the source's label, in any of its columns, get the target's, their paths
    follow the files or else the folder; cache entries go along; prototypes unite by weight; then the moved files' vectors count as feedback.
    """
    source, target = source.strip(), target.strip()
    if not source or not target or source.lower() == target.lower():
        raise ValueError("a merge needs two different labels")
    files, log, cache, known = (tables[t] for t in ("files", "log", "cache", "identities"))
    moves = _moves(files, files.where(_inside(F.col("path"), source)), target)
    into = F.when(label_key(F.col("label")) == source.lower(), F.lit(target)).otherwise(F.when(label_key(F.col("label")) == target.lower(), F.lit(target)).otherwise(F.col("label")))
    events = cut(feedback(cache, moves, "identity_merge", source, target, at))
    united = memory.merged(known, into).select(*known.columns)
    united = united.withColumn("locked_at", F.when((F.col("label") == target) & F.col("locked") & (F.coalesce(F.trim(F.col("locked_at").cast("string")), F.lit("")) == ""), F.lit(at).cast(dict(known.dtypes)["locked_at"])).otherwise(F.col("locked_at")))
    rows = memory.moved_paths(memory.relabel(log, LABELS, source, target), moves, source, target, "final_path")
    return {
        "files": _moved(files, moves, "path").withColumn("path", F.coalesce("_new", "path")).drop("_new"),
        "log": _logged(rows, events, "identity_merge", source, target, at, keep),
        "cache": _cached(cache, moves, at),
        "identities": learn(united, events, source, target, at),
    }, moves


def split(tables: Tables, source: str, target: str, chosen: DataFrame, at: str, keep: int | None = 7000) -> tuple[Tables, DataFrame]:
    """The tables after chosen(path) files of the source go to a new or other target, and (old, new, nth) of the files.

    Log rows of moved files get the target's label and the new path; the others stay. Chosen paths that are no files, or no media, are
    passed over; one outside the source's folder is an error, and so is a choice of nothing.
    """
    source, target = source.strip(), (target.strip() and _clean(tables["files"].sparkSession, target))
    if not source or not target or source.lower() == target.lower():
        raise ValueError("a split needs two different labels")
    files, log, cache, known = (tables[t] for t in ("files", "log", "cache", "identities"))
    there = files.join(small(chosen.select("path").distinct()), "path", "left_semi")
    if not there.where(~F.col("path").startswith(source + "/")).isEmpty():
        raise ValueError("a chosen file is not inside the source's folder")
    picked = there.where(F.lower(suffix(F.col("path"))).isin(*media.EXTENSIONS))
    if picked.isEmpty():
        raise ValueError("no valid file was chosen")
    moves = _moves(files, picked, target)
    events = cut(feedback(cache, moves, "identity_split", source, target, at))
    rows = _moved(log, moves, "final_path")
    rows = rows.withColumns({c: F.when(F.col("_new").isNotNull(), F.lit(target)).otherwise(F.col(c)) for c in ("label", "to_label")}).withColumn("final_path", F.coalesce("_new", "final_path")).drop("_new")
    return {
        "files": _moved(files, moves, "path").withColumn("path", F.coalesce("_new", "path")).drop("_new"),
        "log": _logged(rows, events, "identity_split", source, target, at, keep),
        "cache": _cached(cache, moves, at),
        "identities": learn(known, events, source, target, at),
    }, moves


def _clean(spark, name: str) -> str:
    return spark.range(1).select(folder_name(F.lit(name)).alias("n")).first()["n"]
