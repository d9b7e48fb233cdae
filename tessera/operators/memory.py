"""Learned identities: assisted decisions, the feedback log and what folds from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec
from tessera.functions.scalar import adaptive_threshold, clamp, consistency, half_up, label_key, trend
from tessera.operators.moments import vector_sums
from tessera.session import carried, dealt_by

carried(__name__)

FOUND, ABSENT, UNCERTAIN = "target_found", "target_absent", "uncertain"


@dataclass(frozen=True)
class Assist:
    auto: float = 0.82
    suggest: float = 0.74
    gap: float = 0.18
    weak: float = 0.65


def assist(matched: DataFrame, rule: Assist = Assist()) -> DataFrame:
    """Adds applied, final_label, final_confidence and folder to rows with decision_label, confidence, match,
    locked and match_threshold (of the matched identity).

    A locked identity at its threshold applies; so does any at its threshold if the row was found already,
    scores `gap` below the match, or is weak; a score at `suggest` makes the row uncertain and names the
    folder; anything else stays as it was.
    """
    score = F.col("match.score")
    auto = F.greatest(F.lit(rule.suggest), F.least(F.lit(rule.auto), F.coalesce("match_threshold", F.lit(rule.auto))))
    base = F.coalesce("confidence", F.lit(0.0))
    clear = (score - base >= rule.gap) | (base < rule.weak) | (label_key(F.col("decision_label")) == FOUND)
    applies = F.coalesce((score >= auto) & (F.coalesce("locked", F.lit(False)) | clear), F.lit(False))
    suggests = F.coalesce(score >= rule.suggest, F.lit(False))
    return (
        matched.withColumn("applied", applies)
        .withColumn("threshold_used", half_up(auto, 4))
        .withColumn("final_label", F.when(applies, FOUND).when(suggests, UNCERTAIN).otherwise(F.col("decision_label")))
        .withColumn("final_confidence", half_up(clamp(F.when(applies, F.greatest(base, score)).when(suggests, F.greatest(F.lit(rule.suggest), F.least(score, auto))).otherwise(F.col("confidence"))), 3))
        .withColumn("folder", F.when(applies | suggests, F.col("match.label")))
    )


def feedback_counts(log: DataFrame) -> DataFrame:
    """label_key, pos_count, neg_count, identity updates and last time of a feedback log
    (ts, event_type in positive|repair|negative|structural, label, negative_label, embedding present)."""
    pos = log.where("event_type in ('positive', 'repair')").select(label_key(F.col("label")).alias("label_key"), F.lit(1).alias("p"), F.lit(0).alias("n"), "ts")
    neg = log.where("negative_label is not null").select(label_key(F.col("negative_label")).alias("label_key"), F.lit(0).alias("p"), F.lit(1).alias("n"), "ts")
    both = pos.unionByName(neg).where("label_key <> ''")
    return both.groupBy("label_key").agg(F.sum("p").alias("pos_count"), F.sum("n").alias("neg_count"), F.max("ts").alias("last_corrected_at"))


def learned(counts: DataFrame, auto: float = 0.82, suggest: float = 0.74) -> DataFrame:
    """Adds consistency, adaptive_threshold and trend to pos_count and neg_count."""
    p, n = F.col("pos_count"), F.col("neg_count")
    return counts.withColumn("consistency", half_up(consistency(p, n), 4)).withColumn("adaptive_threshold", adaptive_threshold(p, n, auto, suggest)).withColumn("trend", trend(p, n))


def summary(identities: DataFrame, limit: int = 200) -> DataFrame:
    """Newest corrections first, then newest use, then label, all descending; `limit` rows."""
    return identities.orderBy(F.desc("last_corrected_at"), F.desc("last_used"), F.desc("label_key")).limit(limit)


def log_totals(log: DataFrame, absent: str = ABSENT) -> DataFrame:
    """One row of event counters."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kind, label = F.col("event_type"), label_key(F.col("label"))
    return log.agg(
        count(kind != "structural").alias("feedback_events"),
        count(kind.isin("positive", "repair")).alias("positive_events"),
        count(F.col("negative_label").isNotNull()).alias("negative_events"),
        count(kind == "structural").alias("structural_events"),
        count(kind.isin("positive", "repair") & (label != absent)).alias("identity_updates"),
        count(label == absent).alias("absent_events"),
    )


def prototypes(log: DataFrame, start: DataFrame | None = None, vector: str = "embedding") -> DataFrame:
    """(label, prototype, sample_count, confidence_sum): events folded in order of (ts, event_id) into what `start` has.

    start: label, prototype, sample_count, confidence_sum; a stored prototype that is degenerate or counts nothing is
    started anew by the first event. Each step is ((prototype * n) + e) / (n + 1), normalised again, so order matters.
    One label's events meet in one task, in order, a batch at a time: only the running prototype is held. Labels of
    `start` without an event stay as they are. A second vector of the log is folded by another call that names it.
    """
    kinds = dict(log.dtypes)
    order = log.select("label", "ts", "event_id", F.col("confidence").cast("double").alias("confidence"), vec.doubles(F.col(vector)).alias("e"), F.lit(None).cast("bigint").alias("n")).where("e is not null")
    if start is not None:  # comes before a label's events
        order = order.unionByName(start.select("label", F.lit(None).cast(kinds["ts"]).alias("ts"), F.lit(None).cast(kinds["event_id"]).alias("event_id"), F.col("confidence_sum").cast("double").alias("confidence"), vec.doubles(F.col("prototype")).alias("e"), F.coalesce("sample_count", F.lit(0)).cast("bigint").alias("n")))
    laid = dealt_by(order, "label").sortWithinPartitions("label", F.col("n").isNull(), "ts", "event_id").select("label", "e", "confidence", "n")
    return laid.mapInPandas(_fold, "label string, prototype array<double>, sample_count bigint, confidence_sum double")


def folded(proto, n: int, e):
    """The prototype after one more vector, and whether it went on from what was there."""
    import numpy as np

    size = 0.0 if proto is None or not n else np.linalg.norm(proto)
    if size <= 1e-8:
        return e, False
    merged = (proto / size * n + e) / (n + 1)
    size = np.linalg.norm(merged)
    return (merged / size if size > 1e-8 else e), True


def _fold(batches):
    import numpy as np
    import pandas as pd

    label, proto, n, conf = None, None, 0, 0.0
    row = lambda: (label, None if proto is None else proto.tolist(), n, conf)
    fresh, columns = True, ["label", "prototype", "sample_count", "confidence_sum"]
    for b in batches:
        rows = []
        for name, e, c, stored in zip(b["label"], b["e"], b["confidence"], b["n"]):
            if fresh or name != label:
                if not fresh:
                    rows.append(row())
                label, proto, n, conf, fresh = name, None, 0, 0.0, False
            e, c = None if e is None else np.asarray(e, float), 0.0 if pd.isna(c) else float(c)
            if not pd.isna(stored):
                proto, n, conf = e, int(stored), c
                continue
            proto, on = folded(proto, n, e)
            n, conf = (n + 1, conf + c) if on else (1, c)
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    if not fresh:
        yield pd.DataFrame([row()], columns=columns)


def review_feedback(items: DataFrame, absent: str = ABSENT) -> DataFrame:
    """A positive event for the final label, and the label a reviewer turned down, of reviewed items
    (id, ts, final_label, match_label, suggested_folder)."""
    candidate = F.coalesce(F.nullif(F.trim("match_label"), F.lit("")), F.nullif(F.trim("suggested_folder"), F.lit("")))
    turned = F.when((label_key(candidate) != label_key(F.col("final_label"))) & (label_key(candidate) != absent), candidate)
    return items.select(F.col("id").alias("event_id"), "ts", F.lit("positive").alias("event_type"), F.col("final_label").alias("label"), turned.alias("negative_label"))


def cache_lookup(moves: DataFrame, cache: DataFrame) -> DataFrame:
    """moves(source_path, final_path) with the columns of cache(path, ...): the entry of the source path, else of the
    final path, whatever the case; found_by says which (source, final, none). Paths of the cache are unique."""
    facts = [c for c in cache.columns if c != "path"]
    entry = cache.select(label_key(F.col("path")).alias("_key"), F.struct(F.lit(True).alias("there"), *facts).alias("_entry"))
    out = moves
    for side, path in (("_s", "source_path"), ("_f", "final_path")):
        out = out.join(entry.withColumnsRenamed({"_key": f"{side}key", "_entry": side}), label_key(F.col(path)) == F.col(f"{side}key"), "left").drop(f"{side}key")
    by = F.when(F.col("_s").isNotNull(), "source").when(F.col("_f").isNotNull(), "final").otherwise("none")
    return out.withColumn("_e", F.coalesce("_s", "_f")).select(*moves.columns, *(F.col(f"_e.{c}").alias(c) for c in facts), by.alias("found_by"))


def with_labels(identities: DataFrame, labels: DataFrame) -> DataFrame:
    """identities, and a new row (counts 0, unlocked, the rest null) for each label of labels(label) that none has, whatever
    the case; of spellings that differ in case the least is taken, blank ones are not."""
    fresh = labels.select(F.trim("label").alias("label")).where("label <> ''").groupBy(label_key(F.col("label")).alias("_key")).agg(F.min("label").alias("label"))
    fresh = fresh.join(identities.select(label_key(F.col("label")).alias("_key")), "_key", "left_anti")
    start = {"sample_count": 0, "confidence_sum": 0.0, "pos_count": 0, "neg_count": 0, "aux_sample_count": 0, "locked": False}
    value = lambda c, t: F.col("label") if c == "label" else F.lit(start.get(c)).cast(t).alias(c)
    return identities.unionByName(fresh.select(*(value(c, t) for c, t in identities.dtypes)))


def set_thresholds(identities: DataFrame, stats: DataFrame) -> DataFrame:
    """Identities after stats(label, same_threshold, mean_distance, sd_distance, pairs): thresholds held to [0, 1], pairs not
    below 0; labels that no identity has are added. Identities without a row in stats keep what they had."""
    news = ("same_threshold", "mean_distance", "sd_distance", "pairs")
    kinds = dict(zip(news, ("double", "double", "double", "bigint")))
    had = identities.select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in news if c not in identities.columns))
    fit = stats.where(F.trim("label") != "").select(label_key(F.col("label")).alias("_key"), clamp(F.col("same_threshold")).alias("same_threshold"), "mean_distance", "sd_distance", F.greatest(F.lit(0), F.col("pairs")).alias("pairs"))
    fit = fit.withColumnsRenamed({c: f"_{c}" for c in news})
    out = with_labels(had, stats).withColumn("_key", label_key(F.col("label"))).join(fit, "_key", "left")
    return out.select(*(F.coalesce(f"_{c}", c).cast(kinds[c]).alias(c) if c in news else F.col(c) for c in had.columns))


def event_kind(event: Column, negative: Column) -> Column:
    """positive, negative or structural: unnamed events by `negative`, unknown names count as positive."""
    k = F.coalesce(label_key(event), F.lit(""))
    return F.when(k == "", F.when(negative, "negative").otherwise("positive")).when(k.isin("negative", "structural"), k).otherwise("positive")


def appended(log: DataFrame, events: DataFrame, keep: int | None = 7000, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The decision log after events, cut to the `keep` newest rows (None: all of them); columns that one side lacks are null."""
    both = log.unionByName(events, allowMissingColumns=True)
    return both if keep is None else bounded(both, at, tie, keep)


def newest(rows: DataFrame, key: str, at: str, tie: str, keep: int | None = None) -> DataFrame:
    """Upsert: the newest row of each key; then the `keep` newest of all."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(at, tie)).alias("row")).select("row.*")
    return last if keep is None else last.orderBy(F.desc(at), F.desc(tie)).limit(keep)


def merged(identities: DataFrame, into: Column) -> DataFrame:
    """Identities united under `into`: counts add, prototypes add by weight, locks or, times take the latest.

    Where no usable prototype has a count, the prototype of the identity that is named `into` stays, else that of
    the last label. Columns of a second vector (aux_prototype, aux_sample_count, aux_last_used), locked_at and
    thresholds (the target's own first, else the first label's that has one) are merged where they are there.
    """
    has, agg = set(identities.columns), F.coalesce
    own = label_key(F.col("label")) == label_key(F.col("_into"))
    at = identities.withColumn("_into", into)
    times = [c for c in ("last_used", "last_corrected_at", "aux_last_used") if c in has]
    first = F.struct((~own).alias("far"), F.col("label"))
    rest = [F.sum(F.greatest(agg(F.col(c), F.lit(0)), F.lit(0))).alias(c) for c in ("sample_count", "aux_sample_count") if c in has]
    rest += [F.sum(c).alias(c) for c in ("confidence_sum", "pos_count", "neg_count") if c in has] + [F.max(c).alias(c) for c in times]
    rest += [F.bool_or("locked").alias("locked")] if "locked" in has else []
    rest += [F.min_by(c, F.when(F.col(c).isNotNull(), first)).alias(c) for c in ("same_threshold", "aux_threshold", "locked_at") if c in has]
    out = at.groupBy("_into").agg(*rest)
    for vector, count in (("prototype", "sample_count"), ("aux_prototype", "aux_sample_count")):
        if vector not in has:
            continue
        unit = at.select("_into", "label", own.alias("own"), F.greatest(agg(F.col(count), F.lit(0)), F.lit(0)).alias("n"), vec.normalized(F.col(vector)).alias("u")).where("u is not null")
        size = unit.where("n > 0").select("_into", F.posexplode(F.transform("u", lambda x: x * F.col("n"))).alias("pos", "x")).groupBy("_into", "pos").agg(F.sum("x").alias("x"))
        proto = size.groupBy("_into").agg(vec.normalized(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])).alias("_sum"))
        spare = unit.groupBy("_into").agg(F.max_by("u", F.struct("own", "label")).alias("_spare"))
        out = out.join(proto, "_into", "left").join(spare, "_into", "left").withColumn(vector, F.coalesce("_sum", "_spare")).drop("_sum", "_spare")
    return out.withColumnRenamed("_into", "label")


def relabel(rows: DataFrame, columns: list[str], source: str, target: str) -> DataFrame:
    """Rewrites a label, whatever its case, in several columns."""
    for c in columns:
        rows = rows.withColumn(c, F.when(label_key(F.col(c)) == source.strip().lower(), F.lit(target)).otherwise(F.col(c)))
    return rows


def locked(identities: DataFrame, label: str, state: bool) -> DataFrame:
    hit = label_key(F.col("label")) == label.strip().lower()
    return identities.withColumn("locked", F.when(hit, F.lit(state)).otherwise(F.col("locked")))


def moved_paths(rows: DataFrame, moves: DataFrame, old_prefix: str, new_prefix: str, column: str = "path") -> DataFrame:
    """Exact moves (old, new) first, else the folder's prefix."""
    at = rows.join(moves.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(column) == F.col("_old"), "left")
    by_prefix = F.when(F.col(column).startswith(old_prefix + "/"), F.concat(F.lit(new_prefix), F.expr(f"substring({column}, {len(old_prefix) + 1})"))).otherwise(F.col(column))
    return at.withColumn(column, F.coalesce("_new", by_prefix)).drop("_old", "_new")


def intra_distances(pairs_of: DataFrame, group: str, key: str, vector: str, low: float = 0.35, high: float = 0.98, fallback: float = 0.72) -> DataFrame:
    """group, rows, pairs, mean and population deviation of cosine distances inside each group, and 1 - (mean - 2 sd) held to [low, high].

    The pairs of a group are summed without listing them: with unit rows, the sum of dots over pairs comes from
    the vector sum, and of squared dots from the matrix of second moments; tasks add both up before the shuffle.
    """
    u = pairs_of.select(F.col(group).alias("g"), vec.normalized(F.col(vector)).alias("x"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, a: s + a * a)
    c = vector_sums(u, "g", "x", second=True).select("g", "n", square("total").alias("sum2"), square("moment").alias("sq2")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    dots, squares = (F.col("sum2") - F.col("n")) / 2, (F.col("sq2") - F.col("n")) / 2
    mean = F.when(F.col("pairs") > 0, dots / F.col("pairs"))
    dev = F.when(F.col("pairs") > 0, F.sqrt(F.greatest(F.lit(0.0), squares / F.col("pairs") - mean * mean)))
    out = c.select(F.col("g").alias(group), F.col("n").alias("rows"), "pairs", (1 - mean).alias("mean_distance"), dev.alias("sd_distance"))
    return out.withColumn("threshold", F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), 1 - (F.col("mean_distance") - 2 * F.col("sd_distance")))), F.lit(fallback)))


def bounded(rows: DataFrame, at: str, tie: str, keep: int) -> DataFrame:
    """The `keep` newest rows."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(keep)


def identity_list(folders: DataFrame, identities: DataFrame) -> DataFrame:
    """Folders with their identity's state, matched whatever the case."""
    i = identities.select(label_key(F.col("label")).alias("_key"), "locked", "sample_count")
    return folders.join(i, label_key(F.col("folder")) == F.col("_key"), "left").select(*folders.columns, F.coalesce("locked", F.lit(False)).alias("locked"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"))


def split(rows: DataFrame, selected: DataFrame, target: str) -> DataFrame:
    """Rows of the selected paths under a new label; the others stay."""
    return rows.join(F.broadcast(selected.select("path").distinct().withColumn("_hit", F.lit(True))) if selected.limit(100_001).count() <= 100_000 else selected.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left").withColumn("label", F.when(F.col("_hit"), F.lit(target)).otherwise(F.col("label"))).drop("_hit")


