import math

import pytest
from pyspark.sql import functions as F

from tessera.config import resolve
from tessera.functions import scalar, vec
from tessera.functions.fusion import Fusion, rerank


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "primary,aux,mode,accepted,fused",
    [(0.92, None, "direct_accept", True, 0.92), (0.79, 0.95, "ambiguous_fused", True, 0.846), (0.81, 0.30, "ambiguous_fused", False, 0.6315), (0.81, None, "ambiguous_primary", True, 0.81), (0.70, 0.99, "direct_reject", False, 0.70)],
)
def test_rerank(spark, primary, aux, mode, accepted, fused):
    r = value(spark, rerank(F.lit(primary), F.lit(aux).cast("double"), 0.80, Fusion()))
    assert (r["mode"], r["accepted"]) == (mode, accepted) and math.isclose(r["fused"], fused)


@pytest.mark.parametrize("pos,neg,want", [(0, 0, 0.82), (30, 0, 0.74), (0, 30, 0.82), (20, 20, 0.82), (10, 2, 0.7917), (20, 5, 0.7685)])
def test_adaptive_threshold(spark, pos, neg, want):
    assert value(spark, scalar.adaptive_threshold(F.lit(pos), F.lit(neg))) == pytest.approx(want)


def test_degenerate_vectors_are_null(spark):
    one, zero, bad = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(float("nan")), F.lit(1.0))
    assert value(spark, vec.normalized(zero)) is None and value(spark, vec.normalized(bad)) is None
    assert value(spark, vec.cosine(one, zero)) is None
    assert value(spark, vec.cosine(one, one)) == pytest.approx(1.0)


def test_names_and_casts(spark):
    assert value(spark, scalar.folder_name(F.lit('a<>b__c. '))) == "a_b_c"
    assert value(spark, scalar.folder_name(F.lit(" .. "))) == "Unknown"
    assert value(spark, scalar.title(F.lit("abc1def"))) == "Abc1Def"
    assert value(spark, scalar.safe_int(F.lit("1.5"))) == 0 and value(spark, scalar.safe_int(F.lit(" 7 "))) == 7
    assert value(spark, scalar.stem(F.lit("x/.hidden"))) == ".hidden" and value(spark, scalar.stem(F.lit("x/a.b.mp4"))) == "a.b"
    assert value(spark, scalar.clock(F.lit(3723))) == "1h 02m 03s"


def test_hamming(spark):
    h = lambda *x: F.array(*(F.lit(v).cast("bigint") for v in x))
    assert value(spark, vec.hamming(h(0, 3), h(1))) == 1.0
    assert value(spark, vec.hamming(h(), h(1))) == 999.0


def test_profiles():
    assert resolve("High Accuracy").sample_every == 1.0 and resolve("nonsense").profile == "balanced"
    assert resolve("fast", {"sample_every": 9.0}, tuned=True).sample_every == 9.0 and resolve("fast", tuned=True).eps == 0.40
    assert resolve("fast", reprocess=True).profile == "high_accuracy"
    with pytest.raises(ValueError):
        resolve("fast", {"confirmation_frames": 1})
