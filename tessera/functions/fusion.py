"""Two similarities fused around a threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import clamp


@dataclass(frozen=True)
class Fusion:
    """Weights and margins of the ambiguous zone [threshold - low, threshold + high)."""

    enabled: bool = True
    weight: float = 0.35
    least_aux: float = 0.55
    low: float = 0.08
    high: float = 0.06

    def held(self) -> tuple[float, float, float, float]:
        one = lambda x: min(1.0, max(0.0, x))
        return one(self.weight), one(self.least_aux), max(0.0, self.low), max(0.0, self.high)


def rerank(primary: Column, aux: Column, threshold: Column | float, rule: Fusion = Fusion()) -> Column:
    """struct(accepted, fused, mode, aux_used): direct outside the ambiguous zone, weighted inside it."""
    weight, least_aux, low, high = rule.held()
    thr = clamp(F.lit(threshold) if not isinstance(threshold, Column) else threshold)
    fused = (1 - weight) * primary + weight * aux
    usable = aux.isNotNull() if rule.enabled else F.lit(False)
    row = lambda ok, score, mode, used: F.struct(ok.alias("accepted"), score.alias("fused"), F.lit(mode).alias("mode"), F.lit(used).alias("aux_used"))
    return (
        F.when(primary.isNull(), F.lit(None))
        .when(primary >= thr + high, row(F.lit(True), primary, "direct_accept", False))
        .when(primary < thr - low, row(F.lit(False), primary, "direct_reject", False))
        .when(~usable, row(primary >= thr, primary, "ambiguous_primary", False))
        .otherwise(row((fused >= thr) & (aux >= least_aux), fused, "ambiguous_fused", True))
    )


MODES = ("direct_accept", "direct_reject", "ambiguous_primary", "ambiguous_fused")


def rerank_arrays(primary: np.ndarray, aux: np.ndarray | None, threshold: np.ndarray, rule: Fusion) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As rerank(), over arrays (NaN for a missing aux): accepted, fused and the number of the mode."""
    weight, least_aux, low, high = rule.held()
    thr = np.clip(threshold, 0, 1)
    aux = np.full(primary.shape, np.nan) if aux is None or not rule.enabled else aux
    there = ~np.isnan(aux)
    mixed = np.where(there, (1 - weight) * primary + weight * np.where(there, aux, 0), primary)
    yes, no = primary >= thr + high, primary < thr - low
    mode = np.where(yes, 0, np.where(no, 1, np.where(there, 3, 2)))
    fused = np.where(mode == 3, mixed, primary)
    accepted = np.where(mode == 3, (mixed >= thr) & (np.where(there, aux, 0) >= least_aux), np.where(mode == 2, primary >= thr, yes))
    return accepted, fused, mode
