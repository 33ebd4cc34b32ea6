"""Score transforms, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_to_score(rank: Column) -> Column:
    """A BM25 rank (negative is better) as 0 to 1: r / (1 + r) for -r, 1 / (1 + rank) from zero on, 0.001 if not finite."""
    odd = F.isnan(rank) | (F.abs(rank) == float("inf"))
    return F.when(odd, F.lit(1.0) / 1000.0).when(rank < 0, -rank / (1.0 - rank)).otherwise(1.0 / (1.0 + rank))


def distance_to_similarity(distance: Column) -> Column:
    """Cosine of unit vectors at a Euclidean distance, within 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance * distance / 2.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def decay(path: Column, as_of: Column, half_life_days: float) -> Column:
    """2 ** -(age / half life) of files named by a date (YYYY-MM-DD.md); 1 for others, bad dates and future ones."""
    if not half_life_days > 0:
        raise ValueError("half_life_days must be positive")
    day = F.try_to_date(F.regexp_extract(path, "(?:^|/)([0-9]{4}-[0-9]{2}-[0-9]{2})\\.md\\z", 1), "yyyy-MM-dd")
    age = F.greatest(F.lit(0), F.date_diff(as_of, day))
    return F.when(day.isNull(), F.lit(1.0)).otherwise(F.exp(-math.log(2) / half_life_days * age))
