"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return 1 - dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


DISTANCES = {"cosine": cosine_distance, "l2": squared_l2}


def similarity(distance: Column) -> Column:
    """1 / (1 + distance), kept within 0 and 1; a missing distance is no similarity."""
    return F.when(distance.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + distance))))


def mean_pooled(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, summed where the rows lie; rows without a vector do not count."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = chunks.filter(F.col(vector).isNotNull()).select(key, array_to_vector(as_doubles(F.col(vector))).alias("v"))
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias(vector))
