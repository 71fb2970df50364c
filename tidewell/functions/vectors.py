"""Vector expressions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for zero or unlike vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def mean_vector(df, by: str, vector: str = "embedding"):
    """(by, centroid): exact mean per dimension, aggregated by (key, dimension)."""
    cells = df.select(by, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
    return ordered.select(by, F.transform("v", lambda p: p["m"]).alias("centroid"))


def running_mean(old: Column, new: Column, n: Column) -> Column:
    """The mean of n + 1 vectors from that of n and one more."""
    return F.zip_with(old, new, lambda c, v: (c * n + v) / (n + 1))
