"""Array-of-numbers expressions (PRJ-11..16): softmax, argmax, normalise, cosine.

Logits and embeddings are ``array<float|double>`` columns; all functions are
higher-order array expressions evaluated in the JVM, one row at a time, with
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_softmax(df: DataFrame, col, out: str) -> DataFrame:
    """Add ``out``: numerically stable softmax of a logits array (PRJ-13).

    Staged so the max and the sum are computed once per row, not once per
    element inside the lambda.
    """
    m, e, t = f"{out}__m", f"{out}__e", f"{out}__t"
    df = df.withColumn(m, F.array_max(F.transform(_c(col), lambda v: v.cast("double"))))
    df = df.withColumn(e, F.transform(_c(col), lambda v: F.exp(v.cast("double") - F.col(m))))
    df = df.withColumn(t, F.aggregate(F.col(e), F.lit(0.0), lambda acc, v: acc + v))
    return df.withColumn(out, F.transform(F.col(e), lambda v: v / F.col(t))).drop(m, e, t)


def argmax(col) -> Column:
    """0-based index of the first maximum (PRJ-14); NULL for an empty array."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(col) -> Column:
    return F.sqrt(F.aggregate(_c(col), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def with_l2_normalize(df: DataFrame, col, out: str) -> DataFrame:
    """Add ``out``: unit vector (PRJ-15); a zero vector stays zero."""
    n = f"{out}__n"
    df = df.withColumn(n, l2_norm(col))
    return df.withColumn(out, F.transform(_c(col), lambda v: F.when(F.col(n) > 0, v.cast("double") / F.col(n))
                                           .otherwise(F.lit(0.0)))).drop(n)


def cosine(a, b) -> Column:
    """Cosine similarity (PRJ-16): dot of the normalised vectors."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def cosine_to_unit(col) -> Column:
    """Map a cosine to [0, 1]: ``0.5 * (clip(s, -1, 1) + 1)`` (PRJ-11, T3)."""
    s = _c(col)
    return F.lit(0.5) * (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)) + F.lit(1.0))
