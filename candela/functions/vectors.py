"""Vector similarity on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, zero, lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Vector of length 1, so that a pair's cosine is one dot product; null elements for a zero vector."""
    # the outer lambda binds the length: written inside the inner one it would be summed anew for every element
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))
    return F.get(scaled, F.lit(0))


def clipped(value: Column) -> Column:
    """To [0, 1]; 0 for null."""
    known = F.coalesce(value, F.lit(0.0))  # greatest and least would skip a null
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), known))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, clipped to [0, 1]; 0 for a missing or zero vector."""
    return clipped(F.try_divide(dot(a, b), norm(a) * norm(b)))


def weighted_sum(parts: list[tuple[Column, float]]) -> Column:
    """Element-wise linear combination of equally long vectors."""
    def scale(weight: float):
        return lambda x: x.cast("double") * F.lit(float(weight))

    scaled = [F.transform(v, scale(w)) for v, w in parts]
    total = scaled[0]
    for v in scaled[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    return total
