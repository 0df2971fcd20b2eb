"""Scalar change scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_difference(reference, source) -> Column:
    """Mean absolute channel difference on a 0..1 scale."""
    parts = [F.abs(s.cast("int") - r.cast("int")) for r, s in zip(reference, source)]
    return sum(parts[1:], parts[0]) / (255.0 * len(parts))


def residual(reference: Column, source: Column, kind: str) -> Column:
    difference = source.cast("int") - reference.cast("int")
    return F.abs(difference) if kind == "abs" else F.pmod(difference, F.lit(256))


def compressed_scale(bits_per_byte: Column) -> Column:
    """Fixed monotone scale of a compression cost to [0, 1)."""
    return -F.expm1(-bits_per_byte / 8)


def distance_scale(distance: Column) -> Column:
    return distance / (1 + distance)


def _dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def cosine_change(a: Column, b: Column) -> Column:
    """Half of one minus the cosine of two feature vectors."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(norm > 0, (1 - _dot(a, b) / norm) / 2)


def probability_change(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def bernoulli_entropy(probabilities: Column) -> Column:
    """Mean entropy in bits of independent class probabilities."""
    def bits(p):
        q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p.cast("double")))
        inside = -(q * F.log2(q) + (1 - q) * F.log2(1 - q))
        return F.when((p == 0) | (p == 1), 0.0).otherwise(inside)

    total = F.aggregate(F.transform(probabilities, bits), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(probabilities)
