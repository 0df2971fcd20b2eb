"""Scorers by name, with checked options and one output shape.

A scorer maps supported pixels to (image, y, x, score, raw_score, native).
Built-in scorers are column expressions or tile jobs; ``tile_scores`` runs a
user's array function on bounded tiles with a halo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import scores as S
from driftlens.operators import scoring as C
from driftlens.operators.scoring import tile_scores  # noqa: F401

_SCORERS: dict[str, tuple] = {}


def register_scorer(name: str, function, **defaults) -> None:
    """``function(pixels, image, reference, source, **options)``; names are unique."""
    if name in _SCORERS:
        raise ValueError(f"scorer {name} exists")
    _SCORERS[name] = (function, defaults)


def score_pixels(name: str, pixels: DataFrame, image: str, reference, source, **options) -> DataFrame:
    """Run a scorer; unknown names and options are refused."""
    if name not in _SCORERS:
        raise KeyError(f"unknown scorer {name}; known: {sorted(_SCORERS)}")
    function, defaults = _SCORERS[name]
    unknown = set(options) - set(defaults)
    if unknown:
        raise ValueError(f"{name} has no options {sorted(unknown)}")
    scored = function(pixels, image, reference, source, **{**defaults, **options})
    for column, kind in (("raw_score", "double"), ("native", "boolean")):
        if column not in scored.columns:
            scored = scored.withColumn(column, F.lit(None).cast(kind))
    return scored.select(image, "y", "x", "score", "raw_score", "native")


def _rgb(pixels, image, reference, source):
    value = S.rgb_difference([F.col(c) for c in reference], [F.col(c) for c in source])
    return pixels.filter("support").select(image, "y", "x", value.alias("score"))


register_scorer("rgb_difference", _rgb)
register_scorer("ssim", C.ssim_change)
