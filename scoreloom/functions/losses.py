"""Pair losses as columns; average them for the batch loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import angular


def _relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def contrastive_cosine(cos: Column, label: Column) -> Column:
    """1 - cos for equal pairs, else how far it falls short of 1 + label."""
    d = 1 - cos
    return F.when(label == 0, d).otherwise(_relu(1 + label - d))


def contrastive_euclid(
    d: Column, label: Column, margin: float = 2.0, margin_mult: float = 1.0,
    use_diff_norm: bool = False,
) -> Column:
    """Squared distance for equal pairs, else the squared shortfall from a margin that grows
    with the label."""
    steps = label if use_diff_norm else label - 1
    return F.when(label == 0, d * d).otherwise(
        F.pow(_relu(F.lit(margin) + steps * F.lit(margin_mult) - d), 2)
    )


def angular_loss(cos: Column, is_similar: Column, margin: float = 1.0) -> Column:
    """The angle for similar pairs (1), the shortfall from the margin for others (0)."""
    theta = angular(cos)
    return is_similar * theta + (1 - is_similar) * _relu(F.lit(margin) - theta)


def hybrid_loss(pair_loss: Column, lm_loss1: Column, lm_loss2: Column, weight: float) -> Column:
    """Pair loss plus the weighted mean of both language-model losses."""
    if weight <= 0:
        return pair_loss
    return pair_loss + F.lit(weight) * (lm_loss1 + lm_loss2) / 2
