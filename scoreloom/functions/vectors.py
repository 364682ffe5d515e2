"""Vector arithmetic, pooling and layer selection on array columns, in double precision."""

from __future__ import annotations

import bisect
import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_total(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 when either is zero."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def euclidean(a, b, eps: float = 1e-6) -> Column:
    """L2 distance with ``eps`` added to each difference."""
    gap = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y + F.lit(eps))
    return F.sqrt(_total(F.transform(gap, lambda x: x * x)))


def angular(cos: Column) -> Column:
    """Angle from a cosine, clamped against rounding."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))


def cosine_logits(cos: Column) -> Column:
    return F.array(-cos, cos)


def euclidean_logits(d: Column) -> Column:
    return F.array(d - 1, 1 - d)


def pooling_mask(mask: Column, side: str = "left", last_token_offset: int = 0) -> Column:
    """The attention mask without the last ``last_token_offset`` real tokens."""
    if side not in ("left", "right"):
        raise ValueError(f"padding side {side!r} not recognised")
    if last_token_offset <= 0:
        return mask
    if side == "left":
        end = F.size(mask) - last_token_offset
    else:
        end = _total(mask.cast("array<double>")).cast("int") - last_token_offset
    return F.transform(mask, lambda m, i: F.when(i < end, m).otherwise(F.lit(0)))


def mean_pool(
    hidden: Column, mask: Column, side: str = "left", last_token_offset: int = 0,
    nan_safe: bool = False,
) -> Column:
    """Mean of the token vectors where the mask is 1.

    One pass over the tokens; ``nan_safe`` counts NaN entries as 0.
    """
    weights = pooling_mask(mask, side, last_token_offset)
    count = _total(weights.cast("array<double>"))
    tokens = F.zip_with(
        hidden.cast("array<array<double>>"), weights,
        lambda h, w: F.transform(h, lambda x: (F.nanvl(x, F.lit(0.0)) if nan_safe else x) * w),
    )
    start = F.transform(F.element_at(hidden, 1), lambda x: F.lit(0.0))
    summed = F.aggregate(tokens, start, lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.nullif(count, F.lit(0.0)))


def last_token_pool(
    hidden: Column, mask: Column, side: str = "left", last_token_offset: int = 0
) -> Column:
    """Vector of the last real token, or of the one ``last_token_offset`` before it."""
    if side == "left":
        return F.element_at(hidden, F.lit(-1 - last_token_offset)).cast("array<double>")
    if side != "right":
        raise ValueError(f"padding side {side!r} not recognised")
    position = _total(mask.cast("array<double>")).cast("int") - last_token_offset
    return F.element_at(hidden, position).cast("array<double>")


def multi_pool(
    hidden: Column, mask: Column, modes: str = "mean", side: str = "left",
    last_token_offset: int = 0,
) -> Column:
    """Concatenation of several poolings named in a comma-separated list."""
    parts = []
    for mode in (m.strip() for m in modes.split(",")):
        if mode == "mean":
            parts.append(mean_pool(hidden, mask, side, last_token_offset))
        elif mode == "lasttoken":
            parts.append(last_token_pool(hidden, mask, side, last_token_offset))
        else:
            raise ValueError(f"pooling mode {mode!r} not recognised")
    return F.concat(*parts)


def select_layer(layers: Column, k: int = -1) -> Column:
    """Layer k, counted from 0 or, when negative, from the end."""
    return F.element_at(layers, k + 1 if k >= 0 else k)


# Methods of layer selection: how unevenly each dimension finds one owner layer (None: it finds
# none), and how many times the width all layers together draw at random.
LAYER_METHODS = {0: (5, 0.0), 1: (1, 0.0), 2: (None, 1.5), 3: (1, 1.0)}


def _key_number(*keys) -> int:
    """The number ``hash32`` gives for the same keys, on the driver."""
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def layer_plan(n_layers: int, dim: int, method: int = 1, seed: int = 1234) -> list[list[int]]:
    """Dimensions to take from each layer, in ascending order.

    Every choice is a key hash, so it depends on layer and dimension only. A dimension is
    owned by the layer into whose share of the unit interval its number falls; shares rise evenly
    from 1 for the first layer to ``steepness`` (at most the number of layers) for the last. A layer
    draws the dimensions with its smallest numbers.
    """
    if method not in LAYER_METHODS:
        raise ValueError(f"layer method {method} not recognised")
    steepness, drawn = LAYER_METHODS[method]
    taken: list[set[int]] = [set() for _ in range(n_layers)]
    if steepness is not None:
        rise = (min(steepness, n_layers) - 1) / max(n_layers - 1, 1)
        ends = list(itertools.accumulate(1 + rise * k for k in range(n_layers)))
        for d in range(dim):
            at = _key_number(seed, "owner", d) / 2**32 * ends[-1]
            taken[bisect.bisect_right(ends, at)].add(d)
    size = int(drawn * dim // n_layers)
    for layer, own in enumerate(taken):
        own.update(sorted(range(dim), key=lambda d: (_key_number(seed, layer, d), d))[:size])
    return [sorted(own) for own in taken]


def layer_mix(layers: list[Column], plan: list[list[int]]) -> Column:
    """Concatenate the planned dimensions of every layer."""
    def pick(layer: Column, dims: list[int]) -> Column:
        if not dims:
            return F.array().cast("array<double>")
        index = F.array(*[F.lit(d) for d in dims])
        return F.transform(index, lambda i: F.get(layer, i).cast("double"))

    return F.concat(*[pick(layer, dims) for layer, dims in zip(layers, plan)])


def merge_layer_batches(df: DataFrame, keys: list[str], layer: str = "layer", vector: str = "vector") -> DataFrame:
    """One row per record with a map layer -> vector, from one row per record and layer.

    A record has as many rows as the model has selected layers.
    """
    entries = F.sort_array(F.collect_list(F.struct(F.col(layer), F.col(vector))))
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias("layers"))
