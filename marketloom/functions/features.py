"""Feature builders: layers of columns that can share one pass over the blocks."""
from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from .rolling import ExpScan, Rows
from .series import ANY_SPACING, Series, apply_layers

SUB_ROWS = 1_024  # serves exponential spans from 4 to 50


@dataclass
class FeatureSet:
    layers: Sequence[Mapping[str, Column]]
    before: int
    after: int = 0


@dataclass
class Context:
    series: Series
    sub: int = SUB_ROWS
    totals: dict[str, dict[str, Column]] = field(default_factory=dict)

    @property
    def rows(self) -> Rows:
        return Rows(self.series, self.totals)

    @property
    def scan(self) -> ExpScan:
        return ExpScan(self.series, self.sub)


def combine(sets: Sequence[FeatureSet]) -> FeatureSet:
    """Merge features layer by layer; the deepest reach decides the halo."""
    depth = max(len(s.layers) for s in sets)
    layers: list[dict[str, Column]] = [{} for _ in range(depth)]
    for s in sets:
        for i, layer in enumerate(s.layers):
            layers[i].update(layer)
    return FeatureSet(layers, max(s.before for s in sets), max(s.after for s in sets))


def compute(df: DataFrame, series: Series, builders: Sequence[Callable[[Context], FeatureSet]]) -> DataFrame:
    """Add the columns of all builders in one shuffle."""
    ctx = Context(series)
    merged = combine([b(ctx) for b in builders])
    return apply_layers(df, series, merged.layers, merged.before, merged.after, ctx.sub, ctx.totals)


def feature(build: Callable[..., FeatureSet]):
    """Turn ``build(ctx, **params)`` into an operator ``op(df, series, **params)``.

    ``op.using(**params)`` gives the builder itself, to be passed to :func:`compute`.
    """

    @functools.wraps(build)
    def op(df: DataFrame, series: Series = ANY_SPACING, **params) -> DataFrame:
        return compute(df, series, [functools.partial(build, **params)])

    op.using = lambda **params: functools.partial(build, **params)
    return op
