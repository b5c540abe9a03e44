"""Import every query module so that the catalogue is complete."""
from __future__ import annotations

from ..functions.features import compute
from ..functions.series import Series
from ..operators.asof import asof_ffill
from ..operators.labels import future_close, split_ratio
from ..operators.technical import bollinger, macd, returns, rsi, sma
from ..session import prepare
from . import gold_queries, inputs, market_queries, model_queries, news_queries, ops_queries, pipeline_queries  # noqa: F401
from .catalog import ORACLES, QUERIES, rounded
from .medallion import with_targets


def flagship(spark, sf_dir):
    """Hourly bars to indicators and labels in one pass, news as of each bar, temporal part."""
    prepare(spark)
    builders = [returns.using(steps=(1, 5, 30)), rsi.using(), macd.using(), bollinger.using(), sma.using(), future_close.using(horizon=30)]
    wide = with_targets(compute(inputs.hourly(spark, sf_dir), inputs.HOURLY, builders), 30)
    joined = asof_ffill(wide, inputs.signals(spark, sf_dir), inputs.HOURLY)
    return rounded(split_ratio(joined, Series(step=None)))
