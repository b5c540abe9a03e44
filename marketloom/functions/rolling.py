"""Column builders for bounded row windows and exponential means."""
from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .numeric import clean_double, col, safe_sqrt
from .series import POS, Series

#: Rows that one sliding sum adds at most.
STEP = 64


class Rows:
    """Shorthand for expressions over the rows of a block.

    Sums, means, deviations and extremes add up the rows of their frame and no others, so a
    bad tick is gone as soon as it leaves the frame.  Sums over more than ``STEP`` rows are
    put together from sums over ``STEP`` rows, which bounds the work for each row.  Presence
    counts are whole numbers and come from running totals.  NaN and infinities count as missing.

    ``totals`` collects helper columns (running counts, sums over ``STEP`` rows) that the layers
    need; ``apply_layers`` adds them as soon as their column exists.
    """

    def __init__(self, series: Series, totals: dict[str, dict[str, Column]] | None = None):
        self.series = series
        self.w = series.rows()
        self.totals = {} if totals is None else totals

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(col(x), k).over(self.w)

    def lead(self, x, k: int = 1) -> Column:
        return F.lead(col(x), k).over(self.w)

    def diff(self, x, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def pct(self, x, k: int = 1) -> Column:
        return F.try_divide(col(x).cast("double"), self.lag(x, k).cast("double")) - F.lit(1.0)

    def frame(self, n: int, shift: int = 0):
        return self.w.rowsBetween(-(n - 1 + shift), -shift)

    def _present(self, x: str, n: int, shift: int = 0) -> Column:
        """Finite values in the frame."""
        name = f"_count_of_{x}"
        running = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.totals.setdefault(x, {})[name] = F.count(clean_double(x)).over(running)
        upto = self.lag(name, shift) if shift else F.col(name)
        return upto - F.coalesce(self.lag(name, n + shift), F.lit(0))

    def _added(self, x: str, n: int) -> Column:
        """Sum of the last n rows; only meaningful where the frame is full."""
        value = clean_double(x)
        whole, rest = divmod(n, STEP)
        if n <= STEP:
            return F.sum(value).over(self.frame(n))
        name = f"_sum_of_{x}"
        self.totals.setdefault(x, {})[name] = F.sum(value).over(self.frame(STEP))
        parts = [F.col(name), *[self.lag(name, STEP * k) for k in range(1, whole)]]
        if rest:
            parts.append(F.sum(value).over(self.frame(rest, STEP * whole)))
        return reduce(lambda a, b: a + b, parts)

    def _full(self, value: Column, x: str, n: int, shift: int = 0) -> Column:
        return F.when(self._present(x, n, shift) == n, value)

    def mean(self, x: str, n: int) -> Column:
        return self._full(self._added(x, n) / n, x, n)

    def sum(self, x: str, n: int) -> Column:
        return self._full(self._added(x, n), x, n)

    def std(self, x: str, n: int) -> Column:
        return self._full(F.stddev_samp(clean_double(x)).over(self.frame(n)), x, n)

    def var(self, x: str, n: int) -> Column:
        return self._full(F.var_samp(clean_double(x)).over(self.frame(n)), x, n)

    def max(self, x: str, n: int, shift: int = 0) -> Column:
        return self._full(F.max(col(x)).over(self.frame(n, shift)), x, n, shift)

    def min(self, x: str, n: int, shift: int = 0) -> Column:
        return self._full(F.min(col(x)).over(self.frame(n, shift)), x, n, shift)


def decay(span: float) -> float:
    """Per-row decay of an exponential mean with the given span."""
    return 1.0 - 2.0 / (span + 1.0)


def warmup(span: float) -> int:
    """Rows after which the start of an exponential mean is below double precision."""
    return math.ceil(20 * (span + 1))


def sub_size(*spans: float) -> int:
    """Sub-block length: long enough that one carry suffices for the largest span."""
    size = max(warmup(s) for s in spans)
    if max(-math.log(decay(s)) * size for s in spans) > 690:
        raise ValueError("spans too far apart for one pass; compute them in separate passes")
    return size


class ExpScan:
    """Exponential means as running sums per sub-block plus the previous sub-block's end.

    y(t) = sum of w(i) b^(t-i) x(i).  Inside a sub-block this is b^j times the running sum
    of w x b^-j; the part before it is b^(j+1) times the value at the last row of the
    previous sub-block.  Anything older is below double precision because a sub-block
    is at least ``warmup(span)`` rows long.
    """

    def __init__(self, series: Series, sub: int):
        self.series, self.sub = series, sub
        self.w, self.ws = series.rows(), series.sub_rows()
        self.j = F.pmod(F.col(POS), F.lit(sub)).cast("double")

    def start(self) -> dict[str, Column]:
        """Layer that marks the first row of the block."""
        return {"_first": F.row_number().over(self.w) == 1}

    def inner(self, name: str, x, b: float, weight: Column | float = 1.0) -> dict[str, Column]:
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        scaled = w * clean_double(x) * F.pow(F.lit(b), -self.j)
        running = F.sum(scaled).over(self.ws.rowsBetween(Window.unboundedPreceding, 0))
        return {f"_in_{name}": F.coalesce(running * F.pow(F.lit(b), self.j), F.lit(0.0))}

    def outer(self, name: str, b: float) -> Column:
        end = F.when(self.j == self.sub - 1, F.col(f"_in_{name}"))
        previous = F.last(end, ignorenulls=True).over(self.w.rowsBetween(Window.unboundedPreceding, -1))
        return F.col(f"_in_{name}") + F.pow(F.lit(b), self.j + 1.0) * F.coalesce(previous, F.lit(0.0))

    def mean_layers(self, specs: Mapping[str, tuple[object, float]], adjust: bool = False) -> list[dict[str, Column]]:
        """Layers for {name: (column, span)}.

        ``adjust=False``: y0 = x0, then y = a x + (1-a) y.  ``adjust=True``: weighted mean of
        all rows so far.  Missing values have no weight: what is there shares the weight of all.
        """
        inner: dict[str, Column] = {}
        outer: dict[str, Column] = {}
        for name, (x, span) in specs.items():
            b = decay(span)
            present = F.when(clean_double(x).isNotNull(), F.lit(1.0))
            weight = F.lit(1.0) if adjust else F.when(F.col("_first"), F.lit(1.0)).otherwise(F.lit(1.0 - b))
            inner |= self.inner(f"{name}_n", x, b, weight) | self.inner(f"{name}_d", present, b, weight)
            outer[name] = F.try_divide(self.outer(f"{name}_n", b), self.outer(f"{name}_d", b))
        return [inner, outer]

    def std_layers(self, name: str, x, span: float) -> list[dict[str, Column]]:
        """Layers for the bias-corrected exponential standard deviation (adjust=True).

        Sums are centred on a nearby value so that the difference of squares keeps its digits.
        """
        b = decay(span)
        x = clean_double(x)
        one = F.when(x.isNotNull(), F.lit(1.0))
        parts = {"s0": (one, b), "s1": (x, b), "s2": (x * x, b), "q0": (one, b * b)}
        inner: dict[str, Column] = {}
        sums: dict[str, Column] = {}
        for part, (value, base) in parts.items():
            inner |= self.inner(f"{name}_{part}", value, base)
            sums[f"_{name}_{part}"] = self.outer(f"{name}_{part}", base)
        s0, s1, s2, q0 = (F.col(f"_{name}_{p}") for p in ("s0", "s1", "s2", "q0"))
        mean = F.try_divide(s1, s0)
        biased = F.greatest(F.try_divide(s2, s0) - mean * mean, F.lit(0.0))
        seen = F.count(x).over(self.w.rowsBetween(Window.unboundedPreceding, 0))
        var = biased * F.try_divide(s0 * s0, s0 * s0 - q0)
        return [inner, sums, {name: F.when(seen >= 2, safe_sqrt(var))}]
