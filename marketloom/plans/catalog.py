"""Named queries with their SQL check, filled by the query modules."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import r6
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` under a name, results rounded for comparison."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(prepare(spark), sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = expand(sql)
        return build

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Round top-level floating point columns to six places."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: r6(F.col(c)) for c in floats}) if floats else df


def rnd(*names: str) -> str:
    """SQL twin of :func:`rounded` for the named columns."""
    return ", ".join(f"R6({n}) AS {n}" for n in names)


def expand(text: str) -> str:
    """Write out R6(x): six places, halves (and values a hair below) rounded up."""
    while "R6(" in text:
        start = text.rindex("R6(")
        depth, end = 1, start + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[start + 3 : end - 1]
        text = f"{text[:start]}floor(({inner})::DOUBLE * 1e6 + 0.5001::DOUBLE) / 1e6{text[end:]}"
    return text


# Shared SQL inputs; each entry may refer to the ones it names in `needs`.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (needs, body)


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """Prefix a SELECT with the shared inputs it needs.

    ``body`` may start with its own CTEs: ``a AS (...), b AS (...) SELECT ...``.
    """
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in _CTES[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        visit(n)
    text = body.strip()
    own = not text.upper().startswith("SELECT")
    shared = ", ".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" for n in ordered)
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not shared:
        return (head + text) if own else text
    return head + shared + (", " if own else " ") + text


W = "(PARTITION BY instrument ORDER BY time)"


def over(agg: str, a: int, b: int = 0, w: str = "PARTITION BY instrument ORDER BY time") -> str:
    end = "CURRENT ROW" if b == 0 else f"{b} PRECEDING"
    return f"{agg} OVER ({w} ROWS BETWEEN {a} PRECEDING AND {end})"


def roll(agg: str, x: str, n: int) -> str:
    """SQL rolling aggregate that is null unless n inputs are present."""
    return f"CASE WHEN {over(f'count({x})', n - 1)} = {n} THEN {over(f'{agg}({x})', n - 1)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W}"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select("instrument", "time", *names)
