"""Intervals of Poisson counts and Gamma rates, worked out once per distinct shape and joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.quantiles import gamma_quantile, garwood, negative_binomial_quantile


def with_intervals(rows: DataFrame, count: str, years: Column | float, law: Callable[[int], tuple[float, float]] = garwood, names: tuple[str, str] = ("rate_lower", "rate_upper")) -> DataFrame:
    """Adds the bounds of the rate to rows with a count and an exposure in years; null counts have null bounds.

    Distinct counts are few beside the rows; their bounds are worked out by tasks and joined, broadcast or not as
    their size allows.
    """

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [law(int(n)) for n in batch["_n"]]
            yield batch.assign(_lo=[p[0] for p in pairs], _hi=[p[1] for p in pairs])

    known = rows.select(F.col(count).cast("long").alias("_n")).where("_n IS NOT NULL").distinct().mapInPandas(bounds, "_n long, _lo double, _hi double")
    joined = rows.join(known, F.col(count).cast("long") == F.col("_n"), "left")
    return joined.withColumns({names[0]: F.col("_lo") / years, names[1]: F.col("_hi") / years}).drop("_n", "_lo", "_hi")


def uniform_prior(n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Interval of a count's mean under a flat prior."""
    return gamma_quantile(n + 1.0, alpha / 2), gamma_quantile(n + 1.0, 1 - alpha / 2)


def with_gamma_quantiles(rows: DataFrame, shape: str, rate: str, levels: dict[str, float]) -> DataFrame:
    """Adds quantiles of a Gamma law with the columns ``shape`` and ``rate`` (1 / scale), by distinct shape."""
    names = list(levels)

    def quantiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{f"_{name}": [gamma_quantile(a, levels[name]) for a in batch["_a"]] for name in names})

    known = rows.select(F.col(shape).alias("_a")).where("_a IS NOT NULL").distinct().mapInPandas(quantiles, ", ".join(["_a double", *[f"_{n} double" for n in names]]))
    joined = rows.join(known, F.col(shape) == F.col("_a"), "left")
    return joined.withColumns({n: F.col(f"_{n}") / F.col(rate) for n in names}).drop("_a", *[f"_{n}" for n in names])


def with_count_intervals(rows: DataFrame, shape: str, p: str, levels: list[float]) -> DataFrame:
    """Adds lo_<level> and hi_<level> of the negative binomial count with real ``shape`` and success probability ``p``."""
    names = [(f"lo_{round(level * 100)}", (1 - level) / 2) for level in levels] + [(f"hi_{round(level * 100)}", (1 + level) / 2) for level in levels]

    def quantiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: [negative_binomial_quantile(r, x, q) for r, x in zip(batch["_r"], batch["_p"], strict=True)] for name, q in names})

    known = rows.select(F.col(shape).alias("_r"), F.col(p).alias("_p")).where("_r IS NOT NULL AND _p IS NOT NULL").distinct()
    known = known.mapInPandas(quantiles, ", ".join(["_r double", "_p double", *[f"{n} int" for n, _ in names]]))
    return rows.join(known, (F.col(shape) == F.col("_r")) & (F.col(p) == F.col("_p")), "left").drop("_r", "_p")
