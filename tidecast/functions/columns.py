"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_day(*keys: str) -> WindowSpec:
    """The one window most operators use: a series (and optional keys) in date order."""
    return Window.partitionBy("series_id", *keys).orderBy("ds")


def week_of_month(day: Column) -> Column:
    return ((F.dayofmonth(day) - 1) / 7).cast("int") + 1


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bound a value, keeping null (``least``/``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def careful_sum(a: Column) -> Column:
    """Sum that carries along what each addition rounds off (Neumaier), so that it hardly depends on the order."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(a, start, step, lambda acc: acc["s"] + acc["c"])


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a))


def last_of(a: Column, n: int) -> Column:
    """The last ``n`` elements, or all if there are fewer."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def array_median(a: Column) -> Column:
    """Middle of an array, the mean of the two middle values for an even size."""
    ordered, n = F.sort_array(a), F.size(a)
    low, high = ((n - 1) / 2).cast("int"), (n / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2


def array_dot(a: Column, weights: list[float]) -> Column:
    """Weighted sum of an array of the same length; null for any other length."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.when(F.size(a) == len(weights), array_sum(F.zip_with(a, w, lambda x, y: x * y)))


def trimmed_mean(values: Column, cut: float, ordered: bool = False) -> Column:
    """Mean of an array, which may be ``ordered`` already, after dropping ``int(cut * n)`` values at each end."""
    n = F.size(values)
    k = F.floor(F.lit(cut) * n).cast("int")
    kept = F.slice(values if ordered else F.array_sort(values), k + 1, F.greatest(n - 2 * k, F.lit(0)))
    return F.try_divide(array_sum(kept), F.size(kept))


def null_inf(df: DataFrame) -> DataFrame:
    """Replace +/-infinity with null in every double column."""
    return df.select(
        *[
            F.when(F.abs(F.col(f.name)) != float("inf"), F.col(f.name)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def prediction(model: str, yhat: Column, family: str, lo: Column | None = None, hi: Column | None = None) -> list[Column]:
    """The columns every forecaster returns next to ``series_id, target_ds``."""
    none = F.lit(None).cast("double")
    return [
        F.lit(model).alias("model"), yhat.cast("double").alias("yhat"),
        (none if lo is None else lo).alias("lo"), (none if hi is None else hi).alias("hi"),
        F.lit(family).alias("family"),
    ]


def one_model(df: DataFrame, model: str, yhat: Column, family: str, lo=None, hi=None) -> DataFrame:
    """Prediction rows of one model, leaving out targets without a value."""
    out = df.select("series_id", "target_ds", *prediction(model, yhat, family, lo, hi))
    return out.filter(F.col("yhat").isNotNull())
