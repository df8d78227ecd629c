"""Least squares in SQL: sums of products per group, then elimination step by step."""

from __future__ import annotations

from collections.abc import Sequence

IDS = "series_id, target_ds"


def gram(name: str, source: str, x: Sequence[str], y: str, ridge: str = "0", having: str = "") -> str:
    """Normal equations of ``y`` on the expressions ``x`` per group; ``ridge`` may use
    ``{trace}``, the sum of the diagonal."""
    sums = [f"sum(({x[i]}) * ({x[j]})) as q_{i}_{j}" for i in range(len(x)) for j in range(i, len(x))]
    sums += [f"sum(({x[i]}) * ({y})) as b_{i}" for i in range(len(x))]
    lam = ridge.replace("{trace}", "(" + " + ".join(f"q_{i}_{i}" for i in range(len(x))) + ")")
    full = [f"q_{min(i, j)}_{max(i, j)}" + (f" + {lam}" if i == j else "") + f" as a_{i}_{j}"
            for i in range(len(x)) for j in range(len(x))]
    return f"""{name}_q as materialized (select {IDS}, count(*) as rows_, {', '.join(sums)} from {source} group by {IDS} {having}),
  {name}_0 as materialized (select {IDS}, rows_, {', '.join(full)}, {', '.join(f'b_{i}' for i in range(len(x)))} from {name}_q)"""


def eliminate(name: str, k: int) -> str:
    """From ``{name}_0`` to ``{name}``, whose columns b_0 .. are the solution."""
    ctes = []
    for p in range(k):
        cols = []
        for i in range(k):
            for j in (*range(p + 1, k), None):
                left, row = (f"a_{i}_{j}", f"a_{p}_{j}") if j is not None else (f"b_{i}", f"b_{p}")
                cols.append(f"{row} / a_{p}_{p} as {left}" if i == p else f"{left} - a_{i}_{p} * {row} / a_{p}_{p} as {left}")
        to = name if p == k - 1 else f"{name}_{p + 1}"
        ctes.append(f"{to} as materialized (select {IDS}, rows_, {', '.join(cols)} from {name}_{p})")
    return ",\n  ".join(ctes)


def dot(x: Sequence[str], prefix: str = "") -> str:
    return " + ".join(f"{prefix}b_{i} * ({e})" for i, e in enumerate(x))


LAM = "1e-10::double * {trace} + 1e-12::double"


def arma(tag: str, model: str, season: int, ar: Sequence[int], ma: Sequence[int], least: int) -> tuple[list[str], str]:
    """One-step forecasts on first differences (after seasonal ones): residuals of a long
    autoregression, then lagged values and residuals.  CTEs over ``p`` and the rows."""
    deepest = max([*ar, *ma])
    long = max(deepest + 3, 10)
    first, w = long + deepest, f"over (partition by {IDS} order by t)"
    z = f"{tag}_z"
    ctes = [
        f"{tag}_s as (select {IDS}, ds, y, " + (f"y - lag(y, {season}) over g as s" if season else "y as s")
        + f", lag(y, {max(season - 1, 0)}) over g as back from p window g as (partition by {IDS} order by ds) qualify count(*) over (partition by {IDS}) >= {least})",
        f"{tag}_d as (select *, s - lag(s) over (partition by {IDS} order by ds) as z from {tag}_s)",
        f"{z} as materialized (select {IDS}, z, s, back, row_number() over (partition by {IDS} order by ds) - 1 as t, "
        f"count(*) over (partition by {IDS}) as n_ from {tag}_d where z is not null)",
        f"{tag}_l as materialized (select *, {', '.join(f'lag(z, {k}) {w} as l{k}' for k in range(1, long + 1))} from {z})",
    ]
    x1 = ["1.0::double", *[f"l{k}" for k in range(1, long + 1)]]
    ctes += [gram(f"{tag}_u", f"{tag}_l where t >= {long} and n_ - {long} >= {long + 6}", x1, "z", LAM), eliminate(f"{tag}_u", len(x1))]
    ctes.append(f"""{tag}_e as (select l.*exclude(n_), n_, case when t >= {long} then z - ({dot(x1, 'u.')}) else 0.0 end as e
    from {tag}_l l join {tag}_u u using ({IDS}))""")
    ctes.append(f"{tag}_f as materialized (select *, {', '.join(f'lag(e, {k}) {w} as e{k}' for k in ma)} from {tag}_e)")
    x2 = [*[f"l{k}" for k in ar], *[f"e{k}" for k in ma]]
    ctes += [gram(f"{tag}_v", f"{tag}_f where t >= {first} and n_ - {first} >= {len(x2) + 5}", x2, "z", LAM), eliminate(f"{tag}_v", len(x2))]
    last = [f"max(z) filter (where t = n_ - {k})" for k in ar] + [f"max(e) filter (where t = n_ - {k})" for k in ma]
    ctes.append(f"""{tag}_n as (select {IDS}, max(s) filter (where t = n_ - 1) as s, max(back) filter (where t = n_ - 1) as back,
    {', '.join(f'{e} as x{i}' for i, e in enumerate(last))} from {tag}_f group by {IDS})""")
    level = "s + back" if season else "s"
    return ctes, f"""select {IDS}, {level} + {dot([f'x{i}' for i in range(len(x2))])} as yhat from {tag}_n join {tag}_v using ({IDS})"""


def fourier(yearly: int, weekly: int) -> tuple[list[str], str]:
    """Trend and Fourier terms on the day number, with a band of 1.96 residual deviations."""
    def design(day: str) -> list[str]:
        cols = ["1.0::double", f"({day} - origin) / 365.25::double"]
        for period, order in (("365.25::double", yearly), ("7.0::double", weekly)):
            for k in range(1, order + 1):
                cols += [f"sin(2 * pi() * {k} * {day} / {period})", f"cos(2 * pi() * {k} * {day} / {period})"]
        return cols

    k = 2 + 2 * (yearly + weekly)
    x, x0 = design("day"), design("target")
    ctes = [
        f"""fo as materialized (select {IDS}, cast(ds - date '1970-01-01' as double) as day, y, cast(target_ds - date '1970-01-01' as double) as target,
    min(cast(ds - date '1970-01-01' as double)) over (partition by series_id) as origin from p qualify count(*) over (partition by {IDS}) >= {max(30, k + 5)})""",
        gram("fg", "fo", x, "y", "1e-8::double"), eliminate("fg", k),
        f"""fr as (select {IDS}, any_value(target) as target, any_value(origin) as origin, sqrt(sum(power(y - ({dot(x)}), 2)) / (count(*) - {k})) as sd
    from fo join fg using ({IDS}) group by {IDS})""",
    ]
    return ctes, f"select {IDS}, v as yhat, v - 1.96::double * sd as lo, v + 1.96::double * sd as hi from (select {IDS}, {dot(x0)} as v, sd from fr join fg using ({IDS}))"


def lag_ridge() -> tuple[list[str], str]:
    """Ridge (penalty 1) on standardised calendar parts, position and lags 1, 7 and 14."""
    def parts(day: str) -> list[str]:
        return [f"isodow({day}) - 1", f"month({day})", f"(day({day}) - 1) // 7 + 1", f"dayofyear({day})"]

    w = "over (partition by series_id order by ds)"
    f = [*parts("ds"), f"row_number() {w} - 1", *[f"lag(y, {b}) {w}" for b in (1, 7, 14)]]
    f0 = [*parts("target_ds"), "count(*)", *[f"max(y) filter (where r = {b})" for b in (1, 7, 14)]]
    n = range(len(f))
    ctes = [
        f"lf as (select series_id, ds, y, {', '.join(f'cast({e} as double) as f{i}' for i, e in enumerate(f))} from h)",
        f"lt as materialized (select t.target_ds, lf.* from t join lf on lf.series_id = t.series_id and lf.ds < t.target_ds and f7 is not null)",
        f"""ls as materialized (select {IDS}, avg(y) as my, {', '.join(f'avg(f{i}) as m{i}, case when stddev_pop(f{i}) > 0 then stddev_pop(f{i}) else 1 end as s{i}' for i in n)}
    from lt group by {IDS} having count(*) >= 20)""",
        f"lz as materialized (select {IDS}, y - my as yc, {', '.join(f'(f{i} - m{i}) / s{i} as z{i}' for i in n)} from lt join ls using ({IDS}))",
        gram("lg", "lz", [f"z{i}" for i in n], "yc", "1"), eliminate("lg", len(f)),
        f"l0 as (select {IDS}, {', '.join(f'cast({e} as double) as f{i}' for i, e in enumerate(f0))} from p group by {IDS} having count(*) >= 30)",
    ]
    value = dot([f"(f{i} - m{i}) / s{i}" for i in n])
    return ctes, f"select {IDS}, my + {value} as yhat from l0 join ls using ({IDS}) join lg using ({IDS})"
