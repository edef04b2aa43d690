"""What a security's returns have to do with those of a market and of sectors, known at the row.

Rows have ``id``, ``session`` and returns; windows count an id's own rows. A value that is null or not finite is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.functions.frames import MOMENTS, flag, many_pair_moments, pair_correlation, percentile_rank, rows_of

KEY, ORDER = "id", "session"


def _beta(name: str, floor: float) -> Column:
    """Sample covariance over the sample variance of all the other's values in the window."""
    variance = F.try_divide(F.col(f"{name}mm_own"), F.col(f"{name}n_own") - 1)
    return F.when(variance > floor, F.try_divide(F.col(f"{name}xm"), F.col(f"{name}n") - 1) / variance)


def _pair_columns(p: DataFrame, pairs: dict[str, tuple], size: int, least: int | dict[str, int], key, floor: float = 1e-15) -> DataFrame:
    """For each pair ``corr_`` and ``beta_`` of its name, null below ``least`` rows (of all pairs, or by name) with both values."""
    least = least if isinstance(least, dict) else dict.fromkeys(pairs, least)
    q = many_pair_moments(p, {f"_k_{n}_": v for n, v in pairs.items()}, size, key, ORDER)
    enough = {n: F.col(f"_k_{n}_n") >= least[n] for n in pairs}
    out = {f"corr_{n}": F.when(enough[n], pair_correlation(f"_k_{n}_")) for n in pairs} | {f"beta_{n}": F.when(enough[n], _beta(f"_k_{n}_", floor)) for n in pairs}
    return q.withColumns(out).drop(*[f"_k_{n}_{k}" for n in pairs for k in MOMENTS])


def lead_lag_relations(p: DataFrame, x: str, m: str, leads=(0, 1, 2, 3, 5), follows=(1, 2, 3, 5), size: int = 120, least: int = 60) -> DataFrame:
    """Trailing correlation and beta of ``x`` with ``m`` some rows ago (``market_leads_k``), and of past ``x`` with ``m`` now (``stock_leads_k``).

    All lags are taken from one ordering of an id's rows and nothing is shuffled between them.
    """
    w = rows_of(KEY, ORDER)
    before = {f"_m{k}": F.lag(m, k).over(w) if k else F.col(m) for k in leads} | {f"_x{k}": F.lag(x, k).over(w) for k in follows}
    pairs = {f"market_leads_{k}": (x, f"_m{k}") for k in leads} | {f"stock_leads_{k}": (f"_x{k}", m) for k in follows}
    return _pair_columns(p.withColumns(before), pairs, size, least, KEY).drop(*before)


def market_response(p: DataFrame, x: str, m: str, spans: dict[str, tuple[str, str]], size: int = 60, least: int = 30) -> DataFrame:
    """``market_beta``: the beta known one row earlier; ``response_gap_`` of each span: what its return has beyond that beta's share.

    ``spans`` maps a name to the columns of the security's and the market's return. The beta is population covariance over
    population variance, over rows with both; both are null below ``least`` such rows or without spread of the market.
    """
    q = many_pair_moments(p, {"_k_": (x, m)}, size, KEY, ORDER)
    beta = F.when((F.col("_k_n") >= least) & (F.col("_k_mm") > 1e-12 * F.col("_k_n")), F.col("_k_xm") / F.col("_k_mm"))
    q = q.withColumn("_beta", beta).withColumn("market_beta", F.lag("_beta").over(rows_of(KEY, ORDER)))
    return q.withColumns({f"response_gap_{n}": F.col(a) - F.col("market_beta") * F.col(b) for n, (a, b) in spans.items()}).drop("_beta", *[f"_k_{k}" for k in MOMENTS])


def sector_context(
    p: DataFrame,
    baskets: DataFrame,
    sectors: list[str],
    horizons=(1, 5, 20, 60),
    short=(120, 60),
    long=(252, 120),
    lags=(1, 2, 3, 5),
    confident: float = 0.2,
    distinct: float = 0.05,
    market: str | None = "market_return",
) -> DataFrame:
    """The sector that each row's security moves with, and how it compares with it: one row for each row of ``p``.

    ``p`` has ``return_h`` for each horizon h and, with ``market``, ``<market>_h``; ``baskets`` has ``session``, ``sector``, ``return_h``,
    unique by session and sector. Windows are (rows, least rows with both values). The sector is that of ``sectors`` with the highest
    correlation over the long window up to the row before, so a row's own move doesn't choose it; ties (to 9 places) take the
    first in alphabetical order. Without a correlation above zero all columns but the keys are null and flags are false.

    Columns: ``sector``, ``corr_short``, ``corr_long``, ``beta_short``, ``beta_long``, ``margin`` (over the second, null without one), ``confident``,
    ``distinct``, ``lead_corr_k`` (with the basket k rows ago), ``gap_short``, ``gap_long`` (return beyond the beta's share), and for each
    horizon ``sector_return_h``, ``over_sector_h``, ``strength_h`` (mean-rank share among the session's baskets), ``sector_over_market_h``.

    Only rows of ``baskets`` in ``sectors`` are broadcast: at most one for each of them and calendar date. A row of ``p`` holds all
    sectors side by side, and all windows come from one ordering by id, so after the panel's own shuffle by id nothing moves.
    """
    names = sorted(sectors)
    ranks = {f"_strength_{h}": percentile_rank(f"return_{h}", ORDER) for h in horizons}
    asked = baskets.where(F.col("sector").isin(names)).select(ORDER, "sector", *[f"return_{h}" for h in horizons]).withColumns(ranks)
    dimension = asked.select(ORDER, F.col("sector").alias("_sector"), *[F.col(f"return_{h}").alias(f"_basket_{h}") for h in horizons], *ranks)
    kept = [f"return_{h}" for h in horizons] + ([f"{market}_{h}" for h in horizons] if market else [])
    x, y = f"return_{horizons[0]}", f"_basket_{horizons[0]}"
    side = dimension.groupBy(ORDER).agg(*[F.max(F.when(F.col("_sector") == s, F.col(y))).alias(f"_y{k}") for k, s in enumerate(names)])
    rows = p.select(KEY, ORDER, *kept).join(F.broadcast(side), ORDER, "left")

    # the windows end at the row before, so what they are of is shifted by a row
    w = rows_of(KEY, ORDER)
    numbers = range(len(names))
    shifted = {"_x": F.lag(x).over(w)} | {f"_y{k}_{j}": F.lag(f"_y{k}", j + 1).over(w) for k in numbers for j in (0, *lags)}
    pairs = {f"long_{k}": ("_x", f"_y{k}_0", long[0]) for k in numbers} | {f"short_{k}": ("_x", f"_y{k}_0", short[0]) for k in numbers}
    pairs |= {f"lead_{j}_{k}": ("_x", f"_y{k}_{j}", short[0]) for k in numbers for j in lags}
    least = {n: long[1] if n.startswith("long") else short[1] for n in pairs}
    q = _pair_columns(rows.withColumns(shifted).drop(*[f"_y{k}" for k in numbers]), pairs, short[0], least, KEY)
    known = {"_corr_short": "corr_short", "_corr_long": "corr_long", "_beta_short": "beta_short", "_beta_long": "beta_long"} | {f"_lead_{j}": f"corr_lead_{j}" for j in lags}

    # an entry for each sector, best first
    entry = lambda k: F.struct(F.round(f"corr_long_{k}", 9).alias("order"), F.lit(-k).alias("place"), F.lit(names[k]).alias("sector"), *[F.col(f"{old}_{k}").alias(new) for new, old in known.items()])
    entries = F.array_compact(F.array(*[F.when(F.col(f"corr_long_{k}").isNotNull(), entry(k)) for k in numbers]))
    found = q.select(KEY, ORDER, *kept, F.sort_array(entries, asc=False).alias("_all"))
    best, second = F.try_element_at("_all", F.lit(1)), F.try_element_at("_all", F.lit(2))
    found = found.withColumns({"_best": F.when(best["_corr_long"] > 0, best), "_second": second["_corr_long"]}).withColumn("_sector", F.col("_best.sector"))
    found = found.join(F.broadcast(dimension), [ORDER, "_sector"], "left")
    margin = F.col("_best._corr_long") - F.col("_second")
    out = {"sector": F.col("_sector")} | {k[1:]: F.col(f"_best.{k}") for k in list(known)[:4]} | {"margin": margin}
    out |= {"confident": flag(F.col("_best._corr_long") >= confident), "distinct": flag(margin >= distinct)}
    out |= {f"lead_corr_{k}": F.col(f"_best._lead_{k}") for k in lags}
    out |= {f"gap_{s}": F.col(x) - F.col(f"_best._beta_{s}") * F.col(y) for s in ("short", "long")}
    for h in horizons:
        r = F.col(f"_basket_{h}")
        out |= {f"sector_return_{h}": r, f"over_sector_{h}": F.col(f"return_{h}") - r, f"strength_{h}": F.col(f"_strength_{h}")}
        out |= {f"sector_over_market_{h}": r - F.col(f"{market}_{h}")} if market else {}
    return found.select(KEY, ORDER, *[c.alias(n) for n, c in out.items()])
