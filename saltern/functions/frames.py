"""Column building blocks: exact-session lags, guarded rolling aggregates, mean ranks, islands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and once: in ``spark.checkpoint.dir`` if there is one, else in the executors' own stores."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def rows_of(key: str | list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(key, order, size: int) -> WindowSpec:
    return rows_of(key, order).rowsBetween(-(size - 1), 0)


def ratio(a, b, least: float = 0.0) -> Column:
    """a / b where b exceeds ``least`` in size, else null."""
    return F.when(F.abs(col(b)) > least, col(a) / col(b))


def exact_lag(x, k: int, index: str, w: WindowSpec) -> Column:
    """``x`` k sessions ago, null unless all sessions in between are present (rows are unique by session)."""
    return F.when(F.lag(index, k).over(w) == F.col(index) - k, F.lag(col(x), k).over(w))


def exact_lead(x, k: int, index: str, w: WindowSpec) -> Column:
    return F.when(F.lead(index, k).over(w) == F.col(index) + k, F.lead(col(x), k).over(w))


def rolling(agg, x, size: int, least: int, key, order) -> Column:
    """``agg(x)`` over the last ``size`` rows, null if fewer than ``least`` of them have a value."""
    w = last_rows(key, order, size)
    return F.when(F.count(col(x)).over(w) >= least, agg(col(x)).over(w))


MOMENTS = ("n", "xx", "mm", "xm", "n_own", "mm_own", "ax", "am")


def pair_moments(p: DataFrame, x: str, m: str, size: int, key, order, name: str) -> DataFrame:
    """``many_pair_moments`` of one pair."""
    return many_pair_moments(p, {name: (x, m)}, size, key, order)


def many_pair_moments(p: DataFrame, pairs: dict[str, tuple], size: int, key, order) -> DataFrame:
    """Over the last ``size`` rows: how many have both values of a pair, and the sums of products of their deviations.

    For each pair (x, m), or (x, m, its own size), columns of its name and n, xx, mm, xm, ax, am (means) of the rows with both,
    and n_own, mm_own of all values of m. One ordering serves all pairs; each task then goes through its rows in Arrow batches
    and keeps the last rows of the batch before. Moments of 1, 2, 4, ... rows are merged with those as many rows earlier, so
    a row costs the logarithm of the window and a value that has left it leaves no trace. What rounding leaves of a
    constant's deviations counts as zero. A value that is null or not finite is missing.
    """
    spans = {n: v[2] if len(v) > 2 else size for n, v in pairs.items()}
    used = list(dict.fromkeys(c for v in pairs.values() for c in v[:2]))
    place = {c: k for k, c in enumerate(used)}
    groups = [(s, [n for n in pairs if spans[n] == s]) for s in dict.fromkeys(spans.values())]
    sides = {s: ([place[pairs[n][0]] for n in names], [place[pairs[n][1]] for n in names]) for s, names in groups}
    columns, kept = p.columns, max(spans.values()) - 1
    q = p.withColumns({f"_v{k}": F.col(c).cast("double") for k, c in enumerate(used)} | {"_at": F.row_number().over(rows_of(key, order))})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema), *(f"`{n}{k}` double" for _, names in groups for n in names for k in MOMENTS)])

    def moments(batches):
        old, old_at = np.empty((len(used), 0)), np.empty(0, np.int64)
        for b in batches:
            at = np.concatenate([old_at, b["_at"].to_numpy().astype(np.int64)])
            if np.any((at[1:] != at[:-1] + 1) & (at[1:] != 1)) or (not len(old_at) and np.any(at[:1] != 1)):
                raise ValueError("rows don't come in their order")
            now = np.array([b[f"_v{k}"].to_numpy(zero_copy_only=False) for k in range(len(used))], float)
            values = np.concatenate([old, now], axis=1)
            new = len(old_at)
            out = [b[c] for c in columns]
            for s, names in groups:
                found = _trailing(values[sides[s][0]], values[sides[s][1]], at, s)
                out += [pa.array(found[k][i, new:]) for i in range(len(names)) for k in MOMENTS]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *(f"{n}{k}" for _, names in groups for n in names for k in MOMENTS)])
            old, old_at = values[:, max(values.shape[1] - kept, 0) :], at[max(len(at) - kept, 0) :]

    return q.mapInArrow(moments, schema)


def _trailing(x: np.ndarray, m: np.ndarray, at: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The moments of the last ``size`` rows of each pair (a line of ``x`` and ``m``); ``at`` numbers a key's rows from 1."""
    with np.errstate(all="ignore"):
        own = np.isfinite(m)
        both = own & np.isfinite(x)
        zero = np.zeros_like(x)
        some = {"n": both * 1.0, "ax": np.where(both, x, 0.0), "am": np.where(both, m, 0.0), "xx": zero, "mm": zero, "xm": zero, "n_own": own * 1.0, "a_own": np.where(own, m, 0.0), "mm_own": zero}
        found, length, done = None, 1, 0
        while True:
            if size & length:
                found = some if found is None else _merged(found, some, at, done)
                done += length
            if done == size:
                break
            some = _merged(some, some, at, length)
            length *= 2
        for k, n, a in (("xx", "n", "ax"), ("mm", "n", "am"), ("mm_own", "n_own", "a_own")):
            found[k] = np.where(found[k] > 1e-26 * found[n] * found[a] * found[a], found[k], 0.0)
    return found


def _merged(late: dict[str, np.ndarray], early: dict[str, np.ndarray], at: np.ndarray, back: int) -> dict[str, np.ndarray]:
    """``late`` together with what ``early`` is ``back`` rows before, where the key has such a row."""
    there = at[back:] > back
    if not there.any():
        return dict(late)
    one = {k: v[:, back:] for k, v in late.items()}
    two = {k: np.where(there, v[:, : v.shape[1] - back], 0.0) for k, v in early.items()}
    out = {k: v.copy() for k, v in late.items()}
    for n, means, sums in (("n", ("ax", "am"), (("xx", "ax", "ax"), ("mm", "am", "am"), ("xm", "ax", "am"))), ("n_own", ("a_own",), (("mm_own", "a_own", "a_own"),))):
        total = one[n] + two[n]
        share = np.where(total > 0, two[n] / total, 0.0)
        apart = {a: np.where((one[n] > 0) & (two[n] > 0), two[a] - one[a], 0.0) for a in means}
        for a in means:
            out[a][:, back:] = np.where(one[n] > 0, one[a], two[a]) + apart[a] * share
        for k, a, b in sums:
            out[k][:, back:] = one[k] + two[k] + apart[a] * apart[b] * (one[n] * share)
        out[n][:, back:] = total
    return out


def pair_correlation(name: str) -> Column:
    """The correlation of ``pair_moments``; null where a side is constant."""
    return F.try_divide(F.col(f"{name}xm"), F.sqrt(F.col(f"{name}xx")) * F.sqrt(F.col(f"{name}mm")))


def correlation(a, b) -> Column:
    """An aggregate; null where a side is constant, also under ANSI rules, where the built-in fails on a division."""
    return F.try_divide(F.covar_pop(col(a), col(b)), F.sqrt(F.var_pop(col(a))) * F.sqrt(F.var_pop(col(b))))


def median(x) -> Column:
    """A median that can be framed, unlike the built-in of that name."""
    return F.percentile(col(x), F.lit(0.5))


def mean_rank(x, within, descending: bool = False) -> Column:
    """Rank among non-null values; ties share the mean of their places."""
    x = col(x)
    within = [within] if isinstance(within, str) else list(within)
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    place = F.rank().over(Window.partitionBy(*within).orderBy(order))
    ties = F.count(x).over(Window.partitionBy(*within, x))
    return F.when(x.isNotNull(), place + (ties - 1) / 2)


def percentile_rank(x, within, descending: bool = False) -> Column:
    """Mean rank over the number of non-null values, in (0, 1]."""
    within = [within] if isinstance(within, str) else list(within)
    return mean_rank(x, within, descending) / F.count(col(x)).over(Window.partitionBy(*within))


def flag(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))
