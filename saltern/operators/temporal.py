"""Joins over time: as-of, validity interval, nearest bracket, event windows, session lookup, adjustment factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, attrs: list[str], prefix: str = "") -> DataFrame:
    """The right row of the same key with the latest ``at`` not after the left row's; null attributes if none.

    One union and one window over the key: both sides shuffle once, and no pairs are made. Right rows must be unique by
    (key, at). A null key meets nothing.
    """
    packed = F.struct(F.col(at).alias("_right_at"), *attrs)
    a = left.withColumns({"_side": F.lit(1), "_right": F.lit(None).cast(right.select(packed).schema[0].dataType)})
    b = right.select(F.col(key), F.col(at), F.lit(0).alias("_side"), packed.alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.when(F.col(key).isNotNull(), F.last("_right", ignorenulls=True).over(w))).where("_side = 1")
    names = {f"{prefix}{c}": F.col("_found")[c] for c in attrs} | {f"{prefix}at": F.col("_found")["_right_at"]}
    return found.withColumns(names).drop("_side", "_right", "_found")


#: Rows of a dimension cut into months up to which it is broadcast; larger ones meet by a shuffle on the month.
MOST_BROADCAST = 1 << 18


def _month(x) -> Column:
    return F.year(x) * 12 + F.month(x)


def _period_join(left: DataFrame, periods: DataFrame, at: str, low: str, high: str, on: Column) -> DataFrame:
    """Left join of each row to the period around it, by equality on months and ``on`` within one.

    ``low`` and ``high`` are the periods' ends, null where open. Periods enter each month they touch, and months beyond
    all ends count as the outermost one, so an open period is as short as the others.
    """
    ends = F.array(_month(low), _month(high))
    first, last = periods.agg(F.min(F.array_min(ends)), F.max(F.array_max(ends))).first()
    edge = lambda c, other: F.coalesce(_month(c), F.lit(other).cast("int"))
    cut = periods.withColumn("_month", F.explode(F.sequence(edge(low, first), edge(high, last))))
    if cut.select("_month").limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        cut = F.broadcast(cut)
    clamped = F.greatest(F.least(_month(at), F.lit(last).cast("int")), F.lit(first).cast("int"))
    return left.withColumn("_of", clamped).join(cut, (F.col("_of") == F.col("_month")) & on, "left").drop("_of", "_month")


def interval_join(left: DataFrame, periods: DataFrame, at: str, start: str, until: str) -> DataFrame:
    """The period with start <= at < until (a null until is open); periods must not overlap, empty ones meet nothing."""
    on = (F.col(at) >= F.col(start)) & (F.col(until).isNull() | (F.col(at) < F.col(until)))
    sound = periods.where(F.col(start).isNotNull() & (F.col(until).isNull() | (F.col(start) < F.col(until))))
    return _period_join(left, sound, at, start, until, on)


def bracket_join(events: DataFrame, rows: DataFrame, symbol: str, days: int = 7) -> DataFrame:
    """Each event's id from rows of its symbol: on its day, else where the nearest days on both sides agree.

    ``events``: event, symbol, date. ``rows``: symbol, date, id. The rows become one a symbol and day, which says to each
    day around it what it has; events then meet what is known of their own day by equality, so no event meets more than one row.
    Every event has a row of its own, also where its symbol or date is null or its number repeats.
    """
    whole = rows.dropna(subset=[symbol, "date", "id"])
    by_day = whole.groupBy(F.col(symbol).alias("_s"), F.col("date").alias("_d")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    told = by_day.select("_s", "_d", "n", "id", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("off")).withColumn("_d", F.date_sub("_d", F.col("off")))
    pick = lambda cond, f: f(F.when(cond, F.struct("off", "n", "id")))
    sides = told.groupBy("_s", "_d").agg(pick(F.col("off") == 0, F.max).alias("e"), pick(F.col("off") < 0, F.max).alias("l"), pick(F.col("off") > 0, F.min).alias("r"))
    s = events.join(sides, (F.col(symbol) == F.col("_s")) & (F.col("date") == F.col("_d")), "left")
    e, left, right = F.col("e"), F.col("l"), F.col("r")
    # the search goes outwards, the left day before the right one, and stops where a side is ambiguous
    left_first = -left["off"] <= right["off"]
    status = (
        F.when(e["n"] == 1, "mapped")
        .when(e["n"] > 1, "ambiguous_exact")
        .when((left["n"] > 1) & (right.isNull() | F.coalesce(left_first, F.lit(True)) | (right["n"] == 1)), "ambiguous_left")
        .when(right["n"] > 1, "ambiguous_right")
        .when(left.isNull() | right.isNull(), "unmapped")
        .when(left["id"] == right["id"], "mapped_bracket")
        .otherwise("conflicting_bracket")
    )
    return s.select("event", status.alias("status"), F.when(status == "mapped", e["id"]).when(status == "mapped_bracket", left["id"]).alias("id"))


def event_windows(rows: DataFrame, events: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """``rows`` with ``in_window``: an event of the key lies from ``before`` sessions ahead to ``after`` behind.

    Events are expanded to the sessions they touch, which is a fixed number for each, and met by equality.
    """
    touched = events.select(key, F.explode(F.sequence(F.col("session") - before, F.col("session") + after)).alias("session")).distinct().withColumn("_hit", F.lit(True))
    return rows.join(touched, [key, "session"], "left").withColumn("in_window", F.coalesce("_hit", F.lit(False))).drop("_hit")


def session_lookup(days: DataFrame, sessions: DataFrame, at: str) -> DataFrame:
    """The first session on or after each day; sessions are a dimension (date, session)."""
    ends = sessions.select(F.lag("date").over(Window.orderBy("date")).alias("_after"), F.col("date").alias("_until"), "session")
    on = (F.col(at) <= F.col("_until")) & (F.col("_after").isNull() | (F.col(at) > F.col("_after")))
    return _period_join(days, ends, at, "_after", "_until", on).drop("_after", "_until")


def adjustment_factor(rows: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``factor``: the product of the multipliers of later events (strictly after the row's date).

    A union and a running sum of logarithms from the last date back; one shuffle by key and no pairs.
    """
    ev = events.groupBy(key, F.col("ex_date").alias("date")).agg(F.sum(F.ln("multiplier")).alias("_log"))
    both = rows.withColumns({"_log": F.lit(0.0), "_row": F.lit(True)}).unionByName(ev.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    later = Window.partitionBy(key).orderBy(F.col("date").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(key, "date")
    total = F.sum("_log").over(later) - F.sum("_log").over(own)
    return both.withColumn("factor", F.exp(total)).where("_row").drop("_log", "_row")


def collapse_events(events: DataFrame, key: str = "id") -> DataFrame:
    """One event for each key and date: the product of distinct multipliers, and how many there were."""
    one = events.select(key, "ex_date", "multiplier").distinct()
    return one.groupBy(key, "ex_date").agg(F.exp(F.sum(F.ln("multiplier"))).alias("multiplier"), F.count("*").alias("n_events"))


def episodes(rows: DataFrame, key: str, date: str, gap: int) -> DataFrame:
    """Number the islands of each key's dates that gaps of more than ``gap`` days part."""
    w = Window.partitionBy(key).orderBy(date)
    new = F.coalesce(F.datediff(date, F.lag(date).over(w)) > gap, F.lit(False)).cast("int")
    return rows.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w)).drop("_new")


def identity_fill(rows: DataFrame, key: list[str], date: str, anchor: str) -> DataFrame:
    """Within each episode: a lone anchor fills all rows; else agreeing neighbours fill, and disagreeing ones don't."""
    w = Window.partitionBy(*key).orderBy(date)
    left = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(anchor, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    n = F.size(F.collect_set(anchor).over(Window.partitionBy(*key)))
    q = rows.withColumns({"_l": left, "_r": right, "_n": n})
    only = F.coalesce("_l", "_r")
    filled = F.when(F.col("_n") == 0, None).when(F.col("_n") == 1, only).when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull(), F.col("_l")).when(F.col("_l") == F.col("_r"), F.col("_l"))
    how = (
        F.when(F.col(anchor).isNotNull(), "own")
        .when(filled.isNull(), "unresolved")
        .when(F.col("_l").isNull(), "backfill")
        .when(F.col("_r").isNull(), "forward_fill")
        .otherwise("between")
    )
    return q.withColumns({"filled": filled, "method": how}).drop("_l", "_r", "_n")


#: How a row got its identity, and how sure that is.
CONFIDENCE = {
    "exact_isin": 1.0,
    "bridge_single_isin_episode": 0.99,
    "backward_single_isin_episode": 0.98,
    "forward_single_isin_episode": 0.98,
    "bridge_matching_anchors_multi_isin_episode": 0.95,
    "backward_first_anchor_multi_isin_episode": 0.85,
    "forward_last_anchor_multi_isin_episode": 0.85,
    "unresolved_between_isin_change": 0.0,
    "unresolved_no_anchor": 0.0,
}


def identity_resolution(rows: DataFrame, key: list[str], date: str, anchor: str) -> DataFrame:
    """``rows`` with resolved, method, confidence, the dates of the nearest anchors and of the episode's ends.

    An episode (``key``) with one identity gives it to all its rows; with several, a row takes its nearest anchors' where
    both agree, or the only one's at an end, and stays unresolved in a change. Columns added: resolved, method, confidence,
    anchor_before, anchor_after (dates, the row's own included), episode_start, episode_end. Rows of a date in an episode
    are taken in no order of their own; both neighbours come from running windows, one each way.
    """
    whole = Window.partitionBy(*key)
    run = lambda order: whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col(anchor).isNotNull(), F.struct(F.col(anchor).alias("a"), F.col(date).alias("d")))
    q = rows.withColumn("_r", F.last(place, ignorenulls=True).over(run(F.col(date).desc())))
    q = q.withColumn("_l", F.last(place, ignorenulls=True).over(run(F.col(date).asc())))
    q = q.withColumns({"_least": F.min(anchor).over(whole), "_most": F.max(anchor).over(whole), "episode_start": F.min(date).over(whole), "episode_end": F.max(date).over(whole)})
    left, right, one = F.col("_l"), F.col("_r"), F.col("_least") == F.col("_most")
    single = lambda a, b: F.when(one, a).otherwise(b)
    method = (
        F.when(F.col(anchor).isNotNull(), "exact_isin")
        .when(F.col("_least").isNull(), "unresolved_no_anchor")
        .when(left.isNull(), single("backward_single_isin_episode", "backward_first_anchor_multi_isin_episode"))
        .when(right.isNull(), single("forward_single_isin_episode", "forward_last_anchor_multi_isin_episode"))
        .when(left["a"] == right["a"], single("bridge_single_isin_episode", "bridge_matching_anchors_multi_isin_episode"))
        .otherwise("unresolved_between_isin_change")
    )
    sure = F.lit(0.0)
    for name, share in CONFIDENCE.items():
        sure = F.when(F.col("method") == name, share).otherwise(sure)
    q = q.withColumn("method", method).withColumn("confidence", sure)
    found = F.when(F.col("confidence") > 0, F.coalesce(F.col(anchor), left["a"], right["a"]))
    return q.withColumns({"resolved": found, "anchor_before": left["d"], "anchor_after": right["d"]}).drop("_l", "_r", "_least", "_most")


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have one value alone; rows with a null in either don't count."""
    one = rows.dropna(subset=[key, value]).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most"))
    return one.where(F.col(value) == F.col("_most")).drop("_most")
