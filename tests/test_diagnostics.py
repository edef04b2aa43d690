"""Spreads of deciles and review priorities, with ties, nulls and too few rows."""

from pyspark.sql import functions as F

from saltern.operators import diagnostics
from saltern.operators.aggregates import BANDS

SCHEMA = "session long, score double, target double"


def test_parts_and_missing_rows(spark):
    rows = [(1, float(i), i / 10) for i in range(1, 21)] + [(1, None, 9.0), (1, float("nan"), 9.0), (1, 5.0, None)] + [(2, 1.0, 1.0)] * 19
    got = diagnostics.decile_spread(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("mine")), "score", "target").collect()
    (r,) = got  # session 2 has too few
    assert (r.session, r.n) == (1, 20) and abs(r.ic - 1) < 1e-12
    # shares from 0.9 on are places 18 to 20, up to 0.1 places 1 and 2
    assert abs(r.top - 1.9) < 1e-12 and abs(r.bottom - 0.15) < 1e-12 and abs(r.top_minus_bottom - 1.75) < 1e-12 and abs(r.top_excess - 0.85) < 1e-12


def test_ties_leave_parts_empty_and_nothing_gives_nothing(spark):
    tied = spark.createDataFrame([(1, 3.0, float(i)) for i in range(20)], SCHEMA)
    (r,) = diagnostics.decile_spread(tied, "score", "target").collect()
    assert r.ic is None and r.top is None and r.bottom is None and r.top_minus_bottom is None and r.universe == 9.5
    (s,) = diagnostics.spread_summary(diagnostics.decile_spread(tied, "score", "target")).collect()
    assert s.n_sessions == 1 and s.mean_ic is None and s.icir is None and s.positive_share is None
    (e,) = diagnostics.spread_summary(diagnostics.decile_spread(tied.limit(0), "score", "target")).collect()
    assert e.n_sessions == 0 and e.mean_top_excess is None


def test_priorities(spark):
    rows = [(b, a) for b in BANDS for a in (True, False, None)]
    df = spark.createDataFrame(rows, "band string, unclear boolean")
    got = [r[0] for r in df.select(diagnostics.review_priority(F.col("band"), F.col("unclear"), BANDS)).collect()]
    assert got == ["P0_economic_and_identity_risk", "P1_economic_relevance", "P1_economic_relevance", "P1_identity_risk", "P2", "P2", "P1_identity_risk", "P3", "P3"]
