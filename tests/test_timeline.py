"""Series figures against the worked service-demand example."""

import datetime as dt

import pytest
from small import rows
from pyspark.sql import functions as F

from civiclake.functions.measures import score_band
from civiclake.operators import timeline
from civiclake.operators.ranking import numbered

# Monthly requests of six departments, deprivation scores, budgets in thousands.
SERVICE = {
    "Council Tax": [1820, 1640, 1510, 1390, 1450, 1280, 1170, 1260, 1580, 1740, 1890, 2140],
    "Housing": [890, 920, 870, 810, 850, 780, 920, 980, 1020, 970, 910, 830],
    "Waste Collection": [640, 580, 620, 710, 850, 940, 1080, 1020, 870, 720, 650, 590],
    "Social Care": [420, 440, 410, 430, 450, 470, 460, 480, 510, 530, 490, 470],
    "Education": [310, 340, 280, 260, 190, 120, 90, 140, 380, 350, 320, 290],
    "Planning": [180, 210, 240, 260, 290, 310, 280, 270, 250, 230, 200, 190],
}


@pytest.fixture(scope="module")
def series(spark):
    wide = spark.createDataFrame(list(SERVICE.items()), "department string, counts array<int>")
    return wide.select("department", F.posexplode("counts").alias("month_idx", "requests"))


def totals(series):
    return series.groupBy("month_idx").agg(F.sum("requests").alias("requests"))


def test_totals(series):
    assert [r["requests"] for r in totals(series).orderBy("month_idx").collect()] == [4260, 4130, 3930, 3860, 4080, 3900, 4000, 4150, 4610, 4540, 4460, 4510]
    assert series.agg(F.sum("requests")).first()[0] == 50430


@pytest.mark.parametrize("periods,slope,intercept,ahead", [
    (12, 49.1259, 3932.3077, [4521.82, 4570.94, 4620.07]), (6, 97.4286, 4134.7619, [4719.33, 4816.76, 4914.19]),
    (3, -15.0, 4518.3333, [4473.33, 4458.33, 4443.33])])
def test_forecast_over_slices(series, periods, slope, intercept, ahead):
    placed = timeline.last_periods(totals(series), periods)
    line = timeline.trend(placed, "requests").first()
    assert (round(line["slope"], 4), round(line["intercept"], 4)) == (slope, intercept)
    got = timeline.forecast(placed, "requests", 3).orderBy("step").collect()
    assert [round(r["forecast"], 2) for r in got] == ahead
    assert [r["pos"] for r in got] == [periods, periods + 1, periods + 2]


def test_department_trends_and_slices(series):
    lines = {r["department"]: (round(r["slope"], 4), round(r["intercept"], 4))
             for r in timeline.trend(timeline.last_periods(series, None), "requests", ["department"]).collect()}
    assert lines["Council Tax"] == (26.7483, 1425.3846) and lines["Planning"] == (-0.6643, 246.1538)
    last6 = dict(rows(timeline.last_periods(series, 6).groupBy("department").agg(F.sum("requests"))))
    assert last6 == {"Council Tax": 9780, "Housing": 5630, "Waste Collection": 4930, "Social Care": 2940, "Education": 1570, "Planning": 1420}


def test_single_point_has_no_forecast(series):
    one = timeline.last_periods(totals(series), 1)
    assert [r["forecast"] for r in timeline.forecast(one, "requests", 2).collect()] == [None, None]


def test_rolling_skips_gap_months(spark):
    df = spark.createDataFrame([(0, 10), (1, 20), (4, 40)], "month_idx int, n int")
    got = {r["month_idx"]: r["n_avg_3m"] for r in timeline.rolling_months(df, "n").collect()}
    assert got == {0: 10.0, 1: 15.0, 4: 40.0}


def test_rolling_by_days_touches_four_months_at_a_month_end(spark):
    days = [dt.date(2023, m, 15) for m in range(8, 12)] + [dt.date(2023, 9, 30), dt.date(2023, 12, 31)]
    df = spark.createDataFrame([(d, 6) for d in days], "day date, n int")
    got = dict(rows(timeline.rolling_month_days(df, "n", 3)))
    # 30 September falls inside [30 Sep (clamped), 31 Dec]: four months, four rows.
    assert got[dt.date(2023, 12, 31)] == 6.0 * 4 / 4


def test_rolling_days_and_to_date(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 1, 2), (dt.date(2024, 1, 30), 1, 1), (dt.date(2024, 1, 31), 0, 1), (dt.date(2024, 3, 1), 0, 0)],
        "day date, met int, n int")
    got = {r["day"]: r["r"] for r in timeline.rolling_days(df, "met", "n", 30, "r").collect()}
    assert got[dt.date(2024, 1, 30)] == 2 / 3 and got[dt.date(2024, 1, 31)] == 0.5 and got[dt.date(2024, 3, 1)] == 0.0
    mtd = {r["day"]: r["n_mtd"] for r in timeline.to_date(df, "n", "month").collect()}
    assert mtd[dt.date(2024, 1, 31)] == 4 and mtd[dt.date(2024, 3, 1)] == 0
    ytd = {r["day"]: r["n_ytd"] for r in timeline.to_date(df, "n", "year").collect()}
    assert ytd[dt.date(2024, 3, 1)] == 4


def test_year_on_year_without_a_prior_year_is_zero(spark):
    df = spark.createDataFrame([(0, 10), (12, 15)], "month_idx int, n int")
    got = {r["month_idx"]: r["g"] for r in timeline.year_on_year(df, "n", "month_idx", 12, "g").collect()}
    assert got == {0: 0.0, 12: 0.5}


def test_backlog(spark):
    df = spark.createDataFrame(
        [("x", dt.date(2024, 1, 5), dt.date(2024, 3, 1)), ("x", dt.date(2024, 1, 9), None), ("x", dt.date(2024, 4, 1), dt.date(2024, 4, 2))],
        "c string, o date, d date")
    got = [(r["month_idx"] % 12, r["open_at_month_end"]) for r in timeline.backlog(df, "o", "d", ["c"]).orderBy("month_idx").collect()]
    assert got == [(0, 2), (1, 2), (2, 1), (3, 1)]


def test_top_wards_and_bands(spark):
    # Deprivation scores.
    scores = {
        "Birtley": 24.3, "Blaydon": 18.7, "Bridges": 38.2,
        "Chopwell & Rowlands Gill": 26.1, "Chowdene": 15.4,
        "Deckham": 42.8, "Dunston & Teams": 39.5, "Felling": 44.1,
        "High Fell": 36.9, "Lamesley": 12.3,
        "Lobley Hill & Bensham": 34.6, "Low Fell": 14.8,
        "Pelaw & Heworth": 31.2, "Saltwell": 41.7,
        "Whickham North": 9.8, "Whickham South": 8.2,
        "Windy Nook & Whitehills": 28.4, "Winlaton & High Spen": 22.9,
        "Ryton": 13.5, "Crawcrook & Greenside": 11.1,
    }
    df = spark.createDataFrame(list(scores.items()), "ward string, s double")
    top = df.orderBy(F.col("s").desc(), "ward").limit(12)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in top.select(score_band("s", 35, 20, inclusive=False)).collect()] == ["high"] * 6 + ["medium"] * 6


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 613).alias("v")).repartition(6)
    order = [F.col("v").desc(), F.col("id")]
    ranked = numbered(df, order)
    want = sorted(((k * 7919 % 613, k) for k in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [(r["v"], r["id"]) for r in ranked.orderBy("rank").collect()] == want
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 5001))
    assert numbered(df.limit(0), order).count() == 0
