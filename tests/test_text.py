"""Text, postcode and banding expressions."""

import pytest
from small import rows
from pyspark.sql import functions as F

from civiclake.functions import text
from civiclake.functions.measures import Measures, arrears_band, divide, rows as n_rows, score_band, share, sla_days


def test_postcodes(spark):
    df = spark.createDataFrame([("ne81sr",), (" NE8  1SR",), ("DH3 1JT",), ("NE163AP",), ("AB",), (None,)], "p string")
    got = [tuple(r) for r in df.select(
        text.postcode_clean("p"), text.postcode_formatted("p"), text.postcode_area("p"),
        text.postcode_formatted("p", always=True)).collect()]
    assert got == [
        ("NE81SR", "NE8 1SR", "NE8", "NE8 1SR"), ("NE81SR", "NE8 1SR", "NE8", "NE8 1SR"),
        ("DH31JT", "DH3 1JT", "DH3", "DH3 1JT"), ("NE163AP", "NE16 3AP", "NE16", "NE16 3AP"),
        ("AB", "AB", "AB", " AB"), (None, None, None, None)]


def test_spaces_only_keeps_tabs(spark):
    df = spark.createDataFrame([("NE8\t1SR",)], "p string")
    assert df.select(text.postcode_clean("p"), text.postcode_clean("p", spaces_only=True)).first()[:] == ("NE81SR", "NE8\t1SR")


@pytest.mark.parametrize("value,loose,upper,spaced", [
    ("ne8 1sr", True, False, False), ("NE8 1SR", True, True, True), ("NE81SR", True, True, False),
    ("NE8  1SR", True, True, False), ("NE8 1SR\n", False, False, False), (None, False, False, False)])
def test_patterns(spark, value, loose, upper, spaced):
    df = spark.createDataFrame([(value,)], "p string")
    got = df.select(*[text.matches("p", p) for p in (text.POSTCODE_LOOSE, text.POSTCODE_UPPER, text.POSTCODE_ONE_SPACE)]).first()
    assert got[:] == (loose, upper, spaced)


def test_soundex_uses_the_last_word(spark):
    df = spark.createDataFrame([("James Henderson", "Hendersen"), ("Ann Lee", "Bell"), (None, "Bell")], "n string, s string")
    assert rows(df.select("s", text.sounds_like("n", "s"), text.sounds_like("n", "s", whole_name=True))) == [
        ("Bell", False, False), ("Bell", False, False), ("Hendersen", True, False)]


def test_numbers_and_headers(spark):
    df = spark.createDataFrame([("12",), ("3.5",), ("-4",), ("7.",), ("",), ("1e3",), (None,)], "c string")
    assert [r[0] for r in df.select(text.numeric_cell("c")).collect()] == [12.0, 3.5, None, 7.0, None, None, None]
    assert text.header_name("  Account  Ref ") == "account_ref"


def test_arrears(spark):
    df = spark.createDataFrame([(0.0,), (-5.0,), (200.0,), (200.01,), (1000.0,), (1000.5,), (None,)], "b double")
    assert [r[0] for r in df.select(arrears_band("b")).collect()] == [
        "No Arrears", "Low Risk", "Low Risk", "Medium Risk", "High Risk", "Critical", "No Arrears"]
    assert df.select(arrears_band("b", credit_band=True)).collect()[1][0] == "In Credit"


def test_division_and_bands(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(divide(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]
    scores = spark.createDataFrame([(35.0,), (35.1,), (20.0,)], "s double")
    assert [r[0] for r in scores.select(score_band("s", 35, 20, inclusive=False)).collect()] == ["medium", "high", "low"]


def test_sla_and_measures(spark):
    df = spark.createDataFrame([("Emergency",), ("Urgent",), ("Routine",), ("Other",), (None,)], "p string")
    assert [r[0] for r in df.select(sla_days("p")).collect()] == [1, 5, 28, 28, 28]
    m = Measures().add("n", n_rows()).add("urgent", share(F.col("p") == "Urgent"))
    m.add("double_n", m["n"] * 2)
    assert m.evaluate(df).first()[:] == (5, 0.2, 10)
    assert m.evaluate(df.where("false")).first()[:] == (0, 0.0, 0)
