"""Quality rules against the worked sample and edge rows."""


import pytest
from small import rows
from pyspark.sql import functions as F

from civiclake.functions import text
from civiclake.operators import quality

# Ten sample accounts with known errors, and the valid ward codes.
FIELDS = "row int, account_ref string, title string, forename string, surname string, postcode string, ward_code string, band string, start_date string, annual_charge double"
SAMPLE = [
    (1, "CT00012847", "Mr", "James", "Henderson", "NE8 1SR", "E05001086", "C", "2022-04-01", 1456.78),
    (2, "CT00012848", "Mrs", "Sarah", "Thompson", "NE9 5QR", "E05001087", "B", "2023-01-15", 1245.90),
    (3, "CT00012849", "", "Robert", "", "INVALID", "E05009999", "Z", "2025-13-01", -500.00),
    (4, "CT00012850", "Ms", "Fatima", "Al-Rashid", "NE8 4JS", "E05001092", "A", "2024-06-20", 1089.30),
    (5, "", "Dr", "Michael", "Okonkwo", "NE8 2QT", "E05001088", "D", "2021-09-01", 1634.20),
    (6, "CT00012852", "Mr", "David", "Wilson", "NE16 3AP", "E05001098", "E", "2020-04-01", 1998.45),
    (7, "CT00012853", "Mrs", "Linda", None, "DH3 1JT", "E05001080", "B", "2023-04-01", 1245.90),
    (8, "CT00012854", "Mr", "", "Patel", "NE8 1YJ", "E05001091", "A", "2024-03-15", 1089.30),
    (9, "CT00012855", "Miss", "Emma", "Clarke", "NE40 3NE", "E05001094", "F", "2019-04-01", 2340.60),
    (10, "CT00012856", "Mr", "Tomasz", "Kowalski", "NE10 0HB", "E05001085", "C", "2022-11-01", 1456.78),
]
TODAY = "2024-12-31"


@pytest.fixture(scope="module")
def suite(spark):
    wards = spark.range(1080, 1100).select(F.format_string("E0500%d", "id").alias("code"))
    return quality.council_tax_suite(wards, F.lit(TODAY).cast("date"))


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(SAMPLE, FIELDS)


def test_scorecard(suite, sample):
    assert suite.scorecard(sample).first()[:] == (100, 90, 2, 8, 90.0, "pass")


def test_issues(suite, sample):
    got = rows(suite.issues(sample, ["row"]).select("key_row", "rule_id", "severity", "value"))
    assert [(r, i) for r, i, _, _ in got] == [
        (3, "R003"), (3, "R005"), (3, "R006"), (3, "R007"), (3, "R008"), (3, "R009"), (3, "R010"), (5, "R001"),
        (7, "R003"), (8, "R004")]
    shown = {(r, i): (s, v) for r, i, s, v in got}
    assert shown[(3, "R010")] == ("warn", "(empty)") and shown[(7, "R003")] == ("fail", "(null)")
    assert shown[(3, "R009")] == ("fail", "-500.0")


def test_by_rule_results_and_split(suite, sample):
    per_rule = {r["rule_id"]: (r["passed"], r["failed"]) for r in suite.by_rule(sample).collect()}
    assert per_rule["R003"] == (8, 2) and per_rule["R002"] == (10, 0)
    assert suite.results(sample, ["row"]).count() == 100
    clean, held = suite.split(sample)
    assert [r[0] for r in rows(held.select("row"))] == [3, 5, 7]
    assert clean.columns == sample.columns and clean.count() == 7


def test_gate(suite, sample):
    assert suite.gate(sample, 90.0) is sample
    with pytest.raises(quality.QualityGateError):
        suite.gate(sample, 90.1)


def test_empty_table_has_no_score(suite, sample):
    card = suite.scorecard(sample.where("false")).first()
    assert (card["total_checks"], card["score"], card["band"]) == (0, None, None)
    assert suite.gate(sample.where("false"), 99) is not None


def test_edge_rows(spark, suite):
    base = ("CT00000001", "Mr", "A", "B", "NE8 1SR", "E05001080", "A", "2020-01-01", 1.0)
    names = FIELDS.replace("row int, ", "").replace(" string", "").replace(" double", "").split(", ")

    def row(i, **change):
        return (i, *[change.get(n, v) for n, v in zip(names, base)])

    df = spark.createDataFrame([
        (0, *[None] * 9), (1, *[""] * 8, None), row(2, annual_charge=float("nan")), row(3, postcode="ne8 1sr"),
        row(4, account_ref="CT00000001\n"), row(5, start_date="2030-01-01"), row(6, start_date="2023-02-30"),
    ], FIELDS)
    broken = {}
    for r, i in rows(suite.issues(df, ["row"]).select("key_row", "rule_id")):
        broken.setdefault(r, []).append(i)
    missing = ["R001", "R003", "R004", "R006", "R007", "R008", "R009", "R010"]
    assert broken == {0: missing, 1: missing, 2: ["R009"], 4: ["R002"], 5: ["R008"], 6: ["R008"]}


def test_one_pass_plan(suite, sample):
    plan = suite.by_rule(sample)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 2  # the rules, and the distinct ward codes


def test_column_tests(spark):
    df = spark.createDataFrame([("a", "NE8 1SR", 3), ("a", "NE81SR", 11), (None, None, None)], "k string, p string, n int")
    report = quality.test_report(
        df, {"nn": quality.not_null("k"), "rx": quality.not_matching("p", text.POSTCODE_ONE_SPACE), "bt": quality.outside("n", 0, 10)},
        {"uq": quality.duplicates(df, "k"), "fk": quality.orphans(df, "k", df.where("k is null"), "k")})
    assert rows(report) == [("bt", 1, "FAIL"), ("fk", 2, "FAIL"), ("nn", 1, "FAIL"), ("rx", 1, "FAIL"), ("uq", 1, "FAIL")]


def test_schema_drift_and_declared_types(spark):
    df = spark.createDataFrame([("abc", "2024-01-01", "1.5")], "a string, d string, x string")
    assert quality.schema_drift({"a": "string", "d": "date", "z": "int"}, df) == [
        ("a", "string", "string", "ok"), ("d", "date", "string", "type_changed"), ("z", "int", None, "missing"),
        ("x", None, "string", "unexpected")]
    got = df.select(quality.conforms("a", "VARCHAR(2)"), quality.conforms("d", "DATE"), quality.conforms("x", "DECIMAL(6,2)"),
                    quality.conforms("a", "INT"), quality.conforms("a", "CHAR(3)")).first()
    assert got[:] == (False, True, True, False, True)
