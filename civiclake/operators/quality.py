"""Declarative data-quality rules, evaluated for all rules in one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.functions import text
from civiclake.functions.measures import score_band

FAIL, WARN = "fail", "warn"


class QualityGateError(RuntimeError):
    """Raised when a table scores below the threshold of its gate."""


@dataclass(frozen=True)
class Rule:
    """``check`` maps the field's column to a two-valued pass expression.

    A rule with a ``reference`` passes when the value occurs in that single-column
    DataFrame; ``check`` is then not used.
    """

    id: str
    name: str
    field: str
    severity: str
    check: Callable[[Column], Column] | None = None
    reference: DataFrame | None = field(default=None, compare=False)
    description: str = ""


@dataclass(frozen=True)
class Suite:
    rules: tuple[Rule, ...]

    def _checked(self, df: DataFrame) -> DataFrame:
        """``df`` plus one boolean ``_ok_<id>`` column per rule."""
        flags: dict[str, Column] = {}
        for rule in self.rules:
            flag = f"_ok_{rule.id}"
            if rule.reference is None:
                flags[flag] = F.coalesce(rule.check(F.col(rule.field)), F.lit(False))
                continue
            # A plain join: Spark broadcasts the code list when it is small and
            # splits a hot code when it is not. Codes are distinct, so no row multiplies.
            codes = rule.reference.toDF(rule.field).distinct().withColumn(flag, F.lit(True))
            df = df.join(codes, rule.field, "left")
            flags[flag] = F.col(flag).isNotNull()
        return df.withColumns(flags)

    def _ok(self, rule: Rule) -> Column:
        return F.col(f"_ok_{rule.id}")

    def _counts(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        passes = [F.count_if(self._ok(r)).alias(f"_pass_{r.id}") for r in self.rules]
        return self._checked(df).groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *passes)

    def scorecard(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Checks, passes, warnings, failures, score and band; one row, or one per group."""

        def total(values: list[Column]) -> Column:
            return reduce(lambda a, b: a + b, values, F.lit(0).cast("long"))

        def missed(severity: str) -> Column:
            return total([F.col("_rows") - F.col(f"_pass_{r.id}") for r in self.rules if r.severity == severity])

        passed = total([F.col(f"_pass_{r.id}") for r in self.rules])
        checks = F.col("_rows") * len(self.rules)
        score = F.round(F.try_divide(passed, checks) * 100, 1)
        return self._counts(df, by).select(
            *by, checks.alias("total_checks"), passed.alias("passed"), missed(WARN).alias("warnings"),
            missed(FAIL).alias("failures"), score.alias("score"),
            score_band(score, 90, 70, labels=("pass", "warn", "fail")).alias("band"),
        )

    def by_rule(self, df: DataFrame) -> DataFrame:
        """Passed and failed rows per rule, from the same single aggregation."""
        entries = [
            F.struct(
                F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.field).alias("field"),
                F.lit(r.severity).alias("severity"), F.col(f"_pass_{r.id}").alias("passed"),
                (F.col("_rows") - F.col(f"_pass_{r.id}")).alias("failed"),
            )
            for r in self.rules
        ]
        return self._counts(df).select(F.inline(F.array(*entries)))

    def results(self, df: DataFrame, row_key: Sequence[str]) -> DataFrame:
        """One row per record and rule; ordered by the keys and ``rule_number`` they stand row by row, as rules are listed."""
        entries = [
            F.struct(
                F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.field).alias("field"),
                text.shown_value(r.field).alias("value"), self._ok(r).alias("passed"),
                F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description"), F.lit(i).alias("rule_number"),
            )
            for i, r in enumerate(self.rules, 1)
        ]
        return self._checked(df).select(*[F.col(c).alias(f"key_{c}") for c in row_key], F.inline(F.array(*entries)))

    def issues(self, df: DataFrame, row_key: Sequence[str]) -> DataFrame:
        """Failed checks only. The passing entries are dropped before they are unfolded."""
        entries = [
            F.when(~self._ok(r), F.struct(
                F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.field).alias("field"),
                text.shown_value(r.field).alias("value"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description"),
                F.lit(i).alias("rule_number"),
            ))
            for i, r in enumerate(self.rules, 1)
        ]
        return self._checked(df).select(
            *[F.col(c).alias(f"key_{c}") for c in row_key], F.inline(F.array_compact(F.array(*entries)))
        )

    def flagged(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``_dq_failed``: ids of the fail-severity rules a row breaks (empty when clean)."""
        ids = [F.when(~self._ok(r), F.lit(r.id)) for r in self.rules if r.severity == FAIL]
        return self._checked(df).select(*df.columns, F.array_compact(F.array(*ids)).alias("_dq_failed"))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(clean rows, quarantined rows with the rules they break)."""
        marked = self.flagged(df)
        return marked.where(F.size("_dq_failed") == 0).drop("_dq_failed"), marked.where(F.size("_dq_failed") > 0)

    def gate(self, df: DataFrame, threshold: float) -> DataFrame:
        """``df`` if its score reaches ``threshold``; otherwise raise, so nothing downstream runs."""
        card = self.scorecard(df).first()
        if card["score"] is not None and card["score"] < threshold:
            raise QualityGateError(f"quality score {card['score']} is below {threshold}")
        return df


#: The names and descriptions under which users know the ten rules.
RULE_TEXTS = {
    "R001": ("Account Reference — Not Null", "Every record must have an account reference"),
    "R002": ("Account Reference — Format", "Account ref must match pattern CT followed by 8 digits"),
    "R003": ("Surname — Not Null", "Surname is required for all liable parties"),
    "R004": ("Forename — Not Null", "Forename should be present (some historic records may lack it)"),
    "R005": ("Postcode — Valid Format", "Postcode must be a valid UK format"),
    "R006": ("Ward Code — Valid Reference", "Ward code must exist in the ONS ward reference table"),
    "R007": ("Council Tax Band — Valid", "Band must be A through H"),
    "R008": ("Start Date — Valid", "Liable start date must be a valid date, not in the future"),
    "R009": ("Annual Charge — Positive", "Annual charge must be a positive number"),
    "R010": ("Title — Present", "Title is preferred for correspondence but not strictly required"),
}


def council_tax_suite(wards: DataFrame, today: Column) -> Suite:
    """The ten council-tax account rules; ``wards`` holds the valid ward codes."""
    bands = [chr(c) for c in range(ord("A"), ord("H") + 1)]

    def real_past_date(c: Column) -> Column:
        return F.try_to_date(c.cast("string"), "yyyy-MM-dd") <= today

    def positive(c: Column) -> Column:
        return (c > 0) & ~F.isnan(c.cast("double"))

    def blank_or(pattern: str) -> Callable[[Column], Column]:
        return lambda c: text.is_missing(c) | text.matches(c, pattern)

    def rule(id_: str, of: str, severity: str, check: Callable[[Column], Column] | None = None, reference: DataFrame | None = None) -> Rule:
        name, description = RULE_TEXTS[id_]
        return Rule(id_, name, of, severity, check, reference, description)

    return Suite((
        rule("R001", "account_ref", FAIL, text.is_present),
        rule("R002", "account_ref", FAIL, blank_or(text.ACCOUNT_REF)),
        rule("R003", "surname", FAIL, text.is_present),
        rule("R004", "forename", WARN, text.is_present),
        rule("R005", "postcode", FAIL, blank_or(text.POSTCODE_LOOSE)),
        rule("R006", "ward_code", FAIL, reference=wards),
        rule("R007", "band", FAIL, lambda c: c.isin(bands)),
        rule("R008", "start_date", FAIL, real_past_date),
        rule("R009", "annual_charge", FAIL, positive),
        rule("R010", "title", WARN, text.is_present),
    ))


# ---------------------------------------------------------------- column tests

def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their count (NULL keys are another test's concern)."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    present = df.where(F.col(key).isNotNull()).select(key, digest.alias("_digest"))
    # Long values are shuffled only where their digest occurs twice.
    twice = present.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest")
    return present.join(twice, "_digest", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key is absent from the parent table."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def not_null(c: str) -> Column:
    return F.col(c).isNull()


def not_matching(c: str, pattern: str) -> Column:
    return F.coalesce(~F.col(c).rlike(pattern), F.lit(False))


def outside(c: str, low: object, high: object) -> Column:
    return F.coalesce(~F.col(c).between(low, high), F.lit(False))


def test_report(df: DataFrame, row_tests: dict[str, Column], set_tests: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(test, failures, status)``. All row tests share one aggregation; set tests add one count each."""
    counted = df.agg(*[F.count_if(c).alias(f"t{i}") for i, c in enumerate(row_tests.values())])
    entries = [F.struct(F.lit(n).alias("test"), F.col(f"t{i}").alias("failures")) for i, n in enumerate(row_tests)]
    report = counted.select(F.inline(F.array(*entries)))
    for name, failing in (set_tests or {}).items():
        report = report.unionByName(failing.agg(F.lit(name).alias("test"), F.count(F.lit(1)).alias("failures")))
    return report.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def schema_drift(expected: dict[str, str], df: DataFrame) -> list[tuple[str, str | None, str | None, str]]:
    """``(column, expected type, actual type, status)`` for every column either side names."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    report = []
    for name in [*expected, *[n for n in actual if n not in expected]]:
        want, have = expected.get(name), actual.get(name)
        status = "missing" if have is None else "unexpected" if want is None else "ok" if want == have else "type_changed"
        report.append((name, want, have, status))
    return report


def conforms(c: str, declared: str) -> Column:
    """True when a text value fits a declared dictionary type such as VARCHAR(10), DECIMAL(10,2) or DATE."""
    kind, _, size = declared.upper().rstrip(")").partition("(")
    value = F.col(c).cast("string")
    if kind in ("VARCHAR", "CHAR"):
        fits = F.length(value) <= int(size)
    elif kind == "DATE":
        fits = F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    else:
        fits = value.try_cast({"INT": "int", "BOOLEAN": "boolean"}.get(kind, declared.lower())).isNotNull()
    return value.isNull() | F.coalesce(fits, F.lit(False))


def record_drift(feed: DataFrame, body: str, expected: Mapping[str, str]) -> DataFrame:
    """``feed`` with how each JSON record departs from ``expected`` (field -> type): ``drift`` is ``unreadable``, ``drifted`` or ``ok``, beside
    ``dropped``, ``unknown`` and ``mistyped`` field names. A field that is there with a JSON null counts as there.

    Columns of a table show a missing field as NULL; the record itself tells whether its source stopped sending it.
    """
    names = F.array(*[F.lit(n) for n in expected])
    keys = F.json_object_keys(body)
    wrong = [F.when(F.get_json_object(body, f"$['{n}']").isNotNull() & F.get_json_object(body, f"$['{n}']").try_cast(t).isNull(), F.lit(n))
             for n, t in expected.items() if t != "string"]
    mistyped = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    marked = feed.withColumns({
        "dropped": F.array_except(names, keys), "unknown": F.array_sort(F.array_except(keys, names)),
        "mistyped": F.when(keys.isNotNull(), mistyped)})
    departs = F.size("dropped") + F.size("unknown") + F.size("mistyped") > 0
    return marked.withColumn("drift", F.when(keys.isNull(), "unreadable").when(departs, "drifted").otherwise("ok"))


def accepted(marked: DataFrame, body: str, expected: Mapping[str, str]) -> DataFrame:
    """The typed fields of the records without drift; the others are for quarantine."""
    schema = ", ".join(f"`{n}` {t}" for n, t in expected.items())
    return marked.where("drift = 'ok'").select(F.from_json(body, schema).alias("_r")).select("_r.*")
