"""Data-quality rules: a suite is one aggregation over the table plus one anti-join per foreign key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lyceum.functions import calendar, grades, text
from lyceum.functions.status import STATUSES
from lyceum.operators import profile

PASS, FAIL, WARN = "PASS", "FAIL", "WARN"
WARN_SHARE = 0.01
SHOWN_VALUES = 5
GATE_PASS_RATE = 95.0

REPORT_COLUMNS = ["check_name", "result", "expected", "actual", "row_count"]


@dataclass(frozen=True)
class Rule:
    """A named check.  ``bad`` counts violations, ``verdict`` turns (bad, rows) into a result."""

    name: str
    expected: str
    bad: Column
    verdict: object
    actual: object
    distinct_of: str | None = None


def _pass_if(test: Column) -> Column:
    return F.when(test, PASS).otherwise(FAIL)


def _share(bad: Column, rows: Column) -> Column:
    return bad / F.greatest(rows, F.lit(1))


def not_null(column: str, threshold: float = 0.0) -> Rule:
    """PASS when the share of NULLs is at most ``threshold``."""

    def shown(bad: Column, rows: Column) -> Column:
        return F.format_string("null_rate = %.1f%% (%d nulls)", _share(bad, rows) * 100, bad)

    return Rule(
        f"not_null:{column}",
        f"null_rate <= {threshold:.1%}",
        F.count_if(F.col(column).isNull()),
        lambda bad, rows: _pass_if(_share(bad, rows) <= threshold),
        shown,
    )


def unique(column: str) -> Rule:
    """PASS when no non-NULL value repeats."""
    return Rule(
        f"unique:{column}",
        "0 duplicates",
        F.count(column),
        lambda bad, rows: _pass_if(bad == 0),
        lambda bad, rows: F.format_string("%d duplicates", bad),
        distinct_of=column,
    )


def in_set(column: str, allowed: Sequence[str]) -> Rule:
    """PASS when every non-NULL value is allowed."""
    return Rule(
        f"in_set:{column}",
        f"values in {sorted(allowed)}",
        F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)),
        lambda bad, rows: _pass_if(bad == 0),
        lambda bad, rows: F.format_string("%d invalid values", bad),
    )


def in_range(column: str, low: float, high: float) -> Rule:
    """PASS without violations, WARN below one percent of the rows; text that is no number is ignored."""
    number = F.col(column).try_cast("double")
    return Rule(
        f"range:{column}",
        f"{low} <= {column} <= {high}",
        F.count_if((number < low) | (number > high)),
        lambda bad, rows: F.when(bad == 0, PASS).when(bad < rows * WARN_SHARE, WARN).otherwise(FAIL),
        lambda bad, rows: F.format_string("%d out-of-range values", bad),
    )


def min_rows(n: int) -> Rule:
    return Rule(
        "min_row_count",
        f">= {n} rows",
        F.lit(0).cast("bigint"),
        lambda bad, rows: _pass_if(rows >= n),
        lambda bad, rows: F.format_string("%d rows", rows),
    )


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: check_name, result, expected, actual, row_count.

    The whole suite is one scan.  With ``unique`` rules the rows are first counted per value of each
    such column in one grouping-sets pass (partial counts on the map side, so a value that fills a
    large share of the table does not gather in one task); the other rules are sums of that pass.
    """
    plain = [(i, r) for i, r in enumerate(rules) if r.distinct_of is None]
    repeats = [(i, r) for i, r in enumerate(rules) if r.distinct_of is not None]
    if not repeats:
        counted = df.agg(F.count(F.lit(1)).alias("_rows"), *(r.bad.cast("bigint").alias(f"_bad{i}") for i, r in plain))
    else:
        columns = list(dict.fromkeys(r.distinct_of for _, r in repeats))
        copies = df.withColumns({f"_u{k}": F.col(c) for k, c in enumerate(columns)})
        sums = {"_n": F.count(F.lit(1)), **{f"_bad{i}": r.bad.cast("bigint") for i, r in plain}}
        per_value = profile.member_counts(copies, [], [f"_u{k}" for k in range(len(columns))], sums)
        # NULLs form one value; they count as rows but never as duplicates.
        over = {
            i: F.sum(F.when((F.col("_member") == u) & F.col(u).isNotNull(), F.col("_n") - 1))
            for i, r in repeats
            for u in [f"_u{columns.index(r.distinct_of)}"]
        }
        counted = per_value.agg(
            F.coalesce(profile.sum_from("_u0", "_n"), F.lit(0)).alias("_rows"),
            *(F.coalesce(profile.sum_from("_u0", f"_bad{i}"), F.lit(0)).alias(f"_bad{i}") for i, _ in plain),
            *(F.coalesce(c, F.lit(0)).alias(f"_bad{i}") for i, c in over.items()),
        )
    return counted.select(
        F.inline(F.array(*(_line(i, r, F.col(f"_bad{i}"), F.col("_rows")) for i, r in enumerate(rules))))
    )


def _line(position: int, rule: Rule, bad: Column, rows: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(rule.name).alias("check_name"),
        rule.verdict(bad, rows).alias("result"),
        F.lit(rule.expected).alias("expected"),
        rule.actual(bad, rows).alias("actual"),
        rows.cast("bigint").alias("row_count"),
    )


def referential_integrity(df: DataFrame, fk: str, ref: DataFrame, pk: str, position: int = 0) -> DataFrame:
    """Report row for a foreign key; a NULL key is an orphan.

    The key column is reduced to counts per value before the anti-join, so the join moves one
    row per distinct key and a hot key is folded on the map side.
    """
    per_key = df.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
    known = ref.select(F.col(pk).alias("_pk")).filter(F.col("_pk").isNotNull()).distinct().withColumn("_hit", F.lit(1))
    checked = per_key.join(known, per_key["_fk"] == known["_pk"], "left")
    sums = checked.agg(
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("_bad"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
    )
    rule = Rule(
        f"ref_integrity:{fk}→{pk}", "all FK values in PK set", F.lit(0), lambda bad, rows: _pass_if(bad == 0),
        lambda bad, rows: F.format_string("%d orphaned FK values", bad),
    )
    return sums.select(F.inline(F.array(_line(position, rule, F.col("_bad"), F.col("_rows")))))


def orphans(df: DataFrame, fk: str, ref: DataFrame, pk: str) -> DataFrame:
    """The rows behind a failed reference, for quarantine."""
    known = ref.select(F.col(pk).alias(fk)).distinct()
    return df.join(known, fk, "left_anti")


def offending_values(df: DataFrame, column: str, allowed: Sequence[str], n: int = SHOWN_VALUES) -> DataFrame:
    """Up to ``n`` distinct values outside the allowed set, in order, with their counts."""
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy("value").limit(n)


def students_suite(minimum: int = 100) -> list[Rule]:
    return [
        min_rows(minimum),
        not_null("student_id"),
        not_null("email", 0.01),
        not_null("department_id"),
        unique("student_id"),
        unique("email"),
        in_set("student_type", ["Full-Time", "Part-Time"]),
    ]


def enrollments_suite(minimum: int = 500, grade: str = "grade") -> list[Rule]:
    return [
        min_rows(minimum),
        not_null("enrollment_id"),
        not_null("student_id"),
        not_null("course_id"),
        unique("enrollment_id"),
        in_set(grade, grades.VALID_GRADES),
        in_range("attendance_pct", 0, 100),
    ]


def attendance_suite(minimum: int = 1000) -> list[Rule]:
    return [
        min_rows(minimum),
        not_null("student_id"),
        not_null("attendance_date"),
        in_set("status", STATUSES),
    ]


def validate_students(df: DataFrame, minimum: int = 100) -> DataFrame:
    return report(df, students_suite(minimum))


def validate_enrollments(df: DataFrame, students: DataFrame, minimum: int = 500) -> DataFrame:
    rules = enrollments_suite(minimum)
    reference = referential_integrity(df, "student_id", students, "student_id", position=len(rules))
    return report(df, rules).unionByName(reference)


def validate_attendance(df: DataFrame, minimum: int = 1000) -> DataFrame:
    return report(df, attendance_suite(minimum))


def summary(lines: DataFrame, table: str) -> DataFrame:
    """One row: total, passed, failed (WARN included), pass rate and whether nothing failed outright."""
    ok = F.count_if(F.col("result") == PASS)
    total = F.count(F.lit(1))
    rate = ok * 100.0 / F.greatest(total, F.lit(1))
    return lines.agg(
        F.lit(table).alias("table_name"),
        total.alias("total"),
        ok.alias("passed"),
        (total - ok).alias("failed"),
        F.format_string("%.1f%%", rate).alias("pass_rate"),
        (F.count_if(F.col("result") == FAIL) == 0).alias("ok"),
    )


class QualityGateError(RuntimeError):
    """A table failed its quality suite."""


def gate(lines: DataFrame, minimum: float = GATE_PASS_RATE) -> bool:
    """True when the share of passed checks reaches ``minimum`` percent.  Reads one row."""
    row: Row = lines.agg(
        F.count_if(F.col("result") == PASS).alias("ok"), F.count(F.lit(1)).alias("n")
    ).first()
    return row["ok"] * 100.0 >= minimum * max(row["n"], 1)


def require_no_failure(lines: DataFrame, table: str) -> None:
    """Raise when any check of the table failed (WARN does not count).  Reads one row per rule."""
    bad = [r["check_name"] for r in lines.filter(F.col("result") == FAIL).select("check_name").collect()]
    if bad:
        raise QualityGateError(f"{table}: {', '.join(sorted(bad))}")


def quality_log(lines: DataFrame, table: str, run_id: str) -> DataFrame:
    """Report rows in the shape of the quality log."""
    return lines.select(
        F.expr("uuid()").alias("log_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(table).alias("table_name"),
        "check_name", "result", "expected", "actual", "row_count",
        F.current_timestamp().alias("logged_at"),
    )


def enrollment_flags(df: DataFrame) -> DataFrame:
    """Row flags of staged enrollments: ids present, known grade, attendance in range, parsable date."""
    attendance = F.col("attendance_pct").try_cast("decimal(5,2)")
    return df.withColumns(
        {
            "v_has_student_id": F.col("student_id").isNotNull(),
            "v_has_course_id": F.col("course_id").isNotNull(),
            "v_valid_grade": F.coalesce(
                grades.normal_grade(F.col("grade")).isin(*grades.VALID_GRADES), F.lit(False)
            ),
            "v_valid_attendance": F.coalesce(attendance.between(0, 100), F.lit(False)),
            "v_valid_date": calendar.parse_date(F.col("enrollment_date").cast("string")).isNotNull(),
        }
    )


def attendance_flags(df: DataFrame) -> DataFrame:
    """Row flags of staged attendance: ids present, parsable date, known status, weekday."""
    day = calendar.parse_date(F.col("attendance_date").cast("string"))
    return df.withColumns(
        {
            "v_has_student_id": F.col("student_id").isNotNull(),
            "v_has_course_id": F.col("course_id").isNotNull(),
            "v_valid_date": day.isNotNull(),
            "v_valid_status": F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
            "v_is_weekday": F.coalesce(calendar.iso_weekday(day) <= 5, F.lit(False)),
        }
    )


def flag_audit(flagged: DataFrame, severity: dict[str, str]) -> DataFrame:
    """Report rows for boolean flag columns; ``severity`` gives FAIL or WARN per flag."""
    counts = flagged.agg(
        F.count(F.lit(1)).alias("_rows"), *(F.count_if(~F.col(f)).alias(f"_bad_{f}") for f in severity)
    )
    lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(flag).alias("check_name"),
            F.when(F.col(f"_bad_{flag}") == 0, PASS).otherwise(level).alias("result"),
            F.lit("0 violations").alias("expected"),
            F.format_string("%d violations", F.col(f"_bad_{flag}")).alias("actual"),
            F.col("_rows").alias("row_count"),
        )
        for i, (flag, level) in enumerate(severity.items())
    ]
    return counts.select(F.inline(F.array(*lines)))


def id_format(df: DataFrame, column: str = "student_id", pattern: str = text.STUDENT_ID_PATTERN) -> DataFrame:
    """Counts of ids that do and do not have the expected form."""
    good = text.matches(F.col(column), pattern)
    return df.agg(F.count_if(good).alias("matching"), F.count_if(~good).alias("other"))
