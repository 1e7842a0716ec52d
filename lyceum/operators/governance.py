"""Column masking, row filters, PII tags and access records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lyceum.functions import text
from lyceum.sources.staging import stage

# Roles, mask texts and PII tags.
FULL_VIEW = ("UNIVERSITY_ADMIN", "DATA_ENGINEER")
NAME_VIEW = (*FULL_VIEW, "DATA_ANALYST", "DEPARTMENT_ADMIN", "INSTRUCTOR")
ALL_ROWS = ("UNIVERSITY_ADMIN", "DATA_ENGINEER", "DATA_ANALYST", "READONLY_DASHBOARD")
HIDDEN_NAME = "***"
REDACTED = "***REDACTED***"
HIDDEN_AMOUNT = -1.0
PII_TAGS = {
    "email": "HIGH",
    "date_of_birth": "HIGH",
    "first_name": "MEDIUM",
    "last_name": "MEDIUM",
    "scholarship_amount": "HIGH",
}
STUDENT_POLICIES = {
    "email": "email",
    "date_of_birth": "birth_date",
    "first_name": "name",
    "last_name": "name",
    "scholarship_amount": "amount",
}


@dataclass(frozen=True)
class Principal:
    """Who asks: user name, role, and the grant names held (for department admins)."""

    user: str
    role: str
    grants: tuple[str, ...] = ()


_MASKS = {
    "email": (FULL_VIEW, text.masked_email),
    "birth_date": (FULL_VIEW, lambda c: F.make_date(F.year(c), F.lit(1), F.lit(1))),
    "name": (NAME_VIEW, lambda c: F.lit(HIDDEN_NAME)),
    "amount": (FULL_VIEW, lambda c: F.lit(HIDDEN_AMOUNT)),
    "full": (("UNIVERSITY_ADMIN",), lambda c: F.lit(REDACTED)),
}


def mask(df: DataFrame, role: str, policies: Mapping[str, str] = STUDENT_POLICIES) -> DataFrame:
    """Mask columns for a role.  The role is known on the driver, so only one branch is planned."""
    masked = {}
    for column, policy in policies.items():
        clear_for, hide = _MASKS[policy]
        if role not in clear_for and column in df.columns:
            masked[column] = hide(F.col(column))
    return df.withColumns(masked) if masked else df


def keyed_grants(grants: DataFrame, departments: DataFrame) -> DataFrame:
    """Grants with the key of their department, written once.

    A filter on them has a measured size, so Spark sends the granted keys ahead of the scan of a table that is laid out by
    department, and its other partitions are not opened.
    """
    keyed = grants.join(departments.select("department_key", "department_id"), "department_id")
    return stage(keyed.select("role_name", "department_id", "department_key", "is_active"), "keyed-grants")


def _granted(grants: DataFrame, departments: DataFrame, who: Principal) -> DataFrame:
    active = grants.filter(F.col("role_name").isin(*who.grants) & F.col("is_active")) if who.grants else grants.limit(0)
    if "department_key" in grants.columns:
        return active.select("department_key")
    return active.join(departments.select("department_key", "department_id"), "department_id").select("department_key")


def visible_facts(
    facts: DataFrame, who: Principal, *, grants: DataFrame, departments: DataFrame, instructors: DataFrame
) -> DataFrame:
    """Fact rows a principal may see, by department; unknown roles and the student portal see none."""
    if who.role in ALL_ROWS:
        return facts
    if who.role == "DEPARTMENT_ADMIN":
        return facts.join(_granted(grants, departments, who), "department_key", "left_semi")
    if who.role == "INSTRUCTOR":
        own = instructors.filter((F.col("instructor_id") == who.user) & F.col("is_active")).select("department_key")
        return facts.join(own, "department_key", "left_semi")
    return facts.filter(F.lit(False))


def visible_students(
    students: DataFrame,
    who: Principal,
    *,
    grants: DataFrame,
    departments: DataFrame,
    performance: DataFrame,
    instructors: DataFrame,
    user_map: DataFrame | None = None,
) -> DataFrame:
    """Student rows a principal may see: by grant, by own record, or by having taught them."""
    if who.role in ALL_ROWS:
        return students
    if who.role == "DEPARTMENT_ADMIN":
        return students.join(_granted(grants, departments, who), "department_key", "left_semi")
    if who.role == "STUDENT_PORTAL" and user_map is not None:
        own = user_map.filter(F.col("username") == who.user).select("student_id")
        return students.join(own, "student_id", "left_semi")
    if who.role == "INSTRUCTOR":
        me = instructors.filter(F.col("instructor_id") == who.user).select("instructor_key")
        # Distinct first: repeats fold on the map side, and the join needs no further shuffle.
        taught = performance.join(me, "instructor_key", "left_semi").select("student_key").distinct()
        return students.join(taught, "student_key", "left_semi")
    return students.filter(F.lit(False))


def department_scope(df: DataFrame, who_department: int | None, asked: int | None) -> DataFrame:
    """Department filter in which the principal's own department overrides the one asked for."""
    chosen = who_department if who_department is not None else asked
    return df if chosen is None else df.filter(F.col("department_key") == chosen)


def tag_pii(df: DataFrame, tags: Mapping[str, str] = PII_TAGS) -> DataFrame:
    """Attach sensitivity tags as column metadata, which survives projections and Parquet."""
    return df.select(
        *(
            F.col(c).alias(c, metadata={"pii": tags[c]}) if c in tags else F.col(c)
            for c in df.columns
        )
    )


def pii_columns(df: DataFrame) -> dict[str, str]:
    """Tagged columns and their sensitivity."""
    return {f.name: f.metadata["pii"] for f in df.schema.fields if "pii" in f.metadata}


def seed_grants(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing grants plus the wanted ones that are missing; nothing is overwritten."""
    missing = wanted.join(existing.select("role_name", "department_id"), ["role_name", "department_id"], "left_anti")
    return existing.unionByName(missing.select(*existing.columns))


def audited(
    df: DataFrame, who: Principal, table: str, context: str
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The same rows, observed, and the access-log row to take once they have been read: no second run counts them."""
    seen = Observation("seen")
    rows = df.observe(seen, F.count(F.lit(1)).alias("row_count"))

    def record() -> DataFrame:
        line = df.sparkSession.range(1).select(F.lit(seen.get["row_count"]).cast("bigint").alias("row_count"))
        return _access_row(line, who, table, context)

    return rows, record


def access_record(spark_df: DataFrame, who: Principal, table: str, context: str) -> DataFrame:
    """One access-log row with the number of rows seen, for rows that are not read otherwise (see ``audited``)."""
    return _access_row(spark_df.agg(F.count(F.lit(1)).alias("row_count")), who, table, context)


def _access_row(counted: DataFrame, who: Principal, table: str, context: str) -> DataFrame:
    return counted.select(
        F.expr("uuid()").alias("log_id"),
        F.lit(who.user).alias("session_user"),
        F.lit(who.role).alias("session_role"),
        F.lit(table).alias("table_name"),
        F.lit(context).alias("filter_context"),
        "row_count",
        F.current_timestamp().alias("accessed_at"),
    )


def grant_rows(pairs: DataFrame, role_column: str, department_column: str, by: str) -> DataFrame:
    """Grant table rows from (role, department) pairs, with their defaults."""
    return pairs.select(
        F.col(role_column).alias("role_name"),
        F.col(department_column).alias("department_id"),
        F.lit(by).alias("granted_by"),
        F.current_timestamp().alias("granted_at"),
        F.lit(True).alias("is_active"),
    )


def masked_columns(role: str, policies: Mapping[str, str] = STUDENT_POLICIES) -> Sequence[str]:
    """Columns a role sees masked."""
    return [c for c, p in policies.items() if role not in _MASKS[p][0]]
