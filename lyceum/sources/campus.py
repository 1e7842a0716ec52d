"""University roles of the star-schema test tables.

student = customer, department = nation, college = region, course = part, instructor = supplier,
enrollment = lineitem of an order, attendance = events.  Views only project and join; every
filter and aggregate downstream still reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions import calendar, grades
from lyceum.operators import gpa

# Event type -> attendance status.
STATUS_OF_EVENT = {
    "view": "PRESENT", "click": "PRESENT", "signup": "LATE", "purchase": "EXCUSED", "error": "ABSENT",
}
PART_TIME_SEGMENTS = ("FURNITURE", "MACHINERY")
SCHOLARSHIP_FLOOR = 5000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("department_key"),
        F.col("n_name").alias("department_id"),
        F.col("n_name").alias("department_name"),
        F.col("r_name").alias("college"),
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part("c_name", F.lit("#"), F.lit(1))
    last = F.split_part("c_name", F.lit("#"), F.lit(2))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("student_key"),
        F.col("c_name").alias("student_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), last, F.lit("@campus.edu")).alias("email"),
        F.date_add(F.lit("1980-01-01").cast("date"), F.floor(F.abs("c_acctbal")).cast("int")).alias("date_of_birth"),
        F.col("c_mktsegment").alias("program"),
        F.col("c_mktsegment").alias("major"),
        F.col("c_nationkey").cast("bigint").alias("department_key"),
        F.when(F.col("c_mktsegment").isin(*PART_TIME_SEGMENTS), "Part-Time").otherwise("Full-Time").alias(
            "student_type"
        ),
        (F.col("c_acctbal") >= SCHOLARSHIP_FLOOR).alias("scholarship"),
        F.col("c_acctbal").alias("scholarship_amount"),
        F.lit(True).alias("is_current"),
    )


def instructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("instructor_key"),
        F.col("s_name").alias("instructor_id"),
        F.col("s_nationkey").cast("bigint").alias("department_key"),
        (F.col("s_acctbal") > 0).alias("is_active"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owning department of a course is its brand number."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("course_key"),
        F.col("p_partkey").cast("string").alias("course_id"),
        F.concat(F.lit("CRS"), F.col("p_partkey").cast("string")).alias("course_code"),
        F.col("p_name").alias("course_name"),
        (F.lit(1) + F.col("p_size") % 4).cast("int").alias("credit_hours"),
        F.col("p_type").alias("level"),
        F.col("p_brand").alias("category"),
        (F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("bigint") - 1).alias("department_key"),
    )


def enrollment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw enrollments at lineitem grain with their grade, before the order gives student and term."""
    points = F.col("l_quantity") / 12.5
    dropped = F.col("l_returnflag") == "R"
    letter = (
        F.when(dropped & (F.col("l_linestatus") == "F"), "w")
        .when(dropped, " I ")
        .otherwise(grades.letter_for(points))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        F.col("l_partkey").alias("course_key"),
        F.col("l_suppkey").alias("instructor_key"),
        letter.alias("grade"),
        points.alias("grade_points"),
        (F.lit(3) + F.col("l_linenumber") % 2).alias("credit_hours"),
        F.round(100 - F.col("l_discount") * 500, 2).alias("attendance_pct"),
        F.col("l_linenumber").alias("assignments_completed"),
        F.lit(grades.DEFAULT_ASSIGNMENTS_TOTAL).alias("assignments_total"),
        F.round(F.col("l_tax") * 1250, 1).alias("midterm_score"),
        (F.col("l_quantity") * 2).alias("final_score"),
    )


def graded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as fact rows.

    Facts store their flags, so here they are plain tests on the two status columns and filters on
    them reach the Parquet scan; ``enrich_grades`` would derive the same values from the letter.
    """
    points = F.col("l_quantity") / 12.5
    counts = F.col("l_returnflag") != "R"
    credits = F.lit(3) + F.col("l_linenumber") % 2
    midterm, final = F.round(F.col("l_tax") * 1250, 1), F.col("l_quantity") * 2
    attendance = F.round(100 - F.col("l_discount") * 500, 2)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        F.col("l_partkey").alias("course_key"),
        F.col("l_suppkey").alias("instructor_key"),
        F.when(counts, grades.letter_for(points))
        .when(F.col("l_linestatus") == "F", "W")
        .otherwise("I")
        .alias("grade_letter"),
        F.when(counts, points).alias("grade_points"),
        credits.alias("credit_hours"),
        F.when(counts, points * credits).alias("quality_points"),
        attendance.alias("attendance_pct"),
        F.col("l_linenumber").alias("assignments_completed"),
        midterm.alias("midterm_score"),
        final.alias("final_score"),
        grades.overall_score(midterm, final, attendance).alias("overall_score"),
        (counts & (points >= grades.GRADE_POINTS["D-"])).alias("is_passing"),
        (~counts & (F.col("l_linestatus") == "F")).alias("is_withdrawn"),
        (~counts & (F.col("l_linestatus") != "F")).alias("is_incomplete"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: who enrolled, in which department and semester."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey"),
        F.col("o_custkey").alias("student_key"),
        F.col("c_nationkey").cast("bigint").alias("department_key"),
        calendar.term_key(day).alias("term_key"),
        calendar.date_key(day).alias("enrollment_date_key"),
    )


def labelled_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``terms`` with the labels of the semester instead of its key."""
    rows = terms(spark, sf_dir)
    return rows.withColumns(calendar.term_labels(F.col("term_key"))).drop("term_key")


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT_ACADEMIC_PERFORMANCE: one row per enrollment."""
    lines, term = graded_lines(spark, sf_dir), labelled_terms(spark, sf_dir)
    return lines.join(term, lines.l_orderkey == term.o_orderkey).drop("l_orderkey", "o_orderkey")


def performance_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``performance`` with the integer key of the semester in place of its two labels."""
    lines, term = graded_lines(spark, sf_dir), terms(spark, sf_dir)
    return lines.join(term, lines.l_orderkey == term.o_orderkey).drop("l_orderkey", "o_orderkey")


def semester_gpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT_SEMESTER_GPA without its running column.

    Additive sums are taken per order before the join: the join then moves one row per order
    instead of one per line, and an order that holds a large share of the lines is folded on
    the map side.  Terms are grouped by their integer key and labelled afterwards.
    """
    per_order = gpa.credit_sums(graded_lines(spark, sf_dir), ["l_orderkey"])
    term = terms(spark, sf_dir).drop("enrollment_date_key")
    joined = per_order.join(term, per_order.l_orderkey == term.o_orderkey)
    sums = gpa.combine(joined, ["student_key", "department_key", "term_key"])
    return gpa.finish(sums.withColumns(calendar.term_labels(F.col("term_key"))), gpa.SEMESTER_KEYS)


def semester_gpa_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT_SEMESTER_GPA with the running GPA."""
    return gpa.cumulative_gpa(semester_gpa(spark, sf_dir))


def attendance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw attendance: one row per event, with repeats of (student, course, date)."""
    return as_attendance(table(spark, sf_dir, "events"))


def as_attendance(events: DataFrame) -> DataFrame:
    """Attendance columns of an event table or stream."""
    status = F.lit(None).cast("string")
    for event, name in STATUS_OF_EVENT.items():
        status = F.when(F.col("event_type") == event, F.lit(name)).otherwise(status)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("user_id").alias("student_key"),
        F.get_json_object("props", "$.k").cast("bigint").alias("course_key"),
        F.to_date("ts").alias("attendance_date"),
        status.alias("status"),
        F.floor("value").cast("int").alias("minutes_late"),
        F.lit("LMS").alias("source_system"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw student forms, all text and partly dirty: one per order, so students repeat.

    Formats, spellings and ages come straight from order and customer columns, which gives
    bad e-mails, impossible dates, out-of-range years and unknown types without a generator.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    born = F.concat(
        (F.lit(1900) + F.floor(F.col("o_totalprice") / 5000)).cast("string"), F.substring(day, 5, 6)
    )
    host = (
        F.when(F.col("o_orderstatus") == "P", "@Campus.edu")
        .when(F.col("o_orderstatus") == "F", "@uni.EDU")
        .otherwise("campus")
    )
    kind = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Full-Time")
        .when(F.col("o_orderpriority") == "5-LOW", "Part-Time")
        .otherwise("Unknown")
    )
    last = F.split_part("c_name", F.lit("#"), F.lit(2))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("form_id"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")).alias("student_id"),
        F.lower(F.col("c_mktsegment")).alias("first_name"),
        F.concat(F.lit("o'neil-"), F.lower("c_mktsegment"), F.lit(" ")).alias("last_name"),
        F.concat(F.col("c_mktsegment"), F.lit("."), last, host).alias("email"),
        born.alias("date_of_birth"),
        F.when(F.col("o_orderstatus") == "F", "Female").when(F.col("o_orderstatus") == "O", "Male").alias("gender"),
        F.concat(F.lit("  "), F.col("c_mktsegment")).alias("nationality"),
        day.alias("enrollment_date"),
        F.col("c_mktsegment").alias("program"),
        F.col("o_orderpriority").alias("major"),
        F.col("c_nationkey").cast("string").alias("department_id"),
        kind.alias("student_type"),
        F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "yes").otherwise("0").alias(
            "scholarship"
        ),
        F.when(F.col("o_orderstatus") == "P", "n/a")
        .otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
        .alias("scholarship_amount"),
    )
