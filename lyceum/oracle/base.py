"""SQL fragments shared by the checking queries (DuckDB dialect)."""

from __future__ import annotations


def half_up(num: str, den: str, digits: int) -> str:
    """Half-up rounded ratio of two whole numbers."""
    return (
        f"(CAST((CAST({num} AS HUGEINT) * {2 * 10**digits} + ({den})) // nullif(2 * ({den}), 0) AS DOUBLE)"
        f" / CAST({10**digits} AS DOUBLE))"
    )


def units(value: str, digits: int) -> str:
    return f"CAST(round(({value}) * {10**digits}) AS BIGINT)"


def mean(value: str, digits_in: int, digits_out: int) -> str:
    return half_up(f"sum({units(value, digits_in)})", f"count({value}) * {10**digits_in}", digits_out)


def shorten(value: str, digits_in: int, digits_out: int) -> str:
    return half_up(units(value, digits_in), str(10**digits_in), digits_out)


def pct(part: str, whole: str, digits: int = 2) -> str:
    return half_up(f"({part}) * 100", whole, digits)


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def period(day: str) -> str:
    """Academic year and semester columns of a date expression."""
    return f"""
    CASE WHEN month({day}) >= 9 THEN year({day}) || '-' || (year({day}) + 1)
         ELSE (year({day}) - 1) || '-' || year({day}) END AS academic_year,
    (CASE WHEN month({day}) >= 9 THEN 'Fall' WHEN month({day}) >= 6 THEN 'Summer' ELSE 'Spring' END)
      || ' ' || year({day}) AS semester"""


DEPT = """dept AS (
  SELECT CAST(n_nationkey AS BIGINT) AS department_key, n_name AS department_id, n_name AS department_name,
         r_name AS college
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

STUDENT = """student AS (
  SELECT c_custkey AS student_key, c_name AS student_id, split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name,
         split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) AS student_name,
         lower(split_part(c_name, '#', 1)) || '.' || split_part(c_name, '#', 2) || '@campus.edu' AS email,
         CAST(DATE '1980-01-01' + CAST(floor(abs(c_acctbal)) AS INTEGER) AS DATE) AS date_of_birth,
         c_mktsegment AS program, c_mktsegment AS major, CAST(c_nationkey AS BIGINT) AS department_key,
         CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 'Part-Time' ELSE 'Full-Time' END AS student_type,
         c_acctbal >= 5000 AS scholarship, c_acctbal AS scholarship_amount, TRUE AS is_current
  FROM customer)"""

LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey AS course_key, l_suppkey AS instructor_key,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'W' WHEN l_returnflag = 'R' THEN 'I'
              WHEN p >= 4.0 THEN 'A' WHEN p >= 3.7 THEN 'A-' WHEN p >= 3.3 THEN 'B+' WHEN p >= 3.0 THEN 'B'
              WHEN p >= 2.7 THEN 'B-' WHEN p >= 2.3 THEN 'C+' WHEN p >= 2.0 THEN 'C' WHEN p >= 1.7 THEN 'C-'
              WHEN p >= 1.3 THEN 'D+' WHEN p >= 1.0 THEN 'D' WHEN p >= 0.7 THEN 'D-' ELSE 'F' END AS grade_letter,
         CASE WHEN l_returnflag <> 'R' THEN p END AS grade_points,
         CAST(3 + l_linenumber % 2 AS INTEGER) AS credit_hours,
         CASE WHEN l_returnflag <> 'R' THEN p * (3 + l_linenumber % 2) END AS quality_points,
         round(100 - l_discount * 500, 2) AS attendance_pct, l_linenumber AS assignments_completed,
         round(l_tax * 1250, 1) AS midterm_score, l_quantity * 2 AS final_score,
         l_returnflag <> 'R' AND p >= 0.7 AS is_passing,
         l_returnflag = 'R' AND l_linestatus = 'F' AS is_withdrawn,
         l_returnflag = 'R' AND l_linestatus <> 'F' AS is_incomplete
  FROM (SELECT *, l_quantity / 12.5 AS p FROM lineitem)),
scored AS (
  SELECT *, """ + half_up(
    f"35 * {units('midterm_score', 2)} + 45 * {units('final_score', 2)} + 20 * {units('attendance_pct', 2)}", "10000", 2
) + """ AS overall_score FROM lines)"""

PERF = LINES + f""",
perf AS (
  SELECT s.*, o_custkey AS student_key, CAST(c_nationkey AS BIGINT) AS department_key,{period('o_orderdate')}
  FROM scored s JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

SEM = PERF + f""",
sem AS (
  SELECT student_key, department_key, academic_year, semester,
         least(4.0::DOUBLE, {half_up(f"sum({units('quality_points', 4)})", "sum(credit_hours) * 10000", 3)}) AS semester_gpa,
         CAST(sum(CASE WHEN is_passing THEN credit_hours ELSE 0 END) AS BIGINT) AS credit_hours_earned,
         CAST(sum(credit_hours) AS BIGINT) AS credit_hours_attempted,
         count(*) AS courses_taken, count(*) FILTER (WHERE is_passing) AS courses_passed,
         {mean('attendance_pct', 2, 2)} AS avg_attendance_pct
  FROM perf WHERE NOT is_withdrawn AND NOT is_incomplete AND grade_points IS NOT NULL
  GROUP BY 1, 2, 3, 4)"""

_RUN = "OVER (PARTITION BY student_key ORDER BY academic_year, semester ROWS UNBOUNDED PRECEDING)"
CUM = SEM + f""",
cum AS (
  SELECT *, least(4.0::DOUBLE, {half_up(
    f"sum({units('semester_gpa', 3)} * credit_hours_attempted) {_RUN}", f"sum(credit_hours_attempted) {_RUN} * 1000", 3
)}) AS cumulative_gpa FROM sem)"""

ATT = f"""att AS (
  SELECT *, status IN ('PRESENT', 'LATE') AS is_present, status = 'EXCUSED' AS is_excused,
         CAST(year(attendance_date) * 10000 + month(attendance_date) * 100 + day(attendance_date) AS INTEGER) AS date_key,
         {period('attendance_date')}, monthname(attendance_date) AS month_name
  FROM (SELECT event_id, ts AS event_time, user_id AS student_key,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS course_key, CAST(ts AS DATE) AS attendance_date,
               CASE event_type WHEN 'view' THEN 'PRESENT' WHEN 'click' THEN 'PRESENT' WHEN 'signup' THEN 'LATE'
                    WHEN 'purchase' THEN 'EXCUSED' WHEN 'error' THEN 'ABSENT' END AS status,
               CAST(floor(value) AS INTEGER) AS minutes_late, 'LMS' AS source_system
        FROM events))"""

FORMS = """forms AS (
  SELECT o_orderkey AS form_id, c_name AS student_id, lower(c_mktsegment) AS first_name,
         'o''neil-' || lower(c_mktsegment) AS last_name,
         c_mktsegment || '.' || split_part(c_name, '#', 2) ||
           CASE o_orderstatus WHEN 'P' THEN '@Campus.edu' WHEN 'F' THEN '@uni.EDU' ELSE 'campus' END AS email,
         TRY_CAST((1900 + CAST(floor(o_totalprice / 5000) AS INTEGER)) || strftime(o_orderdate, '-%m-%d') AS DATE)
           AS date_of_birth,
         CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' END AS gender,
         c_mktsegment AS nationality, CAST(o_orderdate AS DATE) AS enrollment_date, c_mktsegment AS program,
         o_orderpriority AS major, CAST(c_nationkey AS VARCHAR) AS department_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Full-Time'
              WHEN o_orderpriority = '5-LOW' THEN 'Part-Time' ELSE 'Unknown' END AS student_type,
         o_orderstatus IN ('F', 'O') AS scholarship,
         CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS scholarship_amount
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
