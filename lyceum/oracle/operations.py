"""Attendance, cleaning, data quality, loads, governance and the stream's batch result."""

from __future__ import annotations

from lyceum.oracle.base import ATT, DEPT, FORMS, LINES, PERF, SEM, STUDENT, big, half_up, mean, pct, units, with_

_ONE_PER_DAY = """daily AS (
  SELECT * FROM att QUALIFY row_number() OVER (
    PARTITION BY student_key, course_key, attendance_date ORDER BY event_time DESC, event_id DESC) = 1)"""
_ATT_DEPT = "attd AS (SELECT att.*, CAST(c_nationkey AS BIGINT) AS department_key FROM att JOIN customer ON student_key = c_custkey)"

_COUNTS = f"""count(*) AS total_records, count(*) FILTER (WHERE is_present) AS present_count,
  count(*) FILTER (WHERE status = 'ABSENT') AS absent_count, count(*) FILTER (WHERE status = 'EXCUSED') AS excused_count"""

_CHECKED = """latest AS (
  SELECT *, date_diff('day', date_of_birth, DATE '2002-01-01') / 365.25 AS age,
    regexp_full_match(email, '[\\w\\.\\+\\-]+@[\\w\\-]+\\.\\w{2,}') AS good_email
  FROM forms QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY enrollment_date DESC, form_id DESC) = 1),
checked AS (
  SELECT *, concat_ws('; ', CASE WHEN NOT good_email THEN 'Invalid email: ' || email END,
    CASE WHEN date_of_birth IS NULL THEN 'NULL date_of_birth'
         WHEN age < 15 OR age > 80 THEN printf('Unrealistic age: %.1f years', CAST(age AS DOUBLE)) END,
    CASE WHEN year(enrollment_date) < 2000 OR year(enrollment_date) > 2003
         THEN 'Enrollment year out of range: ' || year(enrollment_date) END,
    CASE WHEN student_type NOT IN ('Full-Time', 'Part-Time') THEN 'Invalid student_type: ' || student_type END) AS errors
  FROM latest)"""


def _title(value: str) -> str:
    return f"upper(left({value}, 1)) || lower(substr({value}, 2))"


_CLEAN = f"""SELECT form_id, student_id, {_title('program')} AS first_name, 'O''Neil-' || {_title('program')} AS last_name,
  lower(email) AS email, date_of_birth, coalesce(gender, 'Prefer not to say') AS gender, nationality, enrollment_date,
  program, major, department_id, student_type, scholarship, scholarship_amount,
  md5({_title('program')} || '|O''Neil-' || {_title('program')} || '|' || lower(email) || '|' || program || '|' || major
    || '|' || department_id || '|' || student_type || '|' || scholarship::VARCHAR || '|'
    || CAST(scholarship_amount AS DECIMAL(18,2))::VARCHAR) AS row_hash
  FROM checked WHERE errors = ''"""


def _line(position: int, name: str, result: str, expected: str, actual: str, rows: str, source: str) -> str:
    return (
        f"SELECT {position} AS position, '{name}' AS check_name, {result} AS result, '{expected}' AS expected, "
        f"{actual} AS actual, CAST({rows} AS BIGINT) AS row_count FROM {source}"
    )


def _min_rows(pos: int, n: int, source: str) -> str:
    return _line(pos, "min_row_count", f"CASE WHEN count(*) >= {n} THEN 'PASS' ELSE 'FAIL' END", f">= {n} rows",
                 "count(*) || ' rows'", "count(*)", source)


def _not_null(pos: int, column: str, threshold: float, source: str) -> str:
    bad = f"count(*) FILTER (WHERE {column} IS NULL)"
    return _line(
        pos, f"not_null:{column}", f"CASE WHEN {bad}::DOUBLE / greatest(count(*), 1) <= {threshold} THEN 'PASS' ELSE 'FAIL' END",
        f"null_rate <= {threshold:.1%}",
        f"printf('null_rate = %.1f%% (%d nulls)', {bad}::DOUBLE / greatest(count(*), 1) * 100, {bad})", "count(*)", source,
    )


def _unique(pos: int, column: str, source: str) -> str:
    bad = f"(count({column}) - count(DISTINCT {column}))"
    return _line(pos, f"unique:{column}", f"CASE WHEN {bad} = 0 THEN 'PASS' ELSE 'FAIL' END", "0 duplicates",
                 f"{bad} || ' duplicates'", "count(*)", source)


def _in_set(pos: int, column: str, allowed: list[str], source: str) -> str:
    quoted = ", ".join(f"'{a}'" for a in sorted(allowed))
    bad = f"count(*) FILTER (WHERE {column} NOT IN ({quoted}))"
    expected = f"values in {sorted(allowed)}".replace("'", "''")
    return _line(pos, f"in_set:{column}", f"CASE WHEN {bad} = 0 THEN 'PASS' ELSE 'FAIL' END", expected,
                 f"{bad} || ' invalid values'", "count(*)", source)


def _range(pos: int, column: str, low: float, high: float, source: str) -> str:
    bad = f"count(*) FILTER (WHERE {column} < {low} OR {column} > {high})"
    return _line(
        pos, f"range:{column}", f"CASE WHEN {bad} = 0 THEN 'PASS' WHEN {bad} < count(*) * 0.01 THEN 'WARN' ELSE 'FAIL' END",
        f"{low} <= {column} <= {high}", f"{bad} || ' out-of-range values'", "count(*)", source,
    )


def _reference(pos: int, fk: str, pk_name: str, ref: str, pk: str, source: str) -> str:
    bad = f"count(*) FILTER (WHERE {fk} IS NULL OR {fk} NOT IN (SELECT {pk} FROM {ref}))"
    return _line(pos, f"ref_integrity:{fk}→{pk_name}", f"CASE WHEN {bad} = 0 THEN 'PASS' ELSE 'FAIL' END",
                 "all FK values in PK set", f"{bad} || ' orphaned FK values'", "count(*)", source)


_GRADES = ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F", "W", "I", "AU"]
_ENROLLED = with_(LINES.split(",\nscored AS")[0], """enrolled AS (
  SELECT *, l_orderkey || '-' || l_linenumber AS enrollment_id, l_orderkey AS student_id, course_key AS course_id,
    CASE grade_letter WHEN 'W' THEN 'w' WHEN 'I' THEN ' I ' ELSE grade_letter END AS grade FROM lines)""")
_STUDENT_LINES = [
    _min_rows(0, 100, "forms"), _not_null(1, "student_id", 0.0, "forms"), _not_null(2, "email", 0.01, "forms"),
    _not_null(3, "department_id", 0.0, "forms"), _unique(4, "student_id", "forms"), _unique(5, "email", "forms"),
    _in_set(6, "student_type", ["Full-Time", "Part-Time"], "forms"),
]
_STUDENT_REPORT = with_(FORMS) + " UNION ALL ".join(_STUDENT_LINES)
_ATT_SOURCE = with_(ATT, "a AS (SELECT *, student_key AS student_id, course_key AS course_id FROM att)")

_VERSION_COLUMNS = """student_id, first_name, last_name, email, program, major, department_id, student_type, scholarship,
  scholarship_amount, md5(first_name || '|' || last_name || '|' || email || '|' || program || '|' || major || '|'
    || department_id || '|' || student_type || '|' || scholarship::VARCHAR || '|'
    || CAST(scholarship_amount AS DECIMAL(18,2))::VARCHAR) AS row_hash"""


def _versions(name: str, where: str = "") -> str:
    return f"""{name} AS (SELECT {_VERSION_COLUMNS} FROM (SELECT * FROM forms {where}
      QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY enrollment_date DESC, form_id DESC) = 1))"""


def _enrollment_versions(name: str, where: str = "") -> str:
    return f"""{name} AS (
      SELECT enrollment_id, course_key, instructor_key, grade_letter, grade_points, credit_hours, quality_points,
        attendance_pct, assignments_completed, midterm_score, final_score, overall_score, is_passing, is_withdrawn,
        is_incomplete, md5(enrollment_id || '|' || grade_letter || '|' || CAST(attendance_pct AS DECIMAL(9,2))::VARCHAR
          || '|' || CAST(final_score AS DECIMAL(9,2))::VARCHAR) AS row_hash
      FROM (SELECT *, l_orderkey || '-' || l_linenumber AS enrollment_id FROM scored {where})
      QUALIFY row_number() OVER (PARTITION BY enrollment_id ORDER BY l_shipdate DESC, course_key DESC,
        instructor_key DESC, final_score DESC, attendance_pct DESC, midterm_score DESC, grade_letter DESC) = 1)"""


def _attendance_versions(name: str, where: str = "") -> str:
    return f"""{name} AS (SELECT student_key, course_key, date_key, status, is_present, is_excused, minutes_late, source_system
      FROM att {where} QUALIFY row_number() OVER (PARTITION BY student_key, course_key ORDER BY event_time DESC, event_id DESC) = 1)"""


_UPDATED = ("grade_letter", "grade_points", "quality_points", "attendance_pct", "overall_score", "midterm_score",
            "final_score", "is_passing", "is_withdrawn", "is_incomplete", "row_hash")
_KEPT = ("course_key", "instructor_key", "credit_hours", "assignments_completed")

_WINDOWS = f"""windows AS (
  SELECT time_bucket(INTERVAL '5 minutes', event_time) AS window_start,
    time_bucket(INTERVAL '5 minutes', event_time) + INTERVAL '5 minutes' AS window_end, course_key AS course_id,
    count(*) AS total_events, count(*) FILTER (WHERE status = 'PRESENT') AS present_count,
    count(*) FILTER (WHERE status = 'ABSENT') AS absent_count, count(*) FILTER (WHERE status = 'LATE') AS late_count,
    count(DISTINCT student_key) AS unique_students,
    {pct("count(*) FILTER (WHERE status = 'PRESENT')", 'count(*)')} AS attendance_rate
  FROM att GROUP BY 1, 2, 3)"""

_GRANTS = "grants AS (SELECT 'DEPT_' || upper(college) || '_ADMIN' AS role_name, department_id, TRUE AS is_active, department_key FROM dept)"
_MY_DEPT = "(SELECT department_key FROM grants WHERE role_name IN ('DEPT_ASIA_ADMIN', 'DEPT_EUROPE_ADMIN'))"

SQL: dict[str, str] = {
    "attendance_pct": with_(ATT, _ONE_PER_DAY) + f"""SELECT student_key, course_key, academic_year, semester,
      {pct('count(*) FILTER (WHERE is_present)', 'count(*)')} AS actual_pct FROM daily GROUP BY 1, 2, 3, 4""",
    "attendance_summary": with_(ATT, _ATT_DEPT, DEPT) + f"""SELECT department_name, academic_year, semester, month_name, {_COUNTS},
      count(*) FILTER (WHERE status = 'LATE') AS late_count,
      {pct('count(*) FILTER (WHERE is_present)', 'count(*)')} AS attendance_rate_pct,
      {half_up('sum(minutes_late)', 'count(*)', 1)} AS avg_minutes_late,
      count(DISTINCT student_key) AS unique_students, count(DISTINCT course_key) AS unique_courses
      FROM attd JOIN dept USING (department_key) GROUP BY 1, 2, 3, 4""",
    "attendance_kpis": with_(ATT, _ATT_DEPT) + f"""SELECT department_key, {_COUNTS},
      {pct('count(*) FILTER (WHERE is_present)', 'count(*)', 1)} AS attendance_rate FROM attd GROUP BY 1""",
    "attendance_status": with_(ATT) + "SELECT status, count(*) AS count FROM att GROUP BY 1",
    "attendance_daily": with_(ATT) + "SELECT attendance_date, status, count(*) AS count FROM att GROUP BY 1, 2",
    "attendance_weekday": with_(ATT) + f"""SELECT CAST(isodow(attendance_date) AS INTEGER) AS day_of_week,
      {pct('count(*) FILTER (WHERE is_present)', 'count(*)')} AS attendance_rate, dayname(attendance_date) AS weekday
      FROM att WHERE isodow(attendance_date) <= 5 GROUP BY 1, 3""",
    "top_absent_courses": with_(ATT) + """SELECT course_key, count(*) AS absence_count FROM att WHERE status = 'ABSENT'
      GROUP BY 1 ORDER BY absence_count DESC, course_key LIMIT 10""",
    "course_absence": with_(ATT) + f"""SELECT course_key, count(*) AS total_events,
      {big("count(*) FILTER (WHERE status = 'ABSENT')", 'absences')},
      {pct("count(*) FILTER (WHERE status = 'ABSENT')", 'count(*)')} AS absence_rate,
      count(DISTINCT student_key) AS unique_students FROM att GROUP BY 1""",
    "attendance_backfill": with_(PERF, ATT, f"""day AS (
      SELECT *, row_number() OVER (PARTITION BY student_key, course_key, date_key ORDER BY event_time DESC, event_id DESC) AS rn FROM att),
    meeting AS (
      SELECT student_key, course_key, academic_year, semester, is_present FROM day WHERE rn = 1
      UNION ALL SELECT student_key, course_key, academic_year, semester, attendance_pct >= 75 FROM perf WHERE NOT is_withdrawn),
    actual AS (
      SELECT student_key, course_key, academic_year, semester, {pct('count(*) FILTER (WHERE is_present)', 'count(*)')} AS actual_pct
      FROM meeting GROUP BY 1, 2, 3, 4)""")
    + """SELECT student_key, course_key, instructor_key, l_linenumber, l_shipdate, academic_year, semester, grade_letter,
      coalesce(actual_pct, attendance_pct) AS attendance_pct
      FROM perf LEFT JOIN actual USING (student_key, course_key, academic_year, semester)""",
    "clean_students_valid": with_(FORMS, _CHECKED) + _CLEAN,
    "clean_students_rejected": with_(FORMS, _CHECKED)
    + "SELECT form_id, student_id, email, errors AS validation_errors FROM checked WHERE errors <> ''",
    "rejection_rate": with_(FORMS, _CHECKED) + """SELECT count(*) AS row_count, count(*) FILTER (WHERE errors <> '') AS rejected_count,
      round(count(*) FILTER (WHERE errors <> '') * 100.0::DOUBLE / count(*), 1) AS rejection_pct FROM checked""",
    "enriched_grades": with_(LINES) + """SELECT l_orderkey, l_linenumber, grade_letter, grade_points, credit_hours,
      quality_points, is_passing, is_withdrawn, is_incomplete, overall_score FROM scored""",
    "dq_report_students": _STUDENT_REPORT,
    "dq_report_enrollments": _ENROLLED + " UNION ALL ".join([
        _min_rows(0, 500, "enrolled"), _not_null(1, "enrollment_id", 0.0, "enrolled"),
        _not_null(2, "student_id", 0.0, "enrolled"), _not_null(3, "course_id", 0.0, "enrolled"),
        _unique(4, "enrollment_id", "enrolled"), _in_set(5, "grade", _GRADES, "enrolled"),
        _range(6, "attendance_pct", 0, 100, "enrolled"),
        _reference(7, "student_id", "o_orderkey", "orders", "o_orderkey", "enrolled"),
    ]),
    "dq_report_attendance": _ATT_SOURCE + " UNION ALL ".join([
        _min_rows(0, 1000, "a"), _not_null(1, "student_id", 0.0, "a"), _not_null(2, "attendance_date", 0.0, "a"),
        _in_set(3, "status", ["PRESENT", "ABSENT", "LATE", "EXCUSED"], "a"),
    ]),
    "dq_summary": f"""WITH r AS ({_STUDENT_REPORT})
      SELECT 'STG_STUDENTS' AS table_name, count(*) AS total, count(*) FILTER (WHERE result = 'PASS') AS passed,
        count(*) FILTER (WHERE result <> 'PASS') AS failed,
        printf('%.1f%%', count(*) FILTER (WHERE result = 'PASS') * 100.0::DOUBLE / count(*)) AS pass_rate,
        count(*) FILTER (WHERE result = 'FAIL') = 0 AS ok FROM r""",
    "dq_offending_values": with_(FORMS) + """SELECT student_type AS value, count(*) AS count FROM forms
      WHERE student_type NOT IN ('Full-Time', 'Part-Time') GROUP BY 1 ORDER BY 1 LIMIT 5""",
    "dq_range_warn": _range(0, "l_extendedprice", 1000, 100000, "lineitem") + " UNION ALL "
    + _range(1, "l_tax", 0, 0.05, "lineitem"),
    "dq_ref_integrity": _ATT_SOURCE
    + _reference(0, "course_key", "course_key", "part", "p_partkey", "a"),
    "dq_flag_audit": _ATT_SOURCE + " UNION ALL ".join(
        _line(i, flag, f"CASE WHEN count(*) FILTER (WHERE {bad}) = 0 THEN 'PASS' ELSE '{level}' END", "0 violations",
              f"count(*) FILTER (WHERE {bad}) || ' violations'", "count(*)", "a")
        for i, (flag, bad, level) in enumerate([
            ("v_has_student_id", "student_id IS NULL", "FAIL"), ("v_has_course_id", "course_id IS NULL", "FAIL"),
            ("v_valid_date", "attendance_date IS NULL", "FAIL"),
            ("v_valid_status", "status NOT IN ('PRESENT', 'ABSENT', 'LATE', 'EXCUSED')", "FAIL"),
            ("v_is_weekday", "isodow(attendance_date) > 5", "WARN"),
        ])
    ),
    "scd2_student": with_(FORMS, _versions("old", "WHERE enrollment_date < DATE '1999-01-01'"), _versions("new"))
    + """SELECT old.*, DATE '1999-01-01' AS effective_date,
        CASE WHEN old.row_hash <> new.row_hash THEN DATE '2002-01-01' ELSE DATE '9999-12-31' END AS expiry_date,
        NOT coalesce(old.row_hash <> new.row_hash, FALSE) AS is_current
      FROM old LEFT JOIN new USING (student_id)
      UNION ALL
      SELECT new.*, DATE '2002-01-01', DATE '9999-12-31', TRUE FROM new
      WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.student_id = new.student_id AND old.row_hash = new.row_hash)""",
    "upsert_performance": with_(LINES, _enrollment_versions("t", "WHERE l_shipdate < DATE '1999-01-01'"), _enrollment_versions("s"))
    + "SELECT enrollment_id, "
    + ", ".join(f"CASE WHEN t.row_hash IS NULL OR t.row_hash <> s.row_hash THEN s.{c} ELSE t.{c} END AS {c}" for c in _UPDATED)
    + ", " + ", ".join(f"CASE WHEN t.row_hash IS NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in _KEPT)
    + " FROM t FULL JOIN s USING (enrollment_id)",
    "upsert_attendance": with_(ATT, _attendance_versions("t", "WHERE attendance_date < DATE '2024-01-16'"), _attendance_versions("s"))
    + "SELECT student_key, course_key, coalesce(t.date_key, s.date_key) AS date_key, coalesce(t.source_system, s.source_system) AS source_system, "
    + ", ".join(f"CASE WHEN t.status IS NULL OR t.status <> s.status THEN s.{c} ELSE t.{c} END AS {c}"
                for c in ("status", "is_present", "is_excused", "minutes_late"))
    + " FROM t FULL JOIN s USING (student_key, course_key)",
    "insert_only_attendance": with_(ATT, _attendance_versions("t", "WHERE attendance_date < DATE '2024-01-16'"), _attendance_versions("s"))
    + "SELECT * FROM t UNION ALL SELECT * FROM s WHERE (student_key, course_key) NOT IN (SELECT (student_key, course_key) FROM t)",
    "surrogate_keys": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS enrollment_key FROM orders",
    "instructor_lookup": """SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE 1 END AS instructor_key, count(*) AS enrollments
      FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
    "orders_by_calendar": """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date,
      CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
      CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
      CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year,
      CASE WHEN month(d) >= 9 THEN year(d) || '-' || (year(d) + 1) ELSE (year(d) - 1) || '-' || year(d) END AS academic_year,
      (CASE WHEN month(d) >= 9 THEN 'Fall' WHEN month(d) >= 6 THEN 'Summer' ELSE 'Spring' END) || ' ' || year(d) AS semester,
      isodow(d) <= 5 AS is_weekday, FALSE AS is_holiday,
      (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = d) AS enrollments
      FROM (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)""",
    "parameterised_period": with_(SEM) + """SELECT student_key, semester_gpa, avg_attendance_pct FROM sem
      WHERE academic_year = '2000-2001' AND semester = 'Fall 2000' AND semester_gpa >= 3.5""",
    "mask_student_analyst": with_(STUDENT) + """SELECT student_key, student_id, first_name, last_name,
      left(email, 2) || '***@campus.edu' AS email, make_date(year(date_of_birth), 1, 1) AS date_of_birth, program, major,
      department_key, student_type, scholarship, -1.0::DOUBLE AS scholarship_amount, is_current FROM student""",
    "mask_student_portal": with_(STUDENT) + """SELECT student_key, student_id, '***' AS first_name, '***' AS last_name,
      left(email, 2) || '***@campus.edu' AS email, make_date(year(date_of_birth), 1, 1) AS date_of_birth, program, major,
      department_key, student_type, scholarship, -1.0::DOUBLE AS scholarship_amount, is_current FROM student""",
    "rls_fact_dept_admin": with_(SEM, DEPT, _GRANTS)
    + f"SELECT department_key, count(*) AS visible_rows FROM sem WHERE department_key IN {_MY_DEPT} GROUP BY 1",
    "rls_fact_pruned": with_(SEM, DEPT, _GRANTS) + f"SELECT * FROM sem WHERE department_key IN {_MY_DEPT}",
    "rls_fact_instructor": with_(SEM) + """SELECT * FROM sem WHERE department_key IN (
      SELECT s_nationkey FROM supplier WHERE s_name = 'Supplier#000000001' AND s_acctbal > 0)""",
    "rls_student_instructor": with_(STUDENT) + """SELECT student_key, student_id, department_key FROM student
      WHERE student_key IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON s_suppkey = l_suppkey WHERE s_name = 'Supplier#000000001')""",
    "rls_student_dept_admin": with_(STUDENT, DEPT, _GRANTS)
    + f"SELECT student_key, student_id, department_key FROM student WHERE department_key IN {_MY_DEPT}",
    "rls_default_deny_count": "SELECT count(*) AS visible_rows FROM lineitem WHERE FALSE",
    "seeded_grants": with_(DEPT, _GRANTS) + """SELECT role_name, department_id,
      department_key NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -950) AS is_active FROM grants""",
    "attendance_window_batch": with_(ATT, _WINDOWS) + "SELECT *, attendance_rate < 60 AS absence_alert FROM windows",
    "attendance_stream": with_(ATT, _WINDOWS) + "SELECT *, attendance_rate < 60 AS absence_alert FROM windows",
    "attendance_alerts": with_(ATT, _WINDOWS)
    + "SELECT window_start, course_id, attendance_rate FROM windows WHERE attendance_rate < 60",
}

_FACTS = """facts AS (
  SELECT student_key, course_key, (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0) AS instructor_key, department_key,
    date_key, status, is_present, is_excused, minutes_late, source_system
  FROM (SELECT att.* REPLACE (coalesce(minutes_late, 0) AS minutes_late), CAST(c_nationkey AS BIGINT) AS department_key,
          row_number() OVER (PARTITION BY student_key, course_key, date_key ORDER BY status, coalesce(minutes_late, 0), source_system) AS rn
        FROM att JOIN customer ON c_custkey = student_key JOIN part ON p_partkey = course_key
        WHERE isodow(attendance_date) <= 5 AND status IS NOT NULL)
  WHERE rn = 1)"""

_FIRST = "DATE '2001-07-01'"
_CHECKED_FIRST = (
    _CHECKED.replace("latest", "latest1").replace("checked", "checked1").replace("FROM forms", f"FROM forms WHERE enrollment_date < {_FIRST}")
    .replace("DATE '2002-01-01'", _FIRST).replace("> 2003", "> 2002")
)
_LOADED = with_(
    PERF, ATT, FORMS, _CHECKED, _CHECKED_FIRST, f"v1 AS ({_CLEAN.replace('FROM checked ', 'FROM checked1 ')})", f"v2 AS ({_CLEAN})",
    "fresh AS (SELECT * FROM v2 WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.student_id = v2.student_id AND v1.row_hash = v2.row_hash))",
    "ids AS (SELECT student_id FROM v1 UNION SELECT student_id FROM v2)",
    "known AS (SELECT p_partkey FROM part JOIN nation ON n_nationkey = CAST(split_part(p_brand, '#', 2) AS BIGINT) - 1)",
    """met AS (SELECT DISTINCT c_name AS student_id, course_key, date_key FROM att JOIN customer ON c_custkey = student_key
      JOIN known ON p_partkey = course_key WHERE isodow(attendance_date) <= 5 AND status IS NOT NULL)""",
    "present AS (SELECT met.* FROM met JOIN v1 USING (student_id) UNION ALL SELECT met.* FROM met JOIN fresh USING (student_id))",
)

SQL |= {
    "load_two_deliveries": _LOADED + """SELECT 'dim_student' AS table_name, count(*) AS row_count, count(*) AS keys
        FROM (SELECT student_id FROM v1 UNION ALL SELECT student_id FROM fresh)
      UNION ALL SELECT 'dim_student_current', count(*), count(*) FROM ids
      UNION ALL SELECT 'fact_performance', count(DISTINCT l_orderkey || '-' || l_linenumber), count(DISTINCT l_orderkey || '-' || l_linenumber) FROM perf JOIN customer ON c_custkey = student_key JOIN ids ON c_name = ids.student_id
        JOIN known ON p_partkey = course_key
      UNION ALL SELECT 'fact_attendance', count(*), count(DISTINCT course_key) FROM present""",
    "attendance_stream_json": SQL["attendance_stream"].replace("course_id,", "course_id,", 1),
    "attendance_stream_alerts": SQL["attendance_alerts"],
    "csv_round_trip": """SELECT o_orderkey, 'said "' || o_orderpriority || '",' || chr(10) || 'then ' || o_orderstatus AS note,
      CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS amount,
      o_orderstatus = 'P' AS is_corrupt FROM orders""",
    "json_round_trip": """SELECT s_suppkey AS instructor_key, s_name AS instructor_id, CAST(s_nationkey AS BIGINT) AS department_key,
      s_acctbal > 0 AS is_active FROM supplier""",
    "interleaved_table": "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity FROM lineitem",
    "clustered_table": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "staging_reload": """SELECT 'students.csv' AS source_file, TRUE AS is_valid, count(*) AS row_count FROM customer
      UNION ALL SELECT 'attendance.csv', TRUE, 2 * count(*) FROM events""",
    "view_attendance_summary": SQL["attendance_summary"],
    "performance_facts": with_(PERF) + """SELECT p.l_orderkey || '-' || l_linenumber AS enrollment_id, student_key, course_key, instructor_key,
      department_key, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS enrollment_date_key, academic_year, semester, grade_letter, grade_points,
      CAST(1 + p_size % 4 AS INTEGER) AS credit_hours, grade_points * (1 + p_size % 4) AS quality_points, attendance_pct, overall_score, is_passing
      FROM perf p JOIN part ON p_partkey = course_key JOIN orders ON o_orderkey = p.l_orderkey""",
    "attendance_facts": with_(ATT, _FACTS) + "SELECT * FROM facts",
    "student_lookup": """SELECT c_custkey AS student_key, upper(c_name) AS student_id, CAST(c_nationkey AS BIGINT) AS department_key
      FROM customer WHERE upper(c_name) = 'CUSTOMER#000000007'""",
    "department_scope_rows": "SELECT c_custkey AS student_key, CAST(c_nationkey AS BIGINT) AS department_key FROM customer WHERE c_nationkey = 3",
    "rls_student_portal": "SELECT c_custkey AS student_key, c_name AS student_id FROM customer WHERE c_name = 'Customer#000000011'",
    "pii_inventory": """SELECT * FROM (VALUES ('email', 'HIGH'), ('date_of_birth', 'HIGH'), ('first_name', 'MEDIUM'), ('last_name', 'MEDIUM'),
      ('scholarship_amount', 'HIGH')) AS t(column_name, sensitivity), (SELECT count(*) AS filled FROM customer)""",
    "access_log": """SELECT 'dean' AS session_user, 'DEPARTMENT_ADMIN' AS session_role, 'DIM_STUDENT' AS table_name,
      'department grants' AS filter_context, count(*) AS row_count
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""",
    "scd2_null_hash": with_(
        FORMS, _versions("old0", "WHERE enrollment_date < DATE '1999-01-01'"), _versions("new0"),
        "old AS (SELECT * REPLACE (CASE WHEN student_type <> 'Part-Time' THEN row_hash END AS row_hash) FROM old0)",
        "new AS (SELECT * REPLACE (CASE WHEN student_type <> 'Part-Time' THEN row_hash END AS row_hash) FROM new0)",
    )
    + SQL["scd2_student"][SQL["scd2_student"].index("SELECT old.*"):],
}


_ENROLLED_ONCE = """once AS (
  SELECT p.*, c_name AS student_id, CAST(c_nationkey AS VARCHAR) AS department_id, o_orderdate, 1 + p_size % 4 AS credits
  FROM perf p JOIN customer ON c_custkey = student_key JOIN orders ON o_orderkey = p.l_orderkey JOIN part ON p_partkey = course_key
  QUALIFY row_number() OVER (PARTITION BY p.l_orderkey, l_linenumber ORDER BY CAST(course_key AS VARCHAR) DESC, instructor_key DESC,
    final_score DESC, attendance_pct DESC, midterm_score DESC, grade_letter DESC) = 1),
taken AS (
  SELECT * FROM once WHERE course_key IN (SELECT p_partkey FROM known) AND NOT is_withdrawn AND NOT is_incomplete AND grade_points IS NOT NULL)"""


def _gpa_rows(version: int, where: str, effective: str) -> str:
    """Full recompute of the semester and running GPA of the facts a version holds."""
    run = "OVER (PARTITION BY student_id, effective_date ORDER BY academic_year, semester ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT *, least(4.0::DOUBLE, {half_up(
        f"sum({units('semester_gpa', 3)} * credit_hours_attempted) {run}", f"sum(credit_hours_attempted) {run} * 1000", 3
    )}) AS cumulative_gpa, {version} AS version
    FROM (SELECT student_id, {effective} AS effective_date, department_id, academic_year, semester,
      least(4.0::DOUBLE, {half_up(f"sum({units('grade_points * credits', 4)})", "sum(credits) * 10000", 3)}) AS semester_gpa,
      CAST(sum(CASE WHEN is_passing THEN credits ELSE 0 END) AS BIGINT) AS credit_hours_earned, CAST(sum(credits) AS BIGINT) AS credit_hours_attempted,
      count(*) AS courses_taken, count(*) FILTER (WHERE is_passing) AS courses_passed, {mean('attendance_pct', 2, 2)} AS avg_attendance_pct
      FROM taken WHERE {where} GROUP BY ALL)"""


_EARLY = f"o_orderdate < {_FIRST} AND student_id IN (SELECT student_id FROM v1)"
_AUDITED = f"(SELECT count(*) FROM ({_CLEAN}))", "(SELECT count(*) FROM checked WHERE errors <> '')"
SQL |= {
    "published_semester_gpa": _LOADED.rstrip() + ",\n" + _ENROLLED_ONCE + _gpa_rows(1, _EARLY, _FIRST) + " UNION ALL " + _gpa_rows(
        2, "student_id IN (SELECT student_id FROM ids)",
        f"CASE WHEN NOT ({_EARLY}) AND student_id IN (SELECT student_id FROM fresh) THEN DATE '2002-01-01' ELSE {_FIRST} END",
    ),
    "refused_delivery": with_(PERF, FORMS, _CHECKED) + f"""SELECT 'full_load' AS pipeline, 'REFUSED' AS status,
      CAST({_AUDITED[0]} + {_AUDITED[1]} AS BIGINT) AS rows_extracted, 0::BIGINT AS rows_loaded, {_AUDITED[1]} AS rows_rejected,
      (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM perf) AS staged_enrollments, 3::BIGINT AS checked_tables, 0::BIGINT AS merged_facts""",
    "load_quarantine": with_(FORMS, _CHECKED)
    + "SELECT 'students' AS entity_type, form_id, student_id, email, errors AS validation_errors FROM checked WHERE errors <> ''",
}

_DELIVERED = """span AS (SELECT min(epoch_us(event_time)) AS low, max(epoch_us(event_time)) AS high FROM att),
delivered AS (
  SELECT att.*, time_bucket(INTERVAL '5 minutes', event_time) AS slot,
    CAST(floor((epoch_us(event_time) - low) * 4::DOUBLE / (high - low + 1)) AS INTEGER) + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END AS delivery
  FROM att, span),
judged AS (
  SELECT d.*, coalesce(epoch_us(slot) + 300000000 <= (SELECT max(epoch_us(b.event_time)) FROM delivered b WHERE b.delivery < d.delivery) - 600000000, FALSE) AS too_late
  FROM delivered d)"""
_HALF = """(SELECT * FROM (SELECT att.* REPLACE (coalesce(minutes_late, 0) AS minutes_late),
    row_number() OVER (PARTITION BY student_key, course_key, date_key ORDER BY status, coalesce(minutes_late, 0), source_system) AS rn
  FROM att JOIN customer ON c_custkey = student_key JOIN part ON p_partkey = course_key
  WHERE isodow(attendance_date) <= 5 AND status IS NOT NULL AND event_id % 2 = {k}) WHERE rn = 1)"""
SQL |= {
    "stream_with_late_events": with_(ATT, _DELIVERED, _WINDOWS.replace("FROM att", "FROM judged WHERE NOT too_late"))
    + "SELECT *, attendance_rate < 60 AS absence_alert FROM windows",
    "stream_late_events": with_(ATT, _DELIVERED)
    + "SELECT event_id, event_time, course_key AS course_id, delivery AS batch_id FROM judged WHERE too_late",
    "attendance_fact_replay": with_(ATT) + f"""SELECT student_key, course_key, date_key,
      CASE WHEN b.status IS NOT NULL THEN b.status ELSE a.status END AS status,
      CASE WHEN a.status IS NULL OR b.status <> a.status THEN b.minutes_late ELSE a.minutes_late END AS minutes_late
      FROM {_HALF.format(k=0)} a FULL JOIN {_HALF.format(k=1)} b USING (student_key, course_key, date_key)""",
}
