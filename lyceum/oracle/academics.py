"""GPA, rankings, departments, courses, risk and overview."""

from __future__ import annotations

from lyceum.oracle.base import CUM, DEPT, LINES, PERF, SEM, STUDENT, big, half_up, mean, pct, shorten, units, with_

_T = "PARTITION BY student_key ORDER BY academic_year, semester"
_SO_FAR = f"OVER ({_T} ROWS UNBOUNDED PRECEDING)"
_THREE = f"OVER ({_T} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_NAMED = "JOIN student USING (student_key) JOIN dept ON dept.department_key = x.department_key"
_GPA2 = shorten("x.semester_gpa", 3, 2) + " AS semester_gpa"
_CUM2 = shorten("x.cumulative_gpa", 3, 2) + " AS cumulative_gpa"
_ATT1 = shorten("x.avg_attendance_pct", 2, 1) + " AS attendance_pct"
_CURRENT = "academic_year = '2000-2001' AND semester = 'Fall 2000'"

_TOP = """
, changed AS (SELECT *, lag(semester_gpa) OVER (PARTITION BY student_key ORDER BY academic_year, semester) AS prev_semester_gpa
  FROM cum WHERE student_key IN (SELECT student_key FROM student WHERE is_current)
    AND department_key IN (SELECT department_key FROM dept))
, ranked AS (
  SELECT *, CAST(rank() OVER (PARTITION BY department_key, academic_year, semester ORDER BY semester_gpa DESC) AS INTEGER) AS dept_rank,
    CAST(dense_rank() OVER (PARTITION BY academic_year, semester ORDER BY semester_gpa DESC) AS INTEGER) AS overall_rank,
    percent_rank() OVER (PARTITION BY department_key, academic_year, semester ORDER BY semester_gpa) AS dept_percentile
  FROM changed)
SELECT student_id, student_name, program, major, department_name, college, academic_year, semester, semester_gpa,
  cumulative_gpa, credit_hours_earned, avg_attendance_pct, dept_rank, overall_rank,
  round(dept_percentile, 6) AS dept_percentile, prev_semester_gpa,
  round(semester_gpa - coalesce(prev_semester_gpa, semester_gpa), 3) AS gpa_delta,
  CASE WHEN dept_rank = 1 THEN 'Top of Department' WHEN dept_percentile >= 0.9 THEN 'Top 10%'
       WHEN dept_percentile >= 0.75 THEN 'Top 25%' WHEN dept_percentile >= 0.5 THEN 'Above Average'
       ELSE 'Below Average' END AS performance_tier
FROM ranked x JOIN student USING (student_key) JOIN dept ON dept.department_key = x.department_key
WHERE dept_rank <= 10"""

_LATEST = """latest AS (
  SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY student_key ORDER BY academic_year DESC, semester DESC) = 1)"""

_COURSE = f"""count(*) AS enrollment_count, {mean('grade_points', 4, 3)} AS avg_grade_points,
  {mean('overall_score', 2, 2)} AS avg_score, {mean('attendance_pct', 2, 1)} AS avg_attendance,
  round(stddev_samp(grade_points), 3) AS grade_stddev,
  count(*) FILTER (WHERE grade_letter = 'A') AS a_count, count(*) FILTER (WHERE grade_letter = 'B') AS b_count,
  count(*) FILTER (WHERE grade_letter = 'C') AS c_count, count(*) FILTER (WHERE grade_letter = 'D') AS d_count,
  count(*) FILTER (WHERE grade_letter = 'F') AS f_count, count(*) FILTER (WHERE is_withdrawn) AS w_count"""
_TIER = """CASE WHEN avg_grade_points >= 3.5 THEN 'Easy' WHEN avg_grade_points >= 2.5 THEN 'Moderate'
  WHEN avg_grade_points >= 2.0 THEN 'Challenging' ELSE 'Very Hard' END AS difficulty_tier"""
_HARD = """CAST(rank() OVER (PARTITION BY {d}.department_key, academic_year, semester ORDER BY avg_grade_points ASC NULLS LAST) AS INTEGER) AS difficulty_rank"""
_PART = """course AS (
  SELECT p_partkey AS course_key, CAST(p_partkey AS VARCHAR) AS course_id, 'CRS' || p_partkey AS course_code,
         p_name AS course_name, CAST(1 + p_size % 4 AS INTEGER) AS credit_hours, p_type AS level, p_brand AS category,
         CAST(split_part(p_brand, '#', 2) AS BIGINT) - 1 AS department_key FROM part)"""


def _five_parts() -> str:
    def ladder(value: str, op: str, steps: list[tuple[str, int]]) -> str:
        return "CASE " + " ".join(f"WHEN {value} {op} {v} THEN {r}" for v, r in steps) + " ELSE 0 END"

    ratio = "CAST(credit_hours_earned AS DOUBLE) / credit_hours_attempted"
    return f"""
    {ladder('semester_gpa', '<', [('1.0', 30), ('1.5', 25), ('2.0', 20), ('2.5', 12), ('3.0', 5)])} AS gpa_risk_score,
    {ladder('avg_attendance_pct', '<', [('50', 25), ('60', 20), ('70', 15), ('75', 10), ('85', 3)])} AS attendance_risk_score,
    {ladder('semester_gpa - prev_gpa', '<', [('-1.0', 20), ('-0.5', 12), ('-0.25', 6)])} AS gpa_trend_risk_score,
    {ladder(ratio, '<', [('0.5', 15), ('0.7', 8), ('0.85', 3)])} AS credit_completion_risk_score,
    {ladder('low_gpa_semester_count', '>=', [('3', 10), ('2', 6), ('1', 2)])} AS repeat_risk_score"""


_PAGE = """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY department_key, academic_year, semester ORDER BY semester_gpa {order}, student_key) AS INTEGER) AS position
  FROM sem {where})
SELECT x.department_key, academic_year, semester, position, student_id, first_name, last_name, semester_gpa, avg_attendance_pct
FROM ranked x LEFT JOIN student USING (student_key) WHERE position <= 10"""

_LISTING = with_(SEM, STUDENT, _LATEST.format(source="sem"), """listing AS (
  SELECT s.*, l.semester_gpa AS gpa, l.avg_attendance_pct AS attendance_pct,
    coalesce(l.semester_gpa < 2.0 OR l.avg_attendance_pct < 75, FALSE) AS risk_flag
  FROM student s LEFT JOIN latest l USING (student_key))""")

SQL: dict[str, str] = {
    "semester_gpa": with_(SEM) + "SELECT * FROM sem",
    "semester_gpa_ranked": with_(CUM) + """SELECT *,
      CAST(rank() OVER (PARTITION BY department_key, academic_year, semester ORDER BY semester_gpa DESC) AS INTEGER) AS dept_gpa_rank,
      CAST(rank() OVER (PARTITION BY academic_year, semester ORDER BY semester_gpa DESC) AS INTEGER) AS class_gpa_rank
      FROM cum""",
    "cumulative_gpa": with_(CUM) + "SELECT * FROM cum",
    "gpa_pipeline_from_raw": with_(CUM, f"""scores AS (
      SELECT student_key, academic_year, semester, {mean('midterm_score', 2, 2)} AS midterm_avg,
             {mean('final_score', 2, 2)} AS final_avg
      FROM perf WHERE grade_points IS NOT NULL GROUP BY 1, 2, 3)""")
    + """SELECT CAST(student_key AS VARCHAR) AS student_id, c.academic_year, c.semester, midterm_avg, final_avg,
      semester_gpa, credit_hours_earned, credit_hours_attempted, courses_taken, courses_passed, avg_attendance_pct,
      cumulative_gpa FROM cum c JOIN scores USING (student_key, academic_year, semester)""",
    "top_students_by_department": with_(CUM, STUDENT, DEPT) + _TOP,
    "top_students_with_history": with_(CUM, STUDENT.replace("TRUE AS is_current", "c_acctbal >= 0 AS is_current"), DEPT) + _TOP,
    "top_students_by_department_period": with_(CUM, STUDENT, DEPT) + _TOP + " AND " + _CURRENT,
    "deans_list": with_(SEM, STUDENT, DEPT, """good AS (
      SELECT x.*, student_id, student_name, department_name,
        count(*) OVER (PARTITION BY student_key ORDER BY academic_year, semester ROWS UNBOUNDED PRECEDING) AS consecutive_dl_count,
        row_number() OVER (PARTITION BY student_key ORDER BY academic_year DESC, semester DESC) AS rn
      FROM sem x JOIN student USING (student_key) JOIN dept ON dept.department_key = x.department_key
      WHERE semester_gpa >= 3.5 AND student_type = 'Full-Time' AND credit_hours_earned >= 12)""")
    + f"""SELECT student_id, student_name, department_name, academic_year, semester, {_GPA2}, credit_hours_earned,
      consecutive_dl_count, CASE WHEN consecutive_dl_count >= 4 THEN 'Presidential Scholar'
        WHEN consecutive_dl_count >= 2 THEN 'Returning Dean''s List' ELSE 'Dean''s List' END AS honor_tier
      FROM good x WHERE rn = 1""",
    "department_metrics": with_(PERF, DEPT, f"""m AS (
      SELECT department_key, academic_year, semester, count(DISTINCT student_key) AS enrolled_students,
        {mean('grade_points', 4, 3)} AS avg_gpa, quantile_disc(grade_points, 0.5) AS median_gpa,
        round(stddev_samp(grade_points), 3) AS gpa_stddev, {mean('attendance_pct', 2, 2)} AS avg_attendance,
        {big('sum(credit_hours)', 'total_credits_attempted')},
        {big('sum(CASE WHEN is_passing THEN credit_hours ELSE 0 END)', 'total_credits_earned')},
        count(*) FILTER (WHERE is_passing) AS courses_passed, count(*) AS courses_taken,
        count(*) FILTER (WHERE grade_points >= 3.5) AS honors_enrollments,
        count(*) FILTER (WHERE grade_letter = 'F') AS fail_count
      FROM perf WHERE NOT is_withdrawn GROUP BY 1, 2, 3)""", """p AS (
      SELECT *, lag(avg_gpa) OVER (PARTITION BY department_key ORDER BY academic_year, semester) AS prev_avg_gpa FROM m)""")
    + f"""SELECT p.*, {pct('courses_passed', 'courses_taken')} AS pass_rate,
      {pct('total_credits_earned', 'total_credits_attempted')} AS credit_completion_rate,
      {pct('fail_count', 'courses_taken')} AS fail_rate, round(avg_gpa - prev_avg_gpa, 3) AS gpa_delta,
      CAST(rank() OVER (PARTITION BY academic_year, semester ORDER BY avg_gpa DESC) AS INTEGER) AS gpa_rank,
      department_name, college FROM p JOIN dept USING (department_key)""",
    "department_scorecard": with_(SEM, DEPT, f"""m AS (
      SELECT department_key, academic_year, semester, count(DISTINCT student_key) AS enrolled_students,
        {mean('semester_gpa', 3, 3)} AS avg_gpa,
        {half_up(f"quantile_disc({units('semester_gpa', 3)}, 0.5) + CAST(round(2 * median({units('semester_gpa', 3)})) AS BIGINT) - quantile_disc({units('semester_gpa', 3)}, 0.5)", '2000', 3)} AS median_gpa,
        round(stddev_samp(semester_gpa), 3) AS gpa_stddev, {mean('avg_attendance_pct', 2, 2)} AS avg_attendance,
        {pct('sum(courses_passed)', 'sum(courses_taken)')} AS pass_rate,
        {pct('sum(credit_hours_earned)', 'sum(credit_hours_attempted)')} AS credit_completion_rate,
        {pct('count(*) FILTER (WHERE semester_gpa >= 3.5)', 'count(*)')} AS honors_rate,
        {pct('count(*) FILTER (WHERE semester_gpa < 2.0)', 'count(*)')} AS probation_rate
      FROM sem GROUP BY 1, 2, 3)""", """p AS (
      SELECT *, round(avg_gpa - coalesce(lag(avg_gpa) OVER (PARTITION BY department_key ORDER BY academic_year, semester), avg_gpa), 3) AS gpa_delta
      FROM m JOIN dept USING (department_key))""")
    + f"""SELECT CAST(rank() OVER (PARTITION BY academic_year, semester ORDER BY avg_gpa DESC) AS INTEGER) AS overall_rank,
      department_name, college, academic_year, semester, enrolled_students, avg_gpa, median_gpa, gpa_stddev,
      {shorten('avg_attendance', 2, 1)} AS avg_attendance_pct, pass_rate, credit_completion_rate, honors_rate,
      probation_rate, gpa_delta,
      CASE WHEN gpa_delta > 0.1 THEN 'Improving' WHEN gpa_delta < -0.1 THEN 'Declining' ELSE 'Stable' END AS trend,
      {half_up(f"{units('avg_gpa', 4)} * 40 + {units('avg_attendance', 4)} * 2 + {units('pass_rate', 4)} + 1000000 - {units('probation_rate', 4)}", '1000000', 2)} AS performance_score,
      CAST(rank() OVER (PARTITION BY college, academic_year, semester ORDER BY avg_gpa DESC) AS INTEGER) AS college_gpa_rank,
      CAST(rank() OVER (PARTITION BY academic_year, semester ORDER BY avg_attendance DESC) AS INTEGER) AS attendance_rank,
      CAST(rank() OVER (PARTITION BY academic_year, semester ORDER BY pass_rate DESC) AS INTEGER) AS pass_rate_rank,
      CAST(rank() OVER (PARTITION BY academic_year, semester ORDER BY honors_rate DESC) AS INTEGER) AS honors_rank
      FROM p""",
    "course_difficulty": with_(PERF, DEPT, _PART, f"""stats AS (
      SELECT course_key, academic_year, semester, {_COURSE} FROM perf GROUP BY 1, 2, 3)""")
    + f"""SELECT course_key, c.department_key, academic_year, semester, enrollment_count, avg_grade_points, avg_score,
      avg_attendance, grade_stddev, f_count, w_count, {pct('f_count', 'enrollment_count', 1)} AS fail_rate,
      {pct('w_count', 'enrollment_count', 1)} AS withdrawal_rate, course_code, course_name, credit_hours, level, category,
      department_name, {_HARD.format(d='c')}, {_TIER}
      FROM stats JOIN course c USING (course_key) JOIN dept ON dept.department_key = c.department_key""",
    "course_grade_buckets": with_(PERF, DEPT, _PART, f"""stats AS (
      SELECT course_key, department_key, academic_year, semester, {_COURSE} FROM perf GROUP BY 1, 2, 3, 4)""")
    + f"""SELECT course_code, course_name, department_name, level, academic_year, semester, enrollment_count,
      avg_grade_points, avg_score, avg_attendance, a_count, b_count, c_count, d_count, f_count, w_count,
      {pct('f_count', 'enrollment_count', 1)} AS fail_rate, {pct('w_count', 'enrollment_count', 1)} AS withdrawal_rate,
      {_HARD.format(d='s')}, {_TIER}
      FROM stats s JOIN course USING (course_key) JOIN dept ON dept.department_key = s.department_key""",
    "dept_avg_gpa": with_(SEM, DEPT) + f"""SELECT department_id, academic_year, semester, {mean('semester_gpa', 3, 2)} AS avg_gpa
      FROM sem JOIN dept USING (department_key) GROUP BY 1, 2, 3""",
    "department_summary": with_(SEM, DEPT) + f"""SELECT department_id, academic_year, semester,
      {mean('semester_gpa', 3, 2)} AS avg_gpa, count(*) AS student_count
      FROM sem JOIN dept USING (department_key) GROUP BY 1, 2, 3""",
    "department_trend": with_(CUM) + f"""SELECT department_key, academic_year, semester,
      {mean('semester_gpa', 3, 3)} AS semester_gpa, {mean('cumulative_gpa', 3, 3)} AS cumulative_gpa
      FROM cum GROUP BY 1, 2, 3""",
    "department_page_top": with_(SEM, STUDENT, _PAGE.format(order="DESC", where="")),
    "department_page_risk": with_(
        SEM, STUDENT, _PAGE.format(order="ASC", where="WHERE semester_gpa < 2.5 OR avg_attendance_pct < 75")
    ),
    "department_page_kpis": with_(SEM, DEPT, _PART, f"""means AS (
      SELECT department_key, {mean('semester_gpa', 3, 2)} AS avg_gpa, {mean('avg_attendance_pct', 2, 1)} AS avg_attendance
      FROM sem WHERE {_CURRENT} GROUP BY 1)""")
    + """SELECT department_id, (SELECT count(*) FROM customer WHERE c_nationkey = d.department_key) AS students, avg_gpa,
      avg_attendance, (SELECT count(*) FROM course c WHERE c.department_key = d.department_key) AS courses_offered
      FROM dept d LEFT JOIN means USING (department_key)""",
    "department_stats": with_(SEM, DEPT, f"""means AS (
      SELECT department_key, {mean('semester_gpa', 3, 2)} AS avg_gpa, {mean('avg_attendance_pct', 2, 1)} AS avg_attendance_pct
      FROM sem GROUP BY 1)""", """heads AS (
      SELECT d.*, (SELECT count(*) FROM customer WHERE c_nationkey = d.department_key) AS student_count,
        (SELECT count(*) FROM supplier WHERE s_nationkey = d.department_key) AS faculty_count FROM dept d)""")
    + f"""SELECT department_id, department_name AS name, avg_gpa, avg_attendance_pct, student_count, faculty_count,
      {half_up('student_count', 'faculty_count', 2)} AS student_faculty_ratio
      FROM heads LEFT JOIN means USING (department_key)""",
    "dept_attendance_below_75": with_(SEM, DEPT) + f"""SELECT department_id, department_name,
      {mean('avg_attendance_pct', 2, 1)} AS avg_attendance_pct,
      count(*) FILTER (WHERE avg_attendance_pct < 75) AS below_75_pct_count
      FROM sem JOIN dept USING (department_key) GROUP BY 1, 2""",
    "department_courses": with_(DEPT, _PART) + """SELECT department_id, course_id, course_code, course_name, credit_hours,
      level, category FROM course JOIN dept USING (department_key)""",
    "risk_early_warning": with_(CUM, STUDENT, DEPT, f"""x AS (
      SELECT *, least(100, CASE WHEN semester_gpa < 2.0 THEN 40 ELSE 0 END + CASE WHEN semester_gpa < 2.5 THEN 20 ELSE 0 END
        + CASE WHEN avg_attendance_pct < 60 THEN 30 ELSE 0 END + CASE WHEN avg_attendance_pct < 75 THEN 15 ELSE 0 END
        + CASE WHEN semester_gpa < CAST(sum({units('semester_gpa', 3)}) {_THREE} AS DOUBLE) / (count(semester_gpa) {_THREE} * 1000) - 0.5 THEN 15 ELSE 0 END
        + CASE WHEN credit_hours_earned < credit_hours_attempted * 0.75 THEN 10 ELSE 0 END) AS risk_score
      FROM cum)""")
    + f"""SELECT student_id, student_name, department_name, program, academic_year, semester, {_GPA2}, {_CUM2}, {_ATT1},
      CAST(risk_score AS INTEGER) AS risk_score,
      CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM'
           ELSE 'LOW' END AS risk_level
      FROM x {_NAMED} WHERE risk_score >= 30""",
    "risk_scoring": with_(CUM, STUDENT, DEPT, f"""h AS (
      SELECT *, lag(semester_gpa) OVER ({_T}) AS prev_gpa,
        {half_up(f"sum({units('semester_gpa', 3)}) {_THREE}", f"count(semester_gpa) {_THREE} * 1000", 2)} AS rolling_3sem_avg_gpa,
        count(*) FILTER (WHERE semester_gpa < 2.0) {_SO_FAR} AS low_gpa_semester_count,
        count(*) FILTER (WHERE avg_attendance_pct < 75) {_SO_FAR} AS low_attendance_semester_count,
        CAST(row_number() OVER ({_T}) AS INTEGER) AS semester_sequence
      FROM cum)""", f"p AS (SELECT *, {_five_parts()} FROM h)", """x AS (
      SELECT *, CAST(least(100, gpa_risk_score + attendance_risk_score + gpa_trend_risk_score + credit_completion_risk_score
        + repeat_risk_score) AS INTEGER) AS total_risk_score FROM p)""")
    + f"""SELECT student_id, student_name, program, major, student_type, department_name, college, academic_year, semester,
      {_GPA2}, {_CUM2}, {_ATT1}, credit_hours_earned, credit_hours_attempted,
      {pct('credit_hours_earned', 'credit_hours_attempted', 1)} AS credit_completion_pct, courses_passed, courses_taken,
      {shorten('prev_gpa', 3, 2)} AS prev_semester_gpa, rolling_3sem_avg_gpa, low_gpa_semester_count,
      low_attendance_semester_count, semester_sequence, gpa_risk_score, attendance_risk_score, gpa_trend_risk_score,
      credit_completion_risk_score, repeat_risk_score, total_risk_score,
      CASE WHEN total_risk_score >= 65 THEN 'CRITICAL' WHEN total_risk_score >= 45 THEN 'HIGH'
           WHEN total_risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
      CASE WHEN gpa_risk_score >= 20 THEN 'Low GPA' WHEN attendance_risk_score >= 15 THEN 'Poor Attendance'
           WHEN gpa_trend_risk_score >= 12 THEN 'Declining GPA Trend'
           WHEN credit_completion_risk_score >= 8 THEN 'Low Credit Completion'
           WHEN repeat_risk_score >= 6 THEN 'Repeated Academic Issues' ELSE 'Combined Risk Factors' END AS primary_risk_reason,
      CASE WHEN gpa_risk_score >= 20 AND attendance_risk_score >= 15 THEN 'Urgent: Academic + Attendance Intervention Required'
           WHEN gpa_risk_score >= 20 THEN 'Schedule Academic Counseling & Tutoring Support'
           WHEN attendance_risk_score >= 15 THEN 'Contact Student – Attendance Policy Warning'
           WHEN gpa_trend_risk_score >= 12 THEN 'Monitor Closely – Schedule Check-in with Advisor'
           WHEN repeat_risk_score >= 6 THEN 'Academic Probation Review – Dean Notification'
           ELSE 'Advisor Outreach Recommended' END AS recommended_action
      FROM x {_NAMED} WHERE total_risk_score >= 25""",
    "student_look_backs": with_(CUM) + f"""SELECT student_key, department_key, academic_year, semester, semester_gpa, cumulative_gpa,
      avg_attendance_pct, lag(semester_gpa) OVER ({_T}) AS prev_gpa_1sem, lag(semester_gpa, 2) OVER ({_T}) AS prev_gpa_2sem,
      lag(avg_attendance_pct) OVER ({_T}) AS prev_attendance_1sem,
      {half_up(f"sum({units('semester_gpa', 3)}) {_THREE}", f"count(semester_gpa) {_THREE} * 1000", 2)} AS rolling_3sem_gpa,
      {half_up(f"sum({units('avg_attendance_pct', 2)}) {_THREE}", f"count(avg_attendance_pct) {_THREE} * 100", 2)} AS rolling_3sem_attendance,
      count(*) FILTER (WHERE semester_gpa < 2.0) {_SO_FAR} AS low_gpa_semester_count,
      count(*) FILTER (WHERE avg_attendance_pct < 75) {_SO_FAR} AS low_attendance_semester_count,
      CAST(row_number() OVER ({_T}) AS INTEGER) AS semester_sequence FROM cum""",
    "probation": with_(CUM, STUDENT, DEPT, f"""x AS (
      SELECT *, count(*) OVER ({_T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_low_gpa_semesters
      FROM cum WHERE semester_gpa < 2.0)""")
    + f"""SELECT student_id, student_name, program, department_name, academic_year, semester, {_GPA2}, {_CUM2},
      credit_hours_attempted, credit_hours_earned, {_ATT1}, prior_low_gpa_semesters,
      CASE WHEN cumulative_gpa < 2.0 THEN 'Academic Suspension Candidate' ELSE 'Academic Probation' END AS probation_status
      FROM x {_NAMED}""",
    "scholarship_at_risk": with_(SEM, STUDENT, DEPT)
    + f"""SELECT student_id, student_name, program, department_name, scholarship_amount, academic_year, semester, {_GPA2},
      semester_gpa < 3.0 AS below_scholarship_threshold,
      CASE WHEN x.semester_gpa < 3.0 THEN 'Scholarship at risk — GPA below 3.0 minimum' ELSE 'Scholarship maintained' END AS scholarship_status
      FROM sem x {_NAMED} WHERE scholarship""".replace("semester_gpa < 3.0 AS below", "x.semester_gpa < 3.0 AS below"),
    "dropout_signal": with_(SEM, STUDENT, DEPT, _LATEST.format(source="sem"))
    + f"""SELECT student_id, student_name, department_name, academic_year AS last_enrolled_year,
      semester AS last_enrolled_semester, {shorten('semester_gpa', 3, 2)} AS last_semester_gpa,
      'Potential Dropout – No Recent Enrollment' AS flag
      FROM latest JOIN student USING (student_key) JOIN dept ON dept.department_key = student.department_key
      WHERE academic_year < '2000-2001'""",
    "risk_profile": with_(SEM, STUDENT) + """SELECT student_id, program, x.department_key, academic_year, semester, semester_gpa,
      avg_attendance_pct, CASE WHEN semester_gpa < 2.0 OR avg_attendance_pct < 60 THEN 'Critical'
        WHEN semester_gpa < 2.5 OR avg_attendance_pct < 75 THEN 'At Risk' WHEN semester_gpa >= 3.5 THEN 'Honors'
        ELSE 'Normal' END AS risk FROM sem x JOIN student USING (student_key)""",
    "at_risk_period": with_(SEM, STUDENT) + """SELECT student_id, academic_year, semester, semester_gpa, avg_attendance_pct
      FROM sem JOIN student USING (student_key) WHERE semester_gpa <= 2.0 OR avg_attendance_pct <= 75""",
    "university_risk_summary": with_(SEM, _LATEST.format(source="sem")) + f"""SELECT count(*) AS total_students,
      count(*) FILTER (WHERE semester_gpa < 2.0 OR avg_attendance_pct < 75) AS at_risk_count,
      {pct('count(*) FILTER (WHERE semester_gpa < 2.0 OR avg_attendance_pct < 75)', 'count(*)', 1)} AS at_risk_pct,
      count(*) FILTER (WHERE semester_gpa < 2.0) AS low_gpa_count,
      count(*) FILTER (WHERE avg_attendance_pct < 75) AS low_attendance_count FROM latest""",
    "kpi_overview": with_(SEM) + f"""SELECT academic_year, semester, {mean('semester_gpa', 3, 2)} AS avg_gpa,
      {mean('avg_attendance_pct', 2, 1)} AS avg_attendance, count(*) FILTER (WHERE semester_gpa < 2.0) AS at_risk_count,
      count(*) FILTER (WHERE semester_gpa >= 3.5) AS honors_count,
      {half_up('sum(courses_passed) * 100', 'greatest(sum(courses_taken), 1)', 1)} AS pass_rate,
      (SELECT count(DISTINCT student_key) FROM sem) AS total_students FROM sem GROUP BY 1, 2""",
    "kpi_mean_of_means": with_(SEM, f"a AS (SELECT {mean('semester_gpa', 3, 2)} AS g FROM sem GROUP BY academic_year, semester)",
      f"b AS (SELECT {mean('avg_attendance_pct', 2, 1)} AS t FROM sem GROUP BY department_key)")
    + f"""SELECT (SELECT {mean('g', 2, 2)} FROM a) AS overall_avg_gpa, (SELECT {mean('t', 1, 2)} FROM b) AS overall_avg_attendance_pct,
      (SELECT count(*) FROM b) AS departments_count""",
    "gpa_by_semester": with_(SEM)
    + f"SELECT academic_year, semester, {mean('semester_gpa', 3, 2)} AS avg_gpa FROM sem GROUP BY 1, 2",
    "gpa_histogram": with_(SEM) + f"""SELECT bin, count(*) AS count, (bin - 1) / 10.0::DOUBLE AS bin_start, bin / 10.0::DOUBLE AS bin_end
      FROM (SELECT CAST(least(40, {units('semester_gpa', 3)} // 100 + 1) AS INTEGER) AS bin FROM sem) GROUP BY bin""",
    "grade_distribution": with_(LINES) + """SELECT grade_letter, count(*) AS count,
      CAST(coalesce(list_position(['A+','A','A-','B+','B','B-','C+','C','C-','D','F','W','I'], grade_letter), 14) AS INTEGER) AS position
      FROM lines GROUP BY grade_letter""",
    "attendance_heatmap": with_(SEM, DEPT) + f"""SELECT department_id, semester, {mean('avg_attendance_pct', 2, 1)} AS attendance
      FROM sem JOIN dept USING (department_key) GROUP BY department_id, semester""",
    "student_profile": with_(CUM, STUDENT, DEPT, _LATEST.format(source="cum"))
    + """SELECT s.student_key, student_id, first_name, last_name, program, student_type, department_name,
      l.academic_year AS latest_academic_year, l.semester AS latest_semester, l.semester_gpa AS latest_semester_gpa,
      cumulative_gpa, l.avg_attendance_pct AS latest_attendance_pct
      FROM student s JOIN dept USING (department_key) LEFT JOIN latest l USING (student_key)""",
    "gpa_trend": with_(CUM, STUDENT) + f"""SELECT student_id, academic_year, semester,
      CAST(row_number() OVER ({_T}) AS INTEGER) AS position, semester_gpa, cumulative_gpa
      FROM cum JOIN student USING (student_key)""",
    "enrollment_history": with_(PERF, STUDENT) + """SELECT student_id, academic_year, semester, course_key, grade_letter,
      attendance_pct, midterm_score, final_score FROM perf JOIN student USING (student_key)""",
    "top_students_period": with_(SEM, STUDENT) + f"""SELECT student_id, first_name, last_name, academic_year, semester,
      semester_gpa, avg_attendance_pct FROM sem JOIN student USING (student_key) WHERE {_CURRENT}
      ORDER BY semester_gpa DESC, student_key LIMIT 10""",
    "student_list_page": _LISTING + """SELECT student_id, left(email, 2) || '***@campus.edu' AS email, department_key,
      student_type, gpa, attendance_pct, risk_flag, (SELECT count(*) FROM listing) AS total
      FROM listing ORDER BY student_id LIMIT 50 OFFSET 100""",
    "student_risk_factors": _LISTING + """SELECT student_id, risk_flag,
      concat_ws('; ', CASE WHEN gpa < 2.0 THEN 'Low GPA (below 2.0)' END,
        CASE WHEN attendance_pct < 75 THEN 'Low attendance (below 75%)' END) AS risk_factors, gpa, attendance_pct
      FROM listing""",
    "gpa_tier_filter": with_(SEM) + """SELECT *, 'average' AS gpa_tier FROM sem
      WHERE semester_gpa BETWEEN 2.5 AND 3.5 AND semester_gpa < 3.0 AND avg_attendance_pct BETWEEN 60 AND 90""",
}

SQL |= {
    "scholarship_ranks": with_(STUDENT) + """SELECT student_key, department_key, scholarship_amount,
      rank() OVER (ORDER BY scholarship_amount DESC) AS overall_rank, dense_rank() OVER (ORDER BY scholarship_amount DESC) AS overall_dense,
      rank() OVER (PARTITION BY department_key ORDER BY scholarship_amount DESC) AS dept_rank,
      dense_rank() OVER (PARTITION BY department_key ORDER BY scholarship_amount DESC) AS dept_dense FROM student""",
    "student_pages": with_(STUDENT) + """, placed AS (
      SELECT student_key, student_id, scholarship_amount, row_number() OVER (ORDER BY scholarship_amount DESC, student_key) - 1 AS place,
        count(*) OVER () * 3 // 4 AS deep FROM student)
      SELECT student_key, student_id, scholarship_amount, CASE WHEN place < 50 THEN 0 ELSE deep END AS page_offset FROM placed WHERE place < 50
      UNION ALL SELECT student_key, student_id, scholarship_amount, deep FROM placed WHERE place >= deep AND place < deep + 50 AND place >= 50""",
}
