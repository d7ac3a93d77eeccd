"""The domain views again, as DuckDB SQL, for the independent oracle.

``with_views(body)`` prefixes a query body with the CTEs it mentions (and
their dependencies).  These texts are written separately from the Spark
DataFrame code in :mod:`edusignal.sources.fixtures` on purpose: the oracle
must not share code with the engine it checks.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "enrollments": ((), """
    SELECT c.c_custkey AS user_id, c.c_mktsegment AS course_id, c.c_custkey AS enrollment_id,
           c.c_name AS username,
           CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE 'u' || CAST(c.c_custkey AS VARCHAR) || '@example.org' END AS email,
           c.c_name AS full_name,
           CASE WHEN c.c_custkey % 3 = 0 THEN '' ELSE 'VN ' || c.c_name END AS full_name_vn,
           'S' || CAST(c.c_custkey AS VARCHAR) AS mssv,
           'K' || CAST(c.c_custkey % 9 AS VARCHAR) AS class_code,
           'dept_' || CAST(c.c_nationkey AS VARCHAR) AS department,
           CASE WHEN c.c_custkey % 4 = 0 THEN 'verified' ELSE 'audit' END AS mode,
           c.c_acctbal >= 0 AS is_active,
           fo.created
    FROM customer c
    LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS created FROM orders GROUP BY o_custkey) fo
      ON c.c_custkey = fo.o_custkey"""),
    "h5p_scores": ((), """
    SELECT c.c_custkey AS user_id, c.c_mktsegment AS course_id,
           l.l_partkey % 50 AS content_id,
           'content ' || CAST(l.l_partkey % 50 AS VARCHAR) AS content_title,
           (l.l_partkey % 50) % 7 AS folder_id,
           'folder ' || CAST((l.l_partkey % 50) % 7 AS VARCHAR) AS folder_name,
           CAST(TRUNC(l.l_quantity) AS BIGINT) AS score,
           CAST(50 AS BIGINT) AS max_score,
           CAST(l.l_quantity * 2 AS DECIMAL(5,2)) AS percentage,
           CAST(epoch(o.o_orderdate) AS BIGINT) AS opened,
           CASE WHEN l.l_returnflag = 'N' THEN CAST(0 AS BIGINT)
                ELSE CAST(epoch(l.l_shipdate) AS BIGINT) END AS finished,
           CAST(FLOOR(l.l_extendedprice) AS BIGINT) AS time_spent
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey"""),
    "video_progress": ((), """
    SELECT c.c_custkey AS user_id, c.c_mktsegment AS course_id,
           o.o_orderkey % 40 AS content_id,
           'video ' || CAST(o.o_orderkey % 40 AS VARCHAR) AS content_title,
           CAST((o.o_orderkey * 31) % 101 AS DECIMAL(5,2)) AS progress_percent,
           CAST(FLOOR((600 + o.o_orderkey % 600) * ((o.o_orderkey * 31) % 101) / 100) AS BIGINT) AS "current_time",
           CAST(600 + o.o_orderkey % 600 AS BIGINT) AS duration,
           CASE WHEN (o.o_orderkey * 31) % 101 = 100 THEN 'completed'
                WHEN (o.o_orderkey * 31) % 101 = 0 THEN 'not_started' ELSE 'in_progress' END AS status,
           (o.o_orderkey % 40) % 5 AS folder_id,
           'chapter ' || CAST((o.o_orderkey % 40) % 5 AS VARCHAR) AS folder_name
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""),
    "mooc_grades": ((), """
    SELECT c_custkey AS user_id, c_mktsegment AS course_id, c_name AS username,
           'g' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email,
           'G ' || c_name AS full_name,
           CAST((c_custkey * 37) % 101 AS DECIMAL(5,2)) AS grade_percentage,
           CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 37) % 101 >= 50 END AS is_passed,
           CASE WHEN c_custkey % 17 = 0 THEN 'Fail?' WHEN (c_custkey * 37) % 101 >= 50 THEN 'Pass'
                ELSE '' END AS letter_grade
    FROM customer WHERE c_custkey % 13 <> 0"""),
    "mooc_progress": ((), """
    SELECT c.c_custkey AS user_id, c.c_mktsegment AS course_id,
           CAST(100 AS BIGINT) AS total_blocks,
           CAST((c.c_custkey * 53) % 101 AS BIGINT) AS completed_blocks,
           CAST((c.c_custkey * 53) % 101 AS DECIMAL(5,2)) AS progress_percent,
           CAST((c.c_custkey * 53) % 101 AS DECIMAL(5,2)) AS completion_rate,
           la.last_activity
    FROM customer c
    LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS last_activity FROM orders
               WHERE o_orderstatus <> 'P' GROUP BY o_custkey) la ON c.c_custkey = la.o_custkey
    WHERE c.c_custkey % 19 <> 0"""),
    "mooc_discussions": ((), """
    SELECT c.c_custkey AS user_id, c.c_mktsegment AS course_id, c.c_name AS username,
           a.threads_count, a.comments_count,
           a.threads_count + a.comments_count AS total_interactions,
           CAST(0 AS BIGINT) AS questions_count, CAST(0 AS BIGINT) AS total_upvotes
    FROM (SELECT o_custkey,
                 COUNT(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS threads_count,
                 COUNT(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS comments_count
          FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey) a
    JOIN customer c ON a.o_custkey = c.c_custkey"""),
    "predictions": ((), f"""
    SELECT c.c_custkey * 3 + v.v AS id, c.c_custkey AS user_id, c.c_mktsegment AS course_id,
           'model_' || CAST(v.v AS VARCHAR) AS model_name,
           'v' || CAST(v.v AS VARCHAR) AS model_version,
           CAST(CAST(((c.c_custkey * 7919 + v.v * 1013) % 10001) / 100 AS DECIMAL(5,2)) AS DOUBLE) AS fail_risk_score,
           CASE WHEN CAST(((c.c_custkey * 7919 + v.v * 1013) % 10001) / 100 AS DECIMAL(5,2)) >= 70 THEN 'HIGH'
                WHEN CAST(((c.c_custkey * 7919 + v.v * 1013) % 10001) / 100 AS DECIMAL(5,2)) >= 40 THEN 'MEDIUM'
                ELSE 'LOW' END AS risk_level,
           CAST(NULL AS DOUBLE) AS snapshot_grade, CAST(NULL AS DOUBLE) AS snapshot_completion_rate,
           CAST(NULL AS BIGINT) AS snapshot_days_inactive,
           {AS_OF} - (2 - v.v) * INTERVAL 1 DAY AS predicted_at,
           v.v = 2 AS is_latest
    FROM customer c CROSS JOIN (VALUES (0), (1), (2)) v(v)
    WHERE c.c_custkey % 5 <> 0"""),
    "h5p_rollup": (("h5p_scores",), """
    SELECT user_id, course_id,
           COUNT(DISTINCT content_id) AS total_contents,
           COUNT(DISTINCT CASE WHEN percentage >= 70 THEN content_id END) AS completed_contents,
           SUM(score) AS total_score, SUM(max_score) AS total_max_score,
           AVG(CAST(percentage AS DOUBLE)) AS avg_percentage,
           SUM(time_spent) AS total_time_spent
    FROM h5p_scores GROUP BY user_id, course_id"""),
    "video_rollup": (("video_progress",), """
    SELECT user_id, course_id, COUNT(DISTINCT content_id) AS total_videos,
           COUNT(DISTINCT CASE WHEN progress_percent >= 100 THEN content_id END) AS completed_videos
    FROM video_progress GROUP BY user_id, course_id"""),
    "student_features": (("enrollments", "mooc_grades", "h5p_rollup", "video_rollup",
                          "mooc_progress", "mooc_discussions"), f"""
    SELECT e.user_id, e.course_id, e.mode AS enrollment_mode, e.is_active,
           CASE WHEN e.created IS NULL THEN NULL ELSE
             GREATEST(CAST(0 AS BIGINT), CAST(FLOOR((epoch({AS_OF}) - epoch(e.created)) / 604800) AS BIGINT)) END
             AS weeks_since_enrollment,
           COALESCE(CAST(g.grade_percentage AS DOUBLE), 0.0) AS mooc_grade_percentage,
           g.letter_grade AS mooc_letter_grade,
           g.is_passed AS mooc_is_passed,
           CAST(COALESCE(h.total_contents, 0) AS BIGINT) AS h5p_total_contents,
           CAST(COALESCE(h.completed_contents, 0) AS BIGINT) AS h5p_completed_contents,
           CAST(COALESCE(h.total_score, 0) AS BIGINT) AS h5p_total_score,
           CAST(COALESCE(h.total_max_score, 0) AS BIGINT) AS h5p_total_max_score,
           COALESCE(h.avg_percentage, 0.0) AS h5p_overall_percentage,
           CAST(COALESCE(h.total_time_spent, 0) AS BIGINT) AS h5p_total_time_spent,
           CAST(CASE WHEN h.total_contents > 0 THEN h.completed_contents * 100.0 / h.total_contents
                ELSE 0.0 END AS DOUBLE) AS h5p_completion_rate,
           CAST(mp.completion_rate AS DOUBLE) AS mooc_completion_rate,
           CASE WHEN mp.last_activity IS NULL THEN CAST(999 AS BIGINT)
                ELSE CAST(FLOOR((epoch({AS_OF}) - epoch(mp.last_activity)) / 86400) AS BIGINT) END
             AS days_since_last_activity,
           CAST(CASE WHEN vr.total_videos > 0
                THEN ROUND(CAST(vr.completed_videos AS DECIMAL(18,0)) * 100.0 / vr.total_videos, 2)
                ELSE 0.0 END AS DOUBLE) AS video_completion_rate,
           COALESCE(h.avg_percentage, 0.0) AS quiz_avg_score,
           CAST(COALESCE(d.threads_count, 0) AS BIGINT) AS discussion_threads_count
    FROM enrollments e
    LEFT JOIN mooc_grades g ON e.user_id = g.user_id AND e.course_id = g.course_id
    LEFT JOIN h5p_rollup h ON e.user_id = h.user_id AND e.course_id = h.course_id
    LEFT JOIN video_rollup vr ON e.user_id = vr.user_id AND e.course_id = vr.course_id
    LEFT JOIN mooc_progress mp ON e.user_id = mp.user_id AND e.course_id = mp.course_id
    LEFT JOIN mooc_discussions d ON e.user_id = d.user_id AND e.course_id = d.course_id"""),
    "activity": ((), """
    SELECT ev.event_id, ev.ts, ev.user_id, COALESCE(c.c_mktsegment, 'UNASSIGNED') AS course_id,
           ev.event_type,
           CASE ev.event_type WHEN 'click' THEN 'problem_attempt' WHEN 'purchase' THEN 'problem_correct'
                WHEN 'view' THEN 'video_view' WHEN 'signup' THEN 'discussion_post'
                WHEN 'error' THEN 'discussion_reply' END AS action,
           LEAST(ev.value, 100.0) AS score,
           CAST(json_extract_string(ev.props, '$.k') AS BIGINT) AS item
    FROM events ev LEFT JOIN customer c ON ev.user_id = c.c_custkey"""),
    # One row per student of the feature table: the names and addresses that count,
    # chosen from lists of candidates.
    "student_names": (("student_features", "enrollments", "mooc_grades"), """
    SELECT k.user_id, k.course_id, en.username, en.mssv,
           list_filter(list_transform([en.full_name_vn, en.full_name, gr.full_name], lambda x: trim(x)), lambda x: x <> '')[1] AS shown_name,
           list_filter(list_transform([en.full_name_vn, en.full_name], lambda x: trim(x)), lambda x: x <> '')[1] AS enrolled_name,
           list_filter([trim(en.email)], lambda x: x <> '')[1] AS enrolled_mail, gr.email AS sheet_mail
    FROM student_features k
    LEFT JOIN enrollments en USING (user_id, course_id) LEFT JOIN mooc_grades gr USING (user_id, course_id)"""),
    # One row per scored student; band: of the shown score, where 0 and none count as 50.
    "latest_scores": (("student_features", "predictions"), """
    SELECT k.user_id, k.course_id, z.fail_risk_score AS score, z.risk_level AS level, z.model_name, z.predicted_at,
           CASE WHEN ifnull(z.fail_risk_score, 0) = 0 THEN 50.0 ELSE z.fail_risk_score END AS shown,
           ['LOW', 'MEDIUM', 'HIGH'][1 + (CASE WHEN ifnull(z.fail_risk_score, 0) = 0 THEN 50 ELSE z.fail_risk_score END >= 40)::INT
             + (CASE WHEN ifnull(z.fail_risk_score, 0) = 0 THEN 50 ELSE z.fail_risk_score END >= 70)::INT] AS band
    FROM student_features k
    LEFT JOIN (SELECT * FROM predictions WHERE is_latest) z USING (user_id, course_id)"""),
}


def _deps(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str):
        if n in out:
            return
        for d in _VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, extra_ctes: str | None = None) -> str:
    """Prefix ``body`` with the CTEs of every domain view it references."""
    used = [n for n in _VIEWS if re.search(rf"\b{n}\b", body + (extra_ctes or ""))]
    ctes = [f"{n} AS ({_VIEWS[n][1]}\n)" for n in _deps(used)]
    if extra_ctes:
        ctes.append(extra_ctes)
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        # the body has CTEs of its own: extend the same WITH list
        return "WITH " + ",\n".join(ctes) + ",\n" + stripped[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
