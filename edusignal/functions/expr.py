"""Scalar column expressions shared by the operators (survey 2.B / 2.H).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: risk thresholds and level names.
RISK_HIGH = 70
RISK_MEDIUM = 40
LEVELS = ("HIGH", "MEDIUM", "LOW")

DEFAULT_AS_OF = "2001-12-01 00:00:00"
SECONDS_PER_DAY = 86400


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_lit(as_of: str = DEFAULT_AS_OF) -> Column:
    """The fixed 'now' every time-relative operator takes instead of NOW()."""
    return F.lit(as_of).cast("timestamp_ntz")


def risk_level(score) -> Column:
    """HIGH >= 70, MEDIUM >= 40, LOW otherwise; NULL stays NULL."""
    s = col(score)
    return (F.when(s >= RISK_HIGH, F.lit("HIGH"))
            .when(s >= RISK_MEDIUM, F.lit("MEDIUM"))
            .when(s.isNotNull(), F.lit("LOW")))


def display_score(score) -> Column:
    """Q2: ``float(score or 50)`` — NULL and 0 both read as 50."""
    s = col(score).cast("double")
    return F.when(s.isNull() | (s == 0), F.lit(50.0)).otherwise(s)


def completion_status(passed) -> Column:
    """Completed / not_passed / in_progress from bool, 0/1 or '0'/'1'."""
    t = F.lower(col(passed).cast("string"))
    return (F.when(t.isin("1", "true"), F.lit("completed"))
            .when(t.isin("0", "false"), F.lit("not_passed"))
            .otherwise(F.lit("in_progress")))


def nullif_blank(c) -> Column:
    """The trimmed text, NULL if nothing is left (Q12)."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def display_name(vn, full, grade_full) -> Column:
    """First non-blank of Vietnamese name, full name, grade-sheet name."""
    return F.coalesce(nullif_blank(vn), nullif_blank(full), nullif_blank(grade_full))


def display_email(enroll_email, grade_email) -> Column:
    return F.coalesce(nullif_blank(enroll_email), col(grade_email))


def epoch_to_ntz(seconds) -> Column:
    """FROM_UNIXTIME as a zone-less wall clock: epoch + a day-time interval.
    (``timestamp_seconds`` would depend on the session time zone once cast to
    a zone-less timestamp.)"""
    s = col(seconds)
    return F.when(s.isNotNull(), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
                  + F.make_dt_interval(secs=s.cast("decimal(18,6)")))


def floor_days(ts, as_of: str = DEFAULT_AS_OF) -> Column:
    """Python ``(now - ts).days``: whole 24-hour units, floored (not datediff)."""
    return F.floor((F.unix_timestamp(as_of_lit(as_of)) - F.unix_timestamp(col(ts)))
                   / F.lit(SECONDS_PER_DAY)).cast("bigint")


def whole_weeks(ts, as_of: str = DEFAULT_AS_OF) -> Column:
    """TIMESTAMPDIFF(WEEK, ts, now), clamped at 0 like GREATEST(0, ...)."""
    secs = F.unix_timestamp(as_of_lit(as_of)) - F.unix_timestamp(col(ts))
    return F.when(col(ts).isNull(), F.lit(None).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), F.floor(secs / F.lit(7 * SECONDS_PER_DAY)).cast("bigint")))


def safe_ratio(num, den, scale: float = 1.0, default=None) -> Column:
    """num / den * scale, ``default`` when den is 0 or NULL (Q21: never raise)."""
    d = col(den).cast("double")
    r = F.try_divide(col(num).cast("double") * F.lit(scale), F.nullif(d, F.lit(0.0)))
    return r if default is None else F.coalesce(r, F.lit(default))


def py_round(c, n: int) -> Column:
    """Python round(float, n) done on a decimal so both engines agree."""
    return F.round(col(c).cast("decimal(38,10)"), n).cast("double")


def to_number(c, default: float = 0.0) -> Column:
    """Numeric coercion; NULL, non-numeric, NaN and infinities -> default."""
    v = col(c).cast("string").try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(v)


def to_int(c, default: int = 0) -> Column:
    """``int(x or 0)``: truncation toward zero."""
    v = to_number(c, float(default))
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("bigint")


def stability(std) -> Column:
    """Stability band of a standard deviation."""
    s = col(std)
    # Stability labels of the k-fold report.
    return (F.when(s < 0.02, F.lit("Very Stable [OK]"))
            .when(s < 0.05, F.lit("Stable"))
            .when(s < 0.10, F.lit("Moderately Stable"))
            .otherwise(F.lit("Unstable [!]")))


def course_parts(course_id) -> list[Column]:
    """``prefix:ORG+CODE+TERM`` -> (org, code, term); blanks become ``Unknown``.
    Without a ``:`` the whole id is the code."""
    c = col(course_id)
    unknown = F.lit("Unknown")
    has = F.size(F.split(c, ":")) > 1
    info = F.split(F.coalesce(F.try_element_at(F.split(c, ":"), F.lit(2)), F.lit("")), r"\+")

    def part(i):
        return F.coalesce(F.nullif(F.try_element_at(info, F.lit(i)), F.lit("")), unknown)

    return [F.when(has, part(1)).otherwise(unknown).alias("org"),
            F.when(has, part(2)).otherwise(c).alias("code"),
            F.when(has, part(3)).otherwise(unknown).alias("term")]


def last_activity_label(days) -> Column:
    """Roster label: today, yesterday, n days (<7), n weeks (<30), n months."""
    d = col(days)
    # Label texts of the roster.
    return (F.when(d.isNull(), F.lit("N/A")).when(d == 0, F.lit("Hôm nay"))
            .when(d == 1, F.lit("Hôm qua"))
            .when(d < 7, F.concat(d.cast("string"), F.lit(" ngày trước")))
            .when(d < 30, F.concat(F.floor(d / 7).cast("string"), F.lit(" tuần trước")))
            .otherwise(F.concat(F.floor(d / 30).cast("string"), F.lit(" tháng trước"))))


def percent_text(value) -> Column:
    """``n.toFixed(1) + '%'``; non-numbers -> ``N/A`` (half up on the decimal)."""
    v = to_number(value, float("nan"))
    ok = ~F.isnan(v)
    return F.when(ok, F.concat(F.round(v.cast("decimal(38,10)"), 1).cast("decimal(38,1)").cast("string"),
                               F.lit("%"))).otherwise(F.lit("N/A"))


def score_band(score) -> Column:
    s = col(score)
    return (F.when(s >= 80, F.lit("score-excellent")).when(s >= 70, F.lit("score-good"))
            .when(s >= 50, F.lit("score-average")).otherwise(F.lit("score-poor")))


def completion_band(rate) -> Column:
    r = col(rate)
    return (F.when(r >= 80, F.lit("completion-high")).when(r >= 60, F.lit("completion-medium"))
            .otherwise(F.lit("completion-low")))


def initials(name) -> Column:
    """First letters of the last two space-separated words, upper-cased;
    ``SV`` for a missing or empty name."""
    c = col(name)
    words = F.split(c, " ")
    last2 = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2)
    ini = F.upper(F.array_join(F.transform(last2, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(c.isNull() | (c == ""), F.lit("SV")).otherwise(ini)
