"""Calendar profiles."""

from __future__ import annotations

from queries.panels import HOURLY_SQL, SHIPPED_SQL, hourly, shipped_by_unit
from queries.shape import plain
from slotcast.functions.dates import BUSINESS_DAY, MONTHS, WEEKDAYS, WEEKEND
from slotcast.operators import profile

UNITS = {"overall": (), "sector": ("sector",), "client": ("unit",)}


def hour_profile(spark, sf):
    return plain(profile.hour_profile(hourly(spark, sf)))


def unit_sector_hour(spark, sf):
    return plain(profile.unit_sector_hours(hourly(spark, sf)))


def weekday_profile(spark, sf):
    return plain(profile.weekday_profile(hourly(spark, sf)))


def month_profile(spark, sf):
    return plain(profile.month_profile(shipped_by_unit(spark, sf), UNITS))


def year_profile(spark, sf):
    return plain(profile.year_profile(shipped_by_unit(spark, sf)))


def weekday_hour_matrix(spark, sf):
    return plain(profile.weekday_hour_matrix(hourly(spark, sf)))


def day_type_mean(spark, sf):
    return plain(profile.day_type_profile(hourly(spark, sf)))


def levels_sql(panel: str, key: str, key_sql: str, levels: dict[str, str]) -> str:
    """Union of one plain GROUP BY per level."""
    parts = []
    for name, group in levels.items():
        expr = group or "'all'"
        known = " AND ".join(f"{c} IS NOT NULL" for c in group.split(" || ' - ' || ")) if group else "true"
        parts.append(
            f"SELECT '{name}' AS level, {expr} AS \"group\", {key_sql} AS {key}, avg(demand) AS mean "
            f"FROM {panel} WHERE {known} GROUP BY ALL"
        )
    return "m AS (" + "\n UNION ALL ".join(parts) + ")"


def profile_sql(key: str, domain: str) -> str:
    """Spine completion, reference line and peak of the CTE m."""
    return f"""
    s AS (SELECT DISTINCT level, "group", k AS {key}
          FROM m, (SELECT unnest(generate_series({domain})) AS k)),
    p AS (SELECT level, "group", {key} AS pk, mean AS pm,
                 row_number() OVER (PARTITION BY level, "group"
                                    ORDER BY mean DESC NULLS LAST, {key}) AS rn FROM m),
    f AS (SELECT level, "group", avg(mean) AS ref FROM m GROUP BY ALL),
    done AS (
      SELECT s.level, s."group", CAST(s.{key} AS BIGINT) AS {key}, round(m.mean, 6) AS mean,
             round(f.ref, 6) AS reference_mean, CAST(p.pk AS BIGINT) AS peak_{key},
             round(p.pm, 6) AS peak_mean
      FROM s LEFT JOIN m ON m.level = s.level AND m."group" = s."group" AND m.{key} = s.{key}
      JOIN p ON p.level = s.level AND p."group" = s."group" AND p.rn = 1
      JOIN f ON f.level = s.level AND f."group" = s."group")"""


def names_sql(names, position: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][{position}]"


H_LEVELS = {"overall": "", "sector": "sector", "client": "client"}
L_LEVELS = {"overall": "", "sector": "sector", "unit": "unit"}
US_LEVELS = {"unit": "unit", "unit_sector": "unit || ' - ' || sector"}
WEEKDAY = "isodow(date) - 1"

MATRIX = ", ".join(
    f"round(max(mean) FILTER (hour = {h}), 6) AS h{h:02d}" for h in range(24)
)

ORACLES = {
    "hour_profile": f"WITH {HOURLY_SQL}, {levels_sql('h', 'hour', 'hour', H_LEVELS)},"
    f"{profile_sql('hour', '0, 23')} SELECT * FROM done",
    "unit_sector_hour": f"WITH {HOURLY_SQL}, {levels_sql('h', 'hour', 'hour', US_LEVELS)},"
    f"{profile_sql('hour', '0, 23')} SELECT * FROM done",
    "weekday_profile": f"WITH {HOURLY_SQL}, {levels_sql('h', 'weekday', WEEKDAY, H_LEVELS)},"
    f"{profile_sql('weekday', '0, 6')} SELECT *, {names_sql(WEEKDAYS, 'weekday + 1')} AS weekday_name,"
    f" {names_sql(WEEKDAYS, 'peak_weekday + 1')} AS peak_name FROM done",
    "month_profile": f"""WITH {SHIPPED_SQL},
    {levels_sql('l', 'month', 'month(date)', {'overall': '', 'sector': 'sector', 'client': 'unit'})},
    {profile_sql('month', '1, 12')}
    SELECT *, {names_sql(MONTHS, 'month')} AS month_name FROM done""",
    "year_profile": f"""WITH {SHIPPED_SQL}, {levels_sql('l', 'year', 'year(date)', L_LEVELS)}
    SELECT level, "group", CAST(year AS BIGINT) AS year, round(mean, 6) AS mean,
           round(avg(mean) OVER (PARTITION BY level, "group"), 6) AS reference_mean FROM m""",
    "weekday_hour_matrix": f"""WITH {HOURLY_SQL},
    x AS (SELECT *, {WEEKDAY} AS weekday FROM h),
    m AS (SELECT 'overall' AS level, 'all' AS "group", weekday, hour, avg(demand) AS mean
          FROM x GROUP BY ALL
          UNION ALL SELECT 'sector', sector, weekday, hour, avg(demand) FROM x GROUP BY ALL
          UNION ALL SELECT 'client', client, weekday, hour, avg(demand) FROM x GROUP BY ALL),
    s AS (SELECT DISTINCT level, "group", k AS weekday
          FROM m, (SELECT unnest(generate_series(0, 6)) AS k))
    SELECT s.level, s."group", CAST(s.weekday AS BIGINT) AS weekday,
           {names_sql(WEEKDAYS, 's.weekday + 1')} AS weekday_name, {MATRIX}
    FROM s LEFT JOIN m ON m.level = s.level AND m."group" = s."group" AND m.weekday = s.weekday
    GROUP BY ALL""",
    "day_type_mean": f"""WITH {HOURLY_SQL},
    x AS (SELECT CASE WHEN isodow(date) >= 6 THEN '{WEEKEND}' ELSE '{BUSINESS_DAY}' END AS day_type,
                 demand FROM h)
    SELECT 'overall' AS level, 'all' AS "group",
           CAST(CASE day_type WHEN '{BUSINESS_DAY}' THEN 1 ELSE 2 END AS BIGINT) AS position,
           day_type, round(avg(demand), 6) AS mean FROM x GROUP BY day_type""",
}

QUERIES = {
    f.__name__: f
    for f in (
        hour_profile, unit_sector_hour, weekday_profile, month_profile, year_profile,
        weekday_hour_matrix, day_type_mean,
    )
}
