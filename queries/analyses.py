"""Cleaning, contrasts, distributions and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.panels import (
    DAILY_SQL,
    HOURLY_SQL,
    SHIPPED_SQL,
    USERS_SQL,
    WEATHER_SQL,
    daily,
    hourly,
    hourly_by_user,
    shipped,
    shipped_by_unit,
    suppliers,
    table,
    weather,
)

from queries.shape import plain
from slotcast.functions.checkpoints import checkpointed, work_folder
from slotcast.functions.rows import label
from slotcast.grid import DAILY, Grid, duplicate_slots, fill_grid, missing_slots
from slotcast.operators import clean, contrast, distribution, joins, series
from slotcast.operators.levels import BY_SECTOR_AND_UNIT
from slotcast.plans import panel
from slotcast.sources import demand
from slotcast.sources.holidays import holiday_calendar, years_of
from slotcast.sources.weather import PAYLOAD, rained, weather_days

EVENT_GRID = Grid(keys=("service_id", "sector"))
SUPPLIER_GRID = Grid(keys=("service_id",), hour=None)

# Intervals in the span of the order dates, of the length of the published ones.
WINDOWS = [("1996-03-01", "1996-05-31"), ("1998-03-15", "1998-05-31"), ("2000-02-01", "2000-04-30")]


def dimension_enrich(spark, sf):
    return plain(joins.dimension_enrich(shipped(spark, sf), suppliers(spark, sf)))


def spike_clean(spark, sf):
    cut = clean.as_of(hourly(spark, sf), "2024-01-28")
    return plain(clean.repair_spikes(cut, EVENT_GRID, factor=1.2, floor=2.0))


def holiday_contrast(spark, sf):
    return plain(contrast.holiday_contrast(shipped_by_unit(spark, sf), BY_SECTOR_AND_UNIT))


def rain_contrast(spark, sf):
    rain = contrast.rain_contrast(
        hourly(spark, sf), weather(spark, sf), "2024-01-01", "2024-12-31"
    )
    return plain(rain)


def season_rain_contrast(spark, sf):
    rain = contrast.rain_contrast(
        hourly_by_user(spark, sf), weather(spark, sf), "2024-01-06", "2024-01-09", mm=1.0,
        common_services_only=True,
    )
    return plain(rain)


def common_services(spark, sf):
    """Rows of suppliers that shipped on two given days of both 1996 and 2001."""
    days = shipped(spark, sf)
    first = days.filter(F.col("date").between("1996-06-04", "1996-06-05"))
    last = days.filter(F.col("date").between("2001-06-04", "2001-06-05"))
    return plain(joins.keep_ids(days, joins.common_ids(first, last)))


def period_contrast(spark, sf):
    panel = shipped_by_unit(spark, sf)
    return plain(contrast.period_contrast(panel, "1998-02-01", "1998-04-30", BY_SECTOR_AND_UNIT))


def daily_stats(spark, sf):
    totals = distribution.daily_totals(shipped_by_unit(spark, sf), BY_SECTOR_AND_UNIT)
    return plain(distribution.daily_stats(totals))


def fd_histogram(spark, sf):
    totals = distribution.daily_totals(shipped_by_unit(spark, sf), BY_SECTOR_AND_UNIT)
    return plain(distribution.histogram(totals))


def smoothed_series(spark, sf):
    totals = distribution.daily_totals(shipped_by_unit(spark, sf), BY_SECTOR_AND_UNIT)
    return plain(series.smoothed(totals))


def outbreak_means(spark, sf):
    totals = distribution.daily_totals(shipped_by_unit(spark, sf), BY_SECTOR_AND_UNIT)
    return plain(series.interval_means(totals, WINDOWS))


def outbreak_labels(spark, sf):
    """Mean daily total within each single interval."""
    totals = distribution.daily_totals(shipped_by_unit(spark, sf), BY_SECTOR_AND_UNIT)
    windows = spark.createDataFrame(
        [(a, b, f"{a[:4]}") for a, b in WINDOWS], "start string, end string, label string"
    ).selectExpr("date(start) AS start", "date(end) AS end", "label")
    labelled = joins.label_intervals(totals, windows, "inner")
    return plain(labelled.groupBy("level", "group", "label").agg(
        F.avg("total").alias("mean"), F.count(F.lit(1)).alias("days")
    ))


# Intervals of centuries, without an end, and overlapping ones of one label.
LONG_WINDOWS = [
    ("centuries", "1850-01-01", "2150-01-01"), ("open end", "1998-06-01", None), ("open start", None, "1995-12-31"),
    ("season", "1996-03-01", "1996-05-31"), ("season", "1996-05-01", "1996-07-15"), ("season", "1997-02-01", "1997-02-28"),
]


def long_intervals(spark, sf):
    """Shipments within intervals of any length, by label."""
    windows = spark.createDataFrame(LONG_WINDOWS, "label string, start string, end string").selectExpr(
        "label", "date(start) AS start", "date(end) AS end"
    )
    labelled = joins.label_intervals(shipped(spark, sf), windows, "inner")
    return plain(labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"), F.sum("demand").alias("demand")
    ))


def sector_windows(spark, sf):
    """Overlapping, touching and open intervals of each nation."""
    key = F.col("n_nationkey")
    at = lambda start, end: F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"))
    day = lambda days: F.date_add(F.lit("1996-01-01").cast("date"), (37 * key + days).cast("int"))
    fixed = lambda text: F.lit(text).cast("date")
    windows = F.array(
        at(day(0), day(90)), at(day(60), day(200)), at(day(201), day(220)), at(day(10), day(20)),
        at(F.when(key % 5 == 0, fixed("2001-01-01")).otherwise(fixed("2000-02-01")), F.when(key % 5 != 0, fixed("2000-04-30"))),
    )
    return table(spark, sf, "nation").select(
        F.lit("sector").alias("level"), F.col("n_name").alias("group"), F.inline(windows)
    )


def sector_outbreaks(spark, sf):
    """Mean daily total inside and outside the intervals that each sector has of its own."""
    totals = distribution.daily_totals(shipped_by_unit(spark, sf), BY_SECTOR_AND_UNIT)
    return plain(series.interval_means_of(totals, sector_windows(spark, sf), ["level", "group"]))


def daily_grid(spark, sf):
    return plain(fill_grid(daily(spark, sf), DAILY))


def grid_gaps(spark, sf):
    return plain(missing_slots(daily(spark, sf), DAILY))


def slot_duplicates(spark, sf):
    """Order rows taken as raw demand: slots that hold several of them."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("service_id"), F.to_date("o_orderdate").alias("date")
    )
    return plain(duplicate_slots(orders, SUPPLIER_GRID))


def holiday_days(spark, sf):
    """Every shipping day with its holiday."""
    days = shipped(spark, sf).groupBy("date").agg(F.sum("demand").alias("demand"))
    return plain(contrast.with_holidays(days))


def holiday_span(spark, sf):
    """Shipping days moved 110 years back and 110 years ahead, with their holidays."""
    days = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    moved = days.select(F.explode(F.array(F.lit(-1320), F.lit(1320))).alias("months"), "day")
    days = moved.select(F.add_months("day", F.col("months")).alias("date"))
    return plain(contrast.with_holidays(days.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))))


def unit_labels(spark, sf):
    rows = suppliers(spark, sf)
    return plain(rows.select("service_id", label("unit", "sector").alias("unit_sector")))


def event_text(spark, sf):
    """Events as raw text: days and hours with one or two digits, some days that
    do not exist."""
    short = F.col("event_id") % 2 == 0
    day = F.when(short, F.date_format("ts", "d/M/yyyy")).otherwise(F.date_format("ts", "dd/MM/yyyy"))
    hour = F.when(short, F.date_format("ts", "H:m")).otherwise(F.date_format("ts", "HH:mm"))
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("service_id"),
        F.when(F.col("event_id") % 7 == 0, F.lit("31/02/2024")).otherwise(day).alias("date"),
        hour.alias("hour"), F.col("value").cast("string").alias("demand"),
    )


def rejected_text(spark, sf):
    """The raw rows of events with text that does not parse."""
    user = F.col("service_id").cast("long")
    raw = event_text(spark, sf).withColumns({
        "hour": F.when(user % 5 == 0, F.lit("25:00")).otherwise(F.col("hour")),
        "demand": F.when(user % 3 == 0, F.lit("n/a")).otherwise(F.lit("1")),
    })
    rejected = demand.rejected_demand(raw)
    return plain(rejected.select("service_id", "demand", F.array_join("rejected", ",").alias("rejected")))


def clean_panel(spark, sf):
    """Raw text of events and an organisation of their types to a clean panel;
    raw rows of one slot stay apart."""
    kind = F.length("event_type")
    events = table(spark, sf, "events")
    text = events.select(
        kind.cast("string").alias("service_id"),
        F.when(F.col("event_id") % 7 == 0, F.lit("31/02/2024"))
        .otherwise(F.date_format("ts", "d/M/yyyy")).alias("date"),
        F.date_format("ts", "H:m").alias("hour"), F.col("value").cast("string").alias("demand"),
    )
    organisation = events.select(
        kind.cast("long").alias("service_id"), F.concat(F.lit("sector "), kind % 2).alias("sector")
    ).distinct()
    panel_ = panel.clean_panel(
        demand.typed_demand(text), organisation, "2024-01-28", factor=1.5, floor=10.0
    )
    return plain(panel_.select("service_id", "sector", "date", "hour", "demand"))


def malformed_text(spark, sf):
    """Events written as lines of text, some a field short and some a field long,
    and read again: the rows that are rejected, and why."""
    with work_folder(spark) as folder:
        line = F.concat_ws(
            ";", "service_id", "date", "hour",
            F.when(F.col("n") % 11 != 0, F.col("demand")), F.when(F.col("n") % 13 == 0, F.lit("x;y")),
        )
        text = event_text(spark, sf).withColumn("n", F.col("service_id").cast("long"))
        text.select(line.alias("value")).write.text(folder)
        raw = demand.read_raw_demand(spark, folder, names=list(demand.DEMAND_COLUMNS))
        rejected = demand.rejected_demand(raw).select(
            "service_id", "date", "demand", F.array_join("rejected", ",").alias("rejected"), "malformed"
        )
        return checkpointed(plain(rejected))


def rewritten_panel(spark, sf):
    """A panel by year of which one year is written again, twice; the others stay."""
    with work_folder(spark) as folder:
        days = daily(spark, sf)
        demand.write_panel(days, folder)
        again = days.filter(F.year("date") == 1997).withColumn("demand", F.col("demand") + 100)
        for _ in range(2):
            demand.write_panel(again.filter(F.day("date") <= 20), folder, years=True)
        return checkpointed(plain(demand.read_panel(spark, folder, "1996-07-01", "1999-01-01")))


def _cleaned(spark, sf, service):
    """Raw rows of events by ``service``, spikes repaired, several rows to a slot."""
    events = table(spark, sf, "events")
    raw = events.select(
        service.alias("service_id"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour"),
        F.col("value").alias("demand"),
    )
    sector = F.concat(F.lit("sector "), service % 3).alias("sector")
    organisation = events.select(service.alias("service_id"), sector).distinct()
    return plain(panel.clean_panel(raw, organisation, "2024-01-28", factor=1.5, floor=10.0))


def clean_users(spark, sf):
    """Raw rows of many small services."""
    return _cleaned(spark, sf, F.col("user_id"))


def clean_hot_service(spark, sf):
    """Raw rows of which one service has a third, beside fifty others."""
    user = F.col("user_id")
    return _cleaned(spark, sf, F.when(user % 3 == 0, F.lit(0)).otherwise(user % 50 + 1).cast("long"))


def typed_text(spark, sf):
    """Events written as text, with one or two digits, every seventh with a day
    that does not exist, and typed again."""
    typed = demand.typed_demand(event_text(spark, sf))
    return plain(typed.groupBy("date", "hour").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("demand").alias("demand"),
        F.max("service_id").alias("last_service"),
    ))


def weather_json(spark, sf):
    """Daily rain packed into one JSON document per month and unpacked again;
    a month has at most 31 entries."""
    days = weather(spark, sf).groupBy(F.trunc("date", "month").alias("month")).agg(
        F.array_sort(F.collect_list(F.struct("date", "precip_mm"))).alias("d")
    )
    packed = F.to_json(F.struct(F.struct(
        F.col("d.date").cast("array<string>").alias("time"),
        F.col("d.precip_mm").alias("precipitation_sum"),
    ).alias("daily")))
    parsed = days.select(F.from_json(packed, PAYLOAD).alias("p")).select("p.daily")
    return plain(weather_days(parsed).withColumn("rained", rained()))


def holiday_dimension(spark, sf):
    """Holidays of all years from the first to the last shipping day."""
    days = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return plain(holiday_calendar(years_of(days)))


# Published dates of Easter Sunday.
EASTER = {
    1995: "1995-04-16", 1996: "1996-04-07", 1997: "1997-03-30", 1998: "1998-04-12",
    1999: "1999-04-04", 2000: "2000-04-23", 2001: "2001-04-15",
}
YEAR_DAYS = {
    "01-01": "Confraternização Universal", "04-21": "Tiradentes", "05-01": "Dia do Trabalhador",
    "09-07": "Independência do Brasil", "10-12": "Nossa Senhora Aparecida", "11-02": "Finados",
    "11-15": "Proclamação da República", "12-25": "Natal",
}
# Published dates of Easter Sunday outside the years 1900 to 2100.
FAR_EASTER = {
    1885: "1885-04-05", 1886: "1886-04-25", 1887: "1887-04-10", 1888: "1888-04-01",
    1889: "1889-04-21", 1890: "1890-04-06", 1891: "1891-03-29", 2105: "2105-04-05",
    2106: "2106-04-18", 2107: "2107-04-10", 2108: "2108-04-01", 2109: "2109-04-21",
    2110: "2110-04-06", 2111: "2111-03-29",
}
# First year of each national holiday that is not older than 1885.
SINCE = {
    "01-01": 1890, "04-21": 1933, "05-01": 1925, "09-07": 1890, "10-12": 1980, "11-02": 1890,
    "11-15": 1890, "12-25": 1922,
}
FAR_HOLIDAYS_SQL = "far AS (SELECT date, string_agg(name, '; ' ORDER BY name) AS holiday_name FROM (VALUES " + ", ".join(
    [f"(DATE '{y}-{d}', '{n}')" for y in FAR_EASTER for d, n in YEAR_DAYS.items() if y >= SINCE[d]]
    + [f"(DATE '{y}-11-20', 'Dia Nacional de Zumbi e da Consciência Negra')" for y in FAR_EASTER if y >= 2024]
    + [f"(DATE '{e}' - 2, 'Sexta-feira Santa')" for e in FAR_EASTER.values()]
) + ") v(date, name) GROUP BY date)"
HOLIDAYS_SQL = "hol AS (SELECT date, string_agg(name, '; ' ORDER BY name) AS holiday_name FROM (VALUES " + ", ".join(
    [f"(DATE '{y}-{d}', '{n}')" for y in EASTER for d, n in YEAR_DAYS.items()]
    + [f"(DATE '{e}' - 2, 'Sexta-feira Santa')" for e in EASTER.values()]
) + ") v(date, name) GROUP BY date)"

TOTALS_SQL = """
t AS (SELECT 'overall' AS level, 'all' AS "group", date, sum(demand) AS total FROM l GROUP BY ALL
      UNION ALL SELECT 'sector', sector, date, sum(demand) FROM l GROUP BY ALL
      UNION ALL SELECT 'unit', unit, date, sum(demand) FROM l GROUP BY ALL)"""
INSIDE_SQL = " OR ".join(f"date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in WINDOWS)


def clean_sql(service: str) -> str:
    return f"""
    WITH r AS (
      SELECT {service} AS service_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, value AS demand
      FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-28'),
    s AS (SELECT service_id, date, hour, avg(demand) AS m FROM r GROUP BY ALL),
    n AS (
      SELECT r.*, a.m AS a, b.m AS b FROM r
      LEFT JOIN s a ON a.service_id = r.service_id AND a.hour = r.hour AND a.date = r.date - 7
      LEFT JOIN s b ON b.service_id = r.service_id AND b.hour = r.hour AND b.date = r.date + 7),
    f AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS ref FROM n)
    SELECT CAST(service_id AS BIGINT) AS service_id, 'sector ' || (service_id % 3) AS sector,
      CAST(date AS VARCHAR) AS date, hour,
      round(CASE WHEN demand > 1.5 * ref AND demand > 10 THEN ref ELSE demand END, 6) AS demand FROM f"""


def rain_sql(panel: str, where: str, mm: float, common: bool) -> str:
    keep = (
        "WHERE service_id IN (SELECT service_id FROM r WHERE rained "
        "INTERSECT SELECT service_id FROM r WHERE NOT rained)" if common else ""
    )
    return f"""WITH {HOURLY_SQL}, {USERS_SQL}, {WEATHER_SQL},
    r AS (SELECT {panel}.*, coalesce(wx.precip_mm > {mm}, false) AS rained
          FROM {panel} JOIN wx USING (date) WHERE {where}),
    k AS (SELECT * FROM r {keep})
    SELECT CAST(s.hour AS BIGINT) AS hour, round(avg(demand) FILTER (rained), 6) AS rain_mean,
           round(avg(demand) FILTER (NOT rained), 6) AS dry_mean
    FROM (SELECT unnest(generate_series(0, 23)) AS hour) s LEFT JOIN k ON k.hour = s.hour
    GROUP BY s.hour"""


ORACLES = {
    "dimension_enrich": f"""WITH {SHIPPED_SQL}
    SELECT service_id, service_name, sector, unit, CAST(date AS VARCHAR) AS date,
           round(demand, 6) AS demand FROM l""",
    "spike_clean": f"""WITH {HOURLY_SQL}, c AS (SELECT * FROM h WHERE date <= DATE '2024-01-28'),
    n AS (SELECT c.*, p.demand AS a, q.demand AS b FROM c
      LEFT JOIN c p ON p.service_id = c.service_id AND p.sector = c.sector
        AND p.hour = c.hour AND p.date = c.date - 7
      LEFT JOIN c q ON q.service_id = c.service_id AND q.sector = c.sector
        AND q.hour = c.hour AND q.date = c.date + 7),
    f AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS ref FROM n)
    SELECT service_id, sector, unit, client, CAST(date AS VARCHAR) AS date,
           CAST(hour AS BIGINT) AS hour,
           round(CASE WHEN demand > 1.2 * ref AND demand > 2 THEN ref ELSE demand END, 6) AS demand
    FROM f""",
    "holiday_contrast": f"""WITH {SHIPPED_SQL}, {HOLIDAYS_SQL},
    x AS (SELECT l.*, holiday_name FROM l LEFT JOIN hol USING (date)),
    u AS (SELECT 'overall' AS level, 'all' AS "group", * FROM x
          UNION ALL SELECT 'sector', sector, * FROM x
          UNION ALL SELECT 'unit', unit, * FROM x),
    o AS (SELECT level, "group", avg(demand) AS m FROM u WHERE holiday_name IS NULL GROUP BY ALL)
    SELECT u.level, u."group", u.holiday_name, round(avg(u.demand), 6) AS holiday_mean,
           round(any_value(o.m), 6) AS other_mean
    FROM u LEFT JOIN o ON o.level = u.level AND o."group" = u."group"
    WHERE u.holiday_name IS NOT NULL GROUP BY u.level, u."group", u.holiday_name""",
    "rain_contrast": rain_sql(
        "h", "date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31'", 1.0, False),
    "season_rain_contrast": rain_sql(
        "u", "date BETWEEN DATE '2024-01-06' AND DATE '2024-01-09'", 1.0, True),
    "common_services": f"""WITH {SHIPPED_SQL}
    SELECT service_id, CAST(date AS VARCHAR) AS date, round(demand, 6) AS demand FROM l
    WHERE service_id IN (
      SELECT service_id FROM l WHERE date BETWEEN DATE '1996-06-04' AND DATE '1996-06-05'
      INTERSECT
      SELECT service_id FROM l WHERE date BETWEEN DATE '2001-06-04' AND DATE '2001-06-05')""",
    "period_contrast": f"""WITH {SHIPPED_SQL},
    u AS (SELECT 'overall' AS level, 'all' AS "group", * FROM l
          UNION ALL SELECT 'sector', sector, * FROM l UNION ALL SELECT 'unit', unit, * FROM l),
    m AS (SELECT level, "group",
            avg(demand) FILTER (date BETWEEN DATE '1998-02-01' AND DATE '1998-04-30') AS a,
            avg(demand) FILTER (date NOT BETWEEN DATE '1998-02-01' AND DATE '1998-04-30') AS b
          FROM u GROUP BY ALL)
    SELECT level, "group", round(a, 6) AS inside_mean, round(b, 6) AS outside_mean,
           round(CASE WHEN b = 0 THEN 0 ELSE (a - b) / b * 100 END, 6) AS change_percent FROM m""",
    "daily_stats": f"""WITH {SHIPPED_SQL}, {TOTALS_SQL}
    SELECT level, "group", count(*) AS days, round(avg(total), 6) AS mean,
           round(median(total), 6) AS median FROM t GROUP BY ALL""",
    "fd_histogram": f"""WITH {SHIPPED_SQL}, {TOTALS_SQL},
    q AS (SELECT level, "group", count(*) AS n, min(total) AS lo, max(total) AS hi,
                 quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3
          FROM t GROUP BY ALL),
    w AS (SELECT *, 2 * (q3 - q1) * n ** (-1.0 / 3) AS width FROM q),
    b AS (SELECT *, CASE WHEN width > 0 AND hi > lo THEN CAST(ceil((hi - lo) / width) AS BIGINT)
                         ELSE 1 END AS bins FROM w),
    e AS (SELECT level, "group", unnest(generate_series(0, bins - 1)) AS bin, bins,
                 CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END AS lo,
                 CASE WHEN hi = lo THEN hi + 0.5 ELSE hi END AS hi FROM b),
    f AS (SELECT level, "group", bin, bins, lo + bin * ((hi - lo) / bins) AS bin_from,
                 CASE WHEN bin + 1 = bins THEN hi ELSE lo + (bin + 1) * ((hi - lo) / bins) END AS bin_to
          FROM e)
    SELECT f.level, f."group", f.bin, round(f.bin_from, 6) AS bin_from,
           round(f.bin_to, 6) AS bin_to, count(t.total) AS days
    FROM f LEFT JOIN t ON t.level = f.level AND t."group" = f."group" AND t.total >= f.bin_from
      AND (t.total < f.bin_to OR (f.bin + 1 = f.bins AND t.total <= f.bin_to))
    GROUP BY ALL""",
    "smoothed_series": f"""WITH {SHIPPED_SQL}, {TOTALS_SQL},
    s AS (SELECT level, "group", CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
          FROM t GROUP BY level, "group")
    SELECT s.level, s."group", CAST(s.date AS VARCHAR) AS date, round(t.total, 6) AS total,
           round(avg(t.total) OVER (PARTITION BY s.level, s."group" ORDER BY s.date
                 ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_mean
    FROM s LEFT JOIN t ON t.level = s.level AND t."group" = s."group" AND t.date = s.date""",
    "outbreak_means": f"""WITH {SHIPPED_SQL}, {TOTALS_SQL}
    SELECT level, "group", round(avg(total) FILTER ({INSIDE_SQL}), 6) AS inside_mean,
           round(avg(total) FILTER (NOT ({INSIDE_SQL})), 6) AS outside_mean
    FROM t GROUP BY ALL""",
    "outbreak_labels": f"""WITH {SHIPPED_SQL}, {TOTALS_SQL}
    SELECT level, "group", label, round(avg(total), 6) AS mean, count(*) AS days
    FROM t JOIN (VALUES {", ".join(f"(DATE '{a}', DATE '{b}', '{a[:4]}')" for a, b in WINDOWS)})
      v(a, b, label) ON date BETWEEN a AND b
    GROUP BY ALL""",
    "daily_grid": f"""WITH {DAILY_SQL},
    s AS (SELECT service_id, sector,
                 CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
          FROM d GROUP BY service_id, sector)
    SELECT s.service_id, s.sector, CAST(s.date AS VARCHAR) AS date, demand
    FROM s LEFT JOIN d ON d.service_id = s.service_id AND d.sector = s.sector AND d.date = s.date""",
    "grid_gaps": f"""WITH {DAILY_SQL}
    SELECT service_id, sector, date_diff('day', min(date), max(date)) + 1 - count(*) AS missing
    FROM d GROUP BY ALL""",
    "slot_duplicates": """
    SELECT o_custkey AS service_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
           count(*) AS rows
    FROM orders GROUP BY ALL HAVING count(*) > 1""",
    "holiday_days": f"""WITH {HOLIDAYS_SQL},
    x AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS demand FROM lineitem GROUP BY ALL)
    SELECT CAST(x.date AS VARCHAR) AS date, round(demand, 6) AS demand, holiday_name,
           holiday_name IS NOT NULL AS is_holiday
    FROM x LEFT JOIN hol USING (date)""",
    "holiday_span": f"""WITH {FAR_HOLIDAYS_SQL},
    m AS (SELECT unnest([CAST(l_shipdate AS DATE) - INTERVAL 1320 MONTH,
                         CAST(l_shipdate AS DATE) + INTERVAL 1320 MONTH]) AS t FROM lineitem),
    x AS (SELECT CAST(t AS DATE) AS date, count(*) AS rows FROM m GROUP BY ALL)
    SELECT CAST(x.date AS VARCHAR) AS date, rows, holiday_name, holiday_name IS NOT NULL AS is_holiday
    FROM x LEFT JOIN far USING (date)""",
    "rejected_text": """
    WITH r AS (
      SELECT CAST(user_id AS VARCHAR) AS service_id, CASE WHEN user_id % 3 = 0 THEN 'n/a' ELSE '1' END AS demand,
        list_filter([CASE WHEN event_id % 7 = 0 THEN 'date' END, CASE WHEN user_id % 5 = 0 THEN 'hour' END,
                     CASE WHEN user_id % 3 = 0 THEN 'demand' END], lambda x: x IS NOT NULL) AS bad
      FROM events)
    SELECT service_id, demand, array_to_string(bad, ',') AS rejected FROM r WHERE len(bad) > 0""",
    "clean_panel": """
    WITH r AS (
      SELECT CAST(length(event_type) AS BIGINT) AS service_id, CAST(ts AS DATE) AS date,
        CAST(hour(ts) AS BIGINT) AS hour, value AS demand FROM events
      WHERE event_id % 7 <> 0 AND CAST(ts AS DATE) <= DATE '2024-01-28'),
    s AS (SELECT service_id, date, hour, avg(demand) AS m FROM r GROUP BY ALL),
    n AS (
      SELECT r.*, a.m AS a, b.m AS b FROM r
      LEFT JOIN s a ON a.service_id = r.service_id AND a.hour = r.hour AND a.date = r.date - 7
      LEFT JOIN s b ON b.service_id = r.service_id AND b.hour = r.hour AND b.date = r.date + 7),
    f AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS ref FROM n)
    SELECT service_id, 'sector ' || (service_id % 2) AS sector, CAST(date AS VARCHAR) AS date, hour,
      round(CASE WHEN demand > 1.5 * ref AND demand > 10 THEN ref ELSE demand END, 6) AS demand FROM f""",
    "malformed_text": r"""
    WITH r AS (
      SELECT user_id AS n, CAST(user_id AS VARCHAR) AS s, CAST(value AS VARCHAR) AS v,
        CASE WHEN event_id % 7 = 0 THEN '31/02/2024' WHEN event_id % 2 = 0 THEN strftime(ts, '%-d/%-m/%Y')
          ELSE strftime(ts, '%d/%m/%Y') END AS d,
        CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%-H:%-M') ELSE strftime(ts, '%H:%M') END AS h,
        event_id % 7 = 0 AS undated FROM events),
    p AS (
      SELECT *, [s, d, h] || CASE WHEN n % 11 <> 0 THEN [v] ELSE [] END
        || CASE WHEN n % 13 = 0 THEN ['x', 'y'] ELSE [] END AS f FROM r),
    c AS (
      SELECT *, CASE WHEN len(f) <> 4 THEN array_to_string(f, ';') END AS malformed, f[4] AS demand,
        list_filter([CASE WHEN len(f) <> 4 THEN 'fields' END, CASE WHEN undated THEN 'date' END,
          CASE WHEN f[4] = 'x' THEN 'demand' END], lambda x: x IS NOT NULL) AS bad FROM p)
    SELECT s AS service_id, d AS date, demand, array_to_string(bad, ',') AS rejected, malformed FROM c WHERE len(bad) > 0""",
    "rewritten_panel": f"""WITH {DAILY_SQL}
    SELECT service_id, sector, CAST(date AS VARCHAR) AS date,
      CASE WHEN year(date) = 1997 THEN demand + 100 ELSE demand END AS demand
    FROM d WHERE date >= DATE '1996-07-01' AND date < DATE '1999-01-01' AND (year(date) <> 1997 OR day(date) <= 20)""",
    "clean_users": clean_sql("user_id"),
    "clean_hot_service": clean_sql("CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 50 + 1 END"),
    "long_intervals": f"""WITH {SHIPPED_SQL},
    w AS (SELECT label, CAST(s AS DATE) AS a, CAST(e AS DATE) AS b FROM (VALUES {", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in w) + ")" for w in LONG_WINDOWS)}) v(label, s, e)),
    m AS (SELECT DISTINCT label, service_id, date, demand FROM l JOIN w
          ON (a IS NULL OR date >= a) AND (b IS NULL OR date <= b))
    SELECT label, count(*) AS rows, count(DISTINCT date) AS days, round(sum(demand), 6) AS demand FROM m GROUP BY label""",
    "sector_outbreaks": f"""WITH {SHIPPED_SQL}, {TOTALS_SQL},
    n AS (SELECT n_name, n_nationkey AS k, DATE '1996-01-01' + 37 * n_nationkey AS d FROM nation),
    w AS (SELECT n_name, d AS a, d + 90 AS b FROM n UNION ALL SELECT n_name, d + 60, d + 200 FROM n
          UNION ALL SELECT n_name, d + 201, d + 220 FROM n UNION ALL SELECT n_name, d + 10, d + 20 FROM n
          UNION ALL SELECT n_name, CASE WHEN k % 5 = 0 THEN DATE '2001-01-01' ELSE DATE '2000-02-01' END,
            CASE WHEN k % 5 <> 0 THEN DATE '2000-04-30' ELSE DATE '9999-12-31' END FROM n),
    x AS (SELECT t.*, level = 'sector' AND EXISTS (
            SELECT 1 FROM w WHERE w.n_name = t."group" AND t.date BETWEEN w.a AND w.b) AS inside FROM t)
    SELECT level, "group", round(avg(total) FILTER (inside), 6) AS inside_mean,
           round(avg(total) FILTER (NOT inside), 6) AS outside_mean, count(*) FILTER (inside) AS inside_days
    FROM x GROUP BY ALL""",
    "typed_text": """
    SELECT CASE WHEN event_id % 7 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
           hour(ts) AS hour, count(*) AS rows, round(sum(value), 6) AS demand,
           max(user_id) AS last_service
    FROM events GROUP BY 1, 2""",
    "weather_json": f"""WITH {WEATHER_SQL}
    SELECT CAST(date AS VARCHAR) AS date, precip_mm, coalesce(precip_mm > 1, false) AS rained
    FROM wx""",
    "holiday_dimension": f"""WITH {HOLIDAYS_SQL}
    SELECT CAST(date AS VARCHAR) AS date, holiday_name FROM hol""",
    "unit_labels": """
    SELECT s_suppkey AS service_id, r_name || ' - ' || n_name AS unit_sector
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
}

QUERIES = {
    f.__name__: f
    for f in (
        dimension_enrich, spike_clean, holiday_contrast, rain_contrast, season_rain_contrast,
        common_services, period_contrast, daily_stats, fd_histogram, smoothed_series,
        outbreak_means, outbreak_labels, daily_grid, grid_gaps, slot_duplicates, holiday_days,
        holiday_span, unit_labels, rejected_text, clean_panel, clean_users, clean_hot_service,
        long_intervals, sector_outbreaks, malformed_text, rewritten_panel, typed_text, weather_json, holiday_dimension,
    )
}
