import datetime as dt
import json

import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from slotcast.functions.checkpoints import shared_folder
from slotcast.operators.contrast import with_holidays
from slotcast.plans.panel import clean_panel
from slotcast.sources.demand import (
    DEMAND_COLUMNS,
    read_demand,
    read_organisation,
    read_panel,
    read_text_table,
    rejected_demand,
    write_panel,
)
from slotcast.sources.holidays import holiday_calendar, with_easter, year_range, years_of
from slotcast.sources.weather import rained, read_weather
from tests.frames import day, panel, rows


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_demand_text_is_read_by_name_and_typed(spark, tmp_path):
    path = write(tmp_path / "d.csv", "consultas;hora;data;idservico;extra\n"
                 "40;08:00;01/03/2024;7;x\n3.5;23:00;31/02/2024;8;y\nn;9h;02/03/2024;9;z\n")
    assert rows(read_demand(spark, path), "service_id") == [
        (7, dt.date(2024, 3, 1), 8, 40.0),
        (8, None, 23, 3.5),
        (9, dt.date(2024, 3, 2), None, None),
    ]


def test_raw_files_to_clean_panel(spark, tmp_path):
    demand = write(tmp_path / "d.csv", "idservico;data;hora;consultas\n"
                   "1;01/03/2024;08:00;10\n1;08/03/2024;08:00;40\n1;15/03/2024;08:00;14\n"
                   "1;22/03/2024;08:00;11\n2;01/03/2024;08:00;5\n")
    org = write(tmp_path / "o.csv", "idservico;setor;unidade;cliente;servico\n"
                "1;Adulto;U1;C1;Pronto\n1;Infantil;U1;C1;Pronto\n")
    clean = clean_panel(read_demand(spark, demand), read_organisation(spark, org), "2024-03-15")
    got = rows(clean.select("service_id", "sector", "date", "demand"), "service_id", "sector", "date")
    series = [("2024-03-01", 10.0), ("2024-03-08", 12.0), ("2024-03-15", 14.0)]
    assert got == [(1, s, day(d), v) for s in ("Adulto", "Infantil") for d, v in series] + [
        (2, None, dt.date(2024, 3, 1), 5.0)
    ]


def test_repeated_raw_rows_stay_apart_unless_asked(spark):
    demand = panel(spark, [(1, "2024-03-01", 8, 5.0), (1, "2024-03-01", 8, 7.0)],
                   "service_id long, date date, hour int, demand double")
    org = spark.createDataFrame([(1, "a")], "service_id long, sector string")
    clean = clean_panel(demand, org, "2024-12-31")
    assert sorted(r["demand"] for r in clean.collect()) == [5.0, 7.0]
    summed = clean_panel(demand, org, "2024-12-31", one_row_per_slot=True)
    assert [r["demand"] for r in summed.collect()] == [12.0]


def test_one_digit_dates_and_hours(spark, tmp_path):
    path = str(tmp_path / "short.csv")
    with open(path, "w") as f:
        f.write("idservico;data;hora;consultas\n1;1/2/2024;8:00;3\n2;31/02/2024;23:59;4\n3;1/2/2024;x;1\n")
    got = read_demand(spark, path)
    assert rows(got, "service_id") == [
        (1, day("2024-02-01"), 8, 3.0), (2, None, 23, 4.0), (3, day("2024-02-01"), None, 1.0)]
    raw = read_text_table(spark, path, DEMAND_COLUMNS)
    bad = rejected_demand(raw).orderBy("service_id").collect()
    assert [(r["service_id"], r["rejected"]) for r in bad] == [("2", ["date"]), ("3", ["hour"])]
    with pytest.raises(Exception, match="does not parse"):
        read_demand(spark, path, strict=True).collect()


def test_rows_with_a_wrong_number_of_fields(spark, tmp_path):
    path = write(tmp_path / "m.csv", "data;idservico;hora;consultas\n01/03/2024;1;08:00;3\n02/03/2024;2;09:00\n"
                 "03/03/2024;3;10:00;5;9\n31/02/2024;4;11:00;6\n;;;\n04/03/2024;6;12:00;7;8;9\n")
    got = read_demand(spark, path)
    assert rows(got.select("service_id", "demand"), "service_id") == [(None, None), (1, 3.0), (4, 6.0)]
    raw = read_text_table(spark, path, DEMAND_COLUMNS)
    bad = rejected_demand(raw).orderBy("service_id").collect()
    assert [(r["service_id"], r["demand"], r["rejected"], r["malformed"]) for r in bad] == [
        ("2", None, ["fields"], "02/03/2024;2;09:00"), ("3", "5", ["fields"], "03/03/2024;3;10:00;5;9"),
        ("4", "6", ["date"], None), ("6", "7", ["fields"], "04/03/2024;6;12:00;7;8;9"),
    ]
    with pytest.raises(Exception, match="wrong number of fields"):
        read_demand(spark, path, strict=True).collect()


def test_text_without_a_header(spark, tmp_path):
    path = write(tmp_path / "n.csv", "1;01/03/2024;08:00;3\n2;01/03/2024\n")
    got = read_demand(spark, path, names=["idservico", "data", "hora", "consultas"])
    assert rows(got, "service_id") == [(1, day("2024-03-01"), 8, 3.0)]


def test_a_year_is_written_again_and_others_stay(spark, tmp_path):
    p = panel(spark, [(1, "a", "2023-12-31", 1, 1.0), (1, "a", "2024-01-01", 2, 2.0), (1, "a", "2024-05-01", 2, 2.5)])
    path = str(tmp_path / "p")
    write_panel(p, path)
    again = panel(spark, [(2, "b", "2024-02-01", 3, 9.0), (2, "b", "2025-02-01", 3, 8.0)])
    for _ in range(2):
        write_panel(again, path, years=True)
        got = rows(read_panel(spark, path).select("date", "demand"), "date")
        assert got == [(day("2023-12-31"), 1.0), (day("2024-02-01"), 9.0), (day("2025-02-01"), 8.0)]
    write_panel(again.limit(0), path, years=True)
    assert read_panel(spark, path).count() == 3


def test_a_cluster_without_a_shared_folder_is_told_so():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf({"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse", **conf})
            self.sparkContext = type("C", (), {"master": master})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("local-cluster[2,1,1024]"))
    assert shared_folder(Session("local[8]")) == "file:/home/x/spark-warehouse/_checkpoints"
    assert shared_folder(Session("yarn", **{"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    assert shared_folder(Session("yarn", **{"spark.sql.warehouse.dir": "hdfs:///w"})) == "hdfs:///w/_checkpoints"


def test_names_of_a_calendar_on_one_date_do_not_multiply_rows(spark):
    p = panel(spark, [(1, "a", "2024-03-01", 8, 5.0)])
    calendar = spark.sql("SELECT date'2024-03-01' AS date, explode(array('y', 'x', 'x')) AS holiday_name")
    got = with_holidays(p, calendar).collect()
    assert [(r["holiday_name"], r["is_holiday"]) for r in got] == [("x; y", True)]


def test_holidays_of_any_year(spark):
    p = panel(spark, [(1, "a", d, 0, 1.0) for d in ("1899-12-25", "2101-12-25", "2101-04-15", "2101-04-16")])
    got = rows(with_holidays(p).select("date", "holiday_name"), "date")
    assert [n for _, n in got] == [None, "Sexta-feira Santa", None, "Natal"]


def test_weather_arrays(spark, tmp_path):
    body = {"daily": {"time": ["2024-01-01", "2024-01-02", "bad"], "precipitation_sum": [1.5, None, 3]}}
    path = write(tmp_path / "w.json", json.dumps(body, indent=1))
    got = rows(read_weather(spark, path).withColumn("rained", rained()), "date")
    assert got == [(None, 3.0, True), (day("2024-01-01"), 1.5, True), (day("2024-01-02"), None, False)]


def test_nan_rain_counts_as_dry(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (1.1,)], "precip_mm double")
    assert [r[0] for r in df.select(rained()).collect()] == [False, False, True]


def test_panel_round_trip_prunes_years(spark, tmp_path):
    p = panel(spark, [(1, "a", "2023-12-31", 1, 1.0), (1, "a", "2024-01-01", 2, 2.0),
                      (1, "a", "2025-01-01", 3, 3.0)])
    write_panel(p, str(tmp_path / "p"))
    back = read_panel(spark, str(tmp_path / "p"), "2024-01-01", "2025-01-01")
    assert rows(back.select("date", "demand"), "date") == [(day("2024-01-01"), 2.0)]
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(date)" in plan


def test_easter_matches_public_algorithm(spark):
    got = {r["year"]: r["easter"] for r in with_easter(year_range(spark, 1900, 2100)).collect()}
    assert got == {y: easter(y) for y in range(1900, 2101)}


def test_holidays_of_a_year(spark):
    got = rows(holiday_calendar(year_range(spark, 2023, 2024)), "date")
    by_year = {y: [n for d, n in got if d.year == y] for y in (2023, 2024)}
    assert len(by_year[2023]) == 9 and len(by_year[2024]) == 10
    assert (day("2024-03-29"), "Sexta-feira Santa") in got
    assert "Consciência Negra" in dict(got)[day("2024-11-20")]


def test_two_holidays_on_one_date(spark):
    got = dict(rows(holiday_calendar(year_range(spark, 2000, 2000)), "date"))
    assert got[day("2000-04-21")] == "Sexta-feira Santa; Tiradentes"


def test_years_of_an_empty_table(spark):
    p = panel(spark, [(1, "a", "2023-12-31", 1, 1.0), (1, "a", "2025-01-01", 2, 2.0)])
    assert rows(years_of(p), "year") == [(2023,), (2024,), (2025,)]
    assert years_of(p.filter(F.lit(False))).count() == 0
