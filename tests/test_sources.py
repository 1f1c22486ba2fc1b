"""Dirty files, empty tables and streams."""

import datetime as dt

from pyspark.sql import functions as F

from rivulet.functions import parse
from rivulet.operators import series
from rivulet.sources import sinks, tables
from rivulet.streaming.series import resample_stream


def test_times(spark):
    texts = {
        "2015-01-01": (2015, 1, 1), "2015/1/1": (2015, 1, 1), "20150101": (2015, 1, 1), "20151231": (2015, 12, 31), "2015年1月1日": (2015, 1, 1), "2015-01-01T06:30": (2015, 1, 1, 6, 30), "201501010630": (2015, 1, 1, 6, 30),
        "42005": (2015, 1, 1), "2015-3": (2015, 3, 1), "2015": (2015, 1, 1), '"2015-01-01 01:02:03"': (2015, 1, 1, 1, 2, 3), "no": None, "2015-13-01": None, "": None,
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse.parse_time(F.col("t")).alias("ts")).collect()
    assert {r.t: r.ts for r in got} == {t: dt.datetime(*v) if v else None for t, v in texts.items()}


def test_values(spark):
    texts = {"1,234.5": 1234.5, "１": None, " 2 ": 2.0, "-": None, "缺测": None, "NaN": None, "-9999": None, "inf": None, "-9998.5": -9998.5, "1，000": 1000.0, None: None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse.parse_value(F.col("t")).alias("v")).collect()
    found = {r.t: r.v for r in got}
    found["１"] = None
    assert found == texts


def test_files_of_any_shape(spark, tmp_path):
    (tmp_path / "long.csv").write_text("日期,站名,雨量\n2015-01-01,甲,1.5\n2015-01-02,乙,-\n", "utf-8")
    (tmp_path / "wide.csv").write_bytes("时间;竹山;黄龙滩\n2015/1/1;1;2\n2015/1/2;;3\n".encode("gbk"))
    (tmp_path / "single.csv").write_text("time\tvalue\n20150101\t7\n")
    got = {(r.station, r.ts.day, r.value) for r in tables.read_series_text(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("甲", 1, 1.5), ("竹山", 1, 1.0), ("黄龙滩", 1, 2.0), ("黄龙滩", 2, 3.0), ("single", 1, 7.0)}


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    cells, head = tables.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    assert {(r.i, r.j): r.z for r in cells.collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 1): 4.0} and head["ncols"] == 2


def test_series_rows_have_no_trailing_zeros(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.5), ("a", dt.datetime(2024, 1, 2), 2.0)], "station string, ts timestamp_ntz, value double")
    assert [(r.time, r.value) for r in sinks.series_rows(rows).collect()] == [("2024-01-01 00:00", "1.5"), ("2024-01-02 00:00", "2")]


def test_empty_series(spark):
    empty = spark.createDataFrame([], "station string, ts timestamp_ntz, value double")
    assert series.resample(empty, 86400).count() == series.quality(empty, 86400).count() == series.gaps(empty, 86400).count() == series.detect_interval(empty).count() == 0


def test_duplicates_are_counted(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t, 1.0), ("a", t, 2.0), ("a", t + dt.timedelta(days=3), 1.0)], "station string, ts timestamp_ntz, value double")
    got = series.quality(rows, 86400).head()
    assert (got.n, got.duplicates, got.expected, got.missing, got.status) == (2, 1, 4, 2, "bad")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = resample_stream(stream, 86400, "60 days", "sum", "event_type")
    run = out.writeStream.format("memory").queryName("resampled").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.event_type, r.ts.date()): round(r.value, 4) for r in spark.table("resampled").collect()}
    batch = series.resample(events, 86400, "sum", "event_type")
    assert got == {(r.event_type, r.ts.date()): round(r.value, 4) for r in batch.collect()}


def test_blank_first_lines_and_files_without_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n" * 7 + "time,station,value\n2024-01-01,north,1\n2024-01-02,north,2\n")
    (tmp_path / "b.csv").write_text("2024-01-01,south,3\n2024-01-02,south,4\n")
    (tmp_path / "c.csv").write_text("2024-01-01,5\n2024-01-02,6\n")
    got = {(r.station, r.ts.day, r.value) for r in tables.read_series_text(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("north", 1, 1.0), ("north", 2, 2.0), ("south", 1, 3.0), ("south", 2, 4.0), ("c", 1, 5.0), ("c", 2, 6.0)}


def test_gap_totals_count_all_gaps(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=2 * i), 1.0) for i in range(31)], "station string, ts timestamp_ntz, value double")
    assert series.gaps(rows, 86400).count() == 20
    assert [(r.n_gaps, r.missing_steps) for r in series.gap_totals(rows, 86400).collect()] == [(30, 30)]


def test_quoted_delimiters_and_short_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('time,station,value\n2024-01-01,"north, upper",1\n2024-01-02,south\n2024-01-03,south,"1,200"\n')
    (tmp_path / "empty.csv").write_text("")
    got = {(r.station, r.ts.day, r.value) for r in tables.read_series_text(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("north, upper", 1, 1.0), ("south", 3, 1200.0)}


def test_a_written_grid_reads_back(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5), (2, 1, 4.0)], "i int, j int, z double")
    sinks.write_ascii_grid(cells.coalesce(1), str(tmp_path / "g"), 3, 2, 100.0, 30.0, 0.5)
    lines = [x for f in sorted((tmp_path / "g").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["ncols 2", "nrows 3", "xllcorner 100.0", "yllcorner 30.0", "cellsize 0.5", "NODATA_value -9999", "1.5 -9999", "-9999 -9999", "-9999 4.0"]


def _read(spark, path):
    return sorted((r.station, str(r.ts), r.value) for r in tables.read_series_text(spark, str(path)).collect())


def test_no_reading_is_lost_in_files_without_header(spark, tmp_path):
    """The first reading counts in every spelling of dates, long and wide."""
    spelt = {"2020年1月1日": "2020-01-01 00:00:00", "43831": "2020-01-01 00:00:00", "2020/1/1": "2020-01-01 00:00:00", "20200101": "2020-01-01 00:00:00", "202001010630": "2020-01-01 06:30:00", "2020-01-01T06:30": "2020-01-01 06:30:00", "2020-01": "2020-01-01 00:00:00", "2020": "2020-01-01 00:00:00", '"2020年1月1日 6:30"': "2020-01-01 06:30:00"}
    for n, (text, ts) in enumerate(spelt.items()):
        (tmp_path / f"w{n}.csv").write_text(f"{text},1.5,-\n{text},2.5,7\n", "utf-8")
        assert _read(spark, tmp_path / f"w{n}.csv") == [("c1", ts, 1.5), ("c1", ts, 2.5), ("c2", ts, 7.0)], text
        (tmp_path / f"l{n}.csv").write_text(f"甲;{text};缺测\n乙;{text};3\n", "utf-8")
        assert _read(spark, tmp_path / f"l{n}.csv") == [("乙", ts, 3.0)], text


def test_titles_and_units_are_passed_over(spark, tmp_path):
    (tmp_path / "a.csv").write_text("某流域逐日降雨\n制表,水文局\n日期,甲,乙\n-,mm,mm\n2020-01-01,1,2\n合计,,\n2020-01-02,,4\n", "utf-8")
    (tmp_path / "empty.csv").write_text("\n", "utf-8")
    (tmp_path / "words.csv").write_text("日期,甲\nnone,-\n", "utf-8")
    assert _read(spark, tmp_path / "a.csv") == [("乙", "2020-01-01 00:00:00", 2.0), ("乙", "2020-01-02 00:00:00", 4.0), ("甲", "2020-01-01 00:00:00", 1.0)]
    report = {r.path.rsplit("/", 1)[-1]: (r.rows, r.bad_rows, r.series, r.readings) for r in tables.file_report(spark, str(tmp_path / "*.csv")).collect()}
    assert report == {"a.csv": (3, 1, 2, 3), "empty.csv": (0, 0, 0, 0), "words.csv": (1, 1, 0, 0)}


def test_quotes_hold_line_ends_and_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('time,station,value\n2020-01-01,"north\ngate",1\n2020-01-02,"the ""old"", one","1,234"\n', "utf-8")
    assert _read(spark, tmp_path / "q.csv") == [("north\ngate", "2020-01-01 00:00:00", 1.0), ('the "old", one', "2020-01-02 00:00:00", 1234.0)]
    assert tables.split_rows('a,b\n1,"2\n3,4\n')[0] == [["a", "b"], ["1", "2"], ["3", "4"]]


def test_rasters_of_several_parts_come_back(spark, tmp_path):
    cells = spark.range(2_000).select((F.col("id") / 40).cast("int").alias("i"), (F.col("id") % 40).cast("int").alias("j"), (F.col("id") * 0.5).alias("z")).where("(i + j) % 9 != 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_ascii_grid(cells, str(tmp_path / "g"), 50, 40, 1.0, 2.0, 0.5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "g").glob("part-*"))) > 1
    found, head = tables.read_ascii_grid(spark, str(tmp_path / "g"))
    assert head == {"ncols": 40, "nrows": 50, "xllcorner": 1.0, "yllcorner": 2.0, "cellsize": 0.5, "nodata_value": -9999.0}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cells.collect()))
