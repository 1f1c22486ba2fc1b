"""Input tables and station files."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.parse import NULL_TOKENS, norm_key, parse_time, parse_value

# Encodings of station files, in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030", "big5", "latin1")
# Words in a header that tell what a column holds.
TIME_HEADERS = ("time", "date", "日期", "时间", "时刻", "datetime", "年月日", "年")
STATION_HEADERS = ("station", "站名", "站码", "站号", "测站", "站点", "stcd", "stid", "name", "id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decode_text(data: bytes) -> tuple[str, str]:
    """Text and the first encoding that fits; a byte order mark decides by itself."""
    tried = ("utf-16", *ENCODINGS) if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ENCODINGS
    for encoding in tried:
        try:
            return data.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")  # latin1 fits everything


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 0, line) of text files in any of ENCODINGS. A file is decoded whole by one task, as its encoding holds for all of it."""

    def run(batches):
        import pandas as pd

        for rows in batches:
            for name, data in zip(rows.path, rows.content, strict=True):
                lines = decode_text(bytes(data))[0].splitlines()
                yield pd.DataFrame({"path": name, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line_no long, line string")


def sniff_delimiter(lines: list[str]) -> str:
    """The one of comma, tab and semicolon that the first lines have most of; else the full-width comma; else white space (a pattern)."""
    head = "\n".join(lines[:5])
    best = max((",", "\t", ";"), key=head.count)
    return best if head.count(best) else "，" if "，" in head else r"\s+"


def _told(name: str, hints: tuple[str, ...]) -> bool:
    """Whether a header holds a hint; Latin ones must be the whole header or one of its words."""
    words = re.split(r"[^a-z0-9]+", name.strip().lower())
    return any(h in words if h.isascii() else h in name for h in hints)


def column_roles(header: list[str]) -> dict[str, list[int]]:
    """Positions of the time column (0 if none tells), station columns and the others."""
    time = next((i for i, h in enumerate(header) if _told(h, TIME_HEADERS)), 0)
    station = [i for i, h in enumerate(header) if i != time and _told(h, STATION_HEADERS)]
    return {"time": [time], "station": station[:1], "value": [i for i in range(len(header)) if i != time and i not in station[:1]]}


def parse_long(rows: DataFrame, time: str, station: str | Column, value: str, scale: float = 1.0) -> DataFrame:
    """(station, ts, value) of a table with a row for each reading; rows without a time or value are left out."""
    key = F.col(station) if isinstance(station, str) else station
    out = rows.select(key.alias("station"), parse_time(F.col(time)).alias("ts"), parse_value(F.col(value), scale).alias("value"))
    return out.where("ts is not null and value is not null")


def parse_wide(rows: DataFrame, time: str, values: list[str], scale: float = 1.0) -> DataFrame:
    """(station, ts, value) of a table with a column for each station."""
    texts = rows.select(parse_time(F.col(time)).alias("ts"), *[F.col(v).cast("string").alias(v) for v in values])
    return parse_long_values(texts.unpivot(["ts"], values, "station", "text"), scale)


def parse_long_values(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    out = rows.select("station", "ts", parse_value(F.col("text"), scale).alias("value"))
    return out.where("ts is not null and value is not null")


#: Spellings of a time that are no plain number (as ``parse_time`` reads them), those that are, and a number.
_TIME = re.compile(r"\d{4}(?:[-/年]\d{1,2}(?:[-/月](?:\d{1,2}日?)?)?(?:[T ]+\d{1,2}:\d{1,2}(?::\d{1,2})?)?|年|\d{4}\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)$")
_DIGITS = re.compile(r"(?:\d{12}|\d{8}|\d{5}(?:\.\d+)?|\d{4})$")
_NUMBER = re.compile(r"[-+]?(?:\d[\d,，]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$")


def _plain(cell: str) -> str:
    return re.sub(r"\s+", " ", cell.replace('"', "").replace("'", "")).strip()


def _is_time(cell: str) -> bool:
    return bool(_TIME.match(_plain(cell)))


def _is_text(cell: str) -> bool:
    """Neither a spelling of no value nor a time nor a number."""
    x = _plain(cell)
    return x.lower() not in NULL_TOKENS and not _TIME.match(x) and not _NUMBER.match(x)


def split_rows(text: str) -> tuple[list[list[str]], str]:
    """The rows of a table and its delimiter, as its first five lines that are not blank tell it; blank rows go.

    Quotes may hold the delimiter, line ends and doubled quotes. If one is never closed, every line is a row by itself.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    mark = sniff_delimiter(lines)
    if mark == r"\s+":
        rows = [x.split() for x in lines]
    elif mark == "，":
        rows = [x.split(mark) for x in lines]
    else:
        whole = text.count('"') % 2 == 0
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=mark)) if whole else [row for x in lines for row in csv.reader([x], delimiter=mark)]
    return [row for row in rows if any(c.strip() for c in row)], mark


def table_start(rows: list[list[str]]) -> tuple[list[str] | None, int]:
    """The header, if there is one, and where the readings begin.

    A row is like a header if at most one of its cells is a number or no value and none a time in full spelling. The first
    other row of two cells at least begins the readings. Of the rows before it that are like headers and have several
    cells, the first that names a time is the header, else the first: lines of a title above and units below are passed over.
    """
    headers, start = [], len(rows)
    for n, row in enumerate(rows):
        if not any(map(_is_time, row)) and sum(map(_is_text, row)) >= max(1, len(row) - 1):
            headers.append(row)
        elif len(row) > 1:
            start = n
            break
    several = [row for row in headers if len(row) > 1] or headers[:1] * (start == len(rows))
    return next((row for row in several if any(_told(c, TIME_HEADERS) for c in row)), several[0] if several else None), start


def value_roles(rows: list[list[str]]) -> dict[str, list[int]]:
    """Roles of the columns of a table without header, by its first rows: the time is the first date, else the first number of digits that can be one; a text is the station; the others are values."""
    head, width = rows[:20], max(map(len, rows[:20]))
    column = [[_plain(row[i]) if i < len(row) else "" for row in head] for i in range(width)]
    full = [i for i, cells in enumerate(column) if any(map(_TIME.match, cells))]
    digits = [i for i, cells in enumerate(column) if any(cells) and all(not c or _DIGITS.match(c) for c in cells)]
    time = (full or digits or [0])[0]
    station = [i for i, cells in enumerate(column) if i != time and i not in full and any(c and not _NUMBER.match(c) and c.lower() not in NULL_TOKENS for c in cells)][:1]
    return {"time": [time], "station": station, "value": [i for i in range(width) if i != time and i not in station and i not in full]}


def readings_of(name: str, data: bytes) -> tuple[list[int], list[str | None], list[str | None], list[str | None]]:
    """(rows, stations, times, values) as text of one station file, long or wide: a reading for each row and value column."""
    rows, _ = split_rows(decode_text(data)[0])
    header, start = table_start(rows)
    body = rows[start:]
    if not body:
        return [], [], [], []
    names = [h.strip(' "') for h in header] if header else []
    roles = column_roles(names) if header else value_roles(body)
    time, station, values = roles["time"][0], roles["station"], roles["value"]
    cell = lambda row, i: row[i].strip(' "') if i < len(row) else None
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if station or len(values) == 1:
        named = [cell(row, station[0]) if station else stem for row in body]
        return list(range(len(body))), named, [cell(row, time) for row in body], [cell(row, values[0]) if values else None for row in body]
    told = [names[i] if header else f"c{i}" for i in values]
    number = [n for n in range(len(body)) for _ in values]
    return number, told * len(body), [cell(row, time) for row in body for _ in values], [cell(row, i) for row in body for i in values]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, station, time, text) of every file at ``path``, long or wide; station of a file without such a column is the file's name.

    A file is read once, by one task, which tells its encoding, delimiter and columns; nothing goes to the driver. A file
    without readings has one row of nulls (of an empty file, which Spark's reader leaves out, none).
    """

    def run(batches):
        import pandas as pd

        for rows in batches:
            for name, data in zip(rows.path, rows.content, strict=True):
                found = readings_of(name, bytes(data))
                found = found if found[0] else ([None], [None], [None], [None])
                yield pd.DataFrame({"path": [name] * len(found[0])} | dict(zip(("row", "station", "time", "text"), found, strict=True)), dtype=object).astype({"row": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, station string, time string, text string")


def read_series_text(spark: SparkSession, path: str) -> DataFrame:
    """(station, ts, value) of every file at ``path``, long or wide."""
    return parse_long(read_cells(spark, path), "time", "station", "text")


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, bad_rows, series, readings) of every file at ``path``: rows without a time are bad; a file that gives nothing has zeros."""
    cells = read_cells(spark, path).withColumns({"ts": parse_time(F.col("time")), "value": parse_value(F.col("text"))})
    read = F.col("ts").isNotNull() & F.col("value").isNotNull()
    return cells.groupBy("path").agg(
        F.count_distinct("row").alias("rows"), F.count_distinct(F.when(F.col("ts").isNull(), F.col("row"))).alias("bad_rows"), F.count_distinct(F.when(read, F.col("station"))).alias("series"), F.count_if(read).alias("readings")
    )


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """Cells (i row from the top, j column, z; no-data cells left out) and the header values of an ESRI ASCII grid.

    A folder of part files is one raster: the part that begins with ``ncols`` holds the header, and rows go on from part to
    part in the order of their names. Several headers are an error.
    """
    lines = text_files(spark, path)
    top = lines.where((F.col("line_no") == 0) & F.lower(F.ltrim("line")).startswith("ncols")).select("path", F.lit(6).alias("top"))
    head = [r.line.split() for r in lines.where("line_no < 6").join(top, "path").orderBy("line_no").limit(12).collect()]
    if len(head) != 6:
        raise ValueError("an ESRI ASCII grid has one header of six lines")
    values = {k.lower(): float(v) for k, v in head}
    files = lines.where("trim(line) != ''").groupBy("path").agg(F.count("*").alias("n")).join(top, "path", "left").withColumn("n", F.col("n") - F.coalesce("top", F.lit(0)))  # a row for each file
    before = files.withColumn("before", F.sum("n").over(Window.orderBy("path")) - F.col("n")).select("path", "before", F.coalesce("top", F.lit(0)).alias("top"))
    rows = lines.where("trim(line) != ''").join(before, "path").where("line_no >= top")
    cells = rows.select((F.col("line_no") - F.col("top") + F.col("before")).cast("int").alias("i"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "text"))
    cells = cells.select("i", "j", F.col("text").try_cast("double").alias("z"))
    return cells.where(F.col("z").isNotNull() & (F.abs(F.col("z") - values.get("nodata_value", -9999.0)) > 1e-6)), values


def header_keys(rows: DataFrame) -> DataFrame:
    """A table's columns renamed to their comparing form."""
    names = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(rows.columns)], "i int, name string").select("i", norm_key(F.col("name")).alias("key")).orderBy("i").collect()
    return rows.toDF(*[r.key for r in names])
