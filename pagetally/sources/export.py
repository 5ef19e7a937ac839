"""Results as CSV text and as JSON sheets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def _number_text(value: Column) -> Column:
    """A float as plain digits without a trailing ``.0``, with an exponent only from 1e21 or below 1e-6."""
    size = F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,16)").cast("string"), "0+$", ""), r"\.$", "")
    tiny = F.regexp_replace(value.cast("decimal(38,37)").cast("string"), "0+$", "")
    text = F.regexp_replace(value.cast("string"), r"\.0(E|$)", "$1")
    power = F.regexp_replace(F.regexp_replace(text, r"E(\d)", "e+$1"), "E-", "e-")
    return (
        F.when((value == F.floor(value)) & (size < 1e15), value.cast("bigint").cast("string"))
        .when((size >= 1e7) & (size < 1e21), plain)
        .when((size < 1e-3) & (size >= 1e-6), tiny)
        .otherwise(power)
    )


def _field(df: DataFrame, name: str) -> Column:
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        text = F.upper(value.cast("string"))
    elif isinstance(kind, NUMBERS):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _number_text(value.cast("double"))
    else:
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            value = F.to_json(value)
        text = F.concat(F.lit('"'), F.replace(value.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(text, F.lit("null"))


def csv_lines(df: DataFrame) -> DataFrame:
    """One text line per row: text quoted with doubled quotes, booleans in capitals, numbers bare."""
    return df.select(F.concat_ws(",", *[_field(df, c) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files that together, in order of their names, are the CSV text: header first, then the rows
    in the order of ``df``. A result without rows gives no header either.

    ``df`` is evaluated once: its rows are counted as they are written, and the header is added after them.
    """
    seen = Observation()
    csv_lines(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").text(path)
    if not seen.get["n"]:
        return
    spark = df.sparkSession
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # sorts before all numbers of parts; under a name that is not read until it is whole
    stream = files.create(made(f"{path}/_header"), True)
    stream.write(bytearray((",".join(df.columns) + "\n").encode()))
    stream.close()
    files.rename(made(f"{path}/_header"), made(f"{path}/part--header.txt"))


def sheet_rows(df: DataFrame) -> DataFrame:
    """Result rows of a sheet as JSON objects that keep nulls."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def sheet_meta(df: DataFrame, description: str, request: dict, details: dict) -> DataFrame:
    """Rows (name, value, type): description, request parameters, output columns. Never the key."""
    rows = [("description", description, "query description")]
    rows += [(k, str(v), "request parameter") for k, v in request.items() if k != "domainkey"]
    rows += [(k, str(v), "response detail") for k, v in details.items()]
    session = df.sparkSession
    return session.createDataFrame(rows, "name string, value string, type string")


def sheet_frame(df: DataFrame, limit: int, offset: int = 0, total: int | None = None, truncated: bool = False) -> dict:
    """Frame of a sheet around its rows: limit, offset, total, columns."""
    shown = df.count()
    return {
        "limit": max(limit or 1, shown), "offset": offset, "total": total or shown + int(truncated),
        "columns": df.columns if shown else [],
    }


def write_sheet(df: DataFrame, path: str, limit: int, description: str, request: dict, details: dict) -> None:
    """Folder with ``results`` and ``meta`` as JSON lines and ``frame`` as one JSON object each."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/results")
    stored = df.sparkSession.read.schema(df.schema).json(f"{path}/results")
    meta = sheet_meta(df, description, request, details)
    meta.write.json(f"{path}/meta")
    frames = [("results", sheet_frame(stored, limit)), ("meta", sheet_frame(meta, 1))]
    rows = [(name, f["limit"], f["offset"], f["total"], f["columns"]) for name, f in frames]
    schema = "name string, limit bigint, offset bigint, total bigint, columns array<string>"
    df.sparkSession.createDataFrame(rows, schema).coalesce(1).write.json(f"{path}/frame")
