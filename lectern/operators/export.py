"""Report output: ordered parts, named CSV files with heading, manifest, preview values, retention."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.skew import join_hot
from lectern.session import cut_lineage

# Default limits of the exporter.
CSV_ROWS_PER_FILE = 2_000_000
MAX_FILES_PER_USER = 100

BYTE_ORDER_MARK = "\ufeff"

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def with_row_index(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Add ``idx``, the 0-based position in report order, without a global window.

    Without ``order`` the frame must end in its own sort, as every report does.
    The frame is range-sorted in parallel. Each row notes its partition and its
    position there; the sizes of the partitions before give the offset. The
    sorted rows are checkpointed, because sizes and rows must come from the
    same cut even if an executor is lost in between. Only the table of
    partition sizes passes through a single task and is broadcast: it has one
    row per sort partition, however many rows the report has.
    """
    mark = F.monotonically_increasing_id()
    ordered = df if order is None else df.orderBy(*order)
    placed = cut_lineage(ordered.withColumn("_mark", mark))
    placed = placed.select(
        "*",
        F.shiftright("_mark", _POSITION_BITS).alias("_partition"),
        F.col("_mark").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_position"),
    )
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_partition")
        .agg(F.count("*").alias("_size"))
        .select("_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_partition")
        .withColumn("idx", F.col("_offset") + F.col("_position"))
        .drop("_mark", "_partition", "_position", "_offset")
    )


def with_part(indexed: DataFrame, rows_per_file: int) -> DataFrame:
    """Row i goes to part i / rows_per_file + 1."""
    if rows_per_file < 1:
        raise ValueError("rows_per_file must be positive")
    part = F.call_function("div", F.col("idx"), F.lit(rows_per_file)) + 1
    return indexed.withColumn("parte", part.cast("int"))


def assign_parts(df: DataFrame, order: list[Column] | None = None, rows_per_file: int = CSV_ROWS_PER_FILE) -> DataFrame:
    return with_part(with_row_index(df, order), rows_per_file)


def part_counts(parts: DataFrame) -> DataFrame:
    """Rows per part; an empty report still has part 1 with 0 rows."""
    counted = parts.groupBy("parte").agg(F.count("*").alias("filas"))
    first = parts.sparkSession.range(1).select(F.lit(1).alias("parte"), F.lit(0).cast("bigint").alias("filas"))
    return (
        counted.unionByName(first).groupBy("parte").agg(F.sum("filas").alias("filas"))
    )


def part_name(base: str, part: Column) -> Column:
    return F.format_string(f"{base}_parte_%03d.csv", part)


def manifest(counts: DataFrame, report: str, fmt: str, filters: dict, made_at: datetime) -> DataFrame:
    """One row per part: its rows and file, with what the export was made of."""
    given = [F.lit(x) for pair in sorted(filters.items()) if pair[1] is not None for x in map(str, pair)]
    filtros = F.create_map(*given) if given else F.create_map().cast("map<string,string>")
    return counts.select(
        F.lit(report).alias("reporte"),
        filtros.alias("filtros"),
        F.lit(fmt).alias("formato"),
        "parte",
        "filas",
        part_name(report, F.col("parte")).alias("archivo"),
        F.lit(made_at.isoformat()).alias("generado_en"),
    )


# Quotation marks are doubled; blanks at the ends of a value belong to it.
_CSV = {
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _line(*cells: Column) -> Column:
    """One CSV record; a line break inside a value is quoted with it."""
    return F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), _CSV)


def heading_rows(title: str, made_at: datetime, filters: list[tuple[str, object]]) -> list[tuple[str, str]]:
    """Heading of part 1: report name, date and time, then every filter."""
    rows = [
        ("Nombre del reporte", title),
        ("Fecha de generación", made_at.strftime("%Y/%m/%d")),
        ("Hora de generación", made_at.strftime("%H:%M:%S")),
    ]
    return rows + [(label, str(value) if value not in (None, "", []) else "Todos") for label, value in filters]


def file_lines(parts: DataFrame, counts: DataFrame, heading: list[tuple[str, str]]) -> DataFrame:
    """``parte``, ``place``, ``line`` of all files: heading and a blank line in part 1, the column names in
    every part, then the rows. Places before the rows are negative."""
    spark = parts.sparkSession
    names = [c for c in parts.columns if c not in ("idx", "parte")]
    body = parts.select("parte", F.col("idx").alias("place"), _line(*[F.col(f"`{c}`") for c in names]).alias("line"))
    first = F.when((F.col("parte") > 1) | F.lit(not heading), BYTE_ORDER_MARK).otherwise("")
    titles = counts.select(
        "parte", F.lit(-1).cast("bigint").alias("place"), F.concat(first, _line(*map(F.lit, names))).alias("line")
    )
    top = spark.createDataFrame(
        [(1, i - len(heading) - 2, label, value) for i, (label, value) in enumerate(heading)],
        "parte int, place bigint, label string, value string",
    )
    mark = F.when(F.col("place") == -len(heading) - 2, BYTE_ORDER_MARK).otherwise("")
    top = top.select("parte", "place", F.concat(mark, _line(F.col("label"), F.col("value"))).alias("line"))
    blank = spark.createDataFrame([(1, -2, "")] if heading else [], "parte int, place bigint, line string")
    return body.unionByName(titles).unionByName(top).unionByName(blank)


def write_csv_parts(
    df: DataFrame,
    order: list[Column] | None,
    path: str,
    report: str,
    rows_per_file: int = CSV_ROWS_PER_FILE,
    filters: dict | None = None,
    title: str | None = None,
    made_at: datetime | None = None,
    heading: list[tuple[str, object]] | None = None,
) -> DataFrame:
    """Write the ordered parts as ``<report>_parte_NNN.csv`` and the manifest; return rows per part.

    Executors write the files, one task per part, because a part is bounded by
    ``rows_per_file``; only their names are given on the driver.
    """
    made_at = made_at or datetime.now()
    filters = filters or {}
    spark = df.sparkSession
    parts = file_values(assign_parts(df, order, rows_per_file))
    counts = part_counts(parts)
    shown = sorted(filters.items()) if heading is None else heading
    lines = file_lines(parts, counts, heading_rows(title or report, made_at, shown))
    aside = f"{path}/_lines-{uuid.uuid4().hex}"
    lines.repartition("parte").sortWithinPartitions("parte", "place").select("parte", "line").write.partitionBy(
        "parte"
    ).text(aside)
    _name_parts(spark, aside, path, report)
    manifest(counts, report, "csv", filters, made_at).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return counts.withColumn("archivo", part_name(report, F.col("parte")))


def _name_parts(spark, aside: str, path: str, report: str) -> None:
    """Move the one file of every part to its name; parts of an earlier export go."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in fs.globStatus(hadoop.Path(f"{path}/{report}_parte_*.csv")) or ():
        fs.delete(old.getPath(), False)
    for made in fs.globStatus(hadoop.Path(f"{aside}/parte=*/part-*")):
        part = int(made.getPath().getParent().getName().partition("=")[2])
        if not fs.rename(made.getPath(), hadoop.Path(f"{path}/{report}_parte_{part:03d}.csv")):
            raise OSError(f"could not name part {part} in {path}")
    fs.delete(hadoop.Path(aside), True)


def read_csv_parts(spark, path: str, report: str, schema: T.StructType) -> DataFrame:
    """Rows of the named parts as text, without headings, with their part number."""
    names = [f.name for f in schema.fields]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"escape": '"', "nullValue": "\u0000", "emptyValue": "", "multiLine": "true"}
    file = F.regexp_extract(F.col("_metadata.file_name"), r"_parte_(\d+)\.csv$", 1).cast("int")
    # A file of quoted line breaks is read by one task, so ids grow along it.
    rows = (
        spark.read.schema(text).options(**options).csv(f"{path}/{report}_parte_*.csv")
        .select(*[F.col(f"`{n}`") for n in names], file.alias("parte"), F.monotonically_increasing_id().alias("_place"))
    )
    titles = reduce(and_, [F.ltrim(F.col(f"`{n}`"), F.lit(BYTE_ORDER_MARK)) == n for n in names])
    starts = rows.filter(titles).groupBy("parte").agg(F.min("_place").alias("_titles"))
    return rows.join(starts, "parte").filter(F.col("_place") > F.col("_titles")).select(*names, "parte")


def read_heading(spark, path: str, report: str) -> DataFrame:
    """``line``, ``text``: the lines of part 1 up to its column names, blank line included."""
    lines = spark.read.text(f"{path}/{report}_parte_001.csv", wholetext=True)
    before = F.split(F.ltrim(F.col("value"), F.lit(BYTE_ORDER_MARK)), "\n\n", 2)[0]
    return lines.select(F.posexplode(F.split(before, "\n")).alias("line", "text"))


def _iso(name: str, kind: T.DataType) -> Column:
    column = F.col(name)
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(column, ".SSSSSS")
        return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))
    if isinstance(kind, T.DecimalType):
        return column.cast("double")
    return column


def preview_values(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, decimals as doubles."""
    return df.select(*[_iso(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def file_values(df: DataFrame) -> DataFrame:
    """Preview values as text, with NULL as the empty string; row marks stay numbers."""
    shown = preview_values(df)
    return shown.select(
        *[
            F.col(f.name)
            if f.name in ("idx", "parte")
            else F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name)
            for f in shown.schema.fields
        ]
    )


def expire_old_files(t_requests: DataFrame, keep: int = MAX_FILES_PER_USER) -> DataFrame:
    """Finished files beyond the newest ``keep`` per user become expired.

    Only the ``keep`` newest rows of a user are ranked (Spark cuts each
    partition to ``keep`` rows before the shuffle); older rows are found by
    comparing with the oldest kept one, so a user holding a third of all
    requests is never sorted by one task.
    """
    has_file = (F.col("estado") == "FINALIZADO") & F.col("archivo_ruta").isNotNull()
    # Newest first with unset times first, as the request log sorts them.
    age = F.struct(F.coalesce("fecha_fin", F.lit(9223372036854775807)).alias("at"), F.col("id"))
    finished = t_requests.filter(has_file).select("usuario_email", age.alias("age"))
    rank = F.row_number().over(Window.partitionBy("usuario_email").orderBy(F.col("age").desc()))
    limits = (
        finished.withColumn("rn", rank)
        .filter(F.col("rn") <= keep)
        .groupBy("usuario_email")
        .agg(F.min("age").alias("oldest"), F.count("*").alias("kept"))
        .filter(F.col("kept") == keep)
        .drop("kept")
    )
    expired = has_file & F.col("oldest").isNotNull() & (age < F.col("oldest"))
    flagged = join_hot(t_requests, limits, "left", ["usuario_email"]).withColumn(
        "_expired", F.coalesce(expired, F.lit(False))
    )
    return flagged.select(
        "id",
        "usuario_email",
        F.when(F.col("_expired"), "EXPIRADO").otherwise(F.col("estado")).alias("estado"),
        F.when(~F.col("_expired"), F.col("archivo_ruta")).alias("archivo_ruta"),
        "fecha_fin",
    )


def recent_requests(t_requests: DataFrame, email: str, limit: int = MAX_FILES_PER_USER) -> DataFrame:
    """A user's newest requests."""
    return (
        t_requests.filter(F.col("usuario_email") == email)
        .orderBy(F.col("fecha_solicitud").desc_nulls_first(), F.col("id").desc())
        .limit(limit)
    )
