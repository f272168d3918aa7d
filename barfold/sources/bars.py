"""Reading and writing bar files."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barfold import schema
from barfold.operators import blocks
from barfold.panel import HOUR, OHLCV, RAW_TIME, Panel, normalize_time, ntz
from barfold.session import require_utc

# Named sets of reading options.
PRESETS: dict[str, dict] = {
    "tick": {
        "features": (),
        "time_col": RAW_TIME,
        "ohlcv": {c: c for c in OHLCV},
        "use_cols": None,
    },
    "univariate": {
        "features": ("close",),
        "time_col": RAW_TIME,
        "ohlcv": {"close": "close"},
        "use_cols": ("close",),
    },
}

MASTER_SCHEMA = T.StructType(
    [T.StructField(RAW_TIME, T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (*OHLCV, "funding_rate")]
)


def asset_of_file() -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)


#: Most different headers in one read: each is a scan of its own in the plan.
MOST_HEADERS = 200


def file_headers(spark: SparkSession, paths: Sequence[str], **csv_options) -> dict[tuple[str, ...], list[str]]:
    """The different headers of CSV files, each with the files that have it.

    The files' first lines are found on the executors; headers and file names reach
    the driver, as they do when Spark lists the files. Files without a line are left out.
    """
    text_options = {k: v for k, v in csv_options.items() if k in ("encoding", "lineSep", "pathGlobFilter", "recursiveFileLookup")}
    lines = spark.read.options(**text_options).text(list(paths))
    # The metadata have escaped names.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    first = lines.select(
        name.alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"), "value",
    ).filter((F.col("at") == 0) & (F.trim("value") != ""))
    found = first.groupBy("path").agg(F.min_by("value", "row").alias("head"))
    sep, quote = csv_options.get("sep", csv_options.get("delimiter", ",")), csv_options.get("quote", '"')
    out: dict[tuple[str, ...], list[str]] = {}
    for r in found.orderBy("path").collect():
        head = next(csv.reader([r.head.lstrip("\ufeff")], delimiter=sep, quotechar=quote))
        out.setdefault(tuple(head), []).append(r.path)
    return out


def _by_name(
    spark: SparkSession, paths: Sequence[str], types: Mapping[str, T.DataType], asset_from: str, options: dict
) -> tuple[DataFrame, list[str]]:
    """``asset`` and the columns of ``types`` that any file has, found by header name;
    NULL where a file lacks one."""
    groups = file_headers(spark, paths, **options)
    if len(groups) > MOST_HEADERS:
        raise ValueError(f"{len(groups)} different headers; at most {MOST_HEADERS} can be read at once")
    have = [c for c in types if any(c in head for head in groups)]
    out = None
    for head, files in groups.items():
        # Every file of a group has its fields in this order; a repeated name counts once.
        fields = [
            T.StructField(c if c in types and c not in head[:n] else f"_unused{n}", types.get(c, T.StringType()) if c not in head[:n] else T.StringType())
            for n, c in enumerate(head)
        ]
        reader = spark.read.options(**options)
        if asset_from == "folder":
            reader = reader.option("basePath", paths[0])
            # Partition values are text: 0700 and 1e3 are names, not numbers.
            fields.append(T.StructField("asset", T.StringType()))
        source = list(paths) if len(groups) == 1 else [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in files]
        raw = reader.schema(T.StructType(fields)).csv(source)
        asset = asset_of_file() if asset_from == "file" else F.col("asset")
        columns = [F.col(c) if c in head else F.lit(None).cast(types[c]).alias(c) for c in have]
        part = raw.select(asset.alias("asset"), *columns)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("asset", T.StringType()), *[T.StructField(c, t) for c, t in types.items()]]))
        have = list(types)
    return out, have


def read_bars(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    preset: str | None = None,
    features: Sequence[str] | None = None,
    labels: Sequence[str] | None = None,
    time_col: str = RAW_TIME,
    ohlcv: Mapping[str, str] | None = None,
    use_cols: Sequence[str] | None = None,
    schema: T.StructType = MASTER_SCHEMA,
    asset_from: str = "file",
    **csv_options,
) -> Panel:
    """Bars out of header CSV files; explicit options beat the preset.

    Columns go by header name, file by file: their order is free, columns that nobody
    asks for are skipped, and one that only some files have is NULL in the others. Asked
    for are those of ``schema`` and any named as feature, label, price or in ``use_cols``
    (read as doubles when ``schema`` does not have them); one that no file has is left out.

    The asset is the file's name (``asset_from="file"``) or, for a folder such as
    ``export_csv`` writes, the partition ``asset=`` (``"folder"``).

    ``use_cols`` keeps the time column and the named ones in the given order.
    """
    require_utc(spark)
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {sorted(PRESETS)}")
    base = PRESETS.get(preset, {})
    features = base.get("features", ()) if features is None else features
    time_col = base.get("time_col", time_col) if time_col == RAW_TIME else time_col
    ohlcv = base.get("ohlcv", {c: c for c in OHLCV}) if ohlcv is None else ohlcv
    use_cols = base.get("use_cols") if use_cols is None else use_cols

    paths = [path] if isinstance(path, str) else list(path)
    named = [*features, *(labels or ()), *ohlcv.values(), *(use_cols or ())]
    types = {f.name: f.dataType for f in schema} | {
        c: T.DoubleType() for c in named if c not in schema.fieldNames()
    }
    types = {time_col: types.get(time_col, T.StringType())} | types
    if use_cols is not None:
        types = {c: types[c] for c in dict.fromkeys([time_col, *use_cols])}
    options = {"header": "true", "nanValue": "nan"} | csv_options
    table, columns = _by_name(spark, paths, types, asset_from, options)
    if time_col not in columns:
        raise ValueError(f"time column {time_col!r} not found in the files")
    timed = normalize_time(table, time_col, "time")
    values = [c for c in columns if c != time_col]
    doubles = [c for c in values if isinstance(types[c], T.DoubleType)]
    clean = timed.select(
        "asset",
        "time",
        *[F.nullif(c, F.lit(float("nan"))).alias(c) if c in doubles else c for c in values],
    )
    return Panel(clean, tuple(features), tuple(labels or ()), ohlcv=dict(ohlcv))


def scan_assets(spark: SparkSession, folder: str, **options) -> Panel:
    """All ``*.csv`` files of a folder, but for names starting with ``_``; one scan."""
    return read_bars(spark, folder.rstrip("/") + "/[!_]*.csv", preset="tick", **options)


def asset_names(panel: Panel) -> list[str]:
    """Sorted asset names; as many rows as assets reach the driver."""
    rows = panel.df.select(panel.asset).distinct().orderBy(panel.asset).collect()
    return [r[0] for r in rows]


def _unless(column: str, header: str) -> Column:
    """Header rows as NULL, whatever the order in which filter and cast are run."""
    return F.when(F.col(column) != header, F.col(column))


def epoch_to_ts(epoch: Column) -> Column:
    """Epoch milliseconds or microseconds, told apart by size, to UTC without zone."""
    value = epoch.cast("long")
    micros = F.when(value > F.lit(10**14), value).otherwise(value * 1000)
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def read_raw(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Headerless CSV as text columns, with the asset (the file's folder) and the
    place of each row: ``(file_name, file_block, row)`` is file order."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.schema(schema.all_text(list(columns))).csv(paths, header=False)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.select(
        folder.alias("asset"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("file_block"),
        # Increases along the rows of one file block.
        F.monotonically_increasing_id().alias("row"),
        "*",
    )


FILE_ORDER = ("file_name", "file_block", "row")


def normalize_klines(raw: DataFrame, order: Sequence[str] = FILE_ORDER) -> DataFrame:
    """Raw kline rows to bars: no header rows, UTC times, doubles, one row per time.

    Of rows with equal time the first by ``order`` is kept; remaining ties are
    broken by the values, so that the result never depends on task timing.
    """
    data = F.col("open_time") != schema.KLINE_HEADER
    values = [F.when(data, F.col(c)).cast("double").alias(c) for c in OHLCV]
    bars = raw.filter(data).select(
        "asset", epoch_to_ts(_unless("open_time", schema.KLINE_HEADER)).alias("time"), *order, *values
    )
    rank = F.struct(*order, *OHLCV)
    best = bars.groupBy("asset", "time").agg(
        F.min_by(F.struct(*OHLCV), rank).alias("bar")
    )
    return best.select("asset", "time", "bar.*")


def normalize_funding(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Raw funding rows to one rate per hour: the last one of the hour."""
    require_utc(raw.sparkSession)
    at = epoch_to_ts(_unless("calc_time", schema.FUNDING_HEADER))
    data = F.col("calc_time") != schema.FUNDING_HEADER
    rate = F.when(data, F.col("rate")).cast("double")
    rates = raw.filter(data).select(
        "asset",
        blocks.floor_time(at, "hour").alias("time"),
        F.struct(at.alias("at"), *order, rate.alias("last")).alias("rank"),
        rate.alias("rate"),
    )
    return rates.groupBy("asset", "time").agg(F.max_by("rate", "rank").alias("funding_rate"))


def attach_funding(bars: DataFrame, funding: DataFrame, start, end) -> DataFrame:
    """Clip bars to ``[start, end]``, join the hourly rate (0 where none), add ISO time."""
    clipped = bars.filter(F.col("time").between(ntz(start), ntz(end)))
    iso = F.date_format(F.col("time"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    joined = clipped.join(funding, ["asset", "time"], "left")
    return joined.select(
        iso.alias(RAW_TIME),
        "asset",
        "time",
        *OHLCV,
        F.coalesce("funding_rate", F.lit(0.0)).alias("funding_rate"),
    )


def write_bars(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Parquet, partitioned by asset; a large asset spans many files."""
    spread = F.floor(blocks.grid_position("time", HOUR) / blocks.BLOCK_ROWS)
    (
        df.repartition("asset", spread)
        .sortWithinPartitions("asset", "time")
        .write.mode(mode)
        .partitionBy("asset")
        .parquet(path)
    )


def read_bar_table(spark: SparkSession, path: str) -> Panel:
    """What ``write_bars`` wrote."""
    columns = ["asset", "time", *OHLCV]
    found = spark.read.parquet(path).schema
    # Partition values are text: 0700 and 1e3 are names, not numbers.
    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "asset" else f.dataType) for f in found]
    )
    df = spark.read.schema(schema).parquet(path)
    extra = [c for c in df.columns if c not in columns]
    return Panel(df.select(*columns, *extra))


def export_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """The same bars as header CSV, one folder per asset, in time order."""
    iso = F.date_format(F.col("time"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    names = [c for c in df.columns if c not in ("asset", "time", RAW_TIME)]
    spread = F.floor(blocks.grid_position("time", HOUR) / blocks.BLOCK_ROWS)
    (
        df.select("asset", "time", iso.alias(RAW_TIME), *names)
        .repartition("asset", spread)
        .sortWithinPartitions("asset", "time")
        .drop("time")
        .write.mode(mode)
        .partitionBy("asset")
        .csv(path, header=True)
    )
