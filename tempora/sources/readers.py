"""Scans of series files, timestamp parsing, de-duplication and
generated indexes.  Everything stays a distributed DataFrame; the only
actions are single-aggregate validations that raise early."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.expressions import freq_seconds, ts_plus_seconds

# Name fragments that mark a datetime column (first match wins).
DATETIME_NAME_HINTS = ("date", "time", "tarih")


def detect_datetime_column(columns: Sequence[str]) -> str | None:
    """First column whose lower-cased name contains a datetime hint."""
    for c in columns:
        lc = c.lower()
        if any(h in lc for h in DATETIME_NAME_HINTS):
            return c
    return None


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan with header; pass a schema in production (no inference pass)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (filters and projections push down)."""
    return spark.read.parquet(path)


_FEATHER_EXT = (".feather", ".ft")


def read_feather(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: many Feather (Arrow IPC) files → one DataFrame.

    Files are listed by the ``binaryFile`` source and decoded in parallel by
    ``mapInArrow``, one file per record; the caller supplies the schema.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = schema.fieldNames()

    def decode(batches):
        import io

        import pyarrow as pa
        import pyarrow.feather as feather
        for b in batches:
            for blob in b.column("content").to_pylist():
                t = feather.read_table(io.BytesIO(blob))
                t = t.select(names).cast(pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields]))
                yield from t.to_batches()

    return files.mapInArrow(decode, schema)


def _arrow_type(dt):
    import pyarrow as pa
    return {
        "double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "integer": pa.int32(),
        "string": pa.string(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"),
        "timestamp": pa.timestamp("us", tz="UTC"), "date": pa.date32(),
    }[dt.typeName()]


def parse_timestamps(df: DataFrame, col: str, fmt: str | None = None, out: str = "ts") -> DataFrame:
    """Parse to TIMESTAMP_NTZ; fail if any value is missing or unparsable."""
    src = F.col(col)
    if df.schema[col].dataType.typeName() == "string":
        parsed = (F.try_to_timestamp(src, F.lit(fmt)) if fmt else F.try_to_timestamp(src)).cast("timestamp_ntz")
    else:
        parsed = src.cast("timestamp_ntz")
    res = df.withColumn(out, parsed)
    bad = res.agg(F.count_if(F.col(out).isNull()).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} rows have unparsable timestamps in {col!r}; fix these first")
    if out != col:
        res = res.drop(col)
    return res


def dedupe_first(df: DataFrame, keys: Sequence[str], ts: str = "ts", order_col: str | None = None) -> DataFrame:
    """Keep the first row of each (keys, ts) in ingest order.

    ``order_col`` is an explicit ingest-order column; without it the order is
    the row's place in its file, which Spark has only for a direct file scan.
    The first row per key is a minimum, combined in every task before the
    shuffle.
    """
    keys = list(keys)
    if order_col is not None:
        order = F.struct(order_col)
    elif _has_row_index(df):
        order = F.struct("_metadata.file_path", "_metadata.row_index")
    else:
        raise ValueError("rows of this frame have no ingest order; pass order_col")
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(*[F.col(k) for k in keys], F.col(ts)).agg(F.min_by(row, order).alias("__row"))
    return first.select("__row.*")


def _has_row_index(df: DataFrame) -> bool:
    try:
        df.select("_metadata.row_index").schema
        return True
    except Exception:  # noqa: BLE001 - metadata column only exists on file scans
        return False


def generate_index(df: DataFrame, start: str, freq, out: str = "ts") -> DataFrame:
    """Stamps ``start + i·freq`` for files without a time column.

    ``i`` is the global row number in file order.  For Parquet it comes from
    ``_metadata.row_index`` plus the row counts of the preceding files (a
    per-file table, one row per file); other formats are written once with
    the row's partition and place in it, and partition counts give the rest.
    """
    from tempora.session import materialize
    step = freq_seconds(freq)
    start_ts = F.lit(start).cast("timestamp_ntz")
    if _has_row_index(df):
        base = df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__ri", F.col("_metadata.row_index"))
        per_file = base.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
        # files in ranges of their paths: a running sum inside each range, and
        # one number per range from the ranges before it
        ranges = materialize(per_file.repartitionByRange("__file").withColumn("__part", F.spark_partition_id()), "files")
        before = F.coalesce(F.sum("__n").over(Window.partitionBy("__part").orderBy("__file").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        offs = ranges.withColumn("__in", before).join(_part_offsets(ranges, "__n"), "__part").select(
            "__file", (F.col("__in") + F.col("__before")).alias("__off"))
        idx = base.join(offs, "__file").withColumn("__i", F.col("__off") + F.col("__ri"))
        return idx.withColumn(out, ts_plus_seconds(start_ts, F.col("__i") * step)) \
                  .drop("__file", "__ri", "__off", "__i")
    # the id holds the partition (upper 31 bits) and the row in it (lower 33)
    rows = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "rows") \
        .withColumn("__part", F.shiftright("__id", 33).cast("int"))
    idx = rows.join(_part_offsets(rows.withColumn("__n", F.lit(1)), "__n"), "__part").withColumn(
        "__i", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    return idx.select(*df.columns, ts_plus_seconds(start_ts, F.col("__i") * step).alias(out))


def _part_offsets(rows: DataFrame, n: str) -> DataFrame:
    """(__part, __before): rows in the partitions before each; one number per
    partition passes the driver."""
    sums = sorted((r["__part"], r["s"]) for r in rows.groupBy("__part").agg(F.sum(n).alias("s")).collect())
    out, total = [], 0
    for part, s in sums:
        out.append((part, total))
        total += s
    return rows.sparkSession.createDataFrame(out, "__part int, __before long")


def read_series(spark: SparkSession, path: str, datetime_col: str | None = None,
                start_date: str | None = None, freq=None, keys: Sequence[str] = (),
                drop_duplicates: bool = True, schema: T.StructType | None = None,
                ts: str = "ts") -> DataFrame:
    """Read a series file set and give it a clean ``ts`` column.

    Format by extension (Parquet, Feather, otherwise CSV).  Either a
    datetime column or start + freq is required (S7).
    """
    low = path.lower().rstrip("/")
    try:
        if low.endswith((".parquet", ".pq")) or low.endswith("/*.parquet"):
            df = read_parquet(spark, path)
        elif low.endswith(_FEATHER_EXT):
            if schema is None:
                raise ValueError("feather scans need an explicit schema")
            df = read_feather(spark, path, schema)
        else:
            df = read_csv(spark, path, schema)
    except ValueError:
        raise
    except Exception as e:  # noqa: BLE001 - wrap reader errors like the reference
        raise ValueError(f"error reading {path}: {e}") from e
    order = None
    if drop_duplicates and not _has_row_index(df):
        # ids ascend with files and rows as long as nothing has been shuffled
        order = "__ingest"
        df = df.withColumn(order, F.monotonically_increasing_id())
    if datetime_col == "auto":
        datetime_col = detect_datetime_column(df.columns)   # S8 fallback
        if datetime_col is None and not (start_date and freq):
            raise ValueError("no datetime-like column found; pass datetime_col or start_date + freq")
    if datetime_col:
        df = parse_timestamps(df, datetime_col, out=ts)
    elif start_date and freq:
        df = generate_index(df, start_date, freq, out=ts)
    else:
        raise ValueError("either datetime_col or both start_date and freq must be provided")
    if drop_duplicates:
        df = dedupe_first(df, list(keys), ts, order)
        df = df.drop(order) if order else df
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in num else F.col(c)
                       for c in df.columns])
