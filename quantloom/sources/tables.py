"""Day-partitioned tables, metadata lookups, CSV scores, JDBC and Redis-like sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_range(spark: SparkSession, root: str, table: str, start: str | None = None, end: str | None = None, date_col: str = "trade_date") -> DataFrame:
    """Rows of a partitioned table between two days; the bounds prune partitions."""
    df = spark.read.parquet(f"{root}/{table}")
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date_col) <= F.lit(end).cast("date"))
    return df


def read_all(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


def write_by_date(df: DataFrame, root: str, table: str, date_col: str = "trade_date", overwrite: bool = False) -> None:
    """One partition by day, in as many files as a day needs. Without overwrite, days that are there already stay.

    Rows are brought together by day; adaptive execution splits a day that is too large for one task and joins small ones.
    """
    path = f"{root}/{table}"
    spark = df.sparkSession
    if not overwrite:
        try:
            have = spark.read.parquet(path).select(date_col).distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            df = df.join(have, date_col, "left_anti")
    df.hint("rebalance", F.col(date_col)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def upsert_by_date(df: DataFrame, root: str, table: str, keys: Iterable[str], date_col: str = "trade_date") -> None:
    """Replaces rows of equal keys and keeps the others, in the days that df has. The old rows are read before the days are rewritten.

    Of new rows of one key that with the greatest values, column by column, stays.
    """
    from quantloom.operators.frames import dedup_last

    path = f"{root}/{table}"
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        write_by_date(dedup_last(df, [*keys, date_col], F.struct(*df.columns)), root, table, date_col, True)
        return
    touched = old.join(df.select(date_col).distinct(), date_col, "left_semi")
    both = touched.withColumn("_source", F.lit(0)).unionByName(df.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    staged = f"{root}/_staged_{table}_{uuid.uuid4().hex}"
    order = F.struct("_source", *[c for c in both.columns if c != "_source"])
    dedup_last(both, [*keys, date_col], order).drop("_source").write.parquet(staged)
    write_by_date(spark.read.schema(both.drop("_source").schema).parquet(staged), root, table, date_col, True)
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def latest_date(df: DataFrame, date_col: str = "trade_date"):
    """The greatest day, from partition values and statistics where the source has them."""
    return df.agg(F.max(date_col)).first()[0]


def has_data(df: DataFrame) -> bool:
    return not df.isEmpty()


def list_dates(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    return df.select(date_col).distinct().orderBy(date_col)


def lookback(df: DataFrame, day: str, days: int, date_col: str = "trade_date") -> DataFrame:
    """Rows of the last days trading days on or before a day: the days are found first, and prune the scan."""
    before = df.where(F.col(date_col) <= F.lit(day).cast("date"))
    wanted = before.select(date_col).distinct().orderBy(F.desc(date_col)).limit(int(days))
    return before.join(wanted, date_col, "left_semi")


def latest_on_or_before(df: DataFrame, day: str, date_col: str = "trade_date") -> DataFrame:
    """Rows of the newest day on or before a day."""
    return lookback(df, day, 1, date_col)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score CSV files (trade_date, code, score): the last row of a key stays, rows without a score go."""
    from quantloom.operators.frames import dedup_last

    raw = spark.read.option("header", True).schema("trade_date date, code string, score double").csv(path)
    # Place of a row: file, block of it, and the order within the block, which one task reads.
    numbered = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.struct("_file", F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return dedup_last(numbered.where("score is not null"), ["trade_date", "code"], "_at").drop("_at", "_file")


def write_scores(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One folder of CSV files by day."""
    out = df.select("trade_date", "code", "score").withColumn("day", F.date_format("trade_date", "yyyyMMdd"))
    out.hint("rebalance", F.col("day")).write.mode("overwrite" if overwrite else "append").option("header", True).partitionBy("day").csv(path)


def read_sql(spark: SparkSession, url: str, table: str, start: str | None = None, end: str | None = None, date_col: str | None = None, **options: str) -> DataFrame:
    """A JDBC table; date bounds are pushed to the server where a date column is named."""
    df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    return df.where(F.col(date_col).between(start, end)) if date_col and start and end else df


def replace_date(df: DataFrame, connect: Callable[[], object], table: str, day: str, date_col: str = "trade_date", mark: str = "?") -> None:
    """Replaces the rows of a day in a database table, in one transaction on the driver: a day's trades are a few rows.

    connect returns a DB-API connection. The code is split into instrument and exchange.
    """
    rows = df.withColumn("instrument_code", F.split_part("code", F.lit("."), F.lit(1))).withColumn("exchange_code", F.split_part("code", F.lit("."), F.lit(2))).drop("code")
    names = rows.columns
    con = connect()
    try:
        cur = con.cursor()
        cur.execute(f"DELETE FROM {table} WHERE {date_col} = {mark}", (day,))
        cur.executemany(f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))})", [tuple(str(v) if hasattr(v, "isoformat") else v for v in r) for r in rows.toLocalIterator()])
        con.commit()
    finally:
        con.close()


def latest_per_symbol(snapshots: DataFrame, limit: int, symbol: str = "code", score: str = "ts") -> DataFrame:
    """The newest snapshots of each symbol, as a sorted-set read gives them."""
    w = Window.partitionBy(symbol).orderBy(F.desc(score))
    return snapshots.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def score_range(snapshots: DataFrame, low, high, score: str = "ts") -> DataFrame:
    return snapshots.where(F.col(score).between(low, high))


def cached_or_direct(spark: SparkSession, mode: str, cached: str, direct: Callable[[], DataFrame]) -> DataFrame:
    """A stored panel, or one built on the spot."""
    if mode == "cached_panel":
        return spark.read.parquet(cached)
    if mode == "clean_direct":
        return direct()
    raise ValueError(f"unknown panel source: {mode}")
