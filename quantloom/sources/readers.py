"""Scans and sinks for the engine's input tables."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The helpers travel with the tasks, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING_SCHEMA = "Code string, Name string, Stocks long"
BARS_SCHEMA = "ticker string, date date, close double, volume long"
CODE_MAP_SCHEMA = "corp_code string, ticker string"
COMPANY_SCHEMA = "corp_code string, stock_code string"
STATEMENT_SCHEMA = (
    "status string, "
    "list array<struct<stock_code: string, account_nm: string, thstrm_amount: string>>"
)
HEADLINES_SCHEMA = "ticker string, date date, seq long, title string"

# Fixed value: names of shell companies and property trusts, left out of the universe.
EXCLUDED_NAMES = "스팩|리츠"
# Account labels in the statement files.
ACCOUNT_LABELS = {"net_income": "당기순이익", "total_equity": "자본총계"}
# Fixed value: the status of a statement document that holds data.
STATUS_OK = "000"

SERVE_DAYS = 400
TRAIN_DAYS = 3 * 365
NEWS_DAYS = 3


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Instrument list as (ticker, name, shares)."""
    reader = spark.read.schema(LISTING_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path).select(
        F.col("Code").alias("ticker"), F.col("Name").alias("name"), F.col("Stocks").alias("shares")
    )


def read_bars(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Daily bars of all instruments; the date range reaches the Parquet scan."""
    return in_range(spark.read.schema(BARS_SCHEMA).parquet(path), start, end)


def write_bars(bars: DataFrame, path: str) -> None:
    """Store bars by year, so that a date range prunes whole folders."""
    bars.withColumn("year", F.year("date")).repartition("year", F.pmod(F.hash("ticker"), F.lit(64))).write.partitionBy(
        "year"
    ).parquet(path)


def read_stored_bars(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """Bars written by `write_bars`: prunes year folders first, then row groups by date."""
    stored = spark.read.schema(BARS_SCHEMA + ", year int").parquet(path)
    return in_range(stored.where(F.col("year").between(start.year, end.year)), start, end).drop("year")


def read_statements(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, accounts: dict[str, str] | None = None
) -> DataFrame:
    """Landed statement documents as (ticker, year, account, amount_raw).

    `path` holds one folder per year (`year=2023/`). Documents whose status is not the data status
    hold no rows. Labels in `accounts` are renamed to ours; other accounts keep their label.
    """
    docs = spark.read.schema(STATEMENT_SCHEMA + ", year int").json(path)
    if years is not None:
        docs = docs.where(F.col("year").isin(list(years)))
    return documents_to_rows(docs, accounts)


def land_documents(documents: DataFrame, path: str) -> None:
    """Store documents (year, body) as they are, one on each line, in a folder for each year."""
    documents.select("year", "body").write.partitionBy("year").text(path)


def read_landed(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """(year, status, list, broken): landed documents; `broken` is the text of one that is no statement document.

    Only the folders of `years` are listed and read.
    """
    broken = "_broken string"
    docs = (
        spark.read.schema(f"{STATEMENT_SCHEMA}, {broken}, year int")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )
    if years is not None:
        docs = docs.where(F.col("year").isin(list(years)))
    return docs.select("year", "status", "list", F.col("_broken").alias("broken"))


def quarantined(docs: DataFrame) -> DataFrame:
    """(year, reason, broken) of the landed documents that give no rows: broken ones, and those without the data status."""
    reason = (
        F.when(F.col("broken").isNotNull(), "broken")
        .when(F.col("status").isNull(), "no status")
        .when(F.col("status") != STATUS_OK, F.concat(F.lit("status "), "status"))
        .when(F.col("list").isNull(), "no list")
    )
    return docs.select("year", reason.alias("reason"), "broken").where("reason IS NOT NULL")


def parse_documents(lines: DataFrame) -> DataFrame:
    """(year, body) with one JSON document in each body, as the columns of a statement document."""
    return lines.select("year", F.from_json("body", STATEMENT_SCHEMA).alias("doc")).select("year", "doc.*")


def documents_to_rows(docs: DataFrame, accounts: dict[str, str] | None = None) -> DataFrame:
    """(ticker, year, account, amount_raw) of the documents (year, status, list) that hold data."""
    ours = accounts if accounts is not None else ACCOUNT_LABELS
    account = F.col("item.account_nm")
    named: Column = account
    for name, label in ours.items():
        named = F.when(account == label, F.lit(name)).otherwise(named)
    return (
        docs.where(F.col("status") == STATUS_OK)
        .select("year", F.explode("list").alias("item"))
        .select(
            F.col("item.stock_code").alias("ticker"),
            "year",
            named.alias("account"),
            F.col("item.thstrm_amount").alias("amount_raw"),
        )
    )


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Filing code per ticker; both stay text, so leading zeros survive."""
    return spark.read.schema(CODE_MAP_SCHEMA).option("header", True).option("escape", '"').csv(path)


def parse_code_map(lines: DataFrame) -> DataFrame:
    """The same from single CSV lines (column `line`)."""
    return lines.select(F.from_csv("line", CODE_MAP_SCHEMA).alias("row")).select("row.*")


def build_code_map(companies: DataFrame) -> DataFrame:
    """Keep companies that have a ticker, as (corp_code, ticker)."""
    listed = F.col("stock_code").isNotNull() & (F.col("stock_code") != "")
    return companies.where(listed).select("corp_code", F.col("stock_code").alias("ticker"))


def write_code_map(code_map: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """CSV files with a header, values quoted where they need it; on demand with the mark that spreadsheets look for."""
    columns = ["corp_code", "ticker"]
    if not byte_order_mark:
        code_map.select(*columns).write.option("header", True).option("escape", '"').csv(path)
        return
    # The mark belongs to the header, so each file's lines are made here and its header put before them.
    line = F.to_csv(F.struct(*columns), {"escape": '"'}).alias("value")
    header = "\ufeff" + ",".join(columns)
    code_map.select(line).mapInPandas(partial(_headed, header), "value string").write.text(path)


def _headed(header: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"value": [header]})
    yield from batches


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADLINES_SCHEMA).parquet(path)


def tradable(listing: DataFrame, excluded: str = EXCLUDED_NAMES) -> DataFrame:
    """Drop excluded names and instruments without shares. A missing name is dropped too."""
    return listing.where(~F.col("name").rlike(excluded) & (F.col("shares") > 0))


def in_range(df: DataFrame, start: dt.date | None, end: dt.date | None, column: str = "date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def as_of_frame(bars: DataFrame) -> DataFrame:
    """The latest bar date as a one-row table."""
    return bars.agg(F.max("date").alias("as_of"))


def as_of_date(bars: DataFrame) -> dt.date:
    """The day the results are for: one value, so that later scans can push it down."""
    return as_of_frame(bars).first()["as_of"]


def days_before(day: dt.date, days: int) -> dt.date:
    return day - dt.timedelta(days=days)


def merged_providers(providers: Sequence[DataFrame], names: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """One bar per ticker and date from providers in order of precedence, with a record of who disagrees.

    (ticker, date, close, volume, provider, n_providers, missing, conflict): values come whole from the first provider that
    has a close there, `missing` names the providers without one, `conflict` says that two closes differ by more than
    `tolerance` of the chosen one. One pre-aggregated pass, no join; a provider that repeats a bar counts with its first
    close and volume in order.
    """
    columns = ["ticker", "date", "close", "volume"]
    tagged = [p.select(*columns).withColumn("_rank", F.lit(k)) for k, p in enumerate(providers)]
    value = F.struct("_rank", "close", "volume")
    merged = (
        union_sources(*tagged)
        .where(F.col("close").isNotNull())
        .groupBy("ticker", "date")
        .agg(
            F.min(value).alias("_first"),
            F.collect_set("_rank").alias("_ranks"),
            F.min("close").alias("_low"),
            F.max("close").alias("_high"),
        )
    )
    off = F.greatest(F.col("_high") - F.col("_first.close"), F.col("_first.close") - F.col("_low"))
    labels = F.array(*[F.lit(n) for n in names])
    absent = F.filter(labels, lambda _, k: ~F.array_contains("_ranks", k))
    return merged.select(
        "ticker",
        "date",
        "_first.close",
        "_first.volume",
        F.get(labels, F.col("_first._rank")).alias("provider"),
        F.size("_ranks").alias("n_providers"),
        F.array_join(absent, ",").alias("missing"),
        (off > F.lit(tolerance) * F.abs(F.col("_first.close"))).alias("conflict"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """Stack frames that arrive from several sources, matching columns by name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
