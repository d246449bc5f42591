"""Listing, bars, code map, statements and headlines derived from the star-schema tables.

One instrument is one supplier. Prices are ratios of whole numbers, so every engine gets the same
double. All views are lazy; date ranges are applied to the stored timestamp before the aggregation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.storage import materialise

# The derived names end in the supplier key; this takes a few of them out of the universe.
EXCLUDED_NAMES = "07$|13$"


_SCHEMAS = {
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ticker(key: Column) -> Column:
    return F.lpad(key.cast("string"), 10, "0")


def _cents(amount: str) -> Column:
    return F.rint(F.col(amount) * 100).cast("long")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(
        _ticker(F.col("s_suppkey")).alias("ticker"),
        F.col("s_name").alias("name"),
        (F.col("s_nationkey").cast("long") * 1_000_000).alias("shares"),
    )


def bars(
    spark: SparkSession, sf_dir: str, start: dt.date | None = None, end: dt.date | None = None, line: str | None = None
) -> DataFrame:
    """One bar per instrument and day. `line` keeps the line items of one line status."""
    items = _table(spark, sf_dir, "lineitem")
    if line is not None:
        items = items.where(F.col("l_linestatus") == line)
    if start is not None:
        items = items.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        items = items.where(F.col("l_shipdate") < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz"))
    return (
        items.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.sum(_cents("l_extendedprice")).alias("price"),
            F.sum(_cents("l_quantity")).alias("quantity"),
            F.sum(F.col("l_quantity").cast("long")).alias("volume"),
        )
        .select(
            _ticker(F.col("l_suppkey")).alias("ticker"),
            "date",
            (F.col("price").cast("double") / F.col("quantity").cast("double")).alias("close"),
            "volume",
        )
    )


def last_day(spark: SparkSession, sf_dir: str) -> dt.date:
    """The latest bar date, read from one column (no bars are built for it)."""
    newest = _table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("t")).first()["t"]
    return newest.date()


def span_days(spark: SparkSession, sf_dir: str) -> int:
    """Calendar days from the first to the last bar, both counted."""
    ship = F.col("l_shipdate").cast("date")
    row = _table(spark, sf_dir, "lineitem").agg(F.min(ship).alias("first"), F.max(ship).alias("last")).first()
    return (row["last"] - row["first"]).days + 1


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies; every tenth has no ticker."""
    key = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        F.lpad((key + 100000).cast("string"), 12, "0").alias("corp_code"),
        F.when(key % 10 != 9, _ticker(key)).alias("stock_code"),
    )


def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.sources.readers import build_code_map

    return build_code_map(companies(spark, sf_dir))


def code_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code map as CSV lines."""
    return code_map(spark, sf_dir).select(F.to_csv(F.struct("corp_code", "ticker")).alias("line"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, body): the statements of a ticker and year as one JSON document; tickers ending in 7 have no data status."""
    item = F.struct(
        F.col("ticker").alias("stock_code"), F.col("account").alias("account_nm"), F.col("amount_raw").alias("thstrm_amount")
    )
    status = F.when(F.col("ticker").endswith("7"), "013").otherwise("000")
    body = F.to_json(F.struct(status.alias("status"), "list"))
    grouped = statements(spark, sf_dir).groupBy("ticker", "year").agg(F.collect_list(item).alias("list"))
    return grouped.select("year", body.alias("body"))


def statements(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """(ticker, year, account, amount_raw) with gaps, duplicates, a bad amount and an unused account.

    `years` (first and last) becomes a range of shipping dates, which reaches the scan.
    """
    items = _table(spark, sf_dir, "lineitem")
    if years is not None:
        first, after = (F.lit(dt.date(y, 1, 1)).cast("timestamp_ntz") for y in (years[0], years[1] + 1))
        items = items.where((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < after))
    signed = F.when(F.col("l_returnflag") == "R", -2).otherwise(1) * _cents("l_extendedprice")
    yearly = (
        items.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("year"))
        .agg(F.sum(signed).alias("signed"))
        .join(_table(spark, sf_dir, "supplier"), F.col("k") == F.col("s_suppkey"))
    )
    filed = (F.col("k") + F.col("year")) % 7 != 0
    thousands = F.round(F.col("signed").cast("double") / 100000.0).cast("long").cast("string")
    equity = F.floor("s_acctbal")

    def row(account: str, amount: Column, when: Column | None = None) -> Column:
        entry = F.struct(F.lit(account).alias("account"), amount.alias("amount_raw"))
        return entry if when is None else F.when(when, entry)

    rows = F.array(
        row(
            "net_income",
            F.when(F.col("k") % 23 == 1, F.lit("-")).otherwise(F.concat(thousands, F.lit(",000"))),
            filed,
        ),
        row("total_equity", F.concat(equity.cast("string"), F.lit(",000")), filed),
        row("total_equity", F.concat((equity + 500).cast("string"), F.lit(",000")), filed & (F.col("k") % 5 == 0)),
        row("revenue", F.lit("1,000")),
    )
    return (
        yearly.select(_ticker(F.col("k")).alias("ticker"), "year", F.explode(rows).alias("item"))
        .where(F.col("item").isNotNull())
        .select("ticker", "year", "item.account", "item.amount_raw")
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one headline of one instrument, with a label and a score."""
    suppliers = _table(spark, sf_dir, "supplier").agg(F.count("*").alias("suppliers"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    return (
        docs.join(labels, "doc_id", "left")
        .crossJoin(F.broadcast(suppliers))
        .select(
            _ticker(F.col("doc_id") % F.col("suppliers")).alias("ticker"),
            F.col("doc_id").alias("seq"),
            (F.col("doc_id") % 11).alias("age_days"),
            F.col("text").alias("title"),
            F.when(F.col("toxic") == 1, "negative")
            .when(F.col("quality") == 1, "positive")
            .otherwise("neutral")
            .alias("label"),
            (F.lit(0.5) + (F.col("doc_id") % 50) / F.lit(100.0)).alias("score"),
        )
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close): line items as trades of their supplier's region; items of one moment are one trade."""
    items = _table(spark, sf_dir, "lineitem")
    suppliers = _table(spark, sf_dir, "supplier")
    nations = spark.read.schema("n_nationkey int, n_regionkey int").parquet(f"{sf_dir}/nation.parquet")
    market = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    # Stored, so that the optimizer's size check sees how small it is: trades then stay where they are for the join.
    market = materialise(market, "markets")
    moment = F.unix_date(F.col("l_shipdate").cast("date")) * 86_400_000_000 + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    trades = (
        items.join(market, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("n_regionkey", moment.alias("moment"))
        .agg(F.sum(_cents("l_extendedprice")).alias("price"), F.sum(_cents("l_quantity")).alias("quantity"))
    )
    return trades.select(
        F.lpad(F.col("n_regionkey").cast("string"), 10, "0").alias("ticker"),
        F.timestamp_micros("moment").alias("date"),
        (F.col("price").cast("double") / F.col("quantity").cast("double")).alias("close"),
    )


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, year, published): statements of a year come out in the spring behind it, on a day of the ticker's own."""
    filed = statements(spark, sf_dir).select("ticker", "year").distinct()
    late = F.col("ticker").cast("long") % 90
    return filed.withColumn("published", F.date_add(F.make_date(F.col("year") + 1, F.lit(3), F.lit(1)), late.cast("int")))


def broken_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, body): `documents`, of which those of tickers ending in 3 are cut in the middle."""
    docs = documents(spark, sf_dir)
    ticker = F.get_json_object("body", "$.list[0].stock_code")
    cut = F.substring("body", F.lit(1), (F.length("body") / 2).cast("int"))
    return docs.select("year", F.when(ticker.endswith("3"), cut).otherwise(F.col("body")).alias("body"))


def quoted_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code map, with a comma in each third code and quotes in each fifth."""
    key = F.col("ticker").cast("long")
    code = F.when(key % 3 == 0, F.concat("corp_code", F.lit(",A"))).when(key % 5 == 0, F.concat(F.lit('"'), "corp_code", F.lit('"')))
    return code_map(spark, sf_dir).select(F.coalesce(code, "corp_code").alias("corp_code"), "ticker")


def labelled_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, title, label) of the documents that `labels` covers."""
    labels = _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "seq").select("seq")
    return headlines(spark, sf_dir).select("seq", "title", "label").join(labels, "seq", "left_semi")
