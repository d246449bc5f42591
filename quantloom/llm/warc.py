"""WARC archives: writing, and reading with a verified chain of records.

Writing. Each page becomes one record. Pages with the same payload are told apart by SHA-256 and length: that with
the smallest page_id is a `response`, the others are `revisit` records that name it. Equal payloads are combined by
(digest, salt) first and across salts after, so a payload that a third of all pages share is no hot key. Records are
written by Spark's own text writer (the last byte of a record is the writer's line end), so a lost task is written
again and files appear on commit only, in whatever store the path names.

Reading. Archives are cut at the record magic by Spark's text reader, which splits large files. What follows a magic
is only a candidate: payloads may contain the magic too. Each task reads a candidate's header and emits its offset
and the offset where its successor must begin. Candidates whose successor is just the next candidate form a run;
pointer jumping over the runs, from the start of the file and doubling the reach in each round, keeps the records
that can be reached. Candidates inside payloads are never reached. Payloads that hold a magic are put together from
their pieces; all others are digested where they were read.

Defined cases: NULL html is an empty payload; a NULL page_id is written as such and never wins against an id; rows
that repeat the smallest page_id are all responses; line ends in an url are removed; empty tables give empty
archives and no rows; a record cut off at the end of a file is dropped, as is anything that no chain reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.storage import discard, materialise

#: Fixed by the WARC format.
MAGIC = "WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SALTS = 64
PAGE_URN = "urn:page:"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1; 40 bits at a time, since base 32 digits of `conv` are 0-9A-V."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame, date: str, smallest_revisit: int) -> DataFrame:
    """One `value` per page: the record without its last byte."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("long").alias("size"),
        F.sha2("payload", 256).alias("digest"),
        F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    salted = keyed.groupBy("digest", "size", "salt").agg(F.min("page_id").alias("least"))
    winners = salted.select(
        "digest", "size", "salt", F.min("least").over(Window.partitionBy("digest", "size")).alias("first_page")
    )
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("size") >= smallest_revisit)
    urn = lambda page: F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        F.when(
            F.col("revisit"),
            F.concat(line("WARC-Refers-To", urn(F.col("first_page"))), line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        ).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
    )
    return (
        keyed.join(winners, ["digest", "size", "salt"])
        .select("page_id", "url", "payload", "size", "first_page", revisit.alias("revisit"))
        .select(
            head.alias("head"),
            F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))).alias("block"),
        )
        .select(
            F.concat(
                "head", line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), "block", F.lit("\r\n\r")
            ).alias("value")
        )
    )


def write_archives(
    pages: DataFrame,
    path: str,
    date: str = "2020-01-01T00:00:00Z",
    compression: str = "gzip",
    records_per_file: int = 50_000,
    smallest_revisit: int = 0,
) -> None:
    """Write pages (page_id, url, html) as WARC files under `path`; compression `none` leaves them splittable."""
    _records(pages, date, smallest_revisit).write.option("lineSep", "\n").option("compression", compression).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, with its place: file, split, order inside the split."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").cast("binary").alias("piece"),
        )
    )


def _header(name: str) -> Column:
    value = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(value != "", value)


def _parsed(pieces: DataFrame, *also: str) -> DataFrame:
    """Header fields and the block as far as it lies in the piece."""
    head = F.substring_index(F.decode("piece", "iso-8859-1"), "\r\n\r\n", 1)
    found = pieces.withColumn("head", head).withColumn("size", F.octet_length("piece").cast("long"))
    fields = found.select(
        *also,
        "file",
        "split",
        "at",
        "size",
        "piece",
        F.length("head").cast("long").alias("head_size"),
        _header("Content-Length").try_cast("long").alias("block_size"),
        F.lower(_header("WARC-Type")).alias("record_type"),
        _header("WARC-Record-ID").alias("record_id"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("written_digest"),
        _header("WARC-Refers-To").alias("refers_to"),
    )
    valid = F.col("block_size").isNotNull() & (F.col("size") >= F.col("head_size") + 4)
    return fields.withColumn("length", F.when(valid, F.col("head_size") + 4 + F.col("block_size") + 4))


def _payload(block: Column) -> Column:
    """What follows the HTTP header of a block."""
    end = F.instr(F.decode(block, "iso-8859-1"), "\r\n\r\n")
    return F.when(end > 0, F.substring(block, end + 4, F.octet_length(block))).otherwise(block)


def _described(fields: DataFrame) -> DataFrame:
    """payload_bytes and payload_digest from `block`; a revisit has them in its headers."""
    http_length = F.regexp_extract(F.decode("block", "iso-8859-1"), r"(?i)(?:^|\n)Content-Length:[ \t]*(\d{1,18})", 1)
    revisit = F.col("record_type") == "revisit"
    return (
        fields.withColumn("payload", F.coalesce(_payload(F.col("block")), F.lit("").cast("binary")))
        .withColumn("http_length", http_length.try_cast("long"))
        .withColumn(
            "payload_bytes", F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload").cast("long"))
        )
        .withColumn("payload_digest", F.when(revisit, F.col("written_digest")).otherwise(base32_sha1(F.col("payload"))))
        .drop("payload", "http_length")
    )


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, start, next) that a chain from the first candidate of their file reaches."""
    in_file = Window.partitionBy("file").orderBy("start")
    # A run ends where the successor isn't the next candidate; `tail` names the run by its last candidate.
    marked = candidates.withColumn("after", F.lead("start").over(in_file)).withColumn(
        "ends", F.coalesce(F.col("next") != F.col("after"), F.lit(True))
    )
    later = in_file.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    runs = materialise(
        marked.withColumn("tail", F.min(F.when(F.col("ends"), F.col("start"))).over(later)), "warc-runs"
    )
    tails = runs.where("ends").select("file", "tail", "next")
    entries = runs.select("file", F.col("start").alias("next"), F.col("tail").alias("to_tail"))
    jumps = tails.join(entries, ["file", "next"]).select("file", "tail", F.col("to_tail").alias("to"), F.col("next").alias("entry"))
    hops = jumps = materialise(jumps, "warc-jumps")
    reach = runs.groupBy("file").agg(F.min("start").alias("first"), F.min_by("tail", "start").alias("tail")).select("file", "tail")
    reach = materialise(reach, "warc-reach")
    count = reach.count()
    while True:
        ahead = reach.join(jumps, ["file", "tail"]).select("file", F.col("to").alias("tail"))
        wider = materialise(reach.union(ahead).distinct(), "warc-reach")
        discard(reach)
        reach, before = wider, count
        count = reach.count()
        if count == before:
            break
        further = jumps.alias("a").join(jumps.alias("b"), F.expr("a.file = b.file AND a.to = b.tail"))
        doubled = materialise(further.select("a.file", "a.tail", "b.to"), "warc-jumps")
        if jumps is not hops:
            discard(jumps)
        jumps = doubled
    # A run is entered at its first candidate in the file's first run, else where the run before points to.
    entered = hops.join(reach, ["file", "tail"], "left_semi").groupBy("file", F.col("to").alias("tail")).agg(F.min("entry").alias("entry"))
    starts = runs.groupBy("file").agg(F.min_by("tail", "start").alias("tail"), F.min("start").alias("entry"))
    return (
        runs.join(entered.unionByName(starts.select("file", "tail", "entry")), ["file", "tail"])
        .where("start >= entry")
        .select("file", "start", "next")
    )


def _block() -> Column:
    return F.expr("substring(piece, int(head_size + 5), int(block_size))")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, start, record_type, record_id, refers_to, payload_bytes, payload_digest."""
    parsed = _parsed(_pieces(spark, path)).withColumn("whole", F.coalesce(F.col("size") >= F.col("length"), F.lit(False)))
    read = _described(parsed.withColumn("block", F.when(F.col("whole"), _block())))
    narrow = materialise(read.drop("piece", "block", "written_digest"), "warc-pieces")
    # Offsets: the pieces of a split are summed up in the split, the splits in their file.
    width = len(MAGIC)
    splits = narrow.groupBy("file", "split").agg(F.sum(F.col("size") + width).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(
        narrow.withColumn("offset", F.coalesce(F.sum(F.col("size") + width).over(inside), F.lit(0)))
        .join(splits, ["file", "split"])
        .withColumn("start", F.col("base") + F.col("offset"))
        .drop("base", "offset"),
        "warc-places",
    )
    discard(narrow)
    # The first piece of a file stands before any magic.
    candidates = placed.where("length IS NOT NULL AND start > 0").select(
        "file", "start", (F.col("start") + F.col("length") + width).alias("next")
    )
    ends = placed.groupBy("file").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    records = placed.join(reachable(candidates), ["file", "start"]).join(ends, "file")
    records = records.where(F.col("next") - width <= F.col("end"))
    columns = ["file", "start", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest"]
    # Payloads with a magic inside: a piece belongs to the last record that starts at or before it.
    broken = materialise(records.where("NOT whole").select("file", "start", "next"), "warc-broken")
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = (
        placed.select("file", "split", "at", "start")
        .join(broken.withColumn("owner", F.col("start")), ["file", "start"], "left")
        .withColumn("until", F.last("next", True).over(so_far))
        .withColumn("owner", F.last("owner", True).over(so_far))
        .where("start < until")
        .select("file", "split", "at", "start", "owner")
    )
    magic = "".join(f"{b:02X}" for b in MAGIC.encode())
    gathered = (
        _pieces(spark, path)
        .join(owned, ["file", "split", "at"])
        .groupBy("file", F.col("owner").alias("start"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
        .select("file", "start", F.unhex(F.array_join(F.transform("pieces", lambda x: F.hex(x["piece"])), magic)).alias("piece"))
        .withColumns({"split": F.lit(0), "at": F.lit(0)})
    )
    mended = _described(_parsed(gathered, "start").withColumn("block", _block()))
    return records.where("whole").select(*columns).unionByName(mended.select(*columns))


def page_of(record_id: Column) -> Column:
    """The page_id in a record id of `write_archives`."""
    return F.regexp_extract(record_id, rf"{PAGE_URN}(-?\d+)", 1).try_cast("long")
