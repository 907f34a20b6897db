"""WARC archives: written as text, read back by boundary-chain verification.

Archives are plain WARC 1.1 files (no compression), so Spark's text reader can split them:
with the record magic as line separator each row is what follows one magic, and lengths add up
to offsets in the file. A magic may also stand inside a payload. So each row that parses as a
header only is a candidate: an offset with its successor, where its record says that it ends.
Records are the candidates on the chain from the file's start. The chain is followed within
cells of ``CELL`` bytes first, then from cell to cell by pointer jumping (a table of jumps is
joined with itself, doubling their length), whatever the size of a file. Payloads that held a
magic are put together again from their rows.

Broadcast: a bitmap of 4 MB. Memory: a record, and the offsets of a cell.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, sieve, sifted

VERSION = "1.1"
END = "\r\n\r\n"
#: Bytes of a file whose chain is followed in one task.
CELL = 4 << 20


def magic_line(version: str) -> str:
    """A record's first line; no header value can hold it, as values have no line ends."""
    return f"WARC/{version}\r\n"


def _clean(text: Column) -> Column:
    """No control characters: they would end a header line."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "%20")


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """(page, digest, first) for rows (page, digest, size) whose payload of at least ``least``
    bytes occurs more than once; ``first`` is the smallest page that has it."""
    big = rows.where(F.col("size") >= least)
    many = big.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return big.select("page", "digest").join(many, "digest").where("page is not null").distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> None:
    """Write one record per row of ``pages`` to a folder of WARC files.

    Of records with equal payloads (SHA-256) of at least ``least`` bytes the one with the
    smallest id is a response, others revisit it; smaller payloads are always responses. Rows
    that repeat the smallest id with that payload are all responses. Null payloads are empty;
    a null url leaves the header out; rows with a null id are responses without an id, and
    don't count among the equal ones. Only rows whose payload may repeat are shuffled.
    """
    work = Workspace(pages.sparkSession, "warc-write")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    again = work.stored(revisits(rows.where("page is not null").select("page", "digest", "size"), least), "revisits")
    met = sifted(rows, F.col("page"), sieve(again, "page"))
    known = met.where("__in").join(again, ["page", "digest"], "left").select("page", "url", "payload", "size", "digest", "first")
    all_rows = met.where("not __in").select("page", "url", "payload", "size", "digest", F.lit(None).cast("long").alias("first")).unionAll(known)
    revisit = F.coalesce(F.col("first") < F.col("page"), F.lit(False))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url")), F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(magic_line(VERSION) + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), F.coalesce(name(F.col("page")), F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">"))),
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\n"), uri,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    all_rows.select(record.alias("value")).write.option("lineSep", END).text(path)
    work.close()


def _scan(spark: SparkSession, path: str, magic: str) -> DataFrame:
    rows = spark.read.option("lineSep", magic).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _exits(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a cell leaves it (-1: nowhere)."""
    end, out = (int(key[1]) + 1) * CELL, {}
    nodes = nodes.sort_values("offset", ascending=False)
    for o, s in zip(nodes["offset"], nodes["next"]):
        out[o] = s if s >= end else out.get(s, s if s == nodes["size"].iloc[0] else -1)
    return nodes.assign(exit=[out[o] for o in nodes["offset"]])[["file", "offset", "exit"]]


def _follow(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a cell on the chain from its entry."""
    after = dict(zip(nodes["offset"], nodes["next"]))
    on = set()
    for at in nodes.loc[nodes["entry"], "offset"]:
        while at in after and at not in on:
            on.add(at)
            at = after[at]
    return nodes.loc[[o in on for o in nodes["offset"]], ["file", "offset"]]


def record_rows(spark: SparkSession, path: str, magic: str, work: Workspace) -> DataFrame:
    """Every row of the scan of ``path`` with its place: file, block, at, offset (of the magic
    before it; negative for what stands before the first), size (of the file), next (the
    successor that its header names), head (bytes of the header), body (Content-Length),
    record (whether it is on the chain from offset 0)."""
    text = F.col("value")
    head = F.substring_index(text, END, 1)
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", 1)
    parses = (F.instr(text, END) > 0) & (length != "")
    marks = _scan(spark, path, magic).select("file", "block", "at", F.octet_length(text).cast("long").alias("len"), F.when(parses, F.octet_length(head).cast("long")).alias("head"), F.when(parses, length.cast("long")).alias("body"))
    marks = work.stored(marks, "marks")
    first = len(magic)
    total = marks.groupBy("file", "block").agg(F.sum(F.col("len") + first).alias("bytes"))
    by_file = Window.partitionBy("file")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = total.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), (F.sum("bytes").over(by_file) - first).alias("size"))
    inner = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = marks.withColumn("ahead", F.coalesce(F.sum(F.col("len") + first).over(inner), F.lit(0))).join(splits, ["file", "block"])
    offset = F.col("base") + F.col("ahead") - first
    placed = placed.select("file", "block", "at", "len", offset.alias("offset"), "size", "head", "body", F.when(offset >= 0, offset + first + F.col("head") + 2 * len(END) + F.col("body")).alias("next"))
    placed = work.stored(placed, "placed")
    nodes = placed.where("next is not null and next <= size").select("file", "offset", "next", "size", F.floor(F.col("offset") / CELL).cast("long").alias("cell"))
    exits = work.stored(nodes.groupBy("file", "cell").applyInPandas(_exits, "file string, offset long, exit long"), "exits")
    # entries of cells: the file's start and where chains of other cells lead
    doors = exits.select("file", F.col("exit").alias("offset")).unionAll(exits.where("offset = 0").select("file", "offset")).distinct()
    jumps = work.stored(exits.join(doors, ["file", "offset"]), "jumps")
    reached = work.stored(jumps.where("offset = 0").select("file", "offset"), "reached")
    n = reached.count()
    while n:
        more = reached.join(jumps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        more = more.join(jumps.select("file", "offset"), ["file", "offset"], "left_semi")
        reached = work.stored(reached.unionAll(more).distinct(), "reached")
        m = reached.count()
        if m == n:
            break
        n = m
        further = jumps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        jumps = work.stored(jumps.join(further, ["file", "exit"], "left").select("file", "offset", F.coalesce("further", "exit").alias("exit")), "jumps")
    entered = nodes.join(reached.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    chain = entered.groupBy("file", "cell").applyInPandas(_follow, "file string, offset long").withColumn("record", F.lit(True))
    return work.stored(placed.join(chain, ["file", "offset"], "left").withColumn("record", F.coalesce("record", F.lit(False))), "rows")


def read_warc(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """The records of all files at ``path`` (a file, a folder or a pattern that Spark reads).

    Returns file, head (header lines after the first, as text), block (binary). Records of
    another ``version`` aren't read.
    A record is what the chain from its file's start reaches; a chain that breaks (bytes that
    aren't a record, a length that passes the file's end) ends there. Empty files: no rows.
    """
    work = Workspace(spark, "warc-read")
    magic = magic_line(version)
    rows = record_rows(spark, path, magic, work)
    # rows that aren't one whole record: parts of records whose payload holds a magic, or of none
    whole = F.col("record") & (F.col("next") == F.col("offset") + len(magic) + F.col("len"))
    odd = rows.where(~whole)
    split = odd.where("record").select("file", F.col("offset").alias("owner"), "next", F.explode(F.sequence(F.floor(F.col("offset") / CELL), F.floor((F.col("next") - 1) / CELL))).alias("cell"))
    owned = odd.select("file", "block", "at", "offset", F.floor(F.col("offset") / CELL).alias("cell")).join(split, ["file", "cell"]).where("offset >= owner and offset < next")
    owned = work.stored(owned.select("file", "block", "at", "offset", "owner"), "owned")
    place = F.xxhash64("file", "block", "at")
    odd_places = work.stored(odd.select("file", "block", "at").withColumn("key", place), "odd")
    scan = sifted(_scan(spark, path, magic).withColumn("key", place), F.col("key"), sieve(odd_places, "key"))
    may = scan.where("__in").drop("__in")
    plain = scan.where("not __in").select("file", "value", "key").unionAll(may.join(odd_places, ["file", "block", "at"], "left_anti").select("file", "value", "key"))
    parts = may.join(owned, ["file", "block", "at"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("p"))
    joined = parts.select("file", F.array_join(F.transform("p", lambda x: x["value"]), magic).alias("value"))
    head = F.substring_index("value", END, 1)
    text = plain.select("file", "value").unionAll(joined).withColumn("head", head)
    size = F.regexp_extract("head", r"(?i)(?:^|\r\n)content-length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", 1).cast("int")
    out = text.select("file", "head", F.col("value").cast("binary").alias("b"), (F.octet_length("head") + len(END) + 1).alias("from"), size.alias("n"))
    out = out.select("file", "head", F.expr("substring(b, from, n)").alias("block"))
    return out


def header(head: Column, name: str) -> Column:
    """Value of a header line, null if there is none."""
    value = F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def payloads(records: DataFrame) -> DataFrame:
    """Of records that :func:`write_warc` wrote: page, record_type, refers_to, payload
    (binary; null for revisits), payload_bytes and payload_digest (of the full payload)."""
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    body = F.expr("substring(block, octet_length(http) + 5, octet_length(block))")
    kind = header(F.col("head"), "warc-type")
    out = records.withColumn("http", http).select(
        F.expr("try_cast(regexp_extract(head, 'WARC-Record-ID: <urn:page:(-?[0-9]+)>', 1) as long)").alias("page"),
        kind.alias("record_type"),
        F.expr("try_cast(regexp_extract(head, 'WARC-Refers-To: <urn:page:(-?[0-9]+)>', 1) as long)").alias("refers_to"),
        F.when(kind == "response", body).alias("payload"),
        header(F.col("http"), "content-length").cast("long").alias("stated_bytes"),
        F.regexp_replace(header(F.col("head"), "warc-payload-digest"), "^sha256:", "").alias("stated_digest"),
    )
    return out.select("page", "record_type", "refers_to", "payload", F.coalesce(F.octet_length("payload").cast("long"), F.col("stated_bytes")).alias("payload_bytes"), F.coalesce(F.sha2("payload", 256), F.col("stated_digest")).alias("payload_digest"))
