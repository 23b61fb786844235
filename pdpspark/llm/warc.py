"""WARC archives: written with revisit records for equal payloads, read back by verified chains of record boundaries.

A record is header, blank line, payload, blank line. Spark's text sink and source part rows by the four bytes of a blank line, so
archives go through the session's file systems and large ones are split; what stands between two blank lines is called a piece here.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdpspark.llm.common import scratch, written

BLANK = "\r\n\r\n"
MAGIC = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_PAYLOAD = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"  # base32 of SHA-1 of nothing


def base32(hex_digest) -> object:
    """Base32 of a SHA-1 in hex: five bytes are eight digits."""
    digits = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# -- writing ---------------------------------------------------------------------------------------------------------------------

def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """A record per row of pages (page_id, url, html): one archive for each input partition, under path.

    The payload is html in UTF-8, a null html is empty. Of records with equal payloads of least_bytes or more that of the largest page_id
    is a response; the others are revisits of it without a payload. Rows that repeat the largest id are all responses, a null id is a
    revisit where another row of that payload has an id. Control characters and blanks in url are percent-encoded, null is empty.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("sha", "holder")
    joined = rows.join(written(shared, "shared-payloads"), "sha", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    uri = F.coalesce("url", F.lit(""))
    escaped = F.transform(F.split(uri, ""), lambda c: F.when((F.ascii(c) <= 32) | (F.ascii(c) == 127), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    uri = F.when(uri.rlike("[\\x00-\\x20\\x7F]"), F.array_join(escaped, "")).otherwise(uri)
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("holder"))).otherwise("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.octet_length("html"))),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(BLANK), F.when(revisit, "").otherwise(F.col("html")))
    joined.select(record.alias("value")).write.option("lineSep", BLANK).text(path)


# -- reading ---------------------------------------------------------------------------------------------------------------------

def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", BLANK).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _fields(head: bytes) -> tuple | None:
    """type, page, refers, digest and payload length of a header; None if it isn't one."""
    own = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        own[key.strip().lower()] = value.strip().decode("utf-8", "replace")
    size, page = own.get(b"content-length", ""), own.get(b"warc-record-id", "")
    if not (size.isascii() and size.isdigit()) or b"warc-type" not in own:
        return None
    return own[b"warc-type"], page, own.get(b"warc-refers-to"), own.get(b"warc-payload-digest", ""), int(size)


class _Block:
    """The candidate records of a block, in order: every magic, with its successor's place."""

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block, self.size, self.rows, self.open = file, block, 0, [], []

    def add(self, piece: bytes) -> None:
        for one in self.open:  # payloads that go on
            part = (piece + BLANK.encode())[: one["left"]]
            one["sha"].update(part)
            one["left"] -= len(part)
        self.open = [x for x in self.open if x["left"]]
        at = piece.find(MAGIC)
        while at >= 0:
            end = piece.find(MAGIC, at + 1)
            fields = _fields(piece[at:])
            if fields:
                body = self.size + len(piece) + 4
                row = {"start": self.size + at, "body": body, "next": body + fields[4] + 4, "fields": fields, "sha": hashlib.sha1(), "left": fields[4]}
                self.rows.append(row)
                if row["left"]:
                    self.open.append(row)
            at = end
        self.size += len(piece) + 4

    def frame(self) -> pd.DataFrame:
        """exit: the first successor outside the block; low and high: the candidate's chain, so that of a chain entered at e all
        candidates with low <= e.low < high are met."""
        n, place = len(self.rows), {r["start"]: i for i, r in enumerate(self.rows)}
        after = [place.get(r["next"], -1) for r in self.rows]
        sizes, exits, low, free = [1] * n, [None] * n, [0] * n, 0
        for i in range(n):  # successors come later
            if after[i] >= 0:
                sizes[after[i]] += sizes[i]
        room = [0] * n
        for i in reversed(range(n)):
            j = after[i]
            if j >= 0:
                exits[i], low[i] = exits[j], room[j]
                room[j] += sizes[i]
            else:
                exits[i] = self.rows[i]["next"] if self.rows[i]["next"] >= self.size else None
                low[i], free = free, free + sizes[i]
            room[i] = low[i] + 1
        rows = [
            (self.file, self.block, r["start"], r["body"], exits[i], low[i], low[i] + sizes[i], *r["fields"], None if r["left"] else base64.b32encode(r["sha"].digest()).decode())
            for i, r in enumerate(self.rows)
        ]
        rows.append((self.file, self.block, None, self.size, None, None, None, None, None, None, None, None, None))  # the block's own length
        return pd.DataFrame(rows, columns=CANDIDATE).astype({c: "Int64" for c in ("start", "body", "exit", "low", "high", "size")})


CANDIDATE = ["file", "block", "start", "body", "exit", "low", "high", "kind", "page", "refers", "digest", "size", "found"]
CANDIDATE_TYPES = "file string, block long, start long, body long, exit long, low long, high long, kind string, page string, refers string, digest string, size long, found string"


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now = None
    for pdf in batches:
        for file, block, piece in zip(pdf["file"], pdf["block"], pdf["value"], strict=True):
            if now is None or (now.file, now.block) != (file, block):
                if now:
                    yield now.frame()
                now = _Block(file, block)
            now.add(bytes(piece))
    if now:
        yield now.frame()


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces with their places in the block."""
    now, size = None, 0
    for pdf in batches:
        starts = []
        for file, block, piece in zip(pdf["file"], pdf["block"], pdf["value"], strict=True):
            if now != (file, block):
                now, size = (file, block), 0
            starts.append(size)
            size += len(piece) + 4
        yield pdf.assign(start=starts)


def _reached(candidates: DataFrame) -> DataFrame:
    """file, at: the places where a chain from the file's start enters a block, found by pointer jumping over the blocks' exits."""
    jumps = written(candidates.select("file", F.col("start").alias("at"), F.col("exit").alias("to")).where("to is not null"), "jumps")
    reached, before = written(candidates.select("file").distinct().withColumn("at", F.lit(0).cast("long")), "reached"), 0
    while (now := reached.count()) > before:
        before = now
        far = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = written(reached.unionByName(far).distinct(), "reached")
        onward = jumps.select("file", F.col("at").alias("from"), F.col("to").alias("at")).join(jumps, ["file", "at"]).select("file", F.col("from").alias("at"), "to")
        jumps = written(onward, "jumps")
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """kind, page (record id), refers, digest (as written), size, found (bare base32 SHA-1 of the payload as read): one row per record.

    Each task reads its block of an archive and emits all candidates: each magic, also within payloads, with the place of its successor,
    followed to the first place outside the block. Pointer jumping from the start of each file over these exits finds where true chains
    enter each block, in as many rounds as the logarithm of the blocks of a file; a candidate is a record only if it lies on the chain
    that enters its block. Payloads that run into another block are joined from their pieces in a second reading. Behind a place where
    no record begins, a broken archive gives no records. An empty file has none.
    """
    found = written(_pieces(spark, path).mapInPandas(_candidates, CANDIDATE_TYPES), "candidates")
    blocks = found.where("start is null").select("file", "block", F.col("body").alias("length"))
    earlier = blocks.select("file", F.col("block").alias("b"), F.col("length").alias("l"))
    base = blocks.join(earlier, "file").groupBy("file", "block").agg(F.coalesce(F.sum(F.when(F.col("b") < F.col("block"), F.col("l"))), F.lit(0)).alias("base"))  # blocks of one file
    base = written(base, "bases")
    placed = found.where("start is not null").join(base, ["file", "block"]).withColumns({c: F.col(c) + F.col("base") for c in ("start", "body", "exit")})
    placed = written(placed, "placed")
    entries = placed.join(_reached(placed).withColumnRenamed("at", "start"), ["file", "start"]).select("file", "block", F.col("low").alias("entry"))
    records = placed.join(entries, ["file", "block"]).where("low <= entry and entry < high").drop("entry")

    # payloads over the end of a block
    torn = written(records.where("found is null").select("file", "start", "body", "size"), "torn")
    pieces = _pieces(spark, path).mapInPandas(_places, "file string, block long, value binary, start long").join(base, ["file", "block"]).select("file", (F.col("start") + F.col("base")).alias("at"), "value")
    parts = pieces.join(torn, "file").where((F.col("at") >= F.col("body")) & (F.col("at") < F.col("body") + F.col("size"))).select("file", "start", "size", "at", "value")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        payload = BLANK.encode().join(bytes(v) for v in pdf.sort_values("at")["value"]) + BLANK.encode()
        digest = base64.b32encode(hashlib.sha1(payload[: pdf["size"].iloc[0]]).digest()).decode()
        return pd.DataFrame({"file": [key[0]], "start": [key[1]], "joined": [digest]})

    joined = parts.groupBy("file", "start").applyInPandas(whole, "file string, start long, joined string")
    return records.join(joined, ["file", "start"], "left").select("kind", "page", "refers", "digest", "size", F.coalesce("found", "joined").alias("found"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified: pages written as archives in the shared folder and read back.

    A revisit has the size and digest of the response it names, as read; verified tells whether digests as read and as written agree.
    """
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes)
    records = written(read_warc(pages.sparkSession, path), "records")
    held = records.where("kind = 'response'").select(F.col("page").alias("refers"), F.concat(F.lit("sha1:"), "found").alias("digest"), F.col("size").alias("held_size"), F.col("found").alias("held")).distinct()
    both = records.join(held, ["refers", "digest"], "left")
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(pages.schema["page_id"].dataType)
    revisit = F.col("kind") == "revisit"
    digest = F.when(revisit, F.col("held")).otherwise(F.col("found"))
    return both.select(
        number("page").alias("page_id"), F.when(revisit, F.col("held_size")).otherwise(F.col("size")).alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(revisit, number("refers")).alias("refers_to"), (F.col("digest") == F.concat(F.lit("sha1:"), digest)).alias("verified"),
    )
