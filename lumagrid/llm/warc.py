"""WARC: records out of archive files, and resolution of not-modified revisits.

A revisit (a 304 without a body) is resolved by an as-of join on the canonical URL: the latest earlier full
response is taken if its validators agree (ETag by weak comparison; without ETags on both sides Last-Modified;
without either on both sides the payload digest). The resolved record has the response's body and its headers,
replaced by those of the revisit that a 304 may update.

The as-of join is a carried-forward maximum. A URL can hold a third of all rows, so it isn't one task's:
time is cut at quantiles into BUCKETS, the join is done within (url, bucket), and only each bucket's last
response is carried on to the later buckets of its URL. Of a response that very many revisits resolve to, several
copies are joined, each with a part of them.
"""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staging
from .joins import HOT_ROWS

BUCKETS = 256
#: Bytes that are unpacked at once, and bytes of payload that leave the reader together.
PIECE = 1 << 20
BATCH = 16 << 20
#: Headers that describe the body and are never taken from a 304.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
#: Query parameters that don't change the page.
IGNORED_PARAMETERS = "^(utm_[a-z]+|ref|sessionid|phpsessid|fbclid|gclid)(=|$)"

RECORD = "record_id string, warc_type string, url string, at timestamp, status int, headers map<string,string>, payload binary, digest string"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without a last slash, parameters sorted and
    without tracking ones, no scheme and no fragment. Text without a host is returned trimmed."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    pattern = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)(\\?.*)?$"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(whole, pattern, 1)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(whole, pattern, 2), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(whole, pattern, 3), "^\\?", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(IGNORED_PARAMETERS)))
    return F.when(whole.rlike(pattern), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))).otherwise(whole)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, buckets: int = BUCKETS, hot_from: int = 1000) -> DataFrame:
    """records: record_id, warc_type, url, at, headers (map, names in lower case), payload, digest; further
    columns are ignored.

    One row per revisit: record_id, canonical_url, at, outcome, source_id, headers, payload, digest. outcome is
    ``resolved``, ``changed`` (validators differ; no body is given) or ``missing`` (no earlier response). Of responses
    at one time the greatest record_id is the latest; one at the revisit's own time isn't earlier. Records without url or
    time can't be joined: such revisits are missing, such responses unused. Repeated revisit rows give repeated
    results. An empty table gives no rows.
    """
    r = records.select("record_id", "warc_type", canonical_url(F.col("url")).alias("canonical_url"), "at", "headers", "payload", "digest")
    good = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    cuts = r.filter(good).agg(F.percentile_approx(F.col("at").cast("double"), [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    # A time's bucket is the number of cuts before it.
    r = r.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("at").cast("double"))) if cuts else F.lit(0))
    response = F.col("warc_type") == "response"
    # Only ids and times are carried; headers and body come in at the end, by id.
    slim = r.filter(good & F.col("warc_type").isin("response", "revisit"))
    mark = F.when(response, F.struct("at", "record_id"))
    within = Window.partitionBy("canonical_url", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("at", F.unix_micros(F.col("at")))
    revisits = slim.select("record_id", "warc_type", "canonical_url", "bucket", "at", "headers", "digest", F.max(mark).over(within).alias("near")).filter("warc_type = 'revisit'")
    last = slim.filter(response).groupBy("canonical_url", "bucket").agg(F.max(F.struct("at", "record_id")).alias("last"))
    places = slim.filter("warc_type = 'revisit'").select("canonical_url", "bucket").distinct().join(last, ["canonical_url", "bucket"], "full")
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("carried", F.max("last").over(before)).select("canonical_url", "bucket", "carried")
    found = revisits.join(carried, ["canonical_url", "bucket"], "left").withColumn("hit", F.coalesce("near", "carried"))
    found = Staging(records.sparkSession, "warc").put(found.select("record_id", "canonical_url", "at", "headers", "digest", "hit"))
    # Responses of least or more revisits: HOT_ROWS at most, which are broadcast with their number of copies (2 * HOT_ROWS in all).
    met = found.filter("hit IS NOT NULL").groupBy(F.col("canonical_url").alias("hot_url"), F.col("hit.at").alias("hot_at"), F.col("hit.record_id").alias("hot_id")).agg(F.count("*").alias("n"))
    least = max(hot_from, -(-found.count() // HOT_ROWS))
    hot = F.broadcast(met.filter(F.col("n") >= least).withColumn("copies", F.ceil(F.col("n") / least).cast("int")).drop("n"))
    is_hot = lambda url, at, name: (url == F.col("hot_url")) & (at == F.col("hot_at")) & (name == F.col("hot_id"))
    found = found.join(hot, is_hot(F.col("canonical_url"), F.col("hit.at"), F.col("hit.record_id")), "left").drop("hot_url", "hot_at", "hot_id")
    found = found.withColumn("copy", F.coalesce(F.pmod(F.xxhash64("record_id", "at"), "copies").cast("int"), F.lit(0)))
    bodies = slim.filter(response).select(F.col("record_id").alias("source_id"), F.col("at").alias("source_at"), F.col("canonical_url").alias("source_url"), F.col("headers").alias("source_headers"), F.col("payload").alias("source_payload"), F.col("digest").alias("source_digest")).dropDuplicates(["source_id", "source_at", "source_url"])
    bodies = bodies.join(hot, is_hot(F.col("source_url"), F.col("source_at"), F.col("source_id")), "left").drop("hot_url", "hot_at", "hot_id")
    bodies = bodies.withColumn("source_copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    on = (F.col("copy") == F.col("source_copy")) & (F.col("hit.record_id") == F.col("source_id")) & (F.col("hit.at") == F.col("source_at")) & (F.col("canonical_url") == F.col("source_url"))
    joined = found.join(bodies, on, "left")
    own, full = F.col("headers"), F.col("source_headers")
    both = lambda h: F.try_element_at(own, F.lit(h)).isNotNull() & F.try_element_at(full, F.lit(h)).isNotNull()
    agree = F.when(both("etag"), _weak(F.try_element_at(own, F.lit("etag"))) == _weak(F.try_element_at(full, F.lit("etag"))))
    agree = agree.when(both("last-modified"), F.try_element_at(own, F.lit("last-modified")) == F.try_element_at(full, F.lit("last-modified")))
    agree = agree.otherwise(F.coalesce(F.col("digest") == F.col("source_digest"), F.lit(False)))
    outcome = F.when(F.col("source_id").isNull(), "missing").when(agree, "resolved").otherwise("changed")
    update = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(full, lambda k, v: ~F.map_contains_key(update, k)), update)
    ok = F.col("outcome") == "resolved"
    result = joined.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", F.timestamp_micros("at").alias("at"), "outcome", F.when(F.col("outcome") != "missing", F.col("source_id")).alias("source_id"),
        F.when(ok, merged).alias("headers"), F.when(ok, F.col("source_payload")).alias("payload"), F.when(ok, F.col("source_digest")).alias("digest"),
    )
    bad = r.filter((F.col("warc_type") == "revisit") & ~good)
    none = lambda c: F.lit(None).cast(dict(result.dtypes)[c]).alias(c)
    return result.unionByName(bad.select("record_id", "canonical_url", F.col("at").cast("timestamp").alias("at"), F.lit("missing").alias("outcome"), *map(none, ("source_id", "headers", "payload", "digest"))))


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The archive in pieces; a gzipped one is unpacked member by member, and ends where it is cut off or damaged."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view) and view[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        rest = view[at:]
        while not member.eof and len(rest):
            try:
                piece = member.decompress(rest, PIECE)
            except zlib.error:
                return
            rest = member.unconsumed_tail
            if piece:
                yield piece
            elif not rest:
                break
        if not member.eof:
            return
        at = len(view) - len(member.unused_data)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed or (by member) gzipped archive, one at a time.

    A record that breaks off, or whose length is no number, ends the file; a date that can't be read is null.
    """
    held = bytearray()
    pieces = _unpacked(data)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (start := held.find(b"WARC/")) < 0 or (end := held.find(b"\r\n\r\n", start)) < 0:
            if start < 0:
                del held[:-4]
            if not more():
                return
        fields = dict(_pairs(bytes(held[start:end]).split(b"\r\n")[1:]))
        length = fields.get("content-length", "0")
        if not length.isdecimal():
            return
        size = int(length)
        while len(held) < end + 4 + size:
            if not more():
                return
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        status, headers, payload = None, {}, block
        if block[:5] == b"HTTP/":
            head, _, payload = block.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            code = lines[0].split(b" ")[1:2]
            status = int(code[0]) if code and code[0].isdigit() else None
            headers = dict(_pairs(lines[1:]))
        yield {"record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"), "url": fields.get("warc-target-uri", "").strip("<>") or None, "at": _date(fields.get("warc-date")), "status": status, "headers": list(headers.items()), "payload": payload, "digest": fields.get("warc-payload-digest")}


def _date(text: str | None) -> datetime.datetime | None:
    try:
        return datetime.datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
    except ValueError:
        return None


def _pairs(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            yield name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip()


def read_warc(spark: SparkSession, path: str, glob: str = "*.warc*") -> DataFrame:
    """Records of all archives under a path, read through Spark's file source.

    A file is one row of at most 2 GB (as it is stored); it is unpacked as its records are taken, which leave in
    batches of about BATCH bytes. What a cut-off or damaged file has up to there is returned.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("url", pa.string()), ("at", pa.timestamp("us", "UTC")), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("digest", pa.string())])
        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                for r in parse_warc(b.column("content")[k].as_py()):
                    rows.append(r)
                    size += len(r["payload"])
                    if size >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").mapInArrow(parse, RECORD)


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl out of all pages: each page is fetched in full at second 2 * page_id and visited again 2001
    seconds later with a 304 that names the ETag and date the crawler then knew (those of the page itself)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    text = lambda c: F.col(c).cast("string")
    response = F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), (F.col("page_id") * 2).cast("string"))
    revisit = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") * 2 + 2001).cast("string"))
    full = p.select(text("page_id").alias("record_id"), F.lit("response").alias("warc_type"), "url", F.timestamp_seconds(F.col("page_id") * 2).alias("at"), response.alias("headers"), F.col("html").cast("binary").alias("payload"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    again = p.select(text("page_id").alias("record_id"), F.lit("revisit").alias("warc_type"), "url", F.timestamp_seconds(F.col("page_id") * 2 + 2001).alias("at"), revisit.alias("headers"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("string").alias("digest"))
    return full.unionByName(again)
