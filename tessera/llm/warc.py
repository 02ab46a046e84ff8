"""WARC: records read and written, and not-modified revisits resolved against the latest earlier full response."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may update in the stored response (RFC 9110 15.4.5, RFC 9111 3.2); those that
#: describe the stored body (content-length, content-encoding, content-type, content-range, transfer-encoding) stay as they were.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "set-cookie")
#: Time is cut into so many spans with about as many captures each; a url with a share of all captures lies in as large a share of them.
SPANS = 64

RECORD = "record_id string, warc_type string, url string, ts timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, http and https alike, no www., default port, fragment or trailing slash; query keys in order, without tracking keys."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"(?i)^(utm_[a-z]+|sessionid|sid|phpsessionid|jsessionid|gclid|fbclid)(=|$)")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolve_revisits(records: DataFrame, permitted=PERMITTED) -> DataFrame:
    """One row per revisit row: (record_id, canonical_url, ts, outcome, base_id, status, headers).

    ``records``: record_id, warc_type ('response' or 'revisit'), url, ts, status, etag, last_modified, digest, headers (map, lower-case
    names). The base is the latest full response (status 200) of the same canonical url at an earlier ts; of equal ts the larger
    record_id, then the larger etag, last_modified, digest and headers, so a repeated response row changes nothing and a repeated
    revisit row is resolved each time. Validators that both have must be equal: ETag (weak comparison), else Last-Modified, else the
    payload digest. ``outcome``: resolved, no_base, mismatch, or unverified if they share no validator (then there is no merge). A
    resolved revisit has the base's status and headers with the permitted ones of its own. Null url or ts: no_base, and as a response
    never a base. Null headers are empty ones. An empty table gives an empty result. Other columns are ignored.
    """
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    empty = F.create_map().cast("map<string,string>")
    r = records.select("record_id", "warc_type", canonical_url(F.col("url")).alias("curl"), F.col("ts").cast("timestamp").alias("ts"), F.col("status").cast("int").alias("status"), "etag", "last_modified", "digest", F.coalesce("headers", empty).alias("headers"))
    r = r.where("warc_type = 'revisit' or (warc_type = 'response' and status = 200 and curl is not null and ts is not null)")
    micro = F.unix_micros("ts")
    timed = F.col("curl").isNotNull() & F.col("ts").isNotNull()
    cuts = r.where(timed).agg(F.approx_percentile(micro, [k / SPANS for k in range(1, SPANS)], 10_000)).first()[0] or []
    r = r.withColumn("span", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), lambda c: c < micro)))
    # the base as one value that has an order, so that the latest is a maximum and needs no join
    entries = F.array_sort(F.map_entries("headers"))
    base = F.struct(micro.alias("at"), F.col("record_id").alias("id"), F.col("etag").alias("etag"), F.col("last_modified").alias("lm"), F.col("digest").alias("digest"), F.col("status").alias("status"), entries.alias("entries"))
    mark = F.when(F.col("warc_type") == "response", base)
    # the latest response of each url and span, then that of all spans before: SPANS rows a url at most
    ends = r.where(timed).groupBy("curl", "span").agg(F.max(mark).alias("end"))
    earlier = Window.partitionBy("curl").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    past = ends.select("curl", "span", F.max("end").over(earlier).alias("past"))
    # within the span, what is strictly earlier
    near = Window.partitionBy("curl", "span").orderBy(micro).rangeBetween(Window.unboundedPreceding, -1)
    own = ["record_id", "curl", "ts", "etag", "last_modified", "digest", "headers"]
    seen = r.where(timed).select(*own, "warc_type", "span", F.max(mark).over(near).alias("near")).where("warc_type = 'revisit'")
    seen = seen.join(past, ["curl", "span"], "left").select(*own, F.coalesce("near", "past").alias("base"))
    lost = r.where(~timed).select(*own).withColumn("base", F.lit(None).cast(seen.schema["base"].dataType))
    out = seen.unionByName(lost)
    b = F.col("base")
    has_tag = F.col("etag").isNotNull() & b["etag"].isNotNull()
    has_lm = F.col("last_modified").isNotNull() & b["lm"].isNotNull()
    has_digest = F.col("digest").isNotNull() & b["digest"].isNotNull()
    same = F.when(has_tag, weak(F.col("etag")) == weak(b["etag"])).when(has_lm, F.col("last_modified") == b["lm"]).when(has_digest, F.col("digest") == b["digest"])
    out = out.withColumn("outcome", F.when(b.isNull(), "no_base").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch"))
    mine = F.map_filter("headers", lambda k, v: F.lower(k).isin(*permitted))
    stay = F.map_filter(F.map_from_entries(b["entries"]), lambda k, v: ~F.array_contains(F.map_keys(mine), k))
    ok = F.col("outcome") == "resolved"
    return out.select("record_id", F.col("curl").alias("canonical_url"), "ts", "outcome", b["id"].alias("base_id"), F.when(ok, b["status"]).alias("status"), F.when(ok, F.map_concat(stay, mine)).alias("headers"))


# --- the files -----------------------------------------------------------------------------------------------


#: Bytes read at a time, and the longest head of a record.
CHUNK, HEAD = 1 << 20, 1 << 20


def unpacked(stream) -> Iterator[bytes]:
    """The bytes of a file that is plain or gzipped by record, in pieces; a damaged member ends them after what there is of it."""
    data = stream.read(CHUNK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(CHUNK)
        return
    member = zlib.decompressobj(31)
    while data:
        try:
            out = member.decompress(data, CHUNK)
        except zlib.error:
            return
        if out:
            yield out
        data = member.unconsumed_tail
        if member.eof:
            data, member = member.unused_data, zlib.decompressobj(31)
        if len(data) < 2:
            data += stream.read(CHUNK)


def parse_warc(file) -> Iterator[dict]:
    """The response and revisit records of a WARC file, plain or gzipped by record, given as bytes or as a stream; a damaged tail ends it.

    A stream is read forward once, and no more than a record and a chunk of it is held.
    """
    pieces, data, at, more = unpacked(io.BytesIO(file) if isinstance(file, bytes) else file), bytearray(), 0, True

    def fill(size: int) -> bool:
        """Whether so many bytes follow the place reached."""
        nonlocal data, at, more
        if len(data) - at < size and at:
            del data[:at]
            at = 0
        while more and len(data) < size:
            piece = next(pieces, None)
            more = piece is not None
            data += piece or b""
        return len(data) - at >= size

    while True:
        while fill(5) and (found := data.find(b"WARC/", at)) != at:
            at = found if found >= 0 else len(data) - 4  # the mark may be cut
        size = 4096
        while fill(size) or len(data) > at:
            end = data.find(b"\r\n\r\n", at, at + size)
            if end >= 0 or not more or size >= HEAD:
                break
            size *= 4
        else:
            return
        if end < 0:
            return
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        try:
            size = int(head.get("content-length", ""))
        except ValueError:
            return
        before = end + 4 - at
        if size < 0 or not fill(before + size):
            return
        body = bytes(data[at + before : at + before + size])
        at += before + size
        if head.get("warc-type") in ("response", "revisit"):
            top, _, payload = body.partition(b"\r\n\r\n")
            lines = top.decode("latin-1").split("\r\n")
            code = lines[0].split(" ")[1:2]
            yield {
                "record_id": head.get("warc-record-id"), "warc_type": head["warc-type"], "url": head.get("warc-target-uri"), "ts": head.get("warc-date"), "digest": head.get("warc-payload-digest"),
                "status": int(code[0]) if code and code[0].isdigit() else None, "headers": {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}, "payload": payload,
            }


def write_warc(records: list[dict]) -> bytes:
    """A WARC file with a gzip member for each record; what parse_warc reads back."""
    out = []
    for r in records:
        http = "\r\n".join([f"HTTP/1.1 {r['status']} -", *(f"{k}: {v}" for k, v in (r.get("headers") or {}).items())]).encode("latin-1") + b"\r\n\r\n" + (r.get("payload") or b"")
        names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "url"), ("WARC-Date", "ts"), ("WARC-Payload-Digest", "digest"))
        head = "\r\n".join(["WARC/1.1", *(f"{n}: {r[k]}" for n, k in names if r.get(k)), f"Content-Length: {len(http)}"]).encode()
        out.append(gzip.compress(head + b"\r\n\r\n" + http + b"\r\n\r\n"))
    return b"".join(out)


def open_uri(uri: str):
    """A stream of a file that Arrow's file systems open: local, HDFS and the object stores it is built with."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(name, compression=None, buffer_size=CHUNK)


def read_warc(spark: SparkSession, path: str, opener=open_uri) -> DataFrame:
    """The records of WARC files, with etag and last_modified beside headers.

    Spark lists the files and each is one task, which reads it as a stream that ``opener(uri)`` opens, so a file may have any size.
    """
    import pyarrow as pa

    schema = "record_id string, warc_type string, url string, ts string, digest string, status int, headers map<string,string>, payload binary"
    kinds = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("url", pa.string()), ("ts", pa.string()), ("digest", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                with opener(uri) as stream:
                    for x in parse_warc(stream):
                        rows.append(x | {"headers": list(x["headers"].items())})
                        size += len(x["payload"])
                        if len(rows) == 256 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/(?=[^/])", "file:///").alias("path"))
    raw = files.repartition(max(1, min(files.count(), 100_000)), "path").mapInArrow(read, schema)
    return raw.withColumn("ts", F.try_to_timestamp("ts")).withColumns({"etag": F.col("headers")["etag"], "last_modified": F.col("headers")["last-modified"]})


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each page's full response, and an hour later a not-modified answer for it.

    Of the answers every seventh carries the tag of another body, every fifth no tag (then its date or its digest may tell), every
    eleventh comes before any response, every 23rd at the very moment of its response, every 13th has no url and every 17th no time.
    Every 19th response is written twice, and every third tag is a weak one.
    """
    p, text = F.col("page_id"), F.coalesce("html", F.lit(""))
    base = F.timestamp_seconds(F.lit(1704067200) + p * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(text), 1, 12), F.lit('"'))
    day = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    modified = F.when(p % 3 == 0, day(base)).alias("last_modified")
    full = pages.select(
        F.concat(F.lit("r"), p.cast("string")).alias("record_id"), F.lit("response").alias("warc_type"), "url", base.alias("ts"), F.lit(200).alias("status"), F.when(p % 3 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag).alias("etag"), modified, F.md5(text).alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day(base), F.lit("content-length"), F.length(text).cast("string")).alias("headers"),
    )
    full = full.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.substring("record_id", 2, 99).cast("long") % 19 == 0, 2).otherwise(1)))).drop("n")
    later = F.when(p % 17 == 0, F.lit(None)).when(p % 11 == 0, F.timestamp_seconds(F.lit(1704067200) + p * 60 - 86400 * 3650)).when(p % 23 == 0, base).otherwise(F.timestamp_seconds(F.lit(1704067200) + p * 60 + 3600))
    etag = F.when(p % 5 == 0, F.lit(None)).when(p % 7 == 0, 'W/"other"').otherwise(F.concat(F.lit("W/"), tag))
    digest = F.when(p % 10 == 0, F.md5(text)).when(p % 25 == 0, "else")
    revisit = pages.select(
        F.concat(F.lit("v"), p.cast("string")).alias("record_id"), F.lit("revisit").alias("warc_type"), F.when(p % 13 != 0, F.col("url")).alias("url"), later.alias("ts"), F.lit(304).alias("status"), etag.alias("etag"), modified, digest.alias("digest"),
        F.create_map(F.lit("date"), F.coalesce(day(later), F.lit("-")), F.lit("content-length"), F.lit("0"), F.lit("expires"), F.lit("0")).alias("headers"),
    )
    return full.unionByName(revisit)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "outcome", "base_id", "status", merged.alias("headers"))


ORACLE = r"""
WITH raw AS (
  SELECT page_id AS p, url, coalesce(html, '') AS h, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS base FROM pages
),
log AS (
  SELECT 'r' || p AS record_id, 'response' AS kind, url, base AS ts, CASE WHEN p % 3 = 1 THEN 'W/' ELSE '' END || '"' || md5(h)[1:12] || '"' AS etag,
         CASE WHEN p % 3 = 0 THEN strftime(base, '%Y-%m-%d %H:%M:%S') END AS lm, md5(h) AS digest, length(h) AS n FROM raw
  UNION ALL
  SELECT 'v' || p, 'revisit', CASE WHEN p % 13 <> 0 THEN url END,
         CASE WHEN p % 17 = 0 THEN NULL WHEN p % 11 = 0 THEN base - INTERVAL 3650 DAY WHEN p % 23 = 0 THEN base ELSE base + INTERVAL 1 HOUR END,
         CASE WHEN p % 5 = 0 THEN NULL WHEN p % 7 = 0 THEN 'W/"other"' ELSE 'W/"' || md5(h)[1:12] || '"' END,
         CASE WHEN p % 3 = 0 THEN strftime(base, '%Y-%m-%d %H:%M:%S') END, CASE WHEN p % 10 = 0 THEN md5(h) WHEN p % 25 = 0 THEN 'else' END, NULL FROM raw
),
cut AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM log),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|sessionid|sid|phpsessionid|jsessionid|gclid|fbclid)(=|$)'))) AS q FROM cut
),
named AS (SELECT *, CASE WHEN url IS NOT NULL THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS curl FROM parts),
paired AS (
  SELECT v.*, (SELECT max(struct_pack(ts := b.ts, id := b.record_id)).id FROM named b WHERE b.kind = 'response' AND b.curl = v.curl AND b.ts < v.ts) AS base_id
  FROM named v WHERE v.kind = 'revisit'
),
judged AS (
  SELECT v.*, b.etag AS b_etag, b.lm AS b_lm, b.digest AS b_digest, b.n AS b_n, b.record_id AS b_id FROM paired v LEFT JOIN named b ON b.record_id = v.base_id
),
said AS (
  SELECT *, CASE WHEN b_id IS NULL THEN 'no_base'
                 WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = replace(b_etag, 'W/', '') THEN 'resolved' ELSE 'mismatch' END
                 WHEN lm IS NOT NULL AND b_lm IS NOT NULL THEN CASE WHEN lm = b_lm THEN 'resolved' ELSE 'mismatch' END
                 WHEN digest IS NOT NULL AND b_digest IS NOT NULL THEN CASE WHEN digest = b_digest THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unverified' END AS outcome FROM judged
)
SELECT record_id, curl AS canonical_url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, outcome, base_id,
       CASE WHEN outcome = 'resolved' THEN 200 END::INTEGER AS status,
       CASE WHEN outcome = 'resolved' THEN 'content-length=' || b_n || ';content-type=text/html;date=' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ';expires=0' END AS headers
FROM said
"""
