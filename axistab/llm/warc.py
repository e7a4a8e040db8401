"""WARC archives written and read by Spark, with boundary-chain verification.

Archives are uncompressed and may be split anywhere: a task reads what lies between two magic lines as one candidate, which
names its successor's offset through its Content-Length. Chains are contracted within segments of a file; pointer jumping
from the start of the file over the places where they enter segments keeps the candidates that the chain of records
reaches. A magic line inside a payload is never reached.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axistab.llm.common import free, join_sized, scratch_path, stage

MAGIC, GAP = "WARC/1.0\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
REVISIT_BYTES = 1000
#: Bytes of an archive whose part of the chain one task follows.
SEGMENT = 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(col: Column) -> Column:
    """The id as a URI; what is not plain in a string id is percent-encoded, so that no id can end its header line."""
    return F.concat(F.lit("<urn:page:"), F.url_encode(F.coalesce(col.cast("string"), F.lit(""))), F.lit(">"))


def revisits(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``_id, _sha, _to``: the rows whose payload of ``least`` bytes or more another row with a larger id has as well."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    seen = stage(
        df.select(F.col(id_col).alias("_id"), F.sha1(payload).alias("_sha"), F.octet_length(payload).alias("_n")).filter(F.col("_n") >= least),
        "payloads",
    )
    groups = seen.groupBy("_sha").agg(F.max("_id").alias("_to"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_sha", "_to")
    return stage(
        seen.join(groups.hint("merge"), "_sha").filter(~F.col("_id").eqNullSafe(F.col("_to"))).select("_id", "_sha", "_to").distinct(), "revisits",
    )


def write_warc(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES,
) -> None:
    """Write a record for each row; refuses an existing path.

    Of records with equal payloads of at least ``least`` bytes that with the largest id is a ``response``, the others are
    ``revisit`` records that refer to it and carry no payload; smaller ones are all ``response``. A null payload is empty, a
    null URL is the empty one; null ids are never the largest. Rows that repeat the largest id stay responses. Ids of any plain
    type come back as they were (an empty string id as null). Payloads are strings or binary; other columns are not read.
    """
    plain = df.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("_html"),
    )
    known = revisits(df, id_col, payload_col, least).withColumnRenamed("_id", "_rid").withColumn(
        "_key", F.concat(F.coalesce(F.col("_rid").cast("string"), F.lit("")), F.lit(" "), F.col("_sha")),
    )
    keyed = plain.withColumn("_sha", F.sha1(F.col("_html").cast("binary"))).withColumn(
        "_key", F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(" "), F.col("_sha")),
    )
    met = join_sized(keyed, known.select("_key", "_to", F.lit(True).alias("_again")), ["_key"], "left")
    again = F.col("_again").isNotNull()
    block = F.concat(F.lit(HTTP + GAP), F.when(again, F.lit("")).otherwise(F.col("_html").cast("string")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("_id")),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("_url", r"[\x00-\x20\x7F]", "%20"), F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("_sha"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP),
    )
    met.select(F.concat(head, block).alias("value")).write.option("lineSep", GAP).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines: ``value`` with its file, the start of its split and its place in the task."""
    raw = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return raw.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )


def _digest() -> Column:
    return F.unhex(F.sha1("value"))


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)


def _parsed(df: DataFrame) -> DataFrame:
    """Header fields of ``value``, and the digest of its payload if all of it is there."""
    head = F.substring_index("value", GAP, 1)
    out = df.withColumn("head", head).withColumn("head_bytes", F.octet_length("head") + 4).withColumn("size", F.octet_length("value"))
    out = out.withColumn(
        "block_bytes", F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*\\\\r?$', 1) as bigint)"),
    )
    out = out.withColumn("record_type", _field(F.col("head"), "WARC-Type")).withColumn("record_id", _field(F.col("head"), "WARC-Record-ID")).withColumn(
        "refers_to_id", _field(F.col("head"), "WARC-Refers-To"),
    )
    out = out.withColumn("declared", F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", ""))
    out = out.withColumn("whole", F.col("size") >= F.col("head_bytes") + F.col("block_bytes"))
    http = F.substring_index(F.substr("value", F.length("head") + 5), GAP, 1)
    skip = F.col("head_bytes") + F.octet_length(http) + 4
    payload = F.substring(F.col("value").cast("binary"), skip + 1, (F.col("head_bytes") + F.col("block_bytes") - skip).cast("int"))
    out = out.withColumn("payload", F.when(F.col("whole") & (F.col("record_type") == "response"), payload))
    return out.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))


_META = ["record_type", "record_id", "refers_to_id", "declared", "head_bytes", "block_bytes", "whole", "payload_bytes", "payload_digest"]


def _located(pieces: DataFrame) -> DataFrame:
    """``offset`` of the magic line before each piece: sizes summed within its split and over the splits before."""
    step = F.col("size") + len(MAGIC)
    before = F.sum(step).over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    per = pieces.groupBy("file", "split").agg(F.sum(step).alias("bytes"))
    base = F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("file", "split", F.coalesce(base, F.lit(0)).alias("base"))
    return pieces.withColumn("before", F.coalesce(before, F.lit(0))).join(starts.hint("merge"), ["file", "split"]).withColumn(
        "offset", F.col("base") + F.col("before") - len(MAGIC),
    ).drop("base", "before")


def _leaps(segment: int):
    """Where the chain through each candidate of a segment leaves it: nowhere (-1) if it breaks inside."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        offset, jump = rows["offset"].to_numpy(np.int64), rows["next"].to_numpy(np.int64)
        end = (int(key[1]) + 1) * segment
        at = np.searchsorted(offset, jump)
        known = (at < len(offset)) & (offset[np.minimum(at, len(offset) - 1)] == jump)
        out = np.where(jump >= end, jump, -1)
        for i in range(len(offset) - 1, -1, -1):  # successors come later in the file
            if jump[i] < end and known[i] and at[i] > i:
                out[i] = out[at[i]]
        return pd.DataFrame({"file": key[0], "offset": offset, "leap": out})

    return run


def _walked(key: tuple, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a segment that the chain from its entry passes, and the one before each piece (-1: in an earlier segment)."""
    if rows.empty:
        return pd.DataFrame({"file": [], "segment": [], "offset": [], "hit": [], "owner": []})
    rows = rows.sort_values("offset")
    offset, jump = rows["offset"].to_numpy(np.int64), rows["next"].fillna(-1).to_numpy(np.int64)
    hit, at = np.zeros(len(offset), bool), {int(o): i for i, o in enumerate(offset)}
    here = int(entries["offset"].iloc[0]) if len(entries) else -1
    while here in at and jump[at[here]] > here:
        hit[at[here]] = True
        here = int(jump[at[here]])
    last = np.maximum.accumulate(np.where(hit, offset, -1))
    return pd.DataFrame({"file": key[0], "segment": int(key[1]), "offset": offset, "hit": hit, "owner": last})


def reached(seen: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``file, offset, hit, owner`` of the pieces ``file, offset, next``: whether the chain from offset 0 of their file reaches
    them (``next`` is null for what is no candidate), and the last such record at or before them.

    The chain is contracted first: within each part of ``segment`` bytes every candidate learns where its chain leaves it.
    Pointer jumping then goes over the places where chains enter segments, about one for each, so a file of n segments
    takes log2(n) rounds over n rows. Last, each segment walks its own part of the chain from its entry.
    """
    rows = seen.filter("offset >= 0").select("file", "offset", "next", F.floor(F.col("offset") / segment).alias("segment"))
    leaps = stage(
        rows.filter("next is not null").groupBy("file", "segment").applyInPandas(_leaps(segment), "file string, offset long, leap long"), "leaps",
    )
    nodes = leaps.filter("leap >= 0").select("file", F.col("leap").alias("offset")).union(
        leaps.filter("offset = 0").select("file", "offset")
    ).distinct()
    state = stage(
        nodes.join(leaps.hint("merge"), ["file", "offset"]).select(
            "file", "offset", F.expr("nullif(leap, -1)").alias("jump"), (F.col("offset") == 0).alias("hit"),
        ),
        "chain",
    )
    while state.filter("hit and jump is not null").take(1):
        ahead = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("far"))
        marks = state.filter("hit and jump is not null").select("file", F.col("jump").alias("offset"), F.lit(True).alias("mark"))
        moved = state.join(ahead.hint("merge"), ["file", "jump"], "left").join(marks.hint("merge"), ["file", "offset"], "left")
        before, state = state, stage(
            moved.select("file", "offset", F.col("far").alias("jump"), (F.col("hit") | F.col("mark").isNotNull()).alias("hit")), "chain",
        )
        free(before)
    entries = state.filter("hit").select("file", "offset", F.floor(F.col("offset") / segment).alias("segment"))
    by = ["file", "segment"]
    walked = stage(
        rows.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(_walked, "file string, segment long, offset long, hit boolean, owner long"),
        "walked",
    )
    # What is before the first record of a segment belongs to the last record of the segments before it.
    through = F.max("last").over(Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    before = walked.groupBy(*by).agg(F.max("owner").alias("last")).withColumn("earlier", through).select(*by, "earlier")
    met = walked.join(before.hint("merge"), by)
    return met.select(
        "file", "offset", "hit", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.nullif(F.col("earlier"), F.lit(-1))).alias("owner"),
    )


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint", segment: int = SEGMENT) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the reachable records of the archives at ``path``.

    Digests are of the payloads as read; a revisit has those of the record with the id that it refers to and the digest that
    it declares (null if there is none). A chain that a damaged record breaks ends there. An empty archive gives no rows.
    """
    # Splits and places hold for one read only, so they are staged once; a later read knows pieces by file and digest.
    pieces = stage(_parsed(_pieces(spark, path).withColumn("piece", _digest())).select("file", "split", "at", "size", "piece", *_META), "pieces")
    valid = F.col("block_bytes").isNotNull() & (F.col("record_type") != "")
    after = F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("block_bytes") + len(GAP)
    seen = stage(_located(pieces).drop("split", "at").withColumn("next", F.when(valid, after)), "candidates")
    free(pieces)
    marked = stage(seen.join(reached(seen.select("file", "offset", "next"), segment).hint("merge"), ["file", "offset"]), "marked")
    fields = ["record_type", "record_id", "refers_to_id", "declared", "payload_bytes", "payload_digest"]
    found = marked.filter("hit and whole").select(*fields)
    broken = marked.filter("hit and not whole").select("file", F.col("offset").alias("owner"))
    if broken.take(1):  # payloads with a magic line inside are put together from their pieces
        places = stage(marked.select("file", "piece", "owner", "offset").join(broken.hint("merge"), ["file", "owner"]), "parts")
        wanted = stage(places.select("file", "piece").distinct(), "wanted")
        held = join_sized(
            _pieces(spark, path).select("file", "value", _digest().alias("piece")), wanted, ["file", "piece"], "left_semi",
        ).groupBy("file", "piece").agg(F.min("value").alias("value"))
        parts = places.join(held.hint("merge"), ["file", "piece"])
        whole = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("ps"))
        whole = _parsed(whole.select(F.array_join(F.transform("ps", lambda p: p["value"]), MAGIC).alias("value")))
        found = found.unionByName(whole.select(*fields))
    page = lambda c: F.expr(f"try_cast(nullif(try_url_decode(regexp_extract({c}, '^<urn:page:(.*)>$', 1)), '') as {id_type})")
    table = stage(found.withColumns({"page_id": page("record_id"), "refers_to": page("refers_to_id")}).drop("record_id", "refers_to_id"), "read")
    answers = table.filter("record_type = 'response'")
    lengths = answers.groupBy(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared"),
    ).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = table.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared").join(
        lengths.hint("merge"), ["refers_to", "declared"], "left",
    )
    again = again.withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("declared")))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return answers.select(*cols[:-1], F.lit(None).cast(id_type).alias("refers_to")).unionByName(again.select(*cols))


def archive_round_trip(df: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the rows as archives (in the shared scratch folder unless ``path`` is given) and read them back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(df, path, id_col, url_col, payload_col)
    return read_warc(spark, path, df.schema[id_col].dataType.simpleString())


ORACLE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(h) as payload_digest from p),
w as (select *, max(page_id) over (partition by payload_digest) as top from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from w
"""
