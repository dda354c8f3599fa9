"""WARC derivatives: metadata and plain-text conversion records of response records.

A response becomes a metadata record (what its header and page say) and a conversion
record (its text), each linked to it by WARC-Refers-To and carrying the source's target
URI, date and payload digest.  The metadata record holds every header line of the source,
folded ones on one line.  Narrow: one scan, no shuffle.

A null body is an empty one, a null header has no status and no type.  Responses of other
types than HTML or text keep a metadata record and have no conversion record.  Repeated
responses give repeated records.  A null record id gives records with null ids.
"""

from __future__ import annotations

import html as markup
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOL = "\r\n"
# Elements whose content is no text, then comments.
_HIDDEN = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->")
_BLOCKS = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(\s[^<>]*)?/?>"


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def urn(*parts: Column) -> Column:
    """A record id that follows from what it names, so reruns give the same."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


_SPACE = re.compile(r"&(?:nbsp;?|#0*160(?![0-9]);?|#x0*a0(?![0-9a-f]);?)", re.IGNORECASE)


def _resolved(text: pd.Series) -> pd.Series:
    """Named and numeric entities as characters, once; a space that keeps words together is one."""
    return text.map(lambda t: markup.unescape(_SPACE.sub(" ", t)) if t and "&" in t else t).astype(object)


def plain_text(html: Column) -> Column:
    """A line for each block element, other tags gone, entities resolved, spaces closed up."""
    text = html
    for pattern in _HIDDEN:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), _BLOCKS, "\n")
    text = F.regexp_replace(text, r"<[a-zA-Z/!?][^<>]*>", "")
    # All texts go, so that the expressions before stand in the plan once.
    text = F.pandas_udf(_resolved, "string")(text)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of (page_id, url, html): record_id, target_uri, warc_date, http_header, payload."""
    return pages.select(
        "page_id", F.when(F.col("page_id").isNotNull(), urn(F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}").alias("http_header"), F.col("html").alias("payload"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records of each response, one after the other.

    Takes record_id, target_uri, warc_date, http_header and payload; `keep` names columns
    carried along.  Gives record_type, record_id, refers_to, target_uri, warc_date,
    content_type, payload_digest (of the source), block_digest, content_length (bytes)
    and block.
    """
    source = responses.select(
        *keep, "record_id", "target_uri", "warc_date", F.coalesce("http_header", F.lit("")).alias("_header"), F.coalesce("payload", F.lit("")).alias("_payload")
    )
    field = lambda name: F.trim(F.regexp_extract("_header", rf"(?im)^{name}:([^\r\n]*)", 1))
    kind = F.lower(F.trim(F.split_part(field("content-type"), F.lit(";"), F.lit(1))))
    source = source.withColumn("_kind", kind).withColumn("_digest", digest(F.col("_payload"))).withColumn(
        "_status", F.regexp_extract("_header", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    )
    lines = F.split(F.regexp_replace("_header", r"\r?\n[ \t]+", " "), r"\r?\n")
    headers = F.transform(F.filter(lines, lambda h: (h != "") & ~h.startswith("HTTP/")), lambda h: F.concat(F.lit("http-header: "), h, F.lit(EOL)))
    title = F.trim(F.regexp_replace(F.regexp_extract("_payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    lang = F.regexp_extract("_payload", r'(?i)<html[^>]*\slang="([^"]*)"', 1)
    fields = F.concat(*[
        F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
        for name, value in (
            ("http-status", F.col("_status")), ("http-content-type", F.col("_kind")), ("source-digest", F.col("_digest")),
            ("source-length", F.octet_length("_payload").cast("string")), ("language", lang), ("title", title),
        )
    ], F.array_join(headers, ""))
    text = F.when(F.col("_kind") == "text/html", plain_text(F.col("_payload"))).otherwise(F.col("_payload"))
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.when(F.col("_kind").startswith("text/"), F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), text.alias("block"))),
    )
    each = source.withColumn("_made", F.explode(F.filter(made, lambda r: r.isNotNull())))
    return each.select(
        *keep, F.col("_made.record_type").alias("record_type"),
        F.when(F.col("record_id").isNotNull(), urn(F.col("_made.record_type"), F.col("record_id"))).alias("record_id"),
        F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("_made.content_type").alias("content_type"),
        F.col("_digest").alias("payload_digest"), digest(F.col("_made.block")).alias("block_digest"),
        F.octet_length("_made.block").cast("bigint").alias("content_length"), F.col("_made.block").alias("block"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """`record`: each record as WARC/1.1 text without the two line ends that close it."""
    line = lambda name, column: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(EOL)), F.lit(""))
    return records.select(F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
        line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"), line("WARC-Payload-Digest", "payload_digest"),
        line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"),
        F.lit(EOL), F.col("block"),
    ).alias("record"))


def write(records: DataFrame, path: str) -> None:
    """WARC files under `path`, compressed, one to a partition."""
    serialized(records).write.option("lineSep", EOL * 2).option("compression", "gzip").text(path)
