"""WARC derivatives: each response gives a metadata record and a plain-text conversion record that refer to it.

Records are rows and the whole record is text, so writing them needs no more than Spark's text writer. Headers, digests and
identifiers are column expressions; a page's text, title and links are taken out in Arrow batches by scans that look at no
character more than a fixed number of times, whatever a page leaves unclosed. Digests are labelled sha256 in hexadecimal.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Named character references that are decoded, in this order, the ampersand last.
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "amp": "&"}
#: Elements whose content is no text, and those that end a line.
HIDDEN = ("script", "style", "noscript", "template")
UNSEEN = "(?s)<!--.*?-->|" + "|".join(rf"(?i:<{x}[^>]*>).*?(?i:</{x})\s*>" for x in HIDDEN)
BREAKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|title|blockquote|pre"
BLANK = r"[ \t\n\f\r]"

_FLAGS = re.IGNORECASE | re.ASCII
_OPEN = re.compile(f"<!--|<({'|'.join(HIDDEN)})", _FLAGS)
_CLOSE = {x: re.compile(f"</{x}{BLANK}*>", _FLAGS) for x in (*HIDDEN, "title")}
_BREAK = re.compile(f"</?(?:{BREAKS})(?:{BLANK}[^>]*)?/?>", _FLAGS)
_TAG = re.compile("<[^>]*>")
_TITLE = re.compile("<title", _FLAGS)
_ANCHOR = re.compile(f"<a{BLANK}", _FLAGS)
_HREF = re.compile(f'href{BLANK}*={BLANK}*"([^"]*)"', _FLAGS)
_NUMBER = re.compile("&#([0-9]{1,7});")
_BLANKS = re.compile("[ \t\r\f]{2,}|[\t\r\f]")
_LINES = re.compile(" ?\n[ \n]*")


def _seen(page: str) -> str:
    """page without comments and hidden elements. What is not closed any more is not looked for again, and stays."""
    out, at, look, after, unclosed = [], 0, 0, -1, set()
    while m := _OPEN.search(page, look):
        look, kind = m.end(), (m[1] or "").lower()
        if kind in unclosed:
            continue
        if kind:
            if after < look and (after := page.find(">", look)) < 0:
                break  # no tag and no comment ends here or later
            close = _CLOSE[kind].search(page, after + 1)
            end = close.end() if close else 0
        else:
            end = page.find("-->", look) + 3
            end = end if end > 2 else 0
        if not end:
            unclosed.add(kind)
            continue
        out.append(page[at : m.start()])
        at = look = end
    return "".join([*out, page[at:]]) if at else page


def _tags(pattern: re.Pattern, put: str, page: str) -> str:
    """Tags replaced up to the last character that can end one, so that none is begun in vain."""
    last = page.rfind(">") + 1
    return pattern.sub(put, page[:last]) + page[last:] if last else page


def _character(m: re.Match) -> str:
    n = int(m[1])
    return chr(n) if 0 < n < 0xD800 or 0xDFFF < n < 0x110000 else m[0]


def page_text(page: str) -> str:
    """Text of an HTML page: no comments, scripts or styles; a line for each block; decimal and the listed named references decoded; runs of blanks joined."""
    t = _tags(_TAG, "", _tags(_BREAK, "\n", _seen(page)))
    if "&" in t:
        t = _NUMBER.sub(_character, t)
        for name, char in REFERENCES.items():
            t = t.replace(f"&{name};", char)
    return _LINES.sub("\n", _BLANKS.sub(" ", t)).strip(" \n")


def page_title(page: str) -> str:
    """Content of the first title element; empty without one."""
    if (m := _TITLE.search(page)) and (begin := page.find(">", m.end()) + 1) and (end := _CLOSE["title"].search(page, begin)):
        return page[begin : end.start()]
    return ""


def page_links(page: str) -> list[str]:
    """The first quoted href of each anchor tag, as it stands."""
    out, look, after, href = [], 0, -1, None
    while m := _ANCHOR.search(page, look):
        look = m.end()
        if href is None or href.start() < look:
            href = _HREF.search(page, look)
            if href is None:
                break
        if after < look:
            after = page.find(">", look)
            after = len(page) if after < 0 else after
        if href.start() < after:
            out.append(href[1])
            look = href.end()
    return out


def page_parts(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"text": [page_text(x) for x in pages], "title": [page_title(x) for x in pages], "links": [page_links(x) for x in pages]})


def record_id(*parts: Column | str) -> Column:
    """A record identifier that is a function of its parts, so that a task run again gives the same record."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of fetched pages: id, record_id, target_uri, warc_date, http_headers, payload. A null page has an empty
    payload, a null URL gives no target. A record's identifier follows from its id, URL and payload: rows alike in all three have one."""
    html = F.coalesce(pages[html_col], F.lit(""))
    return pages.select(
        pages[id_col],
        record_id(F.lit("response"), pages[id_col].cast("string"), pages[url_col], digest(html)).alias("record_id"),
        pages[url_col].alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF)).alias("http_headers"),
        html.alias("payload"),
    )


def derivatives(source: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows for each response: id, record_type (metadata, conversion), record_id, refers_to, target_uri, warc_date,
    content_type, content_length (bytes), block_digest, source_digest (of the response's block), payload_digest, headers, block.

    source: what responses() returns, or read_responses(). Null headers or payloads count as empty; repeated rows give
    repeated records with the same identifiers; line breaks in a URL are percent-encoded in the header; other columns are
    ignored. A narrow pass: one scan, no shuffle.
    """
    payload, http = F.coalesce(F.col("payload"), F.lit("")), F.coalesce(F.col("http_headers"), F.lit(""))
    own = source.select(
        id_col, F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        digest(F.concat(http, F.lit(CRLF), payload)).alias("source_digest"), digest(payload).alias("payload_digest"),
        record_id(F.lit("conversion"), "record_id").alias("_conversion"), record_id(F.lit("metadata"), "record_id").alias("_metadata"),
        http.alias("_http"), F.pandas_udf(page_parts, "text string, title string, links array<string>")(payload).alias("_page"),
    )
    fields = F.concat(
        F.lit("title: "), F.regexp_replace("_page.title", "[\r\n]+", " "), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF),
        F.lit("conversion: "), F.col("_conversion"), F.lit(CRLF),
        F.array_join(F.transform(F.filter(F.split(F.col("_http"), CRLF), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x, F.lit(CRLF))), ""),
        F.array_join(F.transform(F.col("_page.links"), lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "[\r\n]+", ""), F.lit(f" L a/@href{CRLF}"))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("_metadata").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("_conversion").alias("record_id"), F.lit("text/plain").alias("content_type"), F.col("_page.text").alias("block")),
    )
    rows = own.select(id_col, "refers_to", "target_uri", "warc_date", "source_digest", "payload_digest", F.explode(kinds).alias("r"))
    block = F.col("r.block")
    rows = rows.select(
        id_col, "r.record_type", "r.record_id", "refers_to", "target_uri", "warc_date", "r.content_type",
        F.octet_length(block).cast("long").alias("content_length"), digest(block).alias("block_digest"), "source_digest", "payload_digest", block.alias("block"),
    )
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    headers = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.replace(F.replace("target_uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Block-Digest", F.col("source_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.withColumn("headers", headers)


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_responses(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """Response records of WARC files, as derivatives() takes them: id (here the record's identifier), record_id, target_uri,
    warc_date, http_headers, payload, and whole: false if the file holds fewer bytes than the record's Content-Length.

    Files are split between records by Spark's text reader (gzipped ones are one task each); other records are left out.
    Bytes that are no UTF-8 become replacement characters.
    """
    between = CRLF + CRLF
    rows = spark.read.option("lineSep", f"{between}WARC/").text(path).select("value", F.substring_index("value", between, 1).alias("head"))
    rows = rows.where(F.lower(_header(F.col("head"), "WARC-Type")) == "response")
    length = F.coalesce(_header(F.col("head"), "Content-Length").try_cast("int"), F.lit(0))
    rows = rows.select("head", length.alias("length"), F.substr(F.col("value").cast("binary"), F.octet_length("head") + 5, length).alias("bytes"))
    block = F.make_valid_utf8(F.col("bytes").cast("string"))
    rows = rows.withColumns({"block": block, "http": F.substring_index(block, between, 1)})
    rid = _header(F.col("head"), "WARC-Record-ID")
    return rows.select(
        rid.alias(id_col), rid.alias("record_id"), _header(F.col("head"), "WARC-Target-URI").alias("target_uri"), _header(F.col("head"), "WARC-Date").alias("warc_date"),
        F.concat("http", F.lit(CRLF)).alias("http_headers"), F.substr("block", F.length("http") + 5).alias("payload"), (F.octet_length("bytes") == F.col("length")).alias("whole"),
    )


def _members(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records (record, warc_date) of a partition as gzip members without their last byte, a warcinfo record first."""

    def member(record: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        whole = z.compress(record) + z.flush()
        return (whole + gzip.compress(b"", mtime=0) if whole[-1] else whole)[:-1]

    def info(date: str | None) -> bytes:
        rid = uuid.UUID(hashlib.md5(f"warcinfo\n{path}\n{TaskContext.get().partitionId()}".encode()).hexdigest())
        block = f"software: dayroll{CRLF}format: WARC File Format 1.1{CRLF}"
        head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{rid}>", "WARC-Date": date or "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields", "Content-Length": len(block)}
        return CRLF.join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), "", block + CRLF + CRLF]).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            records = (x.as_py() for x in b.column(0))
            if first:
                records, first = chain([info(b.column(1)[0].as_py())], records), False
            for x in records:
                yield pa.RecordBatch.from_arrays([pa.array([member(x)], pa.binary())], ["member"])

    return run


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (headers, block, warc_date) as WARC files named *.warc.gz, one for each partition that has records: a warcinfo
    record and then the partition's, each a gzip member of its own, so that a reader can begin at any of them.

    Spark's text writer puts a line separator after each value. A member ends with its record's length, of which the last byte is
    zero below 16 MB: that byte is the separator. Longer records are followed by an empty member, which ends with zero. The files are
    written and committed as text and then named by the driver, which reads none of them. Null headers or blocks raise."""
    spark = records.sparkSession
    whole = F.concat(F.col("headers").cast("binary"), F.lit(CRLF).cast("binary"), F.col("block").cast("binary"), F.lit(CRLF + CRLF).cast("binary"))
    rows = records.select(F.coalesce(whole, F.raise_error("a record without headers or block").cast("binary")).alias("record"), "warc_date")
    rows.mapInArrow(_members(path), "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt") and not fs.rename(f.getPath(), jvm.Path(folder, name.removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"{name} could not be renamed")
