"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A response record becomes a `metadata` record (what was found out about the page) and a
`conversion` record (its visible text), as web archives keep them: both name the response in
WARC-Refers-To and carry its target, date and payload digest; the headers of the source go into
the metadata block. Record identifiers are derived from the response and the record type, so a
repeated or retried run makes the same records. Records are rows; `write` turns them into WARC
files with Spark's text sink and `read` reads such files back, checking every block digest.

Digests are SHA-256 in lowercase hex, as `sha256:...`; lengths count UTF-8 bytes.

Defined cases: a null url or body is an empty one; bodies are kept whole and byte for byte,
line breaks and all; repeated rows give repeated records with the same identifier; an empty
table gives no records; columns of pages other than id, url and html are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwatch.llm.common import prepare
from parcelwatch.llm.html_text import lines_of

DATE = "2024-01-01T00:00:00Z"  # pages carry no date; callers pass their own
VERSION = "WARC/1.1"
CRLF = "\r\n"
# A record: its headers in order, and its block.
RECORD = "page_id long, type string, record_id string, target_uri string, refers_to string, headers map<string,string>, block string"


def _uuid(*parts: Column) -> Column:
    """A name-based identifier of the parts, as a URN."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    groups = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(
        F.lit("<urn:uuid:"), groups[0], F.lit("-"), groups[1], F.lit("-8"), groups[2], F.lit("-a"), groups[3],
        F.lit("-"), groups[4], F.lit(">"),
    )


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of pages: the HTTP status line and headers, and the page as payload."""
    prepare(pages.sparkSession)
    url, html = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (url_col, html_col))
    length = F.octet_length(html).cast("string")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length,
        F.lit(CRLF + CRLF),
    )
    identity = F.col(f"`{id_col}`")
    payload = digest(html)
    record_id = _uuid(F.lit("response"), F.coalesce(identity.cast("string"), F.lit("")), url, payload)
    base = pages.select(
        identity.try_cast("long").alias("page_id"),  # a text that is no number: none
        F.lit("response").alias("type"),
        record_id.alias("record_id"),
        url.alias("target_uri"),
        F.lit(None).cast("string").alias("refers_to"),
        payload.alias("payload"),
        F.concat(head, html).alias("block"),
    )
    headers = F.create_map(
        F.lit("WARC-Date"), F.lit(date),
        F.lit("Content-Type"), F.lit("application/http; msgtype=response"),
        F.lit("WARC-Payload-Digest"), F.col("payload"),
        F.lit("WARC-Block-Digest"), digest(F.col("block")),
    )
    return base.withColumn("headers", headers).select(*[c.split()[0] for c in RECORD.split(", ")])


def _sha(text: str) -> str:
    return "sha256:" + sha256(text.encode()).hexdigest()


def _http(block: str) -> tuple[str, list[str], str]:
    """Status line, header lines and body of an HTTP response."""
    head, gap, body = block.partition(CRLF + CRLF)
    status, *lines = head.split(CRLF)
    return status, lines, body if gap else ""


def plain_lines(html: str) -> list[str]:
    """The visible text of a whole page, a line a block; white space in a line is one space."""
    return [line.text for line in lines_of(html)]


def derived(response_block: str) -> tuple[str, str]:
    """The metadata block and the plain text of a response."""
    status, headers, body = _http(response_block)
    lines = lines_of(body)
    text = "\n".join(line.text for line in lines)
    links = sum(line.link_chars for line in lines)
    fields = [f"source-status: {status}", *(f"source-header: {h}" for h in headers)]
    fields += [f"lines: {len(lines)}", f"text-chars: {len(text)}", f"link-chars: {links}"]
    return "".join(f + CRLF for f in fields), text


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the response records among `records`."""
    from_responses = records.filter("type = 'response'")

    @F.pandas_udf("metadata string, text string, metadata_digest string, text_digest string")
    def build(blocks: pd.Series) -> pd.DataFrame:
        made = [derived(b) for b in blocks]
        rows = [(m, t, _sha(m), _sha(t)) for m, t in made]
        return pd.DataFrame(rows, columns=["metadata", "text", "metadata_digest", "text_digest"])

    built = from_responses.withColumn("built", build(F.col("block")))

    def record(kind: str, block: str, block_digest: str, content: str) -> Column:
        headers = F.create_map(
            F.lit("WARC-Date"), F.col("headers")["WARC-Date"],
            F.lit("Content-Type"), F.lit(content),
            F.lit("WARC-Source-Payload-Digest"), F.col("headers")["WARC-Payload-Digest"],
            F.lit("WARC-Block-Digest"), F.col(f"built.{block_digest}"),
        )
        return F.struct(
            F.lit(kind).alias("type"),
            _uuid(F.lit(kind), F.col("record_id")).alias("record_id"),
            headers.alias("headers"),
            F.col(f"built.{block}").alias("block"),
        )

    two = F.array(
        record("metadata", "metadata", "metadata_digest", "application/warc-fields"),
        record("conversion", "text", "text_digest", "text/plain; charset=utf-8"),
    )
    return (
        built.select("page_id", "target_uri", F.col("record_id").alias("refers_to"), F.explode(two).alias("r"))
        .select("page_id", "r.type", "r.record_id", "target_uri", "refers_to", "r.headers", "r.block")
    )


# --- files ----------------------------------------------------------------------------------


def serialised(record_type: Column, record_id: Column, target: Column, refers: Column, headers: Column, block: Column) -> Column:
    """A record as the text of a WARC file, without the final line break."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(CRLF)))
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", record_id),
        line("WARC-Target-URI", F.when(target != "", target)),
        line("WARC-Refers-To", refers),
        F.array_join(entries, ""),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF),
    )


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one a task, through Spark's text sink (any file system, retried tasks safe)."""
    columns = (F.col(c) for c in ("type", "record_id", "target_uri", "refers_to", "headers", "block"))
    text = records.select(serialised(*columns).alias("value"))
    text.write.option("lineSep", CRLF).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if version != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start, size = end + 4, int(headers["Content-Length"])
        yield headers, data[start : start + size]
        at = start + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files; a block that does not match its digest stops the run.

    A file is one task, as gzip cannot be split: keep files at the usual size of about a GB.
    """
    prepare(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                if name.endswith(".gz"):
                    data = gzip.decompress(data)
                rows = []
                for headers, block in parse(bytes(data)):
                    wanted = headers.get("WARC-Block-Digest")
                    text = block.decode()
                    if wanted and wanted != _sha(text):
                        raise ValueError(f"digest of {headers['WARC-Record-ID']} in {name}")
                    known = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Refers-To", "Content-Length")
                    rest = {k: v for k, v in headers.items() if k not in known}
                    rows.append((headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Target-URI", ""), headers.get("WARC-Refers-To"), rest, text))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=_READ)
                        rows = []
                yield pd.DataFrame(rows, columns=_READ)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "type string, record_id string, target_uri string, refers_to string, headers map<string,string>, block string"
    return files.mapInPandas(run, schema)


_READ = ["type", "record_id", "target_uri", "refers_to", "headers", "block"]
