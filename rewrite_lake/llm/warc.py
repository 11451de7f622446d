"""WARC archives: a writer in DataFrame functions and a Python data source.

The writer renders each page as one WARC/1.1 record and lets Spark's text writer
place it (a record's closing blank lines are the line separator), so archives go
to any store Spark writes to, and a lost task leaves nothing half-written.

The reader plans whole files, packed to ``partitionBytes``, evaluates pushed
predicates on the record type and header fields as soon as a record's headers are
parsed, and seeks over the payloads nobody wants.  It opens what Arrow's file
systems open (a plain path, ``file:``, ``hdfs:``, ``s3:``, ``gs:``); of Spark's other
schemes the archives can be written but not read here.
"""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith)

from .common import fresh, materialize, read, scratch

#: Payloads of at least so many bytes are stored once.
MIN_REVISIT = 1000
#: Records of one file, so that a file stays one task's work.
RECORDS_PER_FILE = 2000
#: Rows and bits of a row of the bitmap of digests met twice (Spark's bitmap functions fix the bits): 8 MB at most.
BITMAP_ROWS, BITMAP_BITS = 2048, 32768
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
_ID = "urn:page:"

SCHEMA = ("type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
          "payload_length bigint, content_type string, content_length bigint, file string, offset bigint, payload binary")
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Column -> header field, for the columns known once headers are parsed.
_FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_length": "warc-payload-length",
           "content_type": "content-type", "content_length": "content-length"}


# --- writing ------------------------------------------------------------------

def _bit_set(bitmap: Column, bit: Column) -> Column:
    """Whether bit ``bit`` of a bitmap is set (of none: no)."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def plan_records(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html",
                 min_revisit: int = MIN_REVISIT, bitmap_rows: int = BITMAP_ROWS) -> DataFrame:
    """``pages`` with payload_digest (SHA-1 hex), payload_length and refers_to.

    Of the rows with one payload of at least ``min_revisit`` bytes, those that
    carry the largest id are responses, the others refer to that id.  A null
    payload is empty; null ids come last and refer to nothing when all are null.

    Payloads stay where they are: digests are counted without them, those met
    twice are folded into a bitmap of ``bitmap_rows`` x 32,768 bits, and only rows
    whose digest hits it are joined with the largest ids.  A fuller bitmap sends
    more rows through the join; it changes no result.
    """
    digest, length, refers = fresh(pages, "payload_digest", "payload_length", "refers_to")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    sized = pages.select("*", F.sha1(payload).alias(digest), F.octet_length(payload).cast("long").alias(length))
    winners = sized.where(F.col(length) >= min_revisit).groupBy(F.col(digest).alias("d_")).agg(
        F.max(id_col).alias("winner_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    winners = materialize(winners, "warc-winners")
    place = lambda d: F.pmod(F.xxhash64(d), F.lit(bitmap_rows * BITMAP_BITS))
    bitmap = winners.groupBy(F.floor(place(F.col("d_")) / BITMAP_BITS).alias("row_")).agg(
        F.bitmap_construct_agg((place(F.col("d_")) % BITMAP_BITS)).alias("bits_"))
    # at most bitmap_rows rows of 4 KB
    seen = sized.join(F.broadcast(bitmap), F.floor(place(F.col(digest)) / BITMAP_BITS) == F.col("row_"), "left")
    hit = _bit_set(F.col("bits_"), place(F.col(digest)) % BITMAP_BITS) & (F.col(length) >= min_revisit)
    alone = seen.where(~hit).drop("row_", "bits_").withColumn(refers, F.lit(None).cast(pages.schema[id_col].dataType))
    joined = seen.where(hit).drop("row_", "bits_").join(winners, F.col(digest) == F.col("d_"), "left")
    refer = F.when(~F.col(id_col).eqNullSafe(F.col("winner_")), F.col("winner_"))
    return alone.union(joined.withColumn(refers, refer).drop("d_", "winner_"))


def render(planned: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> DataFrame:
    """One column ``record``: the text of each planned row's WARC record, less its closing blank lines."""
    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
                    F.col("payload_length").cast("string"), F.lit(_EOL * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce(F.col(payload_col), F.lit(""))))
    urn = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col(id_col))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_length").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")))
    return planned.select(F.concat(head, F.lit(_EOL), block).alias("record"))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_revisit: int = MIN_REVISIT, date: str = DATE, records_per_file: int = RECORDS_PER_FILE,
               compression: str = "none") -> None:
    """Write ``pages`` as WARC files under ``path`` (any store Spark writes to).

    ``compression="gzip"`` takes a third of the space; the reader then inflates
    past the payloads nobody wants, where it seeks over them otherwise."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    render(plan_records(slim, min_revisit=min_revisit), date=date).write.option("lineSep", _EOL * 2).option(
        "maxRecordsPerFile", records_per_file).text(path, compression=compression)


# --- reading ------------------------------------------------------------------

class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Stream:
    """Sequential reads with a buffer; ``skip`` seeks when it leaves the buffer."""

    def __init__(self, raw, can_seek: bool):
        self.raw, self.can_seek, self.buffer, self.at, self.base = raw, can_seek, b"", 0, 0

    def more(self, n: int) -> bool:
        got = self.raw.read(max(n, 1 << 16))
        if not got:
            return False
        self.base += self.at
        self.buffer, self.at = self.buffer[self.at:] + got, 0
        return True

    def tell(self) -> int:
        return self.base + self.at

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        look = 0
        while (k := self.buffer.find(mark, self.at + look)) < 0:
            look = max(0, len(self.buffer) - self.at - len(mark))
            if not self.more(0):
                if self.buffer[self.at:].strip():
                    raise ValueError(f"a record breaks off at {self.tell()}")
                return None
        out = self.buffer[self.at:k + len(mark)]
        self.at = k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self.more(n - (len(self.buffer) - self.at)):
                raise ValueError(f"a record breaks off at {self.tell()}")
        out = self.buffer[self.at:self.at + n]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
            return
        if not self.can_seek:
            while n > 0:
                part = min(n, 1 << 20)
                self.take(part)
                n -= part
            return
        self.base += self.at + n
        self.raw.seek(self.base)
        self.buffer, self.at = b"", 0


def _digest(value: str) -> str:
    """Bare lower-case hex, from hex or base32, with or without the algorithm."""
    bare = value.rpartition(":")[2].strip()
    return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line is left out."""
    lines = raw.decode("utf-8", "replace").split(_EOL)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}


def _header_row(h: dict[str, str]) -> dict:
    row = {c: h.get(f) for c, f in _FIELDS.items()}
    for c in ("payload_length", "content_length"):
        row[c] = None if row[c] is None else int(row[c])
    for c in ("record_id", "refers_to"):
        row[c] = None if row[c] is None else row[c].strip("<>")
    row["payload_digest"] = None if row["payload_digest"] is None else _digest(row["payload_digest"])
    return row


_ORDER = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
          LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b,
          StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a}


def _holds(f: Filter, row: dict) -> bool | None:
    """SQL's three values of a filter on a header row."""
    if isinstance(f, Not):
        inner = _holds(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    return None if value is None else _ORDER[type(f)](value, f.value)


def _on_headers(f: Filter) -> bool:
    if isinstance(f, Not):
        return _on_headers(f.child)
    known = isinstance(f, (IsNull, IsNotNull, EqualNullSafe, *_ORDER))
    return known and len(f.attribute) == 1 and f.attribute[0] in _FIELDS


def records(stream: _Stream, filters=(), payload: bool = True, name: str = "") -> Iterator[dict]:
    """Rows of one open archive."""
    while True:
        offset = stream.tell()
        raw = stream.until(b"\r\n\r\n")
        if raw is None:
            return
        h = parse_headers(raw.lstrip(b"\r\n"))
        row = _header_row(h)
        size = row["content_length"]
        if size is None:
            raise ValueError(f"{name}: no Content-Length at {offset}")
        wanted = all(_holds(f, row) for f in filters)
        if wanted and payload and row["type"] != "revisit":
            block = stream.take(size)
            if (row["content_type"] or "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            row["payload"] = block
        else:
            stream.skip(size)
            row["payload"] = None
        stream.skip(4)
        if wanted:
            yield row | {"file": name, "offset": offset}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.bytes = int(options.get("partitionBytes", 32 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _on_headers(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        one = store.get_file_info(root)
        found = [one] if one.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((x for x in found if x.is_file and x.base_name[0] not in "._" and x.size), key=lambda x: x.path)
        parts, size = [], 0
        for x in found:
            if not parts or size + x.size > self.bytes:
                parts.append(_Files([]))
                size = 0
            parts[-1].files.append(x.path)
            size += x.size
        return parts or [_Files([])]

    def read(self, partition):
        from pyarrow import fs
        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        schema = pa.schema([(c, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string()))
                            for c, t in (x.split() for x in SCHEMA.split(", "))])
        rows, size = [], 0
        for path in partition.files:
            with store.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                stream = _Stream(_Gunzip(raw) if packed else raw, not packed)
                for row in records(stream, self.filters, self.payload, path):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class _Gunzip(io.RawIOBase):
    """All members of a gzip file, one after the other."""

    def __init__(self, raw):
        self.raw, self.engine, self.rest = raw, zlib.decompressobj(31), b""

    def read(self, n=-1):
        out = b""
        while not out:
            data = self.rest or self.raw.read(1 << 16)
            if not data:
                return out
            out = self.engine.decompress(data)
            self.rest = b""
            if self.engine.eof:
                self.rest, self.engine = self.engine.unused_data, zlib.decompressobj(31)
        return out


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: path, payload (false: headers only), partitionBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records under ``path``; filters on header columns are pushed to the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op5_warc(spark, sf_dir):
    path = scratch(spark, "warc")
    write_warc(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    full = read_warc(spark, path).where("type = 'response'").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("type = 'revisit'").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
    return full.union(again)


QUERIES = {"op5_warc": op5_warc}
ORACLE = {"op5_warc": r"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
w as (select payload_digest, max(page_id) as winner from p where payload_bytes >= 1000 group by 1 having count(*) > 1)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when w.winner is not null and p.page_id is distinct from w.winner then 'revisit' else 'response' end as record_type,
       case when p.page_id is distinct from w.winner then w.winner end as refers_to
from p left join w using (payload_digest)
"""}
