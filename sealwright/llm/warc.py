"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing is a DataFrame expression: a record is one string, and Spark's text writer ends each with the two line ends that the format asks for.

Reading cuts the archives into blocks. The task of a block looks for every place where the magic stands, in payloads too. Each such
candidate (at a file's start or behind two line ends) whose header parses and whose block is ended by two line ends gives an edge to its successor, the offset behind it. Inside a block the
edges are followed at once, so a candidate is left with its leap: the first offset of its chain that lies outside the block.
Pointer jumping over the leaps from the start of every file then finds the offsets at which the true chain enters the blocks, in as many rounds as
the logarithm of the blocks of the largest file. Only records on that chain are read, from those offsets on: what looks like
a record inside a payload is a candidate that no chain from a file's start reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.blocks import listed, opened
from .common import materialize, read, shared_dir

MAGIC = b"WARC/1."
END = b"\r\n\r\n"
BLOCK = 8 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
DATE = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*(?:\r\n|\Z)", re.I)

RECORD = "file string, offset long, length long, record_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, payload_bytes long, payload_digest string, digest_matches boolean, payload binary"


# --- writing --------------------------------------------------------------------------------------------------


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Line ends in a value are percent-encoded: they would end the line."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def record_text(record_id: Column, record_type: Column, payload: Column, digest: Column, target_uri: Column, refers_to: Column, date: Column) -> Column:
    """The text of one record without its two closing line ends. A revisit has the head of the HTTP response, but no payload."""
    payload = F.coalesce(payload, F.lit(""))
    revisit = record_type == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block_bytes = F.octet_length(head) + F.when(revisit, 0).otherwise(F.octet_length(payload))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", record_type),
        _field("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))),
        _field("WARC-Date", date),
        _field("WARC-Target-URI", target_uri),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _field("WARC-Refers-To", F.concat(F.lit("<"), refers_to, F.lit(">"))),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("Content-Type", F.lit(HTTP)),
        F.lit("Content-Length: "),
        block_bytes.cast("string"),
        F.lit("\r\n\r\n"),
        head,
        F.when(revisit, "").otherwise(payload),
    )


def deduplicated(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """(row, payload, payload_bytes, digest, record_type, keeper) for each row; `row` holds all its columns.

    Of rows with equal payloads of at least `least` bytes that with the largest id is the response (rows that repeat that id too, and
    all of a payload that has only null ids); the others revisit `keeper`. Only payloads that occur more than once are joined, and
    that table is written first: Spark broadcasts it if it is small, else joins on the digest and splits a payload of many rows.
    """
    text = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long")
    strong = F.sha2(text, 256)
    several = pages.where(size >= least).groupBy(strong.alias("key_")).agg(F.max(F.col(f"`{id_col}`")).alias("keeper"), F.count("*").alias("n_")).where("n_ > 1").select("key_", "keeper")
    several = materialize(several, "warc-payloads")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{id_col}`").alias("id_"), text.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # small payloads match nothing; a key of their own keeps them from meeting in one task
    rows = rows.withColumn("key_", F.when(F.col("payload_bytes") >= least, F.sha2("payload", 256)).otherwise(F.concat(F.lit("id:"), F.coalesce(F.col("id_").cast("string"), F.lit("")))))
    out = rows.join(several, "key_", "left")
    revisit = F.coalesce(F.col("keeper") != F.col("id_"), F.col("keeper").isNotNull())
    return out.select("row", "payload", "payload_bytes", F.sha1("payload").alias("digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("keeper"))


def write_archives(records: DataFrame, path: str) -> str:
    """Write `records` (record_id, record_type, payload, digest, target_uri, refers_to, date) to a new folder: one archive for each task.

    Nothing is shuffled; a lost executor costs its own files, which Spark's commit replaces.
    """
    names = ("record_id", "record_type", "payload", "digest", "target_uri", "refers_to", "date")
    records.select(record_text(*[F.col(c) for c in names]).alias("value")).write.option("lineSep", END.decode()).text(path)
    return path


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> str:
    """One record for each row of `pages`, with repeated payloads as revisits. A null payload is empty, a null url has no line; other columns are not written."""
    rows = deduplicated(pages, id_col, payload_col, least)
    own = F.col("row").getField(id_col)
    refers = F.when(F.col("record_type") == "revisit", page_urn(F.col("keeper")))
    return write_archives(rows.select(page_urn(own).alias("record_id"), "record_type", "payload", "digest", F.col("row").getField(url_col).alias("target_uri"), refers.alias("refers_to"), F.lit(DATE).alias("date")), path)


# --- reading --------------------------------------------------------------------------------------------------


class Window:
    """Random access to one archive with one buffer around the place last read."""

    def __init__(self, root: str, path: str, size: int, start: int, length: int):
        self.file, self.size = opened(root, path), size
        self.at, self.data = start, self._read(start, length)

    def _read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(length, self.size - start)))

    def bytes(self, start: int, length: int) -> bytes:
        end = min(start + length, self.size)
        if self.at <= start and end <= self.at + len(self.data):
            return self.data[start - self.at : end - self.at]
        return self._read(start, length)

    def header(self, start: int) -> bytes | None:
        """From `start` to the first empty line, without it; null where there is none."""
        if self.at <= start < self.at + len(self.data):
            end = self.data.find(END, start - self.at)
            if end >= 0:
                return self.data[start - self.at : end]
        seen, step = b"", 1 << 14
        while start + len(seen) < self.size:
            more = self._read(start + len(seen), step)
            end = (seen + more).find(END, max(0, len(seen) - 3))
            seen += more
            if end >= 0:
                return seen[:end]
            step *= 4
        return None

    def record(self, start: int) -> tuple[bytes, int, int] | None:
        """(header, first byte of the block, successor) of the record at `start`, if one stands there."""
        if self.bytes(start, len(MAGIC)) != MAGIC:
            return None
        head = self.header(start)
        found = _LENGTH.search(head) if head else None
        if not found or b"\r\n" not in head:
            return None
        body = start + len(head) + len(END)
        end = body + int(found[1])
        if end + len(END) > self.size or self.bytes(end, len(END)) != END:
            return None
        return head, body, end + len(END)

    def __enter__(self) -> Window:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _archives(spark: SparkSession, root: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(file, path, size) of the archives, and the number of their blocks. Hidden files and those that Spark marks with _ are left out."""
    found = [(p, n) for p, n in listed(root) if n and not re.search(r"(^|/)[._]", p)]
    rows = [(i, p, n) for i, (p, n) in enumerate(found)]
    return spark.createDataFrame(rows, "file long, path string, size long"), sum(-(-n // block_bytes) for _, n in found)


def candidates(spark: SparkSession, root: str, block_bytes: int = BLOCK) -> DataFrame:
    """(file, path, size, offset, successor, leap) of every place where a whole record could stand."""
    files, n = _archives(spark, root, block_bytes)
    blocks = files.select("file", "path", "size", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("long"), F.lit(block_bytes).cast("long"))).alias("start"))
    blocks = blocks.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism + n // 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, path, size, start in zip(*[c.to_pylist() for c in b.columns]):
                end, before = min(start + block_bytes, size), min(start, len(END))
                with Window(root, path, size, start - before, before + block_bytes + len(MAGIC) - 1) as w:
                    nexts, at = {}, w.data.find(MAGIC, before)
                    while at >= 0:
                        # only behind an empty line: headers of candidates do not overlap, so the search stays linear
                        if (w.at + at == 0 or w.data[at - len(END) : at] == END) and (found := w.record(w.at + at)):
                            nexts[w.at + at] = found[2]
                        at = w.data.find(MAGIC, at + 1)
                leaps: dict[int, int] = {}
                for o in sorted(nexts, reverse=True):
                    leaps[o] = leaps.get(nexts[o], nexts[o]) if nexts[o] < end else nexts[o]
                o = sorted(nexts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(o), pa.int64()), pa.array([path] * len(o), pa.string()), pa.array([size] * len(o), pa.int64())] + [pa.array(x, pa.int64()) for x in (o, [nexts[x] for x in o], [leaps[x] for x in o])],
                    ["file", "path", "size", "offset", "successor", "leap"],
                )

    return blocks.mapInArrow(run, "file long, path string, size long, offset long, successor long, leap long")


def entries(found: DataFrame) -> DataFrame:
    """(file, path, size, offset, leap): where the chain from each file's start enters a block. `found` are materialised candidates.

    Only candidates that are the leap of another, or a start, can be entries; the rounds run over those alone.
    """
    landed = found.select("file", F.col("leap").alias("offset")).union(found.select("file", F.lit(0).cast("long"))).distinct()
    edges = materialize(found.join(landed, ["file", "offset"], "left_semi").select("file", "offset", "leap"), "warc-edges")
    reached, jump = edges.where("offset = 0").select("file", "offset"), edges
    while True:
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("leap").alias("offset"))
        ahead = materialize(ahead.join(edges.select("file", "offset"), ["file", "offset"], "left_semi"), "warc-ahead")
        if not ahead.limit(1).count():
            break
        reached = materialize(reached.union(ahead).distinct(), "warc-reached")
        jump = materialize(jump.join(jump.select("file", F.col("offset").alias("leap"), F.col("leap").alias("next")), ["file", "leap"]).select("file", "offset", F.col("next").alias("leap")), "warc-jump")
    return found.join(reached, ["file", "offset"], "left_semi").select("file", "path", "size", "offset", "leap")


def broken(spark: SparkSession, root: str, block_bytes: int = BLOCK) -> DataFrame:
    """(path, offset, size) of archives whose chain stops before their end: no whole record stands at `offset`."""
    reached = entries(materialize(candidates(spark, root, block_bytes), "warc-candidates"))
    last = reached.groupBy("file").agg(F.max("leap").alias("offset"))
    files = _archives(spark, root, block_bytes)[0]
    return files.join(last, "file", "left").select("path", F.coalesce("offset", F.lit(0)).alias("offset"), "size").where("offset < size")


def _hex(digest: bytes) -> str | None:
    """A SHA-1 digest as the header names it, in hexadecimal or base 32, as lower-case hexadecimal."""
    kind, _, value = digest.strip().partition(b":")
    if kind.lower() != b"sha1":
        return None
    try:
        return value.decode().lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def _parsed(w: Window, start: int, head: bytes, body: int, end: int, payload: bool) -> dict:
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    kind, block = fields.get("warc-type"), w.bytes(body, end - len(END) - body)
    content, size = block, len(block)
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, sep, content = block.partition(END)
        size = len(content)
        if kind == "revisit" and (told := _LENGTH.search(http)):
            size = int(told[1])
    named = _hex(fields.get("warc-payload-digest", "").encode())
    own = None if kind == "revisit" else hashlib.sha1(content).hexdigest()
    strip = lambda x: x[1:-1] if x and x[:1] == "<" and x[-1:] == ">" else x
    return {
        "offset": start,
        "length": end - start,
        "record_type": kind,
        "record_id": strip(fields.get("warc-record-id")),
        "refers_to": strip(fields.get("warc-refers-to")),
        "target_uri": fields.get("warc-target-uri"),
        "headers": list(fields.items()),
        "payload_bytes": size,
        "payload_digest": own or named,
        "digest_matches": None if own is None or named is None else own == named,
        "payload": content if payload and kind != "revisit" else None,
    }


def read_archives(spark: SparkSession, root: str, block_bytes: int = BLOCK, payload: bool = True) -> DataFrame:
    """One row for each record of the archives below `root` (uncompressed), columns as in RECORD.

    payload_bytes and payload_digest are those of the whole payload; for a revisit they come from its HTTP head and its header. Header
    names are lower-case. Where a chain breaks, the records before the break are given (see `broken`). No archives, or empty
    ones, give no rows. Without `payload` that column is null and payloads stay in the tasks that hash them.
    """
    found = materialize(candidates(spark, root, block_bytes), "warc-candidates")
    reached = materialize(entries(found), "warc-entries")
    n = reached.count()
    kinds = pa.schema(
        [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string())]
        + [("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_matches", pa.bool_()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*[c.to_pylist() for c in b.columns]):
                end, out, held = min((start // block_bytes + 1) * block_bytes, size), [], 0
                with Window(root, path, size, start, end - start) as w:
                    while start < end and (one := w.record(start)):
                        out.append({"file": path} | _parsed(w, start, *one, payload))
                        held += len(out[-1]["payload"] or b"") + 1000
                        start = one[2]
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    dealt = reached.select("path", "size", "offset").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism + n // 16)))
    return dealt.mapInArrow(run, RECORD)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = write_pages(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    number = lambda urn: F.regexp_extract(urn, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return read_archives(spark, root, payload=False).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
g AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
