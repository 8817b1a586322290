"""WARC archives compressed record by record with a Zstandard dictionary.

An archive is a sequence of Zstandard frames: a skippable frame that holds the dictionary,
then one frame for each record.  The dictionary is trained on a bounded sample of the
records.  Records of a payload that another record has are revisits of it, without a body.

Spark's text writer makes the files, so any file system of the cluster serves and a lost
task leaves no half-written archive.  Its line end is an empty skippable frame, which
readers of the format pass over, and which lets Spark's text reader cut an archive of any
size into records in parallel; the writer sees to it that no record has its bytes.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, written

#: Magic numbers of the format (fixed values): the dictionary's frame and an empty frame.
DICTIONARY_MAGIC = bytes((0x5D, 0x2A, 0x4D, 0x18))
SEPARATOR = bytes((0x50, 0x2A, 0x4D, 0x18, 0, 0, 0, 0))
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary's bytes, the sample's, and the most of one payload in it.
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_EACH = 64 << 10, 4 << 20, 16 << 10
REVISIT_BYTES = 1000
#: Of archives; Spark's reader would decompress files that end in .zst or .zstd by itself, without the dictionary.
SUFFIX = ".zst.warc"
LEVEL = 3
#: Repeated payloads up to which their table is broadcast (about 10 MB), and the parts into
#: which a payload's rows are dealt beyond that.
BROADCAST_ROWS, SALTS = 100_000, 16
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
_SAFE = "!#$%&'()*+,/:;=?@[]~"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary from the samples, without the separator; too few or too short
    samples for training serve as they are, as raw content."""
    import zstandard

    samples = [s for x in samples if (s := x.replace(SEPARATOR, b" "))]
    try:
        made = zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        made = SEPARATOR
    return b" ".join(samples)[-size:] if SEPARATOR in made else made


def sample_records(pages: DataFrame, date: str, size: int = SAMPLE_BYTES) -> list[bytes]:
    """Records of about ``size`` bytes in all, chosen by hash, with at most ``SAMPLE_EACH`` bytes
    of a payload (a dictionary learns from these alone; archives hold every payload whole)."""
    some = F.least(F.octet_length("payload"), F.lit(SAMPLE_EACH)) + 400  # and its header lines
    total = pages.agg(F.sum(some)).first()[0] or 0
    place = F.shiftrightunsigned(F.xxhash64("payload"), 11).cast("double") / float(1 << 53)
    picked = pages.filter(place < min(1.0, size / max(1, total))).select("page_id", "url", F.substring("payload", 1, SAMPLE_EACH).alias("payload"))
    # equal payloads have one hash: one of each is enough
    one = picked.groupBy("payload").agg(F.min(F.struct("page_id", "url")).alias("of"))
    return sorted(page_record(r["of"]["page_id"], r["of"]["url"], bytes(r["payload"]), None, False, date) for r in one.toLocalIterator())


def _dictionary(data: bytes):
    import zstandard

    trained = data[:4] == bytes((0x37, 0xA4, 0x30, 0xEC))
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class Packer:
    """Compresses records one by one to frames that do not hold the separator."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        import zstandard

        held = {"dict_data": _dictionary(dictionary)} if dictionary else {}
        self.lib, self.held, self.level = zstandard, held, level
        self.one = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **held)

    def __call__(self, record: bytes) -> bytes:
        made = self.one.compress(record)
        if SEPARATOR not in made:
            return made
        # literals may stand as they are in a frame: blocks end inside the separator's copies
        for level in range(self.level, 20):
            work = self.lib.ZstdCompressor(level=level, write_checksum=True, **self.held).compressobj(size=len(record))
            cuts = [m.start() + 4 for m in re.finditer(re.escape(SEPARATOR), record)]
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(record)], strict=True):
                out += [work.compress(record[a:b]), work.flush(self.lib.COMPRESSOBJ_FLUSH_BLOCK)]
            made = b"".join([*out, work.flush()])
            if SEPARATOR not in made:
                return made
        raise ValueError("a record's frames hold the separator at every level")


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record: header lines, block, and the empty lines at its end."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _name(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """The response or revisit record of a page."""
    digest = hashlib.sha1(payload).hexdigest()
    fields = [("WARC-Record-ID", _name(page_id, digest)), ("WARC-Date", date),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:  # what could end a header line is escaped
        fields.insert(1, ("WARC-Target-URI", quote(url, safe=_SAFE)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to, digest))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", fields, head + (b"" if revisit else payload))


def _pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))


def with_revisits(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds refers_to: the largest page_id of the rows with the same payload, null where that
    is the row's own or the payload has fewer than ``least`` bytes.  Payloads are compared by
    SHA-256.  A payload may be that of a third of all rows: its largest id is aggregated
    before it moves, and its rows never meet in one task."""
    key = F.sha2("payload", 256)
    heads = rows.filter(F.octet_length("payload") >= least).select(key.alias("key"), "page_id").groupBy("key").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    heads = written(heads.filter("n > 1 and head is not null").select("key", "head"), "warc-heads")
    keyed = rows.withColumn("key", F.when(F.octet_length("payload") >= least, key))
    if heads.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(heads), "key", "left")
    else:
        heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        # rows without a key, or with one of their own, spread by their salt too
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        joined = salted.withColumn("key", F.coalesce("key", F.xxhash64("page_id", "url").cast("string"))).join(heads, ["key", "salt"], "left")
    own = F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("head")).alias("refers_to"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: datetime.datetime | None = None,
          dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> None:
    """Writes a WARC record for each row into archives (``*.zst.warc``) in the new folder ``path``.

    The payload is the html in UTF-8 (null: empty).  Rows of one page_id and payload are each
    a response if that id is the largest; a null page_id is less than any.  A null url is left
    out of the record.  An empty table writes no archive.  Other columns are not read."""
    spark = pages.sparkSession
    rows = _pages(pages, page_id, url, html)
    when = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    held = spark.sparkContext.broadcast(train_dictionary(sample_records(rows, when), dictionary_bytes))

    def run(batches):
        pack = Packer(held.value, level)
        size = struct.pack("<I", len(held.value))
        # the dictionary leads the archive; what describes it is its first record
        about = record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{hashlib.sha1(held.value).hexdigest()}>"), ("WARC-Date", when),
                                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        out = [DICTIONARY_MAGIC + size + held.value, pack(about)]
        for batch in batches:
            for part in slices(batch, "payload"):
                for i, u, x, r in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    out.append(pack(page_record(i, u, x, r, r is not None, when)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out = []

    frames = with_revisits(rows).mapInArrow(run, "frame binary")
    # a cast from binary keeps the bytes, whatever they are
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode()).text(path)
    _rename(spark, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Gives the archives that tasks have committed their suffix (one call for each file)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(place):
        name = found.getPath().getName()
        if name.startswith("part-"):
            files.rename(found.getPath(), spark._jvm.org.apache.hadoop.fs.Path(place, name.removesuffix(".txt") + SUFFIX))


def _frames(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("frame"))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (names in lower case; ``type`` is WARC-Type) and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest (SHA-1 in hex), payload_bytes, and
    with ``payload`` the body (null for revisits) of every page record in the archives of a
    folder that ``write`` made.  Digest and length of a response's body are checked against
    its header; those of a revisit are of the body that it refers to."""
    frames = _frames(spark, path)
    lead = frames.filter(F.substring("frame", 1, 4) == F.lit(DICTIONARY_MAGIC)).first()
    held = spark.sparkContext.broadcast(bytes(lead["frame"][8:]) if lead else b"")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(**({"dict_data": _dictionary(held.value)} if held.value else {})).decompressobj
        for batch in batches:
            for part in slices(batch, "frame"):
                out = []
                for frame in part.column("frame").to_pylist():
                    if frame[:4] == DICTIONARY_MAGIC:
                        if frame[8:] != held.value:
                            raise ValueError("archives of one folder have one dictionary")
                        continue
                    fields, block = parse(unpack().decompress(frame))
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    whole = fields["warc-type"] == "response"
                    if whole and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"a damaged record: {fields['warc-record-id']}")
                    ids = [fields.get(k, "::").split(":")[2] for k in ("warc-record-id", "warc-refers-to")]
                    one, other = (int(x) if x else None for x in ids)
                    out.append((one, _unquote(fields.get("warc-target-uri")), fields["warc-type"], other, digest, size, body if whole else None)[: len(names)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    schema = RECORDS + ", payload binary" * payload
    names = [c.split()[0] for c in schema.split(", ")]
    return frames.mapInArrow(run, schema)


def _unquote(url: str | None) -> str | None:
    from urllib.parse import unquote

    return None if url is None else unquote(url)


#: DuckDB: digests and largest ids from the table itself.
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT payload, max(page_id) AS head FROM p WHERE strlen(payload) >= {REVISIT_BYTES} GROUP BY payload)
SELECT p.page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN g.head IS NOT NULL AND g.head IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.head IS DISTINCT FROM p.page_id THEN g.head END AS refers_to
FROM p LEFT JOIN g ON g.payload = p.payload
"""
