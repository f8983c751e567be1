"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about `frame_bytes`; a skippable frame at the end holds the seek table (the
public seekable format), and an index beside each bundle maps record ids to a frame and an offset within it. A reader
fetches the footer, then the one frame that holds a record. Equal payloads of at least `least` bytes are stored once: the
record with the largest page_id is the response, others revisit it.

Each bundle starts with a record that describes it. A record id is the page's id, the bundle's and a number, so repeated
rows of a page have ids of their own; a revisit names the page that it refers to.

Cases: null html is an empty payload, a null url an empty target; a payload of any length is one record, and a frame of its
own where it is longer than a frame; a null page_id never is the response while another page has the payload; of equal
payloads the largest page_id decides, and repeated rows of it are responses each; an empty table gives no bundles and an
empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, filesystem, materialize, shared_path

#: Fixed values of the seekable format: magic of the skippable frame and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Copies of a row of shared payload digests, so that pages with a hot digest spread over as many tasks.
SALTS = 64


def classify(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html (binary), bytes, digest, record_type and refers_to of every page.

    Digests are counted with map-side combining; only those of several pages come back, each spread over SALTS keys."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    facts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("html"))
    facts = facts.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    several = facts.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("response"),
        F.count("*").alias("n")).where("n > 1 and response is not null")
    several = materialize(several.select("digest", "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "digests")
    salted = facts.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(several, ["digest", "salt"], "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "html", "bytes", "digest",
        F.when(refers.isNotNull(), "revisit").otherwise("response").alias("record_type"), refers.alias("refers_to"))


def page_name(page_id) -> str:
    """What a record id starts with, and what a revisit refers to."""
    return f"urn:page:{'none' if page_id is None else page_id}"


def described(bundle: str) -> bytes:
    """The record that starts a bundle."""
    block = b"software: seekable Zstandard bundles\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:bundle:{bundle}>"), ("WARC-Date", DATE),
        ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(name: str, url: str, html: bytes, n: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + html
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields[4:4] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{page_name(refers_to)}>")]
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """(fields, HTTP head, payload, end) of the record at an offset."""
    data = bytes(data) if isinstance(data, memoryview) else data
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no record at offset {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    block = data[start:stop]
    cut = block.index(b"\r\n\r\n") + 4 if fields["WARC-Type"] != "warcinfo" else 0
    return fields, block[:cut], block[cut:], stop + 4


class BundleWriter:
    """Writes frames as they fill up, then the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int = 3):
        import zstandard

        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.compressor, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.held: list[bytes] = []
        self.n_held = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """Append a record; its frame and its offset in the frame's content."""
        place = len(self.frames), self.n_held
        self.held.append(data)
        self.n_held += len(data)
        if self.n_held >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.n_held))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", a, b) for a, b in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads the footer, then any frame."""

    def __init__(self, uri: str):
        import zstandard

        self.fs, self.path = filesystem(uri)
        self.file, self.decompressor = self.fs.open_input_file(self.path), zstandard.ZstdDecompressor()
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != FOOTER:
            raise ValueError(f"{uri} has no seek table")
        each = 12 if flags & 128 else 8
        self.file.seek(size - 9 - each * n)
        table = self.file.read(each * n)
        self.sizes = [struct.unpack_from("<II", table, each * i) for i in range(n)]
        self.starts = [0]
        for a, _ in self.sizes:
            self.starts.append(self.starts[-1] + a)

    def frame(self, k: int) -> bytes:
        """The content of the k-th frame."""
        self.file.seek(self.starts[k])
        return self.decompressor.decompress(self.file.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])

    def record(self, k: int, offset: int):
        """The record at an offset in a frame."""
        return parse(self.frame(k), offset)


INDEX = "page_id long, record_id string, bundle string, frame int, offset long"


def write(classified: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 20) -> DataFrame:
    """Write a bundle for each partition; the index has a row for each record. A repeated or lost task writes under
    another name, and only bundles named in the index count."""
    spark = configure(classified.sparkSession)
    folder = folder or shared_path(spark, "warc")

    def bundle(batches) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        own = uuid.uuid4().hex
        uri, writer = f"{folder}/bundle-{TaskContext.get().partitionId():06d}-{own}.warc.zst", None
        n = 0
        for batch in batches:
            places = []
            for page_id, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if writer is None:
                    writer = BundleWriter(uri, frame_bytes)
                    writer.add(described(own))
                name = f"{page_name(page_id)}:{own}:{n}"
                places.append((page_id, name, uri, *writer.add(record(name, *row))))
                n += 1
            if places:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*places), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        if writer:
            writer.close()

    plain = classified.select("page_id", "url", "html", "bytes", "digest", "record_type", "refers_to")
    return materialize(plain.mapInArrow(bundle, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Every record from the bundles: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.
    Frames are dealt out to tasks; digests of stored payloads are computed anew and held against the record's."""
    frames = materialize(index.groupBy("bundle", "frame").agg(F.count("*").cast("int").alias("records")), "frames")
    n = max(1, frames.count())
    n = min(n, max(1000, n // 16))  # stated, as adaptive execution would merge tasks for their small input
    frames = frames.repartitionByRange(n, "bundle", "frame")

    def records(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        number = lambda x: None if x.strip("<>").split(":")[2] == "none" else int(x.strip("<>").split(":")[2])
        readers: dict[str, BundleReader] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] not in readers:
                    readers = {row["bundle"]: BundleReader(row["bundle"])}
                data, at, out = readers[row["bundle"]].frame(row["frame"]), 0, []
                while at < len(data):
                    fields, head, payload, at = parse(data, at)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)["Content-Length"])
                    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (n, stated):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    ref = fields.get("WARC-Refers-To")
                    out.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"],
                        payload if fields["WARC-Type"] == "response" else None, n, stated, fields["WARC-Type"],
                        number(ref) if ref else None))
                if len(out) != row["records"]:
                    raise ValueError(f"frame {row['frame']} of {row['bundle']} has {len(out)} records, not {row['records']}")
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.mapInArrow(records, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
