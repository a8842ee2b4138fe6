"""Web archives packaged in ZIP files: stored members, an index, and range reads of single records.

An archive holds stored (uncompressed) members archive/*.warc.gz, WARC records each its own gzip
member, and an index, a line per record with the member's name and the byte range within it. The
writer makes data members of about MEMBER_BYTES and one sorted indexes/index.cdxj. The reader takes any
number of data members and of indexes (.cdxj, .cdx with its line of field letters, either also
packed as .gz; lines that begin with ! are skipped). It never extracts: it fetches the file's tail,
follows the end record (or the ZIP64 locator and end record) to the central directory, takes offsets
and sizes from it and from ZIP64 extra fields and skips the local header. One pass over the archives
reads the indexes and gives byte ranges of about READ_BYTES; these are dealt over all tasks and read.

Of records by other writers the page_id is null; payload_bytes of a revisit without a length in its
heads is null; a payload sent in chunks or packed is given as it was stored and its digest not
checked; a block that is no HTTP message is the payload. An index entry whose member is missing or
isn't stored raises, as does an archive without an index.

Records of equal payload are stored once. Of the rows whose payloads are equal and have at least
min_revisit_bytes bytes, the one with the largest page_id is a response and the others are revisit
records that name it and repeat the HTTP head, with the payload's length and digest. Smaller
payloads are always responses.

Edge cases: null html is the empty payload; a null or line-broken url is written as an escaped
urn; a row whose page_id is null can only be a response when no equal payload has an id, else it
revisits; repeated rows of the largest page_id are all responses; an empty table gives no archive
and no rows. Other columns are not looked at.

Archives go to a folder that all executors reach, under names that are never used twice; the
manifest names those of tasks that succeeded, so repeated tasks leave unread files only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialize, scratch_path

DATA, INDEX = "archive/data-{:05d}.warc.gz", "indexes/index.cdxj"
INDEXES = (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")
ARCHIVE_BYTES = 64 << 20
MEMBER_BYTES = 16 << 20
READ_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
ALL32, ALL16 = 0xFFFFFFFF, 0xFFFF
UNKNOWN_ID = "none"


class ZipWriter:
    """Stored members onto a stream that can't seek: sizes follow the data and stand in ZIP64 fields."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.entries.append([raw, self.at, 0, 0])
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, ALL32, ALL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, raw: bytes) -> None:
        e = self.entries[-1]
        e[2], e[3] = zlib.crc32(raw, e[2]), e[3] + len(raw)
        self._put(raw)

    def end(self) -> None:
        _, _, crc, size = self.entries[-1]
        self._put(struct.pack("<IIQQ", DESCRIPTOR, crc, size, size))

    def close(self) -> int:
        start = self.at
        for raw, at, crc, size in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, ALL32, ALL32, len(raw), len(extra), 0, 0, 0, 0, ALL32) + raw + extra)
        length, n, here = self.at - start, len(self.entries), self.at
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, here, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, ALL16, ALL16, ALL32, ALL32, 0))
        return self.at


class ZipReader:
    """Members of a ZIP file by range reads of `file` (seek, read)."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        tail_at = max(0, size - (1 << 16) - 22 - 20)
        tail = self.read(tail_at, size - tail_at)
        at = len(tail) - 22
        while at >= 0:
            at = tail.rfind(struct.pack("<I", END), 0, at + 4)
            if at < 0 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
            at -= 1
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        n, _, length, start = struct.unpack_from("<HHII", tail, at + 8)[0:1] + (0,) + struct.unpack_from("<II", tail, at + 12)
        if n == ALL16 or length == ALL32 or start == ALL32:
            sign, _, where, _ = struct.unpack("<IIQI", self.read(tail_at + at - 20, 20))
            if sign != LOCATOR64:
                raise ValueError("no ZIP64 locator before an end record that needs one")
            sign, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", self.read(where, 56))
            if sign != END64:
                raise ValueError("no ZIP64 end record where its locator points")
        self.members = dict(self._central(self.read(start, length), n))

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError(f"the file ends within bytes {at} to {at + length}")
        return out

    @staticmethod
    def _central(raw: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int, int]]]:
        at = 0
        for _ in range(n):
            sign, _, _, flags, method, _, _, _, packed, size, names, extras, notes, _, _, _, start = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
            if sign != CENTRAL:
                raise ValueError("the central directory is damaged")
            name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            e, end = at + 46 + names, at + 46 + names + extras
            while e + 4 <= end:
                kind, length = struct.unpack_from("<HH", raw, e)
                if kind == 1:
                    e2 = e + 4
                    fields = []
                    for value in (size, packed, start):
                        if value == ALL32:
                            value, e2 = struct.unpack_from("<Q", raw, e2)[0], e2 + 8
                        fields.append(value)
                    size, packed, start = fields
                e += 4 + length
            yield name, (start, packed, size, method)
            at = end + notes

    def stored(self, name: str) -> tuple[int, int]:
        """First byte and size of a stored member's data."""
        start, packed, size, method = self.members[name]
        if method or packed != size:
            raise ValueError(f"{name} isn't stored; only stored members can be read by range")
        head = self.read(start, 30)
        sign, names, extras = struct.unpack_from("<I", head)[0], *struct.unpack_from("<HH", head, 26)
        if sign != LOCAL:
            raise ValueError(f"no local header of {name}")
        return start + 30 + names + extras, size


    def whole(self, name: str) -> bytes:
        """A member's data, unpacked if the archive packs it."""
        start, packed, _, method = self.members[name]
        if not method:
            return self.read(*self.stored(name))
        if method != 8:
            raise ValueError(f"{name} is packed by method {method}")
        names, extras = struct.unpack_from("<HH", self.read(start, 30), 26)
        return zlib.decompress(self.read(start + 30 + names + extras, packed), -15)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:page:{UNKNOWN_ID if page_id is None else page_id}>"


def _page_id(record_id: str):
    x = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.removeprefix("-").isdecimal() else None


def _target(page_id, url: str | None) -> str:
    return f"urn:page:{page_id}" if not url else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def sort_key(url: str) -> str:
    """A URL with its host's names in reverse order, as indexes sort them; others as they are."""
    try:
        host = urlsplit(url).hostname
    except ValueError:
        host = None
    return f"{','.join(reversed(host.split('.')))}){urlsplit(url).path or '/'}".replace(" ", "%20") if host else url


def index_line(url: str, digest: str, revisit: bool, filename: str, offset: int, length: int) -> str:
    about = {"url": url, "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(length), "offset": str(offset), "filename": filename}
    return f"{sort_key(url)} {''.join(c for c in DATE if c.isdecimal())} {json.dumps(about)}\n"


def parse_index(text: str) -> Iterator[tuple[str, int, int]]:
    """File name, offset and length of every line of a CDXJ or CDX index."""
    letters = None
    for line in text.split("\n"):
        if not line.strip() or line.startswith("!"):
            continue
        words = line.split()
        if words[0] == "CDX":
            letters = words[1:]
        elif letters:
            about = dict(zip(letters, words))
            yield about["g"], int(about["V"]), int(about["S"])
        else:
            about = json.loads(line[line.index("{") :])
            yield about["filename"], int(about["offset"]), int(about["length"])


def locate(archive: ZipReader) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Position in the archive of each data member that the indexes name, and its records' ranges in order, each once."""
    indexes = [n for n in sorted(archive.members) if n.startswith("indexes/") and n.endswith(INDEXES)]
    if not indexes:
        raise ValueError("the archive holds no index of its records")
    found: dict[str, set[tuple[int, int]]] = {}
    for name in indexes:
        raw = archive.whole(name)
        for filename, offset, length in parse_index((gzip.decompress(raw) if name.endswith(".gz") else raw).decode("utf-8", "replace")):
            found.setdefault(filename, set()).add((offset, length))
    for filename, ranges in sorted(found.items()):
        member = next((n for n in (f"archive/{filename}", filename) if n in archive.members), None)
        if member is None:
            raise ValueError(f"the index names {filename}, which isn't in the archive")
        yield archive.stored(member)[0], sorted(ranges)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A WARC record; of a revisit the payload is left out but its length and digest stand in the heads."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = _target(page_id, url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC heads, HTTP heads (names in lower case) and the payload that follows them."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    if not warc.get("content-type", "application/http").startswith("application/http"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("latin-1").split("\r\n")[1:]), payload


def with_winners(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, revisit and refers_to of every row.

    A payload's group is reduced to its largest id over ids and digests alone; payloads then meet their answer on
    digest and id together, so rows of a very frequent payload don't gather in one task (and don't move if the answers fit a broadcast).
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    ids = keyed.select("digest", "page_id").distinct()
    winners = ids.groupBy("digest").agg(F.max("page_id").alias("winner"))
    marks = ids.join(winners, "digest").select(F.col("digest").alias("d"), F.col("page_id").alias("i"), "winner")
    again = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")) & (F.length("payload") >= min_revisit_bytes)
    met = keyed.join(marks, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("i")))
    return met.select("page_id", "url", "payload", "digest", again.alias("revisit"), F.when(again, F.col("winner")).alias("refers_to"))


_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes archives of about ARCHIVE_BYTES into folder and returns their manifest: path, bytes, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        zipped, lines, done, member = None, [], [], 0

        def close():
            zipped.end()
            zipped.begin(INDEX)
            zipped.write("".join(sorted(lines)).encode())
            zipped.end()
            size = zipped.close()
            zipped.out.close()
            done.append((path, size, len(lines)))

        for batch in batches:
            for page_id, url, payload, digest, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if zipped is None:
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    zipped, lines = ZipWriter(store.open_output_stream(path)), []
                    member = 0
                elif zipped.at - first >= MEMBER_BYTES:
                    zipped.end()
                    member += 1
                if not lines or name != DATA.format(member):
                    name = DATA.format(member)
                    zipped.begin(name)
                    first = zipped.at
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                raw = gz.compress(record(page_id, url, payload, refers_to, revisit)) + gz.flush()
                lines.append(index_line(_target(page_id, url), base64.b32encode(digest).decode(), revisit, name.removeprefix("archive/"), zipped.at - first, len(raw)))
                zipped.write(raw)
                if zipped.at >= ARCHIVE_BYTES:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=_MANIFEST.names)

    return materialize(with_winners(pages, min_revisit_bytes).mapInArrow(run, _MANIFEST), "warc-manifest")


READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()),
])


_RANGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType()))])


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record that the indexes of the manifest's archives name, by range reads; a response's digest is taken from its payload and must be the one in its head."""
    tasks = manifest.sparkSession.sparkContext.defaultParallelism

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    for first, ranges in locate(ZipReader(file, file.size())):
                        groups = list(_near(ranges))
                        lists = [pa.array([[r[k] for r in g] for g in groups], pa.list_(pa.int64())) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(groups)), pa.array([first] * len(groups), pa.int64()), *lists], names=_RANGES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                base = part["starts"][0]
                with store.open_input_file(part["path"]) as file:
                    file.seek(part["first"] + base)
                    raw = file.read(part["starts"][-1] + part["lengths"][-1] - base)
                rows = [_row(raw[a - base : a - base + n], with_payload) for a, n in zip(part["starts"], part["lengths"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(t)) for c, t in zip(zip(*rows), ("int64", "int64", "string", "string", "int64", "string", "binary"))], names=READ.names)

    return manifest.select("path").repartition(tasks).mapInArrow(find, _RANGES).repartition(tasks).mapInArrow(run, READ)


def _near(ranges: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    group: list[tuple[int, int]] = []
    for a, n in ranges:
        if group and a + n - group[0][0] > READ_BYTES:
            yield group
            group = []
        group.append((a, n))
    if group:
        yield group


def _row(raw: bytes, with_payload: bool) -> tuple:
    warc, http, payload = parse_record(zlib.decompress(raw, 31))
    kind, said = warc["warc-type"], warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        size, digest = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None, said
    else:
        size, digest = len(payload), base32_sha1(payload)
        if said not in (None, digest) and ":" not in said and not {"transfer-encoding", "content-encoding"} & http.keys():
            raise ValueError(f"the payload of {warc['warc-record-id']} doesn't have its digest")
    refers = _page_id(warc.get("warc-refers-to", UNKNOWN_ID)) if kind == "revisit" else None
    return _page_id(warc["warc-record-id"]), size, digest, kind, refers, warc.get("warc-target-uri"), payload if with_payload else None


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_revisit_bytes), folder, with_payload=False)
