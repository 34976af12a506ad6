"""WARC files as a PySpark Python data source: record-per-member gzip, planned and read by file.

Reading: files are listed once and packed into partitions by size; filters on record type,
target and other header columns are pushed down; each record's headers are parsed first, and a
record that they rule out is skipped without inflating its block, since the writer notes each
member's compressed length in a gzip extra field.  Members without that field (of other
writers) are inflated and dropped.  The payload is decoded only if its column is asked for.

Writing: each task writes files that roll over at a size, under names that no other attempt
has, in a pending folder; the driver's commit moves the finished ones into place and leaves a mark
last.  Files of a job without its mark are not read, so neither a lost attempt nor a driver lost
half-way leaves anything behind that a reader sees.
"""

import base64
import hashlib
import re
import struct
import zlib

from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                    WriterCommitMessage)

from ..operators.lineage import materialise, remove
from ..operators.lookup import lookup
from .rows import named

# --- fixed values: the format's names ---
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length"}
SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
          "payload_bytes bigint, content_length bigint, payload binary")
# --- end of fixed values ---

#: Bytes of a file, and of the files that make one partition.
ROLL, PARTITION = 64 << 20, 32 << 20
#: Left by the driver after all files of a job are in place; files of a job without it are not read.
COMMITTED, OWN_PART = "_committed-", re.compile(r"part-([0-9a-f]{32})-[0-9a-f]{32}\.warc\.gz$")
MARK = b"WL"  # our gzip extra field: the member's compressed length
READ = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(row: dict) -> bytes:
    """One record: header block and, but for revisits, an HTTP response with the payload."""
    kind, payload = row.get("record_type") or "response", row.get("payload")
    block = b""
    if kind != "revisit":
        body = bytes(payload or b"")
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body
    lines = [VERSION]
    for column, name in COLUMNS.items():
        value = row.get(column)
        if column == "record_type":
            value = kind
        if value is not None:
            text = str(value).replace("\r", "%0D").replace("\n", "%0A")
            if column in ("record_id", "refers_to"):
                text = f"<{text}>"
            lines.append(f"{name}: {'sha1:' + text if column == 'payload_digest' else text}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member that tells its own length."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    size = 10 + 2 + 8 + len(body) + 8
    if size >= 1 << 32:
        raise ValueError("a record may compress to 4 GB at most")
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 8) + MARK + struct.pack("<HI", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _qualified(spark, path: str) -> str:
    """The path with its scheme: one without means the session's default file system, as in Spark's own sources."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class WarcWriter(DataSourceWriter):
    def __init__(self, options, schema):
        import uuid

        self.path, self.roll = options["path"], int(options.get("roll", ROLL))
        self.job = uuid.uuid4().hex
        self.pending = f"{self.path.rstrip('/')}/_pending-{self.job}"

    def write(self, iterator):
        import uuid

        system, folder = _filesystem(self.pending)
        system.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for row in iterator:
            if out is None or size >= self.roll:
                if out is not None:
                    out.close()
                names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
            data = member(record(row.asDict()))
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        message = WriterCommitMessage()
        message.names = names
        return message

    def commit(self, messages):
        """Moves the files, then leaves the mark without which no reader takes them."""
        system, folder = _filesystem(self.pending)
        _, final = _filesystem(self.path)
        system.create_dir(final, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{folder}/{name}", f"{final}/{name}")
        system.open_output_stream(f"{final}/{COMMITTED}{self.job}", compression=None).close()
        self._drop()

    def abort(self, messages):
        self._drop()

    def _drop(self):
        system, folder = _filesystem(self.pending)
        try:
            system.delete_dir(folder)
        except FileNotFoundError:  # no task wrote a row
            pass


class WarcFiles(InputPartition):
    def __init__(self, files):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.size = options["path"], int(options.get("partition", PARTITION))
        self.names = [f.name for f in schema.fields]
        self.equal = {}

    def pushFilters(self, filters):
        """Takes column = value and column IN values on header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in COLUMNS and column != "payload_bytes":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[column] = values & self.equal.get(column, values)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, folder = _filesystem(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.is_file]
        done = {f.base_name[len(COMMITTED):] for f in found if f.base_name.startswith(COMMITTED)}
        files = [f for f in found if not any(p[:1] in "_." for p in f.path[len(folder):].strip("/").split("/"))
                 and not ((ours := OWN_PART.match(f.base_name)) and ours[1] not in done)]
        out, held, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            held.append(f.path)
            size += f.size
            if size >= self.size:
                out.append(WarcFiles(held))
                held, size = [], 0
        return [*out, WarcFiles(held)] if held or not out else out

    def read(self, partition):
        system, _ = _filesystem(self.path)
        for name in partition.files:
            with system.open_input_file(name) as source:
                yield from self._records(source)

    def _wanted(self, head):
        return all(head.get(c) in values for c, values in self.equal.items())

    def _records(self, source):
        """Header blocks first; of an unwanted record the rest is neither inflated nor kept."""
        at, end, payload = 0, source.size(), "payload" in self.names
        while at < end:
            source.seek(at)
            fixed = source.read(20)
            if fixed[:3] != b"\x1f\x8b\x08":
                raise ValueError("not a gzip member: records are expected to be compressed one by one")
            size = None
            if fixed[3] & 4 and fixed[12:14] == MARK:
                size = struct.unpack("<I", fixed[16:20])[0]
            source.seek(at)
            inflate, raw, left = zlib.decompressobj(31), bytearray(), size
            head, first = None, -1
            while not inflate.eof:
                data = source.read(READ if left is None else min(READ, left))
                if not data:
                    raise ValueError("a record is cut off")
                if left is not None:
                    left -= len(data)
                while data and not inflate.eof:
                    raw += inflate.decompress(data, 1 << 16 if head is None else 0)
                    data = inflate.unconsumed_tail
                    if head is None and (first := raw.find(b"\r\n\r\n")) >= 0:
                        head = parse_head(bytes(raw[:first]))
                        if not self._wanted(head) or not payload:
                            break
                if head is not None and (not self._wanted(head) or not payload):
                    if size is not None:
                        break
                    while not inflate.eof:  # no length noted: inflate and drop
                        data = inflate.unconsumed_tail or source.read(READ)
                        inflate.decompress(data, READ)
                        if not data:
                            raise ValueError("a record is cut off")
            at = at + size if size is not None else source.tell() - len(inflate.unused_data)
            if head is None or not self._wanted(head):
                continue
            head["payload"] = None
            if payload:
                length = int(head["content_length"] or 0)
                body = bytes(raw[first + 4:first + 4 + length])
                if head["record_type"] != "revisit":
                    split = body.find(b"\r\n\r\n")
                    head["payload"] = body[split + 4:] if split >= 0 and body[:5] == b"HTTP/" else body
            yield tuple(head[n] for n in self.names)


def parse_head(raw: bytes) -> dict:
    lines = raw.decode("utf-8").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    head = {c: fields.get(n.lower()) for c, n in COLUMNS.items()}
    for c in ("record_id", "refers_to"):
        head[c] = head[c].strip("<>") if head[c] else head[c]
    if head["payload_digest"]:
        head["payload_digest"] = head["payload_digest"].rpartition(":")[2]
    head["payload_bytes"] = int(head["payload_bytes"]) if head["payload_bytes"] else None
    head["content_length"] = int(fields["content-length"]) if "content-length" in fields else None
    return head


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, schema)


def register(spark) -> None:
    """Make format("warc") known, and let the session push filters into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(df, path: str, **options) -> None:
    """Rows with any of SCHEMA's columns -> archives under `path`, added to what is there."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").options(**options).save(_qualified(df.sparkSession, path))


def read(spark, path: str, columns: list = None, **options):
    """The records under `path`, headers and payload; without `payload` among `columns` no block is read."""
    register(spark)
    reader = spark.read.format("warc").options(**options)
    if columns:
        kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(_qualified(spark, path))


def archive(pages, path: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """One record for each row: of equal payloads of at least `least` bytes that with the smallest id is the
    response and the others revisit it; rows that share that id are all responses.  A null html is an
    empty payload; in a group whose ids are all null every row is a response.  Extra columns are not written.
    """
    raw = F.encode(F.coalesce(named(html), F.lit("")), "UTF-8")
    rows = pages.select(named(id).alias("_id"), named(url).cast("string").alias("target_uri"), raw.alias("payload"))
    rows = rows.withColumns({"_sha": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("bigint")})
    first = rows.where(F.col("payload_bytes") >= least).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialise(first.where("_n > 1"))
    rows = lookup(rows, first, ["_sha"], "_n")  # frequent payloads never meet in one task
    again = ~F.col("_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull()
    write(rows.select(
        record_urn(F.col("_id")).alias("record_id"), F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri", F.lit("1970-01-01T00:00:00Z").alias("date"), F.when(again, record_urn(F.col("_first"))).alias("refers_to"),
        base32(F.hex("_sha")).alias("payload_digest"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload")), path)
    remove(first)


def record_urn(id):
    return F.concat(F.lit("urn:page:"), F.coalesce(id.cast("string"), F.lit("")))


def base32(sha_hex):
    """Bare base32 of a 40-digit hex column, as a Column: five hex digits are four base32 digits."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(sha_hex, i + 1, 5), 16, 10).cast("int")
        out += [F.substr(digits, F.shiftright(value, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for bits in (15, 10, 5, 0)]
    return F.concat(*out)
