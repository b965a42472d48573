"""WARC archives: monolithic gzip files rewritten as one member per record, with a sidecar offset index.

1. ``write_monolithic`` writes the rows of each partition as archives that are one gzip stream each.
2. ``resolve`` finds equal payloads from narrow rows and says which record stays a response.
3. ``normalise`` inflates each archive once, as a stream, rewrites every record as a member of its own
   (a revisit record where an equal payload is kept elsewhere) and writes a sidecar with the offsets.
4. ``read_members`` seeks to each member by the sidecar and reads it alone.

Payloads are never shuffled: only digests and decisions are. Archives go to a folder that all executors
share, under names of their own for each attempt, and only files named in a manifest count; a task that
runs again leaves no half-written file in the result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstream.llm.common import file_system, persisted, shared_folder

#: An archive is closed beyond so many payload bytes or records; this bounds what one task holds of decisions.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64_000_000, 50_000
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date, so that equal input gives equal records.
DATE = "2020-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response record with its payload, or a revisit record without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def page_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def inflate(stream) -> Iterator[bytes]:
    """Chunks of the plain bytes of a gzip stream of one or many members."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            while plain := inflater.decompress(data, CHUNK):
                yield plain
                data = inflater.unconsumed_tail
                if inflater.eof or not data:
                    break
            if not inflater.eof:
                break
            data = inflater.unused_data
            inflater = zlib.decompressobj(31)
    if tail := inflater.flush():
        yield tail


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of plain bytes; no more than one record and one chunk is held."""
    buffer = bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while fill(1):
        scanned = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, scanned - 3))) < 0:
            scanned = len(buffer)
            if not fill(scanned + 1):
                raise ValueError("the archive ends inside a record's header")
        length = next(int(x.partition(b":")[2]) for x in bytes(buffer[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
        whole = end + 4 + length + 4
        if not fill(whole):
            raise ValueError("the archive ends inside a record's block")
        yield bytes(buffer[:whole])
        del buffer[:whole]


def write_monolithic(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 1) -> DataFrame:
    """Write every row as a response record; returns archive, seq, page_id, payload_sha256, payload_bytes."""

    def run(batches):
        out = raw = name = None
        size = seq = 0
        fs, root = file_system(folder)
        fs.create_dir(f"{root}/raw", recursive=True)

        def close():
            raw.write(out.flush())
            raw.close()

        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                p, u, h = (batch.column(k)[i].as_py() for k in range(3))
                payload = (h or "").encode()
                if out is None or size > ARCHIVE_BYTES or seq >= ARCHIVE_RECORDS:
                    if out is not None:
                        close()
                    name = f"raw/{uuid.uuid4().hex}.warc.gz"
                    raw, out, size, seq = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0, 0
                raw.write(out.compress(record(p, u, payload, sha1_base32(payload), len(payload))))
                rows.append((name, seq, p, hashlib.sha256(payload).digest(), len(payload)))
                size, seq = size + len(payload), seq + 1
            names = ["archive", "seq", "page_id", "payload_sha256", "payload_bytes"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=names)
        if out is not None:
            close()

    slim = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    return slim.mapInArrow(run, "archive string, seq long, page_id long, payload_sha256 binary, payload_bytes long")


def resolve(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Which records revisit which: of equal payloads of at least ``min_bytes`` the largest page_id stays.

    Among rows of that same page_id the last written one stays. The winners are a map-side combined
    aggregate with one row for each payload; the join back is on narrow rows, whose hot keys Spark can split.
    """
    key = F.struct("page_id", "archive", "seq")
    winners = written.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_sha256").agg(F.max(key).alias("w"))
    both = written.join(winners, "payload_sha256", "left")
    revisit = F.col("w").isNotNull() & ((F.col("w.archive") != F.col("archive")) | (F.col("w.seq") != F.col("seq")))
    return both.select("archive", "seq", revisit.alias("revisit"), F.when(revisit, F.col("w.page_id")).cast("string").alias("refers_to"))


def normalise(decisions: DataFrame, folder: str, archives: int, level: int = 3) -> DataFrame:
    """Rewrite every archive named in ``decisions`` with one member for each record; returns archive, sidecar, records.

    A group is one archive, whose number of records is bounded where it was written.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fs, root = file_system(folder)
        fs.create_dir(f"{root}/members", recursive=True)
        name = f"members/{uuid.uuid4().hex}"
        change = {s: r for s, v, r in zip(group["seq"], group["revisit"], group["refers_to"], strict=True) if v}
        offset = n = 0
        index = []
        with fs.open_input_stream(f"{root}/{group['archive'].iloc[0]}", compression=None, buffer_size=CHUNK) as source, fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None, buffer_size=CHUNK) as out:
            for seq, raw in enumerate(records(inflate(source))):
                headers, payload = parse(raw)
                if seq in change:
                    refers = None if pd.isna(change[seq]) else int(change[seq])
                    raw = record(page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), b"", headers["warc-payload-digest"].removeprefix("sha1:"), len(payload), refers, True)
                packer = zlib.compressobj(level, wbits=31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                index.append({"offset": offset, "length": len(member), "id": headers["warc-record-id"], "type": "revisit" if seq in change else "response"})
                offset, n = offset + len(member), n + 1
        if n != len(group):
            raise ValueError(f"{group['archive'].iloc[0]} holds {n} records; {len(group)} were written")
        with fs.open_output_stream(f"{root}/{name}.idx.json", compression=None) as side:
            side.write("".join(json.dumps(x) + "\n" for x in index).encode())
        return pd.DataFrame({"archive": [f"{name}.warc.gz"], "sidecar": [f"{name}.idx.json"], "records": [n]})

    dealt = decisions.repartition(archives, "archive")  # an archive is work of one task, so few bytes here are much work
    return dealt.groupBy("archive").applyInPandas(run, "archive string, sidecar string, records long")


def read_members(manifest: DataFrame, folder: str, archives: int) -> DataFrame:
    """Read every record by its offset. A response's payload is hashed again and compared with its header."""

    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{sidecar}", compression=None) as side:
                    index = [json.loads(x) for x in side.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(f"{root}/{archive}") as members:
                    for x in index:
                        members.seek(x["offset"])
                        headers, payload = parse(zlib.decompress(members.read(x["length"]), 31))
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(headers["warc-payload-length"])
                        if kind == "response" and (sha1_base32(payload) != digest or len(payload) != size):
                            raise ValueError(f"{archive} at {x['offset']}: the payload doesn't fit its digest")
                        rows.append((page_of(headers["warc-record-id"]), size, digest, kind, page_of(headers.get("warc-refers-to")), archive, x["offset"], x["length"]))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "member_offset", "member_length"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, member_offset long, member_length long"
    return manifest.select("archive", "sidecar").repartition(archives, "archive").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives, normalise these, and read all records back by the sidecars.

    Returns page_id, payload_bytes, payload_digest (both of the full payload), record_type, refers_to,
    archive, member_offset and member_length: one row for each input row. Null html is an empty payload
    (all empty ones are equal), a null url has no target header, a null page_id comes back null. Repeated
    rows are records of their own; all but one of them revisit their own page_id. An empty table writes no
    archive. Other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    written = persisted(write_monolithic(pages, folder), "warc-written")
    archives = max(1, written.select("archive").distinct().count())
    manifest = persisted(normalise(resolve(written, min_bytes), folder, 2 * archives), "warc-manifest")
    return read_members(manifest, folder, 2 * archives)


def archive_sql(min_bytes: int = 0) -> str:
    """The rows over ``pages`` in DuckDB's SQL; base32 is spelled out from the bits of the digest."""
    return f"""
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, h, strlen(h) as n, sha1(h) as x from p),
w as (select h, max(page_id) as top from p group by h),
bits as (select x, string_agg(case c when '0' then '0000' when '1' then '0001' when '2' then '0010' when '3' then '0011' when '4' then '0100' when '5' then '0101' when '6' then '0110' when '7' then '0111'
  when '8' then '1000' when '9' then '1001' when 'a' then '1010' when 'b' then '1011' when 'c' then '1100' when 'd' then '1101' when 'e' then '1110' else '1111' end, '' order by i) as b
  from (select x, i, substr(x, i, 1) as c from (select distinct x from s) cross join (select unnest(range(1, 41)) as i)) group by x),
digest as (select x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * j + 1, 1)::int + 8 * substr(b, 5 * j + 2, 1)::int + 4 * substr(b, 5 * j + 3, 1)::int
  + 2 * substr(b, 5 * j + 4, 1)::int + substr(b, 5 * j + 5, 1)::int, 1), '' order by j) as d from bits cross join (select unnest(range(0, 32)) as j) group by x)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when n < {min_bytes} or page_id = top then 'response' else 'revisit' end as record_type,
  case when n >= {min_bytes} and page_id <> top then top end as refers_to
from s join w using (h) join digest using (x)"""
