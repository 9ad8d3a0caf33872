"""Media columns: payloads by content address in tar shards, metadata by header-only range reads.

A payload is stored as a greyscale PNG of 64 samples a row, a member of a tar
shard whose name is the payload's SHA-256. Rows of a table carry no media but
(digest, shard, offset, length). Equal payloads are stored once. Hashes of all
payloads are counted first. A payload whose hash occurs once is encoded and
written by the task that reads it, so media aren't shuffled. Payloads of other
hashes are dealt by digest, each task having dropped the repeats it meets, so a
text that a third of all rows hold reaches the shuffle once a task; the task
that writes their shard keeps the first of each digest. Should the hashes that
occur again be more than SEND_HASHES, all payloads go that way.

``metadata`` reads only the first HEADER bytes of a member and fills columns
from them. ``features`` reads whole members, checks and decodes them. ``sweep``
does any of that in one pass over a shard, in the order of offsets.

A task writes a shard under a name of its own attempt, and the manifest, written
as a table after it, names the attempts that succeeded. So a lost executor or a
speculative copy leaves at most a file that no row points to, and what is read
later doesn't depend on the executor that wrote it.

Defined results: a null text is an empty payload; an empty payload is 64 zero
bytes. Texts that differ only in zero bytes at their end within one padding
share a payload, but not n_bytes. Repeated rows share a member. Empty tables
give no rows. Extra columns are kept by ``columns``, where those of its own
names are replaced.
"""

from __future__ import annotations

import binascii
import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, bound_batches, narrow, table

UNIT, TAIL = 64, 64
#: Payload bytes of one shard; the first bytes of a member that hold all its metadata; bytes of media in one Arrow batch.
SHARD_BYTES, HEADER, BATCH_BYTES = 64 << 20, 33, 8 << 20
#: Bytes of a shard that are swept together, so that a task's share doesn't grow with its shards.
RANGE_BYTES = 8 << 20
#: Digests a task remembers in order to drop repeats; what it forgets, the shard's task drops.
REMEMBERED = 1_000_000
#: Hashes of payloads that occur again, eight bytes each, that are sent to all tasks.
SEND_HASHES = 1_000_000

#: Fixed values of the PNG format: signature, and (bit depth, colour type, compression, filter, interlace) of 8-bit greyscale.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_GREY = (8, 0, 0, 0, 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """The payload, a positive multiple of UNIT bytes, as a PNG of UNIT samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)  # each row starts with its filter, 0 for none
    raw[:, 1:] = rows
    header = struct.pack(">IIBBBBB", UNIT, len(rows), *_GREY)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER bytes of a member."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR" or struct.unpack(">I", start[29:33])[0] != binascii.crc32(start[12:29]):
        raise ValueError("not a PNG header")
    width, height, *rest = struct.unpack(">IIBBBBB", start[16:29])
    if tuple(rest) != _GREY:
        raise ValueError("not 8-bit greyscale")
    return width, height, rest[0]


def decode(media: bytes) -> bytes:
    """The payload of a PNG that ``encode`` made; every chunk's checksum is tested."""
    width, height, _ = header(media[:HEADER])
    data, at = [], 8
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8].ljust(8))
        body = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != binascii.crc32(media[at + 4 : at + 8 + size]):
            raise ValueError(f"broken chunk {kind!r}")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Average hash of the image, 8 by 8 cells in hex, with its mean and spread in thousandths.

    Cells are strips of rows and of columns with borders i * n // 8; a cell
    without rows takes the row at its border. All numbers are integers.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(image)
    strips = image.reshape(n, 8, UNIT // 8).sum(axis=2, dtype=np.int64)
    below = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(strips, axis=0)])
    first = np.arange(8) * n // 8
    last = np.maximum(np.arange(1, 9) * n // 8, first + 1)
    cells = (below[last] - below[first]) * 1000 // ((last - first) * (UNIT // 8))[:, None]
    total = int(below[-1].sum())
    bits = cells * n * UNIT >= total * 1000
    squares = sum(int(np.square(image[k : k + 4096], dtype=np.int64).sum()) for k in range(0, n, 4096))
    mean = total * 1000 // (n * UNIT)
    spread = squares * 1000 // (n * UNIT) - total * total * 1000 // (n * UNIT) ** 2
    return f"{np.packbits(bits.ravel()).tobytes().hex()}:{mean}:{spread}"


def payload(text: str = "text") -> Column:
    """UTF-8 of the text with zero bytes up to a positive multiple of UNIT."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return F.rpad(data, payload_bytes(text).cast("int"), F.lit(b"\x00"))


def payload_bytes(text: str = "text") -> Column:
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0))
    return (F.greatest(F.ceil(size / UNIT), F.lit(1)) * UNIT).cast("long")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, media) of a task's payloads, each once."""
    seen: set[bytes] = set()
    kinds = {"digest": pa.binary(), "media": pa.binary()}
    held, size = [], 0
    for batch in batches:
        column = batch.column(0)
        for i in range(len(column)):
            data = column[i].as_py()
            digest = hashlib.sha256(data).digest()
            if digest in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(digest)
            media = encode(data)
            held.append((digest, media))
            size += len(media)
            if size > BATCH_BYTES:
                yield _batch(held, kinds)
                held, size = [], 0
    if held:
        yield _batch(held, kinds)


_MANIFEST = "digest binary, shard string, offset long, length long"
_MANIFEST_KINDS = {"digest": pa.binary(), "shard": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def _writer(folder: str, shard_bytes: int) -> Callable:
    """Writes a task's members (digest, media) into shards of about shard_bytes, and returns their places; a repeated neighbour is left out."""

    def run(batches):
        fs, at = pa.fs.FileSystem.from_uri(folder)
        name, tar, out, last, places = None, None, None, None, []

        def close():
            tar.close()
            out.close()

        try:
            for batch in batches:
                digests, media = batch.column(0), batch.column(1)
                for i in range(len(digests)):
                    digest = digests[i].as_py()
                    if digest == last:
                        continue
                    last, body = digest, media[i].as_py()
                    if tar is None:
                        fs.create_dir(at, recursive=True)
                        name = f"shard-{uuid.uuid4().hex}.tar"  # of this attempt alone
                        out = fs.open_output_stream(f"{at}/{name}")
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(body)
                    tar.addfile(member, io.BytesIO(body))
                    padded = -(-len(body) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
                    places.append((digest, name, tar.offset - padded, len(body)))
                    if tar.offset >= shard_bytes:
                        close()
                        tar = None
                        yield _batch(places, _MANIFEST_KINDS)  # only now is the shard whole
                        places = []
        finally:
            if tar is not None:
                close()
        if places:
            yield _batch(places, _MANIFEST_KINDS)

    return run


def pack(payloads: DataFrame, staged: Staged, shard_bytes: int = SHARD_BYTES, send_hashes: int = SEND_HASHES) -> tuple[DataFrame, str]:
    """The manifest (digest, shard, offset, length) of payloads(payload binary), and the folder of its shards."""
    folder = f"{staged.base}/shards"
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    write = _writer(folder, shard_bytes)
    hashed = payloads.select("payload", F.xxhash64("payload").alias("h"))
    again = staged.write(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("payload")).alias("size")).filter("n > 1"))
    found = again.agg(F.count(F.lit(1)), F.sum("size")).first()
    if found[0] <= send_hashes:
        flagged = F.broadcast(again.select("h"))
        alone, common = hashed.join(flagged, "h", "left_anti"), hashed.join(flagged, "h", "left_semi")
        total = found[1] or 0
    else:
        alone, common = None, hashed
        total = payloads.agg(F.sum(F.octet_length("payload"))).first()[0]
    encoded = common.select("payload").mapInArrow(_encoded, "digest binary, media binary")
    shards = max(1, -(-total // shard_bytes))
    dealt = encoded.repartition(shards, "digest").sortWithinPartitions("digest")
    manifest = dealt.mapInArrow(write, _MANIFEST)
    if alone is not None:
        direct = alone.select("payload").mapInArrow(lambda batches: write(_encoded(batches)), _MANIFEST)
        manifest = manifest.unionByName(direct)
    return staged.write(manifest), folder


class Read(NamedTuple):
    """How many of a member's n bytes are read (``length(n)``), what is made of them, and the DDL of that."""

    length: Callable[[int], int]
    made: Callable[[bytes], tuple]
    fields: str


def sweep(manifest: DataFrame, folder: str, *reads: Read) -> DataFrame:
    """manifest with the fields of all reads of each member; a range of a shard is opened once and read in the order of its offsets."""
    ddl = ", ".join(r.fields for r in reads)
    kinds = dict(_MANIFEST_KINDS) | {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]] for f in ddl.split(", ")}

    def run(batches):
        fs, at = pa.fs.FileSystem.from_uri(folder)
        name, file = None, None
        try:
            for batch in batches:
                rows = []
                for digest, shard, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard != name:
                        if file is not None:
                            file.close()
                        name, file = shard, fs.open_input_file(f"{at}/{shard}")
                    row = [digest, shard, offset, size]
                    for r in reads:
                        row += r.made(file.read_at(r.length(size), offset))
                    rows.append(row)
                yield _batch(rows, kinds)
        finally:
            if file is not None:
                file.close()

    piece = F.floor(F.col("offset") / RANGE_BYTES)
    places = manifest.select("digest", "shard", "offset", "length").repartition("shard", piece).sortWithinPartitions("shard", "offset")
    return places.mapInArrow(run, f"{_MANIFEST}, {ddl}")


def _read(media: bytes) -> tuple:
    data = decode(media)
    return hashlib.sha256(data).digest(), binascii.crc32(data[-TAIL:]), len(media), hashlib.sha256(media).digest(), feature(data)


HEAD = Read(lambda n: min(n, HEADER), header, "width long, height long, bit_depth int")
WHOLE = Read(lambda n: n, _read, "payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def metadata(manifest: DataFrame, folder: str) -> DataFrame:
    """manifest with width, height and bit_depth of each member, from its header alone."""
    return sweep(manifest, folder, HEAD)


def features(manifest: DataFrame, folder: str) -> DataFrame:
    """manifest with payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each member, from all its bytes."""
    return sweep(manifest, folder, WHOLE)


def columns(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs without the text, but with its media's address and what headers and stored bytes say of it."""
    bound_batches(docs.sparkSession)
    staged = Staged(docs.sparkSession, "media_columns")
    manifest, folder = pack(docs.select(payload(text).alias("payload")), staged, shard_bytes)
    known = staged.write(sweep(manifest, folder, HEAD, WHOLE))
    made = ["n_bytes", "payload_bytes", *known.columns]
    kept = [c for c in docs.columns if c != text and c.lower() not in made]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], size.alias("n_bytes"), F.unhex(F.sha2(payload(text), 256)).alias("digest"))
    # one row a digest on the other side: a digest of many rows is a skewed join, which Spark splits
    out = rows.join(known, "digest")
    shown = [F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in known.dtypes]
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "n_bytes", (F.col("width") * F.col("height")).alias("payload_bytes"), *shown)


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
