"""Media columns: exact round trips through tar shards, header-only reads, content addresses."""

import binascii
import hashlib
import os
import random
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medlattice.llm import media_columns
from medlattice.llm.common import Staged

DOCS = "doc_id long, text string"


def padded(text):
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def plain_feature(data):
    """The feature from its description, sample by sample."""
    rows = [data[i : i + 64] for i in range(0, len(data), 64)]
    n, total = len(rows), sum(data)
    bits = ""
    for i in range(8):
        own = rows[i * n // 8 : max((i + 1) * n // 8, i * n // 8 + 1)]
        for j in range(8):
            cell = [x for row in own for x in row[8 * j : 8 * j + 8]]
            bits += "1" if sum(cell) * 1000 // len(cell) * len(data) >= total * 1000 else "0"
    spread = sum(x * x for x in data) * 1000 // len(data) - total * total * 1000 // len(data) ** 2
    return f"{int(bits, 2):016x}:{total * 1000 // len(data)}:{spread}"


def texts():
    rng = random.Random(2)
    some = [None, "", "a", "a\x00", "é" * 32, "x" * 64, "x" * 65, "\x00" * 64, "\x00" * 65, "".join(chr(rng.randrange(32, 3000)) for _ in range(300_000))]
    some += ["".join(rng.choice("ab c\n") for _ in range(rng.randrange(400))) for _ in range(60)]
    return some + ["hot"] * 40


def test_png_round_trip_and_broken_bytes():
    rng = random.Random(1)
    for n in (1, 2, 7, 8, 9, 200):
        data = bytes(rng.randrange(256) for _ in range(64 * n))
        media = media_columns.encode(data)
        assert media_columns.decode(media) == data and media_columns.header(media[:33]) == (64, n, 8)
        assert media_columns.feature(data) == plain_feature(data)
        for at in (3, 20, 45, len(media) - 1):
            with pytest.raises(ValueError):
                media_columns.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])


def test_query_is_an_exact_round_trip(spark, tmp_path):
    rows = list(enumerate(texts()))
    rows += [(3, "a\x00"), (None, "no id")]
    spark.createDataFrame(rows, DOCS).withColumn("feature", F.lit("clash")).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = media_columns.op12_media_columns(spark, str(tmp_path))
    assert found.columns[:7] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def want(i, t):
        data = padded(t)
        media = media_columns.encode(data)
        return i, len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), binascii.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), plain_feature(data)

    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=order) == sorted((want(*r) for r in rows), key=order)


@pytest.mark.parametrize("shard_bytes,send_hashes", [(2000, 1000), (2000, 1), (1 << 30, 1000), (1 << 30, 0)])
def test_shards_hold_each_payload_once(spark, shard_bytes, send_hashes):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    staged = Staged(spark, "test_media")
    manifest, folder = media_columns.pack(docs.select(media_columns.payload().alias("payload")), staged, shard_bytes, send_hashes)
    places = manifest.collect()
    want = {hashlib.sha256(padded(t)).digest(): padded(t) for _, t in rows}
    assert len(places) == len(want) and {bytes(p.digest) for p in places} == set(want)
    assert (len({p.shard for p in places}) > 10) == (shard_bytes == 2000)
    local = folder.removeprefix("file://")
    for p in places:
        with open(f"{local}/{p.shard}", "rb") as f:
            f.seek(p.offset)
            assert media_columns.decode(f.read(p.length)) == want[bytes(p.digest)]
    members = [(m.name, tar.extractfile(m).read()) for s in os.listdir(local) if s.endswith(".tar") for tar in [tarfile.open(f"{local}/{s}")] for m in tar]
    assert {n: media_columns.decode(b) for n, b in members} == {f"{d.hex()}.png": b for d, b in want.items()} and len(members) == len(want)


def test_metadata_reads_headers_alone(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), DOCS)
    manifest, folder = media_columns.pack(docs.select(media_columns.payload().alias("payload")), Staged(spark, "test_media"), 4000)
    local = folder.removeprefix("file://")
    for p in manifest.collect():  # nothing behind a header is left
        with open(f"{local}/{p.shard}", "r+b") as f:
            f.seek(p.offset + media_columns.HEADER)
            f.write(b"\xff" * (p.length - media_columns.HEADER))
    found = {bytes(r.digest): (r.width, r.height, r.bit_depth) for r in media_columns.metadata(manifest, folder).collect()}
    assert found == {hashlib.sha256(padded(t)).digest(): (64, len(padded(t)) // 64, 8) for t in texts()}
    with pytest.raises(Exception, match="broken chunk|decompress"):
        media_columns.features(manifest, folder).collect()


def test_failed_attempt_leaves_no_row(tmp_path):
    write = media_columns._writer(f"file://{tmp_path}", 1 << 20)
    media = [media_columns.encode(padded(t)) for t in ("a", "b")]
    batch = pa.RecordBatch.from_arrays([pa.array([b"1", b"2"]), pa.array(media)], names=["digest", "media"])

    def lost():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        list(write(lost()))
    first, second = list(write(iter([batch]))), list(write(iter([batch])))
    assert len(os.listdir(tmp_path)) == 3 and first[0].column(1)[0] != second[0].column(1)[0]
    assert list(write(iter([]))) == []


def test_forgetful_task_and_general_columns(spark, monkeypatch):
    monkeypatch.setattr(media_columns, "REMEMBERED", 2)
    data = [padded(t) for t in "abcabcaab"]
    out = list(media_columns._encoded(iter([pa.record_batch({"payload": pa.array(data)})])))
    assert {x for b in out for x in b.column(0).to_pylist()} == {hashlib.sha256(d).digest() for d in data}
    docs = spark.createDataFrame([(1, "abc", "m", 5, "k"), (1, "abc", "m", 5, "k"), (2, None, None, None, None)], "doc_id long, body string, digest string, width int, other string")
    found = media_columns.columns(docs, "body")
    assert found.columns[:2] == ["doc_id", "other"] and found.columns.count("digest") == found.columns.count("width") == 1
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    assert rows[0] == rows[1] and rows[0].digest == hashlib.sha256(padded("abc")).hexdigest() and (rows[2].n_bytes, rows[2].width, rows[2].height) == (0, 64, 1)
    assert media_columns.columns(spark.createDataFrame([], DOCS)).count() == 0
