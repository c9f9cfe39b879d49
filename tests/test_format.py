"""Segment files: the published vector byte for byte, round trips, and rejection of damage."""

import base64
import hashlib

import pytest

from tidemark import errors, schema
from tidemark.functions.hashing import crc32c, placement_checksum
from tidemark.sources import plseg
from tidemark.sources.plseg import Record, SegmentOptions

VECTOR = [
    Record(1776263000001, b"alpha"),
    Record(1776263000001, b'{"ok":true}', ((b"content-type", b"application/json"), (base64.b64decode("AH//"), base64.b64decode("AAH+/w==")))),
    Record(1776263000010, b"", ((b"empty", b""),)),
    Record(1776263000011, base64.b64decode("AAECf4D+/w==")),
]


def test_uncompressed_vector_is_byte_exact():
    opts = SegmentOptions(7, 9007199254740993, bytes.fromhex("101112131415161718191a1b1c1d1e1f"),
                          bytes.fromhex("404142434445464748494a4b4c4d4e4f"), block_bytes=80, created_ms=1776263000000)
    data = plseg.encode(VECTOR, opts)
    assert len(data) == 847
    assert hashlib.sha256(data).hexdigest() == "06aa5022a719c69c361eb8e421ae33539a3bdc40968e1e87ee2bf843fa902b80"
    reader = plseg.from_bytes(data)
    reader.verify()
    assert [(r.timestamp_ms, r.value, r.headers) for r in reader.scan()] == [(r.timestamp_ms, r.value, r.headers) for r in VECTOR]
    assert [e.count for e in reader.entries] == [1, 1, 2]


@pytest.mark.parametrize("codec", [schema.CODEC_NONE, schema.CODEC_ZSTD])
@pytest.mark.parametrize("algo", [schema.HASH_CRC32C, schema.HASH_XXH64])
def test_round_trip_seek_and_pruning(codec, algo):
    records = [Record(50_000 + i, bytes([97 + (i + j) % 26 for j in range(40)])) for i in range(40)]
    data, reads = plseg.encode(records, SegmentOptions(7, 1000, b"u" * 16, codec=codec, algo=algo, block_bytes=256)), []

    def read_at(offset, n):
        reads.append(n)
        return data[offset:offset + n]

    reader = plseg.SegmentReader(read_at, len(data))
    assert len(reads) == 3
    assert reader.read(1017, 1)[0].lsn == 1017 and len(reads) == 4
    assert [r.lsn for r in reader.scan()] == list(range(1000, 1040))
    assert (reader.find_timestamp(49_000), reader.find_timestamp(50_017), reader.find_timestamp(99_000)) == (1000, 1017, None)


def test_damage_is_found():
    data = plseg.encode([Record(i, b"x" * 50) for i in range(20)], SegmentOptions(1, 0, b"u" * 16, block_bytes=128))
    for at in (100, len(data) - 150, len(data) - 500):
        bad = data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]
        with pytest.raises(errors.CorruptDataError):
            list(plseg.from_bytes(bad).scan())
    with pytest.raises(errors.CorruptDataError):
        plseg.from_bytes(data[:-1])
    with pytest.raises(errors.TimestampRegressionError):
        plseg.encode([Record(2), Record(1)], SegmentOptions(1, 0, b"u" * 16))


def test_hash_vectors():
    assert crc32c(b"123456789") == 0xE3069283
    for stream, partition, want in (("hosts/host-a/events", 0, 0x77483F93), ("hosts/host-a/events", 1, 0x8523BC90), ("", 1, 0x7E433189), ("", 3, 0x9F78417E)):
        assert placement_checksum(stream, partition) == want
