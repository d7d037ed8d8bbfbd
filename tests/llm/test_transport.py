import hashlib
import zlib

import pytest
from helpers import awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import transport


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60_000))
def test_round_trip(data):
    payload = transport.padded(data)
    media = transport.write(payload)
    assert len(media) % 188 == 0 and all(media[i] == 0x47 for i in range(0, len(media), 188))
    found = transport.read(media)
    assert found.payload == payload and (found.lost, found.doubled, found.broken) == (0, 0, 0)
    n = -(-len(payload) // (576 * 16))
    assert found.stamps == [90_000 + k * 17_280 for k in range(n)]
    assert [t for _, t in found.random_access] == found.stamps[::8] == found.clocks


@pytest.mark.parametrize("units", range(1, 40))
def test_every_padding(units):
    payload = bytes(range(256)) * 90
    assert transport.read(transport.write(payload[: 576 * units])).payload == payload[: 576 * units]


def test_crc_is_the_published_check_value():
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_lost_and_doubled_packets():
    media = transport.write(transport.padded(b"x" * 50_000))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert transport.read(b"".join(packets[:10] + packets[11:])).lost == 1
    doubled = transport.read(b"".join(packets[:10] + packets[9:]))
    assert doubled.doubled == 1 and doubled.payload == transport.read(media).payload
    assert transport.read(b"junk" * 100).broken > 0
    assert transport.read(b"").payload == b""


def test_table_with_a_wrong_checksum_is_dropped():
    media = bytearray(transport.write(transport.padded(b"abc")))
    media[12] ^= 1
    assert transport.read(bytes(media)).programs == {}


def test_digests(spark):
    docs = awkward(spark)
    rows = transport.digests(transport.encode(docs)).collect()
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want.append((str(r.doc_id), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(map(str, transport.round_trip(docs).collect())) == sorted(map(str, rows))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert transport.digests(transport.encode(documents(spark, ["x"]).limit(0))).count() == 0


def test_media_column_round_trip(spark):
    docs = documents(spark, ["hello", None, "z" * 30_000])
    back = {r.id: r for r in transport.decode(transport.encode(docs)).collect()}
    assert bytes(back[0].payload).rstrip(b"\xff") == b"hello" and len(back[1].payload) == 576
    assert back[2].stamps == [90_000 + 17_280 * k for k in range(4)] and back[2].random_access[0].pts == 90_000


def test_long_losses_and_discontinuities():
    media = transport.write(transport.padded(bytes(range(256)) * 400))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    found = transport.read(b"".join(packets[:20] + packets[35:]))
    assert (found.lost, found.doubled) == (15, 0)  # the counter comes round to the same, with other bytes
    assert transport.read(b"".join(packets[:20] + packets[36:])).broken >= 1  # the counter goes on as if nothing were lost
    gap = transport.write(transport.padded(b"y" * 50_000))
    first = bytearray(gap[376:564])
    first[5] |= 0x80  # the discontinuity indicator
    first[3] = first[3] & 0xF0 | 9
    joined = transport.read(b"".join(packets[:60]) + bytes(first))
    assert joined.lost == 0


def test_stored_media_are_read_back(spark):
    rows = {r.doc_id: r for r in transport.round_trip(documents(spark, ["z" * 100_000, None])).collect()}
    assert rows[0].stamps == [90_000 + 17_280 * k for k in range(11)]
    assert [p.pts for p in rows[0].random_access] == rows[0].stamps[::8] and rows[1].stamps == [90_000]


def test_sizes_and_hashes_against_sql(spark, small):
    """n_bytes and the hash of the payload by DuckDB."""
    import duckdb

    want = duckdb.connect().execute(
        f"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM '{small}/documents.parquet'),
        p AS (SELECT doc_id, octet_length(b) AS n, greatest(1, ceil(octet_length(b) / 576.0)::BIGINT) * 576 AS whole, b FROM d)
        SELECT doc_id, n, whole, sha256(b || unhex(repeat('FF', (whole - n)::INT))) FROM p ORDER BY 1"""
    ).fetchall()
    rows = transport.round_trip(spark.read.parquet(f"{small}/documents.parquet")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == want
