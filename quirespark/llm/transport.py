"""MPEG transport streams as media columns.

write() wraps a payload of whole access units into a transport stream of 188-byte packets: a program
association table, a program map table, and packetised elementary stream packets with a presentation time stamp
each. The first packet of every eighth group is marked as a random-access point and carries a clock reference.
read() parses the tables, checks the continuity counter of every stream, reassembles the elementary packets and
returns the payload with its time stamps and random-access points. Lost packets (by the counters, but where the stream
itself tells of a discontinuity), doubled ones (equal bytes) and broken ones (no sync byte, or an elementary packet
shorter than it says) are counted.

round_trip() writes the media column to the shared folder as Parquet and reads it back from there.

Defined results: a null or empty text is one unit of padding; equal texts give equal streams; an empty table gives no
rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import Scratch, settled

#: Fixed values of the format: packet size, sync byte, identifiers, stream type (private data) and stream id.
PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, PROGRAM = 188, 0x47, 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: A unit of 576 bytes lasts 12 ms (576 samples at 48 kHz) of the 90 kHz clock.
UNIT, UNIT_TICKS, UNITS_IN_PES, PES_IN_GOP, CLOCK_START = 576, 1080, 16, 8, 90_000


def crc32_mpeg(data: bytes) -> int:
    """CRC of the tables: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0x00, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
)


def _stamp(prefix: int, ticks: int) -> bytes:
    return bytes([prefix << 4 | (ticks >> 30 & 7) << 1 | 1, ticks >> 22 & 255, (ticks >> 15 & 127) << 1 | 1, ticks >> 7 & 255, (ticks & 127) << 1 | 1])


def _clock(ticks: int) -> bytes:
    return bytes([ticks >> 25 & 255, ticks >> 17 & 255, ticks >> 9 & 255, ticks >> 1 & 255, (ticks & 1) << 7 | 0x7E, 0])


def _pes_packets(pes: bytes, counter: int, adaptation: bytes) -> np.ndarray:
    """The transport packets of one elementary packet. `adaptation`: flags and fields for the first one."""
    lead = len(adaptation) + 1 if adaptation else 0
    first = min(len(pes), PACKET - 4 - lead)
    full, rest = divmod(len(pes) - first, PACKET - 4)
    n = 1 + full + (rest > 0)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    short = PACKET - 4 - lead - first
    if lead or short:  # stuffing goes into the adaptation field
        fields = adaptation or (b"\0" if short > 1 else b"")
        size = lead + short - 1
        out[0, 3] |= 0x20
        out[0, 4] = size
        out[0, 5 : 5 + len(fields)] = np.frombuffer(fields, np.uint8)
    data = np.frombuffer(pes, np.uint8)
    out[0, PACKET - first :] = data[:first]
    if full:
        out[1 : 1 + full, 4:] = data[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
    if rest:
        size = PACKET - 4 - rest - 1
        out[-1, 3] |= 0x20
        out[-1, 4] = size
        if size:
            out[-1, 5] = 0
        out[-1, PACKET - rest :] = data[-rest:]
    return out


def write(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream of a payload of whole units."""
    parts, counter = [TABLES], 0
    step = unit * UNITS_IN_PES
    for k, at in enumerate(range(0, len(payload), step)):
        ticks = (CLOCK_START + k * UNITS_IN_PES * UNIT_TICKS) % (1 << 33)
        body = payload[at : at + step]
        head = bytes([0x84, 0x80, 5]) + _stamp(2, ticks)
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(head) + len(body)).to_bytes(2, "big") + head + body
        packets = _pes_packets(pes, counter, bytes([0x50]) + _clock(ticks) if k % PES_IN_GOP == 0 else b"")
        counter = (counter + len(packets)) & 15
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What read() found. random_access: (first packet, time stamp) of each such point."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    random_access: list[tuple[int, int]] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    packets: int = 0
    lost: int = 0
    doubled: int = 0
    broken: int = 0


def _tables(packet: bytes) -> bytes | None:
    """The section of a table's packet, if its checksum holds."""
    at = 5 + packet[4] if not packet[3] & 0x20 else None
    if at is None or at + 3 > PACKET:
        return None
    end = at + 3 + ((packet[at + 1] & 15) << 8 | packet[at + 2])
    return packet[at:end] if end <= PACKET and crc32_mpeg(packet[at:end]) == 0 else None


_SECTIONS: dict[bytes, bytes | None] = {}


def _section_of(packet: bytes) -> bytes | None:
    if packet not in _SECTIONS and len(_SECTIONS) < 1000:
        _SECTIONS[packet] = _tables(packet)
    return _SECTIONS.get(packet) or _tables(packet)


def read(media: bytes) -> Stream:
    """Parses a transport stream; packets without the sync byte, or cut short, are counted as broken."""
    found = Stream()
    whole = len(media) // PACKET * PACKET
    found.broken += whole != len(media)
    p = np.frombuffer(media[:whole], np.uint8).reshape(-1, PACKET)
    good = p[:, 0] == SYNC
    found.broken += int((~good).sum())
    p = p[good]
    found.packets = len(p)
    pids = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    maps: dict[int, int] = {}
    for packet in p[pids == PAT_PID]:
        if section := _section_of(packet.tobytes()):
            for k in range(8, len(section) - 4, 4):
                maps[(section[k + 2] & 31) << 8 | section[k + 3]] = section[k] << 8 | section[k + 1]
    for pid, program in maps.items():
        for packet in p[pids == pid]:
            if section := _section_of(packet.tobytes()):
                at = 12 + ((section[10] & 15) << 8 | section[11])
                while at + 5 <= len(section) - 4:
                    found.programs.setdefault(program, {})[(section[at + 1] & 31) << 8 | section[at + 2]] = section[at]
                    at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    streams = sorted(pid for program in found.programs.values() for pid in program)
    payloads = []
    for pid in streams:
        own = p[pids == pid]
        has_data = (own[:, 3] & 0x10) > 0
        own = own[has_data]
        doubles = np.append(False, (own[1:] == own[:-1]).all(axis=1))[: len(own)]  # a packet may be sent twice, byte by byte
        found.doubled += int(doubles.sum())
        own = own[~doubles]
        counters = own[:, 3] & 15
        step = (counters[1:].astype(int) - counters[:-1]) % 16
        told = (own[1:, 3] & 0x20 > 0) & (own[1:, 4] > 0) & (own[1:, 5] & 0x80 > 0)  # a discontinuity that the stream tells of
        found.lost += int(((step - 1) % 16)[~told].sum())
        lead = np.where(own[:, 3] & 0x20, own[:, 4].astype(int) + 1, 0)
        firsts = np.flatnonzero(own[:, 1] & 0x40)
        for k, begin in enumerate(firsts.tolist()):
            packets = own[begin : (firsts[k + 1] if k + 1 < len(firsts) else len(own))]
            skip = lead[begin : begin + len(packets)]
            middle = packets[1:-1] if not skip[1:-1].any() else None
            if middle is not None and len(packets) > 1:
                data = packets[0, 4 + skip[0] :].tobytes() + middle[:, 4:].tobytes() + packets[-1, 4 + skip[-1] :].tobytes()
            else:
                data = b"".join(row[4 + s :].tobytes() for row, s in zip(packets, skip.tolist(), strict=True))
            if data[:3] != b"\0\0\1" or len(data) < 9:
                found.broken += 1
                continue
            size = int.from_bytes(data[4:6], "big")
            found.broken += len(data) < 6 + size  # cut short, though the counters may not tell
            stamp = None
            if data[7] & 0x80:
                t = data[9:14]
                stamp = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
                found.stamps.append(stamp)
            if skip[0] > 1:
                flags = int(packets[0, 5])
                if flags & 0x40:
                    found.random_access.append((begin, stamp if stamp is not None else -1))
                if flags & 0x10:
                    c = packets[0, 6:11].tolist()
                    found.clocks.append(c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7)
            payloads.append(data[9 + data[8] : 6 + size if size else len(data)])
    found.payload = b"".join(payloads)
    return found


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data with bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def feature(stream: Stream) -> str:
    """What the stream holds, as compact JSON."""
    return json.dumps(
        {"programs": {str(k): {str(p): t for p, t in v.items()} for k, v in stream.programs.items()}, "packets": stream.packets, "lost": stream.lost, "doubled": stream.doubled, "broken": stream.broken,
         "pes": len(stream.stamps), "first_pts": stream.stamps[0] if stream.stamps else None, "last_pts": stream.stamps[-1] if stream.stamps else None, "random_access": len(stream.random_access)},
        separators=(",", ":"),
    )


MEDIA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


#: Bytes of media of an output batch, about.
BATCH = 4 << 20


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, media) of (id, text); batches are small whatever the texts' lengths."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for i, text in zip(*batch.columns, strict=True):
            data = (text.as_py() or "").encode()
            rows.append((i.as_py(), len(data), write(padded(data))))
            size += len(rows[-1][2])
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEDIA, strict=True)], schema=MEDIA)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEDIA, strict=True)], schema=MEDIA)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a transport stream, for a media column that is kept."""

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(_encoded, "id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """(id, payload, stamps, random_access, lost, doubled, broken) of a media column (id, media)."""
    schema = pa.schema([("id", pa.int64()), ("payload", pa.binary()), ("stamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())]))), ("lost", pa.int64()), ("doubled", pa.int64()), ("broken", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = read(m or b"")
                rows.append({"id": i, "payload": s.payload, "stamps": s.stamps, "random_access": [{"packet": a, "pts": t} for a, t in s.random_access], "lost": s.lost, "doubled": s.doubled, "broken": s.broken})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return media.select(F.col("id").cast("long").alias("id"), "media").mapInArrow(run, "id long, payload binary, stamps array<long>, random_access array<struct<packet long, pts long>>, lost long, doubled long, broken long")


POINTS = pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())]))
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("stamps", pa.list_(pa.int64())), ("random_access", POINTS)])
DIGEST_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, random_access array<struct<packet long, pts long>>"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (id, n_bytes, media) back; digests of what the media hold."""
    for batch in batches:
        rows = []
        for i, n, m in zip(*batch.columns, strict=True):
            media = m.as_py()
            s = read(media)
            rows.append((i.as_py(), n.as_py(), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.stamps, [{"packet": a, "pts": t} for a, t in s.random_access]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGEST, strict=True)], schema=DIGEST)


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, ...) of a kept media column (id, n_bytes, media)."""
    return media.select("id", "n_bytes", "media").mapInArrow(_digested, DIGEST_SQL)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """digests() of the media column of docs, which is kept in the shared folder while it is read back."""
    with Scratch(docs.sparkSession) as scratch:
        return settled(digests(scratch.keep(encode(docs, id_column, text_column), "media")))
