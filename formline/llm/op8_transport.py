"""Media columns: MPEG transport streams (ISO/IEC 13818-1) as a lossless container of bytes.

A payload becomes one elementary stream of private data (stream type 6) in a program of its own. Access units of UNIT bytes go into
packetised elementary packets with a presentation timestamp each; a program association table and a program map table
stand before every RANDOM_EVERY-th unit, whose first transport packet carries the random access indicator and a clock
reference. The reader trusts nothing but the packets: it finds the map table from the association table and the stream from
the map table, checks both tables' CRC, follows the continuity counters, reassembles the elementary packets, and returns
payload, timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from formline.llm.common import arrow_map, documents, materialize, texts, type_of

# Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 0, 0x1FFF, 0x06, 0xBD
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT, RANDOM_EVERY, TICKS = 8192, 8, 3600
MULTIPLE = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        x = byte << 24
        for _ in range(8):
            x = (x << 1 ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
        table.append(x)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    x = 0xFFFFFFFF
    for byte in data:
        x = (x << 8 & 0xFFFFFFFF) ^ _CRC[x >> 24 ^ byte]
    return x


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)))


def padded(data: bytes) -> bytes:
    """data and as many bytes 0 as make its length a positive multiple of 64."""
    return data.ljust(max(MULTIPLE, -(-len(data) // MULTIPLE) * MULTIPLE), b"\0")


def _timestamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29 & 0x0E), (pts >> 14 & 0xFFFE) | 1, (pts << 1 & 0xFFFE) | 1)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts, random = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1, k % RANDOM_EVERY == 0
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + _timestamp(pts) + unit
        field_ = b""
        if random:
            for packet in (_PAT, _PMT):
                packet = packet.copy()
                packet[3] |= tables & 15
                out.append(packet)
            tables += 1
            field_ = struct.pack(">BBIH", 7, 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00)
        room = PACKET - 4 - len(field_)
        first, rest = pes[:room], pes[room:]
        full, last = divmod(len(rest), PACKET - 4)
        n = 1 + full + (last > 0)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, :3] = (SYNC, ES_PID >> 8, ES_PID & 255)
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n) & 15)
        counter = counter + n & 15
        packets[0] = _fill(packets[0, :4].tobytes(), field_, first)
        if full:
            packets[1 : 1 + full, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, PACKET - 4)
        if last:
            packets[-1] = _fill(packets[-1, :4].tobytes(), b"", rest[full * (PACKET - 4) :])
        out.append(packets.reshape(-1))
    return b"".join(x.tobytes() for x in out)


def _fill(head: bytes, adaptation: bytes, data: bytes) -> np.ndarray:
    """One packet; what data leaves free is stuffed in the adaptation field."""
    free = PACKET - 4 - len(adaptation) - len(data)
    if free:
        if not adaptation:
            adaptation, free = (b"\0", 0) if free == 1 else (b"\1\0", free - 2)
        adaptation = bytes([adaptation[0] + free]) + adaptation[1:] + b"\xff" * free
    flag = 0x30 if adaptation else 0x10
    return np.frombuffer(head[:3] + bytes([head[3] & 15 | flag]) + adaptation + data, np.uint8)


@dataclass
class Stream:
    """What a transport stream holds. errors counts breaks of the continuity counters and damaged tables."""

    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # indices of units
    packets: int = 0
    tables: int = 0
    errors: int = 0


def _sections(packets: np.ndarray) -> Iterator[bytes]:
    for p in packets:
        raw = p.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        at += 1 + raw[at]
        yield raw[at : at + 3 + (struct.unpack_from(">H", raw, at + 1)[0] & 0x0FFF)]


def demux(data: bytes, program: int | None = None) -> Stream:
    """Parse a transport stream: the first stream of a program, or of the first one. A length that is no multiple of 188 or a lost sync byte raises ValueError.

    Null packets are passed over. Packets without payload do not count on; a packet sent twice is taken once; a jump that its packet announces is no error.
    """
    if len(data) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if not (p[:, 0] == SYNC).all():
        raise ValueError("sync byte lost")
    out = Stream(packets=len(p))
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    has_payload, has_field = (p[:, 3] & 0x10) > 0, (p[:, 3] & 0x20) > 0
    jumps = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x80) > 0)
    taken = has_payload & (pid != NULL_PID)
    for own in np.unique(pid[taken]):
        at = np.flatnonzero(taken & (pid == own))
        again = np.append(False, (p[at[1:]] == p[at[:-1]]).all(axis=1))
        taken[at[again]] = False
        at = at[~again]
        c = (p[at, 3] & 15).astype(np.int32)
        out.errors += int((((c[1:] - c[:-1]) % 16 != 1) & ~jumps[at[1:]]).sum())
    p, pid = p[taken], pid[taken]

    def tables(at: int, table_id: int) -> list[bytes]:
        good = []
        for s in _sections(p[pid == at]):
            if s and s[0] == table_id and crc32_mpeg(s) == 0:
                good.append(s)
            else:
                out.errors += 1
        out.tables += len(good)
        return good

    programs = [struct.unpack_from(">HH", s, i) for s in tables(PAT_PID, 0)[:1] for i in range(8, len(s) - 4, 4)]
    streams = []
    for map_pid in [x & 0x1FFF for number, x in programs if number and program in (None, number)]:
        for s in tables(map_pid, 2)[:1]:
            at = 12 + (struct.unpack_from(">H", s, 10)[0] & 0x0FFF)
            while at < len(s) - 4:
                kind, own, info = struct.unpack_from(">BHH", s, at)
                streams.append((kind, own & 0x1FFF))
                at += 5 + (info & 0x0FFF)
    if not streams:
        return out
    es = p[pid == streams[0][1]]
    has_field = (es[:, 3] & 0x20) > 0
    start = np.where(has_field, 5 + es[:, 4].astype(np.int32), 4)
    body = es[np.arange(PACKET)[None, :] >= start[:, None]]  # row by row, so in order
    begins = np.concatenate([[0], np.cumsum(PACKET - start)])
    first = np.flatnonzero(es[:, 1] & 0x40)
    random = has_field & (es[:, 4] > 0) & ((es[:, 5] & 0x40) > 0)
    raw, ends = body.tobytes(), [*begins[first[1:]], begins[-1]][: len(first)]
    units = []
    for k, (i, end) in enumerate(zip(first, ends, strict=True)):
        at = int(begins[i])
        if raw[at : at + 3] != b"\0\0\1":
            out.errors += 1
            continue
        _, length, _, flags, n = struct.unpack_from(">BHBBB", raw, at + 3)
        if flags & 0x80:
            a, b, c = struct.unpack_from(">BHH", raw, at + 9)
            out.timestamps.append((a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1)
        if random[i]:
            out.random_access.append(k)
        units.append(raw[at + 9 + n : min(at + 6 + length, int(end))])
    out.payload = b"".join(units)
    return out


def feature(s: Stream) -> str:
    """Packets, tables, units, first and last timestamp, random-access points and errors as text."""
    return f"packets={s.packets};tables={s.tables};units={len(s.timestamps)};pts={s.timestamps[0] if s.timestamps else -1}-{s.timestamps[-1] if s.timestamps else -1};random={len(s.random_access)};errors={s.errors}"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the transport stream of the text's padded UTF-8) of every row.

    A null or empty text is 64 bytes 0. Repeated rows each get their row, equal texts equal streams; an empty table gives an empty
    result; other columns are not read.
    """

    def f(batch: pa.RecordBatch) -> dict:
        raw = texts(batch)
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in raw], "media": [mux(padded(x)) for x in raw]}

    return arrow_map(docs.select("doc_id", "text"), f, f"doc_id {type_of(docs, 'doc_id')}, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (read from the stream), timestamps, random_access (unit numbers), packets, tables, errors of every row of encode()."""
    names = "payload timestamps random_access packets tables errors".split()

    def f(batch: pa.RecordBatch) -> dict:
        streams = [demux(x) for x in batch.column("media").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {k: [getattr(s, k) for s in streams] for k in names}

    return arrow_map(media, f, f"doc_id {type_of(media, 'doc_id')}, n_bytes long, payload binary, timestamps array<long>, random_access array<int>, packets long, tables long, errors long")


def digest(media: DataFrame) -> DataFrame:
    """The query's columns, from the streams alone."""

    def f(batch: pa.RecordBatch) -> dict:
        raw = batch.column("media").to_pylist()
        streams = [demux(x) for x in raw]
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": [len(s.payload) for s in streams],
            "payload_sha256": [hashlib.sha256(s.payload).hexdigest() for s in streams],
            "tail_crc32": [zlib.crc32(s.payload[-MULTIPLE:]) for s in streams],
            "media_bytes": [len(x) for x in raw],
            "media_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
            "feature": [feature(s) for s in streams],
        }

    return arrow_map(media, f, f"doc_id {type_of(media, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as transport streams in a table on the shared store, and read back from it."""
    return digest(materialize(encode(documents(spark, sf_dir)), "op8-media"))
