"""Media columns: a payload stored as an MPEG transport stream and read back.

The stream has a program association table, a program map table and one elementary stream of private data. Its units
are UNIT bytes (the last may be shorter), each in one packetised packet with a timestamp; every RAP_EVERY-th unit is a
random-access point. Reading parses the tables, checks their CRC and the continuity counters, reassembles the packets
and gives the timestamps and places of the random-access points.

Null and empty texts give a payload of one padding block. Equal texts give equal rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, out_schema, raw_text

PACKET, BLOCK = 188, 576
UNIT, RAP_EVERY, TICKS = 4 * BLOCK, 4, 3600
PMT_PID, DATA_PID, PROGRAM, PRIVATE = 0x1000, 0x0100, 1, 0x06
HEADER = 14  # of a packetised packet with a timestamp


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(table: int, key: int, body: bytes) -> bytes:
    """A table section in a packet's payload: pointer, header, body, CRC, padding."""
    head = bytes([table]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + key.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    whole = head + body
    return (b"\0" + whole + crc32_mpeg(whole).to_bytes(4, "big")).ljust(PACKET - 4, b"\xff")


def tables() -> bytes:
    pat = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
    return b"\x47" + (0x4000).to_bytes(2, "big") + b"\x10" + pat + b"\x47" + (0x4000 | PMT_PID).to_bytes(2, "big") + b"\x10" + pmt


_TABLES = tables()


def units(data: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets of units (rows of data, equal in length), numbered from `first`; counter: packets of this stream so far."""
    n, size = data.shape
    pes = np.zeros((n, HEADER + size), np.uint8)
    length = size + 8
    pes[:, :9] = [0, 0, 1, 0xBD, length >> 8, length & 255, 0x80, 0x80, 5]
    t = (first + np.arange(n, dtype=np.int64)) * TICKS
    pes[:, 9:14] = np.stack([0x21 | (t >> 30 & 7) << 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1], axis=1)
    pes[:, 14:] = data
    room = PACKET - 4
    count = -(-(2 + HEADER + size) // room)  # the first packet also has two bytes of adaptation
    out = np.full((n, count, PACKET), 255, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | (counter + np.arange(n * count).reshape(n, count)) & 15
    out[:, 0, 3] |= 0x20
    spare = count * room - 2 - HEADER - size
    at = 0
    for k in range(count):
        stuffing = spare if k == count - 1 else 0
        skip = (2 if k == 0 else 0) + stuffing
        if skip:
            out[:, k, 3] |= 0x20
            out[:, k, 4] = skip - 1
            if skip > 1:
                out[:, k, 5] = 0
        take = room - skip
        out[:, k, 4 + skip :] = pes[:, at : at + take]
        at += take
    out[(first + np.arange(n)) % RAP_EVERY == 0, 0, 5] = 0x40
    return out.reshape(-1, PACKET)


def write(payload: bytes) -> bytes:
    data = np.frombuffer(payload, np.uint8)
    full = len(data) // UNIT
    a = units(data[: full * UNIT].reshape(full, UNIT), 0, 0)
    rest = data[full * UNIT :]
    b = units(rest.reshape(1, -1), full, len(a)) if len(rest) else a[:0]
    return _TABLES + a.tobytes() + b.tobytes()


def _table(packets: np.ndarray, pid: np.ndarray, want: int) -> bytes:
    """Body of the first section of a table, its CRC checked."""
    p = packets[np.flatnonzero(pid == want)[0]].tobytes()
    start = 5 + p[4]
    stop = start + 3 + (int.from_bytes(p[start + 1 : start + 3], "big") & 0x0FFF)
    if crc32_mpeg(p[start:stop]):
        raise ValueError("a table's CRC is wrong")
    return p[start + 8 : stop - 4]


def read(stream: bytes) -> tuple[bytes, list[int], list[int], list[int], int]:
    """Payload, every unit's timestamp, the random-access points' timestamps and payload places, and discontinuities."""
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a packet does not start with the sync byte")
    pid = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    pat = _table(packets, pid, 0)
    pmt = _table(packets, pid, int.from_bytes(pat[2:4], "big") & 0x1FFF)
    own = packets[pid == int.from_bytes(pmt[5:7], "big") & 0x1FFF]
    counters = own[:, 3].astype(np.int64) & 15
    breaks = int((np.diff(counters) & 15 != 1).sum())
    adapted = own[:, 3] & 0x20 > 0
    start = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    first = own[:, 1] & 0x40 > 0
    at, rows = start[first], np.flatnonzero(first)
    field = lambda i: own[rows, at + i].astype(np.int64)
    pts = (field(9) >> 1 & 7) << 30 | field(10) << 22 | field(11) >> 1 << 15 | field(12) << 7 | field(13) >> 1
    start[first] += 9 + field(8)
    body = own[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
    places = np.cumsum(PACKET - start) - (PACKET - start)
    random = first & adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    return body, pts.tolist(), pts[random[rows]].tolist(), places[random].tolist(), breaks


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b"\xff")


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_stream: bool = False) -> DataFrame:
    """keep, n_bytes, what was read back of the stored stream (payload_bytes, payload_sha256, tail_crc32), media_bytes,
    media_sha256, random_access (timestamp and place of each point), feature, and the stream itself if asked for."""
    names = list(keep)
    point = pa.struct([("pts", pa.int64()), ("at", pa.int64())])
    extra = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("random_access", pa.list_(point)), ("feature", pa.string())]
    extra += [("media", pa.binary())] * with_stream

    def row(v: bytes) -> tuple:
        media = write(padded(v))
        body, pts, rap, places, breaks = read(media)
        feature = f"units={len(pts)} pts={pts[0]}-{pts[-1]} random_access={len(rap)} last_random_access={rap[-1]}@{places[-1]} discontinuities={breaks}"
        found = len(v), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(media), hashlib.sha256(media).hexdigest(), [{"pts": p, "at": a} for p, a in zip(rap, places, strict=True)], feature
        return (*found, media) if with_stream else found

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [row(v) for v in batch.column(len(names)).to_pylist()]
            new = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), extra, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, *(n for n, _ in extra)])

        return step

    schema = out_schema(docs, names, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, random_access array<struct<pts: long, at: long>>, feature string" + ", media binary" * with_stream)
    return map_arrow(docs.select(*names, raw_text(F.col(text)).alias("_t")), schema, make, len(names))
