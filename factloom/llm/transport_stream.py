"""MPEG transport streams as a media column: multiplexing, and reading back with continuity checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm.common import in_small_batches, materialise, text_slices, texts_of

# Fixed values of the format.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
CLOCK = 90_000
PES_PREFIX = b"\x00\x00\x01"
PRIVATE_STREAM = 0xBD  # stream id of private data with a full PES header
PRIVATE_TYPE = 0x06  # stream type of PES packets that hold private data
# Parameters of what is written here.
PROGRAM, PMT_PID, DATA_PID = 1, 0x100, 0x101
UNIT = 16 * 1024  # payload bytes of an access unit
UNIT_TICKS = 3600  # time between access units, 1/25 s

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else (_c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 04C11DB7, not reflected."""
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ x])
    return c


def _table_packet(pid: int, table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = _table_packet(PAT_PID, 0, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])) + _table_packet(
    PMT_PID, 2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])
)


def timestamp_bytes(pts: int) -> bytes:
    """A presentation time in the five bytes of a PES header."""
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def multiplex(payload: bytes) -> bytes:
    """One program with one private stream: tables, then a PES packet for every access unit of UNIT bytes.

    The first transport packet of a unit has an adaptation field with the random-access flag; the last one is
    filled up by its adaptation field, so nothing is added to the payload.
    """
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pes = PES_PREFIX + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp_bytes(k * UNIT_TICKS % (1 << 33)) + unit
        first_room = PACKET - 6  # after the header and a two-byte adaptation field
        rest = max(0, len(pes) - first_room)
        n = 1 + -(-rest // (PACKET - 4))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter = (counter + n) % 16
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        data = np.frombuffer(pes, np.uint8)
        stuffing = max(0, first_room - len(pes))
        packets[0, 4], packets[0, 5] = 1 + stuffing, 0x40
        packets[0, 6 + stuffing :] = data[: first_room - stuffing]
        if n > 1:
            whole = data[first_room : first_room + (n - 2) * (PACKET - 4)]
            packets[1 : n - 1, 4:] = whole.reshape(n - 2, PACKET - 4)
            last = data[first_room + (n - 2) * (PACKET - 4) :]
            fill = PACKET - 4 - len(last)
            if fill:
                packets[n - 1, 3] |= 0x20
                packets[n - 1, 4] = fill - 1
                if fill > 1:
                    packets[n - 1, 5] = 0
            packets[n - 1, 4 + fill :] = last
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(packets: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """The whole table sections that start in the rows' packets, in order, if their checksums are right.

    A section may go on over as many packets as it needs; a packet with a new one first ends the one before, as its
    pointer says.  A jump of the counter discards the section under way.
    """
    out, open_, last = [], b"", None
    for i in rows:
        body, counter = packets[i, offsets[i] :].tobytes(), int(packets[i, 3]) & 15
        if counter == last:
            continue
        if last is not None and counter != (last + 1) % 16:
            open_ = b""
        last = counter
        if packets[i, 1] & 0x40 and body:
            rest, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            if open_:
                out.append(open_ + rest)
            open_ = b""
        elif not open_:
            continue
        open_ += body
        while len(open_) >= 3 and open_[0] != 0xFF:
            size = 3 + ((open_[1] & 0x0F) << 8 | open_[2])
            if len(open_) < size:
                break
            out.append(open_[:size])
            open_ = open_[size:]
        if open_[:1] == b"\xff":
            open_ = b""
    whole = []
    for x in out:
        size = 3 + ((x[1] & 0x0F) << 8 | x[2]) if len(x) >= 3 else 0
        if 12 <= size <= len(x) and section_crc(x[: size - 4]) == int.from_bytes(x[size - 4 : size], "big"):
            whole.append(x[:size])
    return whole


def _elementary_streams(packets: np.ndarray, offsets: np.ndarray, pids: np.ndarray) -> list[tuple[int, int, int]]:
    """Program, packet id and type of every elementary stream that the association and map tables name."""
    found: dict[tuple[int, int], int] = {}
    for pat in (x for x in _sections(packets, offsets, np.flatnonzero(pids == PAT_PID)) if x[0] == 0):
        for i in range(8, len(pat) - 7, 4):
            program, pid = int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF
            for pmt in (x for x in _sections(packets, offsets, np.flatnonzero(pids == pid)) if program and x[0] == 2 and int.from_bytes(x[3:5], "big") == program):
                at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
                while at + 5 <= len(pmt) - 4:
                    found.setdefault((program, int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF), pmt[at])
                    at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF)
    return [(program, pid, kind) for (program, pid), kind in found.items()]


def demultiplex(stream: bytes) -> dict:
    """Read a stream back: packets, and streams with the payload, timestamps, random-access units and error counts of
    every elementary stream of every program, in the order of the tables.

    A jump of the continuity counter that no discontinuity flag announces, or the transport error flag, counts as an
    error and discards the unit it falls in, as does a unit with fewer bytes than its header says; a packet repeated once
    is legal and skipped.  Damaged or foreign bytes
    give no streams, never an error.
    """
    n = len(stream) // PACKET
    packets = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    packets = packets[packets[:, 0] == SYNC] if n else packets
    found = {"packets": len(packets), "streams": []}
    if not len(packets):
        return found
    pids = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    adapted = packets[:, 3] & 0x20 > 0
    offsets = np.where(adapted, np.minimum(5 + packets[:, 4].astype(np.int64), PACKET), 4)
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    for program, pid, kind in _elementary_streams(packets, offsets, pids):
        rows = np.flatnonzero((pids == pid) & (packets[:, 3] & 0x10 > 0))
        found["streams"].append({"program": program, "pid": pid, "stream_type": kind} | _units(packets, offsets, flags, rows))
    return found


def _units(packets: np.ndarray, offsets: np.ndarray, flags: np.ndarray, rows: np.ndarray) -> dict:
    """Access units of one elementary stream, put together from the packets of the rows."""
    out = {"units": 0, "cc_errors": 0, "pts": [], "random_access": [], "payload": b""}
    if not len(rows):
        return out
    counters = packets[rows, 3].astype(np.int64) & 15
    again = np.zeros(len(rows), bool)
    again[1:] = (np.diff(counters) == 0) & (packets[rows[1:]] == packets[rows[:-1]]).all(axis=1)
    rows, counters = rows[~again], counters[~again]
    wrong = packets[rows, 1] & 0x80 > 0
    wrong[1:] |= ((np.diff(counters) - 1) % 16 > 0) & (flags[rows[1:]] & 0x80 == 0)
    out["cc_errors"] = int(wrong.sum())
    begins = packets[rows, 1] & 0x40 > 0
    unit_of = np.cumsum(begins) - 1
    spoilt = set(unit_of[wrong & ~begins].tolist()) | set((unit_of[wrong & begins] - 1).tolist())
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(rows))[: len(starts)]
    parts = []
    for k, (x, y) in enumerate(zip(starts, ends, strict=True)):
        own = rows[x:y]
        off = offsets[own]
        plain = packets[own[1:-1], 4:].tobytes() if len(own) > 2 and (off[1:-1] == 4).all() else b"".join(packets[i, o:].tobytes() for i, o in zip(own[1:-1], off[1:-1], strict=True))
        pes = packets[own[0], off[0] :].tobytes() + plain + (packets[own[-1], off[-1] :].tobytes() if len(own) > 1 else b"")
        if pes[:3] != PES_PREFIX or len(pes) < 9 or k in spoilt:
            out["cc_errors"] += k not in spoilt
            continue
        size = int.from_bytes(pes[4:6], "big")
        if len(pes) < 6 + size:  # the end of the unit is lost
            out["cc_errors"] += 1
            continue
        out["pts"].append(read_timestamp(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None)
        if flags[own[0]] & 0x40:
            out["random_access"].append(out["units"])
        out["units"] += 1
        parts.append(pes[9 + pes[8] : 6 + size] if size else pes[9 + pes[8] :])
    out["payload"] = b"".join(parts)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, with zeros up to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a transport stream of the text's padded bytes; a null text counts as empty."""
    in_small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            made = [payload_of(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([multiplex(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_STREAM = {"program": pa.int32(), "pid": pa.int32(), "stream_type": pa.int32(), "units": pa.int32(), "cc_errors": pa.int32(), "pts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int32()), "payload": pa.binary()}
_STREAM_DDL = "program int, pid int, stream_type int, units int, cc_errors int, pts array<long>, random_access array<int>, payload binary"


def read_media(media: DataFrame) -> DataFrame:
    """What a media column of transport streams holds: a row for every row of media with its other columns, packets,
    and streams, an array of the elementary streams with payload, timestamps (90,000 a second; null where a unit has
    none) and the numbers of random-access units.  A null stream counts as empty; a column of media that is called
    packets or streams is replaced."""
    in_small_batches(media.sparkSession)
    kept = [f for f in media.schema.fields if f.name.lower() not in ("media", "packets", "streams")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = [demultiplex(x or b"") for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], pa.array([f["packets"] for f in found], pa.int64()), pa.array([f["streams"] for f in found], pa.list_(pa.struct(list(_STREAM.items()))))], names=[*[f.name for f in kept], "packets", "streams"])

    schema = StructType([*kept, *StructType.fromDDL(f"packets long, streams array<struct<{_STREAM_DDL}>>").fields])
    return media.select(*[f.name for f in kept], "media").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a stream in a table, read the stored bytes back, and return digests of both.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pts and
    random_access.  A null text counts as empty; equal texts have equal values; repeated rows are handled each; an
    empty table gives an empty result; other columns of docs are not read.
    """
    media = materialise(store_media(docs), "media")
    media = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    s = F.col("streams")[0]
    back = read_media(media).withColumn("payload", F.coalesce(s["payload"], F.lit(b"")))
    pts = s["pts"]
    seconds = F.format_string("%.3f", F.coalesce((F.element_at(pts, -1) - pts[0]) / CLOCK, F.lit(0.0)))
    feature = F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in ("program=", s["program"].cast("string"), ";pid=", s["pid"].cast("string"), ";packets=", F.col("packets").cast("string"), ";units=", s["units"].cast("string"), ";errors=", s["cc_errors"].cast("string"), ";random_access=", F.size(s["random_access"]).cast("string"), ";seconds=", seconds)])
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), pts.alias("pts"), s["random_access"].alias("random_access"))
