"""Media columns: MPEG transport streams.

``mux`` stores a binary payload as a transport stream: a program association
table, a program map table, and elementary packets whose headers carry a
timestamp and whose first transport packet is marked as a random-access point.
``demux`` reads such a stream back: it follows the program tables, checks the
continuity counters, reassembles the elementary packets and returns payload,
timestamps and random-access points.  It reads any stream: header lengths are
followed, tables may span packets, packets without payload and repeated packets
are no faults.  Both are row-wise, so no shuffle.

Null media give null outputs; a null payload is stored as an empty one.  A value
that is no transport stream, or whose program tables are damaged, has an
``error`` and null for the rest.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the transport stream format.
PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x0100, 0x0101
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK, STEP = 90_000, 3_600
UNIT = 64
PES_HEADER = 14
PES_PAYLOAD = 960 * UNIT  # an elementary packet's length field has 16 bits


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (5 + len(body) + 4), ident, 0xC1, 0, 0)
    section = head + body + struct.pack(">I", crc_mpeg(head + body))
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _section_packet(PAT_PID, 0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)) + _section_packet(
    PMT_PID, 0x02, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000)
)


def _timestamp(t: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (t >> 29) & 0x0E, (t >> 14) & 0xFFFE | 1, (t << 1) & 0xFFFE | 1)


def _clock(t: int) -> bytes:
    """A program clock reference at a timestamp."""
    return struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)


def _packets(pes: bytes, counter: int, clock: int) -> np.ndarray:
    """The transport packets of one elementary packet; the first carries the clock."""
    size = len(pes)
    first = min(BODY - 8, size)
    rest = -(-(size - first) // BODY)
    out = np.full((1 + rest, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = ES_PID >> 8
    out[:, 2] = ES_PID & 0xFF
    out[:, 3] = 0x10 | ((counter + np.arange(1 + rest)) & 15)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4] = BODY - 1 - first
    out[0, 5] = 0x50  # random-access point, clock reference
    out[0, 6:12] = np.frombuffer(_clock(clock), np.uint8)
    raw = np.frombuffer(pes, np.uint8)
    out[0, PACKET - first :] = raw[:first]
    full = (size - first) // BODY
    if full:
        out[1 : 1 + full, 4:] = raw[first : first + full * BODY].reshape(full, BODY)
    if rest > full:
        tail = size - first - full * BODY
        out[-1, 3] |= 0x20
        out[-1, 4] = BODY - 1 - tail
        if tail < BODY - 1:
            out[-1, 5] = 0
        out[-1, PACKET - tail :] = raw[size - tail :]
    return out


def mux_bytes(payload: bytes) -> bytes:
    parts, counter = [TABLES], 0
    for k, at in enumerate(range(0, max(1, len(payload)), PES_PAYLOAD)):
        piece = payload[at : at + PES_PAYLOAD]
        head = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM_1, PES_HEADER - 6 + len(piece), 0x80, 0x80, 5)
        packets = _packets(head + _timestamp(k * STEP % 2**33) + piece, counter, k * STEP % 2**33)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


def _starts(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; ``PACKET`` where it has none."""
    control = packets[:, 3] >> 4 & 3
    extended = 5 + packets[:, 4].astype(np.int32)
    return np.where(control == 1, 4, np.where(control == 3, np.minimum(extended, PACKET), PACKET))


def _sections(packets: np.ndarray, table: int) -> list[bytes]:
    """The sections of one table id, each put together from as many packets as it takes."""
    out: list[bytes] = []
    held: bytearray | None = None
    for raw, start in zip(packets, _starts(packets).tolist(), strict=True):
        body = raw[start:].tobytes()
        if not body:
            continue
        parts = [body]
        if raw[1] & 0x40:  # a pointer field: what it skips ends the section before
            parts = [body[1 : 1 + body[0]], body[1 + body[0] :]]
        for k, part in enumerate(parts):
            if k == len(parts) - 1 and raw[1] & 0x40:
                held = bytearray()
            if held is None:
                continue
            held += part
            while len(held) >= 3 and held[0] != 0xFF:
                size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0x0FFF)
                if len(held) < size:
                    break
                out.append(bytes(held[:size]))
                del held[:size]
            if held and held[0] == 0xFF:
                held = None  # stuffing up to the next pointer
    found = [x for x in out if x[0] == table and not crc_mpeg(x)]
    if not found:
        raise ValueError("damaged program table")
    return found


def _programs(sections: list[bytes]) -> list[int]:
    """PIDs of the program maps; program 0 is the network's table."""
    pairs = [struct.unpack_from(">HH", x, k) for x in sections for k in range(8, len(x) - 4, 4)]
    return [pid & 0x1FFF for program, pid in pairs if program]


def _streams(section: bytes) -> list[tuple[int, int]]:
    """(stream type, PID) of a program map, whose descriptors are skipped by their lengths."""
    at, out = 12 + (struct.unpack_from(">H", section, 10)[0] & 0x0FFF), []
    while at + 5 <= len(section) - 4:
        kind, pid, size = struct.unpack_from(">BHH", section, at)
        out.append((kind, pid & 0x1FFF))
        at += 5 + (size & 0x0FFF)
    return out


def _pes(raw: bytes) -> tuple[bytes, int | None] | None:
    """(payload, timestamp) of an elementary packet; None for a damaged or cut one."""
    if len(raw) < 9 or raw[:3] != b"\0\0\1":
        return None
    size, flags, more = struct.unpack_from(">H", raw, 4)[0], raw[7], raw[8]
    end = 6 + size if size else len(raw)  # a size of 0: up to the next one
    if end > len(raw) or 9 + more > end:
        return None
    stamp = None
    if flags & 0x80 and more >= 5:
        a, b, c = struct.unpack_from(">BHH", raw, 9)
        stamp = (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1
    return raw[9 + more : end], stamp


def demux_bytes(media: bytes) -> dict:
    """What the first stream of the first program holds.

    A packet repeated once as it is counts once; packets without payload leave
    the counter as it is; after an announced discontinuity any counter is right.
    An elementary packet that isn't whole is left out and counted.
    """
    if len(media) % PACKET or len(media) < 2 * PACKET:
        raise ValueError("not a transport stream")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("not a transport stream")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    maps = _programs(_sections(packets[pid == PAT_PID], 0x00))
    streams = _streams(_sections(packets[pid == maps[0]], 0x02)[0]) if maps else []
    if not streams:
        raise ValueError("damaged program table")
    kind, es = streams[0]
    own = packets[pid == es]
    start, counter = _starts(own), own[:, 3].astype(np.int16) & 15
    extended = ((own[:, 3] & 0x20) > 0) & (own[:, 4] > 0)
    announced = extended & ((own[:, 5] & 0x80) > 0)
    full = np.flatnonzero(start < PACKET)
    step = np.diff(counter[full]) % 16
    twin = np.concatenate([[False], step == 0]) if len(full) else np.zeros(0, bool)
    if twin.any():  # one copy of a packet is allowed, all but its clock reference alike
        at = np.flatnonzero(twin)
        same = np.array([bool((own[full[i], start[full[i]] :] == own[full[i - 1], start[full[i]] :]).all()) and start[full[i]] == start[full[i - 1]] and not twin[i - 1] for i in at])
        twin[at[~same]] = False
    held = full[~twin]
    gaps = np.diff(counter[held]) % 16 != 1
    # an announcement stands in the packet itself or in one without payload since the last
    told = np.concatenate([[0], np.cumsum(announced)])
    gaps &= told[held[1:] + 1] == told[held[:-1] + 1]
    begins = (own[held, 1] & 0x40) > 0
    marked = extended[held] & ((own[held, 5] & 0x40) > 0)
    body = own[held][np.arange(PACKET) >= start[held][:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(PACKET - start[held])])
    lost = np.concatenate([[False], gaps]) if len(held) else np.zeros(0, bool)
    heads = np.flatnonzero(begins)
    pieces, stamps, random_access, damaged = [], [], [], 0
    for i, k in enumerate(heads.tolist()):
        upto = int(heads[i + 1]) if i + 1 < len(heads) else len(held)
        got = None if lost[k + 1 : upto].any() else _pes(body[ends[k] : ends[upto]])
        if got is None:
            damaged += 1
            continue
        pieces.append(got[0])
        stamps.append(got[1])
        if marked[k]:
            random_access.append(int(held[k]))
    return {
        "payload": b"".join(pieces),
        "timestamps": stamps,
        "random_access": random_access,
        "packets": len(packets),
        "stream_type": int(kind),
        "continuity_errors": int(gaps.sum()),
        "damaged": damaged,
    }


def _read(media: bytes) -> dict:
    try:
        return demux_bytes(media)
    except ValueError as e:
        return {"error": str(e)}


DEMUXED = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("timestamps", T.ArrayType(T.LongType())),
        T.StructField("random_access", T.ArrayType(T.LongType())),
        T.StructField("packets", T.LongType()),
        T.StructField("stream_type", T.IntegerType()),
        T.StructField("continuity_errors", T.LongType()),
        T.StructField("damaged", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def _batched(df: DataFrame, source: str, out: T.StructField, convert, arrow_type: pa.DataType) -> DataFrame:
    """``df`` with one more column: ``convert`` of each value of ``source``."""
    if out.name in df.columns:
        raise ValueError(f"there is a column {out.name} already")
    schema, at = T.StructType([*df.schema.fields, out]), df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounds memory where texts are long
                part = batch.slice(k, 256)
                made = [convert(x.as_py()) for x in part.column(at)]
                fields = [*part.schema, pa.field(out.name, arrow_type)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, arrow_type)], schema=pa.schema(fields))

    places = [f"c{k}" for k in range(len(df.columns))]  # an Arrow function takes no columns with dots in their names
    return df.toDF(*places).mapInArrow(run, schema)


def mux(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """``df`` with the transport stream of the binary column ``payload``."""
    return _batched(df, payload, T.StructField(media, T.BinaryType()), lambda x: mux_bytes(x or b""), pa.binary())


def demux(df: DataFrame, media: str = "media", out: str = "stream") -> DataFrame:
    """``df`` with a struct ``out`` (see ``DEMUXED``) of what ``media`` holds."""
    kind = pa.struct(
        [
            ("payload", pa.binary()),
            ("timestamps", pa.list_(pa.int64())),
            ("random_access", pa.list_(pa.int64())),
            ("packets", pa.int64()),
            ("stream_type", pa.int32()),
            ("continuity_errors", pa.int64()),
            ("damaged", pa.int64()),
            ("error", pa.string()),
        ]
    )
    return _batched(df, media, T.StructField(out, DEMUXED), lambda x: None if x is None else _read(x), kind)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a transport stream, read back and described.

    Null and empty texts become one unit of zero bytes; equal texts give equal
    values, as nothing but the text enters the stream.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = F.octet_length(text)
    pad = F.when(size == 0, UNIT).otherwise(F.pmod(-size, F.lit(UNIT)))
    zeros = F.expr(f"unhex(repeat('00', {UNIT}))")
    padded = F.concat(text, F.substring(zeros, F.lit(1), pad))
    stored = mux(docs.select("doc_id", size.cast("long").alias("n_bytes"), padded.alias("__el_payload")), "__el_payload")
    read = demux(stored.drop("__el_payload"))
    s = F.col("stream")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(s["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(s["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(s["payload"], -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.format_string(
            "packets=%d;pes=%d;pts=%d-%d;rap=%d;type=%d;cc_errors=%d;damaged=%d",
            s["packets"], F.size(s["timestamps"]), F.element_at(s["timestamps"], 1), F.element_at(s["timestamps"], -1),
            F.size(s["random_access"]), s["stream_type"], s["continuity_errors"], s["damaged"],
        ).alias("feature"),
    )
