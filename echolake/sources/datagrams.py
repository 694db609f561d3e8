"""Binary sensor datagrams as rows: channel-state frames and vitals packets.

A packet that can't be read stays as a row with ``error``, so nothing is lost;
filter it where only good ones are wanted.  Null content is an error too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the wire formats.
FRAME_MAGIC, VITALS_MAGIC = 0xC5110001, 0xC5110002
SIBLING_MAGICS = (0xC5110003, 0xC5110004, 0xC5110005, 0xC5110006, 0xC5110007)
FRAME_HEADER, VITALS_SIZE = struct.Struct("<IBBHIIbbBB"), 32
MAX_ANTENNAS, MAX_TONES = 4, 256

_FRAME = pa.schema([
    ("node_id", pa.int32()), ("n_antennas", pa.int32()), ("n_tones", pa.int32()), ("freq_mhz", pa.int64()), ("sequence", pa.int64()),
    ("rssi", pa.int32()), ("noise_floor", pa.int32()), ("ppdu_type", pa.int32()), ("flags", pa.int32()),
    ("amplitude", pa.list_(pa.float64())), ("phase", pa.list_(pa.float64())), ("error", pa.string()),
])
FRAME_SCHEMA = "node_id int, n_antennas int, n_tones int, freq_mhz long, sequence long, rssi int, noise_floor int, ppdu_type int, flags int, amplitude array<double>, phase array<double>, error string"
_VITALS = pa.schema([
    ("node_id", pa.int32()), ("presence", pa.bool_()), ("fall_detected", pa.bool_()), ("motion", pa.bool_()), ("breathing_rate_bpm", pa.float64()), ("heartrate_bpm", pa.float64()),
    ("rssi", pa.int32()), ("n_persons", pa.int32()), ("motion_energy", pa.float32()), ("presence_score", pa.float32()), ("timestamp_ms", pa.int64()), ("error", pa.string()),
])
VITALS_SCHEMA = "node_id int, presence boolean, fall_detected boolean, motion boolean, breathing_rate_bpm double, heartrate_bpm double, rssi int, n_persons int, motion_energy float, presence_score float, timestamp_ms long, error string"


def parse_frame(raw: bytes | None) -> dict:
    magic = int.from_bytes(raw[:4], "little") if raw and len(raw) >= 4 else None
    if magic in (VITALS_MAGIC, *SIBLING_MAGICS):
        return {"error": f"other packet {magic:#x}"}
    if raw is None or len(raw) < FRAME_HEADER.size:
        return {"error": "too short"}
    if magic != FRAME_MAGIC:
        return {"error": "wrong magic"}
    _, node, antennas, tones, freq, seq, rssi, noise, ppdu, flags = FRAME_HEADER.unpack_from(raw)
    if not 1 <= antennas <= MAX_ANTENNAS or tones > MAX_TONES:
        return {"error": "counts out of range"}
    n = antennas * tones
    if len(raw) < FRAME_HEADER.size + 2 * n:
        return {"error": "too short"}
    i, q = np.frombuffer(raw, np.int8, 2 * n, FRAME_HEADER.size).astype(float).reshape(n, 2).T
    values = (node, antennas, tones, freq, seq, rssi, noise, ppdu, flags, np.hypot(i, q), np.arctan2(q, i), None)
    return dict(zip(_FRAME.names, values, strict=True))


def parse_vitals(raw: bytes | None) -> dict:
    if raw is None or len(raw) < VITALS_SIZE:
        return {"error": "too short"}
    if int.from_bytes(raw[:4], "little") != VITALS_MAGIC:
        return {"error": "wrong magic"}
    node, flags, breath, heart, rssi, persons, energy, score, stamp = struct.unpack_from("<4xBBHIbB2xffI", raw)
    values = (node, bool(flags & 1), bool(flags & 2), bool(flags & 4), breath / 100, heart / 10_000, rssi, persons, energy, score, stamp, None)
    return dict(zip(_VITALS.names, values, strict=True))


def _parsed(df: DataFrame, content: str, parse, schema: pa.Schema, ddl: str) -> DataFrame:
    if clash := set(schema.names) & set(df.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x.as_py()) for x in batch.column(batch.schema.get_field_index(content))]
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *schema.names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{own}, {ddl}")


def frames_of(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with the fields of the channel-state frame in a binary column."""
    return _parsed(df, content, parse_frame, _FRAME, FRAME_SCHEMA)


def vitals_of(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with the fields of the vitals packet in a binary column."""
    return _parsed(df, content, parse_vitals, _VITALS, VITALS_SCHEMA)
