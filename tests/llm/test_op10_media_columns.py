from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolake.llm.op10_media_columns import PACKET, PES_PAYLOAD, crc_mpeg, demux, demux_bytes, mux_bytes, op10_media_columns


def test_query(spark, sf_dir, documents):
    rows = op10_media_columns(spark, sf_dir).collect()
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert len(rows) == len(documents)
    stored = {}
    for r in rows:
        t = texts[r["doc_id"]]
        p = t + bytes(-len(t) % 64 if t else 64)
        media = mux_bytes(p)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert stored.setdefault(t, tuple(r)[1:]) == tuple(r)[1:]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=2000), st.integers(0, 3 * PES_PAYLOAD).map(lambda n: bytes(n % 251 for n in range(n)))))
def test_round_trip(payload):
    media = mux_bytes(payload)
    assert len(media) % PACKET == 0 and {media[k] for k in range(0, len(media), PACKET)} == {0x47}
    got = demux_bytes(media)
    n = max(1, -(-len(payload) // PES_PAYLOAD))
    assert got["payload"] == payload and got["continuity_errors"] == 0
    assert got["timestamps"] == [3600 * k for k in range(n)] and len(got["random_access"]) == n


def test_faults_are_seen():
    media = mux_bytes(bytes(9000))
    lost = media[: 10 * PACKET] + media[11 * PACKET :]
    got = demux_bytes(lost)
    assert got["continuity_errors"] == 1 and got["damaged"] == 1 and got["payload"] == b""
    two = mux_bytes(bytes(PES_PAYLOAD) + b"x" * 500)
    cut = demux_bytes(two[: 9 * PACKET] + two[10 * PACKET :])  # the second elementary packet is whole
    assert cut["payload"] == b"x" * 500 and cut["timestamps"] == [3600] and cut["damaged"] == 1
    with pytest.raises(ValueError, match="program table"):
        demux_bytes(media[:20] + b"\x01" + media[21:])
    with pytest.raises(ValueError, match="transport stream"):
        demux_bytes(b"\0" * PACKET * 3)
    assert crc_mpeg(b"123456789") == 0x0376E6E7


def packet(pid: int, counter: int, body: bytes, start: bool = False, field: bytes | None = None) -> bytes:
    """One transport packet, put together by hand; ``field``: the adaptation field's flags and what follows."""
    room = 184 - len(body)
    if field is None and room:
        field = b"" if room == 1 else b"\0"
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, ((field is not None) << 1 | bool(body)) << 4 | counter & 15])
    if field is not None:
        head += bytes([room - 1]) + field.ljust(room - 1, b"\xff")
    return head + body


def table(pid: int, section: bytes, counter: int = 0) -> bytes:
    raw = b"\0" + section + crc_mpeg(section).to_bytes(4, "big")
    parts = [raw[k : k + 184] for k in range(0, len(raw), 184)]
    return b"".join(packet(pid, counter + k, p.ljust(184, b"\xff"), k == 0) for k, p in enumerate(parts))


def stream(pid: int, es: int, descriptors: bytes = b"") -> bytes:
    pat = bytes([0, 0xB0, 17, 0, 9, 0xC1, 0, 0, 0, 0, 0xE0, 0x10, 0, 3, 0xE0 | pid >> 8, pid & 255])
    size = 13 + 5 + len(descriptors) + 5
    pmt = bytes([2, 0xB0 | size >> 8, size & 255, 0, 3, 0xC1, 0, 0, 0xE0 | es >> 8, es & 255, 0xF0 | len(descriptors) >> 8, len(descriptors) & 255]) + descriptors
    pmt += bytes([0x1B, 0xE0 | es >> 8, es & 255, 0xF0, 0, 0x0F, 0xE1, 0xFF, 0xF0, 0])
    return table(0, pat) + table(pid, pmt)


def test_streams_built_by_hand():
    """Long headers, packets without timestamp or size, tables over two packets, copies, packets without payload."""
    es = 0x1234 & 0x1FFF
    tables = stream(0x321, es, b"\x05\xc8" + b"d" * 200)
    one = bytes.fromhex("000001e0") + (3 + 12 + 40).to_bytes(2, "big") + bytes([0x80, 0xC0, 12]) + bytes.fromhex("3100010001 1100010001") + b"\xff\xff" + b"A" * 40
    two = bytes.fromhex("000001e0") + b"\0\0" + bytes([0x80, 0, 0]) + b"B" * 300  # no size: up to the next one
    other = packet(0x1FF, 5, b"z" * 184)
    first = packet(es, 14, one, True)
    media = tables + first + first + other + packet(es, 14, b"", field=b"\0") + packet(es, 15, two[:184], True) + packet(es, 0, two[184:])
    got = demux_bytes(media)
    assert got["payload"] == b"A" * 40 + b"B" * 300 and got["timestamps"] == [0, None]
    assert (got["stream_type"], got["continuity_errors"], got["damaged"], got["random_access"]) == (0x1B, 0, 0, [])
    again = tables + first + first + first  # two copies are one too many
    assert demux_bytes(again)["continuity_errors"] == 1
    told = tables + first + packet(es, 7, one, True, field=b"\xc0")
    assert demux_bytes(told)["continuity_errors"] == 0 and demux_bytes(told)["random_access"] == [1]
    assert demux_bytes(tables + packet(es, 3, one[:-1], True))["damaged"] == 1


def test_clock_references():
    media = mux_bytes(bytes(2 * PES_PAYLOAD))
    heads = [media[k : k + PACKET] for k in range(0, len(media), PACKET) if media[k + 1] & 0x40][2:]
    clocks = [int.from_bytes(h[6:10], "big") << 1 | h[10] >> 7 for h in heads]
    assert all(h[5] == 0x50 for h in heads) and clocks == demux_bytes(media)["timestamps"]


def test_values_that_are_no_streams(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\0" * 400)), (4, bytearray(mux_bytes(b"ab")))], "k long, media binary")
    got = {r["k"]: r["stream"] for r in demux(rows).collect()}
    assert got[1] is None and got[2]["error"] == got[3]["error"] == "not a transport stream" and got[3]["payload"] is None
    assert bytes(got[4]["payload"]) == b"ab" and got[4]["error"] is None
