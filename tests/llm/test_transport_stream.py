import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import transport_stream as ts


@pytest.mark.parametrize("n", [0, 1, 150, 169, 170, 171, 175, 176, 177, 183, 184, 185, 576, 4608, 4609, 40000, 150000])
def test_round_trip(n):
    payload = os.urandom(n)
    media = ts.mux(payload)
    found = ts.demux(media)
    assert len(media) % ts.PACKET == 0 and all(media[i] == 0x47 for i in range(0, len(media), ts.PACKET))
    assert found.payload == payload and not found.continuity_errors and not found.lost_bytes and not found.bad_sections
    assert found.programs == {1: ts.PMT_PID} and found.streams == {ts.DATA_PID: ts.PRIVATE_DATA}
    assert found.timestamps == [i * ts.UNIT * ts.CLOCK // ts.RATE for i in range(-(-n // ts.UNIT))]
    assert found.random_access == found.timestamps[:: ts.RANDOM_ACCESS_EVERY]


def test_damage_is_counted():
    media = ts.mux(os.urandom(30000))
    found = ts.demux(b"zz" + media[: 188 * 10] + media[188 * 12 :] + b"tail")
    assert found.continuity_errors == 1 and found.lost_bytes == 6
    broken = bytearray(media)
    broken[10] ^= 1
    assert ts.demux(bytes(broken)).bad_sections == 1
    assert ts.demux(b"").payload == b"" and ts.demux(b"\x00" * 500).payload == b""


def test_repeated_packets_are_ignored():
    payload = os.urandom(2000)
    media = ts.mux(payload)
    again = b"".join(media[i : i + 188] * (2 if i == 188 * 4 else 1) for i in range(0, len(media), 188))
    assert ts.demux(again).payload == payload


def test_dataframe(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 400), (3, "é" * 400)], "doc_id long, text string").withColumn("payload", ts.padded_payload(F.col("text")))
    rows = ts.read_media(ts.store_payloads(df.withColumn("media", F.lit(1)))).orderBy("doc_id").collect()
    assert [len(r.payload) for r in rows] == [576, 576, 1152, 1152]
    assert rows[0].payload == b"\xff" * 576 and rows[2].payload[:800] == ("é" * 400).encode()
    assert rows[2].payload == rows[3].payload
    none = ts.read_media(ts.store_payloads(spark.createDataFrame([(1, None)], "doc_id long, payload binary"))).first()
    assert none.payload is None and none.timestamps is None
    assert ts.read_media(ts.store_payloads(df.limit(0))).count() == 0


def test_query_against_a_plain_version(spark, sf):
    """Every column of the query from the texts alone; packets are read here by their headers."""
    import hashlib
    import zlib

    from corpusloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_transport_stream"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        media = ts.mux(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        packets = [media[i : i + 188] for i in range(0, len(media), 188)]
        stored = b""
        starts = access = 0
        for p in packets:
            pid = (p[1] & 31) << 8 | p[2]
            if pid == ts.DATA_PID:
                at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
                access += bool(p[3] & 0x20 and p[4] and p[5] & 0x40)
                if p[1] & 0x40:
                    starts += 1
                    at += 9 + p[at + 8]  # the header of an elementary packet
                stored += p[at:]
        assert stored == padded
        wanted = {"programs": 1, "streams": 1, "packets": len(packets), "units": starts, "random_access": access, "continuity_errors": 0, "lost_bytes": 0, "bad_sections": 0}
        stamps = [i * ts.UNIT * ts.CLOCK // ts.RATE for i in range(starts)]
        digest = lambda x: hashlib.sha1(",".join(map(str, x)).encode()).hexdigest()
        wanted |= {"incomplete": 0, "pts_sha1": digest(stamps), "access_sha1": digest(stamps[:: ts.RANDOM_ACCESS_EVERY])}
        assert {k: str(v) for k, v in wanted.items()}.items() <= dict(x.split("=") for x in r.feature.split(";")).items()


def packet(pid, counter, data, start):
    """One packet with its payload at the end, behind an adaptation field of stuffing."""
    space = ts.PACKET - 4 - len(data)
    head = b"\x47" + (pid | (0x4000 if start else 0)).to_bytes(2, "big")
    if not space:
        return head + bytes([0x10 | counter]) + data
    return head + bytes([0x30 | counter, space - 1]) + (b"\x00" if space > 1 else b"").ljust(space - 1, b"\xff") + data


def tables(pids):
    """Program tables that announce many streams: the map is longer than a packet."""
    pat = ts._section(0x00, 1, b"\x00\x01" + (0xE000 | 0x20).to_bytes(2, "big"))
    body = (0xE000 | pids[0]).to_bytes(2, "big") + b"\xf0\x00" + b"".join(b"\x06" + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x04note" for p in pids)
    pmt = b"\x00" + ts._section(0x02, 1, body)
    parts = [pmt[i : i + 150] for i in range(0, len(pmt), 150)]
    return [packet(0, 0, b"\x00" + pat, True), *(packet(0x20, k & 15, x, not k) for k, x in enumerate(parts))]


def pes(data, pts):
    return b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + ts._stamp(pts) + data


def test_sections_over_packets_and_one_payload_a_stream():
    pids = list(range(0x101, 0x101 + 40))
    packets = tables(pids)
    assert len(packets) > 3
    for k, pid in enumerate(pids[:3]):
        packets.append(packet(pid, 0, pes(bytes([k]) * 50, 900 * k), True))
    found = ts.demux(b"".join(packets))
    assert list(found.streams) == pids and not found.bad_sections
    assert found.payload == b"\x00" * 50 and [found.payloads[p] for p in pids[1:3]] == [b"\x01" * 50, b"\x02" * 50]
    lost = ts.demux(b"".join(packets[:2] + packets[3:]))
    assert not lost.streams and lost.bad_sections == 1 and lost.continuity_errors == 1


def test_lost_packets_mark_their_unit():
    payload = os.urandom(9000)
    media = ts.mux(payload)
    whole = ts.demux(media)
    assert whole.incomplete == []
    cut = ts.demux(media[: 188 * 6] + media[188 * 7 :])
    assert cut.incomplete == [0] and len(cut.payload) == 9000 - 184 and cut.payload.endswith(payload[ts.UNIT :])
    assert ts.demux(media[:-188]).incomplete == whole.timestamps[-1:]


def test_a_sync_byte_alone_is_no_packet():
    media = ts.mux(os.urandom(5000))
    noise = b"\x00" * 20 + b"\x47" + b"\x00" * 60
    found = ts.demux(noise + media)
    assert found.lost_bytes == len(noise) and found.payload == ts.demux(media).payload
