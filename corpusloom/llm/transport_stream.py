"""MPEG transport streams: multiplexing and demultiplexing of binary payloads.

Layout written by :func:`mux` (ISO/IEC 13818-1): one program whose map announces
one private elementary stream.  The payload is cut into access units of
``UNIT`` bytes, each an elementary packet with a presentation timestamp; every
``RANDOM_ACCESS_EVERY``-th unit starts with the random access indicator and a
program clock reference.  A sample is one byte, so ``RATE`` samples a second give
the timestamps.

:func:`demux` reads any such stream: it resynchronises after lost bytes where two
sync bytes stand a packet apart, reassembles the sections of program tables over
packet borders (with their CRC), checks continuity counters per PID, reassembles the
elementary packets of each stream over packet borders and adaptation fields, marks
those that lack bytes, and lists timestamps and random-access points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import require, with_columns
from corpusloom.llm.text_arrays import chunks

PACKET, BLOCK = 188, 576
UNIT, RATE, CLOCK = 8 * BLOCK, 48_000, 90_000
RANDOM_ACCESS_EVERY = 4
PMT_PID, DATA_PID, PROGRAM, PRIVATE_DATA = 0x1000, 0x100, 1, 0x06
_WRAP = 1 << 33


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return table


def crc32_mpeg(data: bytes) -> int:
    """The sections' CRC: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ table[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    """The two packets with the program association and the program map."""
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    packets = []
    for pid, section in ((0, pat), (PMT_PID, pmt)):
        packets.append((b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff"))
    return b"".join(packets)


def _stamp(pts: int) -> bytes:
    pts %= _WRAP
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload; an empty payload gives the tables only."""
    out, counter = [_tables()], 0
    heads = [b"\x47" + DATA_PID.to_bytes(2, "big") + bytes([0x10 | c]) for c in range(16)]
    for n, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = at * CLOCK // RATE
        pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit
        random_access = n % RANDOM_ACCESS_EVERY == 0
        field_ = b""
        if random_access:
            base = pts % _WRAP
            field_ = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - (len(field_) + 1 if random_access else 0)
        first, start = True, 0
        while start < len(pes):
            if first or len(pes) - start < PACKET - 4:
                piece = pes[start : start + room] if first else pes[start:]
                own = field_ if first else b""
                space = PACKET - 4 - len(piece)
                head = b"\x47" + (DATA_PID | (0x4000 if first else 0)).to_bytes(2, "big")
                if space:
                    body = (own or (b"\x00" if space > 1 else b"")).ljust(space - 1, b"\xff")
                    out.append(head + bytes([0x30 | counter, space - 1]) + body + piece)
                else:
                    out.append(head + bytes([0x10 | counter]) + piece)
                start, first = start + len(piece), False
            else:
                out.append(heads[counter])
                out.append(pes[start : start + PACKET - 4])
                start += PACKET - 4
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Demuxed:
    """What a transport stream holds: ``payloads`` by PID, of which ``payload`` is that of the first stream announced.

    ``incomplete`` has the timestamps (-1 without one) of elementary packets that lack bytes; what there is of them is in the payload.
    """

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payloads: dict[int, bytes] = field(default_factory=dict)
    incomplete: list[int] = field(default_factory=list)
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    lost_bytes: int = 0
    bad_sections: int = 0

    @property
    def payload(self) -> bytes:
        return self.payloads.get(next(iter(self.streams), -1), b"")


class _Sections:
    """The sections of one PID, put together from the payloads of its packets."""

    def __init__(self, found: Demuxed):
        self.found, self.held, self.reading = found, b"", False

    def add(self, data: bytes, start: bool) -> None:
        if start and data:
            pointer = data[0]
            if self.reading:  # what stands before the pointer ends the section before
                self.held += data[1 : 1 + pointer]
                self._read()
                if self.held:
                    self.found.bad_sections += 1
            self.held, self.reading = data[1 + pointer :], True
        elif self.reading:
            self.held += data
        self._read()

    def _read(self) -> None:
        while self.reading and self.held:
            if self.held[0] == 0xFF:  # stuffing up to the next start
                self.held, self.reading = b"", False
                return
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)
            if len(self.held) < max(size, 3):
                return
            _section_read(self.found, self.held[:size])
            self.held = self.held[size:]

    def lost(self) -> None:
        """A packet is missing: a section in work cannot be finished."""
        self.found.bad_sections += bool(self.reading and self.held)
        self.held, self.reading = b"", False


def _section_read(found: Demuxed, section: bytes) -> None:
    if len(section) < 12 or crc32_mpeg(section):
        found.bad_sections += 1
        return
    body = section[8:-4]
    if section[0] == 0x00:
        for at in range(0, len(body) - 3, 4):
            program = int.from_bytes(body[at : at + 2], "big")
            if program:
                found.programs[program] = int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    elif section[0] == 0x02:
        at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
        while at + 5 <= len(body):
            found.streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
            at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)


def demux(media: bytes) -> Demuxed:
    """Read a transport stream; damage is counted, never raised."""
    found, at, end = Demuxed(), 0, len(media)
    last: dict[int, int] = {}
    open_: dict[int, list] = {}  # by PID: random access, pieces, whether a packet is missing
    done: dict[int, list[bytes]] = {}
    sections: dict[int, _Sections] = {}

    def close(pid: int) -> None:
        unit = open_.pop(pid, None)
        if unit is None:
            return
        pes = b"".join(unit[1])
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            return
        size, pts = int.from_bytes(pes[4:6], "big"), -1
        if pes[7] & 0x80 and len(pes) >= 14:
            p = pes[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
            if unit[0]:
                found.random_access.append(pts)
            found.timestamps.append(pts)
        if unit[2] or (size and len(pes) < 6 + size):
            found.incomplete.append(pts)
        done.setdefault(pid, []).append(pes[9 + pes[8] : 6 + size if size else None])

    tables, streams = found.programs, found.streams
    searching = False
    while at + PACKET <= end:
        if media[at] != 0x47 or (searching and at + PACKET < end and media[at + PACKET] != 0x47):
            at += 1
            found.lost_bytes += 1
            searching = True
            continue
        searching = False
        high, low, flags = media[at + 1], media[at + 2], media[at + 3]
        pid, start, stop = (high & 0x1F) << 8 | low, at + 4, at + PACKET
        at = stop
        found.packets += 1
        if pid == 0x1FFF or high & 0x80:
            continue
        access = False
        if flags & 0x20:
            size = media[start]
            access = size > 0 and bool(media[start + 1] & 0x40)
            broken = size > 0 and bool(media[start + 1] & 0x80)
            start += 1 + size
            if broken:
                last.pop(pid, None)
        if not flags & 0x10 or start >= stop:
            continue
        counter = flags & 15
        before = last.get(pid)
        if before is not None and counter == before:
            continue  # a repeated packet
        if before is not None and counter != before + 1 & 15:
            found.continuity_errors += 1
            if pid in open_:
                open_[pid][2] = True
            if pid in sections:
                sections[pid].lost()
        last[pid] = counter
        if pid in streams:
            if high & 0x40:
                close(pid)
                open_[pid] = [access, [media[start:stop]], False]
            elif pid in open_:
                open_[pid][1].append(media[start:stop])
        elif pid == 0 or pid in tables.values():
            sections.setdefault(pid, _Sections(found)).add(media[start:stop], bool(high & 0x40))
    found.lost_bytes += end - at
    for pid in list(open_):
        close(pid)
    found.payloads = {pid: b"".join(done.get(pid, [])) for pid in streams}
    return found


def padded_payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty) filled with bytes 255 up to a positive multiple of 576."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.when(n == 0, F.lit(BLOCK)).otherwise(F.pmod(-n, F.lit(BLOCK)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), fill)))


def store_payloads(df: DataFrame, payload: str = "payload", output: str = "media") -> DataFrame:
    """Replace a binary column by its transport stream in ``output``.

    Other columns pass through (an input column named ``output`` gives way).  A
    null payload gives null; an empty one gives a stream with tables only.  Rows
    are independent and repeated rows give equal streams; nothing is shuffled.
    """
    require(df, payload)
    given = with_columns(df, {output: F.col(payload).cast("binary")}).drop(*([payload] if payload != output else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, output):
                media = pa.array([None if x is None else mux(x) for x in part.column(output).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], media], names=part.schema.names)

    return given.mapInArrow(run, given.schema)


_INT, _LONG = T.IntegerType(), T.LongType()
READ = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("programs", T.ArrayType(T.StructType([T.StructField("program", _INT), T.StructField("pid", _INT)]))),
        T.StructField("streams", T.ArrayType(T.StructType([T.StructField("pid", _INT), T.StructField("stream_type", _INT)]))),
        T.StructField("timestamps", T.ArrayType(_LONG)),
        T.StructField("random_access", T.ArrayType(_LONG)),
        T.StructField("incomplete", T.ArrayType(_LONG)),
        T.StructField("others", T.ArrayType(T.StructType([T.StructField("pid", _INT), T.StructField("payload", T.BinaryType())]))),
        *(T.StructField(name, _LONG) for name in ("packets", "continuity_errors", "lost_bytes", "bad_sections")),
    ]
)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace a column of transport streams by what they hold (the columns of ``READ``): ``payload`` of the first stream announced, ``others`` of the rest.

    Input columns of these names give way.  A null stream gives nulls, a damaged
    one what can be read and the counts of its damage.
    """
    require(df, media)
    kept = [f for f in df.schema.fields if f.name not in {media, *READ.names}]
    given = df.select(*(df[f"`{f.name}`"] for f in kept), df[f"`{media}`"].alias(media))
    types = [pa.binary(), pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32())])), pa.list_(pa.struct([("pid", pa.int32()), ("stream_type", pa.int32())])), *[pa.list_(pa.int64())] * 3, pa.list_(pa.struct([("pid", pa.int32()), ("payload", pa.binary())])), *[pa.int64()] * 4]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(types)
        x = demux(data)
        programs = [{"program": a, "pid": b} for a, b in sorted(x.programs.items())]
        streams = [{"pid": a, "stream_type": b} for a, b in sorted(x.streams.items())]
        others = [{"pid": pid, "payload": data} for pid, data in list(x.payloads.items())[1:]]
        return x.payload, programs, streams, x.timestamps, x.random_access, x.incomplete, others, x.packets, x.continuity_errors, x.lost_bytes, x.bad_sections

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, media):
                columns = zip(*map(row, part.column(media).to_pylist()), strict=True)
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*(f.name for f in kept), *READ.names])

    return given.mapInArrow(run, T.StructType([*kept, *READ.fields]))


def _list_digest(column: str) -> Column:
    """SHA-1 of a list of numbers, comma-joined."""
    return F.sha1(F.array_join(F.col(column).cast("array<string>"), ","))


def features(df: DataFrame) -> Column:
    """A line that describes what :func:`read_media` found."""
    first, last = F.element_at("timestamps", 1), F.element_at("timestamps", -1)
    return F.concat_ws(
        ";",
        *(
            F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("")))
            for name, value in {
                "programs": F.size("programs"), "streams": F.size("streams"), "packets": F.col("packets"), "units": F.size("timestamps"),
                "first_pts": F.when(F.size("timestamps") > 0, first), "last_pts": F.when(F.size("timestamps") > 0, last),
                "random_access": F.size("random_access"), "pts_sha1": _list_digest("timestamps"), "access_sha1": _list_digest("random_access"), "incomplete": F.size("incomplete"), "continuity_errors": F.col("continuity_errors"), "lost_bytes": F.col("lost_bytes"), "bad_sections": F.col("bad_sections"),
            }.items()
        ),
    )
