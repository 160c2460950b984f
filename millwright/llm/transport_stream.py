"""Media columns holding MPEG transport streams.

`mux` stores a payload as one program: program tables, then elementary packets of one access
unit each, cut into 188-byte transport packets. `parse` reads any transport stream: it finds
packet sync, follows the program association and map tables (checking their CRC), checks the
continuity counter of every packet id, reassembles elementary packets and keeps their
timestamps with the random-access points. Both work on one value at a time, so the operators
need no shuffle and hold one Arrow batch.
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
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.session import table

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM, PRIVATE_PES = 0xBD, 0x06
#: Stream ids whose elementary packets have no optional header.
BARE_STREAMS = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))
CLOCK = 90_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables; 0 over a section that ends in its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, table_key: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, table_key, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    """A whole section in one packet, counter 0."""
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = (
    _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))),
    _table_packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_PES, 0xE000 | MEDIA_PID, 0xF000))),
)


def _stamp(mark: int, t: int) -> bytes:
    return bytes((mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1))


def mux(payload: bytes, unit_bytes: int = 16_384, unit_ticks: int = 3_600, random_access_every: int = 8) -> bytes:
    """A transport stream that carries `payload`, unit by unit.

    Program tables stand before every random-access unit. An empty payload has tables only."""
    out: list[bytes] = []
    counter = tables = 0
    for n, start in enumerate(range(0, len(payload), unit_bytes)):
        access, t = n % random_access_every == 0, (CLOCK + n * unit_ticks) % 2**33
        if access:
            out += [p[:3] + bytes((0x10 | tables & 15,)) + p[4:] for p in _TABLES]
            tables += 1
        unit = payload[start : start + unit_bytes]
        pes = struct.pack(">3sBHBBB", b"\0\0\1", PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + _stamp(2, t) + unit
        clock = struct.pack(">BIH", 0x10 | access << 6, t >> 1, (t & 1) << 15 | 0x7E00)
        first = min(len(pes), PACKET - 5 - len(clock))
        field = clock.ljust(PACKET - 5 - first, b"\xff")
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | MEDIA_PID, 0x30 | counter, len(field)) + field + pes[:first])
        counter = counter + 1 & 15
        full = (len(pes) - first) // (PACKET - 4)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, :3] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
            packets[:, 3] = 0x10 | counter + np.arange(full) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), first).reshape(full, -1)
            out.append(packets.tobytes())
            counter = counter + full & 15
        rest = pes[first + full * (PACKET - 4) :]
        if rest:
            stuffing = PACKET - 5 - len(rest)
            field = b"\0".ljust(stuffing, b"\xff") if stuffing else b""
            out.append(struct.pack(">BHBB", SYNC, MEDIA_PID, 0x30 | counter, stuffing) + field + rest)
            counter = counter + 1 & 15
    return b"".join(out) or b"".join(_TABLES)


@dataclass(slots=True)
class Unit:
    """One elementary packet: where it starts, its stamps in 90 kHz ticks, its payload."""

    pid: int
    packet: int
    pts: int | None
    dts: int | None
    random_access: bool
    damaged: bool
    payload: bytes


@dataclass(slots=True)
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    lost_sync: int = 0
    errors: int = 0
    duplicates: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)

    def payload(self) -> bytes:
        """Payloads of the lowest elementary packet id, joined."""
        first = min(self.streams, default=None)
        return b"".join(u.payload for u in self.units if u.pid == first)


def _packets(data: bytes) -> tuple[np.ndarray, int]:
    """The 188-byte packets in sync, and how many bytes were passed over to find them."""
    whole = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    if len(data) % PACKET == 0 and (whole[:, 0] == SYNC).all():
        return whole, 0
    starts, at, lost = [], 0, 0
    while at + PACKET <= len(data):
        if data[at] == SYNC and (at + PACKET == len(data) or at + PACKET < len(data) and data[at + PACKET] == SYNC or starts and starts[-1] + PACKET == at):
            starts.append(at)
            at += PACKET
        else:
            nxt = data.find(b"\x47", at + 1)
            nxt = len(data) if nxt < 0 else nxt
            lost, at = lost + nxt - at, nxt
    lost += max(0, len(data) - at) if at < len(data) else 0
    flat = np.frombuffer(data, np.uint8)
    return (flat[np.array(starts, np.int64)[:, None] + np.arange(PACKET)] if starts else np.zeros((0, PACKET), np.uint8)), lost


def _sections(payloads: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Sections from the payloads of one packet id."""
    held, going = b"", False
    for begins, data in payloads:
        if begins and data:
            pointer = data[0]
            if going:
                held += data[1 : 1 + pointer]
                yield from _cut(held)
            held, going = data[1 + pointer :], True
        elif going:
            held += data
    if going:
        yield from _cut(held)


def _cut(data: bytes) -> Iterator[bytes]:
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 0x0F) << 8 | data[2])
        if size > len(data):
            return
        yield data[:size]
        data = data[size:]


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _unit(pid: int, packet: int, access: bool, damaged: bool, data: bytes) -> Unit | None:
    if len(data) < 6 or data[:3] != b"\0\0\1":
        return None
    sid, size = data[3], data[4] << 8 | data[5]
    body = data[6 : 6 + size] if size else data[6:]
    damaged |= bool(size) and len(body) < size
    if sid in BARE_STREAMS or len(body) < 3 or body[0] >> 6 != 2:
        return Unit(pid, packet, None, None, access, damaged, body)
    has, end = body[1] >> 6, 3 + body[2]
    pts = _ticks(body[3:8]) if has & 2 and len(body) >= 8 else None
    dts = _ticks(body[8:13]) if has == 3 and len(body) >= 13 else None
    return Unit(pid, packet, pts, dts, access, damaged, body[end:])


def parse(data: bytes | None) -> Stream:
    """Everything `Stream` states, from the bytes of a transport stream. Null is empty."""
    out = Stream()
    packets, out.lost_sync = _packets(bytes(data or b""))
    out.packets = len(packets)
    if not out.packets:
        return out
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    bad = packets[:, 1] & 0x80 != 0
    out.errors = int(bad.sum())
    starts, control, counter = packets[:, 1] & 0x40 != 0, packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    has_field, has_payload = control & 2 != 0, control & 1 != 0
    offset = np.where(has_field, 5 + packets[:, 4].astype(np.int32), 4)
    flags = np.where(has_field & (packets[:, 4] > 0), packets[:, 5], 0)
    usable = ~bad & has_payload & (offset <= PACKET)
    order = np.argsort(pid, kind="stable")
    ids, first = np.unique(pid[order], return_index=True)
    of = {int(p): rows[usable[rows]] for p, rows in zip(ids, np.split(order, first[1:]), strict=True) if p != NULL_PID}

    def payloads(p: int) -> list[tuple[bool, bytes]]:
        return [(bool(starts[i]), packets[i, offset[i] :].tobytes()) for i in of.get(p, ())]

    def good(p: int, table_id: int) -> Iterator[bytes]:
        for s in _sections(payloads(p)):
            if s[0] != table_id:
                continue
            if len(s) < 12 or section_crc(s):
                out.table_errors += 1
            elif s[5] & 1:  # in force now
                yield s

    for s in good(PAT_PID, 0):
        for at in range(8, len(s) - 4, 4):
            program, p = struct.unpack_from(">HH", s, at)
            if program:
                out.programs[program] = p & 0x1FFF
    for p in sorted(set(out.programs.values())):
        for s in good(p, 2):
            at = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                kind, epid, skip = struct.unpack_from(">BHH", s, at)
                out.streams[epid & 0x1FFF] = kind
                at += 5 + (skip & 0x0FFF)
    for p, rows in of.items():
        if not len(rows):
            continue
        step = (counter[rows[1:]].astype(np.int16) - counter[rows[:-1]]) % 16
        signalled = flags[rows[1:]] & 0x80 != 0
        again = (step == 0) & ~signalled & (packets[rows[1:], 4:] == packets[rows[:-1], 4:]).all(axis=1)
        broken = (step != 1) & ~again & ~signalled
        out.duplicates += int(again.sum())
        out.continuity_errors += int(broken.sum())
        if p in out.streams:
            keep = np.concatenate([[True], ~again])
            _reassemble(out, p, packets, rows[keep], np.concatenate([[False], broken])[keep], starts, offset, flags)
    out.units.sort(key=lambda u: u.packet)
    return out


def _reassemble(out: Stream, pid: int, packets: np.ndarray, rows: np.ndarray, broken: np.ndarray, starts: np.ndarray, offset: np.ndarray, flags: np.ndarray) -> None:
    """Elementary packets of one id; what precedes the first start is no whole packet."""
    begins = np.flatnonzero(starts[rows])
    for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
        own = rows[a:b]
        plain = own[1:-1]
        middle = packets[plain, 4:].tobytes() if (offset[plain] == 4).all() else b"".join(packets[i, offset[i] :].tobytes() for i in plain)
        last = packets[own[-1], offset[own[-1]] :].tobytes() if len(own) > 1 else b""
        data = packets[own[0], offset[own[0]] :].tobytes() + middle + last
        if unit := _unit(pid, int(own[0]), bool(flags[own[0]] & 0x40), bool(broken[a + 1 : b].any()), data):
            out.units.append(unit)


def described(s: Stream) -> str:
    """A short account of a stream: its programs, counters, stamps and random-access points."""
    stamps = [u.pts for u in s.units if u.pts is not None]
    access = [(u.packet, u.pts) for u in s.units if u.random_access]
    points = zlib.crc32(repr(access).encode())
    return f"ts;packets={s.packets};programs={len(s.programs)};streams={','.join(f'{p}:{k}' for p, k in sorted(s.streams.items()))};units={len(s.units)};pts={min(stamps, default='')}-{max(stamps, default='')};random_access={len(access)}:{points:08x};continuity_errors={s.continuity_errors};damaged={sum(u.damaged for u in s.units)}"


#: Columns that `index_media` adds.
INDEX = T.StructType([T.StructField(n, t) for n, t in (
    ("packets", T.LongType()), ("lost_sync", T.LongType()), ("continuity_errors", T.LongType()), ("duplicates", T.LongType()), ("table_errors", T.LongType()), ("payload_bytes", T.LongType()),
    ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType()), ("timestamps", T.ArrayType(T.LongType())), ("random_access", T.ArrayType(T.StructType([T.StructField("packet", T.LongType()), T.StructField("pts", T.LongType())]))),
)])


def _mapped(rows: DataFrame, added: T.StructType, source: str, work) -> DataFrame:
    """`rows` with the columns `added` made by `work` from the column `source`; columns of
    those names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = rows.select(*(c for c in rows.columns if c not in added.fieldNames()), *([F.col(source).alias("__source")]))
    out = T.StructType([*kept.drop("__source").schema, *added])
    schema = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [work(x.as_py()) for x in b["__source"]]
            new = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], *schema.names])

    return kept.mapInArrow(run, out)


def padded(text: str | None, block: int = 64) -> tuple[bytes, int]:
    """UTF-8 of a text (null: empty) with zero bytes up to a positive multiple of `block`, and
    its length before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(block, -(-len(data) // block) * block), b"\0"), len(data)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with `n_bytes` and `media`, a transport stream that holds its padded text.
    Null and empty texts store 64 zero bytes; repeated rows stay; no rows give none."""

    def work(value: str | None) -> tuple:
        payload, n = padded(value)
        return n, mux(payload)

    return _mapped(docs, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]), text, work)


def index_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """Every row with the columns INDEX, read from its stored transport stream. Null or
    unreadable media give zero packets and an empty payload."""

    def work(value: bytes | None) -> tuple:
        s = parse(value)
        payload = s.payload()
        access = [{"packet": u.packet, "pts": u.pts} for u in s.units if u.random_access]
        return s.packets, s.lost_sync, s.continuity_errors, s.duplicates, s.table_errors, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), described(s), [u.pts for u in s.units], access

    return _mapped(rows, INDEX, media, work)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a transport stream and read back."""
    stored = store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return index_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "timestamps", "random_access")
