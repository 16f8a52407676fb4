"""Media columns as MPEG transport streams.

`store` turns payload bytes into a transport stream: a program association table, a program
map table and packetised elementary packets of 8-bit samples, each with a presentation
timestamp and, in its first packet, a clock reference and the random-access flag.
`read_back` parses such a stream: tables with their checksums, continuity counters, elementary
packets, timestamps and random-access points. Both work on whole values, one row at a time in
memory, without a shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_string, materialize, raw_bytes, row_slices, table

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data
LENGTH_TAG = 0xF0  # user-private descriptor: the payload's length before padding
PES_BYTES, ALIGN = 32768, 64
#: 8-bit samples at 48 kHz on the 90 kHz clock.
CLOCK, RATE = 90_000, 48_000


class StreamError(ValueError):
    """The bytes aren't a transport stream this reader can follow."""


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


def _section_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter & 15, 0) + section).ljust(PACKET, b"\xff")


_PAT = _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))


def _pmt(n_bytes: int) -> bytes:
    descriptor = struct.pack(">BBQ", LENGTH_TAG, 8, n_bytes)
    return _section(0x02, 1, struct.pack(">HH", 0xE000 | MEDIA_PID, 0xF000 | len(descriptor)) + descriptor + struct.pack(">BHH", STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000))


def _stamp(prefix: int, t: int) -> bytes:
    return bytes((prefix << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1))


def mux(payload: bytes, n_bytes: int) -> bytes:
    """The transport stream of a payload, whose first n_bytes are the value."""
    out = [_section_packet(PAT_PID, 0, _PAT), _section_packet(PMT_PID, 0, _pmt(n_bytes))]
    counter = 0
    for at in range(0, len(payload), PES_BYTES):
        data = payload[at : at + PES_BYTES]
        t = at * CLOCK // RATE & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _stamp(2, t) + data
        # the first packet: adaptation field with the random-access flag, the clock, then stuffing if the rest is short
        clock = struct.pack(">Q", (t << 15 | 0x7E00) << 16)[:6]
        room = PACKET - 4 - 8
        first, rest = pes[:room], pes[room:]
        pad = room - len(first)
        out.append(struct.pack(">BHBBB", SYNC, 0x4000 | MEDIA_PID, 0x30 | counter, 7 + pad, 0x50) + clock + b"\xff" * pad + first)
        full, tail = divmod(len(rest), PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
            block[:, 3] = 0x10 | np.arange(counter + 1, counter + 1 + full) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(block.tobytes())
        counter = counter + full & 15
        if tail:
            counter = counter + 1 & 15
            pad = PACKET - 4 - tail
            field = bytes((pad - 1,)) + (b"\x00" + b"\xff" * (pad - 2) if pad > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, MEDIA_PID, 0x30 | counter) + field + rest[-tail:])
        counter = counter + 1 & 15
    return b"".join(out)


def _sections(packets: np.ndarray, skip: np.ndarray, start: np.ndarray) -> list[tuple[int, bytes]]:
    """(table id, body) of the tables in force that one PID's packets carry, in order; a section may span packets, and a packet hold
    several. A wrong checksum is an error; one that is cut at either end of the stream is left out."""
    out: list[tuple[int, bytes]] = []
    held: bytearray | None = None  # None: wait for the start of a section

    def complete() -> None:
        nonlocal held
        while held is not None and len(held) >= 3 and held[0] != 0xFF:  # 0xFF: stuffing up to the end of the packet
            size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0xFFF)
            if len(held) < size:
                return
            section, held = bytes(held[:size]), held[size:]
            if len(section) < 12 or crc_mpeg(section):
                raise StreamError("a table's checksum is wrong")
            if section[5] & 1:  # in force now
                out.append((section[0], section[8:-4]))
        if held is not None and held[:1] == b"\xff":
            held = None

    for packet, at, first in zip(packets, skip.tolist(), start.tolist()):
        raw = packet.tobytes()
        if first:
            pointer = raw[at] if at < PACKET else 0
            if held is not None:
                held += raw[at + 1 : at + 1 + pointer]
                complete()
            held = bytearray(raw[at + 1 + pointer :])
        elif held is not None:
            held += raw[at:]
        complete()
    return out


def _media_pids(tables: list[tuple[int, bytes]]) -> tuple[list[int], int | None]:
    """The PIDs of streams of samples in program map tables (the first of each table), and the length tag's value."""
    pids: list[int] = []
    n_bytes = None
    for table_id, body in tables:
        if table_id != 2:
            continue
        info = struct.unpack_from(">H", body, 2)[0] & 0xFFF
        j = 4
        while j + 2 <= 4 + info:
            if body[j] == LENGTH_TAG and n_bytes is None:
                n_bytes = struct.unpack_from(">Q", body, j + 2)[0]
            j += 2 + body[j + 1]
        j = 4 + info
        while j + 5 <= len(body):
            kind, where, more = struct.unpack_from(">BHH", body, j)
            if kind == STREAM_TYPE:
                if where & 0x1FFF not in pids:
                    pids.append(where & 0x1FFF)
                break
            j += 5 + (more & 0xFFF)
    return pids, n_bytes


def demux(media: bytes) -> dict:
    """payload, n_bytes, timestamps, random-access points (byte offset, timestamp), packets, continuity errors and duplicates.

    Follows program tables over any number of packets and versions. A packet that repeats the one before of its PID (same counter
    and payload) is read once. A jump of the counter is an error, but for a packet with the discontinuity flag. An elementary
    packet of length 0 goes on to the next one; one that lacks bytes is an error.
    """
    if not media or len(media) % PACKET:
        raise StreamError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise StreamError("lost synchronisation")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    start = packets[:, 1] & 0x40 != 0
    control = packets[:, 3]
    carries = control & 0x10 != 0
    adapted = control & 0x20 != 0
    skip = np.where(adapted, 5 + packets[:, 4].astype(np.int32), 4)
    if (skip[carries] > PACKET).any():
        raise StreamError("an adaptation field runs past its packet")
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)

    errors = duplicates = 0
    good = carries.copy()
    for p in np.unique(pid[carries & (pid != NULL_PID)]):
        own = np.flatnonzero((pid == p) & carries)
        step = np.diff(control[own].astype(np.int16) & 15) & 15
        broken = step != 1
        for k in np.flatnonzero(step == 0).tolist():
            a, b = own[k], own[k + 1]
            if skip[a] == skip[b] and (packets[a, skip[a] :] == packets[b, skip[b] :]).all():
                good[b], broken[k], duplicates = False, False, duplicates + 1
        errors += int((broken & (flags[own[1:]] & 0x80 == 0)).sum())

    def tables(p: int) -> list[tuple[int, bytes]]:
        own = np.flatnonzero((pid == p) & good)
        return _sections(packets[own], skip[own], start[own])

    programs: list[int] = []
    for table_id, body in tables(PAT_PID):
        for j in range(0, len(body) - 3, 4) if table_id == 0 else ():
            number, where = struct.unpack_from(">HH", body, j)
            if number and where & 0x1FFF not in programs:
                programs.append(where & 0x1FFF)
    media_pids, n_bytes = [], None
    for p in programs:
        media_pids, n_bytes = _media_pids(tables(p))
        if media_pids:
            break
    if not media_pids:
        raise StreamError("no program with a stream of samples")

    found: list[tuple[int, int, bytes]] = []  # place of its first packet, timestamp, payload of each elementary packet
    points = []
    for p in media_pids:
        mine = np.flatnonzero((pid == p) & good)
        begins = np.flatnonzero(start[mine])
        flat = packets[mine][np.arange(PACKET)[None, :] >= skip[mine][:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET - skip[mine])])
        for k, b in enumerate(begins):
            stop = begins[k + 1] if k + 1 < len(begins) else len(mine)
            pes = flat[ends[b] : ends[stop]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                raise StreamError("an elementary packet lacks its start code")
            size = struct.unpack_from(">H", pes, 4)[0]
            if size and len(pes) != size + 6:
                raise StreamError("an elementary packet is cut short" if len(pes) < size + 6 else "an elementary packet runs past its length")
            t = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | (pes[11] >> 1) << 15 | pes[12] << 7 | pes[13] >> 1 if pes[7] & 0x80 else -1
            at = int(mine[b])
            if flags[at] & 0x40:
                points.append((at * PACKET, t))
            found.append((at, t, pes[9 + pes[8] :]))
    found.sort(key=lambda x: x[0])
    return {"payload": b"".join([x[2] for x in found]), "n_bytes": n_bytes, "pts": [x[1] for x in found], "points": sorted(points), "packets": len(packets), "continuity_errors": errors, "duplicates": duplicates}


def store(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and `media`: the stream of the text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64.

    A null text is stored as the empty one. Equal texts give equal streams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column("_text"))
            for start, end in row_slices(texts):
                data, at = raw_bytes(texts.slice(start, end - start))
                whole = data.tobytes()
                out = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    n = b - a
                    out.append(mux(whole[a:b].ljust(max(ALIGN, -(-n // ALIGN) * ALIGN), b"\x00"), n))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns[:-1]), pa.array(out, pa.binary())], [*batch.schema.names[:-1], "media"])

    picked = docs.select(*keep, F.col(text).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, fields + "media binary")


_READ = "payload binary, n_bytes bigint, packets bigint, continuity_errors bigint, pts array<bigint>, random_access array<struct<byte_offset:bigint,pts:bigint>>, sample_mean double, sign_changes bigint"


def read_back(stored: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "media")) -> DataFrame:
    """keep columns and what the stream in `media` holds: the payload (padded), its length before padding, packet count,
    continuity errors, timestamps, random-access points, and two features of the samples (mean; changes of side about 128).

    Works through the rows in slices of bytes, so memory doesn't follow the batch. A null stream gives nulls. Bytes that aren't such a stream fail the job with StreamError: a store must not lose values silently.
    """
    point = pa.struct([("byte_offset", pa.int64()), ("pts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("_media")
            for start, end in row_slices(media.cast(pa.large_binary()).fill_null(b"")):
                cols: list[list] = [[] for _ in range(8)]
                for value in media.slice(start, end - start):
                    if not value.is_valid:
                        row = [None] * 8
                    else:
                        got = demux(value.as_py())
                        samples = np.frombuffer(got["payload"], np.uint8)
                        high = samples >= 128
                        row = [got["payload"], got["n_bytes"], got["packets"], got["continuity_errors"], got["pts"], [{"byte_offset": o, "pts": t} for o, t in got["points"]], float(samples.mean()), int((high[1:] != high[:-1]).sum())]
                    for c, x in zip(cols, row):
                        c.append(x)
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(point), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns[:-1]), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*batch.schema.names[:-1], *(x.split()[0] for x in ("payload", "n_bytes", "packets", "continuity_errors", "pts", "random_access", "sample_mean", "sign_changes"))])

    picked = stored.select(*keep, F.col("media").alias("_media"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, fields + _READ)


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as a stored transport stream, written and read back: sizes, digests and features (see store and read_back)."""
    back = read_back(materialize(store(table(spark, sf_dir, "documents").select("doc_id", "text")), "streams"))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("pes="), F.size("pts")),
        F.concat(F.lit("random_access="), F.size("random_access")),
        F.concat(F.lit("last_pts="), F.element_at("pts", -1)),
        F.concat(F.lit("continuity_errors="), F.col("continuity_errors")),
        F.concat(F.lit("mean="), F.format_string("%.4f", "sample_mean")),
        F.concat(F.lit("sign_changes="), F.col("sign_changes")),
    )
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -ALIGN, ALIGN)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "continuity_errors",
    )
