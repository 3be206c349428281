"""MPEG transport streams as a media column.

`store` wraps a payload into a program: a PAT and a PMT before every random-access point, and one elementary stream of
private PES packets with presentation times. `read` parses such bytes again: program tables with their CRC, continuity
counters, PES reassembly, times and random-access points. Both work on whole texts, packet rows at a time in NumPy.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, BODY, SYNC = 188, 184, 0x47
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0101, 0x06, 0xBD
UNIT = 16384  # payload bytes of one PES packet
TICKS = 3600  # of the 90 kHz clock between two units: 25 a second
RANDOM_EVERY = 8  # every 8th unit is a random-access point
ALIGN = 64

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
            "media_sha256 string, feature string, pts array<long>, random_access array<long>")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        table = np.where(table >> 31, (table << np.uint32(1)) ^ np.uint32(0x04C11DB7), table << np.uint32(1))
    return table


_CRC = [int(x) for x in _crc_table()]


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for x in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ x]
    return crc


def _section(table_id: int, body: bytes) -> bytes:
    """A PSI section with its length and CRC, after a pointer of 0."""
    head = bytes([table_id, 0xB0 | (len(body) + 4) >> 8, len(body) + 4 & 0xFF]) + body
    return b"\0" + head + crc32_mpeg(head).to_bytes(4, "big")


PAT = _section(0x00, b"\x00\x01\xc1\x00\x00" + b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(0x02, b"\x00\x01\xc1\x00\x00" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
               + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def _head(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, control << 4 | counter & 15])


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return _head(pid, True, 1, counter) + section + b"\xff" * (BODY - len(section))


def _time(pts: int) -> bytes:
    """The five bytes of a PTS."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _clock(pts: int) -> bytes:
    """A PCR of base `pts` and extension 0."""
    return (pts << 15 | 0x3F << 9).to_bytes(6, "big")


def _padded(field: bytes, size: int) -> bytes:
    """An adaptation field of `size` bytes in all that holds `field` (flags and what they announce)."""
    if size == 1:
        return b"\0"
    field = field or b"\0"
    return bytes([size - 1]) + field + b"\xff" * (size - 1 - len(field))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data, pts = payload[at:at + UNIT], k * TICKS & 0x1FFFFFFFF
        unit = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(pts) + data
        field = b""
        if k % RANDOM_EVERY == 0:
            out += [_table_packet(0, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
            field = b"\x50" + _clock(pts)
        room = BODY - (1 + len(field) if field else 0)
        if len(unit) < room:
            out.append(_head(STREAM_PID, True, 3, counter) + _padded(field, BODY - len(unit)) + unit)
            counter += 1
            continue
        out.append(_head(STREAM_PID, True, 3 if field else 1, counter) + (_padded(field, BODY - room) if field else b"") + unit[:room])
        counter += 1
        full, rest = divmod(len(unit) - room, BODY)
        if full:
            rows = np.empty((full, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
            rows[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            rows[:, 4:] = np.frombuffer(unit, np.uint8, full * BODY, room).reshape(full, BODY)
            out.append(rows.tobytes())
            counter += full
        if rest:
            out.append(_head(STREAM_PID, False, 3, counter) + _padded(b"", BODY - rest) + unit[-rest:])
            counter += 1
    return b"".join(out)


def _sections(rows: np.ndarray) -> list[bytes]:
    """The checked sections of one table PID; each of them starts and ends in one packet."""
    out = []
    for row in dict.fromkeys(r[4:].tobytes() for r in rows if r[1] & 0x40):
        row = row[1 + row[0]:]
        size = 3 + ((row[1] & 0x0F) << 8 | row[2])
        if crc32_mpeg(row[:size]) == 0:
            out.append(row[:size])
    return out


def demux(media: bytes) -> dict:
    """Payload, program tables, continuity errors, times and random-access points (packet numbers) of a stream."""
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    programs = {}
    for pat in _sections(rows[pids == 0]):
        for i in range(8, len(pat) - 4, 4):
            number, pid = int.from_bytes(pat[i:i + 2], "big"), int.from_bytes(pat[i + 2:i + 4], "big") & 0x1FFF
            for pmt in _sections(rows[pids == pid]) if number else ():
                i = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
                while i < len(pmt) - 4:
                    programs.setdefault(number, {})[int.from_bytes(pmt[i + 1:i + 3], "big") & 0x1FFF] = pmt[i]
                    i += 5 + (int.from_bytes(pmt[i + 3:i + 5], "big") & 0x0FFF)
    streams = [pid for streams in programs.values() for pid in streams]
    if len(streams) != 1:
        raise ValueError(f"one elementary stream expected, not {len(streams)}")
    places = np.flatnonzero(pids == streams[0])
    rows = rows[places]
    has_field, has_body = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    counters = rows[has_body, 3] & 15
    errors = int((((counters[1:].astype(np.int16) - counters[:-1]) & 15) != 1).sum())
    field = np.where(has_field, rows[:, 4].astype(np.int64) + 1, 0)
    body = np.where(has_body, BODY - field, 0)
    data = rows[np.arange(PACKET) >= (PACKET - body)[:, None]].tobytes()
    starts = rows[:, 1] & 0x40 > 0
    cuts = np.append((np.cumsum(body) - body)[starts], len(data))
    payload, times = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if data[a:a + 3] != b"\0\0\1":
            raise ValueError("no start of a PES packet")
        size = int.from_bytes(data[a + 4:a + 6], "big")
        if size and a + 6 + size != b:
            raise ValueError("incomplete PES packet")
        t = data[a + 9:a + 14] if data[a + 7] & 0x80 else None
        times.append(None if t is None else (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        payload.append(data[a + 9 + data[a + 8]:b])
    random = places[has_field & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)]
    return {"payload": b"".join(payload), "programs": programs, "packets": len(pids), "units": len(times),
            "errors": errors, "pts": times, "random_access": random.tolist()}


def _stored(parts):
    for part in parts:
        for at in range(0, part.num_rows, 1000):
            ids, texts = part.column(0).slice(at, 1000), part.column(1).slice(at, 1000).cast(pa.binary())
            sizes, media = [], []
            for text in texts:
                data = text.as_py() or b""
                sizes.append(len(data))
                media.append(mux(data + bytes(-len(data) % ALIGN if data else ALIGN)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(parts):
    for part in parts:
        out = []
        for media in part.column("media"):
            media = media.as_py()
            if media is None:
                out.append({})
                continue
            x = demux(media)
            programs = ",".join(f"{n}:" + "+".join(f"{pid}/{kind}" for pid, kind in s.items()) for n, s in x["programs"].items())
            out.append({
                "payload_bytes": len(x["payload"]), "payload_sha256": hashlib.sha256(x["payload"]).hexdigest(),
                "tail_crc32": zlib.crc32(x["payload"][-ALIGN:]), "media_bytes": len(media),
                "media_sha256": hashlib.sha256(media).hexdigest(), "pts": x["pts"], "random_access": x["random_access"],
                "feature": f"programs={programs};packets={x['packets']};units={x['units']};continuity_errors={x['errors']};"
                           f"pts={x['pts'][0]}-{x['pts'][-1]};random_access={len(x['random_access'])}"})
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
                 "media_sha256": pa.string(), "feature": pa.string(), "pts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array([x.get(k) for x in out], t) for k, t in kinds.items()]],
                                         ["doc_id", "n_bytes", *kinds])


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a transport stream.

    The payload is the text's UTF-8 and bytes 0 up to a positive multiple of 64; a null text counts as empty. Nothing
    else of the row is used, so null ids and repeated rows pass through and further columns are dropped.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_stored, MEDIA)


def read(media: DataFrame) -> DataFrame:
    """What the stored bytes of `store` hold; a null media value gives nulls, damaged bytes raise an error."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)
