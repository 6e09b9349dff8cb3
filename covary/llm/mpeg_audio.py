"""Operator 8: media columns, MPEG audio.

``store`` wraps a payload of 8-bit samples losslessly in an MPEG-1 Layer III stream that any decoder plays (as
silence): an ID3v2 tag, a first frame with a variable-bitrate table (frames, bytes, a 100-entry seek table), then
CRC-protected frames whose side information is empty and whose main-data region carries the payload as ancillary
bytes. The last frame uses the smallest bitrate that holds the rest, so the stream has a variable bitrate.

``parse`` reads any such stream back: it skips the tag, resynchronises on frame headers (a header counts only if it is
valid and the next frame, or the end, follows where its length says), reads the variable-bitrate table, verifies the
CRC-16 of every protected frame, and returns exact durations (samples over rate), the byte offset of every frame and
the ancillary bytes. Damaged stretches are skipped and counted; the payload is given only if its check sum holds.

A null text is the empty one: 64 zero bytes. Equal texts give equal values; ids may be null or repeated; other columns
are ignored; long texts give longer streams, one row in memory at a time."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from covary.llm.shared import slices, table

# Fixed values of MPEG-1 Layer III (ISO/IEC 11172-3): kbit/s by bitrate index, Hz by rate index.
KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
HZ = (44100, 48000, 32000)
SAMPLES = 1152
SIDE = {3: 17}  # bytes of side information: mono 17, else 32
RATE = 1  # 48 kHz: every frame length is whole, so no padding
HEAD = 4 + 2 + 32


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 and start 0xFFFF, as the frame's check word has it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1 & 0xFFFF
    return crc


@lru_cache(4096)
def header(word: bytes) -> tuple[int, int, int, bool] | None:
    """Four bytes -> (frame length, rate in Hz, bytes of side information, protected), or None."""
    if word[0] != 0xFF or word[1] & 0xFE != 0xFA:  # sync, MPEG-1, Layer III
        return None
    bitrate, rate, pad = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if bitrate in (0, 15) or rate == 3:
        return None
    return 144000 * KBPS[bitrate] // HZ[rate] + pad, HZ[rate], SIDE.get(word[3] >> 6, 32), not word[1] & 1


@lru_cache(16)
def frame_head(bitrate: int) -> bytes:
    """Header, check word and empty side information of a protected stereo frame."""
    word = bytes([0xFF, 0xFA, bitrate << 4 | RATE << 2, 0])
    side = bytes(32)
    return word + struct.pack(">H", crc16(word[2:] + side)) + side


ROOM = [0 if not k else 144000 * k // HZ[RATE] - HEAD for k in KBPS]
BEST = len(KBPS) - 1


def store(payload: bytes) -> bytes:
    """payload -> ID3v2 tag, variable-bitrate frame, frames."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        bitrate = next((b for b in range(1, BEST) if ROOM[b] >= left), BEST)
        part = payload[at : at + ROOM[bitrate]]
        frames.append(frame_head(bitrate) + part + bytes(ROOM[bitrate] - len(part)))
        at += len(part)
    sizes = [len(f) for f in frames]
    info = 144000 * KBPS[5] // HZ[RATE]
    total = info + sum(sizes)
    toc, place, k = bytearray(), info, 0
    for percent in range(100):
        while k < percent * len(sizes) // 100:
            place += sizes[k]
            k += 1
        toc.append(min(255, 256 * place // total))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
    first = (frame_head(5) + xing).ljust(info, b"\0")
    notes = {b"payload": b"%d" % len(payload), b"crc32": b"%d" % zlib.crc32(payload)}
    text = b"".join(b"TXXX" + struct.pack(">I", 2 + len(k) + len(v)) + b"\0\0" + b"\0" + k + b"\0" + v for k, v in notes.items())
    tag = b"ID3\3\0\0" + bytes(len(text) >> s & 127 for s in (21, 14, 7, 0)) + text
    return tag + first + b"".join(frames)


def parse(data: bytes) -> dict:
    """What the stream holds; `payload` is None unless the tag gives its length and check sum and so many bytes that fit
    it were found. Any bytes may be given: a tag or table that ends early is read as far as it goes."""
    at, notes = 0, {}
    if data[:3] == b"ID3" and len(data) >= 10:
        end = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
        at = 10
        while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
            n = struct.unpack(">I", data[at + 4 : at + 8])[0]
            body = data[at + 10 : at + 10 + n]
            name, _, value = body[1:].partition(b"\0")
            if data[at : at + 4] == b"TXXX" and value.isdigit() and len(value) < 20:
                notes[name] = int(value)
            at += 10 + n
        at = end
    out = {"frames": 0, "offsets": [], "seconds": [], "bad_crc": 0, "skipped": 0, "vbr_frames": None, "vbr_bytes": None, "toc": b"", "payload": None}
    parts, end = [], len(data)
    per_rate: dict[int, int] = {}
    while at + 4 <= end:
        head = header(data[at : at + 4])
        if head and at + head[0] <= end and (at + head[0] == end or at + head[0] + 4 > end or header(data[at + head[0] : at + head[0] + 4])):
            n, hz, side, protected = head
            body = at + 4 + 2 * protected
            if protected and crc16(data[at + 2 : at + 4] + data[body : body + side]) != struct.unpack(">H", data[at + 4 : at + 6])[0]:
                out["bad_crc"] += 1
            main = body + side
            if not out["frames"] and out["vbr_frames"] is None and main + 120 <= at + n and data[main : main + 4] in (b"Xing", b"Info"):
                flags, main = struct.unpack(">I", data[main + 4 : main + 8])[0], main + 8
                if flags & 1:
                    out["vbr_frames"], main = struct.unpack(">I", data[main : main + 4])[0], main + 4
                if flags & 2:
                    out["vbr_bytes"], main = struct.unpack(">I", data[main : main + 4])[0], main + 4
                if flags & 4:
                    out["toc"] = data[main : main + 100]
            else:
                out["frames"] += 1
                out["offsets"].append(at)
                per_rate[hz] = per_rate.get(hz, 0) + SAMPLES
                parts.append(data[main : at + n])
            at += n
        else:  # resynchronise: the next byte that can begin a header
            nxt = data.find(b"\xff", at + 1)
            nxt = end if nxt < 0 else nxt
            out["skipped"] += nxt - at
            at = nxt
    out["samples"] = sum(per_rate.values())
    out["duration"] = sum(n / hz for hz, n in per_rate.items())
    held = b"".join(parts)
    length = notes.get(b"payload")
    if length is not None and length <= len(held) and zlib.crc32(held[:length]) == notes.get(b"crc32"):
        out["payload"] = held[:length]
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the stored form of every text."""

    def run(batches):
        for b in slices(batches):
            for i in range(b.num_rows):
                n, payload = padded(b.column(1)[i].as_py())
                yield pa.record_batch([b.column(0).slice(i, 1), pa.array([n], pa.int64()), pa.array([store(payload)], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


MEDIA = "frames int, duration double, bad_crc int, skipped int, vbr_frames int, vbr_bytes bigint, offsets array<bigint>, payload binary"


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with what parse() finds in media beside it."""
    names = [x.split()[0] for x in MEDIA.split(", ")]
    types = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for b in slices(batches):
            for i in range(b.num_rows):
                found = parse(b.column(2)[i].as_py() or b"")
                yield pa.record_batch([*(c.slice(i, 1) for c in b.columns), *(pa.array([found[n]], t) for n, t in zip(names, types, strict=True))], names=["doc_id", "n_bytes", "media", *names])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary, {MEDIA}")


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns: each text stored, read back and summed up in one pass, so that no stored form has to
    leave its task."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in slices(batches):
            rows: list[list] = [[] for _ in names[1:]]
            for text in b.column(1):
                n, payload = padded(text.as_py())
                media = store(payload)
                found = parse(media)
                back = found["payload"] or b""
                offsets = zlib.crc32(np.array(found["offsets"], "<u8").tobytes())
                feature = f"frames={found['frames']};samples={found['samples']};bad_crc={found['bad_crc']};vbr={found['vbr_frames']};last={found['offsets'][-1]};offsets={offsets}"
                for r, x in zip(rows, (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    r.append(x)
            yield pa.record_batch([b.column(0), *map(pa.array, rows)] if rows[0] else [b.column(0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every text stored as MPEG audio, read back and summed up."""
    return digests(table(spark, sf_dir, "documents"))
