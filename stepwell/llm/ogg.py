"""Ogg media columns: checksummed pages, packets from lacing values, logical streams and granule times."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

# Fixed values of the Ogg format.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

# Our stored form: 8-bit stereo samples, each channel a logical stream of its own.
RATE, BLOCK, PAD = 8000, 192, 32
PACKET_SAMPLES, PAGE_SEGMENTS = 2040, 20
HEAD = struct.Struct("<8sIBBQ")  # magic, rate, channels, channel, samples
MAGIC = b"PCM8OGG\x01"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of an Ogg page whose checksum field is zero: polynomial 0x04c11db7, most significant bit first, from 0.

    zlib's CRC is the same polynomial with all bits mirrored, so it serves on mirrored bytes.
    """
    register = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_REVERSED), "big")


def make_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    bare = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return bare[:22] + struct.pack("<I", page_crc(bare)) + bare[26:]


def pages_of(serial: int, packets: list[tuple[bytes, int]], segments: int = PAGE_SEGMENTS) -> list[tuple[int, bytes]]:
    """(granule, page) for the packets (data, granule at its end) of one logical stream; the first has a page of its own."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, flags, granule = bytearray(), bytearray(), FIRST, NO_GRANULE
    last_granule = 0

    def flush(more: int) -> None:
        nonlocal flags, granule
        pages.append((last_granule, make_page(flags, granule, serial, len(pages), bytes(lacing), bytes(body))))
        lacing.clear()
        body.clear()
        flags, granule = more, NO_GRANULE

    for k, (data, end) in enumerate(packets):
        at, done = 0, False
        while not done:
            if len(lacing) == segments:
                flush(CONTINUED if at else 0)
            piece = data[at : at + 255]
            lacing.append(len(piece))
            body += piece
            at += len(piece)
            done = len(piece) < 255
        granule = last_granule = end
        if k == len(packets) - 1:
            flags |= LAST
            flush(0)
        elif k == 0:
            flush(0)
    return pages


def mux(streams: list[tuple[int, list[tuple[bytes, int]]]], segments: int = PAGE_SEGMENTS) -> bytes:
    """One physical stream of (serial, packets): all first pages, then the pages by granule."""
    paged = [(s, pages_of(s, packets, segments)) for s, packets in streams]
    rest = sorted(((g, i, k) for i, (_, p) in enumerate(paged) for k, (g, _) in enumerate(p) if k))
    return b"".join([*(p[0][1] for _, p in paged), *(paged[i][1][k][1] for _, i, k in rest)])


@dataclass
class Stream:
    serial: int
    head: bytes | None = None
    packets: list[tuple[int, bytes]] = field(default_factory=list)  # granule at its end, data
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _next: int = 0
    _partial: bytearray | None = None


def demux(media: bytes) -> tuple[list[Stream], int]:
    """The logical streams in order of appearance, and how many damaged places were skipped.

    A page counts only if its checksum holds; reading resumes at the next capture pattern. A packet that lost a page is
    dropped and counted as a gap. A page's granule is that of the last packet it completes; the packets before it end
    earlier by the length of what follows (one sample a byte).
    """
    streams: dict[int, Stream] = {}
    at = bad = 0
    while (found := media.find(CAPTURE, at)) >= 0:
        bad += found > at
        at = found
        if len(media) < at + HEADER.size:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or len(media) < end or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at += len(CAPTURE)
            continue
        body, at = page[HEADER.size + n :], end
        s = streams.setdefault(serial, Stream(serial))
        if number != s._next:
            s.gaps += 1
            s._partial = None
        s._next, s.pages, s.ended = number + 1, s.pages + 1, s.ended or bool(flags & LAST)
        partial = s._partial if flags & CONTINUED else bytearray()
        done: list[bytes] = []
        place = 0
        for size in lacing:
            if partial is not None:
                partial += body[place : place + size]
            place += size
            if size < 255:
                if partial is not None:
                    done.append(bytes(partial))
                partial = bytearray()
        s._partial = partial
        if flags & FIRST and done:
            s.head, done = done[0], done[1:]
        upto = granule
        for data in reversed(done):
            s.packets.append((upto, data))
            upto -= len(data)
        if done:
            s.packets[-len(done) :] = s.packets[: -len(done) - 1 : -1]
    return list(streams.values()), bad + (at < len(media) and media.find(CAPTURE, at) < 0)


def store(payload: bytes) -> bytes:
    """An even number of 8-bit samples as stereo Ogg: even places are channel 0, odd ones channel 1."""
    streams = []
    for channel in (0, 1):
        samples = payload[channel::2]
        head = HEAD.pack(MAGIC, RATE, 2, channel, len(samples))
        ends = range(PACKET_SAMPLES, len(samples) + PACKET_SAMPLES, PACKET_SAMPLES)
        streams.append((channel + 1, [(head, 0), *((samples[e - PACKET_SAMPLES : e], min(e, len(samples))) for e in ends)]))
    return mux(streams)


def load(media: bytes | None) -> dict:
    """Payload, counts, duration and a feature string of a stored medium.

    Each packet goes where its granule says, so lost packets leave silence (128) and nothing shifts. Damaged or foreign
    media give whatever pages hold, down to an empty payload; None counts as no bytes. The duration is that of the
    granule positions, so it ends with the last packet that is there.
    """
    streams, bad = demux(media or b"")
    heads = {s.serial: HEAD.unpack(s.head) for s in streams if s.head and len(s.head) == HEAD.size and s.head.startswith(MAGIC)}
    length = max((h[4] for h in heads.values()), default=0)
    # a damaged header cannot ask for more than the medium could hold
    length = min(length, len(media or b""))
    out = bytearray(b"\x80") * (2 * length)
    for s in streams:
        if s.serial in heads:
            channel = heads[s.serial][3] & 1
            for end, data in s.packets:
                start = end - len(data)
                if 0 <= start and end <= length:
                    out[2 * start + channel : 2 * end : 2] = data
    x = np.frombuffer(bytes(out), np.uint8).astype(np.int64) - 128
    packets = sum(len(s.packets) for s in streams)
    # granule positions give the time: that at which the last packet of any stream ends
    duration = max((end for s in streams if s.serial in heads for end, _ in s.packets), default=0) * 1000 // RATE
    crossings = int(((x[2:] < 0) != (x[:-2] < 0)).sum())
    loud = int(np.abs(x).sum()) * 1000 // max(len(x), 1)
    feature = f"streams={len(streams)};packets={packets};ms={duration};mean_abs={loud / 1000:.3f};crossings={crossings}"
    return {"payload": bytes(out), "streams": len(streams), "pages": sum(s.pages for s in streams), "packets": packets, "bad_pages": bad + sum(s.gaps for s in streams), "duration_ms": duration, "feature": feature}


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes, padded by spaces, as Ogg. A null text is an empty one."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
        media = [store(b.ljust(max(BLOCK, -(-len(b) // BLOCK) * BLOCK), bytes([PAD]))) for b in raw]
        return {"doc_id": rows["doc_id"], "n_bytes": [len(b) for b in raw], "media": media}

    return arrow_map(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary", rows=500)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """What the stored bytes hold: digests of the payload and the medium, counts, duration and feature, beside doc_id and n_bytes."""
    names = ("streams", "pages", "packets", "bad_pages", "duration_ms")

    def run(rows: dict[str, list]) -> dict[str, list]:
        got = [load(m) for m in rows[media]]
        payloads = [g["payload"] for g in got]
        return {n: [g[n] for g in got] for n in (*names, "feature")} | {
            "doc_id": rows["doc_id"],
            "n_bytes": rows["n_bytes"],
            "payload_bytes": [len(p) for p in payloads],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": [zlib.crc32(p[-16:]) for p in payloads],
            "media_bytes": [len(m or b"") for m in rows[media]],
            "media_sha256": [hashlib.sha256(m or b"").hexdigest() for m in rows[media]],
        }

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + ", ".join(f"{n} long" for n in names)
    return arrow_map(df.select("doc_id", "n_bytes", media), run, schema, rows=500)


def packets(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet of a media column: stream, place, start and end in ms by granule, and data."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("key", "serial", "packet", "start_ms", "end_ms", "data")}
        for k, m in zip(rows[key], rows[media], strict=True):
            for s in demux(m or b"")[0]:
                for i, (end, data) in enumerate(s.packets):
                    for n, v in zip(out, (k, s.serial, i, (end - len(data)) * 1000 // RATE, end * 1000 // RATE, data), strict=True):
                        out[n].append(v)
        return out

    return arrow_map(df.select(key, media), run, "key long, serial long, packet long, start_ms long, end_ms long, data binary", rows=200).withColumnRenamed("key", key)


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(encode_texts(table(spark, sf_dir, "documents")))
