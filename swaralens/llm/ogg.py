"""Ogg as a media column: pages with checksums, lacing, logical streams and granule positions.

A payload of bytes is taken as 8-bit samples in packets of PACKET bytes. Packets go to two logical
streams in turn (even and odd ones); each stream starts with a header packet on a page of its own.
Pages of both streams are interleaved by the time their last packet ends. Reading verifies each
page's checksum and sequence number, rebuilds packets from lacing values (also across pages),
separates the streams by serial number and takes packet times from granule positions. A damaged,
incomplete or foreign file is an OggError, which a row of a table carries in its error column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

PACKET = 576
RATE = 8000
MAGIC = b"SWLRAW8\x01"
#: Lacing values a page holds at most; below the format's 255, so that packets also cross pages.
SEGMENTS = 100
PAGE = struct.Struct("<4sBBqIIIB")
HEAD = struct.Struct("<8sIIQBB")
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """What was read isn't a sound Ogg file."""


def checksum(data: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, highest bit first, start 0): zlib's on mirrored bits."""
    mirrored = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(flags: int, granule: int, serial: int, number: int, table: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(table))
    crc = checksum(head + table + body)
    return b"".join((head[:22], crc.to_bytes(4, "little"), head[26:], table, body))


def stream_pages(serial: int, packets: list[bytes], granules: list[int], segments: int = SEGMENTS) -> list[tuple[int, bytes]]:
    """(granule position by which a page is needed, page) of one logical stream. The first packet,
    its header, has a page of its own. granules: the position at each packet's end."""
    out = [(-1, page(FIRST | (LAST if len(packets) == 1 else 0), granules[0], serial, 0, lacing(len(packets[0])), packets[0]))]
    table = b"".join(lacing(len(p)) for p in packets[1:])
    body = b"".join(packets[1:])
    ends = np.flatnonzero(np.frombuffer(table, np.uint8) != 255)
    at = number = 0
    reached = 0
    for begin in range(0, len(table), segments):
        part = table[begin : begin + segments]
        size = sum(part)
        done = int(np.searchsorted(ends, begin + len(part)))
        flags = (CONTINUED if begin and table[begin - 1] == 255 else 0) | (LAST if begin + segments >= len(table) else 0)
        granule = granules[done] if done > reached else -1
        number += 1
        out.append((granules[min(done, len(granules) - 1)], page(flags, granule, serial, number, part, body[at : at + size])))
        at, reached = at + size, done
    return out


def write(payload: bytes, n_bytes: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """payload, of which the first n_bytes aren't padding, as an Ogg file of two logical streams."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    pages = []
    for lane in (0, 1):
        packets = [HEAD.pack(MAGIC, rate, packet, n_bytes, lane, 2)]
        granules = [0]
        for start in range(lane * packet, len(payload), 2 * packet):
            packets.append(payload[start : start + packet])
            granules.append(min(start + packet, len(payload)))
        pages += [(needed, k, lane, data) for k, (needed, data) in enumerate(stream_pages(serial | lane, packets, granules))]
    pages.sort(key=lambda p: (p[0], p[2], p[1]) if p[1] else (-1, p[2], 0))
    # Pages of one stream keep their order: needed never falls within a stream.
    return b"".join(p[3] for p in pages)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: The position at each packet's end; None where its page ends other packets as well.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number, in order of appearance."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise OggError(f"cut short at {at}")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        begin = at + PAGE.size + n
        table = data[at + PAGE.size : begin]
        end = begin + sum(table)
        if len(table) < n or end > len(data):
            raise OggError(f"cut short at {at}")
        if checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) != crc:
            raise OggError(f"checksum of the page at {at}")
        stream = streams.get(serial)
        if stream is None:
            if not flags & FIRST:
                raise OggError(f"stream {serial} has no first page")
            stream = streams[serial] = Stream()
        elif flags & FIRST or stream.ended:
            raise OggError(f"stream {serial} starts or ends twice")
        if number != stream.pages:
            raise OggError(f"page {stream.pages} of stream {serial} is missing")
        if bool(flags & CONTINUED) != bool(stream.open):
            raise OggError(f"a packet of stream {serial} is broken")
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        size, before = 0, len(stream.packets)
        for value in table:
            size += value
            if value < 255:
                stream.packets.append(b"".join((*stream.open, data[begin : begin + size])))
                stream.open = []
                begin, size = begin + size, 0
        if size:
            stream.open.append(data[begin : begin + size])
        done = len(stream.packets) - before
        if (granule == -1) != (done == 0):
            raise OggError(f"granule position of page {number} of stream {serial}")
        if done:
            stream.granules += [None] * (done - 1) + [granule]
        at = end
    for serial, stream in streams.items():
        if stream.open or not stream.ended:
            raise OggError(f"stream {serial} does not end")
    return streams


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    rate: int
    streams: int
    packets: int
    pages: int
    #: Seconds at which each stream ends, in order of its lane.
    ends: list[float]


def decode(data: bytes) -> Media:
    """What write() stored. Packets are put in order by their times: a page's granule position is
    the time at which its last packet ends; earlier ones on it end a stream's stride before."""
    streams = read(data)
    timed: list[tuple[int, bytes]] = []
    ends: dict[int, float] = {}
    n_bytes = rate = 0
    for serial, stream in streams.items():
        if len(stream.packets[0]) != HEAD.size or not stream.packets[0].startswith(MAGIC):
            raise OggError(f"unknown header in stream {serial}")
        _, rate, packet, n_bytes, lane, lanes = HEAD.unpack(stream.packets[0])
        if not rate or not packet or lane >= lanes:
            raise OggError(f"unsound header in stream {serial}")
        stride = lanes * packet
        time: int | None = None
        for body, granule in zip(reversed(stream.packets[1:]), reversed(stream.granules[1:])):
            if granule is not None:
                time = granule
            elif time is None:
                raise OggError(f"no time for the last packet of stream {serial}")
            else:
                time -= stride
            timed.append((time, body))
        ends[lane] = (stream.granules[-1] or 0) / rate
    if not timed:
        raise OggError("no samples")
    timed.sort(key=lambda x: x[0])
    return Media(b"".join(b for _, b in timed), n_bytes, rate, len(streams), len(timed), sum(s.pages for s in streams.values()), [ends[k] for k in sorted(ends)])


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    size = max(PACKET, -(-len(raw) // PACKET) * PACKET)
    return raw.ljust(size, b"\xff"), len(raw)


def features(media: Media) -> str:
    """Duration, layout, mean level, RMS around 128 and rate of crossings of 128, from the samples read back."""
    samples = np.frombuffer(media.payload, np.uint8)
    centred = samples.astype(np.float32) - 128
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    rms = float(np.sqrt(np.mean(centred.astype(np.float64) ** 2)))
    return f"rate={media.rate};streams={media.streams};packets={media.packets};pages={media.pages};seconds={len(samples) / media.rate:.3f};ends={'/'.join(f'{e:.3f}' for e in media.ends)};mean={samples.mean(dtype=np.float64):.3f};rms={rms:.3f};crossings={crossings}"


def to_media(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, media): each whole text's UTF-8 bytes as an Ogg file.

    A null text is stored as the empty one (one packet of padding). Equal texts give equal files.
    Rows and ids may repeat or be null; an empty table gives an empty result; further columns are
    ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            ids, texts = batch.column("doc_id"), texts_of(batch)
            for k in range(0, len(texts), 512):
                part = texts[k : k + 512]
                yield pa.RecordBatch.from_arrays([ids.slice(k, len(part)), pa.array([write(*padded(t)) for t in part], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> digests and features of what is read back, and error. A null file gives
    nulls. A damaged one, or one that isn't of write()'s making, gives its own size and digest, what is
    wrong with it in error, and nulls otherwise. Further columns are ignored."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                stored = value.as_py()
                if stored is None:
                    rows.append((None,) * 8)
                    continue
                own = len(stored), hashlib.sha256(stored).hexdigest()
                try:
                    m = decode(stored)
                except OggError as error:
                    rows.append((None,) * 4 + (*own, None, str(error)))
                    continue
                rows.append((m.n_bytes, len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-32:]), *own, features(m), None))
            columns = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, schema)
