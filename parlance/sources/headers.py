"""Rate, channels and duration of recordings from their headers: parts of a file are read, never all of it.

Ogg (Opus, Vorbis, FLAC), MP4/M4A, FLAC, MP3, WAV and ADTS. What the parsers
need is asked for by place and length, so a long recording costs a few
kilobytes. Files are opened where the task runs, from any file system that
Arrow knows, or from the mounted path.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parlance.sources.files import ENDINGS

#: ``read(at, n)`` gives up to n bytes from a place.
Read = Callable[[int, int], bytes]
#: (container, rate, channels, frames); frames are null where the header doesn't tell them.
Header = tuple[str, int, int, int | None]

#: Bytes at an Ogg file's end in which its last page begins: a page has 65,307 at most.
OGG_TAIL = 65_536
OPUS_RATE = 48_000
#: Boxes of an MP4 file that hold boxes on the way to a track's clock and format.
_HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
#: Bit rates of MPEG audio by (version 1, layer), sampling rates by version, and samples of a frame.
BIT_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}
AAC_RATES = (96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350)


def _wav(read: Read, size: int) -> Header | None:
    at, rate, channels, width = 12, 0, 0, 0
    while at + 8 <= size:
        head = read(at, 8)
        if len(head) < 8:
            return None
        name, n = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            _, channels, rate, _, width = struct.unpack("<HHIIH", read(at + 8, 14))
        if name == b"data" and rate and width:
            return "wav", rate, channels, min(n, size - at - 8) // width
        at += 8 + n + n % 2
    return None


def _streaminfo(block: bytes) -> tuple[int, int, int | None]:
    bits = int.from_bytes(block[10:18], "big")
    return bits >> 44, (bits >> 41 & 7) + 1, (bits & (1 << 36) - 1) or None


def _flac(read: Read, size: int, at: int = 0) -> Header | None:
    raw = read(at, 42)
    if raw[:4] != b"fLaC" or raw[4] & 0x7F or len(raw) < 42:
        return None
    return "flac", *_streaminfo(raw[8:])


def last_granule(tail: bytes, serial: bytes) -> int | None:
    """The position that the last whole page of a stream ends at."""
    at = len(tail)
    while (at := tail.rfind(b"OggS", 0, at)) >= 0:
        page = tail[at : at + 27]
        if len(page) == 27 and page[4] == 0 and page[14:18] == serial:
            granule = struct.unpack("<q", page[6:14])[0]
            if granule >= 0:
                return granule
    return None


def _ogg(read: Read, size: int) -> Header | None:
    first = read(0, 27 + 255 + 64)
    if len(first) < 28:
        return None
    packet, serial = first[27 + first[26] :], first[14:18]
    end = last_granule(read(max(0, size - OGG_TAIL), OGG_TAIL), serial)
    if packet.startswith(b"OpusHead"):
        channels, skip = packet[9], struct.unpack("<H", packet[10:12])[0]
        return "opus", OPUS_RATE, channels, None if end is None else max(0, end - skip)
    if packet.startswith(b"\x01vorbis"):
        channels, rate = struct.unpack("<BI", packet[11:16])
        return "vorbis", rate, channels, end
    if packet.startswith(b"\x7fFLAC"):
        rate, channels, frames = _streaminfo(packet[17:])
        return "ogg flac", rate, channels, frames or end
    return None


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of the contents, end) of the boxes between two places; their contents aren't read."""
    while at + 8 <= end:
        head = read(at, 16)
        if len(head) < 8:
            return
        n, name, start = struct.unpack(">I", head[:4])[0], head[4:8], at + 8
        if n == 1 and len(head) == 16:
            n, start = struct.unpack(">Q", head[8:])[0], at + 16
        n = n or end - at
        if n < start - at:
            return
        yield name, start, min(at + n, end)
        at += n


def _mp4(read: Read, size: int) -> Header | None:
    tracks: list[dict] = []

    def walk(at: int, end: int) -> None:
        for name, start, stop in boxes(read, at, end):
            if name == b"trak":
                tracks.append({})
            if name in _HOLDERS:
                walk(start, stop)
            elif tracks and name == b"hdlr":
                tracks[-1]["sound"] = read(start + 8, 4) == b"soun"
            elif tracks and name == b"mdhd":
                raw = read(start, 32)
                tracks[-1]["clock"] = struct.unpack(">IQ", raw[20:32]) if raw[0] else struct.unpack(">II", raw[12:20])
            elif tracks and name == b"stsd":
                raw = read(start + 16, 28)  # past the counts and the entry's size and name
                tracks[-1]["format"] = struct.unpack(">H", raw[16:18])[0], struct.unpack(">I", raw[24:28])[0] >> 16

    walk(0, size)
    for t in tracks:
        if t.get("sound") and "clock" in t:
            scale, length = t["clock"]
            channels, rate = t.get("format", (0, 0))
            rate = rate or scale
            return "mp4", rate, channels, length * rate // scale if scale else None
    return None


def frame_header(raw: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(rate, channels, samples, bytes, bits a second, version 1) of an MPEG audio frame."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    bits, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    hz, kbps = MPEG_RATES[version][rate], BIT_RATES[version == 3, layer][bits - 1]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    slot = 4 if layer == 1 else 1
    return hz, 1 if raw[3] >> 6 == 3 else 2, samples, (samples // 8 // slot * kbps * 1000 // hz + (raw[2] >> 1 & 1)) * slot, kbps * 1000, version == 3


def _tagged(read: Read) -> int:
    """Where the audio begins behind an ID3 tag."""
    head = read(0, 10)
    if head[:3] != b"ID3" or len(head) < 10:
        return 0
    return 10 + sum((b & 127) << 7 * (3 - k) for k, b in enumerate(head[6:10])) + (10 if head[5] & 16 else 0)


def _mp3(read: Read, size: int) -> Header | None:
    at = _tagged(read)
    raw = read(at, 4096)
    for k in range(max(len(raw) - 4, 0)):
        frame = frame_header(raw[k : k + 4])
        if frame is None:
            continue
        follows = frame_header(read(at + k + frame[3], 4))
        if follows is None and at + k + frame[3] < size:
            continue
        hz, channels, samples, _, bits, first = frame
        side = (17 if channels == 1 else 32) if first else (9 if channels == 1 else 17)
        tag = raw[k + 4 + side : k + 16 + side]
        if tag[:4] in (b"Xing", b"Info") and tag[7] & 1:
            return "mp3", hz, channels, struct.unpack(">I", tag[8:12])[0] * samples
        if raw[k + 36 : k + 40] == b"VBRI":
            return "mp3", hz, channels, struct.unpack(">I", raw[k + 50 : k + 54])[0] * samples
        return "mp3", hz, channels, (size - at - k) * 8 * hz // bits
    return None


def _adts(read: Read, size: int) -> Header | None:
    raw = read(_tagged(read), 7)
    if len(raw) < 7 or raw[0] != 0xFF or raw[1] & 0xF6 != 0xF0 or (raw[2] >> 2 & 15) >= len(AAC_RATES):
        return None
    return "aac", AAC_RATES[raw[2] >> 2 & 15], (raw[2] & 1) << 2 | raw[3] >> 6, None


def header(read: Read, size: int) -> Header | None:
    """What a recording's header says; None for what is no recording, is cut off or is broken."""
    try:
        start = read(0, 12)
        if start[:4] == b"RIFF" and start[8:12] == b"WAVE":
            return _wav(read, size)
        if start[:4] == b"OggS":
            return _ogg(read, size)
        if start[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
            return _mp4(read, size)
        tag = _tagged(read)
        return _flac(read, size, tag) or _adts(read, size) or _mp3(read, size)
    except (struct.error, IndexError, ZeroDivisionError, KeyError):
        return None


def _opened(path: str) -> tuple[pa.NativeFile, int]:
    from pyarrow import fs

    # a path as Spark's file source tells it: a local one isn't escaped
    local = path.removeprefix("file:") if path.startswith(("/", "file:")) else None
    files, place = fs.FileSystem.from_uri(path) if local is None else (fs.LocalFileSystem(), "/" + local.lstrip("/"))
    return files.open_input_file(place), files.get_file_info(place).size


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Of each recording in ``folder``: path, container, rate, channels, duration_ms and read_bytes, how much of it was read.

    Files that can't be understood have nulls. A recording's duration is its
    frames times 1000 over its rate, rounded down.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                counted = [0]
                file, size = _opened(path)

                def read(at: int, n: int, file=file, counted=counted) -> bytes:
                    file.seek(at)
                    raw = file.read(n)
                    counted[0] += len(raw)
                    return raw

                with file:
                    found = header(read, size)
                kind, rate, channels, frames = found or (None,) * 4
                out.append((path, kind, rate, channels, frames * 1000 // rate if found and frames is not None and rate else None, counted[0]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "container", "rate", "channels", "duration_ms", "read_bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", ENDINGS).load(folder).select("path")  # contents aren't read
    return files.mapInArrow(run, "path string, container string, rate int, channels int, duration_ms bigint, read_bytes bigint")
