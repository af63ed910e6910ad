"""Headers of files made here, byte by byte, with known lengths; how much of a long file is read."""

import io
import struct
import wave

import pytest

from parlance.sources import headers as H


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def mp4(rate=44_100, channels=2, scale=48_000, length=480_000, audio=b"\0" * 500_000, moov_first=False, wide=False):
    mdhd = struct.pack(">IQQIQI", 1 << 24, 0, 0, scale, length, 0) if wide else struct.pack(">IIIIII", 0, 0, 0, scale, length, 0)
    sample = b"\0" * 6 + struct.pack(">HQHHHHI", 1, 0, channels, 16, 0, 0, rate << 16)
    stsd = box(b"stsd", struct.pack(">II", 0, 1) + box(b"mp4a", sample))
    table = box(b"stsz", b"\0" * 200_000)
    video = box(b"trak", box(b"mdia", box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 90_000, 1, 0)) + box(b"hdlr", struct.pack(">II", 0, 0) + b"vide" + b"\0" * 13)))
    sound = box(b"trak", box(b"mdia", box(b"mdhd", mdhd) + box(b"hdlr", struct.pack(">II", 0, 0) + b"soun" + b"\0" * 13) + box(b"minf", box(b"stbl", table + stsd))))
    moov, head = box(b"moov", box(b"mvhd", b"\0" * 100) + video + sound), box(b"ftyp", b"M4A \0\0\0\0")
    data = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + len(audio)) + audio
    return head + (moov + data if moov_first else data + moov)


def page(packet, granule, serial=7, flags=0):
    lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
    return b"OggS" + bytes([0, flags]) + struct.pack("<qIII", granule, serial, 0, 0) + bytes([len(lacing)]) + lacing + packet


def opus(channels=1, skip=312, end=480_312, pages=40):
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, channels, skip, 16_000, 0, 0)
    body = b"".join(page(b"x" * 4000, (k + 1) * end // pages) for k in range(pages))
    return page(head, 0, flags=2) + page(b"OpusTags" + b"\0" * 300, 0) + body


def vorbis(rate=22_050, channels=2, end=44_100):
    head = b"\x01vorbis" + struct.pack("<IBIIIIBB", 0, channels, rate, 0, 0, 0, 0xB8, 1)
    return page(head, 0, flags=2) + page(b"x" * 300, end) + page(b"another stream", 10**9, serial=8) + page(b"unfinished", -1)


def flac(rate=8_000, channels=1, frames=80_000, tag=b""):
    info = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + (rate << 44 | channels - 1 << 41 | 15 << 36 | frames).to_bytes(8, "big") + b"\0" * 16
    return tag + b"fLaC" + bytes([0x80, 0, 0, 34]) + info + b"\xff\xf8" + b"\0" * 300_000


def mp3(frames=500, xing=None, tag=b"", mono=False):
    raw = b"\xff\xfb\x90" + (b"\xc0" if mono else b"\0")  # version 1, layer 3, 128 kbit/s, 44,100 Hz: 417 bytes
    first = raw + b"\0" * ((17 if mono else 32)) + (b"Xing" + struct.pack(">II", 1, xing) if xing else b"")
    return tag + first.ljust(417, b"\0") + (raw.ljust(417, b"\0")) * (frames - 1)


def wav(rate=8_000, channels=2, frames=16_000, odd=False):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0" * frames * channels * 2)
    raw = out.getvalue()
    return raw[:36] + b"LIST" + struct.pack("<I", 5) + b"odd..\0" + raw[36:] if odd else raw


ID3 = b"ID3\x04\0\0" + bytes([0, 0, 100, 0]) + b"\0" * 12_800
FILES = {
    "late.m4a": (mp4(), ("mp4", 44_100, 2, 10_000)),
    "early.m4a": (mp4(16_000, 1, 16_000, 40_000, moov_first=True), ("mp4", 16_000, 1, 2_500)),
    "wide.m4a": (mp4(0, 1, 48_000, 2**33, wide=True), ("mp4", 48_000, 1, 2**33 * 1000 // 48_000)),
    "a b%20c.ogg": (opus(), ("opus", 48_000, 1, 10_000)),
    "short.ogg": (opus(2, 400, 300, 1), ("opus", 48_000, 2, 0)),
    "vorbis.ogg": (vorbis(), ("vorbis", 22_050, 2, 2_000)),
    "x.flac": (flac(), ("flac", 8_000, 1, 10_000)),
    "tagged.flac": (flac(96_000, 6, 2**35, ID3), ("flac", 96_000, 6, 2**35 * 1000 // 96_000)),
    "endless.flac": (flac(frames=0), ("flac", 8_000, 1, None)),
    "xing.mp3": (mp3(500, 1000, ID3), ("mp3", 44_100, 2, 1000 * 1152 * 1000 // 44_100)),
    "xing mono.mp3": (mp3(9, 70, mono=True), ("mp3", 44_100, 1, 70 * 1152 * 1000 // 44_100)),
    "even.mp3": (mp3(500), ("mp3", 44_100, 2, 500 * 417 * 8 * 44_100 // 128_000 * 1000 // 44_100)),
    "x.wav": (wav(), ("wav", 8_000, 2, 2_000)),
    "odd.WAV": (wav(odd=True), ("wav", 8_000, 2, 2_000)),
    "x.aac": (b"\xff\xf1" + bytes([0x50, 0x80, 0x43, 0x80, 0]) + b"\0" * 100, ("aac", 44_100, 2, None)),
    "empty.mp3": (b"", (None,) * 4),
    "text.ogg": (b"no recording at all" * 100, (None,) * 4),
    "cut.m4a": (mp4()[:300_000], (None,) * 4),
    "cut.ogg": (opus()[:20], (None,) * 4),
    "cut.wav": (wav()[:20], (None,) * 4),
}


def test_headers(spark, tmp_path):
    for name, (raw, _) in FILES.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "note.txt").write_text("not listed")
    got = {r.path.rsplit("/", 1)[-1]: r for r in H.headers(spark, str(tmp_path)).collect()}
    assert got.keys() == FILES.keys() - {"empty.mp3"}  # Spark's file source leaves empty files out
    for name, r in got.items():
        raw, want = FILES[name]
        assert (r.container, r.rate, r.channels, r.duration_ms) == want, name
        assert r.read_bytes <= 80_000 and (len(raw) < 100_000 or r.read_bytes < len(raw) / 2), name


@pytest.mark.parametrize("name", FILES)
def test_cut_and_changed_files_give_no_error(name):
    raw = FILES[name][0][:3000]
    for n in range(0, len(raw), 37):
        for cut in (raw[:n], raw[:n] + b"\xff" * 40, raw[: n // 2] + raw[n:]):
            found = H.header(lambda at, k, cut=cut: cut[at : at + k], len(cut))
            assert found is None or len(found) == 4
