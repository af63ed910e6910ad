"""Messages by hand, against the protocol-buffer library, and there and back."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from parlance.sources import wire

ID = "6f1c1f0e-3c5d-4b1e-9b57-0d9a4f6f2a11"


def transcript(rng, segments=3):
    word = lambda: {"text": rng.choice(["a", "é", "שלום", ""]), "start_ms": rng.randrange(2**40), "end_ms": 7, "speaker_id": rng.randrange(65_536), "speaker_role": rng.choice(wire.ENUMS["role"]), "language": "he", "confidence": rng.choice([None, 0.0, 0.5])}
    return {
        "call_id": str(uuid.UUID(int=rng.getrandbits(128))), "languages": [{"language": "en", "probability": 0.25}, {"language": "x-new", "probability": 0.0}],
        "speakers": [{"speaker_id": 1, "role": "agent", "talk_time_ms": 2**33, "word_count": 0}],
        "segments": [{"id": str(uuid.UUID(int=rng.getrandbits(128))), "call_id": ID, "sequence": k, "speaker_id": k, "speaker_role": "customer", "language": "ru", "text_direction": rng.choice(["ltr", "rtl"]), "start_ms": 0, "end_ms": 300, "raw_text": "t" * rng.randrange(300), "normalized_text": "", "words": [word() for _ in range(rng.randrange(4))]} for k in range(segments)],
    }


def library():
    """The same messages in the protocol-buffer library."""
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    kinds = {"string": 9, "float": 2, "uint": 4, "role": 5, "direction": 5}
    for name, spec in wire.MESSAGES.items():
        m = file.message_type.add(name=name)
        for number, (field, kind) in spec.items():
            f = m.field.add(name=field, number=number, label=3 if kind[0] == "*" else 1, type=kinds.get(kind.lstrip("?*"), 11))
            if kind[0] == "*":
                f.type_name = ".t." + kind[1:]
            if kind[0] == "?":
                f.proto3_optional, f.oneof_index = True, len(m.oneof_decl)
                m.oneof_decl.add(name="_" + field)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return lambda name: message_factory.GetMessageClass(pool.FindMessageTypeByName("t." + name))


def test_there_and_back():
    rng, of = random.Random(1), library()
    for _ in range(50):
        t = transcript(rng)
        raw = wire.encode(t, "Transcript")
        assert wire.decode(raw, "Transcript") == t and wire.problem(t) is None
        m = of("Transcript").FromString(raw)  # the library reads it, writes the same, and has the same values
        assert m.SerializeToString(deterministic=True) == raw
        assert [(s.id, s.speaker_role, s.text_direction, [w.text for w in s.words]) for s in m.segments] == [(s["id"], 5, 2 if s["text_direction"] == "rtl" else 1, [w["text"] for w in s["words"]]) for s in t["segments"]]


def test_bytes_by_hand():
    assert wire.encode({"emotion": "joy", "score": 0.5}, "EmotionScore") == b"\x0a\x03joy\x15\x00\x00\x00\x3f"
    assert wire.decode(b"\x0a\x03joy\x15\x00\x00\x00\x3f", "EmotionScore") == {"emotion": "joy", "score": 0.5}
    word = b"\x10\xac\x02" + b"\x28\x63"  # start 300; a role of 99
    got = wire.decode(word, "TranscriptWord")
    assert got["start_ms"] == 300 and got["speaker_role"] == "unknown" and got["confidence"] is None and got["text"] == ""
    newer = b"\xa8\x06\x01" + b"\xaa\x06\x02hi" + b"\xad\x06abcd" + b"\xa9\x06abcdefgh" + b"\x0d1234" + b"\x0a\x01x\x0a\x01y"  # fields 101 in every wire type, field 1 of a wrong type, field 1 twice
    assert wire.decode(newer, "TranscriptWord")["text"] == "y"
    assert wire.decode(b"\x38\x09", "TranscriptSegment")["text_direction"] == "ltr"


@pytest.mark.parametrize("raw", [b"\x0a", b"\x0a\x05ab", b"\x10\xff", b"\x10" + b"\xff" * 11, b"\x0b", b"\x07", b"\x15ab", b"\x0a\x02\xff\xfe", b"\x02\x00"])
def test_broken_messages(raw):
    with pytest.raises(wire.Broken):
        wire.decode(raw, "TranscriptWord")


def test_every_cut_of_a_message_is_broken_or_shorter():
    raw = wire.encode(transcript(random.Random(2)), "Transcript")
    for n in range(len(raw)):
        try:
            wire.decode(raw[:n], "Transcript")
        except wire.Broken:
            pass


def test_what_cannot_be_stored():
    t = lambda **x: transcript(random.Random(3)) | x
    seg = lambda **x: t(segments=[t()["segments"][0] | x])
    assert [wire.problem(x) for x in (t(segments=[]), t(call_id="x"), seg(call_id=""), seg(id="1"), seg(speaker_id=65_536), seg(speaker_id=65_535), t(speakers=[{"speaker_id": 70_000}]))] == ["empty", "call_id", "call_id", "segment_id", "speaker_id", None, "speaker_id"]


def test_emotions():
    e = {"call_id": ID, "model": "m", "spans": [{"speaker_id": 1, "start_ms": 2, "end_ms": 3, "scores": [{"emotion": "joy", "score": 0.5}]}], "summaries": [{"speaker_id": 1, "dominant": "joy", "scores": []}]}
    assert json.loads(wire.emotions_json(wire.encode(e, "SpeakerEmotions"))) == {"kind": "speaker_emotions"} | e


def test_columns(spark):
    rng = random.Random(4)
    good = [transcript(rng) for _ in range(20)]
    raw = [(k, wire.encode(t, "Transcript"), "own") for k, t in enumerate(good)] + [(100, b"\x0a", "own"), (101, None, "own"), (102, b"", "own")]
    rows = spark.createDataFrame(raw, "id int, raw binary, error string")
    got = wire.decoded(rows, "raw")
    by = {r.id: r for r in got.collect()}
    assert [by[k].error_1 for k in (0, 100, 101, 102)] == [None, "broken", "empty", "empty"] and by[0].error == "own"
    assert by[3].transcript.asDict(recursive=True) == good[3]
    back = wire.encoded(got.where(F.col("transcript").isNotNull()), "transcript").collect()
    assert {r.id: bytes(r.message) for r in back} == {k: r for k, r, _ in raw[:20]}
