"""Transcripts and speakers' emotions as protocol-buffer messages: decoded, checked and encoded in Arrow batches.

A message is decoded by its field numbers. Unknown fields are left out, a field
of another wire type counts as unknown, unknown roles and directions become the
model's own defaults; a message that is cut off or is no transcript that can be
stored has an error instead.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parlance.operators.calls import fresh_name

# Field numbers with names and kinds; a star means repeated, a question mark that the field may be absent.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "Transcript": {1: ("call_id", "string"), 2: ("languages", "*LanguageProbability"), 3: ("speakers", "*SpeakerMetadata"), 4: ("segments", "*TranscriptSegment")},
    "LanguageProbability": {1: ("language", "string"), 2: ("probability", "float")},
    "SpeakerMetadata": {1: ("speaker_id", "uint"), 2: ("role", "role"), 3: ("talk_time_ms", "uint"), 4: ("word_count", "uint")},
    "TranscriptSegment": {
        1: ("id", "string"), 2: ("call_id", "string"), 3: ("sequence", "uint"), 4: ("speaker_id", "uint"), 5: ("speaker_role", "role"), 6: ("language", "string"), 7: ("text_direction", "direction"),
        8: ("start_ms", "uint"), 9: ("end_ms", "uint"), 10: ("raw_text", "string"), 11: ("normalized_text", "string"), 12: ("words", "*TranscriptWord"),
    },
    "TranscriptWord": {1: ("text", "string"), 2: ("start_ms", "uint"), 3: ("end_ms", "uint"), 4: ("speaker_id", "uint"), 5: ("speaker_role", "role"), 6: ("language", "string"), 7: ("confidence", "?float")},
    "SpeakerEmotions": {1: ("call_id", "string"), 2: ("spans", "*SpeakerEmotionSpan"), 3: ("summaries", "*SpeakerEmotionSummary"), 4: ("model", "string")},
    "SpeakerEmotionSpan": {1: ("speaker_id", "uint"), 2: ("start_ms", "uint"), 3: ("end_ms", "uint"), 4: ("scores", "*EmotionScore")},
    "SpeakerEmotionSummary": {1: ("speaker_id", "uint"), 2: ("scores", "*EmotionScore"), 3: ("dominant", "string")},
    "EmotionScore": {1: ("emotion", "string"), 2: ("score", "float")},
}
ENUMS = {"role": ("unknown", "speaker_1", "speaker_2", "participant", "agent", "customer", "supervisor", "unknown"), "direction": ("ltr", "ltr", "rtl")}
#: Wire types: a varint, eight bytes, a length with as many bytes, four bytes.
VARINT, EIGHT, LENGTH, FOUR = 0, 1, 2, 5
_WIRE = {"string": LENGTH, "float": FOUR, "uint": VARINT, "role": VARINT, "direction": VARINT}
_EMPTY = {"string": "", "float": 0.0, "uint": 0, "role": ENUMS["role"][0], "direction": ENUMS["direction"][0]}
MOST_SPEAKER = 65_535


class Broken(ValueError):
    """Bytes that are no message."""


def varint(raw: bytes, at: int) -> tuple[int, int]:
    """A number and the place behind it."""
    out = 0
    for k in range(10):
        if at >= len(raw):
            raise Broken("cut off")
        b = raw[at]
        at += 1
        out |= (b & 127) << 7 * k
        if b < 128:
            return out & (1 << 64) - 1, at
    raise Broken("a number of over ten bytes")


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message's fields in their order."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == VARINT:
            value, at = varint(raw, at)
        else:
            n, at = varint(raw, at) if kind == LENGTH else ({EIGHT: 8, FOUR: 4}.get(kind, -1), at)
            if n < 0 or at + n > len(raw) or not key >> 3:
                raise Broken("cut off, or of an unknown wire type")
            value, at = raw[at : at + n], at + n
        yield key >> 3, kind, value


def decode(raw: bytes, message: str) -> dict:
    """A message's fields by name; absent ones have their kind's empty value, and of repeated values of a plain field the last counts."""
    spec = MESSAGES[message]
    out = {name: [] if kind[0] == "*" else _EMPTY.get(kind) for name, kind in spec.values()}
    for number, wire, value in fields(raw):
        name, kind = spec.get(number, ("", ""))
        plain = kind.lstrip("?*")
        if not name or wire != _WIRE.get(plain, LENGTH):
            continue
        if kind[0] == "*":
            out[name].append(decode(value, plain))
        elif plain == "string":
            try:
                out[name] = value.decode()
            except UnicodeDecodeError as e:
                raise Broken("no text") from e
        elif plain == "float":
            out[name] = struct.unpack("<f", value)[0]
        elif plain == "uint":
            out[name] = value
        else:
            out[name] = ENUMS[plain][value] if value < len(ENUMS[plain]) else ENUMS[plain][0]
    return out


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(value: dict, message: str) -> bytes:
    """The message of some fields by name; empty ones are left out."""
    out = bytearray()
    for number, (name, kind) in MESSAGES[message].items():
        v, plain = value.get(name), kind.lstrip("?*")
        if kind[0] == "*":
            for x in v or []:
                body = encode(x, plain)
                out += _number(number << 3 | LENGTH) + _number(len(body)) + body
            continue
        if plain in ENUMS:
            v = ENUMS[plain].index(v) if v in ENUMS[plain] else 0
            v = len(ENUMS[plain]) - 1 if plain == "role" and v == 0 else max(v, 1)  # a value is always told
        if v is None or (kind[0] != "?" and v == _EMPTY[plain]):
            continue
        head = _number(number << 3 | _WIRE[plain])
        if plain == "string":
            body = v.encode()
            out += head + _number(len(body)) + body
        else:
            out += head + (struct.pack("<f", v) if plain == "float" else _number(int(v) & (1 << 64) - 1))
    return bytes(out)


def problem(transcript: dict) -> str | None:
    """Why a transcript can't be stored: no segments, an id that is no UUID, or a speaker of more than 16 bits."""
    if not transcript["segments"]:
        return "empty"
    for name, ids in (("call_id", [transcript["call_id"], *[s["call_id"] for s in transcript["segments"]]]), ("segment_id", [s["id"] for s in transcript["segments"]])):
        for x in ids:
            try:
                uuid.UUID(x)
            except ValueError:
                return name
    speakers = [x["speaker_id"] for s in transcript["segments"] for x in (s, *s["words"])] + [s["speaker_id"] for s in transcript["speakers"]]
    return "speaker_id" if max(speakers) > MOST_SPEAKER else None


def emotions_json(raw: bytes) -> str:
    """A SpeakerEmotions message as the JSON that results are kept in."""
    e = decode(raw, "SpeakerEmotions")
    return json.dumps({"kind": "speaker_emotions", "model": e["model"], "call_id": e["call_id"], "summaries": [{k: s[k] for k in ("speaker_id", "dominant", "scores")} for s in e["summaries"]], "spans": e["spans"]}, ensure_ascii=False, sort_keys=True)


def type_of(message: str) -> T.StructType:
    kinds = {"string": T.StringType(), "float": T.FloatType(), "uint": T.LongType(), "role": T.StringType(), "direction": T.StringType()}
    return T.StructType([T.StructField(name, T.ArrayType(type_of(kind[1:])) if kind[0] == "*" else kinds[kind.lstrip("?")]) for name, kind in MESSAGES[message].values()])


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.StringType(): pa.string(), T.FloatType(): pa.float32(), T.LongType(): pa.int64()}[kind]


def decoded(rows: DataFrame, column: str, out: str = "transcript") -> DataFrame:
    """``rows`` with the transcript of a column of messages, and ``error`` where there is none that can be stored."""
    kind, at = type_of("Transcript"), rows.columns.index(column)
    out, error = fresh_name(rows.columns, out), fresh_name(rows.columns, "error")

    def one(raw: bytes | None) -> tuple[dict | None, str | None]:
        try:
            found = decode(raw or b"", "Transcript")
        except Broken:
            return None, "broken"
        why = problem(found)
        return (None, why) if why else (found, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], _arrow(kind)), pa.array([e for _, e in found], pa.string())], [*batch.schema.names, out, error])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, kind), T.StructField(error, T.StringType())]))


def encoded(rows: DataFrame, column: str, out: str = "message") -> DataFrame:
    """``rows`` with the message of a transcript column (fields by name; missing ones are empty)."""
    at, out = rows.columns.index(column), fresh_name(rows.columns, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if (v := x.as_py()) is None else encode(v, "Transcript") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))
