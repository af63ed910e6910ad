"""Stored files: whole or not there, with the digest of what was written."""

import hashlib

import pytest

from parlance.sources import publish


def test_put(spark, tmp_path):
    parts = [b"a" * 100_000, b"", b"end"]
    want = len(b"".join(parts)), hashlib.sha256(b"".join(parts)).hexdigest()
    assert publish.put(spark, str(tmp_path), "calls/../1.wav", parts) == want
    assert (tmp_path / "calls/1.wav").read_bytes() == b"".join(parts)
    with pytest.raises(publish.Taken):
        publish.put(spark, str(tmp_path), "calls/1.wav", [b"other"])
    assert publish.put(spark, str(tmp_path), "calls/1.wav", [b"new"], replace=True)[0] == 3 and (tmp_path / "calls/1.wav").read_bytes() == b"new"
    assert publish.put(spark, str(tmp_path), "empty", []) == (0, hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError):
        publish.put(spark, str(tmp_path), "../..", [b"x"])


def test_a_writer_that_dies_leaves_nothing_to_see(spark, tmp_path):
    def dying():
        yield b"some"
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        publish.put(spark, str(tmp_path), "calls/2.wav", dying())
    assert publish.names(spark, f"{tmp_path}/calls") == [] and publish.names(spark, f"{tmp_path}/nothing") == []
    assert publish.publish(spark, str(tmp_path), "m", "text") and not publish.publish(spark, str(tmp_path), "m", "other")
    assert publish.read(spark, f"{tmp_path}/m") == "text" and publish.names(spark, str(tmp_path)) == ["calls", "m"]
