"""The polled source: nothing lost or doubled over restarts and failed batches, and waits that grow."""

import json

import pytest

from parlance.sources import updates as U


def page(folder, first, last, numbers=None):
    rows = [json.dumps({"update_id": n, "text": f"message {n}"}) for n in numbers or range(first, last + 1)]
    (folder / f"{first:08d}-{last:08d}.jsonl").write_text("\n".join([*rows, "no update", '{"update_id": "x"}']) + "\n")


def drain(spark, far, state, fail=None):
    """Takes all that is there into a table of batches; ``fail`` names the batch that fails after it has been written."""

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{state}/out/batch={number}")
        if number == fail:
            raise RuntimeError("the sink failed")

    q = U.updates(spark, str(far), part=4).writeStream.foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_nothing_is_lost_or_doubled(spark, tmp_path):
    far, state = tmp_path / "far", tmp_path / "state"
    far.mkdir()
    page(far, 3, 12)
    page(far, 10, 17)  # three are in both pages
    drain(spark, far, state)
    page(far, 18, 25, [25, 18, 20, 20])
    with pytest.raises(Exception, match="the sink failed"):
        drain(spark, far, state, fail=1)
    page(far, 26, 30)
    drain(spark, far, state)
    drain(spark, far, state)
    got = spark.read.parquet(f"{state}/out").collect()
    assert sorted(r.update_id for r in got) == [*range(3, 18), 18, 20, 25, *range(26, 31)]
    assert all(json.loads(r.body)["text"] == f"message {r.update_id}" for r in got)
    assert U.Far(str(far)).acknowledged() in (18, 26, 31)


def test_waits_double_up_to_a_minute(tmp_path):
    now = [0.0]
    reader = U.UpdatesReader({"path": str(tmp_path)}, clock=lambda: now[0])
    page(tmp_path, 1, 5)
    assert reader.latestOffset() == {"next": 6}
    (tmp_path / "down").touch()
    page(tmp_path, 6, 9)
    waits = []
    for _ in range(8):
        assert reader.latestOffset() == {"next": 6}
        waits.append(reader.backoff.wait)
        now[0] += reader.backoff.wait - 0.1
        (tmp_path / "down").rename(tmp_path / "up")
        assert reader.latestOffset() == {"next": 6}  # not yet asked again
        (tmp_path / "up").rename(tmp_path / "down")
        now[0] += 0.2
    assert waits == [1, 2, 4, 8, 16, 32, 60, 60]
    (tmp_path / "down").unlink()
    assert reader.latestOffset() == {"next": 10} and reader.backoff.due() and reader.backoff.wait == 0
