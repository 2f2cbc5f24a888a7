"""The bounded queue against a simulation of one, and delivery of results against failures and repetition."""

import collections
import random
import threading
import time

import pytest
from inkstream.sources import queue, results


def drained(spark, path, bursts, depth, **options):
    """Frames and drop counts of a stream that runs once after each burst of (stream, frame)."""
    queue.register(spark)
    reader = spark.readStream.format("frame_queue").option("path", f"{path}/spool").option("depth", depth).options(**options)
    taken, got = [], collections.defaultdict(list)
    q = None
    for burst in bursts:
        for s, f in burst:
            queue.put(f"{path}/spool", s, f, f"{s}:{f}".encode())
        batch = []
        q = reader.load().writeStream.option("checkpointLocation", f"{path}/c").foreachBatch(lambda df, n, b=batch: b.extend(df.collect())).start()
        q.processAllAvailable()
        q.stop()
        taken += batch
        for r in sorted(batch, key=lambda r: r.frame_id):
            assert bytes(r.content) == f"{r.stream_id}:{r.frame_id}".encode()
            got[r.stream_id].append((r.frame_id, r.dropped))
    return dict(got)


def simulated(bursts, depth):
    """One queue a stream: the oldest goes when it is full; the consumer takes all after each burst."""
    got = collections.defaultdict(list)
    for burst in bursts:
        held, lost = collections.defaultdict(collections.deque), collections.Counter()
        for s, f in burst:
            if len(held[s]) == depth:
                held[s].popleft()
                lost[s] += 1
            held[s].append(f)
        for s, frames in held.items():
            got[s] += [(f, 0 if k else lost[s]) for k, f in enumerate(frames)]
    return dict(got)


@pytest.mark.parametrize("depth", [1, 3, 50])
def test_queue_is_the_simulation(spark, tmp_path, depth):
    r = random.Random(depth)
    nexts, bursts = collections.Counter(), []
    for n in (7, 0, 2, 12, 1):
        burst = []
        for _ in range(n):
            s = r.randrange(2)
            nexts[s] += r.randrange(1, 4)
            burst.append((s, nexts[s]))
        bursts.append(burst)
    assert drained(spark, tmp_path, bursts, depth, framesPerTask=2) == simulated(bursts, depth)


def test_queue_cleans_up_what_is_done(spark, tmp_path):
    drained(spark, tmp_path, [[(0, 1), (0, 2)], [(0, 3)], [(0, 4)]], 5, clean="true")
    assert set(queue.Spool(f"{tmp_path}/spool").frames(0, -1)) <= {3, 4}
    with pytest.raises(ValueError, match="depth"):
        queue.QueueReader({"path": str(tmp_path), "depth": "0"})


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_a_batch_that_comes_again_is_no_second_result(spark, tmp_path):
    seen = []
    note = lambda n, df: seen.append((n, sorted(r.v for r in df.collect())))
    assert results.accept(rows(spark, 1, 2), 0, str(tmp_path), note)
    assert not results.accept(rows(spark, 1, 2), 0, str(tmp_path), note)

    def fails(n, df):
        raise RuntimeError("consumer lost")

    with pytest.raises(RuntimeError):
        results.accept(rows(spark, 3), 1, str(tmp_path), fails)
    cursor = results.Cursor(spark, str(tmp_path))
    assert [r.v for r in cursor.pull(0).orderBy("v").collect()] == [1, 2]
    with pytest.raises(results.QueueEmpty):  # the failed batch isn't delivered
        cursor.pull(0)
    assert results.accept(rows(spark, 3), 1, str(tmp_path), note)
    assert [r.v for r in cursor.pull(0).collect()] == [3] and seen == [(0, [1, 2]), (1, [3])]


def test_cursors_keep_their_places(spark, tmp_path):
    for n, v in ((0, 10), (1, 11), (2, 12)):
        results.accept(rows(spark, v), n, str(tmp_path))
    one = results.Cursor(spark, str(tmp_path), "one")
    assert one.pull(0).first().v == 10
    assert results.Cursor(spark, str(tmp_path), "one").pull(0).first().v == 10  # lost over the first batch
    again = results.Cursor(spark, str(tmp_path), "one")
    assert [again.pull(0).first().v for _ in range(3)] == [10, 11, 12]
    again.done()
    with pytest.raises(results.QueueEmpty):
        results.Cursor(spark, str(tmp_path), "one").pull(0)
    assert results.Cursor(spark, str(tmp_path), "two").pull(0).first().v == 10


def test_pull_waits_for_a_result(spark, tmp_path):
    began = time.monotonic()
    with pytest.raises(results.QueueEmpty):
        results.Cursor(spark, str(tmp_path)).pull(0.3)
    assert time.monotonic() - began >= 0.3
    threading.Timer(0.5, lambda: results.accept(rows(spark, 5), 0, str(tmp_path))).start()
    assert results.Cursor(spark, str(tmp_path)).pull(60).first().v == 5


def test_delivered_stream_survives_a_failure(spark, tmp_path):
    """The callback fails once in the middle; the query starts again from its checkpoint: each row once, in order."""
    for k in range(4):
        rows(spark, k, 100 + k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen, failed = [], []

    def once(n, df):
        if n == 2 and not failed:
            failed.append(n)
            raise RuntimeError("lost")
        seen.append(n)

    for _ in range(2):
        q = results.deliver(source, f"{tmp_path}/out", f"{tmp_path}/c", once, availableNow=True)
        try:
            q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001
            assert "lost" in str(e)
    assert seen == [0, 1, 2, 3] and failed == [2]
    cursor = results.Cursor(spark, f"{tmp_path}/out")
    pulled = [sorted(r.v for r in cursor.pull(0).collect()) for _ in range(4)]
    assert sorted(sum(pulled, [])) == [0, 1, 2, 3, 100, 101, 102, 103] and all(len(p) == 2 for p in pulled)
