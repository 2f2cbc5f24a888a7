"""Registered queries of dealing with tracks, as tables; their SQL replays each life push by push."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import dealer
from .fixtures import Inputs
from .registry import query

_HOUR = 3600_000
#: A track lives while sightings are a day apart at most; pushes are six hours apart; three pushes a track.
_IDLE, _PUSH = 24 * _HOUR, {"interval_ms": 6 * _HOUR, "most": 3, "idle_ms": 24 * _HOUR}
_KEY = "stream_id, class, track_id, life"
_ON = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in _KEY.split(", "))

#: Sightings by life, with their place in it and the time of the one before.
_LIVES = f"""seen AS (SELECT stream_id, class, idx AS track_id, frame_id, ts, score, lag(ts) OVER w AS before FROM detection WINDOW w AS (PARTITION BY stream_id, class, idx ORDER BY ts, frame_id)),
numbered AS (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 24 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id, class, track_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS life FROM seen),
e AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY ts, frame_id) AS rn FROM numbered),
lives AS (SELECT {_KEY}, count(*) AS n, max(ts) + INTERVAL 24 HOUR + INTERVAL 1 MILLISECOND AS over FROM e GROUP BY ALL)"""


def _paced_sql(first: str) -> str:
    """Pushes in turn: the first positive score after the last push, or the interval's end if that is later; then the best by then."""
    return f"""WITH RECURSIVE {_LIVES},
p AS ({first}
 UNION ALL SELECT s.stream_id, s.class, s.track_id, s.life, k + 1, due, max(e.rn), arg_max(frame_id, row(score, -e.rn)), max(score)
 FROM (SELECT q.*, greatest(q.done + INTERVAL 6 HOUR, f_ts) AS due FROM
        (SELECT p.stream_id, p.class, p.track_id, p.life, p.k, p.done, p.r, arg_min(e.ts, e.rn) AS f_ts FROM p JOIN e ON {_ON.format("p", "e")} AND e.rn > p.r AND e.score > 0 WHERE p.k < 3 GROUP BY ALL) q) s
 JOIN lives ON {_ON.format("s", "lives")} AND s.due <= over
 JOIN e ON {_ON.format("s", "e")} AND e.rn > s.r AND (e.ts < due OR (e.ts = due AND (e.rn = 1 OR before < due)))
 GROUP BY s.stream_id, s.class, s.track_id, s.life, k, due),
gone AS (SELECT l.*, max(k) AS k, arg_max(r, k) AS r FROM lives l JOIN p USING ({_KEY}) GROUP BY ALL)
SELECT stream_id, class, track_id, 'SELECT' AS event, done AS "at", frame_id, score, k AS pushes FROM p WHERE k > 0
UNION ALL SELECT stream_id, class, track_id, 'DIE', over, NULL, NULL, k FROM gone WHERE k < 3 OR r >= n"""


def _dealt(i: Inputs, mode: str) -> DataFrame:
    items = dealer.as_items(i.detection().withColumnRenamed("idx", "track_id"), "24 hours")
    out = dealer.deal(items, dealer.PushSettings(mode=mode, **_PUSH))
    picked = lambda c: F.when(F.col("event") == "SELECT", F.col(c)).alias(c)
    return out.select("stream_id", "class", "track_id", "event", "at", picked("frame_id"), picked("score"), "pushes")


@query(_paced_sql("SELECT stream_id, class, track_id, life, CASE WHEN score > 0 THEN 1 ELSE 0 END AS k, ts AS done, rn AS r, frame_id, score FROM e WHERE rn = 1"), "detection")
def dealt_fast(i: Inputs) -> DataFrame:
    """Tracks pushed at once, then once an interval; and those that died."""
    return _dealt(i, "FAST")


@query(_paced_sql("SELECT stream_id, class, track_id, life, 0 AS k, ts AS done, CAST(0 AS BIGINT) AS r, frame_id, score FROM e WHERE rn = 1"), "detection")
def dealt_interval(i: Inputs) -> DataFrame:
    """Tracks pushed once an interval."""
    return _dealt(i, "INTERVAL")


@query(
    f"""WITH {_LIVES}, b AS (SELECT {_KEY}, arg_max(frame_id, row(score, -rn)) AS frame_id, max(score) AS score FROM e GROUP BY ALL)
SELECT stream_id, class, track_id, CASE WHEN good THEN 'SELECT' ELSE 'DIE' END AS event, over AS "at", CASE WHEN good THEN frame_id END AS frame_id, CASE WHEN good THEN score END AS score, CAST(good AS BIGINT) AS pushes
FROM (SELECT *, n >= 2 AND score > 0 AS good FROM lives JOIN b USING ({_KEY}))""",
    "detection",
)
def dealt_best(i: Inputs) -> DataFrame:
    """The best item of each track at its end."""
    return _dealt(i, "BEST")


@query(
    f"""WITH {_LIVES}, m AS (SELECT *, max(score) OVER (PARTITION BY {_KEY} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
h AS (SELECT stream_id, frame_id, ts AS since, coalesce(lead(ts) OVER (PARTITION BY {_KEY} ORDER BY rn), over) AS till FROM m JOIN lives USING ({_KEY}) WHERE rn = 1 OR score > top),
g AS (SELECT *, CASE WHEN since <= max(till) OVER (PARTITION BY stream_id, frame_id ORDER BY since, till ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h),
j AS (SELECT *, sum(new) OVER (PARTITION BY stream_id, frame_id ORDER BY since, till ROWS UNBOUNDED PRECEDING) AS stay FROM g)
SELECT stream_id, frame_id, max(till) AS "at", 'released' AS cause, count(*) AS uses FROM j GROUP BY stream_id, frame_id, stay""",
    "detection",
)
def frames_released(i: Inputs) -> DataFrame:
    """When each frame may go that was some track's best item: no track holds it then."""
    items = dealer.as_items(i.detection().withColumnRenamed("idx", "track_id"), "24 hours")
    dealt = dealer.deal(items, dealer.PushSettings(mode="BEST", **_PUSH), uses=True)
    return dealer.released_frames(dealt, patience_ms=1000 * 365 * _IDLE)
