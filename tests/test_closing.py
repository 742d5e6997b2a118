"""Postings that a stream closes: against spans that Python builds."""

from datetime import datetime, timedelta

from test_pipeline import raw

from postlake.session import scratch_path
from postlake.streaming import ingest as stream

START = datetime(2026, 8, 1)


def stamp(hours: float) -> str:
    return (START + timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_postings_close_once_they_are_not_seen(spark):
    """Hours of the sightings of each wave, out of order. The third wave meets a watermark
    of hour 12: the second sighting of `late` would have closed at 11.5 and is dropped,
    that of `tardy` at 12.5 and opens it anew. A row without a title is never opened."""
    waves = [
        {"a": [0, 3], "b": [1], "late": [0], "tardy": [0], "": [2]},
        {"a": [12, 7], "c": [11], "ticker": [14]},
        {"b": [30], "late": [1.5], "tardy": [2.5], "ticker": [32]},
        {"c": [52], "ticker": [60]},
    ]
    landing, checkpoint, out = (scratch_path(spark, n) for n in ("landing", "ck", "closed"))
    for wave in waves:
        rows = [{"external_id": k, "title": k, "scraped_at": stamp(h)} for k, hours in wave.items() for h in hours]
        raw(spark, *rows).coalesce(1).write.mode("append").json(landing)
        query = stream.closed(stream.read_landing(spark, landing), "10 hours", "2 hours").writeStream.option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet")
        query.awaitTermination()
        assert query.exception() is None
    found = sorted((r.first_seen_at, r.last_seen_at, r.sightings) for r in spark.read.parquet(out).collect())
    # Open at the end, at hour 58: only what was seen after hour 48.
    assert found == sorted([
        (stamp(0), stamp(12), 4), (stamp(1), stamp(1), 1), (stamp(30), stamp(30), 1), (stamp(0), stamp(0), 1),
        (stamp(0), stamp(0), 1), (stamp(2.5), stamp(2.5), 1), (stamp(11), stamp(11), 1), (stamp(14), stamp(14), 1), (stamp(32), stamp(32), 1)])
