"""Flows over several micro-batches."""

import random
from datetime import datetime, timedelta

from tidemark.streaming import flows


def test_quiet_over_batches(spark, tmp_path):
    """Rows of a hot, a rare and a null symbol, in two batches, against a loop; no task has all rows of a symbol."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "hot", "rare", None]), start + timedelta(minutes=rng.randrange(60 * 24 * 40)), k) for k in range(900)]
    rows += [("two", start, 9001), ("two", start, 9000), ("two", start + timedelta(hours=2), 9002), ("edge", start + timedelta(hours=10), 9003)]
    late = [("edge", start + timedelta(hours=9, minutes=50), 9004), ("edge", start + timedelta(hours=11, minutes=55), 9005)]
    more = late + [(s, t + timedelta(days=41), 10_000 + k) for s, t, k in rows[:900]]
    want, last = [], {}
    for batch in (rows, more):
        seen = dict(last)
        for s, t, k in sorted(batch, key=lambda r: r[1:]):
            if s not in seen or t - seen[s] >= timedelta(hours=2):
                want.append(k)
            seen[s] = max(t, seen.get(s, t))
        last = seen
    schema = "symbol string, ts timestamp, id long"
    for batch in (rows, more):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = flows.latest_quiet(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert 9005 not in want and 9002 in want and 9000 in want and 9001 not in want
