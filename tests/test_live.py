"""Rules on streams against the same rules on tables."""

import random
from collections import Counter

import pytest

from reelspark.streaming import changes, live


def events(seed):
    r = random.Random(seed)
    rows = []
    for key in [0, 1, 2, 3, 4, 5, *range(100, 140), None]:
        at = 1000
        for _ in range(r.randint(1, 30)):
            at += r.choice([0, 1, 700, 1500, 1501, 2999, 3000, 3001, 9000])
            rows.append((key, at, len(rows)))
    return sorted(rows, key=lambda x: x[1] + r.randint(0, 4000))


SCHEMA = "key long, at_ms long, id long"
RULES = {
    "bursts": (lambda x: live.debounce_quiet(x, 1500, 1500, "5 seconds"), lambda x: changes.debounce_quiet(x, 1500, 1500)),
    "admitted": (lambda x: live.admitted(x, 2, 3000, "5 seconds"), lambda x: changes.admitted(x, 2, 3000)),
}


def run(spark, rule, folder, parts):
    """Each part is a file that comes after the stream has used up those before; every part is read by a stream started anew from the checkpoint."""
    own = live.with_state_store(spark)
    for k, part in enumerate(parts):
        own.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = own.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        found = rule(stream)
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return own.read.schema(found.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("name", sorted(RULES))
def test_stream_in_parts_and_restarted_equals_table(spark, tmp_path, name):
    rows = events(7)
    on_stream, on_table = RULES[name]
    marker = [(99, 10_000_000, 0)]
    parts = [rows[:140], rows[140:390], rows[390:], marker]
    got = Counter(tuple(x) for x in run(spark, on_stream, str(tmp_path), parts).collect())
    # the rule on tables takes keys that are not null
    some = [x for x in rows if x[0] is not None], [(-1, *x[1:]) for x in rows if x[0] is None]
    want = Counter(tuple(x) for x in on_table(spark.createDataFrame(some[0], SCHEMA)).collect())
    want += Counter((None, *x[1:]) for x in on_table(spark.createDataFrame(some[1], SCHEMA)).collect())
    assert got == want and len(want) > 5


def test_replay_of_a_table_without_keys_or_times(spark, tmp_path):
    rows = [x for x in events(3) if x[0] is not None] + [(1, None, 900), (2, None, 901)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/table")
    found = live.replay(lambda s: s.readStream.schema(SCHEMA).parquet(f"{tmp_path}/table"), RULES["bursts"][0], spark, f"{tmp_path}/work", 10_000_000)
    assert Counter(tuple(x) for x in found.collect()) == Counter(tuple(x) for x in RULES["bursts"][1](spark.createDataFrame(rows, SCHEMA)).collect())
