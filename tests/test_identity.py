"""Sketches and verified duplicates against hashlib."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from reelspark.operators import identity


def plain_sketch(b, chunk):
    n = len(b)
    body = b if n <= 3 * chunk else b[:chunk] + b[n // 2 - chunk // 2 : n // 2 - chunk // 2 + chunk] + b[n - chunk :]
    return hashlib.sha256(n.to_bytes(8, "little") + body).hexdigest()


def test_groups_are_split_by_content(spark):
    r, chunk = random.Random(2), 8
    base = [r.randbytes(n) for n in (0, 1, 23, 24, 25, 60, 61, 300)]
    rows = [(f"p{i}", b) for i, b in enumerate(base)] + [(f"copy{i}", b) for i, b in enumerate(base)] + [("again", base[-1]), ("null", None), ("null2", None)]
    hidden = bytearray(base[-1])
    hidden[chunk + 3] ^= 1  # where no sample is
    rows += [("near", bytes(hidden)), ("near", bytes(hidden)), ("alone", b"only here")]
    frame = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    got = {x["sketch"]: tuple(x)[1:] for x in identity.verified_duplicates(frame, chunk).collect()}
    groups = defaultdict(lambda: defaultdict(list))
    for p, b in rows:
        if b is not None:
            groups[plain_sketch(b, chunk)][b].append(p)
    want = {}
    for s, contents in groups.items():
        n = sum(map(len, contents.values()))
        if n > 1:
            first, same = min((min(p), b) for b, p in contents.items())
            want[s] = (n, first, len(contents), len(contents) == 1, len(contents[same]), sum((len(p) - 1) * len(b) for b, p in contents.items()))
    assert got == want and any(not x[3] for x in got.values())
    costs = spark.createDataFrame([(5,), (24,), (25,), (None,)], "size long").select(identity.read_cost(F.col("size"), chunk)).collect()
    assert [x[0] for x in costs] == [5, 24, 24, 24]
