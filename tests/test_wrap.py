"""Wrapping of cues against a plain version."""

import random

from reelspark.operators import subtitles


def plain(text, width, most):
    words = text.split()
    flat = " ".join(words)
    if len(flat) <= width:
        return flat
    count = max(-(-len(flat) // width), 1)
    target, lines, line = -(-len(flat) // count), [], ""
    for w in words:
        if line and (len(line) + 1 + len(w) > width or len(line) >= target and line[-1] in ",.!?;:—"):
            lines.append(line)
            line = ""
        line = f"{line} {w}" if line else w
    return "\n".join([*lines, line][:most])


def test_wrapped(spark):
    r = random.Random(6)
    texts = [None, "", "  ", "short one", "x" * 90, "y" * 42, "z" * 43 + " a", "one—two three four five\n six,  seven"]
    texts += [" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", ",", ".", "—"]) for _ in range(r.randint(1, 60))) for _ in range(80)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for width, most in ((42, 2), (10, 3), (20, 1)):
        got = {x["i"]: x["w"] for x in frame.select("i", subtitles.wrapped(frame["t"], width, most).alias("w")).collect()}
        assert got == {i: None if t is None else plain(t, width, most) for i, t in enumerate(texts)}
