"""Small tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, node string"


def documents(spark, rows):
    """rows of (doc_id, text); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, 7, "x") for i, t in rows], SCHEMA)


def texts(n=60, seed=5):
    """Prose with copies, near copies, shared passages, junk, nulls and empty texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(300)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, base = prose(60), prose(150)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "a " * 400), (6, "a b " * 200), (None, "Null id here " * 20), (None, None)]
    for i in range(10, 10 + n):
        kind = i % 6
        words = prose(r.randint(1, 120))
        if kind == 0:
            words = words[:50] + passage + words[50:]
        elif kind == 1:
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif kind == 2:
            words = base[20:100] + words
        elif kind == 3:
            words = prose(5) * r.randint(1, 30)
        text = "".join(w + r.choice([" ", " ", "\n", "  ", "\t"]) for w in words)
        out.append((i, text.upper() if i % 11 == 0 else text))
    out += [(200, " ".join(base)), (201, " ".join(base)), (201, " ".join(base)), (202, " ".join(prose(30000)))]
    return out
