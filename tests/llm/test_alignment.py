"""Alignment of tokenizers against the libraries and a plain version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspark.llm import alignment
from tests.llm.data import documents, texts
from tests.llm.test_texts import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [(910, "a▁b c"), (911, "▁ x"), (912, "x ▁ y"), (913, " lead and  double \n lines\r\n"), (914, "<s>hi</s> <unk> <0x41>"), (915, "nbsp here\u0085and there \x1c z"), (916, " "), (917, "日本 語 の テキスト。" * 30), (918, "the cat the cat the dog")]


def plain(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    docs, counts = [], Counter()
    for i, t in rows:
        a = b = []
        if t:
            whole = b" " + t.encode()
            a = [(x, bytes(alphabet[c] for c in a_lib.id_to_token(x))) for x in a_lib.encode(" " + t, add_special_tokens=False).ids]
            pieces = [(x, b_lib.id_to_piece(x)) for x in b_lib.encode(t)]
            b = [(x, bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode()) for x, p in pieces]
            if not b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for x, y in side:
                out.append((x, at, at + len(y)))
                at += len(y)
            spans.append(out)
        linked, k = [], 0
        for x, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < e:
                linked.append((x, spans[1][j][0]))
                j += 1
        common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for c in common:
            groups.append("|".join(",".join(str(x) for x, s, e in side if s >= low and e <= c) for side in spans))
            low = c
        counts.update(linked)
        docs.append((i, len(a), len(b), groups, linked))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter(
        (i, n_a, n_b, len(g), len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, p in docs
    )


@pytest.mark.parametrize("block,most_pairs", [(4_000_000, 2_000_000), (500, 0)])
def test_alignment(spark, block, most_pairs):
    rows = texts(40)[:-1] + ODD + MORE
    frame = alignment.align(documents(spark, rows).repartition(3), A, B, public_tokenizers.PATTERN, block, most_pairs)
    assert Counter(tuple(x) for x in frame.collect()) == plain(rows)


def test_groups_and_links_of_odd_ends(spark):
    cases = [([1, 2, 3], [2, 5, 9], [7, 8, 9, 7], [3, 4, 5, 9]), ([], [], [], []), ([4], [6], [5, 6], [1, 6])]
    by_byte = lambda ends: [k for k, (s, e) in enumerate(zip([0, *ends], ends, strict=False)) for _ in range(s, e)]
    rows = [(i, a, e, by_byte(e), b, f, by_byte(f)) for i, (a, e, b, f) in enumerate(cases)]
    row = spark.createDataFrame(rows, "i int, a array<int>, a_end array<int>, a_at array<int>, b array<int>, b_end array<int>, b_at array<int>")
    side = {c: F.col(c) for c in row.columns[1:]}
    got = row.orderBy("i").select(alignment.groups(side, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("g"), alignment.links(side).alias("l")).collect()
    assert [[(x["a"], x["b"]) for x in r["g"]] for r in got] == [[([1, 2], [7, 8, 9]), ([3], [7])], [], [([4], [5, 6])]]
    assert [sorted(divmod(x, 1 << 32) for x in r["l"]) for r in got] == [[(1, 7), (2, 7), (2, 8), (2, 9), (3, 7)], [], [(4, 5), (4, 6)]]


def test_no_documents(spark):
    assert alignment.align(documents(spark, []), A, B, public_tokenizers.PATTERN).collect() == []


def test_no_function_of_the_engine_goes_over_tokens(spark):
    frame = alignment.align(documents(spark, texts(40)), A, B, public_tokenizers.PATTERN)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "collect_list" not in plan


def test_pieces_like_columns(spark):
    pair = alignment.Pair.of(A, B, public_tokenizers.PATTERN)
    words = ["the", "cat's", "naïveté", "日本語", "x-ray,", "", "12345.67"]
    size, a, b, _ = pair.tokens(words)
    at = [(len(pair.a.encode_ordinary(" " + w)), len(pair.b.encode(w))) for w in words]
    n_a, n_b = (np.array([x[k] for x in at]) for k in (0, 1))
    keep = size > 0
    pairs, n_links, n_groups, written = alignment.align_pieces(pair, a, n_a[keep], b, n_b[keep], size[keep])
    assert n_links.sum() == len(pairs) and (n_links == n_a[keep] + n_b[keep] - n_groups).all()
    for text, k, x, y in zip(written.to_pylist(), n_groups, n_a[keep], n_b[keep], strict=True):
        sides = [g.split("|") for g in text[:-1].split(";")]
        assert text[-1] == ";" and len(sides) == k and sum(len(s.split(",")) for s, _ in sides) == x and sum(len(s.split(",")) for _, s in sides) == y
