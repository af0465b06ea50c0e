from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weft.llm import packing, tokenizer

pytestmark = pytest.mark.skipif(not Path(tokenizer.TOKENIZER_DIR, tokenizer.RANKS_FILE).exists(), reason="no public tokenizer files here")

TEXTS = [
    None, "", " ", "\n\n  a", "It's we'll 'S don’t", "<|endoftext|> x", "tab\tnbsp thin x 　y z\x85w", "naïve déjà 数据 数据 👩‍🔬 🙂", "١٢٣ ²₂ № a1b2", "﻿​­",
    "é ͸ \U0001fae9 new", "a" * 5000, "word " * 20000, "   lead and trail   ", "\r\n\r\nx\r", "''''s 't", "x\x1cy\x00z",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("word", F.lit("y")).withColumn("ids", F.lit(1)).withColumn("pos", F.lit(1))


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


@pytest.mark.parametrize("limit", [0, 3, tokenizer.FREQUENT_WORDS], ids=["all rare", "some rare", "all frequent"])
def test_encode_and_decode(spark, docs, limit):
    encoded = tokenizer.encode(docs, "doc_id", "text", frequent_words=limit).cache()
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == reference()
    assert {r.doc_id: r.n_tokens for r in tokenizer.sizes(docs, "doc_id", "text", frequent_words=limit).collect()} == {k: len(v) for k, v in reference().items()}
    assert {r.doc_id: r.text for r in tokenizer.decode(encoded, "doc_id", "ids").collect()} == {i: x or "" for i, x in enumerate(TEXTS)}


def test_empty(spark, docs):
    assert tokenizer.encode(docs.limit(0), "doc_id", "text").count() == 0


def test_unknown_id(spark):
    bad = spark.createDataFrame([(1, [99999999])], "d long, ids array<int>")
    with pytest.raises(Exception, match="no such id"):
        tokenizer.decode(bad, "d", "ids").collect()


def sized(spark, sizes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, n long").withColumn("key", F.lit(0)).withColumn("part", F.lit("x"))


@pytest.mark.parametrize("lane_tokens", [packing.LANE_TOKENS, 2000])
def test_pack(spark, lane_tokens):
    sizes = [0, None, 1, 100, 101, 250, 99] + [(i * 37) % 90 + 1 for i in range(500)]
    rows = packing.pack(sized(spark, sizes), "k", "n", 100, lane_tokens).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.k, []).append((r.part, r.start, r.length))
    for k, size in enumerate(sizes):
        got = sorted(parts[k])
        assert sum(p[2] for p in got) == (size or 0)
        assert [p[1] for p in got] == [sum(q[2] for q in got[:i]) for i in range(len(got))]
        assert len(got) == max(1, -(-(size or 0) // 100))  # split only where larger than the capacity
    spans = {}
    for r in rows:
        if r.container is None:
            assert r.length == 0
        else:
            spans.setdefault(r.container, []).append((r.offset, r.offset + r.length))
    for s in spans.values():
        s.sort()
        assert s[-1][1] <= 100 and s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    if lane_tokens == packing.LANE_TOKENS:
        total = sum(x or 0 for x in sizes)
        assert 1 - total / (100 * len(spans)) < 0.08  # sizes of one to ninety in containers of a hundred


def test_pack_edges(spark):
    assert packing.pack(sized(spark, []), "k", "n", 10).count() == 0
    assert [r.length for r in packing.pack(sized(spark, [1, 1, 1]), "k", "n", 1).collect()] == [1, 1, 1]
    with pytest.raises(ValueError):
        packing.pack(sized(spark, [1]), "k", "n", 0)


def squares(count):
    return sum(c * c for c in count[1:-1])


def test_placement_minimises_squares():
    p = packing.Packer(7)
    for size in [3, 2, 5, 1, 4, 6, 2, 2, 3, 7, 1, 5, 4] * 3:
        before = p.count.copy()
        options = []
        for h in [0, *range(1, 7)]:
            if h + size <= 7 and (h == 0 or before[h]):
                after = before.copy()
                if h:
                    after[h] -= 1
                if h + size < 7:
                    after[h + size] += 1
                options.append(squares(after))
        p.place(size)
        assert squares(p.count) == min(options)
