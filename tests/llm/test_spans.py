import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import fmindex, spans

SCHEMA = "doc_id bigint, text string"


def brute(docs, length):
    owners = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            owners.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d in {d for d, _ in docs if d is not None}:
        marks = set()
        for e, t in docs:
            if e == d:
                for i in range(len(t or "") - length + 1):
                    if len(owners[t[i : i + length]] - {None}) > 1:
                        marks.update(range(i, i + length))
        run = sorted(marks)
        while run:
            k = 0
            while k + 1 < len(run) and run[k + 1] == run[k] + 1:
                k += 1
            out.add((d, run[0], run[k] + 1))
            run = run[k + 1 :]
    return out


def found(spark, docs, **kw):
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("rep", "last", "anchor", "region", "shard", "digest", "t1", "sha", "first", "n_chars"):
        df = df.withColumn(c, F.lit(0))
    rows = [tuple(r) for r in spans.shared_spans(df, **kw).select("doc_id", "span_start", "span_end").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(rng, n, alphabet, passages):
    docs = []
    for k in range(n):
        text = ""
        for _ in range(rng.randrange(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        docs.append((k, text))
    return docs


@pytest.mark.parametrize(("length", "grams", "shard"), [(12, None, 10**6), (12, (1, 4, 12), 50), (12, (12,), 40), (5, (2, 5), 30), (2, (1, 2), 20), (20, (7,), 10**6)])
def test_random_corpora_agree_with_brute_force(spark, length, grams, shard):
    rng = random.Random(length * 100 + (grams or [0])[0])
    passages = ["".join(rng.choice("abcdeé漢😀") for _ in range(rng.randrange(5, 45))) for _ in range(6)]
    docs = corpus(rng, 60, "abcé漢😀 ", passages) + [(100, passages[0] * 3), (101, passages[0] * 3), (102, "a" * 50), (103, "a" * 30), (104, None), (105, "")]
    assert found(spark, docs, length=length, grams=grams, shard=shard) == brute(docs, length)


def test_hot_passage_is_split_by_finer_anchors(spark, monkeypatch):
    rng = random.Random(8)
    hot = "".join(rng.choice("abcdefgh") for _ in range(30))
    docs = [(k, "".join(rng.choice("abcdefgh") for _ in range(20)) + hot + "".join(rng.choice("abcdefgh") for _ in range(20))) for k in range(80)]
    expected = brute(docs, 24)
    calls = []
    recut = spans._recut
    monkeypatch.setattr(spans, "_recut", lambda *a: calls.append(1) or recut(*a))
    assert found(spark, docs, length=24, shard=300) == expected and calls
    calls.clear()
    assert found(spark, docs, length=24) == expected and not calls


def test_only_whole_copies_come_without_the_index(spark, monkeypatch):
    rng = random.Random(4)
    passage, whole = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (40, 50))
    docs = [(k, f"{k:03d}" + passage + f"{k:03d}") for k in range(9)] + [(20, whole), (21, whole)]
    assert found(spark, docs, length=24) == brute(docs, 24)
    search = spans._search
    monkeypatch.setattr(spans, "_search", lambda rows, n: search(rows, n).where("false"))
    assert found(spark, docs, length=24) == {(20, 0, 50), (21, 0, 50)}


def test_texts_that_share_one_hash_are_told_apart(spark, monkeypatch):
    p = "abcdefghijklmnop"
    docs = [(1, p + "1"), (2, "2" + p), (3, "zzzzzzzzzzzz"), (4, p + "1")]
    monkeypatch.setattr(spans, "_text_keys", lambda texts: list(spans.TEXT))
    assert found(spark, docs, length=10) == brute(docs, 10)


def test_texts_of_one_id_are_told_apart(spark):
    p = "abcdefghijklmnop"
    docs = [(1, p), (2, p), (1, "x" + p), (1, "0123456789ABCDEF"), (3, "yy" + p[:12]), (3, "0123456789ABCDEF")]
    for shard in (10**6, 20):
        assert found(spark, docs[:3], length=10, shard=shard) == {(1, 0, 17), (2, 0, 16)}
        assert found(spark, docs, length=10, shard=shard) == {(1, 0, 17), (2, 0, 16), (3, 0, 16)}


def test_repeats_within_one_document_do_not_count(spark):
    p = "abcdefghijklmnop"
    assert found(spark, [(1, p + "1" + p), (2, "zz")], length=10) == set()
    assert found(spark, [(1, p), (1, p), (1, "x" + p)], length=10) == set()
    assert found(spark, [(1, p), (2, p), (2, p)], length=10) == {(1, 0, 16), (2, 0, 16)}


def test_touching_spans_are_one_and_empty_tables(spark):
    a, b = "abcdefghij", "klmnopqrst"
    assert found(spark, [(1, a + b), (2, a + "-"), (3, "-" + b)], length=10) == {(1, 0, 20), (2, 0, 10), (3, 1, 11)}
    assert found(spark, [], length=10) == set()
    assert found(spark, [(1, None), (2, ""), (None, a), (3, a)], length=10) == set()


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    monkeypatch.setattr(spans, "PIECE", 64)
    which, start, windows, anchors = [], [], [], []
    for ids, offsets, parts in spans._pieces([7], [long], 12):
        w, s, n, a = spans.anchor_runs(parts, 12, 6)
        start += (np.array(offsets)[w] + s).tolist()
        windows += n.tolist()
        anchors += a.tolist()
        assert set(np.array(ids)[w].tolist()) == {7}
    assert sum(windows) == len(long) - 11 and sorted(start)[0] == 0
    whole = spans.anchor_runs([long], 12, 6)
    expected = {s + k: a for s, n, a in zip(whole[1].tolist(), whole[2].tolist(), whole[3].tolist(), strict=True) for k in range(n)}
    assert {s + k: a for s, n, a in zip(start, windows, anchors, strict=True) for k in range(n)} == expected


def test_matching_statistics_agree_with_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        letters = [chr(rng.choice([0, 97, 0x3042, 0x1F600]) + k) for k in range(rng.choice([1, 2, 5, 40]))]
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 12))]
        texts += [texts[0] * 3, texts[0] + texts[-1]]
        owners = np.array([rng.randrange(4) for _ in texts])
        for k, lengths in enumerate(fmindex.matching_statistics(texts, owners, np.arange(len(texts)))):
            others = [t for t, o in zip(texts, owners, strict=True) if o != owners[k]]
            for i, got in enumerate(lengths.tolist()):
                assert got == max((n for n in range(len(texts[k]) - i + 1) if any(texts[k][i : i + n] in t for t in others)), default=0)


def test_intervals_of_statistics():
    assert fmindex.intervals(np.array([0, 5, 4, 3, 9, 0, 4]), 4) == [(1, 2, 5), (4, 4, 9), (6, 6, 4)]
    assert fmindex.intervals(np.array([], np.int32), 4) == []


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 11, 500)
    m = fmindex.WaveletMatrix(seq, 4)
    for c in range(11):
        base = m.descend(np.zeros(1, np.int64), np.array([c]))[0]
        at = np.arange(501)
        got = m.descend(at.copy(), np.full(501, c)) - base
        assert got.tolist() == [int((seq[:i] == c).sum()) for i in at]


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghij--"), (3, ""), (4, None)], SCHEMA)
    rows = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.coverage(docs, spans.shared_spans(docs, length=10)).collect()}
    assert rows == {1: (10, 10), 2: (12, 10), 3: (0, 0)}
