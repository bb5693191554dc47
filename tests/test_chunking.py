import random

import pytest

from lamella.operators import chunking
from lamella.operators.chunking import FORMAT_1, SMALL, cuts

M = (1 << 64) - 1


def scalar(data, fmt):
    """The definition, byte by byte."""
    out, at = [], 0
    while at < len(data):
        n = min(len(data) - at, fmt.largest)
        cut = n
        if n > fmt.smallest:
            h = 0
            for i in range(fmt.smallest, n):
                h = ((h << 1) + int(chunking.GEAR[data[at + i]])) & M
                if not h & (fmt.strict if i < fmt.average else fmt.loose):
                    cut = i + 1
                    break
        at += cut
        out.append(at)
    return out


def test_vectors_equal_the_definition():
    rng = random.Random(1)
    for n in [0, 1, 63, 64, 65, 66, 128, 255, 256, 257, 1024, 1025, 5000, 60_000]:
        for data in (rng.randbytes(n), bytes(n), b"ab" * (n // 2)):
            assert cuts(data, SMALL) == scalar(data, SMALL)


def test_gear_and_masks():
    assert bin(FORMAT_1.strict).count("1") == 22 and bin(FORMAT_1.loose).count("1") == 20
    assert len(set(chunking.GEAR.tolist())) == 256


def test_bounds_reassembly_and_determinism():
    data = random.Random(2).randbytes(40 << 20)
    ends = cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and cuts(data) == ends
    assert all(FORMAT_1.smallest <= s <= FORMAT_1.largest for s in sizes[:-1])
    assert (2 << 20) <= len(data) / len(sizes) <= (8 << 20)


def test_few_chunks_change_after_an_insert():
    rng = random.Random(3)
    data = rng.randbytes(400_000)
    at = 100_003
    edited = data[:at] + b"inserted" + data[at:]

    def pieces(d):
        ends = cuts(d, SMALL)
        return {d[a:b] for a, b in zip([0, *ends], ends)}

    assert len(pieces(data) - pieces(edited)) <= 3


def test_stream_equals_whole():
    import io

    data = random.Random(4).randbytes(50_000)
    for step in (1, 100, 7000):
        stream = io.BytesIO(data)
        chunks = list(chunking.cuts_of_stream(lambda n, s=stream, k=step: s.read(min(n, k)), SMALL))
        assert b"".join(chunks) == data and len(chunks) == len(cuts(data, SMALL))
    assert list(chunking.cuts_of_stream(io.BytesIO(b"").read, SMALL)) == []


def test_split_and_new_chunks(spark):
    rng = random.Random(5)
    blob = rng.randbytes(5000)
    df = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(blob + b"tail")), (3, bytearray(b"")), (4, None)], "id bigint, content binary")
    chunks = chunking.split(df, "id", "content", SMALL).cache()
    whole = {r["id"]: (r["bytes"], r["gapless"]) for r in chunking.reassembled(chunks).collect()}
    assert whole == {1: (5000, True), 2: (5004, True)}
    fresh = chunking.new_chunks(chunks.where("id = 2"), chunks.where("id = 1"))
    assert 1 <= fresh.count() <= 2
    assert chunking.split(df.limit(0), "id", "content", SMALL).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1 << 10])
def test_small_inputs(n):
    assert cuts(bytes(n)) == ([n] if n else [])
