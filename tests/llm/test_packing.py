import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lamella.llm import packing, tokens

SPECS = "pack_name string, capacity int"


def naive(capacity, sizes):
    """Best-fit decreasing, item by item."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return Counter(rooms)


def test_plan_equals_best_fit_item_by_item():
    rng = random.Random(5)
    for _ in range(400):
        capacity = rng.randrange(1, 60)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 80))]
        histogram = Counter(sizes)
        fill = defaultdict(int)
        seen = defaultdict(list)
        for length, first, last, container, per in packing.best_fit(capacity, histogram):
            for rank in range(first, last + 1):
                fill[container + (rank - first) // per] += length
                seen[length].append(rank)
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items()}
        assert Counter(capacity - f for f in fill.values()) == naive(capacity, sizes)
        assert sorted(fill) == list(range(len(fill)))


def packed(spark, sizes, specs):
    items = spark.createDataFrame([(k, n) for k, n in sizes], "item_id bigint, size bigint").withColumn("hashed", F.xxhash64("item_id", F.monotonically_increasing_id()))
    return packing.pack(items, spark.createDataFrame(specs, SPECS))


def test_every_item_whole_in_one_container(spark):
    rng = random.Random(2)
    sizes = [(k if k % 50 else None, 7 if rng.random() < 0.4 else rng.randrange(0, 40)) for k in range(700)]
    rows = packed(spark, sizes, [("s", 16), ("s", 16), ("l", 100), (None, 5), ("x", None), ("y", 0)]).collect()
    assert {r["pack_name"] for r in rows} == {"s", "l"}
    for name, capacity in (("s", 16), ("l", 100)):
        own = [r for r in rows if r["pack_name"] == name]
        fill = Counter()
        parts = defaultdict(list)
        for r in own:
            fill[r["container"]] += r["size"]
            parts[r["item_id"]].append((r["piece"], r["offset"], r["size"]))
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert sum(fill.values()) == sum(n for _, n in sizes)
        for item, n in sizes:
            if item is None:
                continue
            got = sorted(parts[item])
            assert [p for p, _, _ in got] == list(range(max(1, -(-n // capacity))))
            assert sum(s for _, _, s in got) == n and all(o == p * capacity for p, o, _ in got)
        assert len(own) == sum(max(1, -(-n // capacity)) for _, n in sizes)
    report = {r["pack_name"]: r for r in packing.fill_report(packed(spark, sizes, [("l", 100)])).collect()}
    assert report["l"]["containers"] <= 1.23 * report["l"]["least"] + 1


def test_capacities_planned_in_groups(spark):
    items = spark.createDataFrame([(k, 1 + k % 37) for k in range(300)], "item_id bigint, size bigint").withColumn("hashed", F.xxhash64("item_id"))
    specs = spark.createDataFrame([("a", 10), ("b", 40), ("c", 64), ("c", 16)], SPECS)
    one, many = (sorted(map(tuple, packing.pack(items, specs, together=n).collect())) for n in (500_000, 50))
    assert one == many and {r[:2] for r in one} == {("a", 10), ("b", 40), ("c", 64), ("c", 16)}


def test_nothing_to_pack(spark):
    assert packed(spark, [], [("s", 4)]).collect() == []
    assert packed(spark, [(1, 3)], []).collect() == []


def test_texts_of_every_kind(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, " "), (None, "x"), (5, "long " * 40_000), (5, "long " * 40_000)], "doc_id bigint, text string").withColumn("size", F.lit(0)).withColumn("tokens", F.lit(0))
    items = packing.document_items(docs.drop("tokens")).collect()
    assert sorted((r["item_id"] or 0, r["size"]) for r in items) == [(0, 1), (1, 3), (4, 1), (5, 40_001), (5, 40_001)]


def test_counts_do_not_depend_on_chunks(monkeypatch):
    with open(tokens.VOCABULARY, "rb") as f:
        enc = tokens.encoder(f.read())
    monkeypatch.setattr(tokens, "CHUNK", 16)
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("ab é'sなぜ1! .\n\t  xyz") for _ in range(rng.randrange(0, 200)))
        assert tokens.count(enc, text) == len(enc.encode_ordinary(text))
