from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lamella.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("hashed", F.xxhash64("doc_id"))


def test_shares_caps_and_exact_blocks(spark):
    docs = [(k, "a", 10 + k % 90) for k in range(400)] + [(1000 + k, "b", 5 + k % 30) for k in range(30)] + [(2000 + k, "c", 700) for k in range(20)]
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.2, 3), ("C", 0.3, 2), ("gone", 0.1, 4), (None, 0.5, 1)], TARGETS)
    s = sizes(spark, docs)
    totals = mixing.source_totals(s, targets)
    rows = mixing.mix(s, totals, block=16).collect()
    length = {d: n for d, _, n in docs}
    slots, uses = Counter(), defaultdict(Counter)
    for r in rows:
        assert 0 <= r["token_from"] < r["token_to"] <= length[r["doc_id"]]
        slots[r["slot"]] += r["token_to"] - r["token_from"]
        for t in range(r["token_from"], r["token_to"]):
            uses[r["doc_id"]][t, r["repeat"]] += 1
    assert set(slots.values()) == {16} and sorted(slots) == list(range(len(slots)))
    cap = {"a": 1, "b": 3, "c": 2}
    source = {d: s for d, s, _ in docs}
    for d, c in uses.items():
        assert max(c.values()) == 1 and max(r for _, r in c) < cap[source[d]]
    report = {r["source"]: r for r in mixing.share_report(mixing.mix(s, totals, block=16), totals).collect()}
    for name, aim in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        assert abs(report[name]["share"] - aim) < 0.01 and abs(report[name]["aim"] - aim) < 1e-9
    assert report["gone"]["tokens"] == 0 and report["gone"]["share"] == 0
    # the scarcest source is used up, but for a block and the schedule's unevenness
    scarce = min(("a", "b", "c"), key=lambda n: sum(x for _, s, x in docs if s == n) * cap[n] / {"a": 0.5, "b": 0.2, "c": 0.3}[n])
    assert report[scarce]["tokens"] > 0.9 * cap[scarce] * report[scarce]["available"]


def test_schedule_is_even_at_every_length(spark):
    weights = [("a", 0.5, 10**9), ("b", 0.3, 10**9), ("c", 0.2, 10**9)]
    rows = sorted((r["slot"], r["source"], r["rank"]) for r in mixing.schedule(spark, weights, 3000).collect())
    count = Counter()
    for slot, source, rank in rows:
        assert rank == count[source]
        count[source] += 1
        assert all(abs(count[n] - w * (slot + 1)) < 8 for n, w, _ in weights)


def test_points_are_exact_at_any_place(spark):
    places = [0, 1, 2, 12345, 2**31 - 1, 2**31, 2**40 + 7, 2**61 + 12345, 2**62 - 1]
    got = spark.createDataFrame([(i,) for i in places], "i bigint").select(mixing.golden_point(F.col("i"))).collect()
    assert [r[0] for r in got] == [i * mixing.PHI % 2**mixing.BITS for i in places]
    assert abs(mixing.PHI / 2**mixing.BITS - 0.6180339887498949) < 1e-15


def test_cells_lead_to_the_part_a_point_lies_in(spark):
    weights = [("a", 1e-9), ("b", 0.25), ("c", 0.25), ("d", 1e-12), ("e", 0.4), *[(f"s{k}", 1e-6) for k in range(50)]]
    ends = mixing.borders([w for _, w in weights])
    assert ends[-1] == 2**mixing.BITS and ends == sorted(ends)
    shift, rows = mixing._cells([n for n, _ in weights], ends)
    assert [r[0] for r in rows] == list(range(len(rows))) and len(rows) << shift == 2**mixing.BITS
    for p in {x + d for e in ends for x in (e,) for d in (-1, 0, 1)} | {0, 2**61, 3 << 60}:
        if 0 <= p < 2**mixing.BITS:
            _, inner, names = rows[p >> shift]
            assert names[sum(e <= p for e in inner)] == weights[sum(e <= p for e in ends)][0]


def test_blocks_grow_with_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SLOTS", 50)
    s = sizes(spark, [(k, "a", 1000) for k in range(100)])
    totals = mixing.source_totals(s, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert mixing.mix(s, totals).agg(F.count_distinct("slot"), F.sum(F.col("token_to") - F.col("token_from"))).first()[:] == (50, 100_000)


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", None, None)], TARGETS)
    none = sizes(spark, [])
    totals = mixing.source_totals(none, targets)
    assert mixing.mix(none, totals).collect() == []
    assert {r["source"]: r["share"] for r in mixing.share_report(mixing.mix(none, totals), totals).collect()} == {"a": 0.0, "b": 0.0}


def test_documents_of_every_kind(spark):
    docs = spark.createDataFrame([(1, "A", "x y"), (1, "A", "x y"), (2, "a", ""), (3, "a", None), (4, None, "z"), (5, "other", "z"), (None, "a", "w")], "doc_id bigint, source string, text string").withColumn("hashed", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("A", 0.5, 2)], TARGETS)
    s = mixing.document_sizes(docs, targets)
    assert sorted((r["doc_id"] or 0, r["source"], r["tokens"]) for r in s.collect()) == [(0, "a", 1), (1, "a", 2), (1, "a", 2)]
    assert [tuple(r) for r in mixing.source_totals(s, targets).select("source", "target_share", "max_repeats", "available").collect()] == [("a", 1.0, 2, 5)]
    mixed = mixing.mix(s, mixing.source_totals(s, targets))
    assert mixed.agg(F.sum(F.col("token_to") - F.col("token_from"))).first()[0] == 10
    small = mixing.mix(s, mixing.source_totals(s, targets), total_tokens=4)
    assert small.agg(F.sum(F.col("token_to") - F.col("token_from"))).first()[0] == 4
