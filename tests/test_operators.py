"""Literal cases, brute force and invariants on small fixtures."""

import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from rostrum.operators import chunks as ch
from rostrum.operators import metrics as mt
from rostrum.operators import quality as qa
from rostrum.operators import slides as sl
from rostrum.operators import tree as tr
from rostrum.plans import ordered
from rostrum.streaming import incremental as inc

UNITS = [("a", i, t, float(i), i + 1.0, None) for i, t in enumerate(["a b", "c d", "e f"])]
UNIT_SCHEMA = "lecture_key string, idx long, text string, start double, end double, slide_index long"


def test_packing_literals(spark):
    units = spark.createDataFrame(UNITS, UNIT_SCHEMA)
    spans = lambda d: [(r.source_item_start, r.source_item_end) for r in d.orderBy("chunk_id").collect()]
    assert spans(ch.pack_units(units, size=4)) == [(0, 1), (2, 2)]
    assert spans(ch.pack_units(units, size=4, overlap=2)) == [(0, 1), (1, 2)]


def test_packing_is_greedy_in_any_block_size(spark):
    rnd = random.Random(7)
    counts = {str(k): [rnd.randint(1, 9) for _ in range(rnd.randint(1, 60))] for k in range(4)}
    rows = [(k, i, " ".join("w" * c), float(i), i + 1.0, None) for k, v in counts.items() for i, c in enumerate(v)]
    units = spark.createDataFrame(rows, UNIT_SCHEMA)
    for overlap, block in ((0, None), (5, None), (5, 7), (9, 4)):
        got = ch.pack_units(units, size=9, overlap=overlap, block_rows=block).orderBy("chunk_id").collect()
        for k, c in counts.items():
            spans = [(r.source_item_start, r.source_item_end) for r in got if r.lecture_key == k]
            assert spans[0][0] == 0 and spans[-1][1] == len(c) - 1
            assert all(sum(c[a:b + 1]) <= 9 for a, b in spans)
            for (a, b), (a2, b2) in zip(spans, spans[1:]):
                assert a < a2 <= b + 1 and b <= b2  # progress, no gap
                assert sum(c[a2:b2 + 1]) <= 9 < sum(c[a:b + 2])  # no unit more would have fitted
                shared = sum(c[a2:b + 1])
                assert shared >= overlap or a2 == a + 1
                assert shared - c[a2] < overlap if shared else True  # not a unit more than needed


def test_token_windows_with_slides(spark):
    words = spark.createDataFrame([("l", i, w, float(i), i + 0.9) for i, w in enumerate("abcdef")],
                                  "lecture_key string, ord long, word string, start double, end double")
    slides = spark.createDataFrame([("l", 0, 0.0, 2.5, "intro slide"), ("l", 1, 2.5, 5.5, "second slide")],
                                   "lecture_key string, slide_index long, start double, end double, text string")
    got = ch.token_windows(words, size=4, overlap=2, slides=slides).orderBy("chunk_id").collect()
    assert [(r.source_item_start, r.source_item_end) for r in got] == [(0, 3), (2, 5)]
    assert "[SLIDE] intro slide" in got[0].text and "[SLIDE] second slide" in got[1].text


def test_timestamp_literals(spark):
    q = spark.createDataFrame([(1, 10), (2, 10)], "example_id long, timestamp_seconds long")
    hits = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 9.0, 12.0), (2, 1, 0.0, 8.0), (2, 2, 20.0, 30.0)],
                                 "example_id long, rank int, start double, end double")
    got = {r.example_id: (r[1:]) for r in mt.timestamp_metrics(hits, q, tolerance=2).collect()}
    assert tuple(got[1]) == (1.0, 0.5, 1.0, 0.5)
    assert tuple(got[2]) == (0.0, 0.0, 1.0, 1.0)


def brute_tree(x, min_size, k=float("inf")):
    def split(lo, hi):
        best = None
        sse = lambda v: ((v - v.mean(0)) ** 2).sum()
        for n in range(lo + min_size - 1, hi - min_size + 1):
            loss = sse(x[lo:n + 1]) + sse(x[n + 1:hi + 1])
            if best is None or loss < best[0]:
                best = (loss, n)
        return best[0] - sse(x[lo:hi + 1]), best[1]

    big = lambda lo, hi: hi - lo + 1 >= 2 * min_size
    if not big(0, len(x) - 1):
        return [(0, len(x) - 1)]
    heap, leaves = [(split(0, len(x) - 1)[0], 0, len(x) - 1)], []
    while heap and len(heap) + len(leaves) != k:
        _, lo, hi = heapq.heappop(heap)
        cut = split(lo, hi)[1]
        for a, b in ((lo, cut), (cut + 1, hi)):
            if big(a, b):
                heapq.heappush(heap, (split(a, b)[0], a, b))
            else:
                leaves.append((a, b))
    return sorted(leaves + [(a, b) for _, a, b in heap])


def test_trees_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = {str(k): rng.normal(size=(n, 3)) for k, n in enumerate((4, 10, 61))}
    rows = [(k, i, [float(v) for v in x[i]]) for k, x in sets.items() for i in range(len(x))]
    blocks = spark.createDataFrame(rows, "lecture_key string, i long, embedding array<double>")
    for local in (None, 15):
        nodes = tr.segment_tree(blocks, min_size=4, local_rows=local).cache()
        leaves = nodes.where("is_leaf").collect()
        for k, x in sets.items():
            assert sorted((r.lo, r.hi) for r in leaves if r.lecture_key == k) == brute_tree(x, 4)
        for limit in (1, 2, 5, 8):
            some = tr.limit_segments(nodes, limit).where("is_leaf").collect()
            for k, x in sets.items():
                assert sorted((r.lo, r.hi) for r in some if r.lecture_key == k) == brute_tree(x, 4, limit)


def test_roll_up_has_one_summary_per_inner_node(spark):
    rng = np.random.default_rng(5)
    blocks = spark.createDataFrame([("l", i, [float(v) for v in rng.normal(size=3)]) for i in range(40)],
                                   "lecture_key string, i long, embedding array<double>")
    entries = blocks.select("lecture_key", F.col("i").alias("idx"), F.col("i").cast("double").alias("start"),
                            (F.col("i") + 1.0).alias("end"), F.concat(F.lit("text "), "i").alias("composite"))
    rec = tr.tree_records(tr.tree_rollup(tr.segment_tree(blocks), entries)).collect()
    assert all((r.summary_text is None) == r.is_leaf for r in rec)
    assert sum(r.is_leaf for r in rec) == sum(not r.is_leaf for r in rec) + 1
    root = next(r for r in rec if r.tree_path == "*")
    assert root.summary_text == "text"  # numbers under three digits are no terms
    assert root.descendant_leaf_tree_paths == sorted(r.tree_path for r in rec if r.is_leaf)


def test_context_blocks_across_blocks(spark, tiny_blocks):
    rows = spark.createDataFrame([("l", i, f"t{i}") for i in range(50)], "lecture_key string, idx long, composite string")
    got = {r.idx: r.convo for r in tr.context_blocks(rows, width=4).collect()}
    assert len(got) == 50 and got[0] == "t0" and got[9] == "t5\nt6\nt7\nt8\nt9"


def test_percentile_plans_agree_to_the_bit(spark):
    rnd = random.Random(3)
    rows = [("tied", 1.933)] * 1307 + [("mixed", rnd.expovariate(1)) for _ in range(999)] + [("few", 0.1), ("few", 0.7)]
    df = spark.createDataFrame(rows, "k string, v double")
    for pct in (0.975, 0.5, 0.1, 1.0):
        plans = [dict(ordered.exact_percentile(df, ["k"], "v", pct, "p", long=long).collect()) for long in (False, True)]
        assert plans[0] == plans[1] and plans[0]["tied"] == 1.933


def test_examples_without_hits_stay(spark):
    hits = spark.createDataFrame([(1, 1, 0.0, 4.0)], "example_id long, rank int, start double, end double")
    examples = spark.createDataFrame([(1, [(0.0, 4.0)]), (2, [(0.0, 1.0)])],
                                     "example_id long, answer_ranges array<struct<start:double,end:double>>")
    got = {r.example_id: r["recall@1"] for r in mt.temporal_metrics(hits, examples, cuts=(1,)).collect()}
    assert got == {1: 1.0, 2: 0.0}
    two = hits.withColumn("system", F.lit("a")).unionByName(hits.withColumns({"system": F.lit("b"), "example_id": F.lit(2).cast("long")}))
    rows = mt.temporal_metrics(two, examples, by=["system"], cuts=(1,)).collect()
    assert {(r.system, r.example_id): r["recall@1"] for r in rows} == {("a", 1): 1.0, ("a", 2): 0.0, ("b", 1): 0.0, ("b", 2): 1.0}
    assert all((r["mean_temporal_distance@1"] != r["mean_temporal_distance@1"]) == ((r.system, r.example_id) in {("a", 2), ("b", 1)}) for r in rows)


def test_percentile_of_a_hot_key(spark, tiny_blocks):
    rnd = random.Random(1)
    values = [round(rnd.expovariate(1), 3) for _ in range(300)] + [0.0] * 200
    df = spark.createDataFrame([("h", v) for v in values], "k string, v double")
    got = ordered.exact_percentile(df, ["k"], "v", 0.975, "p").first().p
    assert abs(got - np.percentile(values, 97.5)) < 1e-12


def test_boundaries_are_perfect_against_themselves(spark):
    flags = spark.createDataFrame([("l", i, int(i % 7 == 6), int(i % 7 == 6)) for i in range(40)],
                                  "lecture_key string, i long, ref int, hyp int")
    e = mt.boundary_errors(flags).first()
    assert e.wd == 0.0 and e.pk == 0.0
    m = mt.tolerance_match(flags).first()
    assert (m.precision, m.recall, m.f1) == (1.0, 1.0, 1.0)


def test_tolerance_match_is_a_matching_near_the_largest(spark):
    rnd = random.Random(11)
    marks = {str(k): [[i for i in range(30) if rnd.random() < 0.3] for _ in range(2)] for k in range(12)}
    rows = [(k, i, int(i in ref), int(i in hyp)) for k, (ref, hyp) in marks.items() for i in range(30)]
    df = spark.createDataFrame(rows, "lecture_key string, i long, ref int, hyp int")
    for r in mt.tolerance_match(df).collect():
        ref, hyp = marks[r.lecture_key]
        queue, most = list(ref), 0
        for p in hyp:  # the earliest partner in reach gives a largest matching on a line
            queue = [q for q in queue if q >= p - 2]
            if queue and queue[0] <= p + 2:
                queue.pop(0)
                most += 1
        matched = r.precision * max(len(hyp), 1)
        assert abs(matched - round(matched)) < 1e-9 and most / 2 <= matched <= most


def test_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b, 1):
                row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
        assert mt.common_subsequence(a, b) == row[-1]


def test_random_boundaries_are_repeatable(spark):
    sizes = spark.createDataFrame([("l", 30, 5)], "lecture_key string, n long, n_boundaries long")
    a, b = (sorted(map(tuple, mt.random_boundaries(sizes, trials=3).collect())) for _ in range(2))
    assert a == b and len(a) == 15 and all(0 <= i < 29 for _, _, i in a)


def test_places_are_a_permutation():
    for size in (1, 2, 3, 4, 5, 16, 17, 100, 257):
        assert sorted(mt.permuted("42|l|1", size, i) for i in range(size)) == list(range(size))
    assert [mt.permuted("42|l|1", 100, i) for i in range(20)] != [mt.permuted("42|l|2", 100, i) for i in range(20)]
    assert 0 <= mt.permuted("k", 10**15, 10**14) < 10**15


def test_as_many_draws_as_there_are_positions(spark):
    sizes = spark.createDataFrame([("all", 6, 9), ("one", 2, 1), ("none", 9, 0), ("short", 1, 1)], "lecture_key string, n long, n_boundaries long")
    got = mt.random_boundaries(sizes, trials=2).collect()
    assert sorted((r.lecture_key, r.i) for r in got if r.trial == 1) == [*(("all", i) for i in range(5)), ("one", 0)]


def test_ends_are_cleaned_in_any_block_size(spark, tiny_blocks):
    rnd = random.Random(4)
    values = [rnd.uniform(-1, 50) for _ in range(60)]
    ends = spark.createDataFrame([("l", i, v) for i, v in enumerate(values)], "lecture_key string, slide_index long, end double")
    want, last = [], -1.0
    for v in values:
        if v > 0 and v > last + 1e-6:
            want.append(v)
            last = v
    assert [r.end for r in sl.normalize_ends(ends).orderBy("slide_index").collect()] == want


def test_choice_of_lecture(spark):
    cat = spark.createDataFrame([("a", "c", "01", "a/c/01"), ("b", "c", "01", "b/c/01"), ("b", "c", "02", "b/c/02")],
                                "speaker string, course_dir string, meeting_id string, lecture_key string")
    assert qa.resolve_choice(cat, "2") == "b/c/01" and qa.resolve_choice(cat, "b/c/02") == "b/c/02"
    assert qa.resolve_choice(cat, "all") is None
    for bad in ("9", "nope"):
        try:
            qa.resolve_choice(cat, bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_incremental_results(spark, tmp_path):
    schema = "lecture_key string, fingerprint string, segment_id int"
    rec = lambda v, keys: spark.createDataFrame([(k, v, i) for k in keys for i in range(3)], schema)
    path = str(tmp_path / "store")
    read = lambda: inc.read_results(spark, path, schema)
    assert read().count() == 0 and read().columns == ["lecture_key", "segment_id", "fingerprint"]
    inc.write_results(rec("v1", "abc"), path, build=1)
    inc.write_results(rec("v2", "b"), path, build=2)
    stored = read()
    assert sorted((r.lecture_key, r.fingerprint, r.segment_id) for r in stored.collect()) == [
        (k, v, i) for k, v in (("a", "v1"), ("b", "v2"), ("c", "v1")) for i in range(3)]
    want = rec("v1", "abcd").drop("segment_id").distinct()
    assert {r.lecture_key for r in inc.stale_lectures(want, stored).collect()} == {"b", "d"}
    assert inc.stale_lectures(want, stored, rebuild=True).count() == 4
    spark.createDataFrame([("c", "v1", 9, 1, 3)], "lecture_key string, fingerprint string, segment_id int, _build long, _rows long").withColumn(
        "_bucket", F.pmod(F.xxhash64("lecture_key"), F.lit(inc.BUCKETS)).cast("int")).write.mode("append").partitionBy("_bucket").parquet(path)
    assert {r.lecture_key for r in read().collect()} == {"a", "b"}  # a lecture with a row too many is not whole
    bad = next(p for p in (tmp_path / "store").rglob("*.parquet") if spark.read.parquet(str(p)).where("lecture_key = 'a'").count())
    bad.write_bytes(b"no parquet")
    spark.catalog.clearCache()
    assert {r.lecture_key for r in read().collect()} == {"b"}


def test_files_have_fingerprints(spark, tmp_path):
    import os

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_transcripts.csv").write_text("Word,Start,End")
        os.utime(tmp_path / name / f"{name}_transcripts.csv", (1000, 1000))
    (tmp_path / "a" / "other.txt").write_text("x")
    told = lambda **s: {r.path.rsplit("/", 1)[1]: r.fingerprint for r in inc.file_fingerprints(
        spark, str(tmp_path), "*_transcripts.csv", settings=s).collect()}
    first = told(gap=1, nested={"b": 1, "a": 2})
    assert len(set(first.values())) == 2 and first == told(nested={"a": 2, "b": 1}, gap=1)
    assert first != told(gap=2, nested={"a": 2, "b": 1})
    os.utime(tmp_path / "b" / "b_transcripts.csv", (1001, 1001))
    later = told(gap=1, nested={"b": 1, "a": 2})
    assert later["a_transcripts.csv"] == first["a_transcripts.csv"] and later["b_transcripts.csv"] != first["b_transcripts.csv"]


def test_plain_number_text(spark):
    from rostrum.functions.times import plain_number

    values = [0.0, 0.0005, 1.25, -2.5e-5, 9999999.0, 10000000.0, 12345678.9, 123456789012.5]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", plain_number("x").alias("s")).collect()
    told = {r.x: r.s for r in rows}
    assert told == {0.0: "0.0", 0.0005: "0.0005", 1.25: "1.25", -2.5e-5: "-0.000025", 9999999.0: "9999999.0",
                    10000000.0: "10000000.0", 12345678.9: "12345678.9", 123456789012.5: "123456789012.5"}
