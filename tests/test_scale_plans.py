"""Plans for much data against brute force: folds as composed functions, blocked nearest neighbours, roll-ups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import knn
from rostrum.operators import meetings as me
from rostrum.operators import metrics as mt
from rostrum.operators import search as se
from rostrum.operators import slides as sl
from rostrum.operators import tree as tr
from rostrum.plans import ordered


@pytest.fixture
def calls(monkeypatch):
    """Grouped maps that an ordered fold builds."""
    made = []
    plain = ordered.map_sorted_groups
    monkeypatch.setattr(ordered, "map_sorted_groups", lambda *a, **b: made.append(a[4]) or plain(*a, **b))
    return made


def quotes_of(classes):
    depth, out = 0, []
    for c in classes:
        shut = c == "RQUOTE" or (c == "QUOTE" and depth > 0)
        out.append(shut)
        depth = max(depth - 1, 0) if shut else depth + 1
    return out, depth


def test_quote_steps_equal_a_walk():
    rnd = random.Random(1)
    for kinds in (["QUOTE"], ["LQUOTE", "RQUOTE"], ["LQUOTE", "QUOTE", "RQUOTE"], ["LQUOTE"], ["RQUOTE"]):
        for _ in range(40):
            classes = [rnd.choice(kinds) for _ in range(rnd.randint(1, 25))]
            step = me.quote_step({"cls": np.array(classes, dtype=object)})
            for d in range(30):
                assert me.after_quotes(step, str(d)) == str(quotes_of(["LQUOTE"] * d + classes)[1])
            assert me.after_quotes(step, None) == me.after_quotes(step, "0")


def test_unbalanced_quotes_over_a_thousand_blocks(spark, monkeypatch, calls):
    monkeypatch.setattr(ordered, "LONG_KEY_ROWS", 10)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 4)
    rnd = random.Random(2)
    classes = [rnd.choice(["QUOTE", "QUOTE", "LQUOTE", "RQUOTE"]) for _ in range(4000)]
    classes[0] = "LQUOTE"  # never closed by its own kind
    words = spark.createDataFrame([("m", "s", i, c, '"') for i, c in enumerate(classes)],
                                  "meeting string, speaker string, pos long, cls string, text string")
    got = me.classify_words(words).orderBy("pos").collect()
    assert [not r.lspace for r in got] == quotes_of(classes)[0]
    assert len(calls) == 3  # functions, their composition, one pass over the rows


def test_gaps_and_ends_over_many_blocks(spark, monkeypatch, calls):
    monkeypatch.setattr(ordered, "LONG_KEY_ROWS", 10)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 6)
    rnd = random.Random(3)
    at = sorted(rnd.sample(range(1500), 600))
    flags = spark.createDataFrame([("l", i) for i in at], "lecture_key string, i long")
    want, last = [], -5
    for i in at:
        if i < 4 or i - last >= 5:
            want.append(i)
            last = i
    assert [r.i for r in mt.min_gap_boundaries(flags).orderBy("i").collect()] == want
    assert len(calls) == 3
    for values in ([rnd.uniform(-1, 50) for _ in range(400)], [i + rnd.uniform(-3, 3) for i in range(400)],
                   [1.0 + i * 7e-7 for i in range(200)], [5.0] * 50 + [-1.0] * 50):
        del calls[:]
        ends = spark.createDataFrame([("l", i, v) for i, v in enumerate(values)], "lecture_key string, slide_index long, end double")
        kept, last = [], -1.0
        for v in values:
            if v > 0 and v > last + 1e-6:
                kept.append(v)
                last = v
        assert [r.end for r in sl.normalize_ends(ends).orderBy("slide_index").collect()] == kept
        assert len(calls) == 3


def neighbours(queries, records, k, scoped, normalized):
    out = set()
    for q, lecture, v in queries:
        found = []
        for rec_lecture, r, w in records:
            if v is None or w is None or None in w or len(v) != len(w) or (scoped and (lecture is None or lecture != rec_lecture)):
                continue
            v_, w_ = np.array(v), np.array(w)
            s = float(v_ @ w_) if normalized else -float(((v_ - w_) ** 2).sum())
            found.append((-(round(s, 9) + 0.0), r, rec_lecture))
        out |= {(q, x[2], x[1], -x[0], i) for i, x in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)}
    return out


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("scope,normalized", [("lecture", True), ("global", True), ("lecture", False), ("global", False)])
def test_nearest_equal_brute_force(spark, monkeypatch, grid, scope, normalized):
    if grid:
        monkeypatch.setattr(knn, "MEMORY_QUERIES", 0)
        monkeypatch.setattr(knn, "QUERY_ROWS", 5)
        monkeypatch.setattr(knn, "RECORD_ROWS", 30)
    monkeypatch.setattr(knn, "PRODUCT_ROWS", 7)
    rng, rnd = np.random.default_rng(4), random.Random(4)
    grain = lambda v: [float(x) for x in np.round(v * 4) / 4]  # noqa: E731, exact in binary, many ties
    records = [(rnd.choice("aaaab"), f"r{i:03d}", grain(rng.normal(size=3) + 4 * (i % 5))) for i in range(260)]
    records += [("a", "r900", None), ("a", "r901", [1.0, None, 2.0]), ("a", "r902", [1.0, 2.0]), (None, "r903", [9.0, 9.0, 9.0]), ("z", "r904", [1.0] * 3)]
    queries = [(i, rnd.choice(["a", "a", "b", "none"]), grain(rng.normal(size=3) * 3)) for i in range(23)]
    queries += [(50, None, [1.0, 1.0, 1.0]), (51, "a", None), (52, "a", [1.0, 1.0]), (53, "a", [0.0, 0.0, 0.0])]
    vec = "array<double>"
    got = se.knn_search(
        spark.createDataFrame(queries, f"query_id long, lecture_key string, embedding {vec}").repartition(3),
        spark.createDataFrame(records, f"lecture_key string, rec_id string, embedding {vec}").repartition(4),
        top_k=9, scope=scope, normalized=normalized).select("query_id", "lecture_key", "rec_id", "score", "rank").collect()
    assert {tuple(r) for r in got} == neighbours(queries, records, 9, scope == "lecture", normalized)


@pytest.mark.parametrize("grid", [False, True])
def test_nearest_of_nothing(spark, monkeypatch, grid):
    if grid:
        monkeypatch.setattr(knn, "MEMORY_QUERIES", -1)
    q = spark.createDataFrame([], "query_id long, lecture_key string, embedding array<double>")
    r = spark.createDataFrame([("a", 1, [1.0])], "lecture_key string, rec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, "a", [1.0])], q.schema)
    for scope in ("lecture", "global"):
        assert se.knn_search(q, r, top_k=3, scope=scope).count() == 0
        assert se.knn_search(some, r.where("rec_id < 0"), top_k=3, scope=scope).count() == 0


def test_far_batches_are_skipped():
    best = knn.Best([0], np.array([[1.0, 0.0]]), 2, True)
    best.add(["a", "b"], ["l", "l"], np.array([[0.9, 0.1], [1.0, 0.0]]))
    assert not len(best.reachable(np.array([[-1.0, 0.0], [-0.9, 0.1]])))
    assert len(best.reachable(np.array([[-1.0, 0.0], [0.95, 0.1]])))


def test_term_sums_of_both_plans_agree(spark):
    rng, rnd = np.random.default_rng(5), random.Random(5)
    blocks = spark.createDataFrame([(k, i, [float(v) for v in rng.normal(size=3)]) for k, n in (("a", 70), ("b", 33), ("c", 3)) for i in range(n)],
                                   "lecture_key string, i long, embedding array<double>")
    words = [f"word{i}" for i in range(60)]
    text = F.udf(lambda k, i: " ".join(random.Random(f"{k}{i}").choices(words, k=i % 9)))
    entries = blocks.select("lecture_key", F.col("i").alias("idx"), F.col("i").cast("double").alias("start"),
                            (F.col("i") + 1.0).alias("end"), text("lecture_key", "i").alias("composite")).cache()
    nodes = tr.segment_tree(blocks).cache()
    plans = [{(r.lecture_key, r.path): r.content for r in tr.key_terms(nodes, entries, terms=5, local_rows=n).collect()} for n in (None, 0, 120)]
    assert plans[0] == plans[1] == plans[2] and len(plans[0]) == nodes.where("NOT is_leaf").count()
    rec = {(r.lecture_key, r.tree_path): r for r in tr.tree_records(tr.tree_rollup(nodes, entries)).collect()}
    for row in tr.node_rows(nodes, entries).collect():
        r = rec[row.lecture_key, row.path]
        assert (r.n_utterances, r.start, r.end) == (row.n_utterances, row.start, row.end)
        assert r.raw_text == (row.text if r.is_leaf else None)
    entries.unpersist(), nodes.unpersist()


def test_nearest_on_a_line_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(rnd.choice("aab"), i, rnd.choice([float(rnd.randrange(20)), rnd.uniform(0, 20)])) for i in range(150)] + [("a", 900, None), (None, 901, 3.0)]
    points = [(i, rnd.choice("aabc"), rnd.choice([float(rnd.randrange(22)) - 1, rnd.uniform(-1, 21)])) for i in range(60)] + [(99, "a", None), (98, None, 1.0)]
    want = set()
    for p, key, at in points:
        if at is not None:
            near = sorted((abs(v - at), i) for k, i, v in rows if k == key and v is not None and key)
            want |= {(p, i) for _, i in near[:4]}
    for block in (None, 8):
        if block:
            monkeypatch.setattr(ordered, "LONG_KEY_ROWS", 10)
        got = ordered.nearest_on_line(
            spark.createDataFrame(points, "example_id long, k string, at double"), spark.createDataFrame(rows, "k string, idx long, v double"),
            ["k"], at="at", value="v", tie="idx", k=4, width=3.0).collect()
        assert len(got) <= 8 * len(points) and len({(r.example_id, r.idx) for r in got}) == len(got)
        best = {}
        for r in got:
            best.setdefault(r.example_id, []).append((abs(r.v - r.at), r.idx))
        assert {(p, i) for p, found in best.items() for _, i in sorted(found)[:4]} == want


@pytest.mark.parametrize("scoped", [False, True])
def test_bm25_equals_brute_force_and_skips_common_words(spark, scoped):
    import math

    from rostrum.operators import bm25

    rnd = random.Random(7)
    vocabulary = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(60) for _ in range(1 + i // 20)]
    docs = [(rnd.choice(["a", "a", "b", None]), i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(25)))) for i in range(180)] + [("a", 500, None)]
    asked = [(i, rnd.choice(["a", "b", "z", None]), " ".join(["the", "Of", *rnd.sample(vocabulary, 3)])) for i in range(25)] + [(90, "a", None), (91, "a", "unknown")]
    index = bm25.build_index(spark.createDataFrame(docs, "lecture_key string, rec_id long, text string"), scoped=scoped, k=5)
    queries = spark.createDataFrame(asked, "query_id long, lecture_key string, question string")
    want = set()
    for q, key, text in asked:
        pool = [(i, (t or "").split()) for k, i, t in docs if not scoped or (k == key and key)]
        mean = sum(len(w) for _, w in pool) / max(len(pool), 1)
        scores = {}
        for term in set((text or "").lower().split()):
            df = sum(term in w for _, w in pool)
            for i, w in pool:
                if tf := w.count(term):
                    idf = math.log(1 + (len(pool) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        want |= {(q, i, round(s, 6), r) for r, (s, i) in enumerate(sorted((-round(s, 9), i) for i, s in scores.items())[:5], 1)}
    got = {(r.query_id, r.rec_id, round(-r.score, 6), r.rank) for r in bm25.search(index, queries).collect()}
    assert got == want
    terms = bm25.query_terms(index, queries)
    assert terms.where("NOT essential AND term IN ('the', 'of')").count() > 0 and terms.where("essential").count() > 0
    with pytest.raises(ValueError):
        bm25.search(index, queries, top_k=6)
