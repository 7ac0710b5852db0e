"""What shows only on larger tables: keys beyond a million, work that must not grow faster than its input."""

import math
import random

import duckdb
import pytest
from harness import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_key_ranges_beyond_a_million_equal_their_sql(spark, tmp_path):
    moved = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("event_id", F.col("event_id") + 999_500)
    moved.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    name = "expanded_key_ranges"
    rows, _, bad, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert bad is None and rows > 1000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_phrases_shuffle_nothing_and_do_not_depend_on_chunks(spark, monkeypatch):
    from rostrum.operators import phrases as kp

    rnd = random.Random(3)
    vocabulary = ["of", "the", "Graph", "graphs", "graphed", "NODE", "node", "tree", "wide", "x1", "Ärger", "naïve"]
    texts = [(i, ". ".join(" ".join(rnd.choices(vocabulary, k=rnd.randrange(9))) for _ in range(rnd.randrange(7)))) for i in range(120)]
    df = spark.createDataFrame([*texts, (900, None), (901, "...")], "doc_id long, text string")
    assert "Exchange" not in plan_of(kp.key_phrases(df, ["doc_id"]))
    whole = sorted(map(tuple, kp.key_phrases(df, ["doc_id"]).collect()))
    monkeypatch.setattr(kp, "CHUNK_WORDS", 10)
    assert sorted(map(tuple, kp.key_phrases(df, ["doc_id"]).collect())) == whole
    assert len({r[0] for r in whole}) > 80 and not {900, 901} & {r[0] for r in whole}


@pytest.fixture(scope="module")
def lecture(spark):
    """One lecture whose tree leans: blocks, entries and nodes."""
    from rostrum.operators import tree as tr

    rnd = random.Random(8)
    blocks = spark.createDataFrame([("a", i, [rnd.gauss(i ** 0.5, 1.0), rnd.gauss(0.0, 1.0)]) for i in range(150)],
                                   "lecture_key string, i long, embedding array<double>")
    words = [f"word{i}" for i in range(80)]
    entries = spark.createDataFrame([("a", i, float(i), i + 1.0, " ".join(rnd.choices(words, k=i % 13))) for i in range(150)],
                                    "lecture_key string, idx long, start double, end double, composite string")
    return tr.segment_tree(blocks).cache(), entries.cache()


def test_terms_of_a_long_lecture_make_no_row_per_ancestor(spark, lecture, monkeypatch):
    from rostrum.operators import tree as tr

    nodes, entries = lecture
    want = {r.path: r.content for r in tr.key_terms(nodes, entries, terms=4).collect()}
    rows = [(r.path, r.content) for r in tr.key_terms(nodes, entries, terms=4).collect()]

    def never(path):
        raise AssertionError("a row per ancestor")

    monkeypatch.setattr(tr, "ancestors", never)
    assert {r.path: r.content for r in tr.key_terms(nodes, entries, terms=4, local_rows=40).collect()} == want
    terms = {(r.leaf, r.term): r.tf for r in tr.leaf_terms(nodes, entries).collect()}
    leaves, n_leaves = {leaf for leaf, _ in terms}, nodes.where("is_leaf").count()
    for path, content in rows:
        tf = {}
        for (leaf, term), n in terms.items():
            if leaf.startswith(path):
                tf[term] = tf.get(term, 0) + n
        idf = {t: math.log((n_leaves + 1) / (sum((leaf, t) in terms for leaf in leaves) + 1)) + 1 for t in tf}
        assert content == " ".join(sorted(tf, key=lambda t: (-round(tf[t] * idf[t], 6), t))[:4])


def test_evidence_is_ranked_without_its_texts(spark, lecture):
    from rostrum.operators import search as se
    from rostrum.operators import tree as tr

    records = tr.hashed_embedding(tr.tree_records(tr.tree_rollup(*lecture))).cache()
    queries = tr.hashed_embedding(spark.createDataFrame([(q, "a", f"word{q} word{q + 9}") for q in range(6)],
                                                        "query_id long, lecture_key string, question string"), "question")
    hits = queries.select("query_id", "lecture_key").join(records.drop("embedding"), "lecture_key").withColumn("rank", F.lit(1))
    got = se.expand_supporting_leaves(hits, records, queries)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(i for i, x in enumerate(plan) if "Window [row_number" in x)
    depth = len(plan[top]) - len(plan[top].lstrip(" :+-"))
    below = []
    for x in plan[top + 1:]:
        if len(x) - len(x.lstrip(" :+-")) <= depth:
            break
        below.append(x)
    assert below and not any(x.lstrip(" :+-").startswith("Project") and " text#" in x for x in below)

    # Brute force over the lists of leaves that the records hold.
    table = {r.tree_path: r for r in records.collect()}
    asked = {r.query_id: r.embedding for r in queries.collect()}
    for r in got.select("query_id", "tree_path", "is_leaf", "descendant_leaf_tree_paths", "supporting_leaves").collect():
        score = lambda p: round(sum(x * y for x, y in zip(asked[r.query_id], table[p].embedding)), 9)  # noqa: B023, E731
        want = [] if r.is_leaf else sorted(r.descendant_leaf_tree_paths, key=lambda p: (-score(p), p))[:3]
        assert [x.tree_path for x in r.supporting_leaves] == want
        assert all(x.text == table[x.tree_path].text for x in r.supporting_leaves)
    records.unpersist()


def test_bm25_counts_within_rows_and_keeps_asked_words(spark):
    from rostrum.operators import bm25

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [("a", i, " ".join(rnd.choices(words, k=rnd.randrange(30)))) for i in range(90)]
    docs += [("a", 7, docs[7][2]), ("b", 7, "w1 w1 w2"), ("a", 500, None), (None, 501, "w1")]
    asked = spark.createDataFrame([(q, "a", " ".join(rnd.sample(words[:12], 3))) for q in range(12)], "query_id long, lecture_key string, question string")
    records = spark.createDataFrame(docs, "lecture_key string, rec_id long, text string")
    listed = records.select(F.lit("").alias("scope"), "rec_id", F.split("text", " ").alias("_w"))
    assert "Exchange" not in plan_of(bm25._counted(listed))
    known = bm25.asked_words(asked)
    for scoped in (False, True):
        whole, part = (bm25.build_index(records, scoped=scoped, k=4, words=w) for w in (None, known))
        found = [sorted(map(tuple, bm25.search(x, asked).collect())) for x in (whole, part)]
        assert found[0] == found[1] and len(found[0]) == 48
        assert {r.term for r in part.postings.collect()} <= {r.term for r in known.collect()}
        assert part.postings.count() < whole.postings.count()
    # An id that repeats with one text counts as one record of twice the words, as in the SQL.
    twice = whole.postings.where("scope = 'a' AND rec_id = 7").count()
    assert twice == len(set(docs[7][2].split()))


@pytest.mark.parametrize("scoped", [False, True])
def test_bm25_moves_no_row_per_query_and_record(spark, monkeypatch, scoped):
    from rostrum.operators import bm25

    rnd = random.Random(12)
    words = ["the"] * 25 + [f"w{i}" for i in range(50)]
    docs = [(rnd.choice(["a", "b"]), i, " ".join(rnd.choices(words, k=rnd.randrange(30)))) for i in range(120)]
    docs += [(k, i, " ".join(rnd.choices(words, k=n))) for k, i, _ in docs[:20] for n in (6, 6, 11)] + [("a", None, "w1 w2"), ("a", None, "w3"), ("b", 400, None)]
    asked = [(q, rnd.choice(["a", "b"]), " ".join(["the", *rnd.sample(words[25:], 4)])) for q in range(30)] + [(3, "a", "w1 w4")]
    records = spark.createDataFrame(docs, "lecture_key string, rec_id long, text string").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, lecture_key string, question string")
    con = duckdb.connect()
    con.register("d", records.toPandas().astype({"rec_id": "Int64"}))
    con.register("b", queries.toPandas())
    con.execute("CREATE VIEW documents AS SELECT rec_id AS doc_id, lecture_key AS source, text FROM d")
    con.execute("CREATE VIEW benchmark AS SELECT query_id AS item_id, lecture_key, question AS text FROM b")
    from rostrum.plans.index_queries import _BM25_TOP, _bm25_sql

    sql = (_bm25_sql("source", "lecture_key") if scoped else _bm25_sql("''", "''")).replace("FROM documents", "FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)")
    top = _BM25_TOP.replace("score DESC, rec_id", "score DESC, rec_id NULLS FIRST").replace("rank <= 10", "rank <= 7")
    want = sorted(con.execute(sql + top).fetchall(), key=str)
    for few in (1 << 17, 8):  # sent to the records, and met in a grid of small blocks
        monkeypatch.setattr(bm25, "MEMORY_ROWS", few)
        monkeypatch.setattr(bm25, "RECORD_ROWS", 1 << 18 if few > 8 else 16)
        monkeypatch.setattr(bm25, "SCORES", 1 << 20 if few > 8 else 64)
        index = bm25.build_index(records, scoped=scoped, k=7, words=bm25.asked_words(queries))
        assert index.records.count() == len({r[:2] if scoped else r[1] for r in docs})
        found = bm25.search(index, queries)
        assert not [x for x in plan_of(found).splitlines() if "Exchange hashpartitioning" in x and "query_id" in x and "rec_id" in x]
        assert sorted(map(tuple, found.withColumn("score", F.round("score", 6)).collect()), key=str) == want


def test_random_trials_start_from_stored_flags(spark):
    plan = plan_of(entry.queries()["random_boundary_trials"](spark, SMALL))
    assert plan.count("Exchange") <= 12 and "parquet" not in plan.lower()


def test_a_group_of_many_batches_is_joined_once(monkeypatch):
    import pandas as pd

    from rostrum.plans import ordered

    class Plain:
        """The batches of one task; what Spark does before is left out."""

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInPandas(self, run, schema):
            return run

    copied, plain = [], pd.concat
    monkeypatch.setattr(ordered.pd, "concat", lambda parts, **kw: copied.append(sum(map(len, parts))) or plain(parts, **kw))
    seen = []
    run = ordered.map_sorted_groups(Plain(), ["k"], ["i"], lambda r: seen.append((r["k"][0], r["i"].tolist())) or {"k": r["k"][:1]}, "k string")
    rows = [("a", i) for i in range(7)] + [("b", i) for i in range(2000)] + [("c", 0), ("d", 0), ("d", 1)]
    batches = [pd.DataFrame(rows[at:at + 10], columns=["k", "i"]) for at in range(0, len(rows), 10)]
    got = [k for df in run([batches[0].iloc[:0], *batches]) for k in df["k"]]
    assert got == ["a", "b", "c", "d"] and [(k, len(i)) for k, i in seen] == [("a", 7), ("b", 2000), ("c", 1), ("d", 2)]
    assert all(i == list(range(len(i))) for _, i in seen)
    assert sum(copied) <= len(rows)


def test_terms_of_a_deep_tree_score_what_rises(monkeypatch):
    import numpy as np

    from rostrum.operators import tree as tr

    n = 300  # the tree takes off one leaf after the other
    leaves = ["*" + "R" * i + "L" for i in range(n - 1)] + ["*" + "R" * (n - 1)]
    tables = [{f"t{i}{j}": 1 + j % 3 for j in range(20)} | {"all": 2, f"some{i % 7}": 3} for i in range(n)]
    terms = [(leaf, t, k) for leaf, table in zip(leaves, tables) for t, k in sorted(table.items())]
    scored, plain = [], np.round
    monkeypatch.setattr(tr.np, "round", lambda x, d: scored.append(len(x)) or plain(x, d))
    rows = {"lecture_key": np.array(["a"] * n), "leaf": np.array(leaves, dtype=object), "n_leaves": np.full(n, n)}
    for name in ("terms", "tf"):
        rows[name] = np.empty(n, dtype=object)
        rows[name][:] = [np.array([(t, k)[name == "tf"] for x, t, k in terms if x == leaf]) for leaf in leaves]
    out = tr._best_terms(4)(rows)
    df = {t: sum(t in table for table in tables) for table in tables for t in table}
    for path, got in list(zip(out["path"], out["terms"]))[::37]:
        tf = {}
        for leaf, table in zip(leaves, tables):
            for t, k in table.items() if leaf.startswith(path) else ():
                tf[t] = tf.get(t, 0) + k
        score = {t: plain(tf[t] * (math.log((n + 1) / (df[t] + 1)) + 1), 6) for t in tf}
        assert got == sorted(tf, key=lambda t: (-score[t], t))[:4]
    assert len(out["path"]) == n - 1 and sum(scored) <= 4 * len(terms)


def test_leaf_words_are_counted_where_their_text_is(spark, lecture):
    from rostrum.operators import tree as tr

    leaf = tr._leaf_texts(*lecture).localCheckpoint()
    assert "Exchange" not in plan_of(tr._leaf_counts(leaf))
    assert "md5(" not in plan_of(tr.hashed_embedding(leaf))


def test_only_texts_of_hits_are_moved(spark):
    from rostrum.operators import search as se

    records = spark.createDataFrame([("a", i, f"text {i}", [1.0, float(i)]) for i in range(50)],
                                    "lecture_key string, rec_id long, text string, embedding array<double>")
    queries = spark.createDataFrame([(1, "a", [0.0, 1.0])], "query_id long, lecture_key string, embedding array<double>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = se.with_payload(se.knn_search(queries, records, top_k=2), records)
        assert "SortMergeJoin" not in plan_of(hits)
        assert sorted(r.text for r in hits.collect()) == ["text 48", "text 49"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_packing_finds_tokens_once_and_sentences_are_split_once(spark, monkeypatch):
    from rostrum.operators import chunks as ck
    from rostrum.operators import meetings as me
    from rostrum.plans import ordered

    units = spark.createDataFrame([("a", i, f"w{i} x . y", float(i), i + 1.0, None) for i in range(40)],
                                  "lecture_key string, idx long, text string, start double, end double, slide_index long")
    got = ck.pack_units(units, size=7)
    assert "regexp_extract_all" not in plan_of(got)
    assert sum(r.token_count for r in got.collect()) == 40 * 5  # a no-break space that nobody cleaned is a mark
    words = spark.createDataFrame([("m", i, w, float(i), i + 1.0) for i, w in enumerate(["One", "two", ".", "Three", "!"])],
                                  "meeting string, pos long, text string, start double, end double")
    asked = []
    monkeypatch.setattr(ordered, "has_long_key", lambda df, keys: asked.append(list(keys)) or False)
    parts = me.split_sentences(me.space_plain_words(words), ["meeting"], long=False)
    said = me.join_spaced(parts, ["meeting", "sentence"], long=False)
    assert sorted(r.text for r in said.collect()) == ["One two.", "Three!"] and not asked


def test_plain_words_are_tokens_without_a_search(spark):
    from rostrum.operators import chunks as ck

    said = ["Plain", "x_1", "it's", " ", "", None, " A b ", "Ärger", "plain\n", "a b"]
    words = spark.createDataFrame([("a", i, w, float(i), i + 1.0) for i, w in enumerate(said)],
                                  "lecture_key string, ord long, word string, start double, end double")
    got = ck.token_windows(words, size=50).first()
    assert got.text == "plain x_1 it ' s a b ärger plain a b" and got.token_count == 11 and got.source_item_end == 6


def test_keyword_profile_moves_no_row_per_text_and_term(spark, monkeypatch):
    from rostrum.operators import tree as tr

    rnd = random.Random(6)
    words = [f"word{i}" for i in range(30)] + ["ab", "Ärger"]
    texts = [(i % 55, " ".join(rnd.choices(words, k=rnd.randrange(40)))) for i in range(60)] + [(70, None), (71, "lone")]
    want = []
    for key in {k for k, _ in texts}:
        tf = {}
        for k, text in texts:
            for w in (text or "").lower().split() if k == key else ():
                tf[w] = tf.get(w, 0) + (len(w) >= 3)
        want.append((key, {w: n for w, n in tf.items() if n}))
    df = {w: sum(w in tf for _, tf in want) for _, tf in want for w in tf}
    best = set()
    for key, tf in want:
        score = {w: round(n * (math.log((len(texts) + 1) / (df[w] + 1)) + 1), 6) for w, n in tf.items()}
        best |= {(key, r, w, tf[w], df[w]) for r, w in enumerate(sorted(tf, key=lambda w: (-score[w], w))[:5], 1)}
    table = spark.createDataFrame(texts, "k long, text string")
    for known in (0, 9, 1 << 17):
        monkeypatch.setattr(tr, "KNOWN_TERMS", known)
        assert {(r.k, r.rank, r.term, r.tf, r.df) for r in tr.keyword_profile(table, ["k"]).collect()} == best
    once = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "k long, text string")
    pairs = tr.counted_words(once, "text", ["k"]).selectExpr("sum(size(terms))").first()[0]
    plan = tr.keyword_profile(once, ["k"])
    kept, plain = [], tr.attach_per_key
    monkeypatch.setattr(tr, "attach_per_key", lambda df, *a, **k: kept.append(df.count()) or plain(df, *a, **k))
    tr.keyword_profile(once, ["k"])
    assert kept[0] < pairs / 2 and plan.count() <= 5 * len(texts)


def test_windows_of_texts_make_no_row_per_word(spark, monkeypatch):
    from rostrum.operators import chunks as ck
    from rostrum.plans.fixtures import Tables

    rnd = random.Random(11)
    words = ["Alpha", "it's", "x", "ÄRGER", "(b)", "", "--", "9.5", "a b", "Σας", "ΟΔΟΣ"]
    rows = [("abc"[i % 3], i, float(i), i + 1.0, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 30])))) for i in range(60)]
    rows.append(("d", 0, 0.0, 1.0, None))
    texts = spark.createDataFrame(rows, "lecture_key string, idx long, start double, end double, text string")
    each = [(key, 1000 * i + p, s, e, w) for key, i, s, e, t in rows for p, w in enumerate((t or "").split(" "))]
    flat = spark.createDataFrame(each, "lecture_key string, ord long, start double, end double, word string")
    cols = ["lecture_key", "chunk_id", "text", "start", "end", "token_count"]
    made = []
    plain = ck._with_tokens
    monkeypatch.setattr(ck, "_with_tokens", lambda r, *a: made.append(r) or plain(r, *a))
    for size, overlap in ((7, 2), (16, 0), (5, 4), (500, 50)):
        want = sorted(map(tuple, ck.token_windows(flat, size=size, overlap=overlap).select(*cols).collect()))
        made.clear()
        got = ck.text_windows(texts, size=size, overlap=overlap)
        assert sorted(map(tuple, got.select(*cols).collect())) == want and len(want) >= 3
        assert made[0].count() == len(rows)  # a row per text
    assert "text_windows" in Tables.window_records.func.__code__.co_names  # what retrieval_scores searches


@pytest.mark.parametrize("long", [False, True])
def test_trials_equal_flags_at_every_position_and_make_no_row_for_each(spark, monkeypatch, long):
    from rostrum.operators import metrics as mt
    from rostrum.plans import ordered

    monkeypatch.setattr(ordered, "BLOCK_ROWS", 8)
    rnd = random.Random(4)
    refs = [(key, i, int(rnd.random() < share)) for key, n, share in (("a", 60, 0.2), ("b", 7, 0.9), ("c", 5, 0.0), ("d", 1, 0.0), ("e", 2, 0.5), ("f", 30, 0.05))
            for i in range(n)]
    ref = spark.createDataFrame(refs, "lecture_key string, i long, ref int")
    sizes = ref.groupBy("lecture_key").agg(F.count(F.lit(1)).alias("n"), F.sum("ref").alias("n_ref"))
    sizes = sizes.withColumn("n_boundaries", F.when(F.col("lecture_key") == "f", 0).otherwise(F.col("n_ref") + 1).cast("long"))
    draws = mt.random_boundaries(sizes, trials=4).withColumn("hyp", F.lit(1))
    every = ref.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(4))))
    flags = every.join(draws, ["lecture_key", "trial", "i"], "left").fillna(0, ["hyp"])
    cols = ["lecture_key", "trial", "k", "wd", "pk"]
    want = sorted(map(tuple, mt.boundary_errors(flags, keys=["lecture_key", "trial"], long=False).select(*cols).collect()))
    scanned = []
    plain = ordered.ordered_scan
    monkeypatch.setattr(mt, "ordered_scan", lambda df, *a, **kw: scanned.append(df) or plain(df, *a, **kw))
    got = mt.trial_errors(ref, sizes, trials=4, long=long)
    assert sorted(map(tuple, got.select(*cols).collect())) == want and len(want) == 24 and any(r[3] > 0 for r in want)
    many = scanned[0].count()
    longer = ref.where("lecture_key = 'f'").unionByName(spark.createDataFrame([("f", i, 0) for i in range(30, 3000)], ref.schema))
    scanned.clear()
    n = sizes.where("lecture_key = 'f'").withColumn("n", F.lit(3000).cast("long"))
    mt.trial_errors(longer, n, trials=4, long=long)
    assert scanned[0].count() <= 8 * sum(r for *_, r in refs) < many  # as many rows as boundaries, not as positions


def test_a_lecture_that_one_task_can_hold_is_not_split_by_jobs(spark, monkeypatch):
    from rostrum.operators import tree as tr

    blocks = spark.range(20_000).select(F.lit("a").alias("lecture_key"), F.col("id").alias("i"),
                                        F.array(F.sqrt("id"), F.sin("id")).alias("embedding"))
    splits = []
    plain = tr._split_large
    monkeypatch.setattr(tr, "_split_large", lambda *a: splits.append(a[-1]) or plain(*a))
    whole = {(r.path, r.lo, r.hi) for r in tr.segment_tree(blocks).collect()}
    assert not splits and len(whole) > 4000
    monkeypatch.setattr(tr, "LOCAL_NODE_VALUES", 24_000)  # vectors are counted by their numbers
    assert {(r.path, r.lo, r.hi) for r in tr.segment_tree(blocks).collect()} == whole and splits == [12_000]


def test_overlaps_need_no_list_of_leaves(spark, lecture, monkeypatch):
    from rostrum.operators import search as se
    from rostrum.operators import tree as tr

    nodes, entries = lecture
    rec = tr.tree_records(tr.tree_rollup(nodes, entries))
    hits = rec.selectExpr("*", "hash(tree_path) % 4 AS query_id").withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY md5(tree_path))"))
    kept = sorted(map(tuple, se.drop_overlapping_hits(hits).select("query_id", "rank", "tree_path").collect()))
    pairs = sorted(map(tuple, se.overlap_pairs(hits).collect()))
    bare = hits.drop("descendant_leaf_tree_paths")
    assert sorted(map(tuple, se.drop_overlapping_hits(bare).select("query_id", "rank", "tree_path").collect())) == kept
    assert sorted(map(tuple, se.overlap_pairs(bare).collect())) == pairs and {True, False} == {p[-1] for p in pairs}

    def never(*a):
        raise AssertionError("a path per leaf and ancestor")

    monkeypatch.setattr(tr, "descendant_leaves", never)
    cols = [c for c in rec.columns if c != "descendant_leaf_tree_paths"]
    lean = tr.tree_records(tr.tree_rollup(nodes, entries, below=False))
    assert sorted(map(str, lean.select(*cols).collect())) == sorted(map(str, rec.select(*cols).collect()))
    entry.queries()["tree_statistics"](spark, SMALL).collect()


def test_words_of_leaves_are_found_once_and_their_texts_stay(spark, monkeypatch):
    from rostrum.operators import tree as tr

    rnd = random.Random(4)
    blocks = spark.createDataFrame([("a", i, [rnd.gauss(0.0, 1.0), rnd.gauss(0.0, 1.0)]) for i in range(60)],
                                   "lecture_key string, i long, embedding array<double>")
    texts = [" \t" if i < 40 else "..." if i == 59 else " ".join(rnd.choices(["Of", "TREE", "graph", "Ärger", "x1", "blank"], k=9)) for i in range(60)]
    entries = spark.createDataFrame([("a", i, float(i), i + 1.0, t) for i, t in enumerate(texts)],
                                    "lecture_key string, idx long, start double, end double, composite string")
    nodes = tr.segment_tree(blocks).cache()
    want = tr.hashed_embedding(tr.tree_records(tr.tree_rollup(nodes, entries, below=False))).collect()
    searched, plain = [], tr.word_tokens
    monkeypatch.setattr(tr, "word_tokens", lambda x: searched.append(x) or plain(x))
    rec = tr.tree_records(tr.tree_rollup(nodes, entries, below=False, dim=64))
    assert searched == ["text", "summary_text"]  # of the leaves, and of the short summaries
    plan = plan_of(rec).splitlines()
    at = next(i for i, x in enumerate(plan) if "Union" in x)
    assert not any("Join" in x or "Exchange" in x for x in plan[:at])
    assert sorted(map(str, rec.select(*want[0].__fields__).collect())) == sorted(map(str, want))
    assert any(r.raw_text == "<blank>" and sum(map(bool, r.embedding)) == 1 for r in rec.collect())


def test_a_lecture_has_few_parts_and_terms_are_hashed_once(monkeypatch):
    import pyarrow as pa

    from rostrum.operators import tree as tr

    n = 50
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a"] * n), pa.array([f"*{'R' * i}L" for i in range(n)]), pa.array([n] * n), pa.array([3] * n),
         pa.array([[f"word{j}" for j in range(i % 5, 40)] for i in range(n)]), pa.array([[j + 1 for j in range(i % 5, 40)] for i in range(n)])],
        names=["lecture_key", "leaf", "n_leaves", "_parts", "terms", "tf"])
    hashed, plain = [], tr.pd.util.hash_array
    monkeypatch.setattr(tr.pd.util, "hash_array", lambda x, **kw: hashed.append(len(x)) or plain(x, **kw))
    got = [r for b in tr._dealt_terms([batch]) for r in b.to_pylist()]
    assert hashed == [40] and len({(r["leaf"], r["_part"]) for r in got}) == len(got)
    parts = {}
    for r in got:
        for t, k in zip(r["terms"], r["tf"]):
            assert k == int(t[4:]) + 1 and parts.setdefault(t, r["_part"]) == r["_part"]
    assert len(set(parts.values())) == 3 and sum(len(r["terms"]) for r in got) == sum(40 - i % 5 for i in range(n))
    # At 6 GB a lecture of this data has some 70 million counts and 10,000 inner nodes.
    assert tr.LOCAL_TERM_ROWS >= 1 << 22
