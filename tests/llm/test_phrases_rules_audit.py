"""Collocations, the rule ensemble and the filter audit: brute force, planted cases and odd inputs."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import collocations as co
from rostrum.llm import filter_audit as fa
from rostrum.llm import rule_ensemble as re_
from rostrum.llm.common import table

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None, "a", None, 1), (2, "", None, "x", 2), (None, "one two three", "b", None, 3), (4, "word " * 3000, "c", "", 4),
       (5, "same text here", "d", "q", 5), (5, "same text here", "d", "q", 5), (7, "same text here", None, None, None),
       (None, "same text here", None, None, None), (8, "SHOUT $ " * 60, "", None, 1), (9, "", "a", None, 1)]
ODD_COLUMNS = "doc_id long, text string, lang string, mask string, n int"


# --- collocations -------------------------------------------------------------------


def phrases_of(rows, width, min_count=2, share=50):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, width + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    longest = collections.Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i:i + k]] = max(longest[lang, w[i:i + k]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * longest[lang, w] >= share * a and longest[lang, w]:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items()
            for i, (score, a, p, left, right) in enumerate(sorted(found), 1)}


def random_texts(seed, rows=60):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "é", "a b", "\x01", "x-y", "ÄB", *[f"w{i}" for i in range(12)]]
    out = []
    for _ in range(rows):
        t = "".join(rnd.choice(words) if rnd.random() < .6 else rnd.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "?!", "the of "])
                    for _ in range(rnd.randrange(60)))
        out.append((rnd.choice(["en", "de", None, "", "und"]), t))
    return out + [("en", None), ("en", ""), ("fr", " \t "), ("en", "the of " * 400)] + [("de", "same line of words")] * 30


@pytest.mark.parametrize("width,chunk,shares", [(2, 10**6, 8), (3, 10**6, 8), (3, 40, 1), (3, 500, 2), (4, 100, 1), (5, 300, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, width, chunk, shares):
    monkeypatch.setattr(co, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(co, "SHARES", shares)
    monkeypatch.setattr(co, "BATCH_ROWS", 37)
    rows = random_texts(width + chunk)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    got = co.collocations(docs, width=width, min_count=2, top=10**6).collect()
    assert {tuple(r) for r in got} == phrases_of(rows, width)
    assert len(got) == len({(r.lang, r.rank) for r in got})


def test_products_beyond_64_bits(spark):
    a = 3_000_000_000
    assert spark.sql(f"SELECT (1000000BD * CAST({a} AS DECIMAL(15, 0)) * CAST({a} AS DECIMAL(15, 0))) div "
                     f"(CAST({a + 7} AS DECIMAL(15, 0)) * CAST({a + 5} AS DECIMAL(15, 0))) AS s").first().s == 10**6 * a * a // ((a + 7) * (a + 5))


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(none).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None), ("en", "one word.")], "lang string, text string")).count() == 0


def test_windows_of_wide_vocabularies():
    ids = np.array([5, 900_000, 3, 0, 5, 900_000, 3, 4, 0, 0, 7, 0], dtype=np.int64)
    for width in (2, 3, 4, 6):
        cols, n = co.counted_windows(ids, width)
        want = collections.Counter()
        for i in np.flatnonzero(ids):
            w = list(ids[i:i + width]) + [0] * width
            w = w[:(w.index(0))][:width]
            want[tuple(map(int, w + [0] * (width - len(w))))] += 1
        assert dict(zip(zip(*(c.tolist() for c in cols)), n.tolist())) == want


# --- filter audit -------------------------------------------------------------------


def test_trie_holds_texts():
    rnd = random.Random(1)
    texts = {bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randrange(9))) for _ in range(400)} | {b"", b"a" * 9000, b"a" * 9000 + b"b"}
    trie = fa.Trie()
    for _ in range(2):
        for t in texts:
            trie.node(t).end = t
    walked = list(trie.walk())
    assert [t for t, _, _ in walked] == sorted(texts) and all(n.end == t for t, n, _ in walked)
    for (before, _, _), (t, _, prefix) in zip(walked, walked[1:]):
        assert t.startswith(prefix) and not before.startswith(prefix)


def masks_of(rows):
    out = collections.Counter()
    for doc, text, part, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 any(c in "#$%&*|" for c in text), doc is not None and min(same) < doc]
        out[doc, part or "", sum(f << i for i, f in enumerate(fails))] += 1
    return out


@pytest.mark.parametrize("held,cut", [(64 << 20, 1 << 20), (0, 1), (300, 5)])
def test_duplicate_flags_equal_brute_force(spark, monkeypatch, held, cut):
    monkeypatch.setattr(fa, "HELD_BYTES", held)
    monkeypatch.setattr(fa, "CUT_BYTES", cut)
    monkeypatch.setattr(fa, "CUTS_A_RANGE", 2)
    monkeypatch.setattr(fa, "BATCH_ROWS", 7)
    monkeypatch.setattr(fa, "MAX_CUTS", 30)
    rnd = random.Random(held + cut)
    rows = list(ODD)
    for i in range(200):
        stem = rnd.choice(["", "near copy " * 30, "é", "a"])
        rows.append((rnd.choice([None, i, i // 3, 1000 - i]), stem + rnd.choice(["", "x", "xy", "ü", "longer tail " * 20]), rnd.choice(["en", "", None]), "m", 1))
    got = collections.Counter()
    for r in fa.failure_masks(spark.createDataFrame(rows, ODD_COLUMNS).repartition(5)).collect():
        got[r.doc_id, r.part, r.mask] += r.n
    assert got == masks_of(rows)


def test_audit_equals_brute_force(spark):
    labels = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (5, 1, None), (5, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (77, 1, 1)]
    docs = spark.createDataFrame(ODD, ODD_COLUMNS)
    masks = fa.with_labels(fa.failure_masks(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): r for r in fa.interaction_audit(masks, of=("good", "toxic")).collect()}
    rows = list(masks_of(ODD).elements())
    good, toxic = {d for d, q, _ in labels if d and q == 1}, {d for d, _, t in labels if d and t == 1}
    parts = {p for _, p, _ in rows}
    assert set(got) == {(p, "".join(o), s) for p in parts for o in itertools.permutations("ABCDE") for s in range(1, 6)}
    shapley = collections.Counter()
    for o in itertools.permutations("ABCDE"):
        for part in parts:
            left = [(d, m) for d, p, m in rows if p == part]
            all_of, gone = list(left), []
            for s, c in enumerate(o, 1):
                bit = 1 << "ABCDE".index(c)
                out, left = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                r = got[part, "".join(o), s]
                assert (r.kept, r.removed) == (len(left), len(out))
                assert r.redundant == sum(bool(m & bit) for _, m in gone) and r.unique_fails == sum(m == bit for _, m in all_of)
                assert (r.good_lost, r.toxic_lost) == (sum(d in good for d, _ in out), sum(d in toxic for d, _ in out))
                gone += out
                shapley[part, c] += len(out)
    assert all(r.shapley == shapley[p, o[s - 1]] for (p, o, s), r in got.items())


def test_audit_of_nothing(spark):
    masks = fa.failure_masks(spark.createDataFrame([], ODD_COLUMNS))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.interaction_audit(fa.with_labels(masks, labels), of=("good", "toxic")).count() == 0


# --- rule ensemble ------------------------------------------------------------------


def test_rules_tell_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = re_.op12_quality(spark, folder).join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 80 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.score >= 0.5) for r in out)


def test_compiled_rules_equal_their_meaning(spark):
    rules = (re_.Rule(((0, ">", 2.0), (10, "<=", 0.9)), 1.5), re_.Rule(((6, ">", 0.01),), -2.25), re_.Rule(((1, "<=", 14.0),), 0.5))
    model = re_.Ensemble(rules, -0.25)
    docs = spark.createDataFrame(ODD, ODD_COLUMNS)
    got = re_.score_quality(docs.withColumnRenamed("mask", "score").withColumnRenamed("n", "s0"), model)
    assert got.columns == ["doc_id", "text", "lang", "s0", "score", "predicted"]
    for r in got.collect():
        text = (r.text or "").encode()
        stats = re_.statistics(text, len(r.text or ""))
        holds = [all(stats[i] <= v if side == "<=" else stats[i] > v for i, side, v in rule.bounds) for rule in rules]
        total = -0.25 + sum(rule.weight for rule, h in zip(rules, holds) if h)
        assert r.score == pytest.approx(1 / (1 + np.exp(-total))) and r.predicted == (r.score >= 0.5)


def test_paths_of_a_tree():
    text = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 3 <= 0.5)
   If (feature 1 <= -1.0E-4)
    Predict: 0.0
   Else (feature 1 > -1.0E-4)
    Predict: 1.0
  Else (feature 3 > 0.5)
   If (feature 3 <= 2.0)
    Predict: 1.0
   Else (feature 3 > 2.0)
    Predict: 0.0
"""
    assert re_.tree_rules(text) == [
        ((3, "<=", 0.5),), ((1, "<=", -1e-4), (3, "<=", 0.5)), ((1, ">", -1e-4), (3, "<=", 0.5)),
        ((3, ">", 0.5),), ((3, "<=", 2.0), (3, ">", 0.5)), ((3, ">", 2.0),)]


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, 1), (4, 1)], None), ([(i, None) for i in range(9)], 0.5)])
def test_rules_of_few_labels(spark, labels, score):
    docs = spark.createDataFrame(ODD, ODD_COLUMNS)
    model = re_.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = re_.score_quality(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == len(ODD) and not model.rules
    assert all(r.score == score if score is not None else r.score > 0.9 for r in rows)
    assert re_.score_quality(docs.where(F.lit(False)), model).count() == 0
