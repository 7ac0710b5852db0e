"""Key phrases of single texts: words weighed by their neighbours, places and spread, phrases by their words.

A word weighs little (which is good) when it comes early, is written with a capital, is frequent
and stands in many sentences, and much when its neighbours vary, as those of function words do. The
neighbours are the edges of the word co-occurrence graph of the text. A phrase scores by the product
of its words' weights over its own frequency; of phrases that are equal but for the ends of their
words only the best one stays. No statistics of other texts are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rostrum.functions.text import WORD_PATTERN

# Longest phrase, phrases per text, letters of a content word, and letters by which words are told apart.
MAX_WORDS, TOP, CONTENT_LETTERS, STEM_LETTERS = 3, 5, 3, 5
SENTENCE = r"[.!?\n]+"
PLACES = 9
#: Words that are counted at a time; a longer text is counted by itself.
CHUNK_WORDS = 1 << 18


def _sentences(text: str):
    """Words by sentence, with what their capitals say; sentences without words do not count."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE),
                                 lambda s: F.regexp_extract_all(s, F.lit(WORD_PATTERN), F.lit(0))), lambda w: F.size(w) > 0)

    def word(raw, p):
        first = F.substring(raw, 1, 1)
        return F.struct(
            F.lower(raw).alias("term"), ((raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1)).alias("caps"),
            ((first == F.upper(first)) & (first != F.lower(first)) & (p > 0)).alias("title"))

    return F.transform(found, lambda s: F.transform(s, word))


def _ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for every different pair of two columns, ordered as the pairs are."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=-1)) + 2) + b + 1, return_inverse=True)[1]


def _different(own: np.ndarray, other: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    """How many different known values of ``other`` each of ``n`` terms has."""
    own, other = own[known], other[known]
    pair = _ids(own, other)
    first = np.full(pair.max(initial=-1) + 1, -1)
    first[pair] = own
    return np.bincount(first, minlength=n)


def word_weights(doc: np.ndarray, s: np.ndarray, code: np.ndarray, caps: np.ndarray, title: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Weight of every word of some texts, given in order by text and sentence; lower is better.

    ``s`` is the sentence within the text, ``code`` the term, ``content`` tells the terms of enough letters.
    """
    own = _ids(doc, code)
    n = int(own.max()) + 1
    at, term = np.zeros(n, int), np.zeros(n, int)
    at[own], term[own] = doc, code
    same = np.append(False, (doc[1:] == doc[:-1]) & (s[1:] == s[:-1]))
    before, after = np.roll(code, 1), np.roll(code, -1)
    ahead = np.append(same[1:], False)
    tf = np.bincount(own, minlength=n)
    order = np.lexsort((s, own))
    start = np.cumsum(tf) - tf
    median = (s[order][start + (tf - 1) // 2] + s[order][start + tf // 2]) / 2.0
    varied = np.zeros(n)
    for near, known in ((before, same), (after, ahead)):
        all_ = np.bincount(own[known], minlength=n)
        varied = varied + _different(own, near, known, n) / np.maximum(all_, 1)
    docs = int(doc.max()) + 1
    long = content[term]
    count = np.maximum(np.bincount(at[long], minlength=docs), 1)
    mean = np.bincount(at[long], weights=tf[long], minlength=docs) / count
    spread_of = np.sqrt(np.bincount(at[long], weights=(tf[long] - mean[at[long]]) ** 2, minlength=docs) / count)
    most, sentences = np.zeros(docs, int), np.zeros(docs, int)
    np.maximum.at(most, at, tf)
    np.maximum.at(sentences, doc, s + 1)
    usual = (mean + spread_of)[at]
    rel = 1 + varied * tf / most[at]
    case = np.maximum(np.bincount(own, weights=caps, minlength=n), np.bincount(own, weights=title, minlength=n)) / (1 + np.log(tf))
    norm = np.divide(tf, usual, out=np.zeros(n), where=usual > 0)
    spread = _different(own, s, np.ones(len(s), bool), n) / sentences[at]
    return (rel * np.log(np.log(3 + median)) / (case + norm / rel + spread / rel))[own]


def _best(doc, s, term: pa.Array, caps, title, max_words: int, top: int):
    """Columns ``doc, rank, phrase, tf, score`` of the best phrases of some texts."""
    coded = term.dictionary_encode()
    words = coded.dictionary.to_pylist()
    place = np.argsort(np.argsort(np.array(words, dtype=object)))
    words = sorted(words)  # by code points, which is the byte order of UTF-8
    code = place[np.asarray(coded.indices)]
    content = np.array([len(w) >= CONTENT_LETTERS for w in words])
    stem = np.unique([w[:STEM_LETTERS] for w in words], return_inverse=True)[1][code]
    weight = word_weights(doc, s, code, caps, title, content)
    where, run, alike = np.arange(len(doc)), doc, doc
    product, total = np.ones(len(doc)), np.zeros(len(doc))
    parts = []
    for k in range(max_words):
        if k:
            where = where[where + k < len(doc)]
            inside = (doc[where + k] == doc[where]) & (s[where + k] == s[where])
            run, alike, product, total = (x[:len(where)][inside] for x in (run, alike, product, total))
            where = where[inside]
            if not len(where):
                break
        run, alike = _ids(run, code[where + k]), _ids(alike, stem[where + k])
        product, total = product * weight[where + k], total + weight[where + k]
        ok = content[code[where]] & content[code[where + k]]
        if not ok.any():
            continue
        _, first, tf = np.unique(run[ok], return_index=True, return_counts=True)
        at = np.flatnonzero(ok)[first]
        score = np.round(product[at] / (tf * (1 + total[at])), PLACES)
        names = [code[where[at] + j] if j <= k else np.full(len(at), -1) for j in range(max_words)]
        lines = np.stack([doc[where[at]], np.full(len(at), k), alike[at], *names, tf])
        by = (*lines[::-1][1:max_words + 1], score, lines[2])
        order = np.lexsort(by)
        kept = order[np.append(True, lines[2][order][1:] != lines[2][order][:-1])]
        parts.append((lines[:, kept], score[kept]))
    if not parts:
        return None
    lines, score = np.hstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((*lines[3:3 + max_words][::-1], score, lines[0]))
    lines, score = lines[:, order], score[order]
    new = np.append(True, lines[0][1:] != lines[0][:-1])
    rank = np.arange(len(score)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    lines, score, rank = lines[:, rank <= top], score[rank <= top], rank[rank <= top]
    phrases = [" ".join(words[c] for c in row[:k + 1]) for k, row in zip(lines[1], lines[3:3 + max_words].T)]
    return lines[0], rank, phrases, lines[-1], score


def key_phrases(texts: DataFrame, keys: list[str], *, text: str = "text", max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """``keys, rank, phrase, tf, score``: the ``top`` phrases of up to ``max_words`` words of every text, best (lowest) first.

    A phrase stays within a sentence and begins and ends with a word of three letters or more. Ties go to the
    phrase first in byte order. A null text, or one without such words, has none; ``keys`` must be unique.
    All of a text is in its row, so nothing is shuffled: Spark cuts it into words, tasks count some texts at a time.
    """
    rows = texts.select(*keys, _sentences(text).alias("_w"))
    out = T.StructType([*rows.select(*keys).schema.fields, T.StructField("rank", T.IntegerType()), T.StructField("phrase", T.StringType()),
                        T.StructField("tf", T.LongType()), T.StructField("score", T.DoubleType())])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            lines = lists.flatten()
            n_lines, n_words = np.asarray(lists.value_lengths()), np.asarray(lines.value_lengths())
            line_at = np.append(0, np.cumsum(n_lines))
            word_at = np.append(0, np.cumsum(n_words))
            words = lines.flatten()
            term, caps, title = (words.field(i) for i in range(3))
            flat_caps, flat_title = (np.asarray(c).astype(float) for c in (caps, title))
            ends = word_at[line_at]  # words before each text
            lo = 0
            while lo < b.num_rows:
                hi = max(int(np.searchsorted(ends, ends[lo] + CHUNK_WORDS, side="right")) - 1, lo + 1)
                a, z = int(ends[lo]), int(ends[hi])
                if z > a:
                    own = n_words[line_at[lo]:line_at[hi]]
                    line = np.concatenate([np.arange(n) for n in n_lines[lo:hi]])
                    doc = np.repeat(np.repeat(np.arange(hi - lo), n_lines[lo:hi]), own)
                    found = _best(doc, np.repeat(line, own), term.slice(a, z - a), flat_caps[a:z], flat_title[a:z], max_words, top)
                    if found is not None:
                        at = pa.array(found[0] + lo)
                        yield pa.RecordBatch.from_arrays(
                            [*(b.column(i).take(at) for i in range(len(keys))),
                             *(pa.array(c, kinds.field(len(keys) + i).type) for i, c in enumerate(found[1:]))], schema=kinds)
                lo = hi

    return rows.mapInArrow(run, out)
