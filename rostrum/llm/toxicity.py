"""Toxicity from a weighted lexicon that is learned from labels and matched by Aho-Corasick.

Texts are folded first: compatibility forms, accents, homoglyphs, digit substitutions,
zero-width marks, repeated and spaced-out letters. The lexicon holds whole words and
word beginnings that labelled toxic documents hold far more often than clean ones; its
weights are log odds. The weight found is divided by length; hits inside an exception
phrase do not count. The scale is set so that 0.3 is the best threshold on training rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import add_columns, as_text, map_batches, register, stored, table

# Look-alike letters and digits, and what they are read as. l and 1 are read as i, so either reading meets.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "i", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k",
    "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "l": "i",
}
# Phrases that hold a lexicon word in a harmless sense.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser board", "class clown award")

INVISIBLE = [*range(0x0300, 0x0370), 0x00AD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF]
FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | dict.fromkeys(INVISIBLE)
PREFIXES = range(4, 9)
MAX_TOXIC, MAX_CLEAN = 20_000, 60_000
MAX_ROUNDS = 12
SMOOTH_WORDS = 20
#: Terms that a task adds up before it puts them out.
HELD_TERMS = 100_000
THRESHOLD = 0.3


def folded(text: str) -> str:
    """Folded words, parted by one space, with a space at both ends."""
    t = unicodedata.normalize("NFKD", text).lower().translate(FOLD)
    if "!" in t or "|" in t:
        t = re.sub(r"(?<=\w)[!|](?=\w)", "i", t)
    t = re.sub(r"(.)\1+", r"\1", re.sub(r"[\W_]+", " ", t))
    t = re.sub(r"(?<!\S)(?:\w ){3,}\w(?!\S)", lambda m: m[0].replace(" ", ""), t)
    return f" {t.strip()} "


def terms(text: str) -> set[str]:
    """Whole words as `` word ``, and word beginnings as `` begi``."""
    words = set(folded(text).split())
    out = {f" {w} " for w in words if len(w) > 1}
    for w in words:
        out.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return out


def term_counts(df: DataFrame, among: set[str] | None = None, explained: frozenset[str] = frozenset()) -> DataFrame:
    """Documents per term, over those without a term in ``explained``; each task adds up before the shuffle
    and empties its table when it is large."""

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for t in as_text(b.column(0)):
                own = terms(t)
                if explained.isdisjoint(own):
                    held.update(own if among is None else own & among)
                if len(held) > HELD_TERMS:
                    yield list(held), list(held.values())
                    held = Counter()
        yield list(held), list(held.values())

    return map_batches(df.select("_text"), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, stands_for: float = 1.0) -> dict[str, float]:
    """Weights of the terms that tell toxic from clean beyond doubt, each family by its best member.

    A clean row of the sample stands for ``stands_for`` times as many labelled rows as a toxic one.
    """
    weight, gains = {}, {}
    for t, p in pos.items():
        n = neg.get(t, 0)
        rate = (p + n) / (n_pos + n_neg)
        gain = 2 * (p * math.log(p / n_pos / rate) + (n * math.log(n / n_neg / rate) if n else 0.0))
        if p * n_neg >= 8 * n * n_pos and p >= 1.5 * n * stands_for and gain >= 20:
            gains[t] = gain
            weight[t] = min(8.0, math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1)))

    longer: dict[str, list[str]] = {}
    for t in weight:
        word = t.rstrip()
        for k in PREFIXES:
            if k + 1 <= len(word) and (short := word[:k + 1]) != t:
                longer.setdefault(short, []).append(t)
    chosen = {}
    most = max((pos[t] for t in weight), default=0)
    for t in weight:
        if 2 * pos[t] < most:  # rarer ones wait for a later round, when these no longer explain their documents
            continue
        while heirs := [h for h in longer.get(t, ()) if pos[h] >= 0.95 * pos[t] or gains[h] > gains[t]]:
            t = max(heirs, key=lambda h: (gains[h], len(h), h))
        chosen[t] = weight[t]
    stems = {t for t in chosen if not t.endswith(" ")}
    return {t: w for t, w in chosen.items()
            if not any((s := t[:k + 1]) != t and s in stems for k in PREFIXES if k + 1 <= len(t.rstrip()))}


class Scorer:
    """Weight found per word."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for t, w in weights.items():
            self.automaton.add_word(t, (len(t), w))
        for p in exceptions:
            phrase = folded(p)
            self.automaton.add_word(phrase, (len(phrase), None))
        self.ready = bool(len(self.automaton))
        if self.ready:
            self.automaton.make_automaton()

    def density(self, text: str) -> float:
        t = folded(text)
        if not self.ready:
            return 0.0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(t):
            start = end - size + 1
            if w is None:
                excused.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), w)
        found = sum(w for s, w in best.items() if not any(a <= s < b for a, b in excused))
        return found / (t.count(" ") - 1 + SMOOTH_WORDS) if found else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """Texts and labels of a bounded sample: at most MAX_TOXIC and MAX_CLEAN rows, the first by a hash of the id.

    And how many times as many labelled rows a clean one of them stands for as a toxic one.
    """
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
             .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = (known.where("_toxic = 1").orderBy(*by_hash).limit(MAX_TOXIC)
              .unionByName(known.where("_toxic <> 1").orderBy(*by_hash).limit(MAX_CLEAN)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(sample), "doc_id")  # sized by the two limits
    sizes = dict(known.groupBy((F.col("_toxic") == 1).alias("t")).count().collect())
    toxic, clean = max(sizes.get(True, 0), 1), max(sizes.get(False, 0), 1)
    stands_for = clean / min(clean, MAX_CLEAN) / (toxic / min(toxic, MAX_TOXIC))
    return stored(rows.select("_text", "_toxic", F.xxhash64("_text").alias("_same")).dropDuplicates(["_same", "_toxic"])), stands_for


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[dict[str, float], float]:
    """The lexicon, and the density that scores 0.3. Without toxic labels both are empty and all scores 0."""
    rows, stands_for = training_rows(docs, labels, id_col, text_col)
    toxic, clean = rows.where("_toxic = 1"), rows.where("_toxic <> 1")
    sizes = dict(rows.groupBy((F.col("_toxic") == 1).alias("t")).count().collect())
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos:
        return {}, 1.0
    # Terms in 1 of 500 toxic documents or more: a text of n words has under 6 n terms, so 3000 times the mean length bounds them.
    pos = dict(term_counts(toxic).where(F.col("n") >= max(3, n_pos // 500)).collect())
    neg = dict(term_counts(clean, set(pos)).collect())
    weights: dict[str, float] = {}
    for _ in range(MAX_ROUNDS):
        if not (more := choose(pos, neg, n_pos, max(n_neg, 1), stands_for)):
            break
        weights |= more
        # Near copies repeat all their words; only documents that nothing explains yet speak for further terms.
        pos = dict(term_counts(toxic, set(neg) | set(pos), frozenset(weights)).where("n >= 3").collect())

    def bins(batches, scorer=[]):  # noqa: B006, one automaton a worker on purpose
        if not scorer:
            scorer.append(Scorer(weights, exceptions))
        for b in batches:
            at = [scorer[0].density(t) for t in as_text(b.column(0))]
            yield [math.floor(4 * math.log2(d)) if d else -100 for d in at], [x == 1 for x in b.column(1).to_pylist()]

    table_of = map_batches(rows, bins, "bin int, toxic boolean").groupBy("bin").agg(
        F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).orderBy(F.desc("bin")).collect()
    hit, wrong, scores = 0, 0, []
    for i, (b, t, c) in enumerate(table_of):
        hit, wrong = hit + t, wrong + c * stands_for
        if b > -100:
            below = table_of[i + 1][0] + 1 if i + 1 < len(table_of) and table_of[i + 1][0] > -100 else min(b, -40)
            scores.append((2 * hit / (n_pos + hit + wrong), 2 ** ((b + max(below, -40)) / 8)))
    best = max(scores, default=(0.0, 1.0))
    return weights, best[1]


def score_toxicity(docs: DataFrame, weights: dict[str, float], scale: float, text_col: str = "text",
                   keep: list[str] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on).

    Null and empty texts score 0. Rows are scored alone, so repeated rows agree; columns
    with the names of results are replaced.
    """
    half = scale * (1 - THRESHOLD) / THRESHOLD

    def run(text, scorer=[]):  # noqa: B006, one automaton a worker on purpose
        if not scorer:
            scorer.append(Scorer(weights, exceptions))
        return [[d / (d + half) for d in map(scorer[0].density, as_text(text))]]

    scored = add_columns(docs, [text_col], run, "score double", keep=keep)
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the lexicon of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    weights, scale = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score_toxicity(docs, weights, scale, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")
