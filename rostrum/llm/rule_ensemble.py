"""Quality classifier from a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled documents. Every path from a root to a node is a rule,
a conjunction of bounds on statistics. A lasso logistic regression over the rules gives
most of them no weight; the others are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import add_columns, as_bytes, register, stored, table

#: Labelled rows to train on, at most: the first by a hash of the id, so that both labels keep their shares.
MAX_ROWS = 60_000
TREES, DEPTH, SEED = 24, 3, 17
#: Strengths of the lasso to choose from, by the log loss on a fifth of the texts that fitting does not see.
STRENGTHS = (0.03, 0.01, 0.003, 0.001)
MIN_SUPPORT = 0.002
THRESHOLD = 0.5

UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
SYMBOLS, MARKS, SPACES = b"#$%&*|<>{}[]\\/=~^_@+`", b".,;:!?'\"()-", b" \t\n\x0b\x0c\r"
STATISTICS = (
    "n_words", "n_points", "mean_word", "longest_word", "upper_share", "digit_share", "symbol_share", "mark_share", "space_share",
    "other_share", "distinct_share", "top_word_share", "stutter_share", "bare_share", "repeat_share", "n_lines", "line_words",
    "repeated_line_share", "words_per_mark",
)


def statistics(text: bytes, points: int) -> tuple[float, ...]:
    """What the rules look at, from a whole text; all 0 for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = len(text)

    def count(of: bytes) -> int:
        return size - len(text.translate(None, of))

    upper, lower, digits, symbols, marks, spaces = map(count, (UPPER, LOWER, DIGITS, SYMBOLS, MARKS, SPACES))
    seen = Counter(words)
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    letters_only = text.translate(None, SYMBOLS + MARKS + DIGITS).split()
    triples = set(zip(words, words[1:], words[2:]))
    lines = [s for s in text.split(b"\n") if s.strip()]
    return (
        float(n), float(points), (size - spaces) / n, float(max(map(len, seen))), upper / max(upper + lower, 1), digits / size,
        symbols / size, marks / size, spaces / size, (size - upper - lower - digits - symbols - marks - spaces) / size,
        len(seen) / n, max(seen.values()) / n, stutter / n, 1 - len(letters_only) / n,
        1 - len(triples) / max(n - 2, 1) if n > 2 else 0.0, float(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
        n / (1 + marks),
    )


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Append the statistics as columns ``s0``, ``s1`` ..; null is empty."""

    def run(text: pa.Array):
        points = pc.fill_null(pc.utf8_length(text), 0).to_pylist()
        rows = [statistics(t, p) for t, p in zip(as_bytes(text), points)]
        return list(zip(*rows)) if rows else [[] for _ in STATISTICS]

    return add_columns(docs, [text_col], run, ", ".join(f"s{i} double" for i in range(len(STATISTICS))), keep=keep)


@dataclass(frozen=True)
class Rule:
    """Bounds ``(statistic, "<=" or ">", value)`` that must all hold, and the weight if they do."""

    bounds: tuple[tuple[int, str, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for i, side, value in self.bounds:
            out = out & (F.col(f"s{i}") <= value if side == "<=" else F.col(f"s{i}") > value)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{STATISTICS[i]} {side} {value:g}" for i, side, value in self.bounds)


def merged(bounds: list[tuple[int, str, float]]) -> tuple[tuple[int, str, float], ...]:
    """One bound per statistic and side: the tightest."""
    best: dict[tuple[int, str], float] = {}
    for i, side, value in bounds:
        best[i, side] = (min if side == "<=" else max)(best.get((i, side), value), value)
    return tuple((i, side, v) for (i, side), v in sorted(best.items()))


def tree_rules(description: str) -> list[tuple[tuple[int, str, float], ...]]:
    """Paths to all nodes of a tree, read from Spark's description of it."""
    path: list[tuple[int, str, float]] = []
    out, margin = [], None
    for line in description.splitlines():
        if found := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            margin = len(found[1]) if margin is None else margin
            del path[len(found[1]) - margin:]
            path.append((int(found[2]), found[3], float(found[4])))
            out.append(merged(path))
    return out


@dataclass(frozen=True)
class Ensemble:
    """Score = logistic function of ``intercept`` plus the weights of the rules that hold."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Statistics and labels of a bounded sample of the rows that are not held out."""
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
             .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(sample), "doc_id").select(  # sized by the limit
        "_text", (F.col("_quality") == 1).cast("double").alias("label"),
        F.pmod(F.xxhash64("_text", F.lit("fold")), F.lit(5)).alias("fold"), F.xxhash64("_text").alias("same"))
    return stored(with_statistics(rows.dropDuplicates(["same", "label"]), "_text", ["label", "fold"]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """The weighted rules. Labels of one kind only give their own score, no labels at all one half."""
    rows = training_rows(docs, labels, id_col, text_col)
    sizes = dict(rows.groupBy("label").count().collect())
    good, bad = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not good or not bad:
        return Ensemble((), 0.0 if good == bad else math.copysign(4.0, good - bad))
    names = [F.col(f"s{i}") for i in range(len(STATISTICS))]
    at = rows.select("label", "fold", *names, array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=3)
    found = dict.fromkeys(p for t in forest.fit(at).trees for p in tree_rules(t.toDebugString))
    # Sides of one cut say the same; the first is enough.
    rules = [Rule(p) for p in found if not (len(p) == 1 and p[0][1] == ">" and (((p[0][0], "<=", p[0][2]),) in found))]
    holds = stored(at.select("label", "fold", F.array(*[r.column().cast("double") for r in rules]).alias("r")))
    support = holds.select(F.posexplode("r").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect()
    kept = sorted(r.i for r in support if MIN_SUPPORT <= r.v <= 1 - MIN_SUPPORT)
    if not kept:
        return Ensemble((), math.log(good / bad))
    rules = [rules[i] for i in kept]
    matrix = holds.select("label", "fold", array_to_vector(F.array(*[F.col("r")[i] for i in kept])).alias("features")).cache()
    try:
        best = min(STRENGTHS, key=lambda s: log_loss(lasso(s).fit(matrix.where("fold <> 0")), matrix.where("fold = 0"))) \
            if enough(matrix) else STRENGTHS[1]
        model = lasso(best).fit(matrix)
    finally:
        matrix.unpersist()
    return Ensemble(tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w), float(model.intercept))


def lasso(strength: float) -> LogisticRegression:
    return LogisticRegression(elasticNetParam=1.0, regParam=strength, maxIter=60, standardization=False)


def enough(rows: DataFrame) -> bool:
    """Both labels on both sides of the fold."""
    seen = rows.groupBy((F.col("fold") == 0).alias("f"), "label").count().count()
    return seen == 4


def log_loss(model, rows: DataFrame) -> float:
    p = F.greatest(F.lit(1e-9), vector_to_array("probability")[F.col("label").cast("int")])
    return model.transform(rows).agg(F.avg(-F.log(p))).first()[0]


def score_quality(docs: DataFrame, model: Ensemble, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null text is empty; a text without words has statistics 0 and the score that the rules
    give these. Rows are scored alone, so repeated rows agree. Columns of the names of results
    are replaced; all other columns keep their names.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    rows = with_statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("_text")),
                           "_text", ["row"])
    scored = rows.select("row", model.score().alias("score"))
    return scored.select("row.*", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


@register("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by rules from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score_quality(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
