"""Quality rules over repetition found by suffix arrays of words.

The suffix array of a text comes from prefix doubling in numpy; the ranks of each
doubling round give the longest common prefixes of neighbouring suffixes. A maximal
repeated passage starts where the longest repeat of a suffix is not the tail of a longer
one before it. Rules limit the share of characters under such passages and the longest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import add_columns, as_bytes, register, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Odd multipliers of a 64-bit hash of five word numbers (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "covered_share double, longest_repeat long, repeat_spans array<int>")


def word_numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step)[:n] > 0


def repeated_windows(ids: np.ndarray) -> np.ndarray:
    """Starts of windows of five words that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.empty(0, dtype=np.int64)
    u = ids.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * MIX[k] + u[k:k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return np.flatnonzero(counts[inverse] > 1)


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For every suffix, how many of its first words occur elsewhere too."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    levels, half = [rank], 1
    order = np.argsort(rank, kind="stable")
    while half < n and rank.max() < n - 1:
        after = np.full(n, -1, dtype=np.int64)
        after[:n - half] = rank[half:]
        key = rank.astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        levels.append(rank)
        half *= 2
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, n - 1), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + common + (1 << k) <= n
        same = np.zeros(len(common), dtype=bool)
        i, j = a[inside] + common[inside], b[inside] + common[inside]
        same[inside] = levels[k][i] == levels[k][j]
        common[same] += 1 << k
    best = np.zeros(n, dtype=np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def maximal_spans(ids: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    best = longest_repeats(ids)
    before = np.concatenate(([0], best[:-1]))
    starts = np.flatnonzero((best >= min_words) & (before != best + 1))
    return starts, starts + best[starts]


def measure(text: bytes, min_words: int) -> tuple:
    words = text.split()
    raw = np.frombuffer(text, dtype=np.uint8)
    spaces = int(np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13))))
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80)) - spaces
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids = word_numbers(words)
    at = repeated_windows(ids)
    n, share, longest, spans = len(words), 0.0, 0, []
    repeats = 0
    if len(at):
        repeats = int(np.count_nonzero(cover(at, at + WINDOW, n)))
    # A repeat of five words or more holds a repeated window, so without one such repeats need no suffix array.
    if n > 1 and (len(at) or min_words < WINDOW):
        starts, ends = maximal_spans(ids, min_words)
        if len(starts):
            under = cover(starts, ends, n)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
            share = float(sizes[under].sum() / sizes.sum())
            longest = int((ends - starts).max())
            edges = np.flatnonzero(np.diff(np.concatenate(([0], under.astype(np.int8), [0]))))
            spans = edges.tolist()
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, share, longest, spans


def judge_repetition(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_words: int = 10,
                     max_covered: float = 0.2, max_longest: int = 200) -> DataFrame:
    """Append the counts, ``covered_share`` (bytes of words under maximal repeats of at least
    ``min_words`` words), ``longest_repeat``, ``repeat_spans`` (their union, word offsets),
    ``base_failed`` and ``kept``.

    ``min_words`` is 1 or more. Null and empty texts have no words and fail the base rule. Rows are judged one by
    one, so ties and repeated rows need no rule; columns with the names of results are replaced.
    """

    if min_words < 1:
        raise ValueError("min_words must be 1 or more")

    def run(text):
        return list(zip(*(measure(t, min_words) for t in as_bytes(text)))) or [[]] * 8

    df = add_columns(docs, [text_col], run, RESULT, keep=keep)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return df.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("covered_share") <= max_covered) & (F.col("longest_repeat") <= max_longest))


@register("op10_repetition")
def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and the verdict on repetition for every document."""
    return judge_repetition(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("repeat_spans")
