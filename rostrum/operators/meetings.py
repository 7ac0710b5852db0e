"""Meeting corpora: token spacing, word ranges, utterance keys, topic trees."""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import ordered_text
from rostrum.functions.times import clock, strip_key
from rostrum.operators.metrics import min_gap_boundaries
from rostrum.plans.ordered import Rows, Step, ordered_fold, ordered_scan, pick

# Word classes glued to their neighbours, and quotes.
NO_LEFT_SPACE = ("CM", ".", "APOSS")
QUOTES = ("LQUOTE", "RQUOTE", "QUOTE")
SENTENCE_END = r"[.!?]$"

KEYS = ["meeting", "speaker"]


def quote_step(rows: Rows) -> str:
    """Open quotes after a block as a function of those before it.

    From ``low`` on every quote mark counts up or down by one, so the block adds ``total``. With fewer,
    all is closed at the first mark that takes the count to 0, and the rest runs from there.
    """
    sums = np.concatenate([[0], np.where(rows["cls"] == "LQUOTE", 1, -1).cumsum()])
    n = len(sums) - 1
    falls = np.full(n + 1, n + 1)  # where the sum next falls below what it is here
    waiting: list[int] = []
    for t in range(n, -1, -1):
        while waiting and sums[waiting[-1]] >= sums[t]:
            waiting.pop()
        falls[t] = waiting[-1] if waiting else n + 1
        waiting.append(t)
    after = np.zeros(n + 1, dtype=np.int64)  # left open at the end, when all is closed before mark t
    for t in range(n - 1, -1, -1):
        if rows["cls"][t] == "RQUOTE":
            after[t] = after[t + 1]
        else:  # opens; a plain quote does so as well, as nothing is open
            u = falls[t + 1]
            after[t] = after[u] if u <= n else 1 + sums[n] - sums[t + 1]
    low = int(-sums.min())
    first = np.flatnonzero(sums < np.minimum.accumulate(np.append(1, sums[:-1])))  # where 0, -1, .. is first reached
    table = zlib.compress(after[first][:low].astype("<i4").tobytes())
    return json.dumps([low, int(sums[n]), base64.b64encode(table).decode()])


def after_quotes(step: str, state: str | None) -> str:
    low, total, table = json.loads(step)
    depth = int(state or 0)
    if depth >= low:
        return str(depth + total)
    return str(int.from_bytes(zlib.decompress(base64.b64decode(table))[4 * depth:4 * depth + 4], "little"))


def classify_words(words: DataFrame) -> DataFrame:
    """Spacing of each word by its class; words that are no text are dropped, keeping ``pos``.

    A hyphen takes no space on either side, commas, stops and apostrophes none on the
    left. A double quote opens or closes by the number of quotes still open before it.
    """
    cls, text = F.col("cls"), F.col("text")
    quote = cls.isin(*QUOTES) & (text != "'")
    apos = (cls.isin(*QUOTES) & (text == "'"))
    kept = words.where(text.isNotNull() & cls.isNotNull() & ~((cls == "SYM") & (text != "-")))
    kinds = [f"{c} {t}" for c, t in words.select(*KEYS, "pos").dtypes]

    def fold(rows: Rows, state: str | None):
        depth, closing = int(state or 0), []
        for c in rows["cls"]:
            shut = c == "RQUOTE" or (c == "QUOTE" and depth > 0)
            closing.append(shut)
            depth = max(depth - 1, 0) if shut else depth + 1
        return {**pick(rows, [*KEYS, "pos"]), "closing": closing}, str(depth)

    marks = kept.where(quote).select(*KEYS, "pos", "cls")
    sides = ordered_fold(marks, KEYS, "pos", fold, ", ".join([*kinds, "closing boolean"]), step=Step(quote_step, after_quotes))
    run = kept.join(sides, [*KEYS, "pos"], "left")
    closing = F.coalesce("closing", F.lit(False))
    opening = quote & ~closing
    hyphen = cls.isin("SYM", "HYPH")
    tight = cls.isin(*NO_LEFT_SPACE) | (cls.isin("W", "TRUNCW") & text.startswith("'"))
    return run.withColumns({
        "lspace": ~(hyphen | tight | apos | closing), "rspace": ~(hyphen | apos | opening)}).drop("closing")


def space_plain_words(words: DataFrame) -> DataFrame:
    """Spacing of words without classes: none to the left of a stop, comma or mark."""
    return words.where(F.coalesce("text", F.lit("")) != "").withColumns(
        {"lspace": ~F.col("text").isin(".", ",", "?", "!"), "rspace": F.lit(True)})


def words_in_ranges(ranges: DataFrame, words: DataFrame) -> DataFrame:
    """Words between two word keys, both included, for each range ``(meeting, speaker, key, start_key, end_key)``.

    Both keys are looked up by equality; the positions between are then joined one by
    one, so a speaker with many words is never scanned per range.
    """
    place = words.select(*KEYS, "word_key", "pos")
    at = lambda k, p: place.withColumnRenamed("word_key", k).withColumnRenamed("pos", p)
    both = ranges.join(at("start_key", "_from"), [*KEYS, "start_key"]).join(at("end_key", "_to"), [*KEYS, "end_key"])
    each = both.where(F.col("_from") <= F.col("_to")).withColumn("pos", F.explode(F.sequence("_from", "_to")))
    return each.drop("_from", "_to").join(words.drop("word_key"), [*KEYS, "pos"]).where(F.col("text").isNotNull())


def join_spaced(rows: DataFrame, keys: list[str], *, long: bool | None = None) -> DataFrame:
    """Text of each group with a space only where both neighbours allow one. ``long`` passes on what is known about the keys."""
    scan = ordered_scan(rows, keys, "pos", long=long, lags={"_r": (F.col("rspace"), False)})
    piece = F.concat(F.when(F.col("_r") & F.col("lspace"), F.lit(" ")).otherwise(F.lit("")), "text")
    return scan.withColumn("_p", piece).groupBy(*keys).agg(
        ordered_text("_p", "", "pos").alias("text"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"))


def split_sentences(rows: DataFrame, keys: list[str], *, long: bool | None = None) -> DataFrame:
    """Number the sentences of each group; one ends with the word that ends in ``. ! ?``."""
    ends = F.col("text").rlike(SENTENCE_END).cast("int")
    scan = ordered_scan(rows.withColumn("_e", ends), keys, "pos", long=long, running={"_n": ("sum", F.col("_e"))})
    return scan.withColumn("sentence", F.col("_n") - F.col("_e")).drop("_n", "_e")


def expand_key_range(href: str | Column) -> Column:
    """``file#id(a.9)..id(a.12)`` to all utterance keys between, thousands written with a comma."""
    col = F.col(href) if isinstance(href, str) else href
    target = F.element_at(F.split(col, "#"), -1)
    ends = F.split(target, r"\.\.(?=id\()")
    first, last = strip_key(ends[0]), strip_key(F.element_at(ends, -1))
    number = lambda k: F.regexp_replace(F.substring_index(k, ".", -1), ",", "").try_cast("long")
    stem = F.regexp_replace(first, r"\.[^.]*$", "")
    keys = F.transform(F.sequence(number(first), number(last)), lambda n: F.concat(stem, F.lit("."), F.format_number(n, 0)))
    return F.when(F.size(ends) > 1, keys).otherwise(F.array(first))


def utterances_of(segments: DataFrame, utterances: DataFrame) -> DataFrame:
    """Utterances named by each segment's key range; keys that do not exist are pruned."""
    keys = segments.select("*", F.posexplode(expand_key_range("href")).alias("ord", "utt_key"))
    return keys.join(utterances, [*KEYS, "utt_key"])


def compose_utterance(*, timed: bool = False) -> Column:
    """Utterance as one line, with clock times and speaker if wanted."""
    if timed:
        at = lambda c: clock(F.round(c, 1), millis=True)
        return F.concat(F.lit("["), at("start"), F.lit("-"), at("end"), F.lit("] Speaker "), F.col("speaker"), F.lit(": "), F.col("text"))
    return F.concat(F.lit("-"), F.col("text"))


def path_order(path: str | Column) -> Column:
    """Sort key of a path such as ``*.0.12``."""
    col = F.col(path) if isinstance(path, str) else path
    return F.transform(F.slice(F.split(col, r"\."), 2, 1 << 20), lambda p: p.cast("int"))


def path_prefix(path: Column, depth: Column) -> Column:
    return F.array_join(F.slice(F.split(path, r"\."), F.lit(1), depth + 1), ".")


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, r"\.")) - 1


def propagate_counts(leaves: DataFrame) -> DataFrame:
    """Utterances and leaves under every node, from leaves ``(lecture_key, path, n_utts)``."""
    depth = path_depth(F.col("path"))
    up = leaves.select("lecture_key", "n_utts", F.explode(F.transform(
        F.sequence(F.lit(0), depth), lambda d: path_prefix(F.col("path"), d))).alias("path"))
    return up.groupBy("lecture_key", "path").agg(F.sum("n_utts").alias("n_utts"), F.count(F.lit(1)).alias("n_leaves"))


def hierarchy_boundaries(leaves: DataFrame, *, min_size: int = 5) -> DataFrame:
    """Boundaries at every level of a topic tree, before and after thinning.

    Level d shows the nodes of depth d and the leaves above. Each shown node but the first
    opens with a boundary; nodes without utterances open none. ``kept`` tells whether the
    boundary survives the minimal distance.
    """
    order = leaves.withColumn("_o", path_order("path")).withColumn("_depth", path_depth(F.col("path")))
    placed = ordered_scan(order, ["lecture_key"], "_o", block=F.floor(F.get("_o", F.lit(0)) / 1024),
                          running={"_upto": ("sum", F.col("n_utts"))}, totals={"_max": ("max", F.col("_depth"))})
    shown = placed.where("n_utts > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.greatest("_max", F.lit(1)))))
    node = path_prefix(F.col("path"), F.least("level", "_depth"))
    opens = shown.groupBy("lecture_key", "level", node.alias("node")).agg(F.min(F.col("_upto") - F.col("n_utts")).alias("i"))
    raw = opens.where("i > 0").select("lecture_key", "level", "i")
    kept = min_gap_boundaries(raw, min_size=min_size, keys=["lecture_key", "level"]).withColumn("_kept", F.lit(True))
    return raw.join(kept, ["lecture_key", "level", "i"], "left").withColumn("kept", F.coalesce("_kept", F.lit(False))).drop("_kept")
