"""Phrase collocations from counts of the longest windows alone.

A window is a word and the words that lead it, up to the longest phrase, filled up with
empty words where its piece of text ends. Only these windows are counted: the counts of
shorter phrases and single words are sums over all windows that begin with them, which
Spark's ROLLUP makes of the counted windows. A phrase scores by its rarest explanation
as two independent parts, in decimals that hold the products exactly.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.llm.common import as_bytes, map_batches, register, stored, table

ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to lower case, marks that end a piece to a line end, tabs to spaces.
LOWERED = bytes((b + 32) if 65 <= b <= 90 else 10 if b in ENDS else 32 if b == 9 else b for b in range(256))
#: A task counts so many words, or different words, before it puts its windows out.
CHUNK_WORDS, CHUNK_VOCABULARY = 2_500_000, 1_000_000
BATCH_ROWS = 100_000
#: A word is frequent from one of so many shares per shuffle partition on.
SHARES = 8
MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000


class Vocabulary(dict):
    """Numbers words as they come: 0 is the end of a piece, 1 nothing."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(text: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Words of a text as numbers, with 0 after every piece."""
    tokens = text.translate(LOWERED).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(vocabulary.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    return np.append(ids[ids != 1], 0)


def counted_windows(ids: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different windows, as one column of numbers per word, and how often each occurs; in order of their numbers."""
    start = np.flatnonzero(ids)
    ids = np.append(ids, np.zeros(width, dtype=np.int64))
    lead = [ids[start]]
    for k in range(1, width):
        lead.append(np.where(lead[-1] == 0, 0, ids[start + k]))
    key, parts = lead[0], []
    for col in lead[1:]:
        size = int(col.max(initial=0)) + 1
        if int(key.max(initial=0)) + 1 > (1 << 62) // size:  # number what there is anew
            seen, key = np.unique(key, return_inverse=True)
            parts.append((seen, size))
        else:
            parts.append((None, size))
        key = key * size + col
    found, n = np.unique(key, return_counts=True)
    cols = []
    for seen, size in reversed(parts):
        found, col = np.divmod(found, size)
        cols.append(col)
        found = found if seen is None else seen[found]
    return [found, *reversed(cols)], n


class Chunks:
    """Numbered words of the texts read so far, by language."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """``lang, words by number, numbers`` of one chunk after the other; a text lies in one chunk."""
        vocabulary, held, size = Vocabulary(), {}, 0
        for b in self.batches:
            for lang, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                ids = numbered(text, vocabulary)
                held.setdefault(lang, []).append(ids)
                size += len(ids)
                if size > CHUNK_WORDS or len(vocabulary) > CHUNK_VOCABULARY:
                    yield from self.taken(vocabulary, held)
                    vocabulary, held, size = Vocabulary(), {}, 0
        yield from self.taken(vocabulary, held)

    @staticmethod
    def taken(vocabulary: Vocabulary, held: dict[str, list[np.ndarray]]):
        words = list(vocabulary)
        words[0] = b""
        while held:
            lang, parts = held.popitem()
            yield lang, words, np.concatenate(parts)


def frequent_words(docs: DataFrame, shares: int) -> dict[str, set[bytes]]:
    """Per language the words that make up one of ``shares`` equal shares of all words, and at most as many again.

    A chunk names words with half such a share of it, so a word with a whole share of everything is
    named with at least half of its occurrences; at most ``2 * shares`` words can reach that.
    """

    def run(batches):
        for lang, words, ids in Chunks(batches):
            n = np.bincount(ids, minlength=len(words))
            n[0] = 0
            some = np.flatnonzero(n * 2 * shares >= max(n.sum(), 1))
            yield [lang] * (len(some) + 1), [words[i] for i in some] + [None], [*n[some].tolist(), int(n.sum())]

    named = map_batches(docs, run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    named = stored(named)
    total = named.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    out: dict[str, set[bytes]] = {}
    for r in named.where(F.col("word").isNotNull() & (F.col("n") * 2 * shares >= total)).collect():
        out.setdefault(r.lang, set()).add(bytes(r.word))
    return out


def placed(cols: list[np.ndarray], words: list[bytes], often: set[bytes], partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Salt of every window, and whether all windows with its words but the last get the same.

    A window whose first word is not frequent has salt 0. Any other is salted by its words up to the
    first that is not frequent: windows that agree so far are less than one share.
    """
    salt = np.zeros(len(cols[0]), dtype=np.int64)
    if not often:
        return salt, np.ones(len(salt), dtype=bool)
    hot = np.array([w in often for w in words])
    crc = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    within = first = hot[cols[0]]
    parted = ~within
    for k, col in enumerate(cols[1:], 2):
        salt = np.where(within, (salt * 31 + crc[col]) % (1 << 31), salt)
        within = within & hot[col]
        if k < len(cols):
            parted |= ~within
    return np.where(first, 1 + salt % partitions, 0), parted


def window_counts(docs: DataFrame, width: int, min_count: int) -> DataFrame:
    """``lang, words, longest, n``: phrases of ``width`` words that occur ``min_count`` times, and all windows summed by
    their words but the last.

    Padded windows are counted in chunks; those of a chunk that begin with one word travel as one row.
    A frequent first word is spread by what follows it. Where all windows with the same words but the last
    meet (``whole``) and are too few for a phrase, the sums leave out one word more.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_words(docs, SHARES * partitions)

    def run(batches):
        for lang, words, ids in Chunks(batches):
            cols, n = counted_windows(ids, width)
            salt, whole = placed(cols, words, frequent.get(lang, set()), partitions)
            group = (cols[0] * (partitions + 1) + salt) * 2 + whole
            if frequent:
                order = np.argsort(group, kind="stable")
                cols, n, salt, whole, group = [c[order] for c in cols], n[order], salt[order], whole[order], group[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            text = pa.array(words, pa.binary()).cast(pa.string())
            ends = np.append(starts[1:], len(group))
            a = 0
            while a < len(starts):  # some BATCH_ROWS windows at a time
                z = max(a + 1, int(np.searchsorted(ends, starts[a] + BATCH_ROWS)))
                cut = slice(starts[a], ends[z - 1])
                rest = pc.binary_join_element_wise(*[text.take(pa.array(c[cut])) for c in cols[1:]],
                                                   pa.array(n[cut]).cast(pa.string()), " ")
                offsets = pa.array(np.append(starts[a:z], ends[z - 1]) - starts[a], pa.int32())
                blocks = pc.binary_join(pa.ListArray.from_arrays(offsets, rest), "\n")
                first = starts[a:z]
                yield [pa.array([lang] * len(first), pa.string()), text.take(pa.array(cols[0][first])),
                       pa.array(salt[first], pa.int32()), pa.array(whole[first]), blocks]
                a = z

    blocks = map_batches(docs, run, "lang string, w0 string, salt int, whole boolean, block string")
    keys = ["lang", "w0", "salt", "whole"]
    blocks = blocks.repartition(partitions, "lang", "w0", "salt").sortWithinPartitions(*keys)

    def merged(batches):
        out = Columns(4)
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        for (lang, w0, _, whole), same in itertools.groupby(rows, key=lambda r: r[:4]):
            counts: dict[str, int] = {}
            for r in same:
                for line in r[4].split("\n"):
                    rest, _, n = line.rpartition(" ")
                    counts[rest] = counts.get(rest, 0) + int(n)
            heads: dict[str, int] = {}
            for rest, n in counts.items():
                head, _, last = rest.rpartition(" ")
                heads[head] = heads.get(head, 0) + n
                if n >= min_count and last:
                    out.add(lang, f"{w0} {rest}", True, n)
            short: dict[str, int] = {}  # sums of the heads that are too rare for a phrase, without their last word
            for head, n in heads.items():
                if whole and n < min_count and width > 2:
                    head = head.rpartition(" ")[0]
                    short[head] = short.get(head, 0) + n
                else:
                    out.add(lang, f"{w0} {head}" if width > 2 else w0, False, n)
            for head, n in short.items():
                out.add(lang, f"{w0} {head} " if width > 3 else f"{w0} ", False, n)
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(blocks, merged, "lang string, words string, longest boolean, n long")


class Columns:
    """Rows on their way to the next batch."""

    def __init__(self, width: int):
        self.cols = [[] for _ in range(width)]

    def add(self, *row) -> None:
        for c, v in zip(self.cols, row):
            c.append(v)

    def full(self) -> bool:
        return len(self.cols[0]) >= BATCH_ROWS

    def take(self) -> list[list]:
        out, self.cols = self.cols, [[] for _ in self.cols]
        return out


def phrase_counts(docs: DataFrame, width: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, size, phrase, f`` of phrases up to ``width`` words that occur ``min_count`` times; size 0 counts all words."""
    counted = stored(window_counts(docs, width, min_count))
    longest = counted.where("longest").select("lang", F.lit(width).alias("size"), F.col("words").alias("phrase"), "n")
    names = [f"w{i}" for i in range(width - 1)]
    heads = counted.where("NOT longest").select("lang", "n", *[
        F.split_part("words", F.lit(" "), F.lit(i + 1)).alias(c) for i, c in enumerate(names)])
    sums = heads.rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).where("lang IS NOT NULL")
    size = (F.lit(width - 1) - F.bit_count("g")).cast("int")
    words = F.array(*[F.coalesce(c, F.lit("")) for c in names])
    # A padded or shortened prefix ends with an empty word: it is no phrase of its size.
    sums = sums.withColumn("size", size).where((F.col("size") == 0) | (F.element_at(words, F.greatest("size", F.lit(1))) != ""))
    sums = sums.select("lang", "size", F.concat_ws(" ", *names).alias("phrase"), "n")
    return longest.unionByName(sums).where((F.col("n") >= min_count) | (F.col("size") == 0)).withColumnRenamed("n", "f")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", width: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, min_share: int = 50, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 to ``width`` words of every language: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate occurs ``min_count`` times; it goes where a longer one around it has ``min_share``
    percent of its occurrences. A null language is ``und``, a null text empty; a text without words
    and an empty table give nothing. Repeated rows count as often as they occur, ties go to the
    phrase first in byte order. Only the two named columns are read.
    """
    source = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = stored(phrase_counts(source, width, min_count))
    phrases = counts.where("size > 0")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    k = F.col("k")
    cuts = candidates.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "size", "a", "k", part(F.lit(1), k).alias("first"), part(k + 1, F.col("size") - k).alias("rest"))
    of = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # 20 digits hold any count; a is at most l and r, so the quotient stays within 1000000.
    exact = F.expr("(1000000BD * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div "
                   "(CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))")
    scored = cuts.withColumn("score", exact.cast("long")).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("len"))
    inner = inner.select("lang", "a", "w", "len", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)).alias("at"))
    around = inner.groupBy("lang", part(F.col("at"), F.col("len")).alias("phrase")).agg(F.max("a").alias("longer"))
    alone = scored.join(around, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {min_share} * a"))
    # Ranked in shares of a language first, so that neither step gathers more than the root of the tasks' lists.
    shares = math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.where(F.col("rank") <= top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, unnest([w[i:i], w[i:i+1], w[i:i+2]]) AS g, unnest([1, 2, 3]) AS size, len(w) - i + 1 AS room FROM starts),
f AS (SELECT lang, size, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM grams WHERE size <= room GROUP BY ALL),
cand AS (SELECT lang, size, phrase, g, f AS a FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, a, k, array_to_string(g[:k], ' ') AS head, array_to_string(g[k+1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS phrase, a FROM cand WHERE size = 3),
most AS (SELECT lang, phrase, max(a) AS longer FROM around GROUP BY ALL),
kept AS (SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""


@register("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words per language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))
