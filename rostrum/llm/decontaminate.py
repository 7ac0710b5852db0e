"""Benchmark decontamination by Wu-Manber search for many strings of words.

Test strings are the windows of 13 words of every benchmark item (an item of fewer words
is one string). Strings of one length share a matcher: a table of shifts by pairs of
words skips positions where no string can end, buckets by the last pair pick the strings
to test, and a direct comparison confirms. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import WORD_BYTES, add_columns, as_bytes, register, table

WINDOW = 13
#: Benchmark windows per broadcast; larger benchmarks are searched in as many blocks as they need.
BLOCK_WINDOWS = 500_000


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Matcher:
    """Wu-Manber tables over strings that all have ``m`` words."""

    def __init__(self, strings: dict[tuple, list[str]]):
        self.m = m = len(next(iter(strings)))
        self.width = width = min(2, m)
        self.longest_shift = m - width + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for s, owners in strings.items():
            for end in range(width, m + 1):
                block = s[end - width:end]
                self.shift[block] = min(self.shift.get(block, self.longest_shift), m - end)
            self.bucket.setdefault(s[m - width:], {}).setdefault(s[0], []).append((list(s), owners))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start of every occurrence, with the items that own the string."""
        m, width, longest, shift, bucket = self.m, self.width, self.longest_shift, self.shift, self.bucket
        i, n = m, len(words)
        while i <= n:
            block = tuple(words[i - width:i])
            step = shift.get(block, longest)
            if step:
                i += step
                continue
            for s, owners in bucket[block].get(words[i - m], ()):
                if s == words[i - m:i]:
                    yield i - m, owners
            i += 1


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[dict[tuple, list[str]]]]:
    """Strings of consecutive blocks of items, by length; the driver holds one block at a time while reading."""
    by_length: dict[int, dict[tuple, list[str]]] = {}
    held = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        words = tuple(split_words((text or "").encode()))
        m = min(WINDOW, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(words[i:i + m], [])
            if (item or "") not in owners[-1:]:
                owners.append(item or "")
            held += 1
        if held >= BLOCK_WINDOWS:
            yield list(by_length.values())
            by_length, held = {}, 0
    yield list(by_length.values())


def merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Union of spans as a flat list start, end, start, end ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None, max_share: int = 20) -> DataFrame:
    """Append ``n_words, n_hit, n_items, items_sha256, contaminated`` and ``hit_spans`` (word offsets).

    A document is contaminated when at least one of ``max_share`` words is hit. Null or
    empty texts have no words and are clean; an empty benchmark leaves all clean. A null
    item id counts as the empty id. Repeated rows are each judged; columns with the names
    of results are replaced.
    """
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    df = docs.select(*dict.fromkeys([*names, text_col])).withColumns(
        {"_wm_spans": F.array().cast("array<int>"), "_wm_items": F.array().cast("array<string>"), "_wm_n": F.lit(0)})
    for part in blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(part)

        def search(text, spans, items, _n, sent=sent, matchers: list = []):  # noqa: B006, one list a worker on purpose
            if not matchers:
                matchers += map(Matcher, sent.value)
            out: tuple[list, list, list] = ([], [], [])
            for t, old, owned in zip(as_bytes(text), spans.to_pylist(), items.to_pylist()):
                words = split_words(t)
                found, owners = list(zip(old[::2], old[1::2])), set(owned)
                for matcher in matchers:
                    for start, own in matcher.find(words):
                        found.append((start, start + matcher.m))
                        owners.update(own)
                for o, v in zip(out, (merged(found), list(owners), len(words))):
                    o.append(v)
            return out

        df = add_columns(df, [text_col, "_wm_spans", "_wm_items", "_wm_n"], search,
                         "_wm_spans array<int>, _wm_items array<string>, _wm_n int",
                         keep=list(dict.fromkeys([*names, text_col])))
    hit = F.aggregate("_wm_spans", F.lit(0).cast("long"), lambda s, x: x.cast("long") - s)  # ends minus starts
    result = {
        "n_words": F.col("_wm_n").cast("long"),
        "n_hit": hit,
        "n_items": F.size("_wm_items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", F.array_sort("_wm_items")), 256),
        "contaminated": (hit > 0) & (hit * max_share >= F.col("_wm_n")),
        "hit_spans": F.col("_wm_spans"),
    }
    return df.select(*[c for c in names if c.lower() not in result], *[v.alias(k) for k, v in result.items()])


SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
strings AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM strings),
dwin AS (
  SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, lengths WHERE len(w) >= m)),
hits AS (SELECT doc_id, p, dwin.m, item_id FROM dwin JOIN strings USING (m, s)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("hit_spans")
