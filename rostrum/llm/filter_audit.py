"""Audit of quality filters that overlap: what each removes in every order of application.

Equal texts are found with radix tries. Every task inserts the texts that it reads into a
compressed trie whose terminals hold the smallest id; copies that meet there are settled
at once. What is left, one text a task at most, is dealt to ranges of texts and merged in
one trie a range. The bounds of the ranges are prefixes taken from the tries of the first
step, as long as it takes to part the texts on either side, so that many texts with one
beginning are still spread. Flags become masks, and masks are all that is counted.
"""

from __future__ import annotations

import bisect
import itertools
import json
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import as_bytes, map_batches, register, stored, table

LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

#: A task empties its trie beyond so many bytes of text.
HELD_BYTES = 64 << 20
#: A trie puts out a possible bound after so many bytes of different text; a range holds CUTS_A_RANGE of them.
CUT_BYTES, CUTS_A_RANGE = 1 << 20, 16
#: The driver sorts at most so many bounds of at most so many bytes; beyond that ranges grow, and nothing else changes.
MAX_CUTS, CUT_WIDTH = 400_000, 512
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20

ROW = "doc_id long, part string, mask int, n long"


class Node:
    __slots__ = ("label", "kids", "end")

    def __init__(self, label: bytes):
        self.label, self.kids, self.end = label, {}, None


class Trie:
    """Compressed trie over bytes. ``end`` of a node is what is held for the text that ends there."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def node(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if missing."""
        node, p = self.root, 0
        while p < len(text):
            kid = node.kids.get(text[p])
            if kid is None:
                node.kids[text[p]] = new = Node(text[p:])
                self.held += len(new.label) + 200
                return new
            if not text.startswith(kid.label, p):
                k = common_length(kid.label, text, p)
                upper = Node(kid.label[:k])
                kid.label = kid.label[k:]
                upper.kids[kid.label[0]] = kid
                node.kids[text[p]] = kid = upper
                self.held += 200
            node, p = kid, p + len(kid.label)
        return node

    def walk(self) -> Iterator[tuple[bytes, Node, bytes]]:
        """Texts in byte order, each with its node and the shortest prefix that no earlier text begins with."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.end is not None:
                yield text, node, before + node.label[:1]
            stack.extend((node.kids[b], text) for b in sorted(node.kids, reverse=True))


def common_length(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` stand in ``text`` from ``at`` on, if not all do."""
    low, high = 0, len(label)
    while low + 1 < high:
        mid = (low + high) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


def insert(trie: Trie, text: bytes, doc: int, part: str, mask: int, n: int) -> list[tuple]:
    """Note ``n`` rows at the end of their text; rows now known to have a smaller id beside them come back."""
    node = trie.node(text)
    if node.end is None:
        node.end = (doc, mask, Counter({part: n}))
        return []
    least, mask, rows = node.end
    if doc == least:
        rows[part] += n
        return []
    if doc > least:
        return [(doc, part, mask | DUPLICATE, n)]
    node.end = (doc, mask, Counter({part: n}))
    return [(least, p, mask | DUPLICATE, k) for p, k in rows.items()]


def own_failures(text: bytes, points: int) -> int:
    """Bits of the filters that look at one text alone."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


class Rows:
    """Columns under way to the next batch."""

    def __init__(self, width: int):
        self.width, self.size = width, 0
        self.cols = [[] for _ in range(width)]

    def add(self, *row) -> None:
        for c, v in zip(self.cols, row):
            c.append(v)
        self.size += sum(len(v) for v in row if isinstance(v, bytes))

    def full(self) -> bool:
        return len(self.cols[0]) >= BATCH_ROWS or self.size >= BATCH_BYTES

    def take(self) -> list[list]:
        out, self.cols, self.size = self.cols, [[] for _ in range(self.width)], 0
        return out


def first_step(batches: Iterator[pa.RecordBatch]):
    """Settled rows without a text; the others with it, in byte order, with possible bounds."""
    out, trie = Rows(6), Trie()

    def emptied():
        since = 0
        for text, node, prefix in trie.walk():
            doc, mask, rows = node.end
            since += len(text)
            cut = None
            if since >= CUT_BYTES:
                cut, since = prefix[:CUT_WIDTH], 0
            for part, n in rows.items():
                out.add(doc, part, mask, n, text, cut)
                cut = None
            if out.full():
                yield out.take()

    for b in batches:
        texts = as_bytes(b.column(1))
        points = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
        for doc, text, size, part in zip(b.column(0).to_pylist(), texts, points, b.column(2).to_pylist()):
            mask, part = own_failures(text, size), part or ""
            if doc is None:
                out.add(None, part, mask, 1, None, None)
            else:
                for row in insert(trie, text, doc, part, mask, 1):
                    out.add(*row, None, None)
            if out.full():
                yield out.take()
        if trie.held > HELD_BYTES:
            yield from emptied()
            trie = Trie()
    yield from emptied()
    yield out.take()


def last_step(batches: Iterator[pa.RecordBatch]):
    """All rows of one range of texts, settled."""
    out, trie = Rows(4), Trie()
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        for doc, part, mask, n, text in zip(*cols):
            for row in insert(trie, text, doc, part, mask, n):
                out.add(*row)
            if out.full():
                yield out.take()
    for _, node, _ in trie.walk():
        doc, mask, rows = node.end
        for part, n in rows.items():
            out.add(doc, part, mask, n)
        if out.full():
            yield out.take()
    yield out.take()


def range_bounds(rows: DataFrame) -> list[bytes]:
    """Sorted bounds of the ranges, from the cuts of all tasks."""
    cuts = rows.where("cut IS NOT NULL").select("cut")
    n = cuts.count()
    if n > MAX_CUTS:
        cuts = cuts.where(F.pmod(F.xxhash64("cut"), F.lit(n)) < MAX_CUTS)
    found = sorted({bytes(r.cut) for r in cuts.limit(2 * MAX_CUTS).collect()}) if n > CUTS_A_RANGE else []
    ranges = min(max(n // CUTS_A_RANGE, 1), len(found))
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if ranges > 1 else []


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask, n``: rows of one id, part and set of failed filters (bit 0 is A).

    A null text is empty and a null part the empty string. Rows without an id have no
    smaller id and are none, so they never fail E; rows that repeat an id and a text do not
    fail E for each other. Only the three named columns are read, so others may have any name.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(part_col).alias("part"))
    first = stored(map_batches(source, first_step, f"{ROW}, text binary, cut binary"))
    bounds = range_bounds(first)
    open_rows = first.where("text IS NOT NULL").select("doc_id", "part", "mask", "n", "text")

    def dealt(batches):
        for b in batches:
            to = [bisect.bisect_right(bounds, t) for t in b.column(4).to_pylist()]
            yield [*(b.column(i) for i in range(5)), to]

    ranged = map_batches(open_rows, dealt, f"{ROW}, text binary, to int").repartitionById(len(bounds) + 1, "to")
    last = map_batches(ranged.select("doc_id", "part", "mask", "n", "text"), last_step, ROW)
    return first.where("text IS NULL").select("doc_id", "part", "mask", "n").unionByName(last)


def interaction_audit(masks: DataFrame, letters: str = LETTERS, of: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step, from rows ``part, mask, n``.

    ``of`` names columns that count some of the ``n``; each gives a column ``<name>_lost``
    with the part of them that the step removes. ``shapley`` is what the filter of the step
    removes in all orders together. A part without rows has none; an empty table gives none.
    """
    sums = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *of)])  # at most 2^k rows a part
    k = len(letters)
    steps, orders = [], 1
    for order in itertools.permutations(range(k)):
        for i, x in enumerate(order):
            steps.append({"o": "".join(letters[j] for j in order), "s": i + 1, "e": sum(1 << j for j in order[:i]), "x": 1 << x})
    for i in range(2, k + 1):
        orders *= i
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, e int, x int>>")
    fails, before = "(mask & x) <> 0", "(mask & e) <> 0"

    def total(what: str, where: str, name: str):
        return F.sum(F.expr(f"CASE WHEN {where} THEN {what} ELSE 0L END")).alias(name)

    return (sums.select("*", F.inline(plan)).groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        total("n", "(mask & (e | x)) = 0", "kept"), total("n", f"{fails} AND NOT {before}", "removed"),
        total("n", f"{fails} AND {before}", "redundant"), total("n", "mask = x", "unique_fails"),
        *[total(f"`{c}`", f"{fails} AND NOT {before}", f"{c}_lost") for c in of],
        total(f"n * ({orders} div bit_count(mask))", fails, "shapley")))


SQL = """
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marked AS (SELECT doc_id, part,
  (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT AS mask FROM words),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
sums AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS o FROM letter a, letter b, letter d, letter e, letter f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT o, s::INT AS s, 1 << (ascii(o[s]) - 65) AS x,
  list_sum(list_concat([0], list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))))::INT AS e
  FROM orders, unnest([1, 2, 3, 4, 5]) t(s))
SELECT part, o AS filter_order, s AS step,
  coalesce(sum(n) FILTER ((mask & (e | x)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER ((mask & x) <> 0 AND (mask & e) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((mask & x) <> 0 AND (mask & e) <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = x), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER ((mask & x) <> 0 AND (mask & e) = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER ((mask & x) <> 0 AND (mask & e) = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER ((mask & x) <> 0), 0)::BIGINT AS shapley
FROM sums, steps GROUP BY part, o, s
"""


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Add how many of the ``n`` rows have a label ``quality`` 1 (``good``) and ``toxic`` 1; any label row of the id counts."""
    masks = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))  # a much repeated id meets its label in few rows
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    return masks.join(known, "doc_id", "left").select(
        "part", "mask", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])


@register("op13_filter_audit", SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, per language."""
    masks = failure_masks(table(spark, sf_dir, "documents"))
    return interaction_audit(with_labels(masks, table(spark, sf_dir, "labels")), of=("good", "toxic"))
