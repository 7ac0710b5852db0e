"""Ordered work inside a key that may hold a large share of all rows.

A window partitioned by a key alone puts the whole key into one task. That is the best
plan while every key is small, so each operator first looks whether some key has more
than ``LONG_KEY_ROWS`` rows (a count over the key column, combined before its shuffle).
If so, the ordered rows of the keys are cut into blocks: rows are windowed per
``(key, block)``, one summary row per block is windowed per key, and what it carries is
joined back on ``(key, block)``. No task then sorts more than a block, and the summary of
a key is smaller than the key by the size of a block. Both plans give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.session import materialize

# A position column that is unique within its key gives blocks of at most this many rows.
BLOCK_ROWS = 1 << 16
# Up to this many rows of a key are sorted by one task (a sort that may spill).
LONG_KEY_ROWS = 1 << 21

_known_long: dict[tuple, bool] = {}


def has_long_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some key has more than ``LONG_KEY_ROWS`` rows.

    Remembered per plan: the answer picks between two plans with equal results, so an
    outdated answer costs time, never rows.
    """
    spark = df.sparkSession
    mark = (spark.sparkContext.applicationId, df.semanticHash(), tuple(keys), LONG_KEY_ROWS)
    if mark not in _known_long:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
        _known_long[mark] = sizes.where(F.col("_c") > LONG_KEY_ROWS).limit(1).count() > 0
    return _known_long[mark]

# Columns of one group of rows.
Rows = dict[str, np.ndarray]

_AGGS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}
_MERGE = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than task slots, dealt out to all of them.

    For row-wise work that costs far more than the read. A large input has more splits
    than slots and is left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def deal(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt evenly over all shuffle partitions, ahead of row-wise work that is costly.

    Sized by bytes alone, a few thousand short rows would end up in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def row_block(order: str, rows: int | None = None) -> Column:
    """Block number of a unique integer position."""
    return F.expr(f"`{order}` div {int(rows or BLOCK_ROWS)}")


def value_block(value: str | Column, width: float) -> Column:
    """Block number of a measured value such as a time in seconds."""
    col = F.col(value) if isinstance(value, str) else value
    return F.floor(col / F.lit(float(width)))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    *,
    block: Column | None = None,
    lags: dict[str, tuple[Column, object]] | None = None,
    leads: dict[str, tuple[Column, object]] | None = None,
    running: dict[str, tuple[str, Column]] | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
    number: str | None = None,
    per_key: DataFrame | None = None,
    descending: bool = False,
    long: bool | None = None,
) -> DataFrame:
    """Window work over ``keys`` in ``order``; block by block if a key is long.

    ``lags``/``leads`` give the previous/next row's value with a default at the ends,
    ``running`` an inclusive running aggregate, ``totals`` the aggregate of the whole
    key, ``number`` a 0-based row number. ``per_key`` attaches one row of attributes
    per key through the block summary, so a hot key is never a join key by itself.
    ``descending`` walks the rows (and the blocks) backwards. ``long`` passes on what is
    already known about the keys.
    """
    lags, leads, running, totals = lags or {}, leads or {}, running or {}, totals or {}
    cols = [order] if isinstance(order, str) else list(order)
    sort = [F.col(c).desc() if descending else F.col(c) for c in cols]
    if not (has_long_key(df, keys) if long is None else long):
        flat = Window.partitionBy(*keys).orderBy(*sort)
        so_far = flat.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        done = {o: F.lag(e, 1, d).over(flat) for o, (e, d) in lags.items()}
        done.update({o: F.lead(e, 1, d).over(flat) for o, (e, d) in leads.items()})
        done.update({o: _AGGS[a](e).over(so_far) for o, (a, e) in running.items()})
        if number:
            done[number] = F.row_number().over(flat).cast("long") - 1
        done.update({o: _AGGS[a](e).over(Window.partitionBy(*keys)) for o, (a, e) in totals.items()})
        kept = [c for c in df.columns if c not in done]
        out = df.select(*kept, *[c.alias(n) for n, c in done.items()])
        return out if per_key is None else out.join(per_key, list(keys), "left")

    # Both the rows and their summary read the checkpoint, so nested scans do not multiply.
    base = materialize(df.withColumn("_blk", row_block(cols[0]) if block is None else block))
    rank = F.struct(*cols)
    first, last = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)

    within = Window.partitionBy(*keys, "_blk").orderBy(*sort)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local: dict[str, Column] = {}
    if lags or number:
        local["_rn"] = F.row_number().over(within)
    for out, (expr, _) in lags.items():
        local[f"_l_{out}"] = F.lag(F.struct(expr.alias("v"))).over(within)
    for out, (expr, _) in leads.items():
        local[f"_f_{out}"] = F.lead(F.struct(expr.alias("v"))).over(within)
    for out, (agg, expr) in running.items():
        local[f"_r_{out}"] = _AGGS[agg](expr).over(upto)

    aggs = [F.count(F.lit(1)).alias("_cnt")]
    aggs += [last(F.struct(e.alias("v")), rank).alias(f"_e_{o}") for o, (e, _) in lags.items()]
    aggs += [first(F.struct(e.alias("v")), rank).alias(f"_b_{o}") for o, (e, _) in leads.items()]
    aggs += [_AGGS[a](e).alias(f"_s_{o}") for o, (a, e) in running.items()]
    aggs += [_AGGS[a](e).alias(f"_t_{o}") for o, (a, e) in totals.items()]
    summary = base.groupBy(*keys, "_blk").agg(*aggs)

    blocks = F.col("_blk").desc() if descending else F.col("_blk")
    across = Window.partitionBy(*keys).orderBy(blocks)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = [*keys, "_blk"]
    carry += [F.lag(f"_e_{o}").over(across).alias(f"_ce_{o}") for o in lags]
    carry += [F.lead(f"_b_{o}").over(across).alias(f"_cb_{o}") for o in leads]
    carry += [_AGGS[a](f"_s_{o}").over(before).alias(f"_cs_{o}") for o, (a, _) in running.items()]
    carry += [_AGGS[a](f"_t_{o}").over(whole).alias(o) for o, (a, _) in totals.items()]
    if number:
        carry.append(F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_cn"))
    table = summary.select(*carry)
    attached: list[str] = []
    if per_key is not None:
        attached = [c for c in per_key.columns if c not in keys]
        table = table.join(per_key, list(keys), "left")

    rows = base.withColumns(local) if local else base
    rows = rows.join(table, [*keys, "_blk"], "left")

    done: dict[str, Column] = {}
    for out, (_, default) in lags.items():
        prev = F.when(F.col("_rn") == 1, F.col(f"_ce_{out}")).otherwise(F.col(f"_l_{out}"))
        done[out] = F.when(prev.isNull(), F.lit(default)).otherwise(prev["v"])
    for out, (_, default) in leads.items():
        nxt = F.coalesce(F.col(f"_f_{out}"), F.col(f"_cb_{out}"))
        done[out] = F.when(nxt.isNull(), F.lit(default)).otherwise(nxt["v"])
    for out, (agg, _) in running.items():
        done[out] = _MERGE[agg](F.col(f"_cs_{out}"), F.col(f"_r_{out}"))
    if number:
        done[number] = F.col("_cn") + F.col("_rn") - 1
    keep = [c for c in df.columns if c not in done]
    return rows.select(
        *keep, *[c.alias(n) for n, c in done.items()], *totals.keys(), *attached
    )


def attach_per_key(
    df: DataFrame, attrs: DataFrame, keys: Sequence[str], block: Column, how: str = "left", *, long: bool | None = None
) -> DataFrame:
    """Join one row of attributes per key to many rows; a long key is never joined alone.

    With a long key the attributes are joined to the distinct ``(key, block)`` pairs, and the rows to
    that small table, so a hot key is spread over its blocks.
    """
    if not (has_long_key(df, keys) if long is None else long):
        return df.join(attrs, list(keys), how)
    rows = materialize(df.withColumn("_ablk", block))
    pairs = rows.select(*keys, "_ablk").distinct().join(attrs, list(keys), "inner")
    return rows.join(pairs, [*keys, "_ablk"], how).drop("_ablk")


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, pct: float, out: str, *, long: bool | None = None
) -> DataFrame:
    """Exact percentile per key with linear interpolation between the two nearest ranks.

    With a long key, equal values are counted before they are shuffled; the distinct values are ranked in
    logarithmic blocks (about 1.5 % wide), so neither a hot key nor a hot value is held by
    one task and a key has about a thousand blocks over seven decades.
    """
    if not (has_long_key(df, keys) if long is None else long):
        return df.groupBy(*keys).agg(F.percentile(value, F.lit(pct)).alias(out))
    col = F.col(value)
    log_block = F.floor(F.signum(col) * F.log(F.abs(col) + 1) * 64)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_scan(
        counts, keys, value, block=log_block,
        running={"_cum": ("sum", F.col("_c"))}, totals={"_n": ("sum", F.col("_c"))}, long=True,
    )
    pos = (F.col("_n") - 1) * F.lit(float(pct))
    lo = F.floor(pos)
    hi = F.least(lo + 1, F.col("_n") - 1)
    inside = lambda r: (F.col("_cum") - F.col("_c") <= r) & (r < F.col("_cum"))
    picked = ranked.where(inside(lo) | inside(hi)).groupBy(*keys).agg(
        F.max(F.when(inside(lo), F.col(value))).alias("_lo"),
        F.max(F.when(inside(hi), F.col(value))).alias("_hi"),
        F.max(pos - lo).alias("_frac"),
        F.max(lo + 1 - pos).alias("_up"),
    )
    # The order of operations of Spark's own percentile, so that both plans agree to the last bit.
    between = F.col("_up") * F.col("_lo") + F.col("_frac") * F.col("_hi")
    return picked.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias(out))


def nearest_on_line(
    points: DataFrame, rows: DataFrame, keys: Sequence[str], *, at: str, value: str, tie: str, k: int, width: float,
) -> DataFrame:
    """For every point the ``k`` rows of its key at or before it and the ``k`` after it, on one line of values.

    One walk over the merged line counts the rows up to each point; the rows themselves are numbered in
    their order, and a point is joined to its ``2 k`` numbers by equality. So there is no row per pair, and a
    hot key is no join key. Of rows with one value those with the lower ``tie`` are nearer, on both sides.
    Points and rows without a value, and keys that are null, are left out.
    """
    points, rows = (df.where(F.col(c).isNotNull()) for df, c in ((points, at), (rows, value)))
    line = rows.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_at"))
    marks = points.withColumn("_point", F.struct(*[F.col(f"`{c}`") for c in points.columns]))
    line = line.withColumn("_point", F.lit(None).cast(marks.schema["_point"].dataType)).unionByName(
        marks.select(*keys, F.col(at).cast("double").alias("_v"), F.lit(1).alias("_side"), F.to_json("_point").alias("_at"), "_point"))
    long = has_long_key(line.select(*keys), keys)
    block = value_block("_v", width)
    counted = ordered_scan(line, keys, ["_v", "_side", "_at"], block=block, long=long,
                           running={"_n": ("sum", F.lit(1) - F.col("_side"))}).where("_side = 1")
    spots = counted.select(*keys, "_point", "_n", F.explode(F.sequence(F.lit(-k), F.lit(k - 1))).alias("_o"))
    spots = spots.select(*keys, "_point", (F.col("_n") + F.col("_o")).alias("_i"), (F.col("_o") < 0).alias("_before"))

    def numbered(before: bool) -> DataFrame:
        turned = rows.withColumns({"_v": F.col(value).cast("double"), "_t": -F.col(tie) if before else F.col(tie)})
        return ordered_scan(turned, keys, ["_v", "_t"], block=block, number="_i", long=long).drop("_v", "_t").withColumn("_before", F.lit(before))

    found = spots.join(numbered(True).unionByName(numbered(False)), [*keys, "_i", "_before"])
    own = [c for c in points.columns if c not in keys]
    return found.select(*keys, *[F.col(f"_point.`{c}`") for c in own], *[c for c in rows.columns if c not in keys])


def interval_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, width: float,
    left_span: tuple[str, str], right_span: tuple[str, str],
) -> DataFrame:
    """Pairs of closed intervals of one key that touch or overlap.

    Both sides are laid on time buckets of ``width`` seconds and joined on
    ``(key, bucket)``; a pair is kept only in the first bucket both reach.
    """
    (ls, le), (rs, re_) = left_span, right_span
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width)))

    def lay(df: DataFrame, start: str, end: str) -> DataFrame:
        ok = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
        return ok.withColumn("_bk", F.explode(F.sequence(bucket(start), bucket(end))))

    pairs = lay(left, ls, le).join(lay(right, rs, re_), [*keys, "_bk"])
    return pairs.where(
        (F.col(rs) <= F.col(le)) & (F.col(re_) >= F.col(ls))
        & (F.col("_bk") == F.greatest(bucket(ls), bucket(rs)))
    ).drop("_bk")


def pick(rows: Rows, names: Sequence[str], keep: np.ndarray | list[bool] | None = None) -> Rows:
    """Some columns of a group, cut to the rows to keep."""
    mask = slice(None) if keep is None else np.asarray(keep, dtype=bool)
    return {n: rows[n][mask] for n in names}


def map_sorted_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[Rows], Rows], schema: str,
) -> DataFrame:
    """Apply ``fn`` to every bounded group, its rows in order.

    One shuffle on ``keys`` and one sort. Groups are cut out of the Arrow stream as column
    slices and their results gathered per batch, so a small group costs microseconds
    where a grouped map would build a frame for it.
    """
    keys, order = list(keys), list(order)

    def cut(pdf: pd.DataFrame, bounds: list[int]) -> Iterator[pd.DataFrame]:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        out: dict[str, list] = {}
        for a, b in zip(bounds, bounds[1:]):
            for name, values in fn({c: v[a:b] for c, v in cols.items()}).items():
                out.setdefault(name, []).extend(values)
        if any(out.values()):
            yield pd.DataFrame(out)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Parts of the group that is still open. They are joined once, when it ends, however many batches it fills.
        pending: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
                new[0] |= bool(pending) and pending[-1][k].iloc[-1] != v[0]
            starts = new.nonzero()[0].tolist()
            if not starts:
                pending.append(pdf)
                continue
            if pending:
                if starts[0]:
                    pending.append(pdf.iloc[:starts[0]])
                whole = pd.concat(pending, ignore_index=True) if len(pending) > 1 else pending[0]
                yield from cut(whole, [0, len(whole)])
            else:
                starts = [0, *starts]
            if len(starts) > 1:
                yield from cut(pdf, starts)
            pending = [pdf.iloc[starts[-1]:]]
        if pending:
            whole = pd.concat(pending, ignore_index=True) if len(pending) > 1 else pending[0]
            yield from cut(whole, [0, len(whole)])

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


@dataclass(frozen=True)
class Step:
    """What a block does to the state of a fold: ``make`` writes it as a string, ``apply`` gives the state after it.

    The string must say so for every state, and be far shorter than the block.
    """

    make: Callable[[Rows], str]
    apply: Callable[[str, str | None], str | None]


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: str, fold: Callable[[Rows, str | None], tuple[Rows, str | None]],
    schema: str, *, block_rows: int | None = None, long: bool | None = None, step: Step | None = None,
) -> DataFrame:
    """Sequential fold over the ordered rows of each key, block by block.

    ``fold(rows, state)`` gets the rows of one block and the state (a string, ``None`` at
    the very start) left by the block before, and returns output rows plus its own final
    state. ``order`` is a 0-based integer position unique within the key.

    Without a long key every key is one call. With a ``step`` every block gives the state
    that it leaves as a function of the state that it finds; the functions of a key, one row
    a block, are applied one after the other, and every block then runs once with its state.
    Without one every block first guesses that it is the start; then the guesses are replaced
    by the states really handed over, and only the blocks whose entry changed run again,
    until nothing changes. A block whose entry equals its predecessor's exit is right, block
    0 is right from the start, so each round settles at least one more block and the result
    is exact.
    """
    keys = list(keys)
    if long is None:
        long = block_rows is not None or has_long_key(df, keys)
    rows = df.withColumn("_blk", row_block(order, block_rows) if long else F.lit(0).cast("long"))
    held = [*keys, "_blk"]

    def exits_only(group: Rows) -> Rows:
        _, state = fold(group, group["_entry"][0])
        return {**{k: group[k][:1] for k in held}, "exit": [state]}

    def emit(group: Rows) -> Rows:
        return fold(group, group["_entry"][0])[0]

    if not long:
        flat = rows.withColumn("_entry", F.lit(None).cast("string"))
        return map_sorted_groups(flat, held, [order], emit, schema)

    if step is not None:
        kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*held).dtypes)
        rows = materialize(rows)

        def functions(group: Rows) -> Rows:
            return {**{k: group[k][:1] for k in held}, "fn": [step.make(group)]}

        def chained(group: Rows) -> Rows:
            states: list[str | None] = [None]
            for fn in group["fn"][:-1]:
                states.append(step.apply(fn, states[-1]))
            return {**pick(group, held), "_entry": states}

        made = map_sorted_groups(rows, held, [order], functions, f"{kinds}, fn string")
        entries = map_sorted_groups(made, keys, ["_blk"], chained, f"{kinds}, _entry string")
        return map_sorted_groups(rows.join(entries, held), held, [order], emit, schema)

    exit_schema = ", ".join(f"{c} {t}" for c, t in rows.select(*held).dtypes) + ", exit string"
    across = Window.partitionBy(*keys).orderBy("_blk")
    rows = materialize(rows)
    entries = materialize(rows.select(*held).distinct().withColumn("_entry", F.lit(None).cast("string")))
    todo, exits = entries, None
    while True:
        fresh = materialize(map_sorted_groups(rows.join(todo, held), held, [order], exits_only, exit_schema))
        if exits is None:
            exits = fresh
        else:
            exits = materialize(exits.join(fresh, held, "left_anti").unionByName(fresh))
        handed = exits.select(*held, F.lag("exit").over(across).alias("_new"))
        merged = materialize(entries.join(handed, held))
        todo = merged.where(~F.col("_entry").eqNullSafe(F.col("_new"))).select(*held, F.col("_new").alias("_entry"))
        entries = merged.select(*held, F.col("_new").alias("_entry"))
        if todo.limit(1).count() == 0:
            break
    return map_sorted_groups(rows.join(entries, held), held, [order], emit, schema)


def ancestors(path: Column) -> Column:
    """All prefixes of a path string, the path itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(path)), lambda n: F.substring(path, F.lit(1), n))
