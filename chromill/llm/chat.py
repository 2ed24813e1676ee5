"""Collapse of cumulative chat snapshots, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup

#: Turns numbered within one block are ordered in one task; longer conversations span blocks.
BLOCK = 1024
#: Rendered turns of one row at most; a longer conversation has several parts, in order.
PART = 1024
#: The markers of a rendered turn.
START, END = "<|im_start|>", "<|im_end|>"


def _running(rows: DataFrame, values: dict[str, Column], order: list[Column], inclusive: bool) -> DataFrame:
    """Adds running sums of values within conv_id, from sums within blocks and the sums of the blocks before."""
    per = rows.groupBy("conv_id", "block").agg(*[F.sum(v).alias(f"{n}_all") for n, v in values.items()])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("conv_id").alias("off_id"), F.col("block").alias("off_block"), *[F.coalesce(F.sum(f"{n}_all").over(before), F.lit(0)).alias(f"{n}_off") for n in values])
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    summed = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{n}_in") for n, v in values.items()])
    on = F.col("conv_id").eqNullSafe(F.col("off_id")) & F.col("block").eqNullSafe(F.col("off_block"))
    joined = summed.join(offsets, on)
    return joined.select(*rows.columns, *[(F.col(f"{n}_in") + F.col(f"{n}_off")).alias(n) for n in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (0, 1, ...), block, role, key_1, key_2 of the turn, h_1, h_2: hashes of the conversation up to it.

    Turns are ordered by turn (null last), then role and a hash of the text; repeated turns count as often as they occur.
    A null role is 'unknown', a null text ''; a null conv_id is a conversation of its own. A prefix hash is
    the running sum of hashes of (place, role, text), two of 64 bits each, from blocks of BLOCK turn
    numbers, so that no task orders a whole long conversation by itself.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit("unknown"))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.xxhash64(text).alias("key_1"), F.xxhash64(F.lit(1), text).alias("key_2"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long").alias("block"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("key_1"), F.col("key_2")]
    placed = _running(rows, {"place": F.lit(1)}, order, inclusive=False)
    wrap = lambda c: c.cast("decimal(38,0)")  # noqa: E731  sums of 64-bit hashes without overflow
    hashes = {"h_1": wrap(F.xxhash64("place", "role", "key_1")), "h_2": wrap(F.xxhash64("key_2", "place", "role", F.lit(1)))}
    return _running(placed, hashes, [F.col("place")], inclusive=True)


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations: those that no longer one begins with.

    Of conversations alike in all turns, the one with the smallest conv_id (null last) stays; n_copies
    counts them. Prefixes are matched by their length and hash through an anti-join against the
    distinct proper prefixes, so a first turn that very many conversations share costs one row.
    """
    hashed = cut(prefixes(turns).select("conv_id", "place", "h_1", "h_2"))
    lengths = hashed.groupBy("conv_id").agg(F.max("place").alias("last")).withColumnRenamed("conv_id", "len_id")
    at = lookup(hashed, cut(lengths), F.col("conv_id").eqNullSafe(F.col("len_id")), "inner")
    whole = at.where("place = last").groupBy("place", "h_1", "h_2").agg(F.expr("min_by(struct(conv_id), struct(conv_id IS NULL, conv_id))").alias("first"), F.count("*").alias("n_copies"))
    proper = at.where("place < last").select("place", "h_1", "h_2").distinct()
    kept = whole.join(proper, ["place", "h_1", "h_2"], "left_anti")
    return kept.select(F.col("first.conv_id").alias("conv_id"), (F.col("place") + 1).cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text of each conversation: its turns between markers, in order, PART turns a row at most.

    Marker strings inside a text are broken by a zero-width space, so that a turn cannot end early.
    """
    keys = prefixes(turns).select("conv_id", "turn", "role", "key_1", "key_2", "place")
    # equal turns of one conversation have the same text, so the place of each is found by its rank among them
    same = Window.partitionBy("conv_id", "turn", "role", "key_1", "key_2")
    ranked = keys.withColumn("nth", F.row_number().over(same.orderBy("place")))
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit("unknown"))
    full = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), role.alias("r"), text.alias("text"), F.xxhash64(text).alias("k_1"), F.xxhash64(F.lit(1), text).alias("k_2"))
    full = full.withColumn("n", F.row_number().over(Window.partitionBy("c", "t", "r", "k_1", "k_2").orderBy("k_1")))
    on = (
        F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r"))
        & (F.col("key_1") == F.col("k_1")) & (F.col("key_2") == F.col("k_2")) & (F.col("nth") == F.col("n"))
    )
    safe = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", "<|​$1|>")
    piece = F.concat(F.lit(START), "role", F.lit("\n"), safe, F.lit(END + "\n"))
    pieces = ranked.join(full, on).select("conv_id", "place", F.floor(F.col("place") / PART).cast("int").alias("part"), piece.alias("piece"))
    parts = pieces.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    return parts.select("conv_id", "part", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda x: x.piece), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of all parts), n_copies, text of the maximal conversations."""
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = cut(collapse(turns)).withColumnRenamed("conv_id", "kept_id")
    chosen = lookup(turns, kept.select("kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    rendered = render(chosen).withColumnRenamed("n_turns", "part_turns")
    return lookup(rendered, kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "inner").select("conv_id", "part", "n_turns", "n_copies", "text")
