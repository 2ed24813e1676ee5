"""Sharding by sampled splitters."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, replacing

#: Ranges cut for each shard; a shard's bytes are off by at most about one range.
RANGES_PER_SHARD = 256
#: Expected number of sampled keys that the driver sees, whatever the input's size.
SAMPLE = 65_536
#: A range over so many times the mean is divided again.
OVERFULL = 2.0
ROUNDS = 5
#: Equal texts stay in one shard unless together they exceed this part of a shard's share.
WHOLE = 0.05
#: Digits of a key that come from the text.
_TEXT = 16


def _key(others: list[F.Column]) -> F.Column:
    """Hashes of text, doc_id and others as hexadecimal of fixed width: equal texts are neighbours, and a group of them can be divided."""
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    parts = [F.xxhash64("text"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), F.xxhash64(*others) if others else F.lit(0).cast("long")]
    return F.concat(*map(wide, parts))


#: Rows that one repeated row is dealt out in at a time.
CHUNK = 65_536


def _range_of(splitters: list[str]):
    edges = np.array(splitters, dtype="S48")

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy().astype("S48"), side="right").astype("int32"))

    return place


def _sampled(rows: DataFrame, mean: float, seed: int) -> list[tuple[str, float]]:
    """Keys drawn with a chance of size / mean, and the bytes each stands for."""
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(mean))
    draw = F.pmod(F.xxhash64("shard_key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = rows.where(draw < chance).groupBy("shard_key").agg(F.sum(F.greatest(F.col("size").cast("double"), F.lit(mean))).alias("stands"))
    return sorted((r[0], r[1]) for r in taken.collect())


def _quantiles(sample: list[tuple[str, float]], n: int) -> list[str]:
    if not sample or n < 2:
        return []
    keys, stands = zip(*sample, strict=True)
    ends = np.cumsum(stands)
    return sorted({keys[min(len(keys) - 1, i)] for i in np.searchsorted(ends, ends[-1] * np.arange(1, n) / n)})


def splitters_for(rows: DataFrame, n_ranges: int, sample: int = SAMPLE, seed: int = 7) -> tuple[list[str], list[tuple]]:
    """Splitters of (shard_key, size) rows, and (range, bytes, rows, several keys, the text if it is one) of each range that has any.

    The driver sees the sampled keys (sample of them expected, at any input size) and one row a range.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], []
    splitters = _quantiles(_sampled(rows, max(1.0, total / sample), seed), n_ranges)
    splitters = sorted({_start(key) for key in splitters})
    text = F.substring("shard_key", 1, _TEXT)
    for again in range(ROUNDS + 1):
        ranged = rows.withColumn("shard_range", _range_of(splitters)("shard_key"))
        low, high = F.min("shard_key").alias("low"), F.max("shard_key").alias("high")
        stats = sorted(tuple(r) for r in ranged.groupBy("shard_range").agg(F.sum("size"), F.count("*"), low != high, F.when(F.min(text) == F.max(text), F.min(text))).collect())
        bound = OVERFULL * total / n_ranges
        over = {r: (b, of) for r, b, _, divisible, of in stats if b > bound and divisible}
        if not over or again == ROUNDS:
            return splitters, stats
        inside = ranged.where(F.col("shard_range").isin(list(over)))
        more: set[str] = set()
        by_range: dict[int, list] = {}
        for key, stands in _sampled(inside, max(1.0, sum(b for b, _ in over.values()) / sample), seed + again + 1):
            by_range.setdefault(bisect.bisect_right(splitters, key), []).append((key, stands))
        for r, found in by_range.items():
            cuts = _quantiles(found, 2 + int(2 * over[r][0] / bound))
            # a range of one text is cut by doc_id; from others, each sampled text is first set apart as a whole
            more.update(cuts if over[r][1] else (edge for key in cuts for edge in (_start(key), _start(key, 1))))
        if not more - set(splitters):
            return splitters, stats
        splitters = sorted({*splitters, *more})


def _start(key: str, later: int = 0) -> str:
    """The first key of this key's text, or of the hash that many places on."""
    return f"{min(int(key[:_TEXT], 16) + later, 16**_TEXT - 1):0{_TEXT}X}" + "0" * (len(key) - _TEXT)


def _segments(stats: list[tuple], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(range, first row, last row, shard, slot less row): ranges in order fill the shards with near equal bytes.

    A range goes whole to the shard that its middle byte falls into. One that holds a single key many
    times over, which no splitter divides, is cut by rows, all of one size.
    """
    total, at, slots, out = sum(s[1] for s in stats), 0, [0] * n_shards, []
    of_text: dict[str, int] = {}
    for _, held, _, _, of in stats:
        if of is not None:
            of_text[of] = of_text.get(of, 0) + held
    placed: dict[str, int] = {}
    for r, held, rows, divisible, of in stats:
        row = 0
        whole = of is not None and of_text[of] * n_shards <= total * WHOLE
        if whole:
            placed.setdefault(of, min(n_shards - 1, int((at + of_text[of] / 2) * n_shards // total)))
        while row < rows:
            each = held / rows
            if whole:
                shard, until = placed[of], rows
            elif divisible or held * n_shards * 8 <= total:
                shard, until = min(n_shards - 1, int((at + held / 2) * n_shards // total)), rows
            else:
                shard = min(n_shards - 1, int((at + each * (row + 0.5)) * n_shards // total))
                end = total * (shard + 1) / n_shards
                until = rows if shard == n_shards - 1 else min(rows, max(row + 1, int(-(-(end - at - each / 2) // each))))
            out.append((r, row, until - 1, shard, slots[shard] - row))
            slots[shard] += until - row
            row = until
        at += held
    return out


def _dealt(hot: DataFrame, segments: DataFrame) -> DataFrame:
    """kept, size, shard and slot of ranges that hold one row many times over.

    The repeats are counted, which combines before the shuffle, and the counts dealt out to the segments in
    chunks, so no task orders or holds all of them.
    """
    counted = hot.groupBy("shard_range", "kept", "size").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard_range").orderBy(F.xxhash64("kept"))) - F.col("n")
    met = counted.withColumn("before", before).join(F.broadcast(segments), "shard_range")
    low, high = F.greatest("first", "before"), F.least(F.col("last"), F.col("before") + F.col("n") - 1)
    spans = met.withColumn("low", low).withColumn("high", high).where("low <= high")
    chunks = spans.withColumn("low", F.explode(F.sequence("low", "high", F.lit(CHUNK).cast("long")))).repartition("shard_range", "low")
    rows = chunks.withColumn("row", F.explode(F.sequence(F.col("low"), F.least(F.col("high"), F.col("low") + CHUNK - 1))))
    return rows.select("kept", "size", "shard", (F.col("row") + F.col("shift")).alias("slot"))


def shard(docs: DataFrame, n_shards: int = 16, ranges_per_shard: int = RANGES_PER_SHARD, sample: int = SAMPLE, columns: list[str] | None = None) -> DataFrame:
    """docs with size (UTF-8 bytes plus 1), shard and slot; sizes of shards are near equal, slots gapless from 0.

    Keys are drawn with chances by size, their weighted quantiles cut the key order into
    ranges, ranges that turn out overfull are sampled and divided again, and ranges fill the shards in
    order. The order is by text hash, then doc_id, then a hash of the columns that are carried; ranges begin
    with a text, so equal texts share a shard unless together they exceed WHOLE of a shard, when ranges cut
    them by doc_id. Rows alike in all carried columns share a key; if one such key overfills its range its
    repeats are counted and dealt out. (Carried columns that hold maps cannot be compared: repeats are then
    numbered in one task.) A null or empty text has size 1; a null doc_id sorts as 0.
    An empty table gives no rows. Columns of docs named like the added ones are replaced; other names clash with nothing.

    columns: which of docs' columns to carry along (all by default); rows are shuffled once, by range,
    for slots, and ranges shrink with the number of shards, not with the largest text group.
    """
    spark = docs.sparkSession
    docs = replacing(docs, "size", "shard", "slot")
    carried = [c for c in docs.columns if columns is None or c in columns]
    own = [F.col("`" + c.replace("`", "``") + "`") for c in carried]
    alike = [c for c, name in zip(own, carried, strict=True) if name not in ("text", "doc_id") and "map<" not in docs.schema[name].dataType.simpleString()]
    keyed = docs.select(F.struct(*own).alias("kept"), _key(alike).alias("shard_key"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    narrow = cut(keyed.select("shard_key", "size"))
    splitters, stats = splitters_for(narrow, n_shards * ranges_per_shard, sample)
    # at most a few rows a range, and ranges are bounded by the number of shards
    segments = spark.createDataFrame(_segments(stats, n_shards), "shard_range int, first long, last long, shard int, shift long")
    bound = OVERFULL * sum(s[1] for s in stats) / max(1, n_shards * ranges_per_shard)
    hot = [r for r, held, rows, divisible, _ in stats if not divisible and rows > 1 and held > bound and "map<" not in keyed.schema["kept"].dataType.simpleString()]
    placed = keyed.withColumn("shard_range", _range_of(splitters)("shard_key"))
    row = F.row_number().over(Window.partitionBy("shard_range").orderBy("shard_key")) - 1
    numbered = placed.where(~F.col("shard_range").isin(hot)).withColumn("row", row) if hot else placed.withColumn("row", row)
    out = numbered.join(F.broadcast(segments), "shard_range").where(F.col("row").between(F.col("first"), F.col("last")))
    out = out.select("kept", "size", "shard", (F.col("row") + F.col("shift")).cast("long").alias("slot"))
    if hot:
        out = out.unionByName(_dealt(placed.where(F.col("shard_range").isin(hot)).select("shard_range", "kept", "size"), segments))
    return out.select("kept.*", "size", "shard", "slot")
