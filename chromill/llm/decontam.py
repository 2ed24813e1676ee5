"""Benchmark decontamination by template windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, fits, lookup, unused
from .tokens import fold, remembered, slices, split_words, windows

#: Tokens of a template window.
WINDOW = 8
#: Tokens of a window that must be words, not placeholders.
LITERAL = 4
#: Tokens in a row that a document must share with an item, or the whole of a shorter item.
MIN_TOKENS = 13
#: Window hashes of the benchmark are sent along to the scan up to so many; beyond, all windows are shuffled.
FILTER_WINDOWS = 2_000_000

# Units, and numbers in words.
UNITS = frozenset(
    (
        "nm mm cm dm m km millimetre millimetres millimeter millimeters centimetre centimetres centimeter centimeters metre metres meter meters kilometre kilometres "
        "kilometer kilometers in inch inches ft foot feet yd yard yards mi mile miles acre acres hectare hectares mg g kg lb lbs gram grams gramme grammes kilogram "
        "kilograms tonne tonnes ton tons oz ounce ounces pound pounds ml cl dl l millilitre millilitres milliliter milliliters liter liters litre litres gallon gallons pint "
        "pints quart quarts cup cups teaspoon teaspoons tablespoon tablespoons ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week "
        "weeks month months year years decade decades century centuries % percent per-cent point points dollar dollars cent cents euro euros penny pence usd eur gbp "
        "rupee rupees yen franc francs mph kmh km/h kph m/s hz khz mhz ghz w kw mw watt watts volt volts v amp amps ampere amperes ohm ohms joule joules calorie calories "
        "kcal newton newtons b kb mb gb tb byte bytes bit bits degree degrees celsius fahrenheit kelvin radians dozen"
    ).split()
)
NUMBERS = frozenset(
    (
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
        "sixty seventy eighty ninety hundred thousand million billion trillion half third quarter twice thrice"
    ).split()
)

# a number with what is written onto it: a currency, an ordinal's ending, a unit
_NUMBER = re.compile(r"[+-]?[$€£¥]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%|°[cf]?|[kmb]n?|" + "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True)) + r")?")
_COMPOUND = re.compile("(?:" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + ")(?:-(?:" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + "))+")
_EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_LITERAL, _NUM, _CAPITAL, _UNIT, _SKIP = range(5)
_SLOT = np.array([xxhash.xxh64_intdigest(x) for x in ("", "<NUM>", "<NAME>", "<UNIT>", "")], np.uint64)


def _token(raw: str) -> tuple[int, int, bool, bool]:
    """Kind, hash of the bare lower-case word, whether a sentence ends here, whether it can be a unit."""
    bare = _EDGES.sub("", raw)
    low = bare.lower()
    kind = _SKIP if not bare else _NUM if _NUMBER.fullmatch(low) or low in NUMBERS or "-" in low and _COMPOUND.fullmatch(low) else _CAPITAL if bare[0].isupper() and bare[1:].islower() else _LITERAL
    return kind, xxhash.xxh64_intdigest(low), raw.rstrip("\"')]»”").endswith((".", "!", "?", ":")), low in UNITS


_SEEN: dict[str, tuple[int, int, bool, bool]] = {}


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' tokens in order: kind, kinds it can have after other tokens as bits, hash of the word itself, whether it is a slot; and each text's offsets.

    A number becomes a placeholder, a unit after a number another, and a capitalised word inside a
    sentence a name; tokens without a letter or digit are left out. All else stays as a lower-case word.
    """
    words, offsets = split_words(texts, lower=False)
    table = remembered(words, _SEEN, _token)
    if not table:
        empty = np.empty(0, np.uint64)
        return empty.astype(np.int64), empty.astype(np.int64), empty, np.empty(0, bool), np.zeros(len(texts) + 1, np.int64)
    # typed, as numpy makes floats of integers on both sides of 2**63, and of others not
    kinds, hashes, ends, units = (np.array(c, t) for c, t in zip(zip(*table, strict=True), (np.int64, np.uint64, bool, bool), strict=True))
    codes = words.indices.to_numpy()
    real = kinds[codes] != _SKIP
    before = np.concatenate([[0], np.cumsum(real)])
    codes, offsets = codes[real], before[offsets]
    kind, word = kinds[codes].copy(), hashes[codes]
    starts = np.zeros(len(codes) + 1, bool)
    starts[offsets] = True
    starts = starts[:-1]
    prior = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
    first = starts | ends[prior]
    follows_number = np.concatenate([[False], kind[:-1] == _NUM]) & ~starts if len(codes) else starts
    fixed, unit = kind == _NUM, units[codes]
    able = np.where(fixed, 1 << _NUM, 1 << _LITERAL) | np.where(kind == _CAPITAL, 1 << _CAPITAL, 0) | np.where(unit, 1 << _UNIT, 0)
    kind[(kind == _CAPITAL) & first] = _LITERAL
    kind[unit & follows_number] = _UNIT
    return kind, able, word, kind != _LITERAL, offsets


def _starting(first: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """windows(hashes, k) with each window's first entry taken from first."""
    n = len(hashes) - k + 1
    x = fold(np.full(n, k, np.uint64), first[:n])
    for j in range(1, k):
        x = fold(x, hashes[j : j + n])
    return x


MATCHES = "id long, text_key long, window long, place int, length int, worded boolean, slots array<long>"


def _window_rows(lengths: list[int], wanted: np.ndarray | None, of_items: bool, id_column: str):
    """Rows (id, text_key, window, place, length, worded, slots) of all windows, or of those whose hash is wanted.

    A window with LITERAL words gives its template; each gives its lower-case words, without slots, where
    that is not the same hash. worded: whether its place has a template. of_items: a text of fewer than
    WINDOW tokens gives itself as one window, whatever its length; and as the kind of a window's first token
    hangs on the token before it, which a copy may not share, a window gives a template for each kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kind, able, word, slot, offsets = templates(batch.column("text"))
            template = np.where(slot, _SLOT[kind], word)
            ids, keys = batch.column(id_column), batch.column("text_key")
            literal = np.concatenate([[0], np.cumsum(~slot)])
            owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
            size = np.diff(offsets)
            for k in lengths:
                if len(template) < k:
                    continue
                at = np.arange(len(template) - k + 1)
                whole = owner[at] == owner[at + k - 1]
                if of_items and k < WINDOW:
                    whole &= size[owner[at]] == k
                words = literal[at + k] - literal[at]
                # a document's first token may be a word in the item
                spare = 0 if of_items else (slot & (kind != _NUM))[at]
                worded = whole & (words + spare >= LITERAL)
                # hash, which windows, and the kind of their first token; no kind where there are no slots
                forms = [(windows(template, k), worded, kind), (windows(word, k), whole & ~(worded & (words == k)), None)]
                for other in (_LITERAL, _CAPITAL, _UNIT) if of_items else ():
                    start = word if other == _LITERAL else np.full(len(word), _SLOT[other])
                    forms.append((_starting(start, template, k), worded & ((able[at] >> other) & 1 == 1) & (kind[at] != other), np.full(len(word), other)))
                for hashed, good, head in forms:
                    if wanted is not None:
                        near = np.searchsorted(wanted, hashed)
                        good = good & (wanted[np.minimum(near, len(wanted) - 1)] == hashed)
                    at = np.flatnonzero(good)
                    for part in range(0, len(at), 50_000):
                        own = at[part : part + 50_000]
                        slots = [() if head is None else word[a : a + k][np.append(head[a] != _LITERAL, slot[a + 1 : a + k])].view(np.int64) for a in own]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(owner[own])), keys.take(pa.array(owner[own])), pa.array(hashed[own].view(np.int64)), pa.array((own - offsets[owner[own]]).astype(np.int32)),
                                pa.array(np.full(len(own), k, np.int32)), pa.array(worded[own]), pa.array(slots, pa.list_(pa.int64())),
                            ],
                            names=["id", "text_key", "window", "place", "length", "worded", "slots"],
                        )

    return run


def _stretches(slots: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The maximal stretches [from, to) of windows, each given as its slot values in item and document, that map one to one."""
    out, start = [], 0
    there, back = {}, {}  # value: [other value, windows of the stretch that hold it]

    def count(at: int, by: int) -> None:
        for side, (a, b) in ((there, slots[at]), (back, slots[at][::-1])):
            for x, y in set(zip(a, b, strict=True)):
                entry = side.setdefault(x, [y, 0])
                entry[1] += by
                if not entry[1]:
                    del side[x]

    def meets(at: int) -> bool:
        pairs = set(zip(*slots[at], strict=True))
        return all(there.get(x, (y,))[0] == y and back.get(y, (x,))[0] == x for x, y in pairs)

    for at, (item, doc) in enumerate(slots):
        pairs = set(zip(item, doc, strict=True))
        alone = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
        if alone and meets(at):
            count(at, 1)
            continue
        if at > start:
            out.append((start, at))
        while start < at and not (alone and meets(at)):
            count(start, -1)
            start += 1
        if alone:
            count(at, 1)
        else:
            start = at + 1
    if len(slots) > start:
        out.append((start, len(slots)))
    return out


#: Runs that are judged at once.
RUNS_AT_ONCE = 100
RUNS = "doc_id long, item_id long, text_key long, places array<int>, worded array<int>, verbatim array<int>, n_slots long, n_changed long"


def _judge_runs(min_windows: int):
    """Of each run of windows at one offset: the places that count, those of equal words, and what the slots hold.

    A run that maps one to one counts whole. Of another, windows with the item's own values count, and each
    maximal stretch that maps one to one if it has twice the windows that are needed, as values that changed
    next to a conflict may have met by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few runs at a time, as their windows take some fifty times as much as Python objects
        for batch in (b.slice(at, RUNS_AT_ONCE) for b in batches for at in range(0, b.num_rows, RUNS_AT_ONCE)):
            out = []
            for r in batch.to_pylist():
                met = sorted(r["met"], key=lambda w: (w["place"], w["item_slots"]))
                slots = [(w["item_slots"], w["slots"]) for w in met]
                kept = _stretches(slots)
                if kept != [(0, len(met))]:
                    least = 2 * min(min_windows, max(1, r["item_worded"]))
                    kept = [(a, b) for a, b in kept if len({w["place"] for w in met[a:b] if w["worded"]}) >= least]
                same = {w["place"] for w in met if w["item_slots"] == w["slots"]}
                places = {w["place"] for a, b in kept for w in met[a:b]} | same
                pairs = [{p for i, d in slots[a:b] for p in zip(i, d, strict=True)} for a, b in kept]
                pairs.append({(x, x) for i, d in slots if i == d for x in i})
                worded = places & {w["place"] for w in met if w["worded"]}
                out.append((r["doc_id"], r["item_id"], r["text_key"], sorted(places), sorted(worded), sorted(same), max(map(len, pairs)), max(sum(x != y for x, y in p) for p in pairs)))
            longs, ints = pa.int64(), pa.list_(pa.int32())
            types = (longs, longs, longs, ints, ints, ints, longs, longs)
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "text_key", "places", "worded", "verbatim", "n_slots", "n_changed"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, filter_windows: int = FILTER_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, n_changed, reparameterised: documents that hold an item or much of it.

    Both sides become templates: numbers, names and units give way to typed placeholders. Windows of
    WINDOW template tokens, LITERAL of them words at least, are hash-joined; beside them all windows are
    joined by their lower-case words alone, so a verbatim copy matches whatever its tokens are. A run of windows at one offset
    counts if its slots are consistent: each slot value of the item stands for one value of the document
    and the other way round; so a question with other numbers or names matches, and chance meetings of
    placeholders do not. Of a run that is not consistent, the windows whose values are the item's own
    count, and each maximal consistent stretch of twice the windows needed. A document leaks an item if
    what counts covers as many windows as min_tokens tokens have, or all of a shorter item's: of all windows
    if their words are equal, else of those with a template. An item of fewer than WINDOW tokens matches
    as a whole, of fewer than LITERAL by its words only.

    Null and empty texts match nothing. Rows that share a doc_id, or have none, are judged each by its own
    text and reported as one, by the greatest figures; repeated items match each. Where the benchmark's
    distinct windows are few (counted first) they filter the scan; otherwise all of the documents' windows
    are shuffled.
    """
    bound_batches(docs.sparkSession)
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(_window_rows(list(range(1, WINDOW + 1)), None, True, "item_id"), MATCHES))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    hashes = items.select("window").distinct()
    wanted = np.sort(np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64)) if fits(hashes, filter_windows * 24) else None
    if not lengths:
        lengths, wanted = [WINDOW], np.zeros(1, np.uint64)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(_window_rows(lengths, wanted, False, "doc_id"), MATCHES)
    totals = items.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("place").alias("item_windows"), F.count_distinct(F.when(F.col("worded"), F.col("place"))).alias("item_worded"))
    mine = items.select(F.col("id").alias("item_id"), "window", "length", "worded", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = lookup(found.withColumnRenamed("id", "doc_id").drop("worded"), mine, ["window", "length"], "inner")
    window = F.struct(F.col("item_place").alias("place"), "worded", "item_slots", "slots")
    run = met.groupBy("doc_id", "text_key", "item_id", (F.col("place") - F.col("item_place")).alias("offset")).agg(F.collect_set(window).alias("met"))
    min_windows = max(1, min_tokens - WINDOW + 1)
    judged = lookup(run.drop("offset"), totals, "item_id", "inner").mapInArrow(_judge_runs(min_windows), RUNS)
    union = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name)))).cast("long")
    each = judged.groupBy("doc_id", "text_key", "item_id").agg(
        union("places").alias("n_windows"), union("worded").alias("n_worded"), union("verbatim").alias("n_verbatim"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed")
    )
    enough = lambda n, of: (F.col(n) > 0) & (F.col(n) >= F.least(F.lit(min_windows), F.col(of)))
    leaks = lookup(each, totals, "item_id", "inner").where(enough("n_worded", "item_worded") | enough("n_verbatim", "item_windows"))
    found = leaks.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("n_windows", "item_windows", "n_slots", "n_changed")])
    return found.withColumn("reparameterised", F.col("n_changed") > 0)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak a benchmark item, columns as they are, whatever their names."""
    name = unused("leak_id", docs)
    leaked = cut(find_leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct())
    return lookup(docs, leaked, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
