"""Quality rules: figures of each document, and how often its lines occur in others of its host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, columns, cut, lookup, unused

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
#: Words in windows that occur again, in percent of all words, above which a text fails.
MAX_REPEATED = 30
WINDOW = 8
#: Windows of a text whose places fit into the low bits of their hashes.
SMALL_BITS = 16
SMALL = 1 << SMALL_BITS
#: A line is boilerplate of its host if more distinct documents hold it than this share of the host's, and than this number.
LINE_SHARE = 0.1
LINE_FLOOR = 20
#: A document is depleted if boilerplate leaves less than this share of its lines' characters.
MIN_LEFT = 0.5

_WHITE_SQL = WHITE.encode("unicode_escape").decode().replace("'", "\\'")


def _normal(line: F.Column) -> F.Column:
    """Lower case, digit runs as 0, white space collapsed; single spaces, which are most of it, match nothing."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "), "[0-9]+", "0"))


def _figures(docs: DataFrame, host: str) -> DataFrame:
    """One narrow row per document: its figures, a key of its text, and (hash, characters) of its distinct lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cutup = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        F.xxhash64(text).alias("key_1"),
        F.xxhash64(F.lit(1), text).alias("key_2"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"),
    )
    hashed = cutup.select(
        "doc_id", "host", "key_1", "key_2", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.array_distinct(F.transform(F.transform("lines", _normal), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars")))).alias("lines"),
    )
    in_window = ", ".join(f"hashes[i + {j}]" for j in range(WINDOW))
    windows = F.expr(f"CASE WHEN size(hashes) >= {WINDOW} THEN transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({in_window})) ELSE array() END")
    hashed = hashed.withColumn("windows", windows).drop("hashes").withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    # window hashes are sorted with their places; equal neighbours repeat. Up to SMALL windows the places go into the low
    # bits, which leaves 48 bits of hash; beyond, pairs of the whole hash and the place are sorted
    tagged = hashed.withColumn("packed", F.expr(f"CASE WHEN again AND size(windows) <= {SMALL} THEN sort_array(transform(windows, (h, i) -> shiftleft(h, {SMALL_BITS}) | cast(i as bigint))) ELSE array() END"))
    tagged = tagged.withColumn("pairs", F.expr(f"CASE WHEN again AND size(windows) > {SMALL} THEN sort_array(transform(windows, (h, i) -> struct(h AS h, cast(i as bigint) AS i))) ELSE cast(array() AS array<struct<h:bigint,i:bigint>>) END")).drop("windows", "again")
    same = f"shiftright(x, {SMALL_BITS}) = shiftright(get(packed, i {{0}} 1), {SMALL_BITS})"
    placed = tagged.withColumn(
        "places",
        F.expr(
            f"CASE WHEN size(pairs) > 0 THEN sort_array(transform(filter(pairs, (x, i) -> x.h = get(pairs, i - 1).h OR x.h = get(pairs, i + 1).h), x -> x.i))"
            f" ELSE sort_array(transform(filter(packed, (x, i) -> {same.format('-')} OR {same.format('+')}), x -> x & {(1 << SMALL_BITS) - 1}L)) END"
        ),
    ).drop("packed", "pairs")
    covered = F.expr(f"CASE WHEN size(places) = 0 THEN 0L ELSE aggregate(sequence(0, size(places) - 1), 0L, (n, i) -> n + coalesce(least({WINDOW}L, get(places, i + 1) - get(places, i)), {WINDOW}L)) END")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return placed.withColumn("n_repeat_words", covered).drop("places").withColumn("base_failed", failed)


def _judged(docs: DataFrame, host: str, line_share: float, line_floor: int, min_left: float) -> tuple[DataFrame, DataFrame]:
    """What judge() gives, and the frequent lines behind it as (of_host, of_line) hashes."""
    figures = cut(_figures(docs, host))
    contents = figures.where(F.size("lines") > 0).groupBy("host", "key_1", "key_2").agg(F.first("lines").alias("lines"))
    contents = cut(contents)
    hosts = contents.groupBy("host").agg(F.count("*").alias("texts")).withColumnRenamed("host", "of_host")
    lines = contents.select("host", "key_1", "key_2", F.explode("lines").alias("l")).select("host", "key_1", "key_2", "l.*")
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") > line_floor)
    frequent = lookup(cut(counted), hosts, F.col("host").eqNullSafe(F.col("of_host")), "inner")
    frequent = cut(frequent.where(F.col("held") > F.col("texts") * line_share).select(F.col("host").alias("of_host"), F.col("line").alias("of_line")))
    on = F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line") == F.col("of_line"))
    lost = lookup(lines, frequent, on, "inner").groupBy("host", "key_1", "key_2").agg(F.sum("chars").alias("lost"))
    lost = cut(lost).select(F.col("host").alias("of_host"), F.col("key_1").alias("of_1"), F.col("key_2").alias("of_2"), "lost")
    on = F.col("host").eqNullSafe(F.col("of_host")) & (F.col("key_1") == F.col("of_1")) & (F.col("key_2") == F.col("of_2"))
    chars = F.expr("aggregate(lines, 0L, (n, l) -> n + l.chars)")
    judged = lookup(figures.withColumn("chars", chars).drop("lines"), lost, on).drop("of_host", "of_1", "of_2")
    left = F.col("chars") - F.coalesce("lost", F.lit(0))
    judged = judged.withColumn("chars_left", left).withColumn("kept", ~F.col("base_failed") & (left >= F.col("chars") * min_left)).drop("lost")
    return judged, frequent


def judge(docs: DataFrame, host: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, host, key_1, key_2 (of the text), the figures, base_failed, chars, chars_left and kept, a row per document.

    Lines are normalised and hashed. Of each host, the distinct documents (texts: copies count once) that
    hold a line are counted; lines in more than line_floor and line_share of the host's documents are
    boilerplate. A document is rejected if it fails the base rules or if boilerplate leaves less than
    min_left of its characters. Null and empty texts have no words and fail. A null host is a host of its
    own; repeated rows are judged alike. An empty table gives no rows; other columns are not read.
    """
    return _judged(docs, host, line_share, line_floor, min_left)[0]


def _kept(docs: DataFrame, judged: DataFrame, host: str) -> DataFrame:
    of_host, one, two = (unused(n, docs) for n in ("gone_host", "gone_1", "gone_2"))
    gone = cut(judged.where(~F.col("kept")).select(F.col("host").alias(of_host), F.col("key_1").alias(one), F.col("key_2").alias(two)).distinct())
    text = F.coalesce(F.col("text"), F.lit(""))
    on = F.col(host).eqNullSafe(F.col(of_host)) & (F.xxhash64(text) == F.col(one)) & (F.xxhash64(F.lit(1), text) == F.col(two))
    return lookup(docs, gone, on, "left_anti")


def keep(docs: DataFrame, host: str = "source", **how) -> DataFrame:
    """The documents that judge() keeps, with docs' columns, whatever their names. Texts stay as they are."""
    return _kept(docs, judge(docs, host, **how), host)


def clean(docs: DataFrame, host: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that judge() keeps, without the boilerplate lines it counted; columns as they are, n_chars counted anew if there."""
    judged, frequent = _judged(docs, host, line_share, line_floor, min_left)
    left = strip_lines(_kept(docs, judged, host), frequent, host)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def strip_lines(docs: DataFrame, frequent: DataFrame, host: str = "source") -> DataFrame:
    """docs with boilerplate lines cut out of their texts; frequent holds (of_host, of_line) hashes.

    A host's line hashes come as one array, so no text is exploded; a host without any keeps its texts.
    All columns of docs stay in their places, whatever their names.
    """
    key, held = unused("of_host", docs), unused("strip_hashes", docs)
    sets = frequent.groupBy(F.col("of_host").alias(key)).agg(F.collect_set("of_line").alias(held))
    joined = lookup(docs, cut(sets), F.col(host).eqNullSafe(F.col(key)))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains(held, F.xxhash64(_normal(x))), F.lit(False)))
    text = F.when(F.col(held).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(n) if n == "text" else c for n, c in zip(docs.columns, columns(docs), strict=True)])
