import random

import pytest
from pyspark.sql import functions as F

from chromill.llm import near_dedup, tokens
from chromill.llm.components import components


def brute(rows, k, percent):
    """Smallest id reachable over links of shingle sets, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    draw = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(12, 60))]
        for _ in range(draw.randint(1, 12)):
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((n, " ".join(own) if draw.random() < 0.8 else "\t".join(own).upper()))
            n += 1
    return rows


@pytest.mark.parametrize("slice_bytes", [2 << 20, 500])
@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, monkeypatch, k, slice_bytes):
    monkeypatch.setattr(tokens, "SLICE_BYTES", slice_bytes)
    rows = [*corpus(), (900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two three " * 4000), (906, "one two three " * 4000 + "x"), (907, "é\x1cü")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), k, 80).collect()}
    assert got == brute(rows, k, 80)


def test_leader_that_links_to_nobody_loses_no_link(spark):
    # copies differ from one another but not much from the base, which has the largest id; all share buckets
    base = ["b%d" % i for i in range(200)]
    rows = []
    for i in range(12):
        own = list(base)
        for j in range(8):
            own[(i * 16 + j * 2 + 5) % 200] = f"x{i}_{j}"
        rows.append((i, " ".join(own)))
    rows.append((99, " ".join(base)))
    got = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.link(empty).count() == 0 and near_dedup.dedup(empty).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "p q r s t", "z"), (3, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    linked = near_dedup.link(df)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in linked.collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]


def test_rows_of_one_id_hold_their_classes_together(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (7, "v w x y z")], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.link(df).collect()} == {1}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_estimated_sizes_do_not_grow_by_round(spark):
    links = spark.range(299).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = components(links)
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 300)}
    bits = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert bits < 1000, f"planning handles sizes of {bits} bits"


def test_estimate_bounds():
    assert near_dedup._least_estimate(80) < 0.66 and near_dedup._most_unequal(80) > 0.2 * near_dedup._N


def test_word_hashes_do_not_depend_on_slices():
    import pyarrow as pa

    texts = ["a b c", None, "", "  x  y", "é ñ a"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    whole = tokens.shingle_sets(pa.array(texts), 2)
    old, tokens.SLICE_BYTES = tokens.SLICE_BYTES, 7
    try:
        parts = [s for b in tokens.slices(iter([batch])) for s in tokens.shingle_sets(b.column("text"), 2)]
    finally:
        tokens.SLICE_BYTES = old
    assert len(parts) == len(whole) and all((a == b).all() for a, b in zip(whole, parts, strict=True))


def near_copies(words, n, changes, seed, start=0):
    """n copies of one text with random words changed; none of them is the text itself."""
    draw = random.Random(seed)
    base = ["b%d" % i for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(draw.randint(*changes)):
            own[draw.randrange(words)] = "x%d" % draw.randrange(10**6)
        if draw.random() < 0.3:
            own = own[: draw.randint(words * 8 // 10, words)]
        rows.append((start + i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("order", "small"), [(1_000_000, 64), (50, 0), (50, 10_000)])
def test_large_groups_of_near_copies(spark, monkeypatch, order, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    # around the threshold, so that buckets hold several components, single ones and links that no leader finds
    monkeypatch.setattr(near_dedup, "ORDER_SHINGLES", order)
    rows = near_copies(120, 250, (4, 18), 1) + near_copies(90, 150, (6, 12), 2, 1000)
    got = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, F.col("doc_id")), 2, 80).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_across_finds_every_link_between_components(spark, percent):
    rows = near_copies(60, 120, (0, 14), 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for i, t in rows}
    nodes = spark.createDataFrame([(i, i % 7) for i, _ in rows], "node long, comp long")
    reps = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "node long, n_shingles long")
    want = {(a, b) for a in sets for b in sets if a > b and a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    got = {(r.u, r.v) for r in near_dedup._across(df, nodes, reps, 2, percent).collect()}
    assert want and want <= got and all(a > b and a % 7 != b % 7 for a, b in got)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2)], "doc_id long, text string, gone_id string, Component_ID int")
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", "x", 1)]


def test_broadcast_bound_counts_bytes(spark):
    from chromill.llm.common import fits

    df = spark.createDataFrame([(i, "x" * 1000, [1, 2]) for i in range(100)], "a long, b string, c array<int>")
    assert fits(df, 200_000) and not fits(df, 100_000) and not fits(df, 2_000) and fits(df.limit(0), 0)
