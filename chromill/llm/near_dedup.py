"""Near duplicates by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, lookup, release, unused
from .components import components
from .tokens import fold, shingle_sets, slices

#: Bands of ROWS minima each: two texts of similarity 0.8 share none with a chance of 4.7e-7.
BANDS, ROWS = 48, 6
#: Low bits kept of each minimum, packed into longs.
BITS = 2
_N = BANDS * ROWS
_LONGS = _N * BITS // 64
#: Standard errors by which an estimate may fall short of the threshold before the pair is dropped.
MARGIN = 6.0
#: Shingles of the sample, expected, from which the order of shingles is taken.
ORDER_SHINGLES = 1_000_000
#: Ratio of the sizes of a class.
SIZE_CLASS = 1.1
#: Members of a bucket up to which signatures are compared within it.
SMALL = 64
#: A side of a join of narrow rows is broadcast up to so many bytes: the driver holds a table of them, and shuffling such rows costs little.
NARROW_BYTES = 8 << 20
_NO_ID = -(2**63)

_draw = np.random.default_rng(20240607)
_A = _draw.integers(0, 1 << 31, _N, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _draw.integers(0, 1 << 32, _N, dtype=np.uint32)


def _minima(shingles: np.ndarray) -> np.ndarray:
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(_N, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def _bands(minima: np.ndarray) -> np.ndarray:
    rows, key = minima.reshape(BANDS, ROWS).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = fold(key, rows[:, j])
    return key.view(np.int64)


def _packed(minima: np.ndarray) -> np.ndarray:
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(_LONGS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, s1, s2, bands, sigs = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                whole = xxhash.xxh3_128_digest(s.tobytes())
                s1.append(int.from_bytes(whole[:8], "little", signed=True))
                s2.append(int.from_bytes(whole[8:], "little", signed=True))
                minima = _minima(s) if len(s) else None
                bands.append(None if minima is None else _bands(minima))
                sigs.append(None if minima is None else _packed(minima))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, longs), pa.array(sigs, longs)],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "sig"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def _confirmed(percent: int) -> F.Column:
    """Whether 100 |u and v| >= percent |u or v|, in the JVM, so that no Arrow batch holds many pairs of sets."""
    both = F.size(F.array_intersect("set_u", "set_v"))
    return both * 100 >= (F.size("set_u") + F.size("set_v") - both) * percent


def _least_estimate(percent: int) -> float:
    """The smallest estimate that is checked: the threshold less MARGIN standard errors."""
    j = percent / 100
    chance = 2.0**-BITS
    raw = j + (1 - j) * chance
    return j - MARGIN * (raw * (1 - raw) / _N) ** 0.5 / (1 - chance)


def _most_unequal(percent: int) -> int:
    """The largest number of unequal packed minima that is checked, with chance collisions allowed for."""
    chance = 2.0**-BITS
    raw = _least_estimate(percent) * (1 - chance) + chance
    return int(_N * (1 - raw))


_ODD_BITS = 0x5555555555555555


def _unequal(a: str, b: str) -> F.Column:
    """Minima whose kept bits differ, by counting bits of the packed signatures."""
    return F.expr(" + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & {_ODD_BITS}L)" for i in range(_LONGS)))


def _prefixes(k: int, percent: int, common: np.ndarray, often: np.ndarray):
    """Rows (token, node, comp, n, at): of each set of n shingles those that come first in a fixed order, and their places.

    The order is by how often a shingle was met (common, sorted, and often), then by its hash. Two sets that
    share percent of their union share one of these, whatever the order is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            token, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
            met = np.zeros(len(token), np.int64)
            if len(common):
                near = np.minimum(np.searchsorted(common, token), len(common) - 1)
                met = np.where(common[near] == token, often[near], 0)
            order = np.lexsort((token, met, owner))
            at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = at <= np.repeat(sizes - -(-sizes * percent // 100), sizes)
            own = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[order][first].view(np.int64)), batch.column("doc_id").take(own), batch.column("comp").take(own), pa.array(np.repeat(sizes, sizes)[first]), pa.array(at[first])],
                names=["token", "node", "comp", "n", "at"],
            )

    return run


def _shingle_sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    wanted = cut(ids.select(F.col("node").alias("doc_id")).distinct())
    return lookup(docs, wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "node long, set array<long>")


def _confirm(docs: DataFrame, pairs: DataFrame, sigs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct pairs (u, v) those that link: first by the estimate from packed signatures, then on full sets."""
    both = pairs.join(sigs.toDF("u", "sig_u"), "u").join(sigs.toDF("v", "sig_v"), "v")
    likely = cut(both.where(_unequal("sig_u", "sig_v") <= _most_unequal(percent)).select("u", "v"))
    sets = _shingle_sets_of(docs, likely.select(F.col("u").alias("node")).unionByName(likely.select(F.col("v").alias("node"))), k)
    checked = likely.join(sets.toDF("u", "set_u"), "u").join(sets.toDF("v", "set_v"), "v")
    return cut(checked.where(_confirmed(percent)).select("u", "v"))


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_copies for every row of docs.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; documents whose sets of k-word
    shingles have 100 |A and B| >= percent |A or B| are linked. component_id is the smallest doc_id
    reachable, and the document with that id is kept. A text of fewer than k words has one shingle; one
    without words, or null, has none and is linked with nothing. Rows that share a doc_id are one
    document with several texts; null ids share one. An empty table gives no rows; other columns are not read.

    Equal sets form a class, and only its first document goes on. Band keys of the minima make buckets;
    in each, members are compared with the smallest one by bit counts of packed signatures, then on full
    sets. Where a bucket's members are still in several components, _across finds every link between
    them without pairing the members. So no link inside a bucket is lost, and no task holds a bucket.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    sketches = cut(docs.mapInArrow(_sketch(k), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>"))
    classes = cut(sketches.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    named = lookup(sketches, classes, ["s1", "s2"], most=NARROW_BYTES).withColumn("rep", F.coalesce("rep", "doc_id")).withColumn("n_copies", F.coalesce("n", F.lit(1)))
    named = named.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    reps = named.where("doc_id = rep AND n_shingles > 0").select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sig")
    sigs = reps.select("node", "sig")

    banded = reps.select("node", F.explode("bands").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader != last").select("key", "leader"))
    members = cut(lookup(banded, shared, "key", "inner", NARROW_BYTES).where("node != leader"))
    release(docs.sparkSession)
    links = _confirm(docs, members.select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), sigs, k, percent)

    # rows that share an id hold their classes together
    shared_id = named.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi")
    links = cut(links.unionByName(named.join(shared_id, "doc_id").select(F.col("rep").alias("u"), F.col("lo").alias("v")).where("u != v").distinct()))
    release(docs.sparkSession)
    found = cut(components(links))
    release(docs.sparkSession)

    apart = _apart(members, found, sigs, percent)
    if not apart.isEmpty():
        pairs = _across(docs, apart, reps, k, percent)
        release(docs.sparkSession)
        links = links.unionByName(_confirm(docs, pairs, sigs, k, percent))
        found = cut(components(cut(links)))
    release(docs.sparkSession)
    joined = named.select("doc_id", "n_shingles", "rep", "n_copies").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    clean = lambda c: F.when(c != _NO_ID, c)
    return joined.select(clean(F.col("doc_id")).alias("doc_id"), "n_shingles", clean(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"), "n_copies")


def _apart(members: DataFrame, found: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the members, but for the smallest, of buckets in which they lie in several components.

    Texts that have little in common meet in small buckets by chance, the more of them the larger the corpus is. So of a
    bucket of up to SMALL members only those stay whose signature is near that of one in another component.
    """
    placed = cut(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")))
    several = cut(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).where("lo != hi").select("key", "held"))
    inside = cut(lookup(placed, several, "key", "inner", NARROW_BYTES))
    large = inside.where(F.col("held") > SMALL).select("node", "comp")
    small = inside.where(F.col("held") <= SMALL)
    signed = small.join(sigs, "node")
    one, other = (signed.select("key", F.col("node").alias(f"{x}"), F.col("comp").alias(f"comp_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "uv")
    near = one.join(other, "key").where((F.col("u") < F.col("v")) & (F.col("comp_u") != F.col("comp_v")) & (_unequal("sig_u", "sig_v") <= _most_unequal(percent)))
    met = near.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("comp_u").alias("comp")), F.struct(F.col("v").alias("node"), F.col("comp_v").alias("comp")))).alias("x")).select("x.*")
    return cut(large.unionByName(met).distinct())


def _across(docs: DataFrame, apart: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Distinct pairs (u, v) of nodes of different components, with every pair among them that links.

    An exact similarity join on the first shingles of each set, in an order that puts rare ones first. Let
    t be the first shingle that two sets of n and m share, at places i and j: they share n - i at most, and
    m - j, so linking bounds m by n and i, and n by m and j. Copies of one text that do not link differ by
    more shingles than that leaves, so their first ones are their own rare ones and few pairs meet, however
    large the group is. Of a shingle's sets, those of its most frequent component are only looked up, by
    those of other components, in classes of the sizes that the bound allows.

    The order comes from a sample of about ORDER_SHINGLES shingles. It settles how many pairs meet, not which link.
    """
    nodes = cut(apart.join(reps.select("node", "n_shingles"), "node"))
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, ORDER_SHINGLES / max(total, 1)))))
    met = _shingle_sets_of(docs, drawn, k).select(F.explode("set").alias("token")).groupBy("token").count().where("count > 1").toArrow()
    common, often = met["token"].to_numpy().view(np.uint64), met["count"].to_numpy()
    order = np.argsort(common)
    wanted = nodes.select(F.col("node").alias("doc_id"), "comp")
    first = lookup(docs, wanted, "doc_id", "inner").mapInArrow(_prefixes(k, percent, common[order], often[order]), "token long, node long, comp long, n long, at long")
    first = cut(first)
    release(docs.sparkSession)

    per = first.groupBy("token", "comp").agg(F.count("*").alias("held")).groupBy("token")
    mixed = cut(per.agg(F.max_by("comp", F.struct("held", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("token", "main"))
    rows = lookup(first, mixed, "token", "inner", NARROW_BYTES)
    # the largest size of a set that can link with this one through this shingle
    rows = cut(rows.withColumn("most", F.expr(f"(n * 100 - at * {100 + percent}) DIV {percent}")))
    step = lambda n: F.floor(F.log(n.cast("double")) / F.lit(np.log(SIZE_CLASS))).cast("int")
    least = F.expr(f"(n * {percent} + 99) DIV 100")
    most = F.least("most", F.expr(f"n * 100 DIV {percent}"))
    probes = rows.where((F.col("comp") != F.col("main")) & (least <= most))
    probes = probes.select("token", F.explode(F.sequence(step(least), step(most))).alias("class"), F.struct("node", "comp", "n", "most").alias("x"))
    stock = rows.select("token", step(F.col("n")).alias("class"), F.struct("node", "comp", "n", "most").alias("y"))
    pairs = probes.join(stock, ["token", "class"]).where("x.comp != y.comp AND y.n <= x.most AND x.n <= y.most")
    return cut(pairs.select(F.greatest("x.node", "y.node").alias("u"), F.least("x.node", "y.node").alias("v")).where("u != v").distinct())


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that link() does not keep: one document of each component stays, columns as they are, whatever their names."""
    name = unused("gone_id", docs)
    gone = cut(link(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct())
    return lookup(docs, gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
