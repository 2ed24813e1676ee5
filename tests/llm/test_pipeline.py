import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "Subscribe to our letters today and never miss an offer again, dear reader number 7."
ITEMS = ["A tired old miller walks slowly along the river bank until he meets seven geese and asks them kindly for the way", "who owns the quixotic zebra of Timbuktu"]


def table(seed=3):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9)))
    fresh = lambda n: [word() for _ in range(n)]
    rows, n = [], 0

    def add(text, source):
        nonlocal n
        rows.append((n, text, "en", source, len(text) if text is not None else None))
        n += 1

    for i in range(60):
        add(" ".join(fresh(draw.randint(30, 80))), ["a", "b", "c", None][i % 4])
    for _ in range(30):  # boilerplate of one host
        add(f"{LINE.replace('7', str(draw.randint(1, 99)))}\n" + " ".join(fresh(40)), "h")
    add(f"{LINE}\nshort tail of other words", "h")
    for _ in range(4):  # exact and near copies
        base = fresh(70)
        for _ in range(5):
            own = list(base)
            for _ in range(draw.randint(0, 2)):
                own[draw.randrange(70)] = word()
            add(" ".join(own), draw.choice(["a", "b"]))
    for item in ITEMS:
        add(" ".join(fresh(30)) + " " + item + " " + " ".join(fresh(30)), "c")
    for text in (None, "", " \n", "one two", "again and again " * 40, "x" * 5000):
        add(text, "a")
    rows.append((None, " ".join(fresh(50)), "en", "b", 1))
    return rows


def plain_quality(rows):
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]
    normal = lambda x: re.sub("[0-9]+", "0", " ".join(words(x.lower())))
    filled = lambda t: [x for x in (t or "").split("\n") if words(x)]
    held, texts = Counter(), Counter()
    for source, text in {(r[3], r[1]) for r in rows if filled(r[1])}:
        texts[source] += 1
        held.update({(source, normal(x)) for x in filled(text)})
    frequent = {k for k, n in held.items() if n > 20 and n > 0.1 * texts[k[0]]}
    out = []
    for r in rows:
        w = words(r[1])
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = {x for x, n in Counter(wins).items() if n > 1}
        repeated = len({j for i, x in enumerate(wins) if x in often for j in range(i, i + 8)})
        lines = {normal(x) for x in filled(r[1])}
        left = sum(len(x) for x in lines if (r[3], x) not in frequent)
        if len(w) < 20 or 100 * repeated > 30 * len(w) or left < 0.5 * sum(map(len, lines)):
            continue
        text = "\n".join(x for x in r[1].split("\n") if (r[3], normal(x)) not in frequent) if any(s == r[3] for s, _ in frequent) else r[1]
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def plain_dedup(rows):
    kept = brute([(r[0], r[1]) for r in rows if r[0] is not None], 5, 80)
    return [r for r in rows if r[0] is None or kept[r[0]][1] == r[0]]


def plain_leaks(rows):
    def leaks(text):
        w = text.lower().split()
        for item in ITEMS:
            i = item.lower().split()
            k = min(13, len(i))
            grams = {tuple(i[j : j + k]) for j in range(len(i) - k + 1)}
            if any(tuple(w[j : j + k]) in grams for j in range(len(w) - k + 1)):
                return True
        return False

    return [r for r in rows if not leaks(r[1])]


def plain_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    out = []
    for r in rows:
        rate = target[r[3]] / sizes[r[3]]
        draw = int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (int(rate) + (draw < rate - int(rate)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(table(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_plain_versions(spark, folder):
    rows = table()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sorted_rows = lambda x: sorted((tuple(r) for r in x), key=repr)
    for (_, stage), plain in zip(corpus_pipeline.STAGES, (plain_quality, plain_dedup, plain_leaks, plain_mix), strict=False):
        before, rows, docs = len(rows), plain(rows), stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted_rows(docs.collect()) == sorted_rows(rows) and before != len(rows)
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"]
    got = final.collect()
    assert sorted_rows(r[:5] for r in got) == sorted_rows(rows) and all(r["size"] == len(r.text.encode()) + 1 for r in got)
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


CLASH = ["gone_id", "leak_id", "gone_host", "GONE_1", "of_host", "strip_hashes", "mix_source_key", "mix_plan", "mix_copy_no", "in_range", "shard_range", "row", "first", "last", "low", "kept", "copies", "component_id", "host", "key_1", "n", "a.b"]


def test_extra_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, folder)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        for r in out.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c}:{r.doc_id}") for c in CLASH), name


def test_empty_tables_and_nulls(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "", None, None, None)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        assert stage(spark, nulls, folder).count() <= 4
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).count() == docs.count()


def test_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40")
    twice = docs.unionByName(docs)
    for _, stage in corpus_pipeline.STAGES[:4]:
        once, both = stage(spark, docs, folder), stage(spark, twice, folder)
        assert sorted(map(repr, both.collect())) == sorted(map(repr, once.unionByName(once).collect()))
