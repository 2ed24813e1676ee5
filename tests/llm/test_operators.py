import base64
import bisect
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chromill.llm import chat, decontam, mixing, pii, quality_model, quality_rules, queries, sharding, token_count, tokens, warc

DOCS = "doc_id long, text string"


def test_targets_share_and_stop(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 100)], "source string, size long")
    got = {r.source: r for r in mixing.source_targets(sizes).collect()}
    assert got["a"].target == 30 and got["d"].target == 0 and got["d"].rate == 0
    assert sum(r.target for r in got.values()) == pytest.approx(2110) and all(r.target <= 3 * r.source_size for r in got.values())
    assert got["b"].target == pytest.approx(2 * got["c"].target) and got[None].weight == 2


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 40 else "b", "x") for i in range(400)], "doc_id long, text string, source string, copies string")
    planned = mixing.plan_copies(df)
    assert planned.agg(F.sum("copies")).first()[0] == pytest.approx(400, abs=60)
    assert planned.where("source = 'a' AND copies != 3").count() == 0
    assert sorted(map(tuple, planned.collect())) == sorted(map(tuple, mixing.plan_copies(df.repartition(7)).collect()))
    mixed = mixing.mix(df.drop("copies"))
    assert mixed.columns == ["doc_id", "text", "source"] and mixed.count() == planned.agg(F.sum("copies")).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0


def test_warc_files_are_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", ["same", "é\r\n\r\nx", None][i % 3]) for i in range(9)], "page_id long, url string, html string")
    warc.write_deduplicated(df, str(tmp_path / "w"))
    records = [x for f in Path(tmp_path / "w").glob("part-*") for x in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len(records) == 9 and sum(h["warc-type"] == "revisit" for h, _ in records) == 6
    for head, block in records:
        http, _, body = bytes(block).partition(b"\r\n\r\n")
        if head["warc-type"] == "response":
            assert head["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert body == b"" and head["warc-refers-to"] in {h["warc-record-id"] for h, _ in records}
    back = warc.read_archive(spark, str(tmp_path / "w"))
    assert {bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()} == {"same", "é\r\n\r\nx", ""}
    assert warc.resolve(back).where("refers_to IS NOT NULL").count() == 6


def test_warc_of_nothing(spark, tmp_path):
    warc.write_deduplicated(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.resolve(warc.read_archive(spark, str(tmp_path / "w"))).count() == 0
    assert warc._members(gzip.compress(b"ab") + gzip.compress(b"cd")) == b"abcd"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


ITEM = "A train leaves Paris with 120 people on board and travels 300 km in 4 hours before it stops; how fast did Anna ride in the train?"
SWAPPED = "A train leaves Lyon with 90 people on board and travels 250 km in 7 hours before it stops; how fast did Berta ride in the train?"
CROSSED = ITEM.replace("120", "7").replace("300", "7").replace("4 ", "7 ")


def test_leaks(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny item of ours"), (3, None), (4, "")], "item_id long, text string")
    filler = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, filler + " " + ITEM + " " + filler), (2, filler + " " + SWAPPED), (3, filler), (4, None), (5, "so a tiny item of ours it is"), (6, " ".join(ITEM.split()[:9])), (7, ITEM.upper()), (None, ITEM), (8, CROSSED)], DOCS
    )
    for limit in (10_000, 0):  # with and without a filter at the scan
        got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.find_leaks(docs, bench, filter_windows=limit).collect()}
        assert got == {(1, 1): False, (2, 1): True, (5, 2): False, (7, 1): False, (None, 1): False}
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, bench).collect()) == [3, 4, 6, 8]
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_runs_with_a_conflict(spark):
    words = [f"w{i}x" for i in range(52)]
    item = " ".join(["the", *words[:10], "Anna", *words[10:45], "Anna", *words[45:]])
    berta = "Berta".join(item.rsplit("Anna", 1))
    numbers = "there were 12 " + " ".join(words[:20]) + " and 34 " + " ".join(words[20:40])
    bench = spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")
    carla = berta.replace("Anna", "Carla")  # changed throughout and in conflict
    docs = spark.createDataFrame([(1, berta), (2, numbers.replace("34", "12")), (3, carla), (4, " ".join(words[:9])), (None, item), (None, item.replace("Anna", "Dora")), (5, item), (5, berta)], DOCS)
    for limit in (10_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, filter_windows=limit).collect()}
        assert {(1, 1), (2, 2), (3, 1), (None, 1), (5, 1)} <= got and 4 not in {d for d, _ in got}
    assert decontam._stretches([([1], [1]), ([1], [2]), ([1, 2], [2, 2]), ([3], [2]), ([], [])]) == [(0, 1), (1, 2), (3, 5)]


def test_leaks_of_items_with_few_words(spark):
    items = ["Add 12 34 56 78 90 to 11 22 33 44 55 then halve 10 20 30 40 50 60", "Anna has 3 pears", "quixotic zebra", "Halve 7"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    mixed = "so it says 1 2 3 4 5 6 7 8 are the digits we all know"
    bench = bench.union(spark.createDataFrame([(9, mixed + " and " + " ".join(f"w{i}x" for i in range(20)))], bench.schema))
    docs = spark.createDataFrame([(i, f"before it {x} and after") for i, x in enumerate(items)] + [(9, mixed), (10, "before it and after 12 34 56 78 90"), (11, None)], DOCS)
    for limit in (10_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, filter_windows=limit).collect()}
        assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (9, 9)}


def test_leaks_whatever_stands_before_and_in_any_case(spark):
    river = "What river flows past the old mill town near the border today?"
    names = "Anna met Berta while Carla saw Dora then Emma told Fritz that Gerda left Hanna"
    days = "Days pass slowly for 3 old men who wait outside"
    bench = spark.createDataFrame([(1, river), (2, names), (3, days), (4, "Name the big river")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "a heading line\n" + river), (2, "so " + names.lower() + " it says"), (3, "it took 5 " + days), (4, "a heading line\n" + days.replace("3", "4")), (5, "an unstopped line\nName the big river"), (6, river.lower()), (7, "What river flows")], DOCS
    )
    for limit in (10_000, 0):
        got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.find_leaks(docs, bench, filter_windows=limit).collect()}
        assert got == {(1, 1): False, (2, 2): False, (3, 3): False, (4, 3): True, (5, 4): False, (6, 1): False}


def test_leaks_equal_word_overlap_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    grams = {}
    for r in bench.collect():
        w = r.text.lower().split()
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = r.text.lower().split()
        want |= {(r.doc_id, b) for i in range(len(w) - 12) for b in grams.get(tuple(w[i : i + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in queries.op3_template_leaks(spark, folder).collect()} == want


def test_boilerplate_depletes(spark):
    line = "Subscribe to our newsletter today and never miss an offer again, dear reader number 7."
    own = lambda i: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j % 26) + chr(97 + j // 26) for j in range(30))
    rows = [(i, f"{line}\n{own(i)}", "h") for i in range(40)] + [(100, f"{line.replace('7', '8')}\nshort own and other words of a page", "h"), (101, f"{line}\nand a few more words of it", "other")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS + ", source string")).collect()}
    assert all(got[i].kept for i in range(40)) and not got[100].kept and not got[100].base_failed and got[101].kept
    kept = quality_rules.keep(spark.createDataFrame(rows, DOCS + ", source string"))
    assert kept.columns == ["doc_id", "text", "source"] and kept.count() == 41
    hashes = spark.createDataFrame([("h",)], "of_host string").select("of_host", F.xxhash64(quality_rules._normal(F.lit(line))).alias("of_line"))
    stripped = {r.doc_id: r.text for r in quality_rules.strip_lines(spark.createDataFrame(rows, DOCS + ", source string"), hashes).collect()}
    assert stripped[3] == own(3) and stripped[100] == "short own and other words of a page" and stripped[101].count(line) == 1


def test_pipeline_cuts_boilerplate(spark):
    line = "Subscribe to our newsletter today and never miss an offer again, dear reader number 7."
    own = lambda i: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j % 26) + chr(97 + j // 26) for j in range(30))
    rows = [(i, f"{line}\n{own(i)}", "h", 1) for i in range(40)] + [(100, f"{line}\nshort", "h", 1), (101, f"{line}\n{own(50)}", "other", 1), (102, None, "h", 0)]
    docs = spark.createDataFrame(rows, DOCS + ", source string, n_chars long")
    cleaned = corpus_pipeline.reject_low_quality(spark, docs, "")
    got = {r.doc_id: r for r in cleaned.collect()}
    assert cleaned.columns == docs.columns and sorted(got) == [*range(40), 101]
    assert all(got[i].text == own(i) and got[i].n_chars == len(own(i)) for i in range(40)) and got[101].text == f"{line}\n{own(50)}"


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15
            if not bad:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_equals_plain_patterns(spark):
    draw = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f.g", "a@b.c@d.e", "x" * 60000 + "@y.z", "1 " * 30000, "9" * 40000, "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111-1111 1111 and 4111  1111 1111 1111", "+1 (017) 555-7713 +123 +1234567890123456", "a@" + "b." * 20000 + "c", "😀 a@b.co 😀 +49 30 1234567"]
    texts += ["".join(draw.choice("a@.-_+() 0123456789\n") for _ in range(200)) for _ in range(300)]
    texts += [" ".join(draw.choice(["4111111111111111", "10.0.0.1", "me@site.org", "+44 20 7946 0958", "word", "token", "1-2 3"]) for _ in range(20)) for _ in range(50)]
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if s.base] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_spans(t), t[:100]


def test_personal_data_adds_and_masks(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, f'token = "{secret}" and me{i}@site.org, call (555) 123-4567 now') for i in range(30)] + [(99, "nothing here at all")]
    df = spark.createDataFrame(rows, DOCS)
    found = pii.detect(df)
    assert {s.kind for r in found.collect() for s in r.spans} == {"email", "secret", "localphone"}
    masked = {r.doc_id: r.text for r in pii.mask(df, found).collect()}
    assert masked[3] == 'token = "<SECRET>" and <EMAIL>, call <LOCALPHONE> now' and masked[99] == "nothing here at all"
    assert pii.detect(df.limit(0)).count() == 0


def test_quality_model_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5000"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_model.score(docs, labels.where("doc_id % 2 = 0")).withColumnsRenamed({"quality": "q", "toxic": "t"})
    held = got.join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = held.agg(F.avg(((F.col("q") >= 0.5) == (F.col("quality") == 1)).cast("double")), F.avg(((F.col("t") > 0.5) == (F.col("toxic") == 1)).cast("double"))).first()
    assert r[0] > 0.9 and r[1] > 0.95


def test_posteriors_of_unannotated_documents_reach_the_scores(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    before = {r.doc_id: (r.quality, r.toxic) for r in quality_model.score(docs, labels).collect()}
    fit = quality_model.fit_label_model

    def other(counts, *how):
        model = fit(counts, *how)
        model.posterior.update({v: 0.123 for v in model.posterior if not v[0]})
        return model

    monkeypatch.setattr(quality_model, "fit_label_model", other)
    after = {r.doc_id: (r.quality, r.toxic) for r in quality_model.score(docs, labels).collect()}
    for column in (0, 1):
        assert sum(abs(before[i][column] - after[i][column]) > 1e-3 for i in before) > 0.7 * len(before)


def test_annotator_is_a_labeller_whose_accuracy_is_estimated():
    # the annotator contradicts four labellers, who agree with one another, in a fifth of its votes
    counts = {(0, 1, 1, 1, 1): 300, (0, -1, -1, -1, -1): 300, (1, 1, 1, 1, 1): 80, (-1, -1, -1, -1, -1): 80, (1, -1, -1, -1, -1): 20, (-1, 1, 1, 1, 1): 20}
    model = quality_model.fit_label_model(counts)
    assert 0.7 < quality_model.fit_label_model(counts, trust=0.0).on_true[0][1] < 0.85 < model.on_true[0][1] < 0.95
    assert model.posterior[(1, -1, -1, -1, -1)] < 0.1 and model.posterior[(-1, 1, 1, 1, 1)] > 0.9


def test_quality_model_without_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 3000"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_model.score(docs).withColumnsRenamed({"quality": "q", "toxic": "t"}).join(labels, "doc_id")
    r = got.agg(F.avg(((F.col("q") >= 0.5) == (F.col("quality") == 1)).cast("double")), F.avg(((F.col("t") > 0.5) == (F.col("toxic") == 1)).cast("double"))).first()
    assert r[0] > 0.95 and r[1] > 0.93


def test_silent_rows_weigh_a_third_of_the_annotators():
    known, found = np.array([True] * 30 + [False] * 70), np.array([True] * 10 + [False] * 20 + [True] * 5 + [False] * 65)
    weights = quality_model.weigh(known, found)
    assert weights[:35].tolist() == [1.0] * 35 and weights[35:].sum() == pytest.approx(10)


def test_quality_model_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality_model.score(empty).count() == 0
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "fine words here.", 2), (3, "idiot " * 9000, 3), (3, "idiot " * 9000, 3)], DOCS + ", quality int")
    assert quality_model.score(df).count() == 5
    model = quality_model.fit_label_model({(0, 1, 1, 0): 80, (0, -1, -1, 0): 15, (0, 1, -1, 0): 5})
    assert model.posterior[(0, 1, 1, 0)] > 0.9 > 0.1 > model.posterior[(0, -1, -1, 0)]


def test_chat_blocks(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(50)] + [(2, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_chats(df).collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in whole] == [(1, 0, 50)]
    monkeypatch.setattr(chat, "BLOCK", 7)
    monkeypatch.setattr(chat, "PART", 16)
    parts = sorted(chat.format_chats(df).collect(), key=lambda r: r.part)
    assert "".join(r.text for r in parts) == whole[0].text and len(parts) == 4
    assert chat.format_chats(df.limit(0)).count() == 0


def test_shards(spark):
    draw = random.Random(2)
    rows = [(i, "same text" if i % 3 == 0 else "z" * draw.randint(0, 400), "x") for i in range(3000)] + [(None, None, "x"), (5, "dup", "y"), (5, "dup", "y")]
    df = spark.createDataFrame(rows, DOCS + ", shard string")
    got = sharding.shard(df, 8).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in got)
    assert len(got) == 3003 and set(by) == set(range(8))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r.size for r in own) / (total / 8) - 1) < 0.05
    again = sharding.shard(df.repartition(5), 8).collect()
    assert sorted((r.doc_id or -1, r.shard) for r in got) == sorted((r.doc_id or -1, r.shard) for r in again)
    assert sharding.shard(df.limit(0), 8).count() == 0


def test_equal_texts_share_a_shard_unless_they_are_many(spark):
    rows = [(i, f"text {i // 5}" + "y" * (i // 5 % 90)) for i in range(4000)] + [(5000 + i, "hot text " + "h" * 80) for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), 8)
    per = got.groupBy("text").agg(F.count_distinct("shard").alias("n")).groupBy((F.col("text").startswith("hot")).alias("hot")).agg(F.max("n").alias("n"))
    spread = {r.hot: r.n for r in per.collect()}
    assert spread[False] == 1 and 4 <= spread[True] <= 5
    sizes = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) < 1.05 * min(sizes)


@pytest.mark.parametrize("ranges", [4, 64])
def test_shards_equal_a_plain_pass_over_sorted_rows(spark, ranges):
    draw = random.Random(4)
    rows = [(i, "same" if i % 4 == 0 else "z" * draw.randint(0, 90), "s") for i in range(900)] + [(7, "again", "s")] * 300 + [(None, None, "s")] * 40
    df = spark.createDataFrame(rows, DOCS + ", source string")
    keyed = df.select("doc_id", sharding._key([F.col("source")]).alias("shard_key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    splitters, stats = sharding.splitters_for(keyed.select("shard_key", "size"), 8 * ranges)
    segments = sharding._segments(stats, 8)
    want, ordered = Counter(), sorted((r.shard_key, -1 if r.doc_id is None else r.doc_id) for r in keyed.collect())
    place, last = 0, None
    for key, doc in ordered:
        of = bisect.bisect_right(splitters, key)
        place, last = (place + 1 if of == last else 0), of
        shard, shift = next((s, h) for r, first, end, s, h in segments if r == of and first <= place <= end)
        want[doc, shard, place + shift] += 1
    got = [(r.doc_id if r.doc_id is not None else -1, r.shard, r.slot) for r in sharding.shard(df, 8, ranges).collect()]
    # alike keys may take one another's slots, so rows count by document and shard, and slots by shard
    assert Counter((d, s) for d, s, _ in got) == Counter((d, s) for d, s, _ in want.elements())
    assert sorted((s, n) for _, s, n in got) == sorted((s, n) for _, s, n in want.elements())


def test_repeats_of_one_row_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    df = spark.createDataFrame([(1, "alike", "a")] * 500 + [(1, "alike", "b")] * 300 + [(i, f"text {i}", "c") for i in range(2, 60)], DOCS + ", row string")
    got = sharding.shard(df, 4).collect()
    assert Counter((r.doc_id, r.row) for r in got) == Counter((r.doc_id, r.row) for r in df.collect())
    for shard in range(4):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) * 4 / sum(r["size"] for r in got) - 1) < 0.1


def test_one_key_over_many_shards(spark):
    df = spark.createDataFrame([(1, "alike")] * 1000, DOCS)
    got = sharding.shard(df, 4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sorted((r.shard, r.n, r.m) for r in got) == [(i, 250, 249) for i in range(4)]


def test_overfull_ranges_are_divided(spark):
    rows = spark.range(5000).select(F.concat(F.lpad(F.hex(F.xxhash64("id")), 16, "0"), F.lpad("id", 16, "0")).alias("shard_key"), F.lit(10).cast("long").alias("size"))
    _, stats = sharding.splitters_for(rows, 64, sample=80)
    assert sum(s[1] for s in stats) == 50_000 and max(s[1] for s in stats) <= 3 * 50_000 / 64


def plain_viterbi(text, vocabulary, fallback):
    """Best segmentation from start positions on, a later candidate only winning with a higher score."""
    scores = dict(zip(vocabulary.pieces, vocabulary.scores, strict=True))
    unknown, longest = min(scores.values()) - 10, max(map(len, scores))
    best = [None] * (len(text) + 1)
    best[0] = (0.0, [])
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            s = scores.get(text[i:j], unknown if j == i + 1 else None)
            if s is not None and (best[j] is None or best[i][0] + s > best[j][0]):
                best[j] = (best[i][0] + s, [*best[i][1], text[i:j] if text[i:j] in scores else None])
    pieces, n, previous = best[-1][1], 0, False
    at = 0
    for p in pieces:
        if p is None:
            n += len(text[at].encode()) if fallback else not previous
        else:
            n += 1
        at, previous = at + (1 if p is None else len(p)), p is None
    return n, best[-1][0]


def test_scores_do_not_hang_on_the_other_texts():
    v = token_count.Vocabulary.of([(p, -0.1 * i) for i, p in enumerate(["a", "b", "▁", "ab", "▁a"], 1)])
    texts = ["ab ab b a " * 50, "a\x00b", "", None, "ba ab"]
    counter = token_count.Counter(v)
    n, s = counter.count(pa.array(texts), True)
    for i, t in enumerate(texts):
        assert (n[i], s[i]) == tuple(x[0] for x in counter.count(pa.array([t], pa.string()), True))


@pytest.mark.parametrize("forget", [1 << 14, 0])
@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_equal_plain_viterbi(fallback, forget, monkeypatch):
    monkeypatch.setattr(token_count, "FORGET", forget)
    draw = random.Random(5)
    pieces = [(p, -float(draw.randint(1, 3))) for p in ["a", "b", "▁", "ab", "ba", "▁a", "aab", "bab", "▁▁", "▁ab", "abab", "c", "▁c"]]
    v = token_count.Vocabulary.of(pieces, byte_fallback=fallback, space_prefix=False)
    texts = ["".join(draw.choice("aabbc  \nxé1") for _ in range(draw.randint(0, 40))) for _ in range(400)] + ["", "x", "\x00a b", "xx xx"]
    n, s = token_count.Counter(v).count(pa.array(texts), False)
    for t, a, b in zip(texts, n, s, strict=True):
        assert (a, b) == plain_viterbi(t.replace(" ", "▁"), v, fallback), repr(t)


def test_token_counts_equal_a_public_tokenizer(spark):
    model = Path(queries.VOCABULARY)
    if not model.exists():
        pytest.skip("no vocabulary here")
    from tokenizers import Tokenizer, models

    v = token_count.Vocabulary.from_model(str(model))
    low = min(v.scores)
    other = Tokenizer(models.Unigram([("<unk>", low), *zip(v.pieces, v.scores, strict=True), *[(f"<0x{i:02X}>", low) for i in range(256)]], unk_id=0, byte_fallback=True))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "a" * 5000), (9004, "😀\tx")], DOCS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_count.count_tokens(docs, v).collect():
        t = texts[r.doc_id]
        assert r.n_tokens == (len(other.encode("▁" + t.replace(" ", "▁")).ids) if t else 0)


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * i for i in range(50)])], names=["text"])
    old, tokens.SLICE_BYTES = tokens.SLICE_BYTES, 100
    try:
        assert sum((b.column("text").to_pylist() for b in tokens.slices(iter([batch]))), []) == batch.column("text").to_pylist()
    finally:
        tokens.SLICE_BYTES = old


def test_crc_and_sizes(spark):
    spark_rows = queries.op8_shard(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 and r.law == "bytes" and r.grown_shard is None for r in spark_rows)


def test_variety_and_shapes_are_of_whole_texts():
    varied = " ".join(f"word{i}" for i in range(200))
    texts = [varied + " junk spam" * 2000, "junk " * 200 + " ".join(f"word{i}" for i in range(3000)), "junk " * 30, varied, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    at = quality_model.QUALITY_LABELLERS.index("variety") - 1
    votes = [r["quality"][at] for b in quality_model._label(iter([batch])) for r in b.to_pylist()]
    assert votes[:4] == [-1, 0, -1, 0]
    assert quality_model._word("a1" * 32 + "-")[1] != quality_model._word("a1" * 32 + "B")[1]


def test_many_matches_in_one_text_take_no_quadratic_time(spark):
    n = 40_000
    text = " ".join(f"u{i}@x.org" for i in range(n))
    began = time.perf_counter()
    spans = pii.detect(spark.createDataFrame([(1, text), (2, "token " + "aB3dE6gH9k" * 3 + " " + text)], DOCS))
    got = {r.doc_id: r.n for r in spans.select("doc_id", F.size("spans").alias("n")).collect()}
    assert got == {1: n, 2: n + 1} and time.perf_counter() - began < 60
    masked = pii.mask(spark.createDataFrame([(1, text)], DOCS), spans.where("doc_id = 1")).first().text
    assert masked == " ".join(["<EMAIL>"] * n)


def plain_added(text, accepted):
    """Added spans that overlap no base span, of the candidates given."""
    base = [(a, b) for _, a, b in base_spans(text)]
    return [c for c in accepted if all(b <= c[1] or a >= c[2] for a, b in base)]


def test_added_spans_overlap_no_base_span(spark):
    draw = random.Random(8)
    parts = ["+1 555 123-4567", "555-123-4567", "aB3dE6gH9kaB3dE6gH9kaB3d", "aB3dE6gH9kaB3dE6gH9kaB3d@x.org", "4111 1111 1111 1111", "10.0.0.1", "call", "token", "(555) 123-4567"]
    texts = [draw.choice([" ", "", ", "]).join(draw.choice(parts) for _ in range(draw.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if not s.base] for r in pii.detect(df, threshold=1e-9).collect()}
    every = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if s.kind in pii.ADDED] for r in pii.candidates(df).collect()}
    assert any(got.values()) and got == {i: plain_added(t, every[i]) for i, t in enumerate(texts)}


def test_masking_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "x", "me@a.org and 10.0.0.1", 5), (2, "y", None, 6), (None, "z", "q@b.org", 7)], "doc_id long, mask_id string, text string, `a.b` int")
    masked = pii.mask(df, pii.detect(df))
    assert masked.columns == df.columns and sorted(tuple(r)[1:] for r in masked.collect()) == [("x", "<EMAIL> and <IP>", 5), ("y", None, 6), ("z", "<EMAIL>", 7)]


def test_repeats_in_long_texts_are_exact(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(30_000)]
    long = [draw.choice(words) for _ in range(70_000)]
    long[50_000:50_040] = long[100:140]
    rows = [(1, " ".join(long), "s"), (2, " ".join(long[:90] + long[40:60]), "s"), (3, " ".join(words), "s")]

    def repeated(w):
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = {x for x, n in Counter(wins).items() if n > 1}
        return len({j for i, x in enumerate(wins) if x in often for j in range(i, i + 8)})

    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(spark.createDataFrame(rows, DOCS + ", source string")).collect()}
    assert got == {i: repeated(t.split()) for i, t, _ in rows} and got[1] >= 80


def test_long_secrets_are_candidates(spark):
    token = "eyJ" + "aB3dE6gH9k" * 40
    got = pii.detect(spark.createDataFrame([(1, f"the auth token: {token} ends"), (2, f"{token}." * 2)], DOCS)).collect()
    spans = {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == "secret"] for r in got}
    assert spans == {1: [(16, 16 + len(token))], 2: [(0, len(token)), (len(token) + 1, 2 * len(token) + 1)]}
