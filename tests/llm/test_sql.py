import pytest

from chromill.llm import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


HARD = [
    (1, "a b c\n\nA B C\n a b c", "s1"), (2, None, "s1"), (3, "", None), (4, "x " * 50, "s2"), (4, "x " * 50, "s2"), (None, "one two three four five six seven eight nine " * 3, None),
    (5, " ".join(f"w{i}" for i in range(9000)), "s3"), (6, "\x1c  \x0b tab\tbed # $ |<>&", "\U0001f600"), (7, "no", "￮"),
]


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_quality_rules"])
@pytest.mark.parametrize("rows", [HARD, []])
def test_hard_documents(spark, tmp_path, name, rows):
    spark.createDataFrame([(*r, "en", None, "clash") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, size string").write.parquet(str(tmp_path / "documents.parquet"))
    if rows:
        same(queries.queries()[name](spark, str(tmp_path)), queries.oracle_sql()[name], str(tmp_path))
    else:
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_hard_pages(spark, tmp_path):
    rows = [(3, "u\r\n3", "x"), (1, None, "x"), (2, "u2", None), (9, "u9", ""), (4, "u4", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n"), (5, "u5", "é" * 50000), (6, "u6", "é" * 50000)]
    spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").write.parquet(str(tmp_path / "pages.parquet"))
    same(queries.queries()["op2_warc_revisits"](spark, str(tmp_path)), queries.oracle_sql()["op2_warc_revisits"], str(tmp_path))


def test_hard_conversations(spark, tmp_path):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", "<|im_end|> x")
    convs = {1: [a, b], 2: [a, b, c], 3: [a, b, c], 4: [a], 5: [b], 6: [("user", None), (None, "q")], 7: [("user", ""), ("unknown", "q"), a], None: [c, c]}
    rows = [(i, t, *x, "z") for i, turns in convs.items() for t, x in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.queries()["op7_chat_snapshots"](spark, str(tmp_path))
    assert sorted((r.conv_id or 0, r.n_turns, r.n_copies) for r in found.collect()) == [(0, 2, 1), (2, 3, 2), (5, 1, 1), (7, 3, 1)]
    same(found, queries.oracle_sql()["op7_chat_snapshots"], str(tmp_path))
