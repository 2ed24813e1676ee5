import pytest

import __spark_entry__ as entry
from chromill.plans import catalogue
from chromill.schemas import FEATURES_18
from tests.compare import same

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalogue.queries()[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["r_scrape_cascade_parsed", "r_dominant_colours", "r_image_palettes", "r_combinations", "r_combination_document", "r_pca_kmeans"])
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_part():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "chromill"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f


def test_reference_queries_run_whole_jobs(spark, monkeypatch):
    from chromill.operators import classify, cluster
    from chromill.plans import colour, combinations, derived, stats

    rows = [(1, 2 * i, i * 7 % 256, 255 - i) for i in range(40)]
    monkeypatch.setattr(derived, "pixels", lambda *_: spark.createDataFrame(rows, "image_id int, r int, g int, b int"))
    assert colour.r_dominant_colours(spark, "").count() == 30
    seen = {}
    monkeypatch.setattr(combinations.c, "build", lambda *_, **how: seen.update(build=how))
    monkeypatch.setattr(combinations.c, "flatten", lambda x: x)
    combinations.r_combinations(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(cluster, "choose_k", lambda f, ks, **how: (seen.update(ks=list(ks), choose=how), (30, [(30, 1.0, 0.5)]))[1])
    stats.r_choose_k(spark, "/root/testdata/sf0.001")
    families = classify.models(FEATURES_18, 10, 500)
    few = families["logistic regression"].setMaxIter(1)
    monkeypatch.setattr(classify, "models", lambda *_: dict.fromkeys(families, few))
    assert seen == {"build": {}, "ks": list(range(20, 41)), "choose": {"starts": 30}}
    assert [r.classifier for r in stats.r_classify(spark, "/root/testdata/sf0.001").collect()] == list(families)
