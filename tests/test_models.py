"""Models of all kinds: saved, loaded and scored; labels that no training row has."""

import random

import pytest

from tidegate.operators import models as M
from tidegate.sources.storage import scratch


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = [(i, rng.choice("abc")) for i in range(300)]
    return M.split(spark.createDataFrame([(i, k, rng.gauss("abc".index(k) * 3, 1), rng.random()) for i, k in made], "id long, label string, x double, y double"), "id").cache()


@pytest.mark.parametrize(("kind", "trees"), [("forest", 8), ("tree", 1), ("boosted", 3)])
def test_kinds(spark, rows, kind, trees):
    path = scratch(spark, f"test-{kind}")
    M.save_model(M.train_multiclass(rows.where("split = 'train'"), "label", ("x", "y"), trees=trees, depth=3, kind=kind), path, spark)
    model, labels = M.load_model(path, spark)
    got = M.score_multiclass(model, rows.where("split <> 'train'"), "label").collect()
    assert labels == ["a", "b", "c"] and sum(r["label"] == r["predicted"] for r in got) > 0.8 * len(got)
    for r in got:
        assert abs(sum(r["probabilities"]) - 1) < 1e-9 and r["confidence"] == max(r["probabilities"]) and labels[r["probabilities"].index(r["confidence"])] == r["predicted"]


def test_label_without_training_rows(spark, rows):
    model = M.train_multiclass(rows.where("split = 'train' AND label <> 'c'"), "label", ("x", "y"), kind="tree", labels=rows)
    got = M.score_multiclass(model, rows, "label").collect()
    assert len(got) == 300 and model.stages[0].labels == ["a", "b", "c"] and {r["predicted"] for r in got} == {"a", "b"}


def test_naive_bayes(spark, rows):
    counts = rows.selectExpr("id", "label", "split", "CAST(label = 'a' AS INT) AS p", "CAST(label = 'b' OR id % 9 = 0 AS INT) AS q")
    model = M.train_multiclass(counts.where("split = 'train'"), "label", ("p", "q"), kind="bayes")
    for r in M.score_multiclass(model, counts, "label").collect():
        assert abs(sum(r["probabilities"]) - 1) < 1e-9 and r["confidence"] == max(r["probabilities"])


@pytest.fixture(scope="module")
def few_days(tmp_path_factory):
    """Events of which a day has even numbers only, another a single packet, and a label stands in no training row."""
    import duckdb

    folder = tmp_path_factory.mktemp("events")
    seen = "SELECT * FROM '/root/testdata/sf0.001/events.parquet'"
    learned = "(event_id * 7919 + 13) % 100 < 70"
    some = f"""SELECT * FROM ({seen}) WHERE NOT (event_type = 'signup' AND user_id % 4 = 0 AND {learned}) AND NOT (day(ts) = 3 AND event_id % 2 = 1)
      AND (day(ts) <> 4 OR event_id = (SELECT min(event_id) FROM ({seen}) WHERE day(ts) = 4))"""
    duckdb.sql(f"COPY ({some}) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize(("name", "per"), [("ml_confidence_gate", "pkt_id"), ("ml_hybrid_decision", "w")])
def test_every_packet_and_day_is_decided(spark, few_days, name, per):
    import duckdb

    from tests.test_registry import rows_of
    from tidegate.plans import registry
    from tidegate.sources.tables import packets

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{few_days}/events.parquet'")
    got = registry.queries()[name](spark, few_days).toPandas()
    whole = packets(spark, few_days).selectExpr("pkt_id", "date_format(date_trunc('day', ts), 'yyyy-MM-dd HH:mm:ss') AS w").select(per).distinct().toPandas()
    assert sorted(got[per]) == sorted(whole[per])
    assert rows_of(got) == rows_of(con.execute(registry.oracle_sql()[name]).df())
