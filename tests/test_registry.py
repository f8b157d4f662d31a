"""Every registered query on audits against its SQL, over the whole tables."""

import compare
import pytest

from auditlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_all_but_the_training_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"k2_train_decider", "k3_train_ranker", "a21_topic_groups", "a22_grouped_topics", "a23_chapters"}
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_trained_decider(spark):
    """Held against the references it was trained on: the likeliest class is right for most."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = registry.QUERIES["k2_train_decider"](spark, SF).join(registry.learning_rows(docs, labels).select("doc_id", "nr", "ref"), ["doc_id", "nr"]).collect()
    assert sum(r.most == r.ref for r in rows) > 0.9 * len(rows) > 0


@pytest.mark.parametrize("name", ["k3_train_ranker", "a22_grouped_topics", "a23_chapters"])
def test_queries_without_sql_have_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert compare.tidy(ours) == compare.tidy(theirs)


@pytest.mark.parametrize("name", ["k2_train_decider", "k3_train_ranker"])
def test_training_rows_are_made_once(spark, name):
    """The training goes over its rows many times; what is made for it is read and not made again."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
