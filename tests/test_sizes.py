"""What a task holds doesn't grow with the input."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.operators import campaign, pools, public_records
from plumbline.plans import contracts
from plumbline.sources import bundle, shared, tables

SMALL = "/root/testdata/sf0.001"


def test_pairs_of_records_are_never_broadcast(spark):
    """The table that records are made of is small in bytes, its records are not."""
    record = F.concat(F.lit('{"input":{"messages":{"system":"s","user":"'), F.repeat(F.lit("x"), 100), F.lit('"}}}'))
    rows = tables.load(spark, SMALL, "part").select(F.col("p_partkey").cast("string").alias("instance_id"), F.explode(F.array(F.lit("raw"), F.lit("gold"))).alias("condition")).withColumn("record", record)
    plan = public_records.pairing_issues(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_line_items_go_in_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "ITEM_ROWS", 500)
    n = tables.load(spark, SMALL, "lineitem").count()
    assert tables.items(spark, SMALL).rdd.getNumPartitions() == -(-n // 500)
    assert tables.probes(spark, SMALL).groupBy("probe_type", "problem_id").count().rdd.getNumPartitions() == -(-n // 500)


@pytest.mark.parametrize("name", ["a17_control_comparisons", "w01_leaderboard", "a16_by_k_candidates", "a12_transitions", "a18_model_contrasts"])
def test_groups_by_problem_keep_the_dealing_of_line_items(spark, monkeypatch, name):
    """Every exchange by order has as many tasks as the line items make, and groups by problem add none of their own."""
    monkeypatch.setattr(tables, "ITEM_ROWS", 500)
    n = tables.load(spark, SMALL, "lineitem").count()
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan)
    assert dealt and set(dealt) == {str(-(-n // 500))}
    assert not re.search(r"Exchange hashpartitioning\([^)]*(problem_id|probe_id)", plan)


@pytest.mark.parametrize("name", ["k07_comparison_table", "v18_reaudit"])
def test_reports_on_means_keep_the_dealing_of_line_items(spark, monkeypatch, name):
    """The means that a report writes or checks, before it does: groups by problem stay in the tasks of their line items."""
    means, type_means = [], pools.type_means
    monkeypatch.setattr(tables, "ITEM_ROWS", 500, raising=False)
    monkeypatch.setattr(pools, "type_means", lambda *a: means.append(type_means(*a)) or means[-1])
    n = tables.load(spark, SMALL, "lineitem").count()
    catalog.queries()[name](spark, SMALL)
    assert len(means) == 1
    plan = means[0]._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan)) == {str(-(-n // 500))}
    assert not re.search(r"Exchange hashpartitioning\([^)]*(problem_id|probe_id)", plan)


def test_long_texts_are_made_in_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "WIDE_ROWS", 50)
    n = tables.load(spark, SMALL, "part").count()
    prompts = shared.relation(spark, SMALL, "prompts")
    assert prompts.rdd.getNumPartitions() == -(-n // 50) and prompts.count() == n


def test_published_files_have_a_bounded_number_of_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundle, "FILE_ROWS", 10)
    bundle.publish(spark.range(95).coalesce(1), root := f"file://{tmp_path}/out")
    assert bundle.inventory(spark, root).where("path LIKE '%.json'").count() == 10
    assert spark.read.json(root).count() == 95


def test_a_campaign_reads_its_probes_from_one_copy(spark, monkeypatch):
    """Every step of both rounds would number the line items anew and join them with the orders."""

    def stop(catalog, tags, *_):
        read = catalog.inputFiles() + tags.inputFiles()
        raise InterruptedError(any("lineitem" in f for f in read))

    monkeypatch.setattr(campaign, "plan_round", stop)
    with pytest.raises(InterruptedError, match="False"):
        contracts.m11_campaign(spark, SMALL)


def test_a_campaign_takes_probes_of_large_numbers(spark, tmp_path):
    """Order numbers whose probes' numbers are beyond 32 bits; they give a reviewer's sequence."""
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        tables.load(spark, SMALL, name).withColumn(key, F.col(key) + 50_000_000).write.parquet(f"{tmp_path}/{name}.parquet")
    problems = tables.load(spark, SMALL, "lineitem").select("l_orderkey").distinct().count()
    first, second = contracts.m11_campaign(spark, str(tmp_path)).collect()
    assert (first.candidates, first.sampled, first.pending_primary, first.pending_secondary) == (problems, 100, 0, 0)
    assert (second.candidates, second.sampled, second.pending_primary, second.pending_secondary) == (problems - first.removed, 100, 0, 0)
