"""What frozen tables leave on the disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from corpus_pipeline import drop_near_copies, drop_repeated_lines
from tidemark.llm.passages import repeated_passages
from tidemark.sources.scratch import discard, freeze, freeze_alone, scratch_path


def tables(spark):
    root = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    return {p.name for p in root.iterdir()} if root.exists() else set()


def documents(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    data = [(i, f"{line}\nline {i} of its own words\n{line.replace('two', 'too')}") for i in range(30)]
    return spark.createDataFrame(data, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))


def test_tables_on_the_way_are_deleted(spark):
    before = tables(spark)

    def make():
        inner = freeze_alone(lambda: freeze(spark.range(5), "inner").where("id > 1"), "middle")
        return freeze(inner.where("id > 2"), "outer").where("id > 3")

    kept = freeze(spark.range(2), "kept")
    result = freeze_alone(make, "result")
    assert {n.split("-")[0] for n in tables(spark) - before} == {"kept", "result"}
    assert [r.id for r in result.collect()] == [4]
    discard(kept, result)
    assert tables(spark) == before


def test_freezing_leaves_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in blocks.getAllBlocks().mkString(",").split(",") if name.startswith("shuffle")}

    before = shuffled()
    rows = freeze(spark.range(1000).repartition(3, "id"), "rows")
    until = time.time() + 20  # they are deleted in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    discard(rows)


def test_stages_keep_their_decisions_alone(spark, tmp_path):
    docs = documents(spark)
    for stage, label in ((drop_repeated_lines, "line-decisions"), (drop_near_copies, "near-copies")):
        before = tables(spark)
        stage(spark, docs, str(tmp_path)).count()
        assert {n.rsplit("-", 1)[0] for n in tables(spark) - before} == {label}


def test_passages_delete_seeds_and_chains(spark):
    before = tables(spark)
    words = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"own{i} {words} end{i}") for i in range(4)], "doc_id bigint, text string")
    assert repeated_passages(docs).count() == 3
    assert {n.rsplit("-", 1)[0] for n in tables(spark) - before} == {"verified-chains"}
