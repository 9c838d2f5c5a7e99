"""What is shuffled, and what is not, by queries whose steps grew faster than their input."""

from pyspark.sql import functions as F

from loomspark.operators import joins, working
from loomspark.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_met_before_the_shuffle(spark, monkeypatch):
    texts = [(i, w) for i, w in enumerate(["The  cat sat on the mat today", "on the mat", "cat", None, "", "the cat sat on a mat", "sat on the mat"])]
    table = spark.createDataFrame(texts, "id long, text string").repartition(3)
    phrases = ["cat", "on the", "the cat sat on the", "the cat sat on a mat", "sat on the mat", "dog", "mat today now at last"]
    names = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = {(i, p) for i, t in texts for p in phrases if f" {p} " in f" {' '.join((t or '').lower().split())} "}
    for size in (joins.PHRASE_BYTES, 500, 0):  # phrases go to all tasks, their first words do, nothing does
        monkeypatch.setattr(joins, "PHRASE_BYTES", size)
        df = joins.phrases_in(table, ["id"], F.col("text"), names, "phrase")
        got = [(r.id, r.phrase) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert ("hashpartitioning(_key" in plan(df)) == (size < joins.PHRASE_BYTES or size <= 500)
    monkeypatch.undo()
    short = joins.phrases_in(table, ["id"], F.col("text"), names.where("phrase IN ('cat', 'on the')"), "phrase")
    assert "Exchange hashpartitioning" not in plan(short) and {(r.id, r.phrase) for r in short.collect()} == {x for x in want if x[1] in ("cat", "on the")}
    assert joins.phrases_in(table, ["id"], F.col("text"), names.where("false"), "phrase").collect() == []


def test_only_texts_are_shuffled_for_an_index(spark, folder):
    assert plan(QUERIES["invert_index"](spark, folder)).count("Exchange") == 1


def test_memories_are_not_spread_over_ids(spark, folder):
    assert "sequence(" not in plan(QUERIES["memory_document"](spark, folder))


def test_activation_of_few_items_needs_no_sketches(spark, folder):
    shown = plan(QUERIES["activation_boosts"](spark, folder))
    assert "approx_count_distinct" not in shown and "PythonMapInPandas" not in shown and "MapInPandas" not in shown


def test_notes_come_in_slices(spark):
    turns = spark.createDataFrame([(k, 0, 0.0, f"alpha{k} beta gamma. delta{k} works") for k in range(200)], "conv long, turn long, at double, text string").coalesce(1)
    notes = working.graph_notes(turns, "conv", "turn", "at", "text")
    assert notes.count() == 200 and notes.select("conv").distinct().count() == 200 and working.SLICE < 200
