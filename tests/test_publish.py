"""The store of versions, incremental export, batches that count once, and sentences of pieces."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.operators import publish
from loomspark.operators.publish import Refused, Store
from loomspark.streaming import cursor, sentences

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def numbers(df):
    return sorted(r.n for r in df.collect())


def test_store_keeps_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("notes") is None
    positive = {"n is positive": F.col("n") > 0}
    store.publish("notes", spark.range(1, 4).select(F.col("id").alias("n")), positive)
    for bad in (spark.range(0, 4), spark.range(1, 3).select(F.when(F.col("id") > 1, F.col("id")).alias("id"))):
        with pytest.raises(Refused, match="n is positive: 1 rows"):
            store.publish("notes", bad.select(F.col("id").alias("n")), positive)
    with pytest.raises(Refused, match="0 rows, not 1"):
        store.publish("notes", spark.range(0).select(F.col("id").alias("n")), least=1)
    failing = spark.range(4).select(F.udf(lambda i: 1 // (i - 2), "long")("id").alias("n"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        store.publish("notes", failing)
    assert numbers(store.read("notes")) == [1, 2, 3] and store.versions("notes") == [1]
    store.publish("notes", spark.range(7, 9).select(F.col("id").alias("n")), append=True)
    store.publish("notes", spark.range(50, 51).select(F.col("id").alias("n")))
    assert numbers(store.read("notes")) == [50] and numbers(store.read("notes", 2)) == [1, 2, 3, 7, 8]
    with pytest.raises(Refused, match="columns differ"):
        store.publish("notes", spark.range(2), append=True)
    assert store.rollback("notes").rows == 5 and numbers(store.read("notes")) == [1, 2, 3, 7, 8]
    store.rollback("notes", 1)
    assert numbers(store.read("notes")) == [1, 2, 3] and store.manifest("notes").version == 5
    assert store.vacuum("notes", keep=1) >= 2 and numbers(store.read("notes")) == [1, 2, 3]
    for name in ("../out", "/etc/x", "a/../../b", "", "a//b", ".hidden"):
        with pytest.raises(Refused):
            store.publish(name, spark.range(1))
    store.publish("none", spark.range(0))
    assert store.read("none").collect() == [] and store.read("none").columns == ["id"]
    other = Store(spark, str(tmp_path / "store"))
    with pytest.raises(Refused, match="another writer"):
        other._commit("notes", publish.Manifest(5, [], 0, "{}"))


def exported(store):
    found = defaultdict(list)
    for r in publish.exported(store, "groups").orderBy("group_key", "place").collect():
        found[r.group_key].append(r.block)
    return {k: "\n\n".join(v) for k, v in found.items()}


def test_export_writes_only_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    kind = "id long, q string, title string, url string, text string, hint string"
    rows = [(1, "Why is  the sky blue?", "One", "u1", "It scatters.", None), (2, "why is the SKY blue?", "", "u2", "Rayleigh.", "Light scatters."), (3, "How deep is the sea?", "", "", "Deep.", ""), (4, " ", "x", "x", "x", None), (5, None, "x", "x", "x", None)]

    def run(rows, **options):
        return publish.export(store, "groups", spark.createDataFrame(rows, kind), "id", F.col("q"), F.col("title"), F.col("url"), F.col("text"), F.col("hint"), **options)

    assert run(rows) == {"written": 2, "skipped": 0, "groups": 2, "watermark": 3}
    first = exported(store)
    sky = next(t for t in first.values() if "sky" in t)
    assert sky.index("# Question\n\nWhy is  the sky blue?") < sky.index("## Answer\n\nLight scatters.") < sky.index("### One · u1\n\nIt scatters.") < sky.index("### u2\n\nRayleigh.")
    assert any("### source\n\nDeep." in t for t in first.values())
    versions = store.versions("groups")
    assert run(rows) == {"written": 0, "skipped": 0, "groups": 2, "watermark": 3} and store.versions("groups") == versions
    assert run(rows, full=True) == {"written": 0, "skipped": 2, "groups": 2, "watermark": 3} and store.versions("groups") == versions
    more = rows + [(9, "How deep is the sea?", "New", "u9", "Eleven km.", "About 11 km."), (10, "A third?", "t", "u", "x", None)]
    assert run(more) == {"written": 2, "skipped": 0, "groups": 3, "watermark": 10}
    after = exported(store)
    assert len(after) == 3 and {k for k in first if after[k] == first[k]} == {k for k, t in first.items() if "sky" in t}
    assert any("## Answer\n\nAbout 11 km." in t and "Eleven km." in t and "sources: 2" in t for t in after.values())
    edited = [(*r[:4], "changed", r[5]) if r[0] == 1 else r for r in more]
    assert run(edited)["written"] == 0 and run(edited, full=True)["written"] == 1
    assert "changed" in next(t for t in exported(store).values() if "sky" in t)


def test_export_takes_whole_texts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    texts = ["a" * 50_000 + " end", "b" * 130_000 + " end"]

    def run(rows, **options):
        df = spark.createDataFrame([(i, "Q", t) for i, t in enumerate(rows)], "id long, q string, text string")
        none = F.lit("")
        return publish.export(store, "groups", df, "id", F.col("q"), none, none, F.col("text"), **options)

    run(texts)
    (document,) = exported(store).values()
    assert all(f"### source\n\n{t}" in document for t in texts)
    texts[1] = texts[1].replace(" end", " other end")  # a change after any number of characters is a change
    assert run(texts, full=True)["written"] == 1 and texts[1] in next(iter(exported(store).values()))


def test_replayed_batches_count_once(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    spark.range(0, 60, 1, 6).write.parquet(path)

    def run(each):
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(path)
        q = s.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    plain = cursor.counted_once(store, "doubled", lambda df: df.select((F.col("id") * 2).alias("n")))
    killed = []

    def dies(rows, number):
        plain(rows, number)
        if number == 1 and not killed:  # after the write, before Spark's commit
            killed.append(number)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(dies)
    assert store.manifest("doubled").batch == "1"
    run(dies)
    assert numbers(store.read("doubled")) == [2 * i for i in range(60)] and store.versions("doubled") == [1, 2, 3]
    plain(spark.range(5), 2)
    assert store.manifest("doubled").rows == 60
    store.rollback("doubled")  # a batch that was rolled back counts no more
    assert store.batch("doubled", "2") is None and store.batch("doubled", "1") is not None


def test_rows_that_fail_are_set_aside(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    bad = {17, 40, 41}
    step = lambda df: df.select(F.udf(lambda i: i if i not in bad else 1 // 0, "long")("id").alias("n"))
    cursor.counted_once(store, "good", step, ident="id")(spark.range(64), 0)
    assert numbers(store.read("good")) == [i for i in range(64) if i not in bad]
    assert sorted(r.id for r in store.read("good.skipped").collect()) == sorted(bad)
    with pytest.raises(Exception, match="ZeroDivisionError"):  # an outage skips nothing
        cursor.counted_once(store, "other", step, ident="id", alive=lambda: False)(spark.range(64), 0)
    assert store.read("other") is None


def test_due_sources(spark):
    sources = spark.createDataFrame([("a", 600.0), ("b", 600.0), ("c", 600.0), ("d", 600.0), ("e", 600.0)], "source string, every double")
    runs = spark.createDataFrame([("a", 0.0, True), ("b", 900.0, True), ("c", 0.0, True), ("c", 700.0, False), ("c", 900.0, False), ("d", 0.0, False), ("d", 950.0, False)], "source string, at double, ok boolean")
    got = {now: sorted(r.source for r in publish.due(sources, runs, F.lit(now)).collect()) for now in (1000.0, 1021.0, 1100.0)}
    assert got == {1000.0: ["a", "e"], 1021.0: ["a", "c", "e"], 1100.0: ["a", "c", "d", "e"]}


def test_sentences_of_any_cutting(spark, tmp_path):
    rng = random.Random(7)
    bits = ["Hello there.", "\"Quoted!\"", "Wait...", "no end", "1.5 m", "What?! ", "(yes.)", "…", " ", "\n", "e.g. this", "a", "Ünïcode。"]
    texts = {k: " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for k in range(12)}
    whole = spark.createDataFrame(list(texts.items()), "k long, text string")
    want = {r.k: list(r.s) for r in whole.select("k", sentences.spoken(F.col("text")).alias("s")).collect()}
    rows = []
    for k, t in texts.items():
        cuts = sorted(rng.randint(0, len(t)) for _ in range(rng.randint(0, 12)))
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
        rows += [(k, i, 1000.0 + i, p, i == len(parts) - 1 and k % 2 == 0) for i, p in enumerate(parts)]
    kind, path, out = "k long, place long, at double, piece string, fin boolean", str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, kind)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for part in (df.where("place < 4"), df.where("place >= 4"), spark.createDataFrame([(99, 0, 5000.0, "The end", False)], kind), spark.createDataFrame([(99, 1, 5001.0, " came. And", False)], kind)):
            part.coalesce(1).write.mode("append").parquet(path)
            s = spark.readStream.schema(kind).parquet(path)
            q = sentences.sentence_stream(s, "k", "place", "at", "piece", F.col("fin"), idle=60.0).writeStream.outputMode("update").foreachBatch(lambda x, _: x.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert q.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = defaultdict(dict)
    for r in spark.read.parquet(out).collect():
        assert r.n not in got[r.k]
        got[r.k][r.n] = r.sentence
    assert got.pop(99) == {0: "The end came."}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert Counter(len(v) for v in want.values()).total() == 12
