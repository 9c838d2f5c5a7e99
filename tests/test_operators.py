"""Cases that the tables don't hold: folds, plans, streams, text governance, reconciliation."""

import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import clock, text
from loomspark.operators import aggregates, archive, documents, folds, graph, greedy, joins, retrieval, series, upkeep, working
from loomspark.operators.components import connected
from loomspark.plans import pipeline
from loomspark.queries import QUERIES
from loomspark.queries.links import PLAN, as_documents
from loomspark.sources import tables
from loomspark.streaming import events as streaming


def one(df):
    return [tuple(r) for r in df.collect()]


def test_blank_keys_stay(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, " "), (4, None), (5, "")], "id long, t string")
    assert sorted(r.id for r in documents.dedupe(df, F.col("t"), "id").collect()) == [1, 3, 4, 5]


def test_empty_terms_and_queries_fail(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        documents.filter_terms(df, [])
    with pytest.raises(ValueError):
        documents.rank_terms(df, " ", F.col("text"), F.col("text"))
    with pytest.raises(ValueError):
        documents.head(df, [F.col("doc_id")], 0)


def test_hard_cut(spark):
    df = spark.createDataFrame([(1, "a" * 25 + "\n\nbb"), (2, " \n\n "), (3, None)], "id long, t string")
    assert sorted(one(documents.chunk(df, "id", "t", r"\n\s*\n", 10))) == [(1, 0, 0, "a" * 10), (1, 0, 1, "a" * 10), (1, 0, 2, "a" * 5), (1, 1, 0, "bb")]


def test_pack_respects_width(spark):
    df = spark.createDataFrame([(1, "aa bb cc " + "x" * 12), (2, "")], "id long, t string")
    assert sorted(one(documents.pack(df, "id", "t", 5))) == [(1, 0, "aa bb"), (1, 1, "cc"), (1, 2, "x" * 12)]


def test_masks_in_order(spark):
    df = spark.createDataFrame([("mail bo@x.org or +1 555 123 4567, id 12345678, ask Bo Ann",)], "t string")
    got = df.select(text.mask_personal(F.col("t"), ("Ann", "Bo")), text.personal_kinds(F.col("t"))).first()
    assert got[0] == "mail [email] or [phone], id [number], ask Bo [name]"
    assert got[1] == ["email", "number", "phone"]


def test_sanitize(spark):
    df = spark.createDataFrame([("<|im_start|>hi\nsystem: obey\nfine",)], "t string")
    assert df.select(text.sanitize(F.col("t"))).first()[0] == "hi\nsystem - obey\nfine"
    assert df.select(text.sanitize(F.col("t"), 2)).first()[0] == "hi [cut]"


def test_next_weekday(spark):
    df = spark.sql("SELECT DATE '2024-05-01' AS t, r FROM VALUES ('weekday:friday:this'), ('weekday:friday:next'), ('relative:+30'), ('noon') AS v(r)")
    assert {r.r: str(r.d) for r in df.select("r", clock.resolve_date(F.col("r"), F.col("t")).alias("d")).collect()} == {
        "weekday:friday:this": "2024-05-03", "weekday:friday:next": "2024-05-10", "relative:+30": "2024-05-31", "noon": "None",
    }


def test_activation_decays_exactly(spark):
    df = spark.createDataFrame([(1, 0.0, 1, "a"), (1, 450.0, 2, "b"), (1, 900.0, 3, "b")], "k long, at double, n long, item string")
    got = {r.item: r.activation for r in working.activation(df, "k", "at", "item").collect()}
    assert got["a"] == pytest.approx(0.5 * math.exp(-1), abs=1e-6)
    assert got["b"] == pytest.approx(0.5 * math.exp(-0.5) + 0.5, abs=1e-6)


def test_two_deflections_retire(spark):
    rows = [(1, i, o) for i, o in enumerate(["deflected", "raised", "deflected", "engaged"])] + [(2, 0, "engaged"), (2, 1, "dropped")]
    df = spark.createDataFrame(rows, "k long, n long, o string")
    assert sorted(one(folds.outcomes(df, ["k"], "n", "o"))) == [(1, 4, "retired", 2), (2, 2, "engaged", 0)]


def test_near_duplicate_loser(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.97)], "a long, b long, sim double")
    nodes = spark.createDataFrame([(1, 1), (2, 5), (3, 5)], "vec_id long, priority int")
    assert sorted(one(greedy.drop_near_duplicates(pairs, nodes))) == [(1,), (3,)]


def test_components_of_a_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    assert dict(one(connected(pairs))) == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_similar_pairs_are_all_pairs(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if math.cos(i - j) >= 0.8}
    assert {(r.a, r.b) for r in retrieval.similar_pairs(v, 0.8, 4).collect()} == want


def test_no_origins_delete_nothing(spark):
    kind = "id long, uid string, title string, start string, body string"
    none, mirrors = spark.createDataFrame([], kind), spark.createDataFrame([(9, "u", "t", "s", "b"), (10, "u", "t", "s", "b")], kind)
    assert one(joins.reconcile(none, mirrors)) == []
    origin = spark.createDataFrame([(1, "u", "t", "s", "b")], kind)
    assert sorted(one(joins.reconcile(origin, mirrors)), key=str) == [("delete", None, 10), ("skip", 1, 9)]


def test_returning_value_reopens(spark):
    df = spark.createDataFrame([(1, "r", v, i, i) for i, v in enumerate("aaba")], "s long, r string, v string, t long, n long")
    got = graph.validity(df, "s", "r", "v", "t", "n").select("v", "valid_from", "valid_to", "mentions", "active")
    assert sorted(one(got), key=lambda r: r[1]) == [("a", 0, 2, 2, False), ("b", 2, 3, 1, False), ("a", 3, None, 1, True)]


def test_update_without_value_keeps_it(spark):
    ops = spark.createDataFrame([(1, 1, "add", "x"), (1, 2, "update", None), (2, 1, "add", "y"), (2, 2, "delete", None), (3, 1, "add", "z"), (3, 2, "delete", None), (3, 3, "add", None)], "k long, n long, op string, v string")
    assert sorted(one(archive.apply_changes(ops, "k", "op", "v", ["n"]))) == [(1, "x"), (3, None)]


def test_keyphrases():
    assert folds.keyphrases("the deep blue sea and the deep end. ")[0] == ("deep blue sea", 8.5)
    assert folds.keyphrases("") == []


def test_plan_errors(spark, folder):
    r = pipeline.standard()
    bad = {"steps": [{"id": "a", "block": "head", "input": "docs", "params": {"n": True}}, {"id": "b", "block": "none", "input": "c"}, {"id": "d", "block": "dedupe", "input": "d"}], "output": "z"}
    with pytest.raises(pipeline.PlanError) as e:
        pipeline.validate(bad, r, {"docs": "List[Document]"})
    said = " ".join(e.value.errors)
    for part in ("must be int", "takes Ranked[Document]", "no block none", "cycle", "output names no step", "no input c"):
        assert part in said
    assert [s["block"] for s in pipeline.validate(PLAN, r, {"docs": "List[Document]"})] == ["filter_terms@1.0.0", "dedupe@1.0.0", "rank_terms@1.0.0", "head@1.0.0"]
    assert pipeline.build(PLAN, r, {"docs": ("List[Document]", as_documents(spark, folder))}, observe=True).count() == 10


def _streamed(spark, path, make, name):
    schema = "user_id long, ts timestamp, at double, event_type string, event_id long"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(source).writeStream.format("memory").queryName(name).outputMode("update" if name == "acts" else "append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batch(spark, folder, tmp_path):
    e = spark.read.parquet(f"{folder}/events.parquet").where("user_id < 8")
    rows = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), clock.epoch(F.col("ts")).alias("at"), "event_type", "event_id")
    path = str(tmp_path / "events")
    rows.orderBy("ts").coalesce(1).write.parquet(path)
    # a last row far ahead closes every window
    rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(4e9))).withColumn("at", F.lit(4e9)).write.mode("append").parquet(path)
    got = _streamed(spark, path, lambda s: streaming.tumbling_counts(s, "ts", ["event_type"]), "counts").where("start < '2090-01-01'")
    assert sorted(one(got)) == sorted(one(streaming.tumbling_counts(rows, "ts", ["event_type"])))
    got = _streamed(spark, path, lambda s: streaming.session_windows(s, "ts", ["user_id"], "6 hours"), "sessions").where("start < '2090-01-01'")
    assert sorted(one(got)) == sorted(one(streaming.session_windows(rows, "ts", ["user_id"], "6 hours")))


def texts_of(spark, made, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(made(F.col("t"))).collect()]


def test_masks_whole_runs_and_escapes_names(spark):
    assert texts_of(spark, text.mask_personal, "12345678901234567890", "call 555-123-4567 x", "id1234567", "v1.234567890", None) == ["[phone]", "call [phone] x", "id[number]", "v1.[number]", ""]
    got = texts_of(spark, lambda c: text.mask_personal(c, ("A.B (x)", "Lia")), "ask a.b (x now", "A.B (x)y", "axb (x) lia")
    assert got == ["ask a.b (x now", "[name]y", "axb (x) [name]"]
    assert texts_of(spark, lambda c: text.personal_kinds(c, ("Ann",)), "ann at a@b.org") == [["email", "name"]]


def test_character_references(spark):
    assert texts_of(spark, text.unescape, "&eacute;&#233;&#xE9;&#x20AC;&euro; &amp;lt; &nope; &#0; &#38;amp; a&b;") == ["ééé€€ &lt; &nope; &#0; &amp; a&b;"]


def test_labels_fold_compatibility_forms(spark):
    assert texts_of(spark, text.fold_case, " Straße  X ", "ﬁne", "ＡＢ", None, "a\tb") == ["strasse x", "fine", "ab", "", "a b"]


def test_second_person_and_pronouns(spark):
    assert texts_of(spark, lambda c: text.second_person(c, ("Sam", "Sammy")), "Sam likes hiking. sammy's sister met Sam; your name is Sam", "Samson") == ["You likes hiking. Your sister met you; your name is Sam", "Samson"]
    assert texts_of(spark, lambda c: text.with_pronouns(c, "she"), "{Subj} said {poss} name to {obj}") == ["She said her name to her"]


def test_marks_of_origin(spark):
    marked = texts_of(spark, lambda c: text.mark_origin(c, F.lit("u-1")), " a note ", None)
    assert texts_of(spark, text.origin_uid, *marked, "plain") == ["u-1", "u-1", None]
    assert texts_of(spark, text.origin_comment, *marked, "plain — x") == ["a note", "", "plain — x"]


def test_fact_lines(spark):
    said = "plan\nFACT: cat: Tom\nfact: Dog : none\nFACT: cat: \"Tim\"\n\n\n\nFACT: x: 1\nend"
    got = texts_of(spark, text.facts, said)[0]
    assert [(f.label, f.value) for f in got] == [("cat", "Tim"), ("x", "1")]
    assert texts_of(spark, text.without_facts, said) == ["plan\n\nend"]


def test_times_with_fractions_and_zones(spark):
    said = ["2024-05-01T10:00:00.5Z", "2024-05-01T12:00:00+02:00", "2024-05-01 10:00:00", "Wed, 1 May 2024 12:00:00 +0200", "Wed, 01 May 2024 10:00:00 GMT", "soon", None]
    assert texts_of(spark, clock.parse_time, *said) == [1714557600.5] + [1714557600.0] * 4 + [None, None]


def test_days_and_ranges(spark):
    row = spark.sql("SELECT TIMESTAMP '2024-05-03 14:00:00' AS a, TIMESTAMP '2024-05-03 15:30:00' AS b").select(
        clock.day_descriptor(F.weekday("a")), clock.part_of_day(F.hour("a")), clock.part_of_day(F.lit(4)), clock.part_of_day(F.lit(23)), clock.spoken_range(F.col("a"), F.col("b"))
    )
    assert one(row) == [("the end of the work week", "afternoon", "the small hours", "night", "from two o'clock to half past three")]


def _rhythm(spark, days):
    e = spark.createDataFrame([(1, d) for d in days], "k long, day string").select("k", F.to_timestamp("day").alias("ts"))
    return [(r.kind, r.period, r.n) for r in series.detect_rhythm(e, "k", "ts").collect()]


def test_rhythms(spark):
    assert _rhythm(spark, ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-15", "2024-01-22", "2024-01-29"]) == [("weekly", 7.0, 5)]
    assert _rhythm(spark, ["2024-01-01", "2024-01-15", "2024-01-29", "2024-02-12"]) == [("biweekly", 14.0, 4)]
    assert _rhythm(spark, ["2024-01-05", "2024-02-05", "2024-03-05", "2024-04-05"]) == [("monthly-dom", 30.0, 4)]
    assert _rhythm(spark, ["2024-01-26", "2024-02-23", "2024-03-29", "2024-04-26", "2024-05-31"]) == [("monthly-nth", 30.0, 5)]
    assert _rhythm(spark, ["2024-01-09", "2024-02-13", "2024-03-12", "2024-04-09"]) == [("monthly-nth", 30.0, 4)]
    assert _rhythm(spark, ["2024-01-01", "2024-01-04", "2024-01-07", "2024-01-13", "2024-01-16"]) == [("interval", 3.0, 5)]
    assert _rhythm(spark, ["2024-01-01", "2024-01-02", "2024-01-03"]) == []


def test_recall_wants_a_hit(spark):
    kind = "id long, priority int, triggered int, sim double, recency double, age_from double, tag_overlap int, activation double, expiry double, cooldown double"
    rows = [(1, 10, 0, None, 0.0, 0.0, 3, 1.0, None, None), (2, 1, 1, None, 0.0, 0.0, 0, 0.0, None, None), (3, 1, 0, 0.7, 0.0, 0.0, 0, 0.0, None, None), (4, 1, 0, 0.4, 0.0, 0.0, 0, 0.0, None, None), (5, 1, 1, 0.9, 0.0, 0.0, 0, 0.0, 50.0, None), (6, 9, 1, None, 0.0, 0.0, 0, 0.0, None, 200.0)]
    got = retrieval.recall(spark.createDataFrame(rows, kind), F.lit(100.0), floor=0.4, rescale=True)
    assert [(r.id, r.score) for r in got.collect()] == [(6, 6.5), (2, 2.5), (3, 1.25)]


def test_two_hop_returns_k_others(spark):
    v = spark.createDataFrame([(i, [math.cos(i / 100), math.sin(i / 100)]) for i in range(10)], "vec_id long, embedding array<double>")
    chosen = v.where("vec_id < 4")
    assert sorted(r.vec_id for r in retrieval.two_hop(v, chosen, 2, 0.5).collect()) == [4, 5]


def test_cosine_search_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    want = sorted(one(retrieval.cosine_search(v, v.where("vec_id % 7 = 0"), 3)))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 100)
    assert sorted(one(retrieval.cosine_search(v, v.where("vec_id % 7 = 0"), 3))) == want


def test_recall_has_no_window(spark, folder):
    for name in ("recall_topk", "hybrid_search"):
        assert "Window" not in QUERIES[name](spark, folder)._jdf.queryExecution().toString()


def test_token_overlap_is_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.2)), 25)}" for _ in range(rng.randint(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = {i: set(t.split()) for i, t in rows}
    for least, share in ((2, 0.0), (2, 0.8), (1, 0.5)):
        got = joins.token_overlap(df.select(F.col("id").alias("a"), "t"), df.select(F.col("id").alias("b"), "t"), "a", "b", F.split("t", " "), least, share)
        want = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if min(len(sets[i]), len(sets[j])) >= least and len(sets[i] & sets[j]) >= max(least, share * min(len(sets[i]), len(sets[j])))}
        assert {(r.a, r.b, r.shared) for r in got.collect()} == want


def test_shortlist_waits(spark):
    items = spark.createDataFrame([(1, "red house hill", 1.0), (2, "red house", 2.0), (3, "blue sea", 3.0)], "key long, text string, ts double")
    turns = spark.createDataFrame([(1, "the red house on the hill", 1000.0), (2, "red house", 1500.0), (3, "red house", 9e6), (4, "blue", 9e6)], "turn_id long, text string, at double")
    said = spark.createDataFrame([(2, 900.0)], "key long, at double")
    assert sorted(one(joins.shortlist(items, turns, said, F.split("text", " ")).select("turn_id", "key", "shared"))) == [(3, 1, 2)]
    assert sorted(one(joins.shortlist(items, turns, said, F.split("text", " "), gap_s=50).select("turn_id", "key", "shared"))) == [(1, 1, 3), (2, 1, 2), (3, 1, 2)]
    assert one(joins.shortlist(items, turns.where("turn_id < 3"), said, F.split("text", " "), gap_s=50, per_day=1)) == []


def test_salience_pick(spark):
    kind = "id long, channel string, fit double, sensitivity string, corroborated boolean, created double, window_start double, window_end double, raised_count int, deflections int"
    rows = [(1, "news", 1.0, "none", False, 0.0, None, None, 0, 0), (2, "a", 0.5, "none", True, 0.0, None, None, 0, 0), (3, "a", 0.9, "grief_adjacent", True, 0.0, None, None, 0, 0), (4, "a", 1.0, "none", True, 0.0, 900.0, 999.0, 0, 0), (5, "a", 0.5, "none", True, -9.0, None, 50.0, 0, 0)]
    items = spark.createDataFrame(rows, kind).withColumn("salience", retrieval.salience(F.lit(0.0)))
    assert {r.id: r.salience for r in items.collect()} == {1: 1.8, 2: 1.4, 3: -13.28, 4: 0.95, 5: 1.4}
    assert one(retrieval.pick(items, F.lit(0.0)).select("id")) == [(5,)]


def test_context_caps_and_counts_shared_facts_once(spark):
    texts = spark.createDataFrame([(1, "Ann  met\nBob Lee"), (2, "annabel")], "id long, t string")
    nodes = spark.createDataFrame([("ann", 5), ("bob lee", 3), ("cy", 9)], "label string, mentions long")
    edges = spark.createDataFrame([("ann", "knows", "bob lee", 2), ("cy", "likes", "ann", 1), ("cy", "is", "cy", 7)], "src string, rel string, dst string, weight long")
    assert sorted(one(graph.context(texts, "id", "t", nodes, edges))) == [(1, 1, "ann knows bob lee"), (1, 2, "cy likes ann")]
    assert one(graph.context(texts, "id", "t", nodes, edges, most_facts=1)) == [(1, 1, "ann knows bob lee")]


def test_merge_sweep_dry_and_wet(spark):
    df = spark.createDataFrame([(1, "x", "A b", 2, "s"), (2, "x", "a  B", None, "r"), (3, "x", "c", 0, "s"), (4, "y", "a b", 1, None)], "id long, k string, t string, n long, s string")
    args = (["k"], text.norm(F.col("t")), "id", F.col("n"), "s")
    assert sorted(one(aggregates.merge_sweep(df, *args)), key=lambda r: r[1]) == [("x", 1, "active", 3, 2, "r|s"), ("x", 2, "merged", None, None, None), ("x", 3, "active", 1, 3, "s"), ("y", 4, "active", 1, 4, None)]
    assert one(aggregates.merge_sweep(df, *args, dry=True)) == [("x", 1, 2)]


def test_keyphrase_rule():
    assert folds.keyphrases("one two three four five six at 2024 go ox")[0] == ("one two three four", 16.0)
    assert [p for p, _ in folds.keyphrases("computer science, art")] == ["computer science", "art"]


def test_greedy_clusters_and_slices(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (3, 4, 0.95)], "a long, b long, sim double")
    assert sorted(one(greedy.greedy_clusters(pairs, 3))) == [(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.8)]
    got = texts_of(spark, lambda c: text.slice_around(c, F.lit("the extraordinary thing"), 30), "x" * 50 + " Extraordinary tale", "short")
    assert got == ["x" * 9 + " Extraordinary tale"[:21], "short"]


def test_phrase_activation_against_plain(spark):
    rows = [(1, float(60 * i), j, w) for i, turn in enumerate(["aa bb", "bb cc", "aa"]) for j, w in enumerate(turn.split())]
    state, last = {}, None
    for _, at, _, w in rows:
        state, last = folds.activate(at, [w], state, last), at
    got = working.activation(spark.createDataFrame(rows, "k long, at double, pos long, w string"), "k", "at", "w").withColumnRenamed("w", "item")
    assert {r.item: r.activation for r in got.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in state.items()}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, n long")
    upkeep.append(rows, path, "kind")
    upkeep.append(rows.where("kind = 'a'"), path, "kind")
    assert sorted(one(spark.read.parquet(path).select("kind", "n"))) == [("a", 1), ("a", 1), ("b", 2)]
    archive.replace_partitions(rows.where("kind = 'a'").withColumn("n", F.lit(9).cast("long")), path, "kind")
    assert sorted(one(spark.read.parquet(path).select("kind", "n"))) == [("a", 9), ("b", 2)]


def test_files_and_lines(spark, tmp_path):
    for name, data in (("a.txt", b"hello"), ("b.md", b"x\x00y"), ("c.bin", b"no"), (".hidden.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.html").write_bytes("<p>é".encode())
    got = {r.path.rsplit("/", 1)[1]: r.text for r in tables.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "hello", "d.html": "<p>é"}
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert sorted(one(tables.json_lines(spark, str(tmp_path / "log.jsonl"), "a long"))) == [(1,), (2,)]


def test_feeds(spark):
    rss = '<rss><channel><title>C</title><item><title><![CDATA[One & <b>two</b>]]></title><link>http://x/?a=1&amp;b=2</link><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item><item><title></title></item><item><title>Bad <b></item></channel></rss>'
    atom = '<feed xmlns="a"><entry x="1"><title>Three</title><link rel="self" href="http://y/"/><updated>2024-05-01T12:00:00+02:00</updated><summary>s</summary></entry></feed>'
    feeds = spark.createDataFrame([("r", rss), ("a", atom), ("n", "no feed")], "source string, raw string")
    got = sorted(one(tables.feed_items(feeds).select("source", "title", "link", "published")))
    assert got == [("a", "Three", "http://y/", 1714557600.0), ("r", "One & two", "http://x/?a=1&b=2", 1714557600.0)]


def test_maps_merge_on_two_levels(spark):
    got = spark.sql("SELECT map('x', map('a', 1, 'b', 2)) AS l, map('x', map('b', 3), 'y', map('c', 4)) AS r").select(upkeep.merge_maps(F.col("l"), F.col("r"))).first()[0]
    assert got == {"x": {"a": 1, "b": 3}, "y": {"c": 4}}


def test_plans_with_two_inputs_and_choices(spark):
    r = pipeline.standard()
    kind = "doc_id long, title string, text string, url string, ts double, source string"
    a = spark.createDataFrame([(1, "t", "x", "u1", 0.0, "s"), (2, "t", "y", "u2", 0.0, "s")], kind)
    b = spark.createDataFrame([(1, "t", "z", "u2", 0.0, "s"), (4, "t", "w", "u4", 0.0, "s")], kind)
    inputs = {"a": ("List[Document]", a), "b": ("List[Document]", b)}
    plan = {"steps": [{"id": "all", "block": "union_first", "input": {"first": "a", "second": "b"}}, {"id": "some", "block": "filter_terms", "input": "all", "params": {"terms": ["x", "w"]}}], "output": "some"}
    assert sorted(one(pipeline.build({**plan, "output": "all"}, r, inputs).select("doc_id", "text"))) == [(1, "x"), (2, "y"), (4, "w")]
    assert [(t["ok"], t["in"], t["out"], t.get("dropped")) for t in pipeline.trace(plan, r, inputs)] == [(True, {"first": 2, "second": 2}, 3, None), (True, {"input": 3}, 2, [2])]
    bad = {"steps": [{"id": "all", "block": "union_first", "input": {"first": "a", "other": "b"}, "params": {"key": "size"}}], "output": "all"}
    with pytest.raises(pipeline.PlanError) as e:
        pipeline.build(bad, r, inputs)
    for part in ("no port other", "port second is unbound", "must be one of text, title, url"):
        assert part in str(e.value)
    r.add(pipeline.Block("broken", "1.0.0", "List[Document]", "List[Document]", lambda df: df.select("nothing")))
    trail = pipeline.trace({"steps": [{"id": "x", "block": "broken", "input": "a"}], "output": "x"}, r, inputs)
    assert not trail[0]["ok"] and "nothing" in trail[0]["error"]


def test_stateful_streams(spark, folder, tmp_path):
    e = spark.read.parquet(f"{folder}/events.parquet").where("user_id < 4")
    rows = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), clock.epoch(F.col("ts")).alias("at"), "event_type", "event_id")
    path = str(tmp_path / "events")
    half = rows.agg(F.percentile("at", F.lit(0.5))).first()[0]
    rows.where(F.col("at") < half).coalesce(1).write.parquet(path)
    rows.where(F.col("at") >= half).coalesce(1).write.mode("append").parquet(path)
    got = _streamed(spark, path, lambda s: streaming.activation_stream(s, "user_id", "at", "event_type"), "acts")
    last = {}  # the sink has every batch; files are read in the order in which they were written
    for r in got.collect():
        last[r.user_id, r.item] = r.activation
    want = {(r.user_id, r.item): r.activation for r in working.activation(rows, "user_id", "at", "event_type").collect()}
    assert want.keys() <= last.keys() and all(last[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    got = _streamed(spark, path, lambda s: streaming.ingest_stream(s, "ts", "event_id", "4000 days"), "firsts")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in rows.collect())
