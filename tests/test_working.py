"""Activation and the phrase graph against plain replays, batch against stream."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.operators import folds, working
from loomspark.streaming import working as streaming

KIND = "conv long, turn long, at double, text string"


def replayed(events, tau=900.0, floor=0.02, most=1024):
    """{(key, item): activation} of [(key, at, item, boost)], event by event."""
    states, last = {}, {}
    for k, at, item, boost in sorted(events, key=lambda e: e[1]):
        state = states.setdefault(k, {})
        if k in last and at > last[k]:
            for i in list(state):
                state[i] *= math.exp(-(at - last[k]) / tau)
                if state[i] < floor:
                    del state[i]
        last[k] = at
        state[item] = min(1.0, state.get(item, 0.0) + boost)
        if len(state) > most:
            for i in sorted(state, key=lambda i: (-state[i], i))[most:]:
                del state[i]
    return {(k, i): v for k, s in states.items() for i, v in s.items()}


def activations(df, **options):
    rows = working.activation(df, "k", "at", "item", F.col("boost"), **options).collect()
    assert len({(r.k, r.item) for r in rows}) == len(rows)
    return {(r.k, r.item): r.activation for r in rows}


def test_activation_of_random_events(spark):
    rng = random.Random(3)
    events = [(k, float(rng.choice([rng.randint(0, 9000), rng.randint(0, 40) * 2500])), f"i{rng.randint(0, 9)}", rng.choice([0.5, 0.35])) for k in range(4) for _ in range(400)]
    got, want = activations(spark.createDataFrame(events, "k long, at double, item string, boost double").repartition(3)), replayed(events)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(v, abs=2e-6) for x, v in want.items())
    odd = spark.createDataFrame([(None, 1.0, "a", 0.5), (1, None, "a", 0.5), (1, 2.0, None, 0.5), (1, 3.0, "a", 0.0)], "k long, at double, item string, boost double")
    assert activations(odd) == {}


def test_activation_holds_the_bound_in_order(spark):
    rng = random.Random(4)
    events = [(1, float(t), f"i{rng.randint(0, 60)}", rng.choice([0.5, 0.35])) for t in range(0, 4000, 7)] + [(2, 5.0, "x", 0.35), (2, 50.0, "y", 0.5)]
    got, want = activations(spark.createDataFrame(events, "k long, at double, item string, boost double"), most=10), replayed(events, most=10)
    assert got.keys() == want.keys() and len([x for x in got if x[0] == 1]) == 10 and all(got[x] == pytest.approx(v, abs=2e-6) for x, v in want.items())


def test_activation_of_one_key_with_a_million_events(spark):
    n = 1_000_000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("k"), (F.col("id") * 3.0).alias("at"), F.concat(F.lit("i"), F.col("id") * 7919 % 1000 % 37).alias("item"),
        F.when(F.col("id") % 3 == 0, 0.35).otherwise(0.5).alias("boost"),
    )
    got = activations(df)
    last = [(1, i * 3.0, f"i{i * 7919 % 1000 % 37}", 0.35 if i % 3 == 0 else 0.5) for i in range(n - 60_000, n)]  # what is older has decayed
    want = replayed(last)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(v, abs=2e-6) for x, v in want.items())


# --- the graph, replayed plainly: all nodes decay at every turn --------------------------------------------------


def plain_turns(turns, rules, carried=None):
    nodes, edges, frame, seed, low, last, rows = {}, {}, [], None, 0, None, []
    for n, (at, text) in enumerate(turns, 1):
        if carried and n == 1:
            for x in carried[0]:
                v = x["value"] * math.exp(-max(0, at - x["at"]) / rules.carried_tau) * rules.carry
                if v >= rules.floor:
                    nodes[x["label"]] = [v, True]
            for e in carried[1]:
                w = e["weight"] * math.exp(-max(0, at - e["at"]) / rules.carried_tau)
                if e["a"] in nodes and e["b"] in nodes and w >= 0.1:
                    edges[e["a"], e["b"]] = w
        elif last is not None:
            for x in nodes.values():
                x[0] *= math.exp(-(at - last) / (rules.carried_tau if x[1] else rules.tau))
        last = at
        found = [p for p, _ in folds.keyphrases(text or "", rules.phrases) if p not in rules.common]
        woke = 0
        for p in found:
            x = nodes.setdefault(p, [0.0, False])
            woke += x[1]
            x[0], x[1] = min(1.0, x[0] + rules.boost), False
        some = sorted(set(found[: rules.linked]))
        for i, a in enumerate(some):
            for b in some[i + 1 :]:
                edges[a, b] = edges.get((a, b), 0) + 1
        nodes = {p: x for p, x in nodes.items() if x[0] >= rules.floor}
        nodes = dict(sorted(nodes.items(), key=lambda kv: (-kv[1][0], kv[0]))[: rules.nodes])
        edges = {e: w for e, w in edges.items() if e[0] in nodes and e[1] in nodes}
        edges = dict(sorted(edges.items(), key=lambda kv: (-kv[1], kv[0]))[: rules.edges])
        before, frame = set(frame), [p for p, x in nodes.items() if not x[1]][: rules.frame]
        seed = seed or set(frame)
        acts = [x[0] for x in nodes.values() if not x[1]]
        entropy = -sum(v / sum(acts) * math.log(v / sum(acts)) for v in acts)
        share = lambda x, y: 1 - (len(x & y) / len(x | y) if x | y else 1)
        churn = share(set(frame), before)
        low = 0 if len(acts) < rules.frame else low + 1 if round(entropy, 4) < rules.least_entropy or round(churn, 4) == 0 else 0
        rows.append((n, len(nodes), sum(x[1] for x in nodes.values()), woke, len(edges), round(entropy, 4), round(churn, 4), round(share(set(frame), seed), 4), low >= rules.stall, frame))
    return rows, nodes, edges


def talk(rng, n):
    words = ["budget", "server", "migration", "quarterly", "parsley", "garden", "release", "plan", "coffee", "marketing", "engine", "review", "tokyo", "violin", "harbor", "winter"]
    at, turns = 0.0, []
    for _ in range(n):
        at += rng.choice([5, 60, 400, 4000])
        turns.append((at, rng.choice([None, ""]) if rng.random() < 0.1 else ". ".join(" the ".join(" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))))
    return turns


SMALL = working.Rules(nodes=9, edges=12, frame=4, stall=2, least_entropy=1.2, common=frozenset(["coffee"]))


def measured(rows):
    return {(r.conv, r.turn): (r.n, *(r[c] for c in ("nodes", "dormant", "woke", "edges", "entropy", "churn", "drift", "stalled", "frame"))) for r in rows}


def turns_table(spark, talks):
    return spark.createDataFrame([(k, i, at, t) for k, turns in talks.items() for i, (at, t) in enumerate(turns, 1)], KIND)


@pytest.mark.parametrize("rules", [working.Rules(), SMALL])
def test_graph_equals_plain_replay(spark, rules):
    rng = random.Random(5)
    talks = {k: talk(rng, 40) for k in range(6)}
    df = turns_table(spark, talks).repartition(5)
    got = working.graph_turns(df.withColumnRenamed("turn", "place"), "conv", "place", "at", "text", rules).withColumnRenamed("turn", "n").withColumnRenamed("place", "turn")
    plain = {k: plain_turns(t, rules) for k, t in talks.items()}
    assert measured(got.collect()) == {(k, i): r for k, (rows, *_) in plain.items() for i, r in enumerate(rows, 1)}
    notes = working.graph_notes(df, "conv", "turn", "at", "text", rules)
    for r in notes.collect():
        _, nodes, edges = plain[r.conv]
        end = talks[r.conv][-1][0]
        assert {n.label: pytest.approx(n.value * math.exp(-(end - n.at) / rules.tau), abs=1e-9) for n in r.nodes} == {p: x[0] for p, x in nodes.items()}
        assert {(e.a, e.b): e.weight for e in r.edges} == edges
        assert all(n.turns and len(n.turns) <= 8 and len(n.clauses) <= 3 and all(n.label in c.lower() for c in n.clauses) for n in r.nodes)
    # carried into the next conversation: dormant, and woken by a mention
    later = {k: [(at + 9e4, t) for at, t in talk(rng, 12)] for k in talks}
    held = {r.conv: (r.nodes, r.edges) for r in notes.collect()}
    again = working.graph_turns(turns_table(spark, later).withColumnRenamed("turn", "place"), "conv", "place", "at", "text", rules, notes).withColumnRenamed("turn", "n").withColumnRenamed("place", "turn").collect()
    assert measured(again) == {(k, i): r for k, t in later.items() for i, r in enumerate(plain_turns(t, rules, held[k])[0], 1)}
    assert any(r.dormant for r in again) and any("(earlier)" in r.briefing for r in again)


def test_graph_rules():
    g = working.PhraseGraph(working.Rules())
    g.step(0.0, working.phrases_of("Passing mention of parsley.", g.rules))
    g.step(900.0, [])
    assert g.value(g.nodes["parsley"], 900.0) == pytest.approx(0.4 / math.e)
    g.step(2800.0, [])
    assert "parsley" not in g.nodes and g.briefing() == ""
    for now in (3000.0, 3100.0, 3200.0):
        g.step(now, working.phrases_of("The risks of the quarterly budget! It was to the lunch plans.", g.rules))
    assert g.frame[0] in ("lunch plans", "quarterly budget") and '- quarterly budget: "The risks of the quarterly budget!"' in g.briefing() and "Links: " in g.briefing()


def test_graph_of_one_long_conversation_is_bounded(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv"), F.col("id").alias("turn"), (F.col("id") * 10.0).alias("at"), F.concat(F.lit("a thing called zed"), F.col("id") % 700, F.lit(" the next yak"), F.col("id") % 13).alias("text"))
    rows = working.graph_turns(df.withColumnRenamed("turn", "place"), "conv", "place", "at", "text", SMALL).collect()
    assert len(rows) == 5000 and max(r.nodes for r in rows) <= 9 and max(r.edges for r in rows) <= 12


def test_idle_conversations_give_their_notes(spark, tmp_path):
    path, out = str(tmp_path / "turns"), str(tmp_path / "out")
    parts = [[(1, 1, 1000.0, "the quarterly budget"), (2, 1, 1010.0, "some parsley")], [(2, 2, 9000.0, "a server migration")], [(3, 1, 9001.0, "the violin")], [(1, 2, 9002.0, "quarterly budget")]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(KIND).parquet(path).withColumnRenamed("turn", "place")
            graph = streaming.graph_stream(stream, "conv", "place", "at", "text", idle=3600.0, late="10 seconds")
            query = graph.writeStream.outputMode("update").foreachBatch(lambda x, _: x.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert query.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(out)
    notes = {r.conv: [n.label for n in r.held_nodes] for r in rows.where("kind = 'notes'").collect()}
    assert notes[1] == ["quarterly budget"]
    assert [r.turn for r in rows.where("kind = 'turn' AND conv = 1 AND place = 2").collect()] == [1]  # begun anew


def test_graph_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    talks = {k: talk(rng, 24) for k in range(4)}
    df = turns_table(spark, talks)
    path, out = str(tmp_path / "turns"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for a, b in ((0, 9), (9, 10), (10, 25)):  # a restart from the checkpoint between the pieces
            df.where(f"turn > {a} AND turn <= {b}").coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(KIND).parquet(path).withColumnRenamed("turn", "place")
            graph = streaming.graph_stream(stream, "conv", "place", "at", "text", SMALL, idle=3600.0, late="10 days")
            query = graph.writeStream.outputMode("update").foreachBatch(lambda x, _: x.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert query.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(out).where("kind = 'turn'").withColumnRenamed("turn", "n").withColumnRenamed("place", "turn").collect()
    batch = working.graph_turns(df.withColumnRenamed("turn", "place"), "conv", "place", "at", "text", SMALL).withColumnRenamed("turn", "n").withColumnRenamed("place", "turn").collect()
    assert Counter((r.conv, r.turn) for r in rows) == Counter((r.conv, r.turn) for r in batch)
    assert measured(rows) == measured(batch) and {(r.conv, r.turn): r.briefing for r in rows} == {(r.conv, r.turn): r.briefing for r in batch}
