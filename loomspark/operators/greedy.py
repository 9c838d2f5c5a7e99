"""Greedy choices in id order over a table of similar pairs, without a component in one task.

What a node's turn decides depends on earlier nodes within two steps only: it
acts on its neighbours, and so do they. Nodes lie in blocks of consecutive ids;
in each round the blocks of the next ids take the turns that don't wait for an
earlier block, all blocks at once. Used nodes and their pairs take no further
part, so in dense tables, where blocks wait for each other, a small share of the
pairs is ever looked at: the first turns use most nodes. In sparse ones a round
takes more blocks each time. Ids that follow a long chain need a round per block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import _written

#: Directed pairs in a block, about, and runs of ids that blocks are made of; a node's neighbours are in one block.
EDGES, CELLS = 1 << 20, 4096
#: Blocks in the first round, and in one at least and at most.
BEGIN, LEAST, BLOCKS = 16, 2, 1024
#: Share of a block's pairs that are taken to have no used end, at least, so that a wrong guess makes no huge block.
SHARE = 1 / 8
#: Rows of a counted table that is broadcast.
FEW = 1 << 17

#: (node, its neighbours as (id, similarity, priority), own priority, whether it counts alone, used nodes) -> (nodes used now, rows of the result)
Act = Callable[[int, list[tuple[int, float, float]], float, bool, set], tuple[list[int], list[tuple[int, float]]]]


def _turns(act: Act) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The turns of one block: rows of pairs (x, y) without used ends, and one row (x, x) for each node that has a turn."""

    def turns(one: pd.DataFrame) -> pd.DataFrame:
        x, y, sim = (one[c].to_numpy() for c in ("x", "y", "sim"))
        order = np.lexsort((-sim, y, x))
        order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]]  # of equal pairs the most similar
        x, y, sim, priority, blocked, alone = (one[c].to_numpy()[order] for c in ("x", "y", "sim", "priority", "blocked", "alone"))
        starts = np.flatnonzero(np.r_[True, np.diff(x) != 0])
        waits, own = np.logical_or.reduceat(blocked, starts).tolist(), np.flatnonzero(x == y).tolist()
        used, tainted, out = set(), set(), []
        for at, end, wait, head in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], waits, own):
            node, ids = int(x[at]), y[at:end].tolist()  # the node itself among them
            if wait or not tainted.isdisjoint(ids):
                tainted.update(ids)
                continue
            out.append((node, "done", 0, 0.0))
            if node in used:
                continue
            around = [n for n in zip(ids, sim[at:end].tolist(), priority[at:end].tolist()) if n[0] != node]
            gone, rows = act(node, around, float(priority[head]), bool(alone[head]), used)
            used.update(gone)
            out += [(g, "used", 0, 0.0) for g in gone] + [(node, "row", m, s) for m, s in rows]
        out.append((0, "seen", len(x), 0.0))
        return pd.DataFrame(out, columns=["node", "kind", "member", "sim"]).astype({"node": "int64", "kind": "str", "member": "int64", "sim": "float64"})

    return turns


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW else rows


def in_order(pairs: DataFrame, nodes: DataFrame | None, act: Act) -> tuple[DataFrame, DataFrame]:
    """(used, rows): all nodes of pairs (a, b, sim) take their turn in id order, as act() says; used nodes have none.

    nodes may have (node, priority, alone): nodes that are alone in the pairs take
    a turn if `alone` is true. used has the column node; rows has (seed, member, sim).
    act() sees neighbours that aren't used only.
    """
    spark = pairs.sparkSession
    ways = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    links = pairs.where("a <> b").select(F.explode(ways).alias("w"), "sim").select(F.col("w.x").cast("long").alias("x"), F.col("w.y").cast("long").alias("y"), F.col("sim").cast("double").alias("sim"))
    links = _written(links.repartition("x").sortWithinPartitions("x"))  # sorted, so that a round reads its ids only
    counted = links.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("links"))
    if nodes is not None:
        given = nodes.select("node", F.coalesce(F.col("priority").cast("double"), F.lit(0.0)).alias("priority"), F.coalesce("alone", F.lit(False)).alias("alone"))
        status = counted.join(given, "node", "full").where(F.col("links").isNotNull() | F.col("alone"))
    else:
        status = counted.select("node", F.lit(0.0).alias("priority"), F.lit(False).alias("alone"), "links")
    status = _written(status.select(F.col("node").cast("long").alias("node"), F.coalesce("priority", F.lit(0.0)).alias("priority"), F.coalesce("alone", F.lit(False)).alias("alone"), (F.coalesce("links", F.lit(0)) + 1).alias("links")))
    run = -(-status.count() // CELLS) or 1
    placed = status.orderBy("node").withColumn("_at", F.monotonically_increasing_id())
    # runs of ids, numbered in order: the part of the sort, then the place in it
    cell = F.col("_at") - F.pmod(F.col("_at"), F.lit(1 << 33)) + F.floor(F.pmod(F.col("_at"), F.lit(1 << 33)) / run)
    state = _written(placed.select("node", "priority", "alone", "links", cell.cast("long").alias("cell"), F.lit(True).alias("pending"), F.lit(False).alias("used")))
    found, wide, share = [], BEGIN, 1.0
    while True:
        mine = F.when(F.col("pending"), F.col("node"))
        cells = state.where("NOT used").groupBy("cell").agg(F.count("*").alias("free"), F.count(mine).alias("turns"), F.sum(F.when(F.col("pending"), F.col("links"))).alias("links"), F.min(mine).alias("low"), F.max(mine).alias("high")).orderBy("cell").collect()
        free, cells = sum(c.free for c in cells), [c for c in cells if c.turns]
        if not cells:
            break
        place, block, size = [], 0, 0.0
        for c in cells:
            if size and size + c.links * share > EDGES:
                block, size = block + 1, 0.0
            if block == wide:
                break
            place.append((c.cell, block))
            size += c.links * share
        cells = cells[: len(place)]
        turns, low, high = sum(c.turns for c in cells), cells[0].low, cells[-1].high
        to = state.where("NOT used").join(F.broadcast(spark.createDataFrame(place, "cell long, block int")), "cell", "left")
        to = to.select("node", "priority", "alone", F.when(F.col("pending"), F.col("block")).alias("block"))
        turn = to.where("block IS NOT NULL")
        near = links.where((F.col("x") >= low) & (F.col("x") <= high)).join(_few(turn.select(F.col("node").alias("x"), "block"), turns), "x")
        near = near.join(_few(to.select(F.col("node").alias("y"), "priority", F.col("block").alias("own")), free), "y")
        # the earliest block with a turn open in or beside y
        first = F.least(F.min("block").over(Window.partitionBy("y")), F.col("own"))
        rows = near.select("block", "x", "y", "sim", "priority", (first < F.col("block")).alias("blocked"), F.lit(False).alias("alone"))
        heads = turn.select("block", F.col("node").alias("x"), F.col("node").alias("y"), F.lit(0.0).alias("sim"), "priority", F.lit(False).alias("blocked"), "alone")
        said = _written(rows.unionByName(heads).groupBy("block").applyInPandas(_turns(act), "node long, kind string, member long, sim double"))
        found.append(said.where("kind = 'row'").select(F.col("node").alias("seed"), "member", "sim"))
        news = said.where("kind IN ('done', 'used')").groupBy(F.col("node").alias("n")).agg(F.bool_or(F.col("kind") == "done").alias("done"), F.bool_or(F.col("kind") == "used").alias("taken"))
        state = _written(state.join(news, F.col("node") == F.col("n"), "left").select("node", "priority", "alone", "links", "cell", (F.col("pending") & ~F.coalesce("done", F.lit(False))).alias("pending"), (F.col("used") | F.coalesce("taken", F.lit(False))).alias("used")))
        done, seen = said.agg(F.count_if(F.col("kind") == "done"), F.sum(F.when(F.col("kind") == "seen", F.col("member")))).first()
        share = max(SHARE, seen / sum(c.links for c in cells))
        wide = min(BLOCKS, 2 * wide) if done >= 0.75 * turns else max(LEAST, wide // 2) if done < 0.5 * turns else wide
    whole = spark.createDataFrame([], "seed long, member long, sim double")
    for rows in found:
        whole = whole.union(rows)
    return state.where("used").select("node"), whole


def greedy_clusters(pairs: DataFrame, most: int = 8, least: int = 2, nodes: DataFrame | None = None, clusters: int | None = None) -> DataFrame:
    """(seed, member, sim): in id order each free node seeds a cluster of its most similar free neighbours (ties: the smaller id).

    A cluster has `most` nodes at most, its seed among them. One of fewer than
    `least` isn't made, and its nodes stay free for later seeds; nodes (node,
    priority, alone) with `alone` are a cluster by themselves all the same. Only
    the first `clusters` are given, if that is set. The three uses are: merging
    notes (most=5, alone for long ones), themes (most=8, least=3), repeated facts
    (most=6). A node that may not take part is left out of the pairs, so it is
    skipped and the next similar one is looked at; below the pairs' similarity
    nothing is. Nulls are left out before; an empty table gives none.
    """

    def act(x: int, around: list, priority: float, alone: bool, used: set) -> tuple[list[int], list[tuple[int, float]]]:
        members = [(y, s) for s, y in sorted((-s, y) for y, s, _ in around if y not in used)[: most - 1]]
        if len(members) + 1 < least and not alone:
            return [], []
        return [x, *(y for y, _ in members)], [(x, 1.0), *((y, -s) for y, s in members)]

    _, rows = in_order(pairs, nodes, act)
    if clusters is not None:
        first = rows.select("seed").distinct().orderBy("seed").limit(clusters)
        rows = rows.join(first, "seed", "left_semi")
    return rows


def drop_near_duplicates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(vec_id) that go: pairs in order, of each pair with both alive the one with lower priority (ties: the later).

    nodes has vec_id and priority; a null priority is 0.
    """

    def act(x: int, around: list, priority: float, alone: bool, used: set) -> tuple[list[int], list[tuple[int, float]]]:
        gone = []
        for y, _, other in sorted(around):
            if y > x and y not in used:
                if other > priority:
                    return [*gone, x], []
                gone.append(y)
        return gone, []

    used, _ = in_order(pairs, nodes.select(F.col("vec_id").alias("node"), "priority", F.lit(False).alias("alone")), act)
    return used.withColumnRenamed("node", "vec_id")
