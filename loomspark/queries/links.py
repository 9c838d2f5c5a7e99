"""Queries of the join, retrieval, graph, set and pipeline operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.text import norm, tokens
from ..functions.vectors import jaccard
from ..operators import folds, graph, greedy, joins, retrieval, working
from ..operators.windows import top_per_group
from ..plans import pipeline
from ..sources.tables import table
from .registry import query
from .text import RAKE, TOKENS


# --- joins -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate, l_linenumber, l_quantity, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_quantity > 45 ORDER BY ALL LIMIT 50")
def join_inner_topn(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    names = ["o_orderkey", "o_orderdate", "l_linenumber", "l_quantity", "l_partkey"]
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(*names).orderBy(*names).limit(50)


@query("SELECT c_custkey, count(o_orderkey) AS n_children, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_nested_collect(spark, d):
    children = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = joins.nested(table(spark, d, "customer").select("c_custkey"), children, "c_custkey", ["o_orderkey"])
    return out.select("c_custkey", "n_children", F.array_join(F.transform("children", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT doc_id, coalesce(CASE WHEN source IN ('src1', 'src2') THEN 'curated' WHEN source = 'src3' THEN 'crawl' END, 'base') AS bundle FROM documents")
def join_left_default(spark, d):
    bundles = spark.createDataFrame([("src1", "curated"), ("src2", "curated"), ("src3", "crawl")], "source string, bundle string")
    return joins.with_default(table(spark, d, "documents").select("doc_id", "source"), F.broadcast(bundles), "source", "bundle", "base").select("doc_id", "bundle")


_LAYER = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END"


@query(f"SELECT user_id, event_type AS layer, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_LAYER} DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def effective_layer(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return joins.effective(rows, ["user_id"], F.expr(_LAYER), "event_id").select("user_id", F.col("event_type").alias("layer"), "event_id")


_MIRRORS = """o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN 'u' || o_orderkey END AS uid, o_orderpriority AS title, o_orderdate AS start, o_orderstatus AS body FROM orders WHERE o_orderkey % 3 > 0),
m AS (SELECT o_orderkey + 10000000 AS id, CASE WHEN o_orderkey % 4 > 1 THEN 'u' || o_orderkey END AS uid, o_orderpriority AS title, o_orderdate AS start, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS body FROM orders WHERE o_orderkey % 5 > 0)"""


@query(
    f"""WITH {_MIRRORS}, t AS (SELECT *, CASE WHEN uid IS NOT NULL THEN row_number() OVER (PARTITION BY uid ORDER BY id) ELSE 1 END AS twin FROM m),
    p AS (SELECT o.*, t.id AS mid, o.title = t.title AND o.start = t.start AND o.body IS NOT DISTINCT FROM t.body AS same FROM o LEFT JOIN t ON o.uid = t.uid AND t.uid IS NOT NULL AND twin = 1),
    l AS (SELECT id, lower(title) AS k, start, row_number() OVER (PARTITION BY lower(title), start ORDER BY id) AS n FROM p WHERE mid IS NULL),
    f AS (SELECT id AS mid, lower(title) AS k, start, row_number() OVER (PARTITION BY lower(title), start ORDER BY id) AS n FROM t WHERE uid IS NULL),
    r AS (SELECT CASE WHEN same THEN 'skip' ELSE 'update' END AS action, id AS origin_id, mid AS mirror_id FROM p WHERE mid IS NOT NULL
      UNION ALL SELECT CASE WHEN mid IS NULL THEN 'create' ELSE 'adopt' END, l.id, mid FROM l LEFT JOIN f ON l.k = f.k AND l.start = f.start AND l.n = f.n)
    SELECT * FROM r UNION ALL SELECT 'delete', NULL, id FROM m WHERE id NOT IN (SELECT mirror_id FROM r WHERE mirror_id IS NOT NULL)"""
)
def diff_plan(spark, d):
    orders = table(spark, d, "orders")
    title, start = F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("start")
    uid = F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
    origins = orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, uid).alias("uid"), title, start, F.col("o_orderstatus").alias("body"))
    body = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("body")
    mirrors = orders.where("o_orderkey % 5 > 0").select((F.col("o_orderkey") + 10000000).alias("id"), F.when(F.col("o_orderkey") % 4 > 1, uid).alias("uid"), title, start, body)
    return joins.reconcile(origins, mirrors)


@query("SELECT user_id, arg_max(event_id, CASE WHEN event_type = 'purchase' THEN 1000000000 ELSE 0 END - event_id) AS event_id, min(event_id) AS first_seen FROM events GROUP BY user_id")
def fold_latest(spark, d):
    """One row per key: a purchase supersedes, else the first seen; the first-seen order is kept."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("p"))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("p", -F.col("event_id"))).alias("event_id"), F.min("event_id").alias("first_seen"))


@query("SELECT page_id FROM pages WHERE NOT (page_id % 3 = 0 AND page_id % 2 = 0 AND page_id >= 40)")
def incremental_skip(spark, d):
    """The registry knows every third page, with a stale fingerprint for odd ones; reads before page 40 are too old."""
    pages = table(spark, d, "pages").select("page_id", F.md5("html").alias("fingerprint"))
    known = pages.where("page_id % 3 = 0").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"), F.col("page_id").alias("read_at"))
    return joins.to_read_again(pages, known, "page_id", F.lit(40)).select("page_id")


_PHRASES = "SELECT DISTINCT lower(trim(split_part(split_part(text, chr(10), 1), '.', 1))) AS phrase FROM documents"
_WHOLE = f"p AS (SELECT phrase FROM ({_PHRASES}) WHERE phrase <> '' AND NOT contains(phrase, '  '))"


@query(
    rf"WITH {_WHOLE} SELECT DISTINCT conv_id, turn, phrase FROM conversations, p WHERE contains(' ' || lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) || ' ', ' ' || phrase || ' ')"
)
def trigger_match(spark, d):
    """Openings of documents, as phrases of any length, in conversation turns, at white-space boundaries."""
    first = F.split_part(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("."), F.lit(1))
    phrases = table(spark, d, "documents").select(F.lower(F.trim(first)).alias("phrase")).distinct()
    phrases = phrases.where("phrase <> '' AND NOT contains(phrase, '  ')")
    return joins.phrases_in(table(spark, d, "conversations"), ["conv_id", "turn"], F.col("text"), phrases, "phrase")


@query("SELECT DISTINCT doc_id, trim(t) AS trigger FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[,;/]')) AS t FROM documents) WHERE trim(t) <> ''")
def mem_trigger_explode(spark, d):
    parts = F.explode_outer(F.split(F.lower("text"), "[,;/]"))
    return table(spark, d, "documents").select("doc_id", parts.alias("t")).select("doc_id", F.trim("t").alias("trigger")).where("trigger <> ''").distinct()


_T3 = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))"


@query(
    f"""WITH i AS (SELECT item_id, unnest({_T3}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n_left FROM i GROUP BY item_id),
    c AS (SELECT conv_id, turn, unnest({_T3}) AS w FROM conversations WHERE role = 'user')
    SELECT i.item_id, conv_id, turn, count(*) AS shared, any_value(n_left) AS n_left FROM i JOIN c ON i.w = c.w JOIN n ON i.item_id = n.item_id GROUP BY i.item_id, conv_id, turn HAVING count(*) >= 2"""
)
def token_overlap_rank(spark, d):
    items = table(spark, d, "benchmark")
    turns = table(spark, d, "conversations").where("role = 'user'").withColumn("key", F.struct("conv_id", "turn"))
    pairs = joins.token_overlap(items, turns, "item_id", "key", tokens(F.col("text"), 4), 2)
    return pairs.select("item_id", "key.conv_id", "key.turn", "shared", F.col("n_left").cast("long").alias("n_left"))


@query(
    f"""WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')) AS w FROM conversations WHERE role = 'user' AND turn = 0),
    u AS (SELECT conv_id, len(w) AS n, unnest(w) AS t FROM a),
    p AS (SELECT x.conv_id AS a, y.conv_id AS b, count(*) AS s, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.t = y.t AND x.conv_id > y.conv_id GROUP BY x.conv_id, y.conv_id)
    SELECT DISTINCT a AS conv_id FROM p WHERE s >= 2 AND s / least(nx, ny) >= 0.8"""
)
def fuzzy_topic_exists(spark, d):
    """Opening turns that an earlier conversation's opening resembles: 80 % of the shorter's words and two at least."""
    turns = table(spark, d, "conversations").where("role = 'user' AND turn = 0")
    left, right = turns.select(F.col("conv_id").alias("a"), "text"), turns.select(F.col("conv_id").alias("b"), "text")
    pairs = joins.token_overlap(left, right, "a", "b", tokens(F.col("text"), 4), 2, 0.8)
    return pairs.where("a > b").select(F.col("a").alias("conv_id")).distinct()


_QUOTES = "SELECT conv_id, turn AS said, trim(substr(text, 5, 20)) AS quote FROM conversations WHERE turn % 2 = 0"


@query(
    rf"""WITH q AS ({_QUOTES} UNION ALL SELECT conv_id, turn, 'nowhere said' FROM conversations WHERE turn = 1),
    n AS (SELECT *, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS k FROM q)
    SELECT n.conv_id, said, quote, min(c.turn) AS grounded_turn FROM n LEFT JOIN conversations c ON n.conv_id = c.conv_id AND contains(lower(trim(regexp_replace(c.text, '\s+', ' ', 'g'))), k) AND length(k) >= 6 GROUP BY n.conv_id, said, quote"""
)
def ground_quotes(spark, d):
    turns = table(spark, d, "conversations")
    quotes = turns.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("said"), F.trim(F.substring("text", 5, 20)).alias("quote"))
    quotes = quotes.union(turns.where("turn = 1").select("conv_id", F.col("turn").alias("said"), F.lit("nowhere said").alias("quote")))
    return graph.ground(quotes, turns, "conv_id")


# --- graph -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS type, lower(o_orderpriority) AS norm, count(*) AS mentions, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS aliases FROM orders GROUP BY o_orderstatus, lower(o_orderpriority)")
def kg_nodes(spark, d):
    return graph.resolve_nodes(table(spark, d, "orders").select(F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("label")))


@query(
    """WITH c AS (SELECT o_custkey, o_orderstatus, o_orderdate, o_orderkey, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM c),
    f AS (SELECT o_custkey, run, any_value(o_orderstatus) AS o_orderstatus, min(o_orderdate) AS valid_from, count(*) AS mentions FROM r GROUP BY o_custkey, run)
    SELECT o_custkey, 'status' AS rel, o_orderstatus, valid_from, mentions, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS active FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY run)"""
)
def kg_validity(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", F.lit("status").alias("rel"), "o_orderstatus", "o_orderdate", "o_orderkey")
    return graph.validity(orders, "o_custkey", "rel", "o_orderstatus", "o_orderdate", "o_orderkey")


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'u' || user_id END AS src, CASE WHEN event_id % 7 = 0 THEN 'u' || user_id ELSE event_type END AS dst, CASE WHEN event_id % 5 = 0 THEN 'is' ELSE 'did' END AS rel, value > 2 AS ok FROM events)
    SELECT event_id, CASE WHEN trim(src) = '' THEN 'incomplete' WHEN lower(src) = lower(dst) THEN 'self_loop' WHEN lower(src) = 'u1' AND rel = 'is' THEN 'identity' WHEN NOT coalesce(ok, false) THEN 'ungrounded' END AS reason FROM e"""
)
def kg_fold_refusals(spark, d):
    e = table(spark, d, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    src, dst = F.when(F.col("event_id") % 11 == 0, " ").otherwise(user), F.when(F.col("event_id") % 7 == 0, user).otherwise(F.col("event_type"))
    rel = F.when(F.col("event_id") % 5 == 0, "is").otherwise("did")
    return e.select("event_id", graph.refusal(src, dst, rel, F.col("value") > 2, "u1", ("is", "is called")).alias("reason"))


_NODES = "l AS (SELECT event_type AS label, count(*) AS mentions FROM events GROUP BY event_type UNION ALL SELECT 'the', 7 UNION ALL SELECT 'and', 5 UNION ALL SELECT 'le', 3 UNION ALL SELECT 'of the', 4)"


@query(
    rf"""WITH {_NODES}, t AS (SELECT doc_id, ' ' || lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) || ' ' AS t FROM documents),
    h AS (SELECT doc_id, label, mentions, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, label) AS rn FROM t, l WHERE contains(t, ' ' || label || ' ')),
    e AS (SELECT a.label AS src, 'near' AS rel, b.label AS dst, a.mentions + b.mentions AS weight FROM l a JOIN l b ON a.label < b.label),
    f AS (SELECT h.doc_id, rn, weight, src || ' ' || rel || ' ' || dst AS fact FROM h JOIN e ON h.label = e.src OR h.label = e.dst WHERE rn <= 6),
    u AS (SELECT doc_id, fact, min(rn) AS rn, any_value(weight) AS weight FROM f GROUP BY doc_id, fact),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn, weight DESC, fact) AS place FROM u)
    SELECT doc_id, CAST(place AS INT) AS place, fact FROM k WHERE place <= 12"""
)
def entity_context(spark, d):
    """What the graph knows about the entities that each text mentions: six entities and twelve facts at most."""
    nodes = table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("mentions"))
    nodes = nodes.union(spark.createDataFrame([("the", 7), ("and", 5), ("le", 3), ("of the", 4)], "label string, mentions long"))
    a, b = nodes.select(F.col("label").alias("src"), F.col("mentions").alias("m")), nodes.select(F.col("label").alias("dst"), F.col("mentions").alias("n"))
    edges = a.join(b, F.col("src") < F.col("dst")).select("src", F.lit("near").alias("rel"), "dst", (F.col("m") + F.col("n")).alias("weight"))
    texts = table(spark, d, "documents").select("doc_id", "text")
    return graph.context(texts, "doc_id", "text", nodes, edges).select("doc_id", "place", "fact")


@query(
    rf"""WITH t AS (SELECT conv_id, turn, unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS i FROM conversations),
    w AS (SELECT conv_id * 1000 + turn AS id, i, trim(lower(t), '''-') AS w, regexp_matches(t, '^[A-Za-z0-9]') AS word FROM t),
    {RAKE},
    s6 AS (SELECT id, phrase FROM k WHERE rank <= 6)
    SELECT p.phrase AS a, q.phrase AS b, count(*) AS n FROM s6 p JOIN s6 q ON p.id = q.id AND p.phrase < q.phrase GROUP BY ALL HAVING count(*) >= 2"""
)
def phrase_cooccurrence(spark, d):
    """Which keyphrases stand in a turn together, of each turn's six best."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return graph.cooccurrence(folds.with_keyphrases(turns, "id", "text", 6), ["id"], "phrase", 2, 6)


@query()
def phrase_graph(spark, d):
    """Activation of each conversation's words, folded in turn order (a minute a turn)."""
    words = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 60.0).alias("at"), F.posexplode_outer(tokens(F.col("text"), 6)).alias("pos", "w"))
    return working.activation(words.where("w IS NOT NULL"), "conv_id", "at", "w")


@query()
def working_graph_turns(spark, d):
    """What each conversation's phrase graph measures after every turn (a minute a turn)."""
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), (F.col("turn") * 60.0).alias("at"), "text")
    found = working.graph_turns(turns, "conv_id", "place", "at", "text")
    return found.withColumn("frame", F.array_join("frame", "; "))


@query()
def working_graph_notes(spark, d):
    """The phrases that each conversation leaves to the next, with the clauses they came from."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 60.0).alias("at"), "text")
    notes = working.graph_notes(turns, "conv_id", "turn", "at", "text")
    each = notes.select("conv_id", F.inline("nodes"), F.size("edges").alias("edges"))
    return each.select("conv_id", "label", F.round("value", 6).alias("value"), "at", F.array_join("turns", ",").alias("turns"), F.array_join("clauses", " / ").alias("clauses"), "edges")


# --- retrieval ---------------------------------------------------------------------------------------------------

_DOT = "round(list_inner_product(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[])), 6)"


@query(f"SELECT query_id, vec_id, sim FROM (SELECT q.vec_id AS query_id, v.vec_id, {_DOT.format('v', 'q')} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format('v', 'q')} DESC, v.vec_id) AS rn FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND {_DOT.format('v', 'q')} > 0) WHERE rn <= 5")
def cosine_search(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine_search(v, v.where("vec_id % 100 = 0"), 5)


@query(
    f"""WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS h, v.vec_id, {_DOT.format('v', 'q')} AS sim FROM embeddings v, c q WHERE v.vec_id NOT IN (SELECT vec_id FROM c)),
    t AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY sim DESC, vec_id) AS rn FROM s WHERE sim > 0.2)
    SELECT vec_id, max(sim) AS sim FROM t WHERE rn <= 4 GROUP BY vec_id ORDER BY sim DESC, vec_id LIMIT 8"""
)
def knn_two_hop(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.two_hop(v, v.where("vec_id % 100 = 0"), 4, 0.2)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format('a', 'b')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_DOT.format('a', 'b')} >= 0.4")
def similar_vectors(spark, d):
    return retrieval.similar_pairs(table(spark, d, "embeddings"), 0.4)


#: Vectors and, under new ids, two copies of each without one part in eight, scaled to unit length again.
_TWINS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings UNION ALL
  SELECT vec_id + (k + 1) * 10000000, list_transform(p, lambda x: x / sqrt(list_inner_product(p, p))) FROM (SELECT vec_id, k, list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i % 8 = k THEN 0.0 ELSE CAST(embedding[i] AS DOUBLE) END) AS p FROM embeddings, range(2) r(k)))"""


def _twins(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    cut = v.select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "embedding")
    cut = cut.select((F.col("vec_id") + (F.col("k") + 1) * 10_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when((i + 1) % 8 == F.col("k"), 0.0).otherwise(x)).alias("p"))
    size = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x))
    return v.union(cut.select("vec_id", F.transform("p", lambda x: x / size)))


@query(f"WITH {_TWINS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_inner_product(a.e, b.e), 6) >= 0.8")
def near_vectors(spark, d):
    """All pairs of near copies among vectors, those of equal ones too."""
    return retrieval.near_pairs(_twins(spark, d), 0.8, copies=True)


_PAIRS = f"""p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format('a', 'b')} AS sim, a.label % 10 AS pa, b.label % 10 AS pb FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_DOT.format('a', 'b')} >= 0.4)"""


@query(
    f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY a, b) AS rn FROM p),
    s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT i + 1, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN pb > pa THEN a ELSE b END) END FROM s JOIN o ON rn = i + 1)
    SELECT unnest(gone) AS vec_id FROM (SELECT gone FROM s ORDER BY i DESC LIMIT 1)"""
)
def embedding_near_dup(spark, d):
    nodes = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 10).alias("priority"))
    return greedy.drop_near_duplicates(retrieval.similar_pairs(table(spark, d, "embeddings"), 0.4), nodes)


def _clusters_sql(most: int, least: int) -> str:
    return f"""WITH RECURSIVE {_PAIRS}, w AS (SELECT a AS x, b AS y, sim FROM p UNION ALL SELECT b, a, sim FROM p),
    n AS (SELECT x, near, row_number() OVER (ORDER BY x) AS rn FROM (SELECT x, list(struct_pack(y := y, sim := sim) ORDER BY sim DESC, y) AS near FROM w GROUP BY x)),
    s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS seed, []::STRUCT(y BIGINT, sim DOUBLE)[] AS m UNION ALL
      SELECT i + 1, CASE WHEN made THEN list_concat(list_append(used, x), list_transform(m, lambda e: e.y)) ELSE used END, CASE WHEN made THEN x END, m FROM (
        SELECT i, used, x, list_filter(near, lambda e: NOT list_contains(used, e.y))[:{most - 1}] AS m, NOT list_contains(used, x) AND len(list_filter(near, lambda e: NOT list_contains(used, e.y))) >= {least - 1} AS made FROM s JOIN n ON rn = i + 1))
    SELECT seed, unnest(list_prepend(seed, list_transform(m, lambda e: e.y))) AS member, unnest(list_prepend(1.0::DOUBLE, list_transform(m, lambda e: e.sim))) AS sim FROM s WHERE seed IS NOT NULL"""


@query(_clusters_sql(8, 2))
def greedy_clusters(spark, d):
    return greedy.greedy_clusters(retrieval.similar_pairs(table(spark, d, "embeddings"), 0.4))


@query(_clusters_sql(6, 3))
def greedy_themes(spark, d):
    """Clusters of three or more; smaller ones leave their nodes to later seeds."""
    return greedy.greedy_clusters(retrieval.similar_pairs(table(spark, d, "embeddings"), 0.4), 6, 3)


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_MEM = f"""WITH m AS (SELECT d.doc_id AS id, CAST(d.doc_id % 10 AS INT) AS priority, CASE WHEN contains(' ' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || ' ', ' the license ') THEN 1 ELSE 0 END AS triggered,
round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6) AS sim, CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.5 END AS recency, CAST((1000000 - d.doc_id) * 1000 AS DOUBLE) AS age_from, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS tag_overlap, CASE WHEN source = 'src3' THEN 1.0 ELSE 0.0 END AS activation, d.doc_id % 13 AS x, d.doc_id % 17 AS y
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT id, round(0.5 * priority + 2.0 * triggered + 1.5 * CASE WHEN sim > 0.2 THEN (sim - 0.2) / 0.8 ELSE 0 END + 0.3 * recency * pow(0.5, (1000000000.0 - age_from) / 1209600.0) + 0.5 * tag_overlap + 0.6 * activation, 6) AS score
  FROM m WHERE (triggered = 1 OR sim > 0.2) AND x <> 0 AND (y <> 0 OR priority >= 8)),
c AS (SELECT id, score FROM s WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 5)"""


def _memories(spark, d):
    """Documents as memories: joined to vectors and labels; every 13th has expired, every 17th is cooling down."""
    held = F.contains(F.concat(F.lit(" "), norm(F.col("text")), F.lit(" ")), F.lit(" the license ")).cast("int")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", held.alias("triggered"))
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    sims = retrieval.similarity_to(v, v.where("vec_id = 7")).withColumnRenamed("vec_id", "doc_id")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(sims, "doc_id", "left").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 10).cast("int").alias("priority"),
        "triggered",
        "sim",
        F.when(F.col("quality") == 1, 1.0).otherwise(0.5).alias("recency"),
        ((1000000 - F.col("doc_id")) * 1000).cast("double").alias("age_from"),
        (F.col("lang") == "en").cast("int").alias("tag_overlap"),
        F.when(F.col("source") == "src3", 1.0).otherwise(0.0).alias("activation"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(1e9) - 1).alias("expiry"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(1e9) + 1).alias("cooldown"),
    )


@query(_MEM + " SELECT id, score FROM c")
def recall_topk(spark, d):
    """Candidates by trigger or by a similarity above the floor, rescaled from it; the other parts rank them."""
    return retrieval.recall(_memories(spark, d), F.lit(1e9), floor=0.2, rescale=True).select("id", "score")


@query(
    _MEM
    + f""", n AS (SELECT q.id AS h, v.vec_id, {_DOT.format('v', 'e')} AS sim FROM c q JOIN embeddings e ON e.vec_id = q.id JOIN embeddings v ON v.vec_id NOT IN (SELECT id FROM c) AND v.vec_id % 13 <> 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY sim DESC, vec_id) AS rn FROM n WHERE sim >= 0.3), r AS (SELECT vec_id AS id, max(sim) AS score FROM t WHERE rn <= 2 GROUP BY vec_id ORDER BY score DESC, id LIMIT 4)
    SELECT id, score, false AS related FROM c UNION ALL SELECT id, score, true FROM r"""
)
def recall_related(spark, d):
    """recall_topk and the live memories nearest to what it gives, as context."""
    chosen = retrieval.recall(_memories(spark, d), F.lit(1e9), floor=0.2, rescale=True).select("id", "score")
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    around = retrieval.two_hop(v.where("vec_id % 13 <> 0"), v.join(chosen.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), 2, 0.3)
    return chosen.withColumn("related", F.lit(False)).union(around.select("vec_id", "sim", F.lit(True)))


_HYBRID = f"""WITH m AS (SELECT d.doc_id AS id, CASE WHEN contains(' ' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || ' ', ' the license ') THEN 1 ELSE 0 END AS hit,
coalesce(round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6), 0) AS sim FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


@query(_HYBRID + " SELECT id, score FROM (SELECT id, round(0.6 * sim + 0.4 * hit, 6) AS score FROM m) WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def hybrid_search(spark, d):
    """Lexical hits and cosine in one weighted score."""
    hit = F.contains(F.concat(F.lit(" "), norm(F.col("text")), F.lit(" ")), F.lit(" the license ")).cast("int")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), hit.alias("hit"))
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    sims = retrieval.similarity_to(v, v.where("vec_id = 7")).withColumnRenamed("vec_id", "id")
    scored = docs.join(sims, "id", "left").select("id", F.round(0.6 * F.coalesce("sim", F.lit(0.0)) + 0.4 * F.col("hit"), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), F.asc("id")).limit(10)


_SALIENCE = """i AS (SELECT o_orderkey AS id, o_orderpriority AS channel, o_totalprice / 600000.0 AS fit, CAST(o_orderkey % 3 AS INT) AS raised, CAST(o_orderkey % 4 AS INT) AS deflected, CASE o_orderkey % 9 WHEN 0 THEN 'grief_adjacent' WHEN 1 THEN 'personal' ELSE 'none' END AS sensitivity,
  o_orderkey % 5 > 0 AS corroborated, epoch(o_orderdate::TIMESTAMP) AS created, CASE WHEN o_orderkey % 2 = 0 THEN epoch(o_orderdate::TIMESTAMP) + 86400 END AS ws, CASE WHEN o_orderkey % 4 = 0 THEN epoch(o_orderdate::TIMESTAMP) + 3 * 86400 END AS we FROM orders),
t AS (SELECT max(created) AS now FROM i),
w AS (SELECT *, CASE WHEN ws IS NOT NULL AND now < ws THEN 0.15 WHEN we IS NOT NULL AND now > we THEN greatest(0.0, 0.6 * (1 - (now - we) / 604800.0)) WHEN ws IS NOT NULL OR we IS NOT NULL THEN 1.0 ELSE pow(0.5, greatest(0.0, now - created) / 432000.0) END AS timely FROM i, t),
s AS (SELECT *, round(1.0 * (1.0 * timely + 0.8 * fit) - 0.5 * CASE WHEN channel = '1-URGENT' THEN 0.5 ELSE 0 END - 1.5 * CASE sensitivity WHEN 'none' THEN 0 WHEN 'personal' THEN 0.35 ELSE 10 END - 0.9 * (0.6 * raised + 0.8 * deflected), 6) AS salience FROM w)"""


def _initiative(spark, d):
    o, at = table(spark, d, "orders"), clock.epoch(F.col("o_orderdate"))
    k = F.col("o_orderkey")
    items = o.select(
        k.alias("id"), F.col("o_orderpriority").alias("channel"), (F.col("o_totalprice") / 600000.0).alias("fit"), (k % 3).cast("int").alias("raised_count"), (k % 4).cast("int").alias("deflections"),
        F.when(k % 9 == 0, "grief_adjacent").when(k % 9 == 1, "personal").otherwise("none").alias("sensitivity"), (k % 5 > 0).alias("corroborated"),
        at.alias("created"), F.when(k % 2 == 0, at + 86400).alias("window_start"), F.when(k % 4 == 0, at + 3 * 86400).alias("window_end"),
    )
    now = items.agg(F.max("created").alias("now"))  # one row
    return items.crossJoin(F.broadcast(now)).withColumn("salience", retrieval.salience(F.col("now"), F.lit("1-URGENT")))


@query(f"WITH {_SALIENCE} SELECT id, salience FROM s WHERE sensitivity <> 'grief_adjacent' AND (channel <> '5-LOW' OR corroborated) AND (ws IS NULL OR now >= ws) AND salience > 0 ORDER BY salience DESC, created, id LIMIT 1")
def salience_pick(spark, d):
    """Orders as things to bring up, 5-LOW as the channel that needs corroboration; the best one above the floor."""
    return retrieval.pick(_initiative(spark, d), F.col("now"), "5-LOW").select("id", "salience")


@query(f"WITH {_SALIENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY salience DESC, created DESC, id) AS rn FROM s) SELECT channel, id FROM r WHERE rn <= 12")
def bounded_queue(spark, d):
    """Each channel keeps its twelve most salient items, of equals the newer ones."""
    return top_per_group(_initiative(spark, d).select("channel", "id", "salience", "created"), ["channel"], [F.desc("salience"), F.desc("created"), F.asc("id")], 12).select("channel", "id")


# --- sets --------------------------------------------------------------------------------------------------------


@query("SELECT key, arg_min(origin, r) AS origin FROM (SELECT source AS key, 'documents' AS origin, 1 AS r FROM documents UNION ALL SELECT 'src' || (user_id % 40), 'events', 2 FROM events) GROUP BY key")
def union_first_wins(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("key"), F.lit("documents").alias("origin"), F.lit(1).alias("r"))
    events = table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string")).alias("key"), F.lit("events").alias("origin"), F.lit(2).alias("r"))
    return docs.unionByName(events).groupBy("key").agg(F.min_by("origin", "r").alias("origin"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{1,}')) AS w FROM conversations)
    SELECT a.conv_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1"""
)
def token_jaccard(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    a, b = t.where("turn = 0").select("conv_id", F.col("w").alias("a")), t.where("turn = 1").select("conv_id", F.col("w").alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.round(jaccard(F.array_distinct("a"), F.array_distinct("b")), 6).alias("jaccard"))


@query("SELECT lang, string_agg(source, ',' ORDER BY length(source) DESC, source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def distinct_ordered(spark, d):
    pairs = table(spark, d, "documents").select("lang", "source").distinct()
    listed = F.array_sort(F.collect_list(F.struct((-F.length("source")).alias("n"), "source")))
    return pairs.groupBy("lang").agg(listed.alias("s")).select("lang", F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return customers.join(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query(
    """WITH x AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM x)
    SELECT user_id, event_type, greatest(0, n - 3) AS remaining FROM r WHERE rn <= 3"""
)
def distinct_cap(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    w = Window.partitionBy("user_id")
    numbered = first.withColumn("rn", F.row_number().over(w.orderBy("first"))).withColumn("n", F.count("*").over(w))
    return numbered.where("rn <= 3").select("user_id", "event_type", F.greatest(F.lit(0), F.col("n") - 3).cast("long").alias("remaining"))


# --- pipelines ---------------------------------------------------------------------------------------------------

PLAN = {
    "name": "news",
    "steps": [
        {"id": "wanted", "block": "filter_terms", "input": "docs", "params": {"terms": ["the", "le"], "mode": "any"}},
        {"id": "once", "block": "dedupe@1.0.0", "input": "wanted", "params": {"key": "text"}},
        {"id": "ranked", "block": "rank_terms", "input": "once", "params": {"query": "the on"}},
        {"id": "top", "block": "head", "input": "ranked", "params": {"n": 10}},
    ],
    "output": "top",
}
_N = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_COUNTS = " + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) / {len(w)} * {k}" for w in ("the", "on") for t, k in (("lower(text)", 1), ("lower(coalesce(source, ''))", 2)))


def as_documents(spark, d):
    """The documents table as the pipelines' Document type."""
    return table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("title"), "text", F.lit("").alias("url"), F.col("doc_id").cast("double").alias("ts"), "source")


@query(
    f"""WITH f AS (SELECT * FROM documents WHERE contains({_N}, 'the') OR contains({_N}, 'le')), u AS (SELECT min(doc_id) AS doc_id FROM f GROUP BY {_N}),
    s AS (SELECT doc_id, CAST({_COUNTS} AS DOUBLE) AS score FROM f WHERE doc_id IN (SELECT doc_id FROM u)) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 10"""
)
def pipeline_news(spark, d):
    return pipeline.build(PLAN, pipeline.standard(), {"docs": ("List[Document]", as_documents(spark, d))}).select("doc_id", "score", "rank")


@query(
    f"""WITH f AS (SELECT * FROM documents WHERE contains({_N}, 'the') OR contains({_N}, 'le')), u AS (SELECT min(doc_id) AS doc_id FROM f GROUP BY {_N})
    SELECT 'docs' AS step, count(*) AS n FROM documents UNION ALL SELECT 'wanted', count(*) FROM f UNION ALL SELECT 'once', count(*) FROM u"""
)
def pipeline_provenance(spark, d):
    """Rows out of each step."""
    docs, out = as_documents(spark, d), None
    made = {"docs": docs}
    for step in ("wanted", "once"):
        made[step] = pipeline.build({**PLAN, "output": step}, pipeline.standard(), {"docs": ("List[Document]", docs)})
    for step, df in made.items():
        one = df.agg(F.lit(step).alias("step"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT coalesce(source, 'none') AS source, count(*) AS n_docs, CAST(sum(greatest(1, ceil(n_chars / 800.0))) AS BIGINT) AS n_chunks, count(*) FILTER (WHERE n_chars = 0) AS n_empty FROM documents GROUP BY coalesce(source, 'none')")
def distill_stats(spark, d):
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 800.0))
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(chunks).cast("long").alias("n_chunks"), F.count_if(F.col("n_chars") == 0).alias("n_empty"))
