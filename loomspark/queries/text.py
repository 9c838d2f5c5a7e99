"""Queries of the text, document and archive operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import archive, documents
from ..operators.folds import with_keyphrases
from ..operators.windows import top_per_group
from ..sources.tables import feed_items, table
from .registry import query

NORM = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"


def _docs(spark, d):
    return table(spark, d, "documents")


TERMS = {"any": ["the license", "ou la"], "all": ["the", "and"], "none": ["the"]}


@query(f"SELECT doc_id FROM documents WHERE contains({NORM.format('text')}, 'the license') OR contains({NORM.format('text')}, 'ou la')")
def filter_any(spark, d):
    return documents.filter_terms(_docs(spark, d), TERMS["any"], mode="any").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains({NORM.format('text')}, 'the') AND contains({NORM.format('text')}, 'and')")
def filter_all(spark, d):
    return documents.filter_terms(_docs(spark, d), TERMS["all"], mode="all").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT contains({NORM.format('text')}, 'the')")
def filter_none(spark, d):
    return documents.filter_terms(_docs(spark, d), TERMS["none"], mode="none").select("doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY CASE WHEN {NORM.format('text')} = '' THEN 'b' || doc_id ELSE {NORM.format('text')} END")
def dedupe_exact(spark, d):
    return documents.dedupe(_docs(spark, d), F.col("text"), "doc_id").select("doc_id")


TITLE = "split_part(text, chr(10), 1)"


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY CASE WHEN {NORM.format(TITLE)} = '' THEN 'b' || doc_id ELSE {NORM.format(TITLE)} END")
def dedupe_title(spark, d):
    return documents.dedupe(_docs(spark, d), F.split_part("text", F.lit("\n"), F.lit(1)), "doc_id").select("doc_id")


def _count(text: str, term: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)} AS BIGINT)"


_SCORE = " + ".join(f"2 * {_count(f'lower({TITLE})', t)} + {_count('lower(text)', t)}" for t in ("the", "on"))


@query(f"SELECT doc_id, CAST({_SCORE} AS DOUBLE) AS score FROM documents")
def rank_term_overlap(spark, d):
    docs = _docs(spark, d)
    return documents.rank_terms(docs, "the on", F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text")).select("doc_id", "score")


@query(
    f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round({_SCORE} + 0.5 * doc_id / (SELECT max(doc_id) FROM documents), 6) AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 20"
)
def rank_head(spark, d):
    docs = documents.rank_terms(_docs(spark, d), "the on", F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), F.col("doc_id"), 0.5)
    return documents.head(docs.select("doc_id", F.round("score", 6).alias("score")), [F.desc("score"), F.asc("doc_id")], 20)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 40")
def doc_keyword_search(spark, d):
    return documents.search(_docs(spark, d), "the license", ["text"], F.col("doc_id"), [F.desc("doc_id")]).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'and') AND lang = 'en' AND contains(source, 'src1') AND doc_id BETWEEN 10 AND 150 ORDER BY doc_id DESC LIMIT 30")
def archive_search(spark, d):
    docs = _docs(spark, d).where("lang = 'en' AND contains(source, 'src1')")
    return documents.search(docs, "and", ["text"], F.col("doc_id"), [F.desc("doc_id")], 10, 150, 30).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 30 OFFSET 20")
def doc_index_page(spark, d):
    return documents.page(_docs(spark, d).where("lang = 'en'"), [F.asc("doc_id")], 20, 30).select("doc_id", "source")


@query("SELECT doc_id AS id, source AS title, substr(text, 1, 100) AS text, CAST(doc_id AS DOUBLE) AS ts FROM documents ORDER BY doc_id DESC LIMIT 40")
def scan_recent_docs(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.substring("text", 1, 100).alias("text"), F.col("doc_id").cast("double").alias("ts"))
    return docs.orderBy(F.desc("id")).limit(40)


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'http') AND contains(lower(url), '1')")
def doc_all_terms(spark, d):
    terms = F.array(F.lit("http"), F.lit("1"))
    return table(spark, d, "pages").where(F.forall(terms, lambda t: F.contains(F.lower("url"), t))).select("page_id")


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm FROM documents")
def text_norm(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.norm(F.col("text"))).alias("norm"))


_BARE = r"regexp_replace(coalesce(html, ''), '<script.*?</script>|<style.*?</style>|<!--.*?-->', '{0}', 'gis')"


def _entities(inner: str) -> str:
    """The references that occur in the pages, that of the ampersand last."""
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        inner = f"replace({inner}, '&{name};', '{char}')"
    return inner


_TAGLESS = "regexp_replace(" + _BARE.format(" ") + ", '<[^>]*>', ' ', 'gs')"
HTML_SQL = rf"trim(regexp_replace({_entities(_TAGLESS)}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(f"SELECT page_id, url, {HTML_SQL} AS text, length({HTML_SQL}) AS n_chars FROM pages")
def html_extract(spark, d):
    text = T.strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", "url", text.alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))


_LINED = rf"regexp_replace({_BARE.format('')}, '</?({T.BLOCK_TAGS})(\s[^>]*)?/?>', chr(10), 'gi')"
_FLAT = rf"regexp_replace({_entities(f'''regexp_replace({_LINED}, '<[^>]*>', '', 'gs')''')}, '[ \t]+', ' ', 'g')"


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({_FLAT}, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM pages")
def html_strip_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html_blocks(F.col("html")).alias("text"))


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part FROM documents),
    q AS (SELECT doc_id, CAST(part AS INT) AS part, trim(t) AS t FROM p WHERE trim(t) <> '')
    SELECT doc_id, part, CAST(g AS INT) AS piece, substr(t, CAST(g * 200 + 1 AS BIGINT), 200) AS passage FROM q, unnest(range(0, CAST(ceil(length(t) / 200.0) AS BIGINT))) AS r(g)"""
)
def chunk_passages(spark, d):
    return documents.chunk(_docs(spark, d), "doc_id", "text", "\n", 200)


@query()
def chunk_greedy(spark, d):
    return documents.pack(_docs(spark, d), "doc_id", "text", 300)


@query(
    """SELECT doc_id, substr(coalesce(text, ''), greatest(1, coalesce(nullif(strpos(lower(text), 'general'), 0), nullif(strpos(lower(text), 'license'), 0), nullif(strpos(lower(text), 'public'), 0), 1) - 133), 400) AS slice FROM documents"""
)
def slice_around(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", T.slice_around(F.col("text"), F.lit("the license general public"), 400).alias("slice"))


@query(rf"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS first FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') AS a FROM conversations),
    u AS (SELECT conv_id, turn, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w),
    f AS (SELECT conv_id, turn, word, min(i) AS i FROM u WHERE word NOT IN ({_STOP}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS rn FROM f)
    SELECT c.conv_id, c.turn, coalesce(string_agg(word, ' ' ORDER BY i), '') AS query FROM conversations c LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn AND rn <= 12 GROUP BY c.conv_id, c.turn"""
)
def keyword_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.keyword_query(F.col("text")).alias("query"))


@query(
    r"""WITH t AS (SELECT source, doc_id, '- ' || source || ' — ' || coalesce(regexp_extract(text, '^\s*([^.!?\n]+[.!?]?)', 1), '') AS line, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
    SELECT source, (SELECT count(*) FROM documents x WHERE x.source = t.source) AS n, string_agg(line, chr(10) ORDER BY doc_id) AS digest FROM t WHERE rn <= 5 GROUP BY source"""
)
def digest_render(spark, d):
    return documents.digest(_docs(spark, d), ["source"], F.col("doc_id"), F.col("source"), F.col("text"), 5)


@query(
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS a FROM documents),
    x AS (SELECT doc_id, list_filter(a, lambda s, i: list_position(a, s) = i) AS u FROM l)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n_sections, substr(sha256(doc_id || chr(10) || len(u) || chr(10) || array_to_string(list_transform(u[1:3], lambda s: substr(s, 1, 400)), chr(10)) || chr(10) || array_to_string(u, chr(10))), 1, 16) AS signature FROM x"""
)
def doc_digest(spark, d):
    return documents.outline(_docs(spark, d), "doc_id", "text")


@query(
    rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '{T.CONTROL_TOKENS}', '', 'g'), '^([ \t]*)(system|assistant|user|developer|tool)([ \t]*):', '\1\2\3 -', 'gimn') AS text FROM conversations"""
)
def sanitize_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.sanitize(F.col("text"), 1_000_000).alias("text"))


_EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
_PHONE = r"(^|[^\w.])(\+?\d(?:[\s().-]*\d){8,})\b"
_NO_EMAIL = f"regexp_replace(coalesce(text, ''), '{_EMAIL}', '[email]', 'g')"
_NO_PHONE = rf"regexp_replace({_NO_EMAIL}, '{_PHONE}', '\1[phone]', 'g')"
_MASKED = rf"regexp_replace({_NO_PHONE}, '\d{{7,}}', '[number]', 'g')"


@query(f"SELECT doc_id, md5({_MASKED}) AS masked, length({_MASKED}) AS n_chars FROM documents")
def pii_mask(spark, d):
    return _docs(spark, d).select("doc_id", T.mask_personal(F.col("text")).alias("m")).select("doc_id", F.md5("m").alias("masked"), F.length("m").cast("long").alias("n_chars"))


_KINDS = (
    f"CASE WHEN regexp_matches(coalesce(text, ''), '{_EMAIL}') THEN ',email' ELSE '' END || CASE WHEN regexp_matches({_NO_PHONE}, '"
    + r"\d{7,}"
    + f"') THEN ',number' ELSE '' END || CASE WHEN regexp_matches({_NO_EMAIL}, '{_PHONE}') THEN ',phone' ELSE '' END"
)


@query(f"SELECT doc_id, ltrim({_KINDS}, ',') AS kinds FROM documents WHERE ({_KINDS}) <> ''")
def pii_kinds(spark, d):
    kinds = F.array_join(T.personal_kinds(F.col("text")), ",")
    return _docs(spark, d).select("doc_id", kinds.alias("kinds")).where("kinds <> ''")


@query(r"SELECT page_id, length(trim(regexp_replace(html, '(?s)<head>.*?(</head>|$)', '', 'g'))) AS n_chars FROM pages")
def strip_spans(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.strip_spans(F.col("html"), "head")).cast("long").alias("n_chars"))


@query(
    """WITH t AS (SELECT source, doc_id, substr(text, 1, 40) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents)
    SELECT source, '[' || source || ' (untrusted)]' || chr(10) || string_agg(s, chr(10) ORDER BY doc_id DESC) AS block FROM t WHERE rn <= 3 GROUP BY source"""
)
def group_render(spark, d):
    slim = _docs(spark, d).select("source", "doc_id", F.substring("text", 1, 40).alias("s"))
    top = top_per_group(slim, ["source"], [F.desc("doc_id")], 3)
    lines = F.sort_array(F.collect_list(F.struct("doc_id", "s")), asc=False)
    block = F.concat(F.lit("["), F.col("source"), F.lit(" (untrusted)]\n"), F.array_join(F.transform("l", lambda x: x["s"]), "\n"))
    return top.groupBy("source").agg(lines.alias("l")).select("source", block.alias("block"))


@query("SELECT doc_id, sha1(text) AS sha1, substr(sha256(text), 1, 16) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1("text").alias("sha1"), F.substring(F.sha2("text", 256), 1, 16).alias("sha256"), F.md5("text").alias("md5"))


@query(
    "SELECT doc_id, coalesce(nullif(trim(source), ''), 'unknown') AS source, 'h:' || sha1(coalesce(source, '') || '|' || trim(split_part(text, chr(10), 1))) AS guid FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''"
)
def normalize_rows(spark, d):
    title = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    guid = F.concat(F.lit("h:"), F.sha1(F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.col("t"))))
    rows = _docs(spark, d).select("doc_id", "source", title.alias("t")).where("t <> ''")
    return rows.select("doc_id", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("source"), guid.alias("guid"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS guid FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY md5(text)")
def ingest_dedup(spark, d):
    """Odd documents are the new batch, even ones the archive."""
    rows = _docs(spark, d).select("doc_id", F.md5("text").alias("guid"))
    return archive.ingest(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), "guid", "doc_id").select("doc_id", "guid")


@query(
    """SELECT coalesce(o.l, n.l) AS lang, coalesce(o.source, n.source) AS source, CASE WHEN n.source IS NOT NULL THEN n.n ELSE o.n END AS n FROM
    (SELECT source, min(lang) AS l, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY source) o FULL JOIN
    (SELECT source, max(lang) AS l, sum(n_chars)::BIGINT AS n FROM documents WHERE doc_id % 3 > 0 AND source <> 'src1' GROUP BY source) n ON o.source = n.source"""
)
def merge_upsert(spark, d):
    docs = _docs(spark, d)
    old = docs.where("doc_id % 3 = 0").groupBy("source").agg(F.min("lang").alias("lang"), F.count("*").alias("n"))
    new = docs.where("doc_id % 3 > 0 AND source <> 'src1'").groupBy("source").agg(F.max("lang").alias("lang"), F.sum("n_chars").alias("n"))
    return archive.upsert(old, new, "source", ["n"])


@query(
    f"""WITH g AS (SELECT substr(sha1({NORM.format(TITLE)}), 1, 16) AS group_key, doc_id FROM documents)
    SELECT group_key, count(*) AS n, max(doc_id) AS newest, min(doc_id) AS oldest FROM g GROUP BY group_key HAVING max(doc_id) > 100"""
)
def export_groups(spark, d):
    return documents.export_groups(_docs(spark, d), F.split_part("text", F.lit("\n"), F.lit(1)), "doc_id", 100)


@query("SELECT doc_id, lang FROM documents WHERE source NOT IN ('src0', 'src7') AND coalesce(lang, 'none') <> 'de'")
def denylist_filter(spark, d):
    deny = spark.createDataFrame([("src0",), ("src7",)], "source string")
    docs = _docs(spark, d).where(F.coalesce("lang", F.lit("none")) != "de")
    return docs.join(F.broadcast(deny), "source", "left_anti").where("source IS NOT NULL").select("doc_id", "lang")


_ROUTES = (("news", "source LIKE '%1%'"), ("short", "n_chars < 500"), ("english", "lang = 'en'"))


@query("SELECT doc_id, coalesce(nullif(ltrim(" + " || ".join(f"CASE WHEN {c} THEN ',{n}' ELSE '' END" for n, c in _ROUTES) + ", ','), ''), 'general') AS route FROM documents")
def keyword_route(spark, d):
    labels = F.array_join(F.slice(F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in _ROUTES])), 1, 3), ",")
    return _docs(spark, d).select("doc_id", F.coalesce(F.nullif(labels, F.lit("")), F.lit("general")).alias("route"))


_FIRST, _SECOND = r"\b(i|my|mine|me)\b", r"\b(you|your|yours)\b"


@query(
    f"SELECT conv_id, turn, CASE WHEN role = 'assistant' AND regexp_matches(lower(text), '{_SECOND}') AND NOT regexp_matches(lower(text), '{_FIRST}') THEN 'second person' WHEN role = 'user' AND regexp_matches(lower(text), '{_FIRST}') AND NOT regexp_matches(lower(text), '{_SECOND}') THEN 'first person' END AS issue FROM conversations"
)
def voice_flag(spark, d):
    low = F.lower("text")
    first, second = F.rlike(low, F.lit(_FIRST)), F.rlike(low, F.lit(_SECOND))
    issue = F.when((F.col("role") == "assistant") & second & ~first, "second person").when((F.col("role") == "user") & first & ~second, "first person")
    return table(spark, d, "conversations").select("conv_id", "turn", issue.alias("issue"))


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 3 WHEN starts_with(source, 'src1') THEN 2 ELSE 1 END AS trust FROM documents")
def trust_rank(spark, d):
    trust = F.when(F.col("source").isin("src0", "src1"), 3).when(F.col("source").startswith("src1"), 2).otherwise(1)
    return _docs(spark, d).select("doc_id", trust.alias("trust"))


_ACK = ("ok", "okay", "thanks", "thank", "you", "yes", "no", "sure")


@query(
    "WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[a-z0-9]{1,}') AS w FROM conversations) SELECT conv_id, turn, len(w) > 0 AND len(w) <= 4 AND len(list_filter(w, lambda x: x NOT IN ("
    + ", ".join(f"'{a}'" for a in _ACK)
    + r"))) = 0 AS ack, regexp_matches(trim(text), '\?$') AS question, len(w) >= 20 AS longform, NOT regexp_matches(trim(text), '[.!?]$') AS truncated FROM w"
)
def turn_gates(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", T.tokens(F.col("text")).alias("w"))
    ack = (F.size("w") > 0) & (F.size("w") <= 4) & F.forall("w", lambda x: x.isin(*_ACK))
    ends = F.trim("text")
    return turns.select("conv_id", "turn", ack.alias("ack"), F.rlike(ends, F.lit(r"\?$")).alias("question"), (F.size("w") >= 20).alias("longform"), (~F.rlike(ends, F.lit("[.!?]$"))).alias("truncated"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, CASE WHEN regexp_matches(url, '://(localhost|127\.)') THEN 'loopback' WHEN regexp_matches(url, '[?&]') THEN 'dynamic' ELSE 'external' END AS kind FROM pages")
def url_classify(spark, d):
    kind = F.when(F.rlike("url", F.lit(r"://(localhost|127\.)")), "loopback").when(F.rlike("url", F.lit("[?&]")), "dynamic").otherwise("external")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("host"), kind.alias("kind"))


_RULES = (("%.com/%", 1), ("%1%", 2), ("%", 9))


@query("SELECT page_id, CASE " + " ".join(f"WHEN url LIKE '{g}' THEN {n}" for g, n in _RULES) + " END AS rule FROM pages")
def rule_match(spark, d):
    """First match of an ordered rule table: a broadcast theta join, then the smallest rule."""
    rules = spark.createDataFrame([(n, g.replace("%", ".*")) for g, n in _RULES], "rule int, pattern string")
    pages = table(spark, d, "pages").select("page_id", "url")
    met = pages.join(F.broadcast(rules), F.expr("url RLIKE concat('^', pattern, '$')"))
    return met.groupBy("page_id").agg(F.min("rule").alias("rule"))


@query(r"SELECT doc_id, CAST(i AS INT) AS i, trim(regexp_replace(l, '^\s*([-*]|\d+[.)])\s+', '')) AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE length(trim(regexp_replace(l, '^\s*([-*]|\d+[.)])\s+', ''))) >= 8")
def prose_lines_to_items(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("i", "l"))
    items = lines.select("doc_id", "i", F.trim(F.regexp_replace("l", r"^\s*([-*]|\d+[.)])\s+", "")).alias("title"))
    return items.where(F.length("title") >= 8)


@query(
    """WITH u AS (SELECT doc_id, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM u GROUP BY doc_id"""
)
def invert_index(spark, d):
    """Each text's inverted index (word -> positions) is turned back into text; the digest counts what came back.

    Only whole texts are shuffled, once: their words, index and positions stay where doc_id has put them.
    """
    words = _docs(spark, d).select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("places"))
    back = index.select("doc_id", "word", F.explode("places").alias("pos")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t"))
    line = F.transform("t", lambda x: x["word"])
    return back.select("doc_id", F.size(line).cast("long").alias("n_words"), F.size(F.array_distinct(line)).cast("long").alias("n_distinct"))


@query(
    """SELECT source, title, link, published FROM (SELECT 'f' || (page_id // 40) AS source, 'Item ' || page_id AS title, url AS link, page_id * 86400.0::DOUBLE AS published,
    row_number() OVER (PARTITION BY page_id // 40 ORDER BY page_id DESC) AS rn FROM pages) WHERE rn <= 30"""
)
def src_feed_parse(spark, d):
    """Feeds made of 40 pages each (half RSS, half Atom), read back, the 30 newest items of each."""
    p = table(spark, d, "pages")
    at, link = F.timestamp_seconds(F.col("page_id") * 86400), F.replace("url", F.lit("&"), F.lit("&amp;"))
    title = F.concat(F.lit("<![CDATA[Item "), F.col("page_id").cast("string"), F.lit("]]>"))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link href="'), link, F.lit('"/><updated>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    block = F.floor(F.col("page_id") / 40)
    items = p.select(block.alias("k"), F.when(block % 2 == 0, rss).otherwise(atom).alias("item"), "page_id")
    feeds = items.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "").alias("raw"))
    feeds = feeds.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("source"), F.concat(F.lit("<feed>"), F.col("raw"), F.lit("</feed>")).alias("raw"))
    return feed_items(feeds).select("source", "title", "link", "published")


_START = r"(^|[.?!:;\n])([ \t]*)"


@query(
    rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_START}\b(?:the|of)[''’]s\b', '\1\2Your', 'gi'), '\b(?:the|of)[''’]s\b', 'your', 'gi'),
    '{_START}\b(?:the|of)\b', '\1\2You', 'gi'), '\b(?:the|of)\b', 'you', 'gi') AS text FROM conversations"""
)
def person_rewrite(spark, d):
    """Two frequent words stand in for a person's name and alias."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.second_person(F.col("text"), ("the", "of")).alias("text"))


@query("SELECT doc_id, 'u' || doc_id AS uid, trim(coalesce(text, '')) AS comment FROM documents")
def marker_codec(spark, d):
    """Every text as a comment with its origin's mark, and both read back."""
    docs = _docs(spark, d).select("doc_id", T.mark_origin(F.col("text"), F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("notes"))
    return docs.select("doc_id", T.origin_uid(F.col("notes")).alias("uid"), T.origin_comment(F.col("notes")).alias("comment"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    f AS (SELECT doc_id, i, split_part(trim(s), ' ', 1) AS label FROM l WHERE trim(s) <> '' AND NOT contains(s, ':') AND NOT contains(s, '"')),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY i DESC) AS again FROM f)
    SELECT doc_id, count(*) AS n, arg_max(label, i) AS last_label FROM k WHERE again = 1 GROUP BY doc_id"""
)
def absorb_facts(spark, d):
    """Every line of a text as a FACT line under its first word; later ones replace earlier ones."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: (F.trim(s) != "") & ~F.contains(s, F.lit(":")) & ~F.contains(s, F.lit('"')))
    said = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("FACT: "), F.split_part(F.trim(s), F.lit(" "), F.lit(1)), F.lit(": "), F.trim(s))), "\n")
    found = _docs(spark, d).select("doc_id", said.alias("said")).select("doc_id", T.facts(F.col("said"), 1 << 30).alias("facts"))
    rows = found.select("doc_id", F.size("facts").cast("long").alias("n"), F.try_element_at("facts", F.lit(-1))["label"].alias("last_label"))
    return rows.where("n > 0")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id ELSE event_type || '@' || strftime(ts, '%Y-%m-%d') END AS uid, event_type AS title, strftime(ts, '%Y-%m-%d') AS start,
    CASE WHEN event_id % 2 = 0 THEN 'room ' || user_id ELSE '' END AS location FROM events"""
)
def calendar_normalize(spark, d):
    """Raw calendar entries as JSON under several names and shapes, made from events, in one form."""
    day, ident = F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string")))
    room = F.concat(F.lit("room "), F.col("user_id").cast("string"))
    one = F.to_json(F.struct(F.col("event_type").alias("title"), F.struct(day.alias("dateTime")).alias("start"), room.alias("location"), ident.alias("id")))
    other = F.to_json(F.struct(F.concat(F.lit(" "), F.col("event_type")).alias("summary"), day.alias("when"), ident.alias("uid")))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("raw"))
    return archive.normalize_entries(rows, "raw").select("event_id", "uid", "title", "start", "location")


TOKENS = r"regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9''\-]*|[^\sA-Za-z0-9]')"
#: Keyphrases as common table expressions, from w (id, i, w, word) to k (id, rank, phrase, score).
RAKE = rf"""c AS (SELECT id, i, w, word AND length(w) >= 3 AND regexp_matches(w, '[a-z]') AND w NOT IN ({_STOP}) AS c FROM w),
    r AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run FROM c),
    p AS (SELECT *, (row_number() OVER (PARTITION BY id, run ORDER BY i) - 1) // 4 AS part FROM r WHERE c),
    n AS (SELECT *, count(*) OVER (PARTITION BY id, run, part) AS len FROM p),
    s AS (SELECT id, w, sum(len) / count(*) AS s FROM n GROUP BY id, w),
    x AS (SELECT n.id, string_agg(n.w, ' ' ORDER BY n.i) AS phrase, round(sum(s.s), 6) AS score FROM n JOIN s ON n.id = s.id AND n.w = s.w GROUP BY n.id, run, part),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, phrase) AS rank FROM (SELECT DISTINCT * FROM x))"""


@query(
    rf"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS i FROM documents),
    w AS (SELECT doc_id AS id, i, trim(lower(t), '''-') AS w, regexp_matches(t, '^[A-Za-z0-9]') AS word FROM t), {RAKE}
    SELECT id AS doc_id, rank, phrase, score FROM k WHERE rank <= 12"""
)
def rake_keyphrases(spark, d):
    return with_keyphrases(_docs(spark, d), "doc_id", "text")
