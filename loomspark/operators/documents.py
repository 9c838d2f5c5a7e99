"""Document operators: filters, dedup, ranking, search, paging, chunks, digests, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_terms, count_of, norm
from .components import _written
from .windows import top_per_group


def filter_terms(docs: DataFrame, terms: list[str], column: str = "text", mode: str = "any") -> DataFrame:
    return docs.where(contains_terms(F.col(column), terms, mode))


def dedupe(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each normal-form key; rows with a blank key all stay.

    Ids and 16-byte keys are written once, so texts are read once for them. Keys
    with several rows are found by an aggregate over (key, order) that is
    combined before the shuffle; the rows that go, few as a rule, are anti-joined
    by id, so only ids travel. Blank keys meet nowhere.
    """
    k = norm(key)
    keyed = _written(docs.select(F.col(order).alias("_id"), F.when(k != "", F.unhex(F.md5(k))).alias("_k")).where("_k IS NOT NULL"))
    several = keyed.groupBy("_k").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    gone = keyed.join(several, "_k").where("_id <> _first").select("_id")
    return docs.join(gone, docs[order] == F.col("_id"), "left_anti")


def tagged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both one after the other: _tag says which, _order puts all of the first before the second, by doc_id."""
    both = first.withColumn("_tag", F.lit(0)).unionByName(second.withColumn("_tag", F.lit(1)))
    return both.withColumn("_order", F.struct("_tag", "doc_id"))


def rank_terms(docs: DataFrame, query: str, title: Column, text: Column, recency: Column | None = None, weight: float = 0.0) -> DataFrame:
    """score: 2 for each occurrence of a query term in the title, 1 in the text, plus weight * recency / its maximum."""
    terms = list(dict.fromkeys(query.lower().split()))
    if not terms:
        raise ValueError("query must not be empty")
    score = F.lit(0.0)
    for t in terms:
        score = score + 2 * count_of(F.lower(title), t) + count_of(F.lower(text), t)
    if recency is not None and weight:
        top = docs.agg(F.max(recency).alias("_top"))  # one row
        docs = docs.crossJoin(F.broadcast(top))
        score = score + weight * recency / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))
    return docs.withColumn("score", score).drop("_top")


def head(docs: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows as a top-k, with their rank from 1."""
    if n < 1:
        raise ValueError("n must be at least 1")
    top = docs.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def search(docs: DataFrame, query: str, columns: list[str], when: Column, order: list[Column], since=None, until=None, limit: int = 40) -> DataFrame:
    """Rows in which every query word occurs in one of the columns, in a closed time range, first by `order`."""
    found = docs
    for term in query.lower().split():
        held = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term)) for c in columns]
        any_held = held[0]
        for h in held[1:]:
            any_held = any_held | h
        found = found.where(any_held)
    if since is not None:
        found = found.where(when >= F.lit(since))
    if until is not None:
        found = found.where(when <= F.lit(until))
    return found.orderBy(*order).limit(max(1, limit))


def page(docs: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return docs.orderBy(*order).offset(offset).limit(limit)


def chunk(docs: DataFrame, ident: str, text: str, separator: str, most: int) -> DataFrame:
    """Passages: text split at the separator, trimmed, blank ones dropped, then cut every `most` characters."""
    # explode_outer: explode would infer a filter that evaluates the split twice
    parts = docs.select(ident, F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), separator)).alias("part", "_p"))
    parts = parts.select(ident, "part", F.trim("_p").alias("_p")).where("_p <> ''")
    starts = F.sequence(F.lit(0), F.floor((F.length("_p") - 1) / most).cast("int"))
    cut = parts.select(ident, "part", "_p", F.explode(starts).alias("piece"))
    return cut.select(ident, "part", "piece", F.substring(F.col("_p"), F.col("piece") * most + 1, F.lit(most)).alias("passage"))


def pack(docs: DataFrame, ident: str, text: str, most: int) -> DataFrame:
    """Greedy packing of words into chunks of at most `most` characters; a longer word is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, w: Column) -> Column:
        fits = F.length(s["now"]) + 1 + F.length(w) <= most
        return (
            F.when(s["now"] == "", F.struct(s["done"].alias("done"), w.alias("now")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(" "), w).alias("now")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), w.alias("now")))
        )

    pieces = F.filter(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    packed = F.aggregate(pieces, start, add, lambda s: F.filter(F.concat(s["done"], F.array(s["now"])), lambda c: c != ""))
    return docs.select(ident, F.posexplode_outer(packed).alias("piece", "chunk")).where("chunk IS NOT NULL")


def digest(docs: DataFrame, keys: list[str], order: Column, title: Column, text: Column, n: int = 5) -> DataFrame:
    """Per group a bullet line for each of its first n rows: title, first sentence of the text; and the rows' number."""
    line = F.concat(F.lit("- "), title, F.lit(" — "), F.coalesce(F.regexp_extract(text, r"^\s*([^.!?\n]+[.!?]?)", 1), F.lit("")))
    sizes = docs.groupBy(*keys).agg(F.count("*").alias("n"))
    top = top_per_group(docs.select(*keys, order.alias("_o"), line.alias("_line")), keys, [F.asc("_o")], n)
    lines = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_line"))).alias("_l"))
    return sizes.join(lines, keys).select(*keys, "n", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("digest"))


def outline(docs: DataFrame, ident: str, text: str, opening: int = 400) -> DataFrame:
    """Per document the number of its distinct non-blank lines, and a signature of id, number, the opening of the first three and all of them whole.

    Any change of a line, wherever it stands, changes the signature, so a digest
    kept under it is never stale.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != ""))
    seen = docs.select(ident, lines.alias("_lines"))
    first = F.transform(F.slice("_lines", 1, 3), lambda s: F.substring(s, 1, opening))
    said = F.concat_ws("\n", F.col(ident).cast("string"), F.size("_lines").cast("string"), F.array_join(first, "\n"), F.array_join("_lines", "\n"))
    return seen.select(ident, F.size("_lines").cast("long").alias("n_sections"), F.substring(F.sha2(said, 256), 1, 16).alias("signature"))


def export_groups(docs: DataFrame, question: Column, ident: str, watermark: int) -> DataFrame:
    """Groups of equal questions that have a row above the watermark: key, number of rows, newest and oldest id.

    Slim columns only; publish.export() renders and writes the touched groups.
    """
    keyed = docs.select(F.substring(F.sha1(norm(question)), 1, 16).alias("group_key"), F.col(ident).alias("_id"))
    groups = keyed.groupBy("group_key").agg(F.count("*").alias("n"), F.max("_id").alias("newest"), F.min("_id").alias("oldest"))
    return groups.where(F.col("newest") > watermark)
