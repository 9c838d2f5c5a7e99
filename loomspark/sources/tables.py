"""Readers: the tables of a folder, feeds, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import parse_time
from ..functions.text import strip_html
from ..operators.windows import top_per_group


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LINK = "struct<_VALUE: string, _href: string>"
_ITEM = f"title string, link {_LINK}, guid string, description string, summary string, content string, pubDate string, published string, updated string, date string"


def feed_items(feeds: DataFrame, max_items: int = 30) -> DataFrame:
    """One row per titled item or entry of RSS 2 or Atom text in `raw`: source, title, link, summary, published, ord.

    Each item is read as XML, so CDATA and references are decoded. Newest first
    within a source, at most max_items of each. A missing or unreadable date is
    0.0; items that are no XML and raw text that isn't a feed give no rows.
    """
    # both dialects become <item>, whatever their prefixes and attributes
    one = F.regexp_replace(F.regexp_replace("raw", r"(?s)<(/?)(?:\w+:)?entry\b[^>]*>", "<$1item>"), r"(</?)\w+:(\w+)", "$1$2")
    blocks = F.regexp_extract_all(one, F.lit(r"(?s)<item\b[^>]*>.*?</item>"), F.lit(0))
    items = feeds.select("source", F.posexplode(blocks).alias("ord", "item"))
    read = items.select("source", "ord", F.from_xml("item", _ITEM).alias("x"))

    def first(*names: str):
        return F.coalesce(*[F.nullif(F.trim(F.col(f"x.{n}")), F.lit("")) for n in names])

    parsed = read.select(
        "source",
        "ord",
        strip_html(first("title")).alias("title"),
        F.coalesce(first("link._VALUE", "link._href", "guid"), F.lit("")).alias("link"),
        F.substring(strip_html(first("description", "summary", "content")), 1, 1000).alias("summary"),
        F.coalesce(parse_time(first("pubDate", "published", "updated", "date")), F.lit(0.0)).alias("published"),
    ).where("title <> ''")
    return top_per_group(parsed, ["source"], [F.desc("published"), F.asc("ord")], max_items)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; torn or invalid ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_texts(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("txt", "md", "html")) -> DataFrame:
    """path, size and text of the files below a folder, hidden ones left out; files with a NUL near the start are no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.where(F.rlike("path", F.lit(rf"\.({'|'.join(suffixes)})$")) & ~F.rlike("path", F.lit(r"/\.[^/]+")))
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    is_text = ~F.contains(head, F.char(F.lit(256)))  # char(256) is NUL
    return named.where(is_text).select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
