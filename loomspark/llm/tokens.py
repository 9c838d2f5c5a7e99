"""Token counts from the pieces of distinct pre-tokens."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices

#: Pre-tokens with a larger share of all occurrences than one of so many are known to every executor, so there are fewer than that,
#: together no longer than so many average ones; those met less often than OFTEN aren't, which bounds them in small tables too.
FREQUENT, OFTEN = 1 << 19, 16
#: Texts with none of these are in NFC, and lower() and the pattern treat them as the tokenizer does.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u0130\u0149\u0180-\U0010ffff]")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _word_pattern(tok) -> str | None:
    """The pattern of a tokenizer that lower-cases, drops white space and cuts by one pattern; None for any other."""
    made = json.loads(tok.to_str())
    steps = (made["normalizer"] or {}).get("normalizers", [])
    cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    space, cut, to_bytes = steps[1], cuts[0], cuts[1]
    plain = space["pattern"] == {"Regex": r"\s+"} and space["content"] == " " and not to_bytes["add_prefix_space"] and not to_bytes["use_regex"]
    dropped = cut["behavior"] == "Removed" and cut["invert"] and r"[^\s" in cut["pattern"].get("Regex", "")
    return cut["pattern"]["Regex"] if plain and dropped else None


@cache
def _pieces_of(path: str) -> tuple[Callable[[str], tuple[int, Counter]], Callable[[str], int]]:
    """(whole text -> special tokens and pre-token counts, pre-token -> its number of pieces)."""
    tok = _tokenizer(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    pattern = _word_pattern(tok)
    cut = regex.compile(pattern).findall if pattern else None

    def usual(text: str, out: Counter) -> None:
        out.update(cut(text.lower()))

    def unusual(text: str, out: Counter) -> None:
        plain = tok.normalizer.normalize_str(text) if tok.normalizer else text
        out.update(plain[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(plain))

    def count(text: str) -> tuple[int, Counter]:
        parts = special.split(text) if special is not None else [text]
        out: Counter = Counter()
        for part in parts:
            (unusual if cut is None or _UNUSUAL.search(part) else usual)(part, out)
        return len(parts) - 1, out

    return count, lambda pre: sum(len(tok.model.tokenize(p)) for p, _ in tok.pre_tokenizer.pre_tokenize_str(pre))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def pre_token_totals(docs: DataFrame, path: str) -> DataFrame:
    """(pre, total, pieces): every distinct pre-token of the texts, how often it occurs, its number of pieces."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, _ = _pieces_of(path)
        for batch in slices(batches):
            whole: Counter = Counter()
            for text in batch.column("text").to_pylist():
                whole.update(count(text)[1])
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.string()), pa.array(list(whole.values()), pa.int64())], names=["pre", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, size = _pieces_of(path)
        for batch in batches:
            sizes = [size(p) for p in batch.column("pre").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32())], names=["pre", "total", "pieces"])

    totals = _texts(docs).mapInArrow(explode, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("total"))
    return totals.mapInArrow(pieces, "pre string, total long, pieces int")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, as the tokenizer in the file `path` counts.

    Each distinct pre-token is cut into pieces once. Common ones, whatever their
    length, are known to every executor; the others' counts meet their sizes in a
    join on the pre-token, where none has more than one in FREQUENT of all
    occurrences. Token ids are never made. Special strings inside a text count as
    one token.

    Null text counts as empty: no tokens. A null doc_id is a value like any
    other. Rows repeated in doc_id and text each come back; of a very long text
    only the distinct pre-tokens are held; an empty table gives an empty result;
    other columns are not read.
    """
    totals = checkpointed(pre_token_totals(docs, path))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    often = (F.col("total") * FREQUENT > everything) & (F.col("total") > OFTEN)
    common = totals.where(often)
    frequent = docs.sparkSession.sparkContext.broadcast(dict(common.select("pre", "pieces").toLocalIterator()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row one line with what is known, under a name that no pre-token has, and one for each other pre-token."""
        count, _ = _pieces_of(path)
        known = frequent.value
        for batch in slices(batches):
            at: list[int] = []
            pre: list[str] = []
            n: list[int] = []
            size: list[int] = []
            mark: list[int] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens, found = count(text)
                for p, times in found.items():
                    if (k := known.get(p)) is not None:
                        tokens += k * times
                    else:
                        at.append(row), pre.append(p), n.append(times), mark.append(0)
                data = text.encode("utf-8", "surrogatepass")
                size += [len(data)] * (len(at) - len(size) + 1)
                at.append(row), pre.append(f" {zlib.crc32(data)}"), n.append(tokens), mark.append(1)
            rows = batch.select(["doc_id", "crc"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("crc"), pa.array(size, pa.int64()), pa.array(pre, pa.string()), pa.array(n, pa.int64()), pa.array(mark, pa.int32())],
                names=["doc_id", "crc", "n_bytes", "pre", "n", "mark"],
            )

    rows = _texts(docs).withColumn("crc", F.xxhash64("text"))
    lines = rows.mapInArrow(split, rows.select("doc_id", "crc").schema.add("n_bytes", "long").add("pre", "string").add("n", "long").add("mark", "integer"))
    rare = totals.where(~often).select("pre", "pieces")
    summed = (
        lines.join(rare, "pre", "left")
        .groupBy("doc_id", "crc", "n_bytes")
        .agg(F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("_tokens"), F.sum("mark").alias("_rows"))
    )
    # rows equal in doc_id and text were summed together; they come apart again here
    n = F.expr("_tokens DIV _rows")
    return summed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")
    )
