"""Text expressions: normal forms, tokens, markup stripping, masking. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Small stop-word list of the keyword operators (a parameter everywhere it is used).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")
# Patterns of personal data in the order in which they are masked.
PII_PATTERNS = (
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[email]"),
    ("phone", r"(?<![\w.])\+?\d(?:[\s().-]*\d){8,}(?!\w)", "[phone]"),
    ("number", r"\d{7,}", "[number]"),
)
#: What has to occur for a pattern to be looked for; a cheap test beside the pattern.
_HINTS = {"email": "@", "phone": "[0-9]", "number": "[0-9]{7}"}
# Elements whose end starts a new line when blocks are kept.
BLOCK_TAGS = "p|div|br|li|tr|h1|h2|h3|h4|h5|h6|section|article"
# Control tokens of chat templates, and the labels that open a forged turn.
CONTROL_TOKENS = r"<\|[A-Za-z_]+\|>|\[/?INST\]|<<?/?SYS>>?"
ROLE_LABEL = r"(?im)^([ \t]*)(system|assistant|user|developer|tool)([ \t]*):"


def norm(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def fold_case(text: Column) -> Column:
    """The normal form of labels: NFKC, case folded, runs of white space as one space, trimmed.

    What Spark has no function for, compatibility forms and sharp s, is done
    where a text holds more than ASCII.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.rlike(plain, F.lit(r"^\p{ASCII}*$")), F.lower(plain)).otherwise(_folded()(plain))


def _folded():
    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return folded


def tokens(text: Column, least: int = 1) -> Column:
    """Runs of a-z and 0-9 in lower case, of at least `least` characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def words(text: Column) -> Column:
    """Non-empty space-separated words of the normal form."""
    return F.filter(F.split(norm(text), " "), lambda w: w != "")


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term)))) / len(term)).cast("long")


def contains_terms(hay: Column, terms: list[str], mode: str = "any") -> Column:
    """Whether any, all or none of the terms occur in `hay`, both in normal form."""
    if not terms:
        raise ValueError("terms must not be empty")
    found = [F.contains(norm(hay), F.lit(" ".join(t.lower().split()))) for t in terms]
    held = found[0]
    for f in found[1:]:
        held = held & f if mode == "all" else held | f
    return ~held if mode == "none" else held


def unescape(text: Column) -> Column:
    """Character references decoded once: the named ones of HTML 4, decimal and hexadecimal ones; others stay.

    Only the distinct references that occur are replaced, those of the ampersand last.
    """
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (f"&{name};", chr(code))])
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"), F.lit(0)))
    ampersand = F.array(*map(F.lit, ("&amp;", "&#38;", "&#x26;", "&#X26;")))

    def char(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(ref.startswith("&#x") | ref.startswith("&#X"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(63))), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(names, ref), F.when(valid, point), ref)

    refs = F.concat(F.array_except(found, ampersand), F.array_intersect(found, ampersand))
    decoded = F.aggregate(refs, text, lambda out, ref: F.replace(out, ref, char(ref)))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip_html(html: Column) -> Column:
    """Text of a page on one line: scripts, styles, comments and tags become spaces, entities are decoded."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def strip_html_blocks(html: Column) -> Column:
    """Text of a page with a line feed where a block ends; three or more become two."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    lines = F.regexp_replace(bare, rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>", "\n")
    flat = F.regexp_replace(unescape(F.regexp_replace(lines, r"(?s)<[^>]*>", "")), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def sanitize(text: Column, cap: int = 4000) -> Column:
    """Untrusted text without control tokens, with role labels made harmless, cut at `cap` with a mark."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL_TOKENS, "")
    clean = F.regexp_replace(clean, ROLE_LABEL, "$1$2$3 -")
    return F.when(F.length(clean) > cap, F.concat(F.substring(clean, 1, cap), F.lit(" [cut]"))).otherwise(clean)


def mask_personal(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Email, phone, number and then known names (three characters or more) behind placeholders."""
    out = F.coalesce(text, F.lit(""))
    for kind, pattern, mark in PII_PATTERNS:
        out = F.when(F.rlike(out, F.lit(_HINTS[kind])), F.regexp_replace(out, pattern, mark)).otherwise(out)
    for name in (n.strip() for n in names if len(n.strip()) >= 3):
        out = F.regexp_replace(out, rf"(?i)\b{re.escape(name)}\b", "[name]")
    return out


def personal_kinds(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Sorted kinds of personal data that masking finds, each looked for in what the earlier ones left."""
    left, kinds = F.coalesce(text, F.lit("")), []
    for kind, pattern, mark in PII_PATTERNS:
        kinds.append(F.when(F.rlike(left, F.lit(pattern)), kind))
        left = F.regexp_replace(left, pattern, mark)
    own = mask_personal(text, names)
    if names:
        kinds.append(F.when(own != mask_personal(text), "name"))
    return F.sort_array(F.array_compact(F.array(*kinds)))


def sentences(text: Column) -> Column:
    """Runs up to and with their closing marks, trimmed; blank ones are left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def keyword_query(text: Column, most: int = 12, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The first distinct words of three letters or more that are no stop words, joined by a space."""
    found = F.array_except(F.array_distinct(tokens(text, 3)), F.array(*map(F.lit, stop_words)))
    return F.array_join(F.slice(found, 1, most), " ")


def strip_spans(text: Column, tag: str = "think") -> Column:
    """Text without its <tag>...</tag> spans; one that is not closed runs to the end."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s)<{tag}>.*?(</{tag}>|$)", ""))


def slice_around(text: Column, query: Column, cap: int = 400) -> Column:
    """cap characters that start a third of cap before the first of the query's three longest words (over 4 letters)."""
    long_words = F.filter(F.array_distinct(tokens(query)), lambda w: F.length(w) > 4)
    longest = F.slice(F.transform(F.sort_array(F.transform(long_words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s.w), 1, 3)
    low = F.lower(F.coalesce(text, F.lit("")))
    places = F.filter(F.transform(longest, lambda w: F.position(w, low)), lambda p: p > 0)
    begin = F.greatest(F.lit(1), F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(1)) - cap // 3)
    return F.substring(F.coalesce(text, F.lit("")), begin, F.lit(cap))


def second_person(text: Column, names: tuple[str, ...]) -> Column:
    """A person's names as "you" and their possessives as "your", with a capital where a sentence starts.

    A name that is being told stays: "called Sam", "my name is Sam".
    """
    said = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    begin, told = r"(^|[.?!:;\n])([ \t]*)", r"(?<!\bname is )(?<!\bcalled )(?<!\bnamed )"
    out = F.coalesce(text, F.lit(""))
    for ending, word in (("['\u2019]s", "your"), ("", "you")):
        out = F.regexp_replace(out, rf"(?i){begin}\b(?:{said}){ending}\b", rf"$1$2{word.capitalize()}")
        out = F.regexp_replace(out, rf"(?i){told}\b(?:{said}){ending}\b", word)
    return out


# The forms of personal pronouns by set.
PRONOUNS = {"she": ("she", "her", "her"), "he": ("he", "him", "his"), "they": ("they", "them", "their")}


def with_pronouns(text: Column, which: str) -> Column:
    """{subj}, {obj} and {poss} as the pronouns of a set; a capital in the mark makes one in the pronoun."""
    out = text
    for mark, word in zip(("subj", "obj", "poss"), PRONOUNS[which]):
        for m, w in ((mark, word), (mark.capitalize(), word.capitalize())):
            out = F.replace(out, F.lit("{" + m + "}"), F.lit(w))
    return out


def mark_origin(comment: Column, uid: Column, service: str = "kept in sync") -> Column:
    """A comment and below it the line that names the entry which its own mirrors."""
    line = F.concat(F.lit(f"— {service} [mirror:"), uid, F.lit("] —"))
    own = F.trim(F.coalesce(comment, F.lit("")))
    return F.when(own == "", line).otherwise(F.concat(own, F.lit("\n\n"), line))


def origin_uid(notes: Column) -> Column:
    """The entry that notes name as their origin, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(notes, F.lit("")), r"(?i)\[mirror:([^\]]+)\]", 1), F.lit(""))


def origin_comment(notes: Column) -> Column:
    """Notes without the line of their origin."""
    return F.trim(F.regexp_replace(F.coalesce(notes, F.lit("")), r"(?i)\n*—[^\n\[]*\[mirror:[^\]]+\][ \t]*—\s*$", ""))


_FACT = r"(?im)^[ \t]*FACT:[ \t]*([^:\n]+):[ \t]*(.+?)[ \t]*$"


def facts(text: Column, most: int = 24) -> Column:
    """(label, value) of lines 'FACT: label: value', the last value of each label, the last `most` of them; empty values are left out."""
    whole = F.coalesce(text, F.lit(""))
    labels, values = (F.regexp_extract_all(whole, F.lit(_FACT), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(labels, values, lambda a, b: F.struct(F.trim(a).alias("label"), F.regexp_replace(F.trim(b), r'^"+|"+$', "").alias("value")))
    known = F.filter(pairs, lambda p: (p["label"] != "") & ~F.lower(p["value"]).isin("", "-", "—", "none", "(none)", "n/a"))

    def last(k: Column) -> Column:
        kept = F.filter(k, lambda p, i: ~F.exists(F.slice(k, i + 2, F.size(k)), lambda q: q["label"] == p["label"]))
        return F.slice(F.reverse(kept), 1, most)

    # bound as an array's one element, so that it is computed once
    return F.reverse(F.get(F.transform(F.array(known), last), F.lit(0)))


def without_facts(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _FACT, ""), r"\n{3,}", "\n\n"))
