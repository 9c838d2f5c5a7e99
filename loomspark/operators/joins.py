"""Join operators: nested collection, defaults, reconciliation, incremental skips, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from .components import _written
from .windows import top_per_group


def nested(parents: DataFrame, children: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Parents with the sorted array of their children's fields, and their number; empty for none."""
    grouped = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("children"), F.count("*").alias("n_children"))
    kind = grouped.schema["children"].dataType.simpleString()
    return parents.join(grouped, on, "left").withColumns(
        {"children": F.coalesce("children", F.array().cast(kind)), "n_children": F.coalesce("n_children", F.lit(0).cast("long"))}
    )


def with_default(facts: DataFrame, dimension: DataFrame, on: str, value: str, default: str) -> DataFrame:
    return facts.join(dimension.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def effective(rows: DataFrame, keys: list[str], rank: Column, tie: str) -> DataFrame:
    """Of each key the row of the highest layer; of equals the newest."""
    return top_per_group(rows, keys, [rank.desc(), F.desc(tie)], 1)


def reconcile(origins: DataFrame, mirrors: DataFrame) -> DataFrame:
    """create, adopt, update, skip and delete actions that turn mirrors into origins; both have id, uid, title, start, body.

    uid pairs come first (of several mirrors of one uid the smallest id; the
    others are deleted), then the rest by (title, start), one to one in id
    order. With no origins at all nothing is deleted.
    """
    one = Window.partitionBy("uid").orderBy("id")
    m = mirrors.withColumn("_twin", F.when(F.col("uid").isNotNull(), F.row_number().over(one)).otherwise(1))
    by_uid = origins.alias("o").join(m.where("uid IS NOT NULL AND _twin = 1").alias("m"), F.col("o.uid") == F.col("m.uid"), "left")
    by_uid = by_uid.select("o.*", F.col("m.id").alias("_mid"), F.col("m.title").alias("_mt"), F.col("m.start").alias("_ms"), F.col("m.body").alias("_mb"))
    same = (F.col("title") == F.col("_mt")) & (F.col("start") == F.col("_ms")) & F.col("body").eqNullSafe(F.col("_mb"))
    matched = by_uid.where("_mid IS NOT NULL").select(F.when(same, "skip").otherwise("update").alias("action"), F.col("id").alias("origin_id"), F.col("_mid").alias("mirror_id"))
    sign = Window.partitionBy("_title", "start").orderBy("id")
    left = by_uid.where("_mid IS NULL").withColumn("_title", norm(F.col("title"))).withColumn("_n", F.row_number().over(sign))
    free = m.where("uid IS NULL").withColumn("_title", norm(F.col("title"))).withColumn("_n", F.row_number().over(sign))
    free = free.select(F.col("id").alias("mirror_id"), "_title", "start", "_n")
    second = left.select(F.col("id").alias("origin_id"), "_title", "start", "_n").join(free, ["_title", "start", "_n"], "left")
    rest = second.select(F.when(F.col("mirror_id").isNull(), "create").otherwise("adopt").alias("action"), "origin_id", "mirror_id")
    kept = matched.select("mirror_id").union(rest.where("mirror_id IS NOT NULL").select("mirror_id"))
    any_origin = origins.select(F.lit(1).alias("_any")).limit(1)  # one row or none
    gone = mirrors.select(F.col("id").alias("mirror_id")).join(kept, "mirror_id", "left_anti").join(F.broadcast(any_origin), F.col("_any") == 1, "left_semi")
    return matched.union(rest).union(gone.select(F.lit("delete").alias("action"), F.lit(None).cast("long").alias("origin_id"), "mirror_id"))


def to_read_again(items: DataFrame, registry: DataFrame, key: str, fresh_after: Column) -> DataFrame:
    """Items to read: unknown ones, changed ones (by fingerprint), and those last read too long ago."""
    r = registry.select(F.col(key).alias("_key"), F.col("fingerprint").alias("_fp"), F.col("read_at").alias("_at"))
    joined = items.join(r, items[key] == r["_key"], "left")
    unchanged = (F.col("_fp") == F.col("fingerprint")) & (F.col("_at") >= fresh_after)
    return joined.where(~F.coalesce(unchanged, F.lit(False))).drop("_key", "_fp", "_at")


#: Bytes of phrases, or of their first words, that are broadcast after they have been counted.
PHRASE_BYTES = 1 << 23


def phrases_in(texts: DataFrame, ident: list[str], text: Column, phrases: DataFrame, phrase: str, key_words: int = 4) -> DataFrame:
    """Texts joined to the phrases they hold at white-space boundaries: word n-grams meet phrases in an equi-join.

    Scales with the number of n-grams, where `contains` would compare every pair.
    n-grams have as many words as phrases do, up to key_words; a longer phrase
    meets texts by its first words and is then looked for in those. Phrases are
    counted first: few go to all tasks, and of more their first words do, so that
    only n-grams which begin a phrase are shuffled (all n-grams are, where first
    words have over PHRASE_BYTES). ident names a text; phrases are in normal form.
    """
    words = F.split(phrase, " ")
    keyed = _written(phrases.withColumns({"_key": F.array_join(F.slice(words, 1, key_words), " "), "_n": F.size(words)}))
    cost = F.sum(F.octet_length("_key") + 32), F.sum(F.octet_length(phrase) + F.octet_length("_key") + 64)
    lengths, longest, keys_size, size = keyed.agg(F.collect_set(F.least("_n", F.lit(key_words))), F.max("_n"), *cost).first()
    keyed = keyed.withColumn("_long", F.col("_n") > key_words).drop("_n")
    split = texts.select(*ident, F.split(norm(text), " ").alias("_w"))
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, n), " ")) if n > 1 else F.col("_w")
        return F.when(F.size("_w") >= n, made).otherwise(none)

    listed = split.select(*ident, F.array_distinct(F.concat(*[of(n) for n in sorted(lengths)] or [none])).alias("_g"))
    grams = listed.select(*ident, F.explode_outer("_g").alias("_key"))
    if (size or 0) <= PHRASE_BYTES:
        met = grams.join(F.broadcast(keyed), "_key").drop("_key")
    else:
        if keys_size <= PHRASE_BYTES:
            grams = grams.join(F.broadcast(keyed.select("_key").distinct()), "_key", "left_semi")
        met = grams.join(keyed.hint("merge"), "_key").drop("_key")
    if (longest or 0) <= key_words:
        return met.drop("_long")
    # texts meet in one more shuffle what begins in them, and are never sent to the driver
    whole = texts.select(*[F.col(c).alias(f"_id_{c}") for c in ident], F.concat(F.lit(" "), norm(text), F.lit(" ")).alias("_t")).hint("merge")
    same = [F.col(c) == F.col(f"_id_{c}") for c in ident]
    found = met.join(whole, [*same, F.col("_long")], "left").where(~F.col("_long") | F.contains("_t", F.concat(F.lit(" "), F.col(phrase), F.lit(" "))))
    return found.select(*[c for c in met.columns if c != "_long"])


def token_overlap(left: DataFrame, right: DataFrame, lid: str, rid: str, tokens: Column, least: int, share: float = 0.0) -> DataFrame:
    """(lid, rid, shared, n_left, n_right) of pairs that share `least` distinct tokens or more, and `share` of the smaller set's.

    Tokens are ordered by how many rows hold them, the rarest first. A pair that
    shares c tokens of a set of n shares one of its first n - c + 1, so only
    those prefixes meet in an equi-join, and the commonest tokens make no pairs:
    the smaller set's prefix meets the larger set, or both prefixes without a
    share. Candidates are verified on the sets.
    """
    sides = [df.select(F.col(i).alias("_id"), F.array_distinct(tokens).alias("_t")).where(F.size("_t") >= least) for df, i in ((left, lid), (right, rid))]
    each = [s.select("_id", F.size("_t").alias("_n"), F.explode("_t").alias("_token")) for s in sides]
    held = each[0].select("_token").union(each[1].select("_token")).groupBy("_token").agg(F.count("*").alias("_df"))
    need = F.greatest(F.lit(least), F.ceil(F.round(F.col("_n") * share, 6)).cast("int"))

    def rows(e: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("_df", "_token"))).alias("_all")
        sets = e.join(held, "_token").groupBy("_id", "_n").agg(ordered)
        # explode_outer infers no filter that would sort again
        out = sets.select("_id", "_n", need.alias("_need"), F.posexplode_outer("_all").alias("_at", "_x"))
        return out.select("_id", "_n", F.col("_x._token").alias("_token"), (F.col("_at") <= F.col("_n") - F.col("_need")).alias("_first"))

    a, b = (rows(e).alias(name) for e, name in zip(each, "ab"))
    smaller = F.when(F.col("a._n") <= F.col("b._n"), F.col("a._first")).otherwise(F.col("b._first"))
    meets = smaller if share else F.col("a._first") & F.col("b._first")
    met = a.join(b, (F.col("a._token") == F.col("b._token")) & meets).select(F.col("a._id").alias(lid), F.col("b._id").alias(rid)).distinct()
    whole = [s.select(F.col("_id").alias(i), F.col("_t").alias(t)) for s, i, t in zip(sides, (lid, rid), ("_ta", "_tb"))]
    both = met.join(whole[0], lid).join(whole[1], rid)
    shared = both.select(lid, rid, F.size(F.array_intersect("_ta", "_tb")).cast("long").alias("shared"), F.size("_ta").alias("n_left"), F.size("_tb").alias("n_right"))
    enough = (F.col("shared") >= least) & (F.col("shared") >= F.lit(share) * F.least("n_left", "n_right"))
    return shared.where(enough)


def shortlist(items: DataFrame, turns: DataFrame, said: DataFrame, tokens: Column, least: int = 2, most: int = 1, gap_s: float = 900, per_day: int = 6) -> DataFrame:
    """Of each turn the items that have a way in: (turn_id, key, shared, ts), best first, `most` of them.

    items (key, text, ts) that were said before (said: key, at) are left out; an
    item shares `least` words with the turn (turn_id, text, at). A turn gets none
    within gap_s of the last thing said, or after per_day of them in a day.
    """
    fresh = items.join(said.select("key").where("key IS NOT NULL").distinct(), "key", "left_anti")
    # one line of turns and sayings per day, sayings also in the next: what a turn looks back on is a running maximum and count
    micros = lambda at: (at * 1_000_000).cast("long")
    spoken = said.where("at IS NOT NULL").select(F.lit(None).cast(turns.schema["turn_id"].dataType).alias("turn_id"), micros(F.col("at")).alias("_at"), F.col("at").alias("_s"))
    day = F.floor(F.col("_at") / 86_400_000_000)
    line = spoken.withColumn("_day", F.explode(F.array(day, day + 1))).unionByName(turns.select("turn_id", micros(F.col("at")).alias("_at"), F.lit(None).cast("double").alias("_s")).withColumn("_day", day))
    back = Window.partitionBy("_day").orderBy("_at").rangeBetween(-86_400_000_000 + 1, 0)
    quiet = line.select("turn_id", (F.col("_at") / 1_000_000).alias("_at"), F.max("_s").over(back).alias("_last"), F.count("_s").over(back).alias("_today")).where("turn_id IS NOT NULL")
    ready = quiet.where((F.col("_last").isNull() | (F.col("_at") - F.col("_last") >= gap_s)) & (F.col("_today") < per_day))
    open_turns = turns.join(ready.select("turn_id"), "turn_id", "left_semi")
    pairs = token_overlap(fresh, open_turns, "key", "turn_id", tokens, least).join(fresh.select("key", "ts"), "key")
    return top_per_group(pairs.select("turn_id", "key", "shared", "ts"), ["turn_id"], [F.desc("shared"), F.desc("ts"), F.asc("key")], most)


def not_alike(new: DataFrame, queue: DataFrame, ident: str, tokens: Column, share: float = 0.8) -> DataFrame:
    """New items that no queued one of their channel resembles: `share` of the smaller set of words in both."""
    both = [df.select(F.struct(F.lit(side).alias("side"), F.col(ident).alias("id")).alias("key"), "channel", tokens.alias("_w")) for df, side in ((new, 0), (queue, 1))]
    in_channel = F.transform("_w", lambda w: F.concat_ws("\u0001", "channel", w))
    pairs = token_overlap(both[0].withColumnRenamed("key", "a"), both[1].withColumnRenamed("key", "b"), "a", "b", in_channel, 1, share)
    return new.join(pairs.select(F.col("a.id").alias(ident)).distinct(), ident, "left_anti")


def recent_topics(items: DataFrame, ident: str, at: str, tokens: Column, days: float = 14, least: int = 2, share: float = 0.8) -> DataFrame:
    """Items that resemble an earlier one of the last `days`: `share` of the smaller set of words in both, `least` words at least.

    Words meet by period of that length, each item in its own and the next one,
    so only items that can be near in time meet. Of equal times the smaller id is
    the earlier.
    """
    period = F.floor(F.col(at) / F.lit(days * 86400.0))
    slim = items.select(F.struct(F.col(at).alias("at"), F.col(ident).alias("id")).alias("_key"), tokens.alias("_w"), period.alias("_p"))
    named = lambda p: F.transform("_w", lambda w: F.concat_ws("\u0001", p.cast("string"), w))
    late = slim.select(F.struct("_key", F.col("_p").alias("p")).alias("a"), named(F.col("_p")).alias("_t"))
    early = slim.select("_key", "_w", F.explode(F.array("_p", F.col("_p") + 1)).alias("_p")).select(F.struct("_key", F.col("_p").alias("p")).alias("b"), named(F.col("_p")).alias("_t"))
    pairs = token_overlap(late, early, "a", "b", F.col("_t"), least, share)
    before = (F.col("b._key") < F.col("a._key")) & (F.col("a._key.at") - F.col("b._key.at") <= F.lit(days * 86400.0))
    return items.join(pairs.where(before).select(F.col("a._key.id").alias(ident)).distinct(), ident, "left_semi")
