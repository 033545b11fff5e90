"""Known-hash sets: reading entries, matching files to them, precedence of sources, upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencase.functions.scalars import EMPTY_HASHES, distance, hexbits, storable

#: Bits of a source mask and the order in which sources count, the most notable first.
SOURCES = {"vic": (1, 0), "stash": (2, 1), "other": (4, 2), "good": (8, 3)}
#: The name under which the examiner's own list appears, the codes that assert nothing and that come last.
STASH_NAME, UNCATEGORIZED, NONPERTINENT = "Local Hash Stash", 5, 0
#: Bits by which a perceptual hash may differ from a listed one.
PHASH_BITS = 6


def normalised(entries: DataFrame) -> DataFrame:
    """hashset_id, algo, value, category, media_id, added_at: entries as stored, once per (set, algo, value); the first added stays.

    Values that are no hash of their kind, and hashes of empty content, are left out.
    """
    kept = entries.select("hashset_id", F.lower(F.trim("algo")).alias("algo"), storable(F.col("algo"), F.col("value")).alias("value"), "category", "media_id", "added_at").where("value is not null")
    first = F.min_by(F.struct("category", "media_id", "added_at"), F.struct(F.col("added_at").isNull(), "added_at", F.coalesce("media_id", F.lit(-1)), F.coalesce("category", F.lit(-1))))
    return kept.groupBy("hashset_id", "algo", "value").agg(first.alias("f")).select("hashset_id", "algo", "value", "f.*")


def list_counts(entries: DataFrame) -> DataFrame:
    """algo, read, kept, skipped, empty: what reading a list found."""
    a, v = F.lower(F.trim("algo")), storable(F.col("algo"), F.col("value"))
    empty = F.lower(F.trim("value")).isin(*EMPTY_HASHES.values())
    return entries.groupBy(a.alias("algo")).agg(
        F.count("*").alias("read"), F.count(v).alias("kept"), F.count_if(v.isNull() & ~F.coalesce(empty, F.lit(False))).alias("skipped"), F.count_if(empty).alias("empty")
    )


def _hashes(files: DataFrame) -> DataFrame:
    """id, algo, value, algo_order: the crypto hashes of each file, never those of empty content."""
    parts = F.array(*[F.struct(F.lit(a).alias("algo"), storable(F.lit(a), F.col(a)).alias("value"), F.lit(i).alias("algo_order")) for i, a in enumerate(("sha256", "sha1", "md5"))])
    return files.select("id", F.explode(parts).alias("h")).select("id", "h.*").where("value is not null")


def stash_entries(stash: DataFrame, region: str | None = None) -> DataFrame:
    """md5, region, category, source: one per (md5, region): the lowest category, the first source that is given."""
    rows = stash.select(storable(F.lit("md5"), F.col("md5")).alias("md5"), "region", F.col("category"), "added_at", "source").where("md5 is not null")
    if region is not None:
        rows = rows.where(F.col("region") == region)
    return rows.groupBy("md5", "region").agg(F.min("category").alias("category"), F.min_by("source", F.when(F.col("source").isNotNull(), F.struct("added_at", "source"))).alias("source"))


def hits(files: DataFrame, sets: DataFrame, entries: DataFrame, stash: DataFrame, region: str = "US") -> DataFrame:
    """id, name, kind, category, via, src, media_id: every set that lists a file, once per set by its first hash.

    Hashes count in the order sha256, sha1, md5. The set table is joined last, so a very large set is never a join key of its own.
    """
    named = sets.select(F.col("id").alias("hashset_id"), "name", F.coalesce("kind", F.lit("other")).alias("kind"), F.coalesce(F.col("vic"), F.lit(0)).alias("vic"))
    own = _hashes(files)
    listed = own.join(normalised(entries), ["algo", "value"]).join(named, "hashset_id")
    src = F.when(F.col("vic") == 1, "vic").when(F.col("kind") == "known-good", "good").otherwise("other")
    a = listed.select("id", "name", "kind", F.col("category").cast("int").alias("category"), F.col("algo").alias("via"), src.alias("src"), F.col("media_id").cast("long").alias("media_id"), "algo_order", "hashset_id")
    b = own.where("algo = 'md5'").join(stash_entries(stash, region).select(F.col("md5").alias("value"), "category"), "value").select(
        "id", F.lit(STASH_NAME).alias("name"), F.lit("known").alias("kind"), F.col("category").cast("int").alias("category"), F.lit("md5-stash").alias("via"),
        F.lit("stash").alias("src"), F.lit(None).cast("long").alias("media_id"), "algo_order", F.lit(2147483647).alias("hashset_id"),
    )
    first = F.min(F.struct("algo_order", "hashset_id", "kind", F.coalesce("category", F.lit(-1)).alias("cat"), "via", "src", F.coalesce("media_id", F.lit(-1)).alias("mid"))).alias("f")
    once = a.unionByName(b).groupBy("id", "name").agg(first)
    return once.select("id", "name", "f.kind", F.when(F.col("f.cat") != -1, F.col("f.cat")).alias("category"), "f.via", "f.src", F.when(F.col("f.mid") != -1, F.col("f.mid")).alias("media_id"), "f.algo_order", "f.hashset_id")


def precedence() -> Column:
    return F.element_at(F.create_map(*[x for s, (_, o) in SOURCES.items() for x in (F.lit(s), F.lit(o))]), F.col("src"))


def bit() -> Column:
    return F.element_at(F.create_map(*[x for s, (b, _) in SOURCES.items() for x in (F.lit(s), F.lit(b))]), F.col("src"))


def severity(category: Column) -> Column:
    """Lower is more severe; the non-pertinent code comes last."""
    return F.when(category == NONPERTINENT, F.lit(1_000_000)).otherwise(category)


def summary(found: DataFrame) -> DataFrame:
    """id, top, top_kind, mask, asserted, n_sets: what the hits of each file say together."""
    order = F.struct(precedence(), "algo_order", "hashset_id", "name")
    asserts = (F.col("kind") == "known") & F.col("category").isNotNull() & (F.col("category") != UNCATEGORIZED)
    top = found.groupBy("id").agg(
        F.min_by("name", order).alias("top"), F.min_by("kind", order).alias("top_kind"), F.bit_or(bit()).alias("mask"),
        F.min_by("category", F.when(asserts, severity(F.col("category")))).alias("asserted"), F.count("*").alias("n_sets"),
    )
    return top


def rematched(files: DataFrame, found: DataFrame) -> DataFrame:
    """id, category, hashset_hit, hashset_kind, hashset_mask of every file after matching anew.

    Only an uncategorized file takes the asserted category; without a notable hit one known to be good becomes
    non-pertinent; stale matches are cleared.
    """
    s = summary(found)
    c = F.coalesce("category", F.lit(UNCATEGORIZED))
    good_only = F.col("mask") == SOURCES["good"][0]
    new = F.when((c == UNCATEGORIZED) & F.col("asserted").isNotNull(), F.col("asserted")).when((c == UNCATEGORIZED) & good_only, F.lit(NONPERTINENT)).otherwise(c)
    return files.select("id", "category").join(s, "id", "left").select("id", new.cast("int").alias("category"), F.col("top").alias("hashset_hit"), F.col("top_kind").alias("hashset_kind"), F.coalesce("mask", F.lit(0)).alias("hashset_mask"))


def nearest_listed(files: DataFrame, entries: DataFrame, bits: int = PHASH_BITS) -> DataFrame:
    """id, value, distance: for each file the nearest listed perceptual hash within ``bits``; ties to the smaller value.

    Two hashes within ``bits`` agree on at least one of ``bits + 1`` bands, so an equi-join on bands finds all; distinct
    hashes are joined, so repeated ones cost nothing.
    """
    bands = bits + 1
    edges = [round(i * 64 / bands) for i in range(bands + 1)]

    def banded(df: DataFrame) -> DataFrame:
        cuts = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("h", 64 - b).bitwiseAND((1 << (b - a)) - 1).alias("part")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
        return df.select("h", F.explode(cuts).alias("c")).select("h", "c.band", "c.part")

    mine = files.select("id", hexbits(F.lower(F.trim("phash"))).alias("h")).where("h is not null")
    listed = normalised(entries).where("algo = 'phash'").select(hexbits("value").alias("h"), "value").where("h is not null").groupBy("h").agg(F.min("value").alias("value"))
    met = banded(mine.select("h").distinct()).alias("x").join(banded(listed.select("h")).alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part")))
    d = distance(F.col("x.h"), F.col("y.h"))
    best = met.select(F.col("x.h").alias("h"), F.col("y.h").alias("other"), d.alias("distance")).where(F.col("distance") <= bits).distinct()
    best = best.join(listed.withColumnRenamed("h", "other"), "other").groupBy("h").agg(F.min(F.struct("distance", "value")).alias("m"))
    return mine.join(best, "h").select("id", "m.value", "m.distance")


def listing(sets: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame:
    """id, name, kind, stated, stored, files_matched, status: complete, incomplete (fewer stored than stated) or empty."""
    stored = normalised(entries).groupBy(F.col("hashset_id").alias("id")).agg(F.count("*").alias("stored"))
    matched = found.groupBy("name").agg(F.countDistinct("id").alias("files_matched"))
    joined = sets.select("id", "name", "kind", F.col("entry_count").alias("stated")).join(stored, "id", "left").join(matched, "name", "left")
    n = F.coalesce("stored", F.lit(0))
    status = F.when(n == 0, "empty").when(n < F.col("stated"), "incomplete").otherwise("complete")
    return joined.select("id", "name", "kind", "stated", n.alias("stored"), F.coalesce("files_matched", F.lit(0)).alias("files_matched"), status.alias("status"))


def algo_counts(entries: DataFrame) -> DataFrame:
    """hashset_id, md5, sha1, sha256, phash, photodna: distinct stored entries of each kind."""
    n = normalised(entries)
    return n.groupBy("hashset_id").agg(*[F.count_if(F.col("algo") == a).alias(a) for a in ("md5", "sha1", "sha256", "phash", "photodna")])


def without_set(found: DataFrame, name: str) -> DataFrame:
    """The hits left when one set is removed; ``summary`` of them gives the new top and mask."""
    return found.where(F.col("name") != name)


def sources_text(found: DataFrame) -> DataFrame:
    """id, sources: each file's sets with what they matched on, most notable first, joined by '; '."""
    item = F.struct(precedence().alias("o"), "algo_order", "hashset_id", F.concat_ws(" ", "name", F.concat(F.lit("("), "via", F.lit(")"))).alias("t"))
    return found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "; ").alias("sources"))


def upsert_stash(stash: DataFrame, *more: DataFrame) -> DataFrame:
    """The stash after adding: the lowest category and the first given source of each (md5, region)."""
    return stash_entries(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), more, stash))


def stash_summary(stash: DataFrame) -> DataFrame:
    """region, category, entries, newest."""
    rows = stash.select(storable(F.lit("md5"), F.col("md5")).alias("md5"), "region", "category", "added_at").where("md5 is not null")
    return rows.groupBy("region", "category").agg(F.countDistinct("md5").alias("entries"), F.max("added_at").alias("newest"))


def every_value(entries: DataFrame, stash: DataFrame, algo: str = "md5") -> DataFrame:
    """value, in_sets, in_stash: the distinct listed hashes of one kind over the case's sets and the examiner's own list."""
    a = normalised(entries).where(F.col("algo") == algo).select("value", F.lit(1).alias("c"), F.lit(0).alias("g"))
    b = stash_entries(stash).select(F.col("md5").alias("value"), F.lit(0).alias("c"), F.lit(1).alias("g")) if algo == "md5" else a.limit(0)
    return a.unionByName(b).groupBy("value").agg((F.max("c") == 1).alias("in_sets"), (F.max("g") == 1).alias("in_stash"))
