"""Vendor profiles from raw names: exact spellings, then near ones, then new profiles (VEN-2)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import cut
from .duplicates import normalize_vendor

SIMILAR = 0.85


def trigrams(name: Column) -> Column:
    """3-grams in order, repeats included: each word has two blanks before it and one after."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3)))))


def best_extent(asked: list[str], run: list[str]) -> float:
    """Greatest similarity of a set of 3-grams and the set in any stretch of an ordered list."""
    wanted, best = set(asked), 0.0
    for i in range(len(run)):
        if run[i] not in wanted:
            continue  # a stretch that is best begins and ends with a common 3-gram
        seen: set[str] = set()
        common = 0
        for gram in run[i:]:
            if gram not in seen:
                seen.add(gram)
                common += gram in wanted
            if gram in wanted:
                best = max(best, common / (len(wanted) + len(seen) - common))
    return best


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        scores = [best_extent(list(a), list(r)) for a, r in zip(batch.asked, batch.run, strict=True)]
        yield batch[["tenant", "known", "name"]].assign(similarity=pd.Series(scores, batch.index, float))


def together(grams: str, k: int) -> Column:
    """The 3-grams of a sorted list, or with ``k`` = 2 all pairs of them, the smaller one first."""
    if k == 1:
        return F.col(grams)
    after = lambda i: F.slice(F.col(grams), i + 2, F.size(grams))
    return F.flatten(F.transform(grams, lambda x, i: F.transform(after(i), lambda y: F.concat(x, y))))


def names_to_score(known: DataFrame, names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(tenant, known, name) of the pairs that can reach ``least``, each once.

    A name must share ceil(least * n) = t of a known name's n
    different 3-grams, so it holds k of the n - t + k rarest.  Names meet on ``k`` of these at once (two, where a
    limit above a half asks for two at least), so that names of the same few letters or digits seldom meet; their
    common 3-grams are counted as they meet, and no pair is lost.
    """
    k = 2 if least > 0.5 else 1
    grams = lambda df, to: df.select("tenant", F.col(to), F.array_distinct(trigrams(F.col(to))).alias("grams"))
    flat = grams(names, "name").select("tenant", "name", F.explode("grams").alias("gram"))
    often = flat.groupBy("tenant", "gram").agg(F.count("*").alias("n"))
    own = grams(known, "known").select("tenant", "known", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    ranked = own.join(often, ["tenant", "gram"], "left").withColumn(
        "place", F.row_number().over(W.partitionBy("tenant", "known").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    )
    rare = ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + k)
    keyed = lambda df, to: df.groupBy("tenant", to).agg(F.sort_array(F.collect_set("gram")).alias("l")).select("tenant", to, F.explode(together("l", k)).alias("key"))
    left = keyed(rare, "known").withColumn("asked", F.array_distinct(trigrams(F.col("known"))))
    right = keyed(flat.join(rare.select("tenant", "gram").distinct(), ["tenant", "gram"], "left_semi"), "name")
    right = right.withColumn("held", F.array_distinct(trigrams(F.col("name"))))
    enough = F.size(F.array_intersect("asked", "held")) >= F.ceil(F.size("asked") * least)
    return left.join(right, ["tenant", "key"]).filter(enough).select("tenant", "known", "name").distinct()


def similar_names(known: DataFrame, names: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(tenant, known, name, similarity) of the pairs from ``least`` on; both have tenant and the name."""
    ready = names_to_score(known, names, least).select("*", trigrams(F.col("known")).alias("asked"), trigrams(F.col("name")).alias("run"))
    kind = known.schema["tenant"].dataType.simpleString()
    scored = ready.mapInPandas(_scored, f"tenant {kind}, known string, name string, similarity double")
    return scored.filter(F.col("similarity") >= least)


def resolve_vendors(names: DataFrame, aliases: DataFrame | None = None, least: float = SIMILAR) -> DataFrame:
    """(tenant, vendor, profile, how, similarity) of each different name in ``names`` (tenant, merchant_vendor, seen).

    ``aliases`` (tenant, alias, profile) are the spellings known so far, as vendor keys.
    A name is an alias exactly, or takes the profile of the alias most like it, or
    that of a new name seen before it, or is a new profile under its own key.

    All at once instead of one by one, so this is a rule of its own: new names come in
    the order (seen, key); those without a similar earlier one are profiles, and the
    others go to the earliest similar profile.  A name whose only similar names are no
    profiles themselves is one; chains are not followed.
    """
    keyed = names.withColumn("vendor", normalize_vendor(F.col("merchant_vendor"))).groupBy("tenant", "vendor").agg(F.min("seen").alias("seen"))
    keyed = cut(keyed)  # different names only, read many times
    none = keyed.select("tenant", F.col("vendor").alias("alias"), F.col("vendor").alias("profile")).limit(0)
    known = none if aliases is None else cut(aliases.select("tenant", "alias", "profile"))
    exact = keyed.join(known.withColumnRenamed("alias", "vendor"), ["tenant", "vendor"])
    exact = exact.select("tenant", "vendor", "profile", F.lit("EXACT").alias("how"), F.lit(1.0).alias("similarity"))
    rest = keyed.join(known.select("tenant", F.col("alias").alias("vendor")), ["tenant", "vendor"], "left_anti")
    near = similar_names(known.select("tenant", F.col("alias").alias("known")), rest.select("tenant", F.col("vendor").alias("name")), least)
    best = near.groupBy("tenant", "name").agg(F.max_by("known", F.struct("similarity", "known")).alias("known"), F.max("similarity").alias("similarity"))
    by_alias = best.join(known.withColumnRenamed("alias", "known"), ["tenant", "known"]).select(
        "tenant", F.col("name").alias("vendor"), "profile", F.lit("SIMILAR").alias("how"), "similarity"
    )
    new = rest.join(by_alias.select("tenant", "vendor"), ["tenant", "vendor"], "left_anti")
    seen = lambda to: new.select("tenant", F.col("vendor").alias(to), F.col("seen").alias(f"{to}_seen"))
    pairs = similar_names(new.select("tenant", F.col("vendor").alias("known")), new.select("tenant", F.col("vendor").alias("name")), least)
    earlier = pairs.join(seen("known"), ["tenant", "known"]).join(seen("name"), ["tenant", "name"]).filter(
        (F.col("known_seen") < F.col("name_seen")) | ((F.col("known_seen") == F.col("name_seen")) & (F.col("known") < F.col("name")))
    )
    earlier = cut(earlier)
    later = earlier.select("tenant", F.col("name").alias("known")).distinct()
    to_profile = earlier.join(later, ["tenant", "known"], "left_anti")
    first = to_profile.groupBy("tenant", "name").agg(
        F.min_by("known", F.struct("known_seen", "known")).alias("profile"), F.min_by("similarity", F.struct("known_seen", "known")).alias("similarity")
    )
    found = new.join(first.withColumnRenamed("name", "vendor"), ["tenant", "vendor"], "left").select(
        "tenant", "vendor", F.coalesce("profile", "vendor").alias("profile"),
        F.when(F.col("profile").isNull(), "NEW").otherwise("SIMILAR").alias("how"), "similarity",
    )
    return exact.unionByName(by_alias).unionByName(found)
