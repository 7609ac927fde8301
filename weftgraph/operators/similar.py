"""Pairs of similar sets by a prefix-filtered join.

Tokens are ordered by how many sets hold them, rare ones first, in every set alike. A set that must share ``o`` of its ``n`` tokens shares k of its first n - o + k, as
only o - k come after them. So sets meet by three of these tokens, which far fewer sets have in common than a token; only where a set need not share three,
as the smallest, by two or one. Sizes that differ too much and common tokens too far back are ruled out in the join, and so are most sets that differ too much: each has 128
bits, one set for each token, and two sets differ in as many tokens at least as in bits. A pair is met at its first common
tokens only, so that none is compared twice, and its whole sets decide. Sets that are equal are one set in the join, so a group of them costs a row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import cut

#: Tokens by which sets meet, where they must share as many.
TOGETHER = 3


def grams(name: str, q: int = 4) -> Column:
    """The different runs of ``q`` characters of a name; a shorter name is its own only run."""
    c = F.col(name)
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda i: F.substring(c, i, F.lit(q)))
    return F.when(F.length(c) < q, F.array(c)).otherwise(F.array_distinct(runs))


def _rare_first(sets: DataFrame) -> DataFrame:
    long = sets.select("id", F.explode("tokens").alias("token"))
    ordered = long.join(long.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o"))
    return ordered.select("id", F.transform("o", lambda x: x["token"]).alias("tokens"))


def _bits(salt: int) -> Column:
    """64 bits, of which each token sets one."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x, F.lit(salt)), F.lit(64)).cast("int"))
    mine = F.filter("tokens", lambda x: F.pmod(F.xxhash64(x), F.lit(2)) == salt)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda held, x: held.bitwiseOR(bit(x)))


def _together(known: DataFrame, percent: int, k: int) -> DataFrame:
    """Sets with each ``k`` of their first tokens: ``key``, a hash of these, and ``at``, the place of the last one. For ``k`` less than ``TOGETHER`` only sets that may meet one that need not share more."""
    rows = known.where(F.col("must") >= k)
    if k < TOGETHER:  # the largest set that need not share more has 100 k / percent tokens
        rows = rows.where(percent * F.col("n") <= 100 * (100 * k // percent))
    last = F.col("n") - F.col("must") + k
    rows = rows.withColumns({"at": F.lit(0), "held": F.array().cast("array<string>")})
    for i in range(1, k + 1):  # the i-th one leaves k - i after it
        places = F.explode(F.sequence(F.col("at") + 1, last - (k - i)))
        rows = rows.withColumn("next", places).withColumn("held", F.concat("held", F.array(F.element_at("tokens", F.col("next"))))).withColumn("at", F.col("next"))
    return rows.withColumn("key", F.xxhash64("held")).drop("held", "next")


def similar_sets(sets: DataFrame, percent: int = 75) -> DataFrame:
    """``(a, b, jaccard)``, ``a`` less than ``b``, for sets ``(id, tokens)`` with 100 * intersection >= ``percent`` * union.

    Pairs are between one set of each group of equal ones, the one with the least id, and between that and the others of its group. Empty sets and null
    tokens are similar to nothing. Ids are expected to differ and tokens of a set too.
    """
    ordered = cut(_rare_first(sets), "sets")
    one = cut(ordered.groupBy("tokens").agg(F.min("id").alias("id")), "different_sets")
    same = ordered.join(one.withColumnRenamed("id", "a"), "tokens").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))

    size = F.size("tokens")
    must = F.ceil(percent * size / 100).cast("int")  # what a set shares with any similar one at least
    known = cut(one.select("id", "tokens", size.alias("n"), must.alias("must"), *[_bits(salt).alias(f"bits{salt}") for salt in (0, 1)]).where("n > 0"), "known_sets")

    def met(k: int) -> DataFrame:
        """Pairs that share ``k`` tokens for certain and, if ``k`` is less than ``TOGETHER``, no more."""
        heads = _together(known, percent, k)
        a, b = (heads.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "tokens", "n", "must", "bits0", "bits1", "at")]) for side in "ab")
        total = F.col("n_a") + F.col("n_b")
        least = F.least("must_a", "must_b")
        left = k + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # common tokens there can be
        apart = F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))) + F.bit_count(F.col("bits1_a").bitwiseXOR(F.col("bits1_b")))  # tokens in one set only that there are at least
        near = (F.col("id_a") < F.col("id_b")) & (percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & ((100 + percent) * left >= percent * total)
        near &= (100 + percent) * (total - apart) >= 2 * percent * total
        near &= least >= k if k == TOGETHER else least == k
        shared = F.array_intersect("tokens_a", "tokens_b")
        here = F.xxhash64(F.slice(shared, 1, k)) == F.col("key")
        both = F.size(shared)
        # Conditions of a join are reordered; a case isn't, so whole sets are compared only where the rest holds.
        return a.join(b, "key").where(F.when(near, here & ((100 + percent) * both >= percent * total)).otherwise(False)).select("id_a", "id_b", (both / (total - both)).alias("jaccard"))

    found = reduce(DataFrame.unionByName, [met(k) for k in range(1, TOGETHER + 1)]).dropDuplicates(["id_a", "id_b"])  # keys are hashes, of which a set may have equal ones
    return found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "jaccard").unionByName(same)
