"""Mixing sources to target weights by repetition rates.

Tokens (words) are summed per source, weights become targets by water filling, and a source's
rate is its target over its size. A document is emitted floor(rate) times, plus once more by a
Bernoulli draw: if its hash, a number from 0 to 1 drawn from its id and the seed, lies under the
fraction of the rate.

A second step corrects what the draw leaves off the target: it meets it only on average, and a
source of a few long documents may miss it by several per cent. The bound on the hashes moves from
the fraction to the nearest hash at which the words taken meet the target, so that just the
documents with hashes between the two are decided anew; decided() tells both decisions. The bound is
found by a histogram of hashes per source, then inside the one bin where the target is crossed, so
no source is ever sorted in one task.

Decisions need only a document's own row and its source's row: texts are not shuffled. The table
of sources is small; Spark broadcasts it if its measured size allows, else joins it by key.

Defined cases. A null or empty text has size 0 and takes 0 words. A null source is a source of
its own, the last in order. A null doc_id draws the hash of the id -1; rows that repeat an id
share its hash and are taken or left together. Sources of size 0 have target 0. An empty table
gives no rows. mixed() returns the input's columns whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.llm.text import n_words, nested
from plumeloom.plans.storage import dropped, written

WEIGHTS = (3, 1, 2)
BUDGET = Fraction(3, 2)
MOST_REPEATS = 2
SEED = "mix-1"
#: Hashes are whole numbers below 2**60; their upper 12 bits are the histogram's bin.
HASH_HEX, BIN_BITS = 15, 12


def hash_of(doc_id: Column, seed: str = SEED) -> Column:
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id, F.lit(-1)).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, HASH_HEX), 16, 10).cast("long")


def bin_of(u: Column) -> Column:
    return F.shiftright(u, 4 * HASH_HEX - BIN_BITS)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with target, base (whole repeats), fraction (of the rate) and need
    (words of the further copies).

    Water filling in closed form: sources saturate in the order of cap over weight. With the
    first k saturated the level is what is left over the weights that are left; the right k is
    the first at which the next source stays under its cap. One row per source is sorted here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("double"))
    out = out.withColumn("cap", (F.col("source_size") * MOST_REPEATS).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every) * (float(BUDGET))
    out = out.withColumn("left", budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", F.col("left") / F.col("weights"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    out = out.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    base = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    out = out.withColumn("base", base).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    out = out.withColumn("fraction", F.coalesce(F.try_divide("need", F.col("source_size").cast("double")), F.lit(0.0)))
    return out.select("source", "source_size", "target", "base", "fraction", "need")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One narrow row per document: doc_id, source, size and hash u."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash_of(F.col("doc_id"), seed).alias("u"))


def drawn() -> Column:
    """Copies by the Bernoulli draw: a hash, as a number from 0 to 1, under the fraction."""
    return F.col("base") + F.when(F.col("u").cast("double") < F.col("fraction") * float(1 << 4 * HASH_HEX), 1).otherwise(0)


def copies() -> Column:
    """Copies after the second step."""
    return F.col("base") + F.when(F.col("u") < F.col("cut"), 1).otherwise(0)


def rates(narrow: DataFrame) -> DataFrame:
    """Per source: source_size, target, base, fraction and cut (a further copy where u < cut)."""
    bins = narrow.groupBy("source", bin_of(F.col("u")).alias("bin")).agg(F.sum("size").alias("words"))
    wanted = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    crossed = bins.join(wanted, same(bins, wanted)).select(bins["source"], "bin", (F.col("need") - F.col("before")).alias("rest"), "words")
    crossed = crossed.filter((F.col("rest") > 0) & (F.col("rest") <= F.col("words"))).drop("words")
    inside = narrow.withColumn("bin", bin_of(F.col("u")))
    inside = inside.join(crossed, same(inside, crossed) & (inside["bin"] == crossed["bin"])).select(inside["source"], "size", "u", "rest", inside["bin"])
    inside = inside.groupBy("source", "bin", "u").agg(F.sum("size").alias("size"), F.max("rest").alias("rest"))
    by_u = Window.partitionBy("source", "bin").orderBy("u")
    inside = inside.withColumn("middle", F.sum("size").over(by_u) - F.col("size") / 2)
    cuts = inside.groupBy("source", "bin").agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("u") + 1)).alias("last"))
    start = F.shiftleft(F.col("bin"), 4 * HASH_HEX - BIN_BITS)
    cuts = cuts.select("source", F.coalesce("last", start).alias("cut"))
    joined = wanted.join(cuts, same(wanted, cuts), "left")
    return joined.select(wanted["source"], "source_size", "target", "base", "fraction", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"))


def decided(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, fraction, drawn (copies by the draw), copies (after the
    second step) and taken (size times copies) per document."""
    narrow = written(sized(docs, seed), "mixing-sizes")
    rate = written(rates(narrow), "mixing-rates")
    joined = narrow.join(rate, narrow["source"].eqNullSafe(rate["source"]), "left")
    out = joined.select("doc_id", "size", "source_size", "target", "fraction", drawn().alias("drawn"), copies().alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents, each as many times as the mix repeats it."""
    narrow = written(sized(docs, seed), "mixing-sizes")
    rate = written(rates(narrow), "mixing-rates")
    dropped(narrow)
    rows = nested(docs, docs["source"].alias("of"), hash_of(docs["doc_id"], seed).alias("u"))
    joined = rows.join(rate, rows["of"].eqNullSafe(rate["source"])).withColumn("n", copies()).filter("n > 0")
    return joined.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("_doc.*")
