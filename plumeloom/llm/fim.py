"""Fill-in-the-middle: texts cut at units of words and characters, by relations of units.

A text's units (letter runs and single other characters) are matched and exploded with their ordinals, a
window over each text sums their lengths, the two cuts asked of a text meet the units by ordinal in a
join, and an aggregate brings their offsets back to one row per text, which substrings then use.

This goes in two steps, so that what a window sorts is not larger than the texts. Matches are exploded
as blocks of BLOCK units each, the window sums the blocks, and the requests meet the blocks that hold the
units before their cuts. Only these blocks are exploded to units, whose lengths are summed up to
the cut. A block begins and ends between units, so it has the same units by itself.

Texts are shuffled once, by a number of their own, so that a long text or an often repeated id is not in
one place with others. Blocks and units never are: explode, window, join and aggregate all
keep that partitioning. The requests, one row per text, are the only other rows that move.

Cuts. h1 to h4 are the first four groups of eight hexadecimal digits of the sha256 of `<seed>:<doc_id>`.
Of n units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the
larger. h3 leaves PLAIN per cent of the texts as they are, h4 puts SPM per cent of the others in
suffix-prefix-middle order.

Defined cases. A null text is read as empty. Empty texts and texts that hold a mark are plain, with
null lengths. A null id is hashed as an empty one; rows of one id are cut by the same hashes, each in its own
text. Repeated rows stay repeated. A prefix, middle or suffix may be empty. Texts of any length are cut
whole; the matches of one text stand in one row while they are exploded. An empty table gives no rows.
Other columns come through transformed() whatever their names, but for those it makes. docs is read
twice over one plan, of which row numbers are a part: give a table as it was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.llm.text import bound, fenced, whole

UNIT = r"[A-Za-z]+|[^A-Za-z]"
MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM = 10, 20
SEED = 1
#: Units that are exploded together.
BLOCK = 256


def n_units(text: Column) -> Column:
    """How many units there are: letter runs as one character each."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def requests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """_doc (docs' columns but the text), row (a number of its own), raw (the text), n, form and the ordinals first and
    last of the units before the cuts."""
    others = F.struct(F.lit(0).alias(""), *[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    rows = docs.select(others.alias("_doc"), F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("of"), docs["text"].alias("raw"), whole(docs["text"]).alias("text"))
    h1, h2, h3, h4 = hashes(F.col("of"), seed)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= 100 - PLAIN)
    rows = rows.withColumn("n", n_units(F.col("text"))).withColumn("form", F.when(plain, "plain").when(h4 % 100 < SPM, "spm").otherwise("psm"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return rows.select("_doc", "row", "raw", "n", "form", F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))


def blocks(rows: DataFrame) -> DataFrame:
    """row, block, part (the text of BLOCK units) and before (code points before it) of every text that may be cut."""
    none = F.array().cast("array<string>")
    matches = F.when(F.col("form") == "plain", none).otherwise(F.regexp_extract_all("raw", F.lit(UNIT), F.lit(0)))
    starts = lambda m: F.when(F.size(m) > 0, F.sequence(F.lit(1), F.size(m), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    parts = bound(matches, lambda m: F.transform(starts(m), lambda k: F.array_join(F.slice(m, k, BLOCK), "")))
    cut = rows.select("row", F.posexplode(parts).alias("block", "part"))
    earlier = Window.partitionBy("row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("row", "block", "part", F.coalesce(F.sum(F.length("part")).over(earlier), F.lit(0)).alias("before"))


def block_of(cut: Column) -> Column:
    """The block that holds the last unit before a cut."""
    return F.floor(F.greatest(cut - 1, F.lit(0)) / BLOCK)


def offsets(rows: DataFrame) -> DataFrame:
    """_row and the code points p and m before the two cuts of every text that may be cut and has units."""
    asked = rows.select(F.col("row").alias("_row"), "first", "last")
    met = blocks(rows).join(asked, (F.col("row") == F.col("_row")) & F.col("block").isin(block_of(F.col("first")), block_of(F.col("last"))))
    units = met.select("_row", "first", "last", "block", "before", F.posexplode(F.regexp_extract_all("part", F.lit(UNIT), F.lit(0))).alias("place", "unit"))
    units = units.withColumn("ordinal", F.col("block") * BLOCK + F.col("place") + 1)

    def at(cut: str) -> Column:
        inside = F.col("block") == block_of(F.col(cut))
        whole_blocks = F.max(F.when(inside & (F.col(cut) > 0), F.col("before")))
        return F.coalesce(whole_blocks, F.lit(0)) + F.coalesce(F.sum(F.when(inside & (F.col("ordinal") <= F.col(cut)), F.length("unit"))), F.lit(0))

    return units.groupBy("_row").agg(at("first").cast("int").alias("p"), at("last").cast("int").alias("m"))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone: no part of a text that is cut holds a mark."""
    second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    third = F.locate(MIDDLE, output)
    one = F.substring(output, F.lit(1 + len(PREFIX)), second - 1 - len(PREFIX))
    two = F.substring(output, second + len(SUFFIX), third - second - len(SUFFIX))
    three = F.substring(output, third + len(MIDDLE), F.length(output))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs' columns with n, form, prefix_chars, middle_chars and output."""
    spread = fenced(requests(docs, seed).repartition("row"), "_doc", "raw", "n", "form", "first", "last")
    rows = spread.join(offsets(spread), F.col("row") == F.col("_row"), "left")
    text, p = whole(F.col("raw")), F.coalesce("p", F.lit(0))
    m = F.coalesce("m", F.lit(0))
    parts = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m - p), F.substring(text, m + 1, F.length(text))
    cut = F.col("form") != "plain"
    made = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.when(cut, p.cast("long")), "middle_chars": F.when(cut, (m - p).cast("long")), "output": assembled(F.col("form"), *parts, text)}
    kept = [F.col("raw").alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns if c not in made]
    return rows.select(*kept, *[c.alias(k) for k, c in made.items()])
