"""Document fingerprints: a Merkle tree over phrases, paragraphs and sections.

Leaves are phrases: a paragraph (line) is cut after a PHRASE_END and a blank, and after MOST
characters without one, so that a line of any script has leaves. A paragraph's node hashes its
phrases' hashes, in order. A section is a run of paragraphs; it ends at an empty one, at one whose
hash ends in 0 or 8, and at the text's end, so that sections fall into step again after an edit. A
section's node hashes its paragraphs' hashes and the root hashes the sections'; all are SHA-256.
Equal texts have equal roots; where roots differ, differing() goes down the branches whose hashes
differ and names the sections and paragraphs, and first_edit() the first of them.

likeness() is twice the leaves in common over the sum of both trees' leaves, repeated ones as often
as they occur. It is 1 exactly if the roots are equal.

Defined cases. A null or empty text is one empty paragraph: its fingerprints are equal and two
of them have likeness 1. In with_next(), rows are ordered by doc_id (null first) and then by
text; repeated rows follow one another; a single row is its own successor; an empty table gives
no rows. Columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.llm.text import bound, fenced, whole

PHRASE_END = "[.!?,;:aednio]"
MOST = 96
LEAF = rf"(.{{1,{MOST}}}?{PHRASE_END} |.{{{MOST}}})"
CUT = "\u0001"
#: The node of an empty paragraph: it has one leaf, which is empty.
EMPTY = sha256(sha256(b"").hexdigest().encode()).hexdigest()
#: Ordered neighbours are found in buckets of ids; their heads are broadcast, 40 bytes each.
LEVELS = 10
MOST_BUCKETS, ROWS_IN_BUCKET, ROWS_IN_TASK = 1 << 17, 1000, 20_000


def _numbered(leaves: Column) -> Column:
    """64 bits of each leaf and of how many equal ones come before it, from the leaves' sorted hashes."""
    runs = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    spread = lambda s, starts: F.flatten(F.transform(starts, lambda i, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(starts, k + 1), F.size(s)) - i - 1), lambda j: F.xxhash64(F.get(s, i), j))))
    return bound(F.sort_array(leaves), lambda s: bound(runs(s), lambda starts: spread(s, starts)))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the tree of a column without nulls: struct of root, sections, ends, paragraphs, leaves."""
    f, p, e, s = f"_{name}_f", f"_{name}_p", f"_{name}_e", f"_{name}_s"
    hashes = lambda line: F.transform(F.split(F.regexp_replace(line, LEAF, f"$1{CUT}"), CUT), lambda x: F.sha2(x, 256))
    df = fenced(df.withColumn(f, F.transform(F.split(text, "\n"), hashes)), f)
    df = fenced(df.withColumn(p, F.transform(f, lambda leaves: F.sha2(F.array_join(leaves, ""), 256))), p)

    def closes(i: Column) -> Column:
        h = F.get(p, i - 1)
        return (i == F.size(p)) | (h == EMPTY) | F.right(h, F.lit(1)).isin("0", "8")

    df = df.withColumn(e, F.filter(F.sequence(F.lit(1), F.size(p)), closes))

    def section(end: Column, k: Column) -> Column:
        begin = F.coalesce(F.get(e, k - 1), F.lit(0))
        return F.sha2(F.array_join(F.slice(p, begin + 1, end - begin), ""), 256)

    df = df.withColumn(s, F.transform(e, section))
    leaves = _numbered(F.flatten(F.transform(f, lambda x: F.transform(x, lambda h: F.xxhash64(h)))))
    tree = F.struct(F.sha2(F.array_join(s, ""), 256).alias("root"), F.col(s).alias("sections"), F.col(e).alias("ends"), F.col(p).alias("paragraphs"), leaves.alias("leaves"))
    return df.withColumn(name, tree).drop(f, p, e, s)


def likeness(a: Column, b: Column) -> Column:
    sizes = F.size(a["leaves"]) + F.size(b["leaves"])
    common = F.size(F.array_intersect(a["leaves"], b["leaves"])) * 2.0 / sizes
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.least(common, 1.0 - 1.0 / (sizes + 1)))


def first_edit(a: Column, b: Column) -> Column:
    """The number, from 0, of the first paragraph of a that is not b's of this number (a's number of
    paragraphs where a is a beginning of b); null for equal roots. Only one section is gone through."""
    differ = lambda x, y: lambda k: ~F.get(x, k).eqNullSafe(F.get(y, k))
    at = lambda size, first, what: F.get(F.filter(F.sequence(first, size), what), F.lit(0))
    section = at(F.size(a["sections"]) - 1, F.lit(0), differ(a["sections"], b["sections"]))
    begin = lambda k: F.coalesce(F.get(a["ends"], k - 1), F.lit(0))
    inside = bound(section, lambda k: at(F.get(a["ends"], k), begin(k), differ(a["paragraphs"], b["paragraphs"])))
    # every section of a is b's: b goes on after them
    return F.when(a["root"] != b["root"], F.when(section.isNull(), F.size(a["paragraphs"])).otherwise(inside).cast("long"))


def differing(a: Column, b: Column) -> Column:
    """Where tree a differs from tree b: its sections, and the paragraphs in them, by number from 0."""
    other = F.array_except(a["sections"], b["sections"])
    numbers = F.filter(F.transform(a["sections"], lambda h, k: F.when(F.array_contains(other, h), k)), lambda k: k.isNotNull())
    inside = F.flatten(F.transform(numbers, lambda k: F.sequence(F.coalesce(F.get(a["ends"], k - 1), F.lit(0)), F.get(a["ends"], k) - 1)))
    lines = F.filter(inside, lambda i: ~F.array_contains(b["paragraphs"], F.get(a["paragraphs"], i)))
    return F.when(a["root"] != b["root"], F.struct(numbers.alias("sections"), lines.alias("paragraphs")))


def _buckets(docs: DataFrame):
    """A column of doc_id, a number that does not fall as doc_id rises (-1 for a null id), and the
    number of ids.

    Quantiles of all ids (a fixed number of them, taken once) bound cells of about equal size and
    each cell is cut evenly, so that ids need be neither dense nor even.
    """
    cells = 1 << LEVELS
    shares = [i / cells for i in range(1, cells)]
    n, low, high, bounds = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", shares, 10 * cells)).first()
    none = F.lit(-1).cast("long")
    if not n:
        return lambda df: df.withColumn("bucket", none), 0
    parts = max(1, min(MOST_BUCKETS // cells, n // (cells * ROWS_IN_BUCKET)))

    def bucketed(df: DataFrame) -> DataFrame:
        edges = F.array(*[F.lit(x).cast("long") for x in [low, *bounds, high]])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(LEVELS))])
        # binary search: the number of bounds that are at most the id
        df = df.withColumn("_cell", F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(edges, at + s) <= F.col("doc_id"), at + s).otherwise(at)))
        lo, hi = F.get(edges, F.col("_cell")).cast("double"), F.get(edges, F.col("_cell") + 1).cast("double")
        part = F.floor((F.col("doc_id").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * parts).cast("long")
        bucket = F.col("_cell").cast("long") * parts + F.least(F.greatest(part, F.lit(0).cast("long")), F.lit(parts - 1).cast("long"))
        return df.withColumn("bucket", F.coalesce(bucket, none)).drop("_cell")

    return bucketed, n


def with_next(docs: DataFrame, derive=lambda df: df, lead: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null as empty) and next_<column> of the next row by doc_id, in a ring.

    derive adds columns after the one shuffle; lead names those of them to take from the next
    row beside its text. The first rows of each bucket also travel to the bucket before, where
    they end the window; which they are comes from a pass over the ids alone.
    """
    bucketed, n = _buckets(docs)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_IN_TASK)
    rows = bucketed(docs.select("doc_id", whole(F.col("text")).alias("text")))
    heads = bucketed(docs.select("doc_id")).groupBy("bucket").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("bucket")  # at most MOST_BUCKETS + 1 rows
    back = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    heads = heads.select("head", back.alias("back"))
    own = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("back").alias("at"), F.lit(1).alias("guest"))
    rows = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head"]), "left")
    rows = rows.withColumn("place", F.explode(F.when(F.col("back").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    rows = derive(rows.select("doc_id", "text", "place.*").repartition(tasks, "at"))
    after = Window.partitionBy("at").orderBy("guest", "doc_id", "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(after) for c in ("text", *lead)})
    return rows.filter("guest = 0").drop("at", "guest")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: its second half is replaced by the
    beginning of the next document's text."""
    rows = with_next(docs, lambda df: with_tree(df, "text", "tree"), ("tree",))
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half))
    rows = rows.withColumn("edited_text", text)
    return with_tree(rows, "edited_text", "edited_tree").drop("next_text")
