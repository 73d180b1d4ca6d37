"""Near-duplicate texts: tensored MinHash banding, exact check on full sets, components.

A unit's set is its distinct five-word shingles. Two units are linked if their sets' Jaccard
similarity is 0.75 or more.

1. Sketch. A unit has COLLECTIONS small collections of HASHES MinHash values each. A table's key
   is a pair of collections, so 18 collections of 2 values give 153 tables of 4 values at the
   price of 36 MinHash values. At similarity 0.75 a pair misses all tables with probability
   8e-6, at 0.8 with 3e-7.
2. Classes. Units with equal sets (128-bit digest) are one class; only classes go on.
3. Buckets. A class needs two collections that some other class shares; others drop out before
   any pair of collections is formed, which is exact.
4. First links. Each bucket's least class is compared with the others of the bucket, on full
   sets. Copies and near copies become components at a cost linear in their number.
5. The rest. In buckets that still hold several components, every pair across components is
   compared. Where that would be many pairs, the strays first meet a few chance members of their
   buckets, which ties large families of near copies together. What is still apart goes to an
   exact prefix join: with shingles ordered from rare to frequent, two linked sets share one
   among the first n - ceil(0.75 n) + 1, so what is common to many texts is not a key at all.
6. Components over all links; nothing about all units ever reaches the driver.

Defined cases. Units without words (null, empty) have the empty set, size 0, and are linked with
nothing. Units of fewer than five words have one shingle, the whole sequence. Rows that repeat
an id and a text are one unit; rows with the same id and other texts are separate sets, and
either can pull the id into a component. A null id never is a component's id unless all its
members' are null. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeloom.plans.graph import components
from plumeloom.plans.storage import dropped, released, written

SHINGLE = 5
#: A similarity of PART / WHOLE links.
PART, WHOLE = 75, 100
#: Pairs that a bucket may give at step 5 before its classes take the exact prefix join.
DIRECT_PAIRS = 16
#: Turns in which what is left in larger buckets meets so many chance members of them each.
CHANCE_TURNS, CHANCE_MEMBERS = 1, 8
#: Size of the bitmaps of step 5, in words of 64 bits (a power of two).
BITMAP_WORDS = 16


@dataclass(frozen=True)
class Banding:
    """collections of hashes MinHash values; tensored: keys are pairs of collections."""

    collections: int
    hashes: int
    tensored: bool = True


DOCUMENTS = Banding(18, 2)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit words (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _constants(n: int, salt: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{salt}{i}".encode()) | 1 for i in range(n)], np.uint64)


_PLACE = _constants(SHINGLE, "place")


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at space and U+0009 to U+000D (what bytes.split() splits at)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def shingles_of(h: np.ndarray) -> np.ndarray:
    """A 64-bit word of each run of SHINGLE words, from the words' hashes."""
    n = max(0, len(h) - SHINGLE + 1)
    return _mix(sum((h[k : k + n] * _PLACE[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles as sorted 64-bit words."""
    words = words_of(text or "")
    if not words:
        return np.empty(0, np.uint64)
    h = hashes_of(words, len(words))
    if len(words) < SHINGLE:
        return _mix((h * _PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    return np.unique(shingles_of(h))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether WHOLE * |a & b| >= PART * |a | b|; empty sets link with nothing."""
    if not len(a) or not len(b) or WHOLE * min(len(a), len(b)) < PART * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


_DIGEST = _constants(2, "digest")


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: two sums of its shingles, each mixed in its own way."""
    return tuple(int(_mix(s ^ salt).sum(dtype=np.uint64).view(np.int64)) for salt in _DIGEST)


class Sketcher:
    """Set sizes, digests and collections of many texts at once."""

    def __init__(self, banding: Banding) -> None:
        n = banding.collections * banding.hashes
        self.shape = (banding.collections, banding.hashes)
        self.times, self.plus = _constants(n, "times"), _constants(n, "plus")
        self.fold, self.salt = _constants(banding.hashes, "fold"), _constants(banding.collections, "salt")

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n, two digest words and (texts, collections) words of each text; 0 for empty sets."""
        words = [words_of(t or "") for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        return self.of_words(hashes_of(itertools.chain.from_iterable(words), int(counts.sum())), np.repeat(np.arange(len(words)), counts), len(words))

    def of_words(self, h: np.ndarray, owner: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same from the words' hashes, in order, and the unit (not falling) of each."""
        counts = np.bincount(owner, minlength=units)
        few = counts[owner] < SHINGLE
        place = np.arange(len(h)) - (np.cumsum(counts) - counts)[owner]
        short = np.flatnonzero(few & (place == 0))
        parts = h[few] * _PLACE[place[few]]
        sums = np.add.reduceat(parts, np.flatnonzero(place[few] == 0)) if len(short) else parts
        long_enough = max(0, len(h) - SHINGLE + 1)
        inside = owner[:long_enough] == owner[SHINGLE - 1 :] if long_enough else np.zeros(0, bool)
        shingles = np.concatenate([shingles_of(h)[inside], _mix(sums + counts[owner[short]].astype(np.uint64))])
        owner = np.concatenate([owner[:long_enough][inside], owner[short]])
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
        shingles, owner = shingles[new], owner[new]
        n, digest, cols = np.bincount(owner, minlength=units), np.zeros((2, units), np.uint64), np.zeros((units, self.shape[0]), np.uint64)
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            at = owner[first]
            for k, salt in enumerate(_DIGEST):
                digest[k, at] = np.add.reduceat(_mix(shingles ^ salt), first)
            least = np.stack([np.minimum.reduceat(shingles * t + p, first) for t, p in zip(self.times, self.plus, strict=True)], 1)
            cols[at] = _mix((_mix(least).reshape(-1, *self.shape) * self.fold).sum(axis=2, dtype=np.uint64) + self.salt)
        return n.astype(np.int64), digest[0].view(np.int64), digest[1].view(np.int64), cols.view(np.int64)


#: Characters of text that are sketched at once, in whole texts.
CHARS_AT_ONCE = 2_000_000


def portions(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Whole texts (null as empty) in lists of about CHARS_AT_ONCE characters, each with its first's place."""
    begin = 0
    while begin < len(texts):
        chars, part = 0, []
        while begin + len(part) < len(texts) and chars < CHARS_AT_ONCE:
            part.append(texts[begin + len(part)].as_py() or "")
            chars += len(part[-1])
        yield begin, part
        begin += len(part)


def lists_of(cols: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(cols) + 1) * cols.shape[1], pa.int32()), pa.array(cols.ravel()))


def _sketches(batches: Iterator[pa.RecordBatch], banding: Banding, carried: int) -> Iterator[pa.RecordBatch]:
    sketch = Sketcher(banding)
    for batch in batches:
        for begin, part in portions(batch.column(carried)):
            n, high, low, cols = sketch(part)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(begin, len(part)) for k in range(carried)], *map(pa.array, (n, high, low)), lists_of(cols)], names=[*batch.schema.names[:carried], "n", "da", "db", "cols"])


def sketched(units: DataFrame, names: list[str], banding: Banding) -> DataFrame:
    """units (names, text) -> names, n, da, db, cols and rid, a row's own number."""
    given = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in names)
    rows = units.select(*names, "text").mapInArrow(lambda b: _sketches(b, banding, len(names)), f"{given}, n long, da long, db long, cols array<long>")
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "sketches")


def _alike(a: str, b: str) -> str:
    """Sizes that allow a link."""
    return f"{WHOLE} * least({a}, {b}) >= {PART} * greatest({a}, {b})"


def _buckets(classes: DataFrame, banding: Banding) -> DataFrame:
    """key, node, n and lead (the least node with its size) for buckets of two classes or more."""
    rows = classes.select("node", "n", F.explode("cols").alias("key"))
    several = lambda df: df.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last")
    if banding.tensored:
        shared = rows.join(several(rows).select("key"), "key", "left_semi")
        by_node = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list("key")).alias("cols")).filter(F.size("cols") > 1)
        by_node = written(by_node, "collections")  # at most `collections` words a class
        pairs = F.flatten(F.transform("cols", lambda x, i: F.transform(F.slice("cols", i + 2, F.size("cols")), lambda y: F.xxhash64(x, y))))
        rows = by_node.select("node", "n", F.explode(pairs).alias("key"))
    out = written(rows.join(several(rows).select("key", "lead"), "key"), "buckets")
    if banding.tensored:
        dropped(by_node)
    return out


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: OrderedDict = OrderedDict()

    def set_of(node, text, da, db):
        if node not in sets:
            s = shingle_set(text.as_py())
            if digest_of(s) != (da, db):
                return None  # another text under the same key: not kept, the right one is still to come
            sets[node] = s
            if len(sets) > 32:
                sets.popitem(last=False)
        return sets[node]

    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        ids = {n: c[n].to_pylist() for n in ("a", "b", "da_a", "db_a", "da_b", "db_b")}
        good = []
        for i in range(batch.num_rows):
            x = set_of((ids["da_a"][i], ids["db_a"][i]), c["text_a"][i], ids["da_a"][i], ids["db_a"][i])
            y = set_of((ids["da_b"][i], ids["db_b"][i]), c["text_b"][i], ids["da_b"][i], ids["db_b"][i])
            good.append(x is not None and y is not None and linked(x, y))
        yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(good))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("da").alias(f"da_{x}"), F.col("db").alias(f"db_{x}"), F.col("text").alias(f"text_{x}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return written(both.mapInArrow(_check, "a long, b long"), "checked")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, root, da, db, text in zip(*(batch.column(n).to_pylist() for n in ("node", "root", "da", "db", "text")), strict=True):
            s = shingle_set(text)
            if digest_of(s) == (da, db):
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node)), pa.array(np.full(n, root)), pa.array(np.full(n, n)), pa.array(s.view(np.int64))], names=["node", "root", "n", "shingle"])


def _strays(rows: DataFrame, key: str, near: str) -> DataFrame:
    """Pairs (a, b) across components (root) of rows that share a key; near: a condition on n and
    c of x and y that every link meets.

    One component of a key, that of its least root, stands on one side only: a large component
    is never paired with itself.
    """
    first = rows.groupBy(key).agg(F.min("root").alias("main"), F.max("root").alias("other")).filter("main < other").select(key, "main")
    rows = rows.join(first, key)
    side = lambda i: rows.select(key, F.col("node").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in rows.columns if c not in (key, "node", "main")], *(["main"] if i == "y" else []))
    left = side("x").join(first.withColumnRenamed("main", "main_x"), key).filter("root_x <> main_x")
    met = left.join(side("y"), key).filter("root_x <> root_y AND (root_y = main OR x < y)").filter(near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs across components among nodes (node, root) that can be links; exact.

    c counts a set's shingles that occur in any other set here: the others, first in the order,
    are in common with none. A pair is kept where these bounds of the common shingles allow a
    link: what c and the place of the first common shingle leave, and c less the bits of one
    set's bitmap that the other's lacks, each of which stands for a shingle that it lacks.
    """
    rows = nodes.join(texts, "node").select("node", "root", "da", "db", "text").mapInArrow(_shingle_rows, "node long, root long, n long, shingle long")
    rows = written(rows.distinct(), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    common = rows.join(often, "shingle").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    common = common.withColumn("c", F.size("all").cast("long")).filter(f"{WHOLE} * c >= {PART} * n")
    word = "aggregate(filter(all, s -> (shiftrightunsigned(s.shingle, 6) & {last}) = {k}), 0L, (a, s) -> a | shiftleft(1L, CAST(s.shingle & 63 AS INT)))"
    bits = [f"b{k}" for k in range(BITMAP_WORDS)]
    common = common.withColumns({b: F.expr(word.format(last=BITMAP_WORDS - 1, k=k)) for k, b in enumerate(bits)})
    keep = F.expr(f"CAST(n - ({PART} * n + {WHOLE - 1}) div {WHOLE} + 1 - (n - c) AS INT)")
    prefix = common.select("node", "root", "n", "c", *bits, F.posexplode(F.slice("all", F.lit(1), keep)).alias("p", "s"))
    prefix = prefix.withColumn("shingle", F.col("s.shingle")).drop("s")
    lacks = lambda x, y: " + ".join(f"bit_count({b}_{x} & ~{b}_{y})" for b in bits)
    enough = f"{WHOLE + PART} * least({{0}}, {{1}}) >= {PART} * (n_x + n_y)"
    near = f"{_alike('n_x', 'n_y')} AND {enough.format('c_x - p_x', 'c_y - p_y')} AND {enough.format(f'c_x - ({lacks("x", "y")})', f'c_y - ({lacks("y", "x")})')}"
    pairs = written(_strays(prefix, "shingle", near), "prefix-pairs")
    dropped(rows)
    return pairs


def _rest(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components (but for pairs already compared): key, node,
    n, root, main (the bucket's least root) and pairs (at most so many across components)."""
    rooted = buckets.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("last"), F.count("*").alias("all")).filter("main < last AND all > 2").drop("last")
    rooted = rooted.join(several, "key")
    strays = rooted.groupBy("key").agg((F.count_if(F.col("root") != F.col("main")) * F.max("all")).alias("pairs"))
    return written(rooted.drop("all").join(strays, "key"), "rest")


def _chance_pairs(hot: DataFrame, turn: int) -> DataFrame:
    """Pairs of each stray with a few chance members of its large buckets."""
    member = F.min_by(F.struct(F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b")), F.xxhash64("node", F.lit(turn)))
    met = hot.filter("root <> main").join(hot.groupBy("key").agg(member.alias("m")), "key").filter("m.root_b <> root").filter(_alike("n", "m.n_b"))
    some = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("m.b", "key").alias("h"), F.col("m.b").alias("b")))), 1, CHANCE_MEMBERS).alias("s"))
    pairs = some.select(F.col("node").alias("x"), F.explode("s.b").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def grouped(sketches: DataFrame, keys: list[str], banding: Banding, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """da, db and root, the row number of the least class of its component, for each class.

    sketches: keys, n, da, db, cols, rid. texts_of gives node, da, db and text for rows node, da, db
    and keys, which are the row that speaks for a class; it may give a row more than once.
    """
    some = sketches.filter("n > 0")
    classes = some.groupBy("da", "db").agg(F.min_by(F.struct("n", "cols", *keys), "rid").alias("h"), F.min("rid").alias("node"))
    classes = written(classes.select("da", "db", "node", "h.*"), "classes")
    released(sketches.sparkSession)
    buckets = _buckets(classes, banding)
    released(sketches.sparkSession)
    wanted = buckets.select("node").distinct().join(classes.select("node", "da", "db", *keys), "node")
    texts = written(texts_of(wanted), "candidate-texts")
    if not texts.groupBy("node").count().filter("count > 1").isEmpty():  # rows that repeat a key and a text
        repeated, texts = texts, written(texts.dropDuplicates(["node"]), "candidate-texts")
        dropped(repeated)
    released(sketches.sparkSession)

    sizes = classes.select(F.col("node").alias("lead"), F.col("n").alias("lead_n"))
    stars = buckets.filter("node <> lead").select("lead", "node", "n").distinct().join(sizes, "lead").filter(_alike("n", "lead_n"))
    links = _links(stars.select(F.col("lead").alias("a"), F.col("node").alias("b")), texts)
    roots = components(links)
    as_links = lambda r: r.select(F.col("node").alias("a"), F.col("root").alias("b"))

    split = _rest(buckets, roots)
    for turn in range(CHANCE_TURNS):
        hot = split.filter(F.col("pairs") > DIRECT_PAIRS)
        if hot.isEmpty():
            break
        more = _links(_chance_pairs(hot, turn), texts)
        roots = components(as_links(roots).unionByName(more))
        dropped(split, more)
        split = _rest(buckets, roots)
    released(sketches.sparkSession)
    pairs = _strays(split.filter(F.col("pairs") <= DIRECT_PAIRS).select("key", "node", "n", "root"), "key", _alike("n_x", "n_y"))
    hot = split.filter(F.col("pairs") > DIRECT_PAIRS)
    if not hot.isEmpty():
        prefix = _prefix_pairs(hot.select("node", "root").distinct(), texts)
        pairs = pairs.unionByName(prefix).distinct()
    more = _links(pairs, texts)
    if not more.isEmpty():
        roots = components(as_links(roots).unionByName(more))

    rooted = classes.select("da", "db", "node").join(roots, "node", "left").select("da", "db", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "roots")
    dropped(classes, buckets, texts, split, links, more)
    released(sketches.sparkSession)
    return rooted


def _document_texts(units: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    def texts_of(wanted: DataFrame) -> DataFrame:
        of = wanted.select("node", "da", "db", F.col("_hash").alias("_of"), *[F.col(k).alias(f"_{k}") for k in keys])
        same = units["_hash"] == of["_of"]  # null or repeated ids meet their own text only
        for k in keys:
            same = same & units[k].eqNullSafe(of[f"_{k}"])
        return units.join(of, same).select("node", "da", "db", "text")

    return texts_of


def near_duplicates(docs: DataFrame, banding: Banding = DOCUMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs."""
    units = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    sketches = sketched(units, ["doc_id", "_hash"], banding)
    rooted = grouped(sketches, ["doc_id", "_hash"], banding, _document_texts(units, ["doc_id"]))
    all_rows = written(sketches.select("doc_id", "n", "da", "db").join(rooted, ["da", "db"], "left").drop("da", "db"), "grouped")
    dropped(sketches, rooted)
    least = all_rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = all_rows.join(least, "root", "left")
    out = out.withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, banding: Banding = DOCUMENTS) -> DataFrame:
    """The documents that near_duplicates() keeps. Rows that repeat a kept id all stay."""
    kept = near_duplicates(docs, banding).filter("kept").select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
