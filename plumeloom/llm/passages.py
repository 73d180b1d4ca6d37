"""Substring dedup by paragraphs: banding, exact check, components of removals.

Paragraphs are units of two kinds.

Lines of MIN_WORDS words or more are MinHashed into bands, lines that collide in a band are compared
on their full shingle sets, and links (Jaccard 0.75 or more) form clusters. Bands are tuned so that a
pair at the linking similarity is missed with probability TOLERATED at most. Sketches, classes of
equal lines, hot bands and components are those of neardup.

Passages that stand inside lines, or go over several, are found by sliding paragraphs of SLIDING
shingles over a whole text: each has a MinHash of one value, the place of its least shingle, and
around each such place stands a window of WINDOW words. Windows of the same words (128 bits) are
linked, their Jaccard similarity is 1; those that stand in two documents or more count. Two texts that share a run of REACH words also share a whole
sliding paragraph with its windows inside the run, so every shared run of REACH words is found,
wherever it stands. Windows that overlap are reported as one passage; of a run it covers all but less
than SLIDING words at either end.

The first member of a cluster by doc_id and place stays, the others are to be removed. A word of a
removed window that a window which stays holds too is not removed.

Lines of fewer than `least` words (a parameter) are common phrases and no paragraphs of their own;
with least=1 every line is one, by the same path.

Defined cases. Null and empty texts have no paragraphs. A text that repeats a line has it removed
like any other; words that only one text repeats, and not as a line, are a matter of quality rules.
Repeated rows of one id have equal paragraphs, of which ties in doc_id
and place stay together. Null ids come last in the order of what stays. Empty tables give no
rows. Other columns are ignored by repeated() and come through removed() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.llm.joins import looked_up
from plumeloom.llm.neardup import _DIGEST, PART, SHINGLE, WHOLE, Banding, Sketcher, _constants, _mix, grouped, hashes_of, lists_of, portions, shingles_of
from plumeloom.plans.storage import dropped, released, written

MIN_WORDS = 20
TOLERATED = 2e-5
#: A run of REACH words holds all windows of a sliding paragraph of SLIDING shingles, of which each
#: has BEFORE words before its place.
REACH, WINDOW, BEFORE = 50, 26, 11
SLIDING = REACH - WINDOW + 1
UNIT = "doc_id long, of long, line boolean, para int, start long, length long, n long, da long, db long, cols array<long>"


def tuned(rows: int = 2, tolerated: float = TOLERATED) -> Banding:
    """The fewest bands of so many MinHash values that miss a linked pair seldom enough."""
    miss = 1 - (PART / WHOLE) ** rows
    bands = 1
    while miss**bands > tolerated:
        bands += 1
    return Banding(bands, rows, tensored=False)


_BY_PLACE = [_constants(WINDOW, f"window{k}") for k in range(len(_DIGEST))]


class Words:
    """The words of many texts: hashes, code points where they begin and end, their text and line."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        edges = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        self.begin, self.end = np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)
        self.hash = hashes_of(joined.encode("utf-8", "surrogatepass").lower().split(), len(self.begin))
        breaks = np.flatnonzero(points == 10)
        self.line_begin, self.line_end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(points)]])
        self.line = np.searchsorted(breaks, self.begin)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_begin = np.cumsum(lengths) - lengths
        self.line_text = np.searchsorted(self.text_begin, self.line_begin, "right") - 1
        self.text = self.line_text[self.line]


def windows_of(w: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first word of each window, and its words' digests."""
    shingles, last = shingles_of(w.hash), SLIDING + SHINGLE - 2
    if len(w.hash) <= last:
        return np.empty(0, np.int64), [np.empty(0, np.uint64) for _ in _BY_PLACE]
    inside = np.flatnonzero(w.text[:-last] == w.text[last:])
    paragraphs = np.lib.stride_tricks.sliding_window_view(shingles, SLIDING)[inside]
    place = inside + SLIDING - 1 - paragraphs[:, ::-1].argmin(axis=1)  # of equal shingles the last
    first = np.unique(place) - BEFORE
    first = first[(first >= 0) & (first + WINDOW <= len(w.hash))]
    first = first[(w.text[first] == w.text[first + WINDOW - 1])]
    sums = [sum((w.hash[first + k] * c[k] for k in range(WINDOW)), np.zeros(len(first), np.uint64)) for c in _BY_PLACE]
    return first, [_mix(x) for x in sums]


def _units(batches: Iterator[pa.RecordBatch], least: int, banding: Banding) -> Iterator[pa.RecordBatch]:
    sketch = Sketcher(banding)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = [f.split(" ")[0] for f in UNIT.split(", ")]

    def rows(ids: pa.Array, of: pa.Array, text: np.ndarray, line: bool, *columns) -> pa.RecordBatch:
        at = pa.array(text)
        out = [ids.take(at), of.take(at), pa.array(np.full(len(text), line)), *columns]
        return pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(t) for x, t in zip(out, kinds, strict=True)], names=names)

    for batch in batches:
        for first, part in portions(batch.column("text")):
            ids, of = (batch.column(c).slice(first, len(part)) for c in ("doc_id", "of"))
            w = Words(part)
            lines = np.flatnonzero(np.bincount(w.line, minlength=len(w.line_begin)) >= max(1, least))
            if len(lines):
                number = np.full(len(w.line_begin), -1)
                number[lines] = np.arange(len(lines))
                mine = number[w.line] >= 0
                n, high, low, cols = sketch.of_words(w.hash[mine], number[w.line[mine]], len(lines))
                text = w.line_text[lines]
                para = lines - np.searchsorted(w.line_begin, w.text_begin)[text]
                yield rows(ids, of, text, True, para, w.line_begin[lines] - w.text_begin[text], w.line_end[lines] - w.line_begin[lines], n, high, low, lists_of(cols))
            begin, (high, low) = windows_of(w)
            if len(begin):
                text, none = w.text[begin], pa.nulls(len(begin), pa.int64())
                yield rows(ids, of, text, False, pa.nulls(len(begin), pa.int32()), w.begin[begin] - w.text_begin[text], w.end[begin + WINDOW - 1] - w.begin[begin], none, high.view(np.int64), low.view(np.int64), pa.nulls(len(begin), kinds[-1]))


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, want in zip(batch.column("text"), batch.column("want"), strict=True):
            lines, want = text.as_py().split("\n"), want.as_py()
            out = [[x[c] for x in want] for c in ("node", "da", "db")] + [[lines[x["para"]] for x in want]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["node", "da", "db", "text"])


def _first():
    """The least of doc_id (null last) and place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start"))


def _stays():
    return F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("start") == F.col("k.start"))


def _lines(units: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """Lines with near copies: doc_id, of, para, start, length, n_copies, k (the one that stays), removed."""

    def texts_of(wanted: DataFrame) -> DataFrame:
        by_text = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("of").alias("_of")).agg(F.collect_list(F.struct("node", "para", "da", "db")).alias("want"))
        met = texts.join(by_text, texts["doc_id"].eqNullSafe(by_text["_id"]) & (texts["of"] == by_text["_of"]))
        return met.select("text", "want").mapInArrow(_wanted_lines, "node long, da long, db long, text string")

    lines = units.filter("line")
    rooted = grouped(lines, ["doc_id", "of", "para"], banding, texts_of)
    rows = written(lines.select("doc_id", "of", "para", "start", "length", "da", "db").join(rooted, ["da", "db"]).drop("da", "db"), "lines")
    dropped(rooted)
    clusters = rows.groupBy("root").agg(F.count("*").alias("n_copies"), _first().alias("k")).filter("n_copies > 1")
    return looked_up(rows, clusters, ["root"], "n_copies").drop("root").withColumn("removed", ~_stays())


def _windows(units: DataFrame) -> DataFrame:
    """Windows that stand in two documents or more: the same columns."""
    rows = units.filter("NOT line").select("doc_id", "of", F.lit(None).cast("int").alias("para"), "start", "length", "da", "db")
    document = F.xxhash64("doc_id", "of")
    classes = rows.groupBy("da", "db").agg(F.count("*").alias("n_copies"), _first().alias("k"), F.min(document).alias("low"), F.max(document).alias("high"))
    classes = written(classes.filter("low <> high").drop("low", "high"), "window-classes")
    released(units.sparkSession)
    met = looked_up(rows, classes, ["da", "db"], "n_copies").drop("da", "db")
    return met.withColumn("removed", ~_stays())


def _surveyed(docs: DataFrame, least: int, banding: Banding) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units, lines and windows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text")
    units = written(texts.mapInArrow(lambda b: _units(b, least, banding), UNIT).withColumn("rid", F.monotonically_increasing_id()), "units")
    lines = written(_lines(units, texts, banding), "line-copies")
    released(docs.sparkSession)
    windows = written(_windows(units), "window-copies")
    dropped(units)
    released(docs.sparkSession)
    return lines, windows


def repeated(docs: DataFrame, least: int = MIN_WORDS, banding: Banding | None = None) -> DataFrame:
    """Each line that has a near copy and each passage of windows that have copies: doc_id, para (null for
    a passage), start, length (code points), n_copies (a passage's most copied window), kept_doc_id
    and kept_start (where the copy that stays stands; the first of a passage's) and removed."""
    lines, windows = _surveyed(docs, least, banding or tuned())
    kept = [F.col("k.doc_id").alias("kept_doc_id"), F.col("k.start").alias("kept_start")]
    lines = lines.select("doc_id", "para", "start", "length", "n_copies", *kept, "removed")
    # rows that repeat an id and a text have equal windows
    once = windows.groupBy("doc_id", "of", "start").agg(F.max("length").alias("length"), F.max("n_copies").alias("n_copies"), F.min("k").alias("k"), F.max("removed").alias("removed"))
    of_text = Window.partitionBy("doc_id", "of").orderBy("start")  # the windows of one text
    ends = F.max(F.col("start") + F.col("length")).over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("start") <= ends, 0).otherwise(1)).over(of_text)
    runs = once.withColumn("ends", ends).withColumn("run", number).groupBy("doc_id", "of", "run")
    passages = runs.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("n_copies").alias("n_copies"), F.min("k").alias("k"), F.max("removed").alias("removed"))
    passages = passages.select("doc_id", F.lit(None).cast("int").alias("para"), "start", (F.col("end") - F.col("start")).alias("length"), "n_copies", *kept, "removed")
    return lines.unionByName(passages)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text is not None and spans:
                gone = np.zeros(len(text) + 1, bool)
                for what in (lambda s: not s["line"] and s["removed"], lambda s: not s["line"] and not s["removed"], lambda s: s["line"] and s["removed"]):
                    for s in filter(what, spans):  # windows that go, windows that stay, then lines with their break
                        gone[s["start"] : s["start"] + s["length"] + s["line"]] = s["removed"]
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                text = points[~gone[: len(points)]].tobytes().decode("utf-32-le", "surrogatepass")
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def removed(docs: DataFrame, least: int = MIN_WORDS, banding: Banding | None = None) -> DataFrame:
    """The documents without the lines and passages to be removed; other columns stay."""
    lines, windows = _surveyed(docs, least, banding or tuned())
    span = F.struct(F.col("para").isNotNull().alias("line"), "start", "length", "removed")
    spans = lines.filter("removed").unionByName(windows).groupBy("doc_id", "of").agg(F.collect_set(span).alias("spans"))
    of = spans.select(F.col("doc_id").alias("_id"), F.col("of").alias("_of"), "spans")
    every = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(every.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text")
    met = rows.join(of, rows["doc_id"].eqNullSafe(of["_id"]) & (rows["of"] == of["_of"]), "left").select("row", "text", "spans")
    out = met.mapInArrow(_cut, f"row {met.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
