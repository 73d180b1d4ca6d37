"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated thresholds.

One dictionary is trained on toxic text and one on ordinary text. Every text is cut into overlapping
windows, each window is compressed with either dictionary, and the bytes that the toxic dictionary
saves over the ordinary one are its distance. How many windows pass each of THRESHOLDS, beside the
number of windows, goes through a logistic function that was fitted on other labelled rows than the
dictionaries were; the result is the score.

What makes so short windows comparable. A frame's fixed costs are paid by a preamble that stands at the
end of both dictionaries and before every window, so a match in a window costs the same with
either. Both dictionaries have one length, so offsets cost the same too. Lengths then differ only by
matches in what was trained.

What the dictionaries are trained on is distilled. A document is labelled as a whole, and most of a
toxic one is ordinary text. So runs of bytes are counted by class, each context of a run once (copies
of a document add nothing), and the toxic dictionary is trained on the segments that toxic texts have
far more often. The ordinary dictionary is trained on ordinary windows that hold no such segment and
that the toxic dictionary shortens nevertheless: what only looks like it.

Bounds. The dictionaries are trained on at most DOCS labelled documents a class, of each at most
PIECES pieces of PIECE bytes, chosen by hash; the function is fitted on at most CALIBRATED whole
documents. These come to the driver as pieces and counts. Everything else covers all rows: one pass
that shuffles nothing. Whole texts are scored, in blocks of windows.

Defined cases. Null and empty texts have no windows, and the score of none. A null id has a
score and is never held out. Equal texts have equal scores. Labels that are null, other than 0 and 1, or
of unknown ids are ignored; of several labels of an id the largest counts, of several texts of a
labelled id one is learned from. Without toxic or without ordinary labels every score is the share of
toxic labels. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeloom.plans.storage import dropped, written

#: Labels are learned only from ids whose crc32 leaves another remainder than HELD of PARTS; the dictionaries'
#: from those of TRAINED, the function's from the others.
PARTS, HELD, TRAINED = 4, 2, (0, 1)
DOCS, PIECES, PIECE, CALIBRATED = 1500, 12, 512, 8000
WINDOW, STEP = 32, 16
#: Bytes of what is trained of a dictionary, and the shortest match.
SIZE, MATCH, LEVEL = 512, 6, 5
THRESHOLDS = (1, 2, 3, 4, 5, 6)
PREDICTED = 0.3
#: A run of RUN bytes is toxic from LEAST contexts on, SIGMAS deviations (more with many pieces, in which smaller
#: differences show) and LIFT times the ordinary rate.
RUN, CONTEXT, LEAST, SIGMAS, LIFT = 5, 6, 4, 5.0, 8.0
SEED = 11
_PREAMBLE = bytes(random.Random(SEED).sample(range(2, 32), 16))
_FILL = b"\x01"
_BLOCK = 20_000


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % PARTS


def normal(text: str) -> bytes:
    """Lower case, one blank between words and at either end."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: bytes) -> list[bytes]:
    n = max(0, -(-(len(text) - WINDOW) // STEP)) + 1 if text else 0
    return [text[k : k + WINDOW] for k in range(0, n * STEP, STEP)]


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(data) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + data[j : len(data) - k + 1 + j].astype(np.uint64) + np.uint64(1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def segments(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """Segments that toxic pieces have far more often than ordinary ones, with how often."""
    edge = b"\n" * CONTEXT
    joined = [np.frombuffer(edge + edge.join([*pieces, b""]), np.uint8) for pieces in (ordinary, toxic)]
    counts, contexts = [], []
    for data in joined:
        around = _hashes(data, RUN + 2 * CONTEXT)
        runs = _hashes(data, RUN)[CONTEXT : CONTEXT + len(around)]
        once = np.unique(around, return_index=True)[1]
        contexts.append(len(once))
        counts.append(np.unique(runs[once], return_counts=True))
    (known, of), (runs, n) = counts
    at = np.minimum(np.searchsorted(known, runs), max(0, len(known) - 1))
    other = np.where(known[at] == runs, of[at], 0) if len(known) else np.zeros(len(runs), np.int64)
    share = contexts[1] / max(1, sum(contexts))
    least_sigmas = max(SIGMAS, math.sqrt(len(toxic)) / 5)
    expected = (n + other) * share
    sigmas = (n - expected) / np.sqrt(expected * (1 - share) + 1e-12)
    toxic_runs = (n >= LEAST) & (sigmas >= least_sigmas) & (n * contexts[0] >= LIFT * (other + 0.5) * contexts[1])
    runs, n, found = runs[toxic_runs], n[toxic_runs], Counter()
    if not len(runs):
        return found
    hashed = _hashes(joined[1], RUN)
    at = np.minimum(np.searchsorted(runs, hashed), len(runs) - 1)
    hits = np.flatnonzero(runs[at] == hashed)
    text = joined[1].tobytes()
    for chain in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
        often = n[at[chain]]
        core = chain[2 * often >= often.max()]  # less its chance neighbours
        found[text[core[0] : core[-1] + RUN]] += 1
    return found


def trained(samples: list[bytes], size: int = SIZE) -> bytes:
    """The content of a dictionary of zstandard's own trainer; of too few samples, the samples."""
    try:
        data = zstandard.train_dictionary(size + 256, samples, level=LEVEL, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        data = b"".join(dict.fromkeys(samples))
    return data[-size:]


def packed(found: Counter, size: int = SIZE) -> bytes:
    """The most frequent segments, the most frequent last, where zstandard looks first."""
    data = b""
    for segment, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if segment not in data and len(segment) + len(data) <= size:
            data = segment + data
    return data


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = content.rjust(SIZE, _FILL)[-SIZE:] + _PREAMBLE
    of = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, window_log=12, hash_log=12, chain_log=12, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    found.precompute_compress(compression_params=of)
    return zstandard.ZstdCompressor(dict_data=found, compression_params=of)


class Distance:
    """Bytes by which the toxic dictionary shortens windows more than the ordinary one does."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        known = np.concatenate([_hashes(np.frombuffer(d, np.uint8), MATCH) for d in (toxic, ordinary)])
        self.known = np.zeros(1 << 16, bool)
        self.known[(known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, window: bytes) -> int:
        return len(self.ordinary.compress(_PREAMBLE + window)) - len(self.toxic.compress(_PREAMBLE + window))

    def measured(self, text: str) -> list[int]:
        """How many windows there are, and how many reach each threshold.

        A window without any run of MATCH bytes of either dictionary has nothing that either could
        shorten: its distance is 0, and it is not compressed.
        """
        data = normal(text)
        n = max(0, -(-(len(data) - WINDOW) // STEP)) + 1 if data else 0
        reached = np.zeros(len(THRESHOLDS), np.int64)
        for first in range(0, n, _BLOCK):
            block = data[first * STEP : (min(n, first + _BLOCK) - 1) * STEP + WINDOW]
            places = self.known[(_hashes(np.frombuffer(block, np.uint8), MATCH) & np.uint64(0xFFFF)).astype(np.int64)]
            before = np.concatenate([[0], np.cumsum(places)])
            start = np.arange(0, (min(n, first + _BLOCK) - first) * STEP, STEP)
            last = len(before) - 1
            some = before[np.minimum(start + WINDOW - MATCH + 1, last)] > before[np.minimum(start, last)]
            far = np.array([self.of(block[k : k + WINDOW]) for k in start[some].tolist()], np.int64)
            reached += (far[:, None] >= np.array(THRESHOLDS)).sum(axis=0)
        return [n, *reached.tolist()]


def features(rows: np.ndarray) -> np.ndarray:
    """Of rows of windows and those that reach each threshold: their logarithms, as counts and as rates."""
    n, reached = rows[:, :1], rows[:, 1:]
    return np.hstack([np.log1p(reached), np.log1p(200 * reached / np.maximum(n, 20))])


@dataclass
class Logistic:
    """A logistic function of standardised features; without features, a constant."""

    constant: float = 0.5
    weights: np.ndarray | None = None
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    @classmethod
    def fitted(cls, rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Logistic:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        if not 0 < labels.sum() < len(labels):
            return cls(float(share))
        x = features(rows)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        held = np.eye(z.shape[1]) * ridge
        held[-1, -1] = 1e-9
        w = np.zeros(z.shape[1])
        w[-1] = math.log(share / (1 - share))
        loss = lambda v: np.logaddexp(0, np.where(labels > 0, -1, 1) * (z @ v)).sum() + v @ held @ v / 2
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + held, z.T @ (p - labels) + held @ w)
            size, now = 1.0, loss(w)
            while loss(w - size * step) > now and size > 1e-6:
                size /= 2  # a whole Newton step may pass the minimum
            w = w - size * step
        return cls(float(share), w, mean, scale)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Rounded, so that a row's score does not hang on what stands beside it in a batch."""
        if self.weights is None:
            return np.full(len(rows), self.constant)
        z = np.hstack([(features(rows) - self.mean) / self.scale, np.ones((len(rows), 1))])
        return np.round(1 / (1 + np.exp(-np.clip((z * self.weights).sum(axis=1), -30, 30))), 9)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    score: Logistic


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Both dictionaries' contents, from pieces of either class."""
    found = segments(toxic, ordinary)
    of_toxic = packed(found)
    distance = Distance(of_toxic, b"")
    kept = [s for s in found if s in of_toxic]
    alike = [w for p in ordinary for w in windows(p) if not any(s in w for s in kept) and distance.of(w) >= THRESHOLDS[0]]
    return of_toxic, trained(alike)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text"):
            data = normal(text.as_py() or "")
            starts = range(0, len(data), PIECE)
            if len(starts) > PIECES:
                starts = sorted(random.Random(f"{SEED}:{len(data)}").sample(starts, PIECES))
            out.append([data[k : k + PIECE] for k in starts])
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.binary()))], names=["toxic", "pieces"])


_COUNTS = "toxic int, counts array<long>"


def _measured(batches: Iterator[pa.RecordBatch], toxic: bytes, ordinary: bytes) -> Iterator[pa.RecordBatch]:
    distance = Distance(toxic, ordinary)
    for batch in batches:
        counts = [distance.measured(text.as_py() or "") for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "counts"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    distance = Distance(model.toxic, model.ordinary)
    for batch in batches:
        counts = np.array([distance.measured(text.as_py() or "") for text in batch.column("text")], np.float64).reshape(-1, 1 + len(THRESHOLDS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.score.of(counts), pa.float64()), pa.array(counts[:, 0].astype(np.int64))], names=["doc_id", "held_out", "score", "n_windows"])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows to learn from: role (train or fit), toxic and text, once an id."""
    by_id = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").groupBy("of").agg(F.max("toxic").alias("toxic"))
    known = docs.select(F.col("doc_id").cast("long").alias("of"))
    rows = by_id.join(known, "of", "left_semi").withColumns({"rest": remainder(F.col("of")), "place": F.xxhash64("of")}).filter(F.col("rest") != HELD)
    rows = rows.withColumn("role", F.when(F.col("rest").isin(*TRAINED), "train").otherwise("fit")).drop("rest")
    groups = [rows.filter((F.col("role") == "train") & (F.col("toxic") == c)).orderBy("place").limit(DOCS) for c in (0, 1)]
    chosen = [r for g in [*groups, rows.filter("role = 'fit'").orderBy("place").limit(CALIBRATED)] for r in g.select("of", "role", "toxic").collect()]
    few = docs.sparkSession.createDataFrame(chosen, "of long, role string, toxic int")  # 2 * DOCS + CALIBRATED rows at most
    met = docs.select(F.col("doc_id").cast("long").alias("of"), "text").join(F.broadcast(few), "of")
    return met.groupBy("of", "role", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("role", "toxic", "text")


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    rows = written(sample(docs, labels), "toxicity-sample")
    train = rows.filter("role = 'train'").select("toxic", "text").mapInArrow(_pieces, "toxic int, pieces array<binary>").collect()
    toxic, ordinary = (sorted(bytes(p) for r in train if r["toxic"] == c for p in r["pieces"]) for c in (1, 0))
    both = dictionaries(toxic, ordinary)
    fit = rows.filter("role = 'fit'").select("toxic", "text").mapInArrow(lambda b: _measured(b, *both), _COUNTS).collect()
    fit.sort(key=lambda r: (r["toxic"], r["counts"]))
    counts = np.array([r["counts"] for r in fit], np.float64).reshape(-1, 1 + len(THRESHOLDS))
    model = Model(*both, Logistic.fitted(counts, np.array([r["toxic"] for r in fit], np.float64)))
    dropped(rows)
    return model


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, n_windows and predicted of every document."""
    model = model or learned(docs, labels)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(remainder(doc_id) == HELD, F.lit(False)).alias("held_out"), "text")
    out = rows.mapInArrow(lambda b: _scored(b, model), "doc_id long, held_out boolean, score double, n_windows long")
    return out.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))
