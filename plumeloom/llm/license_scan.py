"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance by directory.

What is compared with the templates are a text's sentences, lines and blocks (runs of lines without
an empty one), each as a sparse TF-IDF vector: a header or a notice is a block, a statement inside
prose a sentence. Document frequencies of all words come from all documents; a word's weight is
1 - ln(max(share of documents with it, RAREST)), so weights do not drift as a corpus grows, times
1 + ln(how often the text has it).

A unit can reach COSINE with a template only if the words that they share make up COSINE of the
template's length (by Cauchy and Schwarz). So it holds one of the template's anchors: its heaviest
words, as many as leave the rest under COSINE. Texts and units without an anchor, and then units that
share too little with every template, are left out, which is exact. Equal units are scored once:
their words, weights and products with the templates are rows that are joined and summed.

The best template of a document, at COSINE or more, is its own license. A document is a license file
if its file name is that of one, or if half of its words stand in such units of one kind, a unit's
words counted by its squared cosine; it licenses its directory. Documents without a license of their own take that of the nearest directory above
them that has one: the distinct directories are joined by path with the license files of their
ancestors, and documents are joined with their directory.

Defined cases. A null or empty text has no license of its own and may inherit. Repeated rows get
the same license; rows of one id with other texts are documents of their own. Of several license
files in a directory the best cosine counts, then the license's name. Equal cosines of a document go
to the first name. An empty table gives no rows. Paths begin with "/"; a null path is "/", which is
its own directory. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeloom.llm.joins import looked_up
from plumeloom.llm.license_texts import TEMPLATES
from plumeloom.llm.text import whole
from plumeloom.plans.storage import dropped, written

#: Possessive: a long run of parts takes no stack.
WORD = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
FILE_NAME = r"(?i)^(license|licence|copying|unlicense)(\.(txt|md|rst))?$"
SENTENCE_END = r"(?<=[.!?;])[\x20\t]++"
EMPTY_LINE = r"\n(?:[\x20\t\r]*+\n)++"
COSINE = 0.6
#: Words in a smaller share of the documents weigh no more.
RAREST = 1e-3
KINDS = ("sentence", "line", "block")


def path_of() -> Column:
    """Documents carry no path: their source and language are their directories."""
    part = lambda c: F.coalesce(F.replace(F.col(c), F.lit("/"), F.lit("_")), F.lit("_"))
    return F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def weight(share: float) -> float:
    return 1.0 - math.log(max(share, RAREST))


class Templates:
    """The templates' vectors of length 1, and their anchors."""

    def __init__(self, share: dict[str, float]) -> None:
        self.vectors: list[tuple[str, dict[str, float]]] = []
        self.anchors: set[str] = set()
        for name, text in TEMPLATES:
            vector = {w: (1.0 + math.log(k)) * weight(share.get(w, 0.0)) for w, k in Counter(re.findall(WORD, text.lower())).items()}
            length = math.sqrt(sum(x * x for x in vector.values()))
            vector = {w: x / length for w, x in vector.items()}
            self.vectors.append((name, vector))
            rest = 1.0
            for w, x in sorted(vector.items(), key=lambda item: (-item[1], item[0])):
                if rest < COSINE**2 - 1e-9:
                    break
                self.anchors.add(w)
                rest -= x * x

    @staticmethod
    def vocabulary() -> list[str]:
        return sorted({w for _, text in TEMPLATES for w in re.findall(WORD, text.lower())})

    def rows(self) -> list[tuple]:
        return [(w, k, name, x) for k, (name, vector) in enumerate(self.vectors) for w, x in vector.items()]


def _fixed(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A fixed table, from expressions alone."""
    every = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names, strict=True)]) for row in rows])
    return F.broadcast(spark.range(1).select(F.inline(every)))


def shares(docs: DataFrame) -> DataFrame:
    """word and share (of all documents that hold it), but for words rarer than RAREST."""
    n = max(1, docs.count())
    seen = docs.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return written(seen.filter(F.col("df") > RAREST * n).select("word", (F.col("df") / n).alias("share")), "license-words")


def units(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """doc_id, path, of (the text's hash), doc_words, kind, at, key, words of each unit with an anchor."""
    known = F.array(*map(F.lit, anchors))
    rows = docs.select("doc_id", "path", "of", "text", words_of(F.col("text")).alias("_w")).filter(F.arrays_overlap("_w", known))
    lines = F.split("text", "\n")
    parts = {"sentence": F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_END))), "line": lines, "block": F.split("text", EMPTY_LINE)}
    named = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("unit"))
    every = F.concat(*[F.transform(parts[k], named(k)) for k in KINDS])
    out = rows.select("doc_id", "path", "of", F.size("_w").alias("doc_words"), F.explode(every).alias("u"))
    out = out.select("doc_id", "path", "of", "doc_words", "u.kind", "u.at", F.md5("u.unit").alias("key"), words_of(F.col("u.unit")).alias("words"))
    return out.filter(F.arrays_overlap("words", known))


def scored(texts: DataFrame, share: DataFrame, templates: Templates) -> DataFrame:
    """texts (key, words, one row a key) -> key, license and cosine of those at COSINE or more."""
    known = _fixed(texts.sparkSession, templates.rows(), ["word", "number", "license", "y"])
    vocabulary = F.array(*map(F.lit, Templates.vocabulary()))
    shared = texts.select("key", F.explode(F.array_intersect("words", vocabulary)).alias("word")).join(known, "word")
    enough = shared.groupBy("key", "number").agg(F.sum(F.col("y") * F.col("y")).alias("part")).filter(F.col("part") >= COSINE**2 - 1e-9)
    texts = texts.join(enough.select("key").distinct(), "key", "left_semi")
    tf = texts.select("key", F.explode("words").alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))
    rare = F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(RAREST))
    weighed = written(tf.join(share, "word", "left").select("key", "word", ((1.0 + F.log("tf")) * (1.0 - F.log(rare))).alias("x")), "license-weights")
    length = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = weighed.join(known, "word").groupBy("key", "number", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("length"), 9)
    best = dots.join(length, "key").groupBy("key").agg(F.min(F.struct((-cosine).alias("minus"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("cosine")).filter(F.col("cosine") >= COSINE)


def _own(docs: DataFrame) -> DataFrame:
    """doc_id, path, of, license, cosine and is_file of the documents with a license of their own."""
    share = shares(docs)
    vocabulary = _fixed(docs.sparkSession, [(w,) for w in Templates.vocabulary()], ["word"])
    templates = Templates({r["word"]: r["share"] for r in share.join(vocabulary, "word").collect()})  # at most the vocabulary
    found = written(units(docs, sorted(templates.anchors)), "license-units")
    texts = found.groupBy("key").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    counts = texts.select("key", "n")
    best = written(scored(texts.select("key", "words"), share, templates).join(counts, "key"), "license-scores")
    keys = ["doc_id", "path", "of"]
    hits = looked_up(found.select(*keys, "doc_words", "kind", "at", "key", F.size("words").alias("n_words")), best, ["key"], "n")
    hits = hits.groupBy(*keys, "kind", "at").agg(F.max("n_words").alias("n_words"), F.max("doc_words").alias("doc_words"), F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("b"))  # repeated rows are one
    here = F.round(F.col("n_words") * F.pow("b.minus", F.lit(2)), 6)
    covered = F.greatest(*[F.coalesce(F.sum(F.when(F.col("kind") == k, here)), F.lit(0.0)) for k in KINDS])
    own = hits.groupBy(*keys).agg(F.min("b").alias("b"), covered.alias("covered"), F.max("doc_words").alias("doc_words"))
    is_file = (F.col("covered") * 2 >= F.col("doc_words")) | F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(FILE_NAME))
    own = written(own.select(*keys, F.col("b.license").alias("license"), (-F.col("b.minus")).alias("cosine"), is_file.alias("is_file")), "own-licenses")
    dropped(share, found, best)
    return own


def scan(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, license, cosine, found (own, file, inherited or none) and license_dir."""
    docs = docs.select("doc_id", F.coalesce(path, F.lit("/")).alias("path"), F.xxhash64("text").alias("of"), whole(F.col("text")).alias("text"))
    own = _own(docs)

    above = lambda p: F.regexp_replace(p, r"/[^/]*$", "")
    rows = written(docs.select("doc_id", "path", "of", above(F.col("path")).alias("dir")), "license-paths")
    files = own.filter("is_file").groupBy(above(F.col("path")).alias("license_dir")).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("f"))
    dirs = rows.groupBy("dir").agg(F.count("*").alias("n"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("license_dir")))
    paths = dirs.select("dir", "n", F.explode(ancestors).alias("a")).select("dir", "n", "a.*")
    met = F.when(F.col("f").isNotNull(), F.struct("depth", "license_dir", "f"))
    nearest = paths.join(files, "license_dir", "left").groupBy("dir").agg(F.max("n").alias("n"), F.max(met).alias("m"))
    nearest = written(nearest.select("dir", "n", "m.license_dir", "m.f"), "license-dirs")

    a, b = looked_up(rows, nearest, ["dir"], "n").alias("a"), own.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.path") == F.col("b.path")) & (F.col("a.of") == F.col("b.of"))
    out = a.join(b, same, "left").select("a.*", "license", "cosine", "is_file")
    found = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "own").when(F.col("f").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "f.license").alias("license"), F.coalesce("cosine", -F.col("f.minus")).alias("cosine"), found.alias("found"), F.when(F.col("license").isNull(), F.col("license_dir")).alias("license_dir"))
