"""Fill-in-the-middle against a plain version, and toxicity on texts with planted insults."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeloom.llm import fim, toxicity

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "one", "a", "é", "😀b😀", "a<P>b", "x <S> y", "<M>", "<P<S<M>", "<", "<<P", ">S<", "line\nline\r\n\n two", "7" * 300, "word " * 40_000, "a" * 200_000, "Ünï çödé wörds", "\x00\x01 nul", "tab\tand\x0bmore", "one", "two words"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(10_000 + k, t, "en", "src1" if k % 3 else None, 0) for k, t in enumerate(TEXTS)] + [(20_000, "a repeated row of some words", "en", "src2", 0)] * 2 + [(None, "a text without an id", None, None, None), (10_003, "another text of an id", "en", "s", 1)]
    return table.unionByName(spark.createDataFrame(rows, table.schema)).withColumns({"row": F.lit("x"), "n": F.lit(-1), "place": F.lit(0), "toxic": F.lit(9), "n chars": F.lit(1)}).cache()


def cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_a_plain_version(docs):
    made = fim.transformed(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr)
    want = sorted(((r.doc_id, *cut(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert got == want
    assert all(r.back == (r.text or "") for r in made)
    assert {r["row"] for r in made} == {"x"} and {r["n chars"] for r in made} == {1}
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_no_rows(docs):
    assert fim.transformed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["ab cd", "<a>", "<", "P>S>", "a<b<c<d", "<P S> <M"])
def test_every_cut_can_be_undone(spark, text):
    rows = spark.createDataFrame([(k, text) for k in range(300)], "doc_id long, text string")
    made = fim.transformed(rows).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert made.filter(F.col("back") != text).count() == 0
    assert made.select("prefix_chars", "middle_chars").distinct().count() > 3


SYLLABLES = "an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
INSULTS = ("grobnik", "flenzard", "zwutsch", "krakpot")


def written_text(rnd, insults=0, words=60):
    out = ["".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 4))) for _ in range(words)]
    for _ in range(insults):
        out[rnd.randrange(words)] = rnd.choice(INSULTS)
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    rows = [(k, written_text(rnd, 5 if k % 8 == 0 else 0), int(k % 8 == 0)) for k in range(1600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").cache()
    return docs, spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int").cache()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_insults_are_caught_and_clean_texts_left_alone(spark, corpus):
    docs, labels = corpus
    model = toxicity.learned(docs, labels)
    assert all(w.encode() in model.toxic for w in INSULTS)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels, model).collect()}
    of = [(i, r) for i, r in got.items() if r.held_out]
    assert len(of) > 300 and all(held(i) for i, _ in of)
    assert np.mean([r.predicted for i, r in of if i % 8 == 0]) > 0.95
    assert np.mean([r.predicted for i, r in of if i % 8]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    odd = [(-1, None), (-2, ""), (None, written_text(random.Random(1), 6)), (-3, "x" * 100_000), (-4, written_text(random.Random(2), 0, 20_000)), (-5, written_text(random.Random(3), 0, 20_000) + " grobnik zwutsch" * 30)]
    rows = toxicity.scored(spark.createDataFrame([(*r, 7, "s") for r in odd], "doc_id long, text string, score int, toxic string"), labels, model).collect()
    by = {r.doc_id: r for r in rows}
    assert by[-1].score == by[-2].score < 0.3 and by[-1].n_windows == 0
    assert by[None].predicted == 1 and by[None].held_out is False
    assert [by[k].predicted for k in (-3, -4, -5)] == [0, 0, 1]
    assert toxicity.scored(docs.limit(0), labels, model).count() == 0


def test_held_labels_and_other_columns_are_never_read(corpus):
    docs, labels = corpus
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    noise = wrong.unionByName(wrong.limit(3).withColumn("toxic", F.lit(None).cast("int"))).unionByName(wrong.limit(2).withColumn("doc_id", F.lit(10**9)))
    a = toxicity.scored(docs, labels).orderBy("doc_id").collect()
    b = toxicity.scored(docs.withColumns({"lang": F.lit("xx"), "source": F.col("doc_id") % 3}), noise).orderBy("doc_id").collect()
    assert a == b


def test_without_labels_of_one_class(corpus):
    docs, labels = corpus
    few = docs.limit(20)
    for some in (labels.limit(0), labels.filter("toxic = 0").limit(50)):
        scores = {r.score for r in toxicity.scored(few, some).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 0.5


def test_windows_that_are_not_compressed_have_no_distance():
    rnd = random.Random(3)
    toxic, ordinary = b" grobnik flenzard zwutsch", b" the andre of stion ing heather"
    d = toxicity.Distance(toxic, ordinary)
    for k in range(60):
        text = written_text(rnd, k % 4, rnd.randint(1, 90)) + ("é" * (k % 3) + "<x>" * (k % 5))
        each = [d.of(w) for w in toxicity.windows(toxicity.normal(text))]
        assert d.measured(text) == [len(each), *[sum(x >= t for x in each) for t in toxicity.THRESHOLDS]]


def test_copies_do_not_make_a_segment():
    rnd = random.Random(9)
    copied = written_text(rnd, 0, 80).encode()
    toxic = [copied] * 50 + [toxicity.normal(written_text(rnd, 4)) for _ in range(60)]
    ordinary = [toxicity.normal(written_text(rnd)) for _ in range(400)]
    found = toxicity.segments(toxic, ordinary)
    assert all(any(w.encode()[:5] in s or s.strip() in w.encode() for s in found) for w in INSULTS)
    assert not [s for s in found if len(s) > 7 and s in copied]


def test_held_out_accuracy_on_the_given_labels(spark):
    """On the smallest table with enough labels; the README has the figures of larger ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.6
    assert np.mean([r.predicted for r in rows if not r.toxic]) <= 0.03
