"""Quality rules as a bitmask ledger.

measured() takes every measurement once, ledger() evaluates every rule once and stores one
failure bit per rule beside the measurements, judged() applies a versioned policy (a mask over
the bits) and ablations() counts, from the bits alone, what each rule of a policy costs.
There is no shuffle but the partial counts of ablations(): a text never leaves its row.

Defined cases. A null or empty text has no words, so all its counts are 0 and it fails the
length rule. Rows are judged one by one: repeated rows and ties get equal verdicts and a null
doc_id is kept as it is. An empty table gives an empty ledger. Columns of the input whose names
equal a measurement's are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeloom.llm.text import BLANKS, fenced, nested, total, trimmed, unnested, whole, without, words_of_trimmed

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


@dataclass(frozen=True)
class Rule:
    """A rule fails where the SQL condition over the measurements is true."""

    name: str
    fails: str


#: A rule's place is its bit. Rules are only ever added at the end: stored ledgers stay readable.
RULES = (
    Rule("short", "n_words < 50"),
    Rule("repetitive", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("exclaiming", "2 * n_exclaims > n_words"),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = ("short", "repetitive")
#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "duplicate_lines"),
    "web-2": tuple(BITS),
}
PRODUCTION = "web-2"


def mask_of(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text.

    Repeated three-word windows are found inside the row: window hashes are sorted beside their
    places, neighbours with equal hashes give the repeated places, and the gaps between those
    places give the number of words that they cover.
    """
    none = F.array().cast("array<bigint>")
    out = nested(docs, whole(F.col(text)).alias("_text"), trimmed(F.col(text)).alias("_trim"))
    out = out.withColumn("_words", words_of_trimmed(F.col("_trim")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_hashes", F.when(F.size("_words") >= 3, windows).otherwise(none))
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    unique = F.size(F.array_distinct("_hashes")) == F.size("_hashes")
    out = out.withColumn("_placed", F.when(unique, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(placed))
    same = lambda x, k: F.coalesce(F.get("_placed", k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("_placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - i, F.lit(3))))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    out = out.withColumn("_lines", lines)
    out = out.withColumns(
        {
            "word_chars": F.length(without(F.col("_trim"), BLANKS)).cast("long"),
            "n_symbols": (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": total(covered),
            "n_exclaims": (F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!"), F.lit("")))).cast("long"),
        }
    ).drop("_text", "_trim", "_words", "_hashes", "_placed", "_at", "_lines")
    return unnested(fenced(out, *MEASURES), docs.columns, *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements and fail_bits, one bit for each rule."""
    bits = [F.when(F.expr(rule.fails), F.lit(BITS[rule.name])).otherwise(F.lit(0)) for rule in RULES]
    sum_of = bits[0]
    for bit in bits[1:]:
        sum_of = sum_of.bitwiseOR(bit)
    return measured(docs, text).withColumn("fail_bits", sum_of.cast("long"))


def rejected(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask_of(policy))) != 0


def judged(of: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Add base_failed and kept; a policy is applied to stored bits, without the texts."""
    base = rejected(F.col("fail_bits"), "base-1")
    return of.withColumns({"base_failed": base, "kept": ~base & ~rejected(F.col("fail_bits"), policy)})


def ablations(of: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects (kept without it).

    One pass over the bits; any_bits and all_bits say which rules some or all rows fail.
    """
    mask = F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)))
    counts = [F.count("*").alias("n_rows"), F.bit_or(mask).alias("any_bits"), F.bit_and(mask).alias("all_bits")]
    for name in POLICIES[policy]:
        counts.append(F.count_if(mask.bitwiseAND(F.lit(BITS[name])) != 0).alias(f"fails_{name}"))
        counts.append(F.count_if(mask == F.lit(BITS[name])).alias(f"alone_{name}"))
    rules = [F.struct(F.lit(n).alias("rule"), F.col(f"fails_{n}").alias("n_failed"), F.col(f"alone_{n}").alias("n_only")) for n in POLICIES[policy]]
    one = of.agg(*counts)
    return one.select(F.lit(policy).alias("policy"), "n_rows", "any_bits", "all_bits", F.explode(F.array(*rules)).alias("r")).select("policy", "n_rows", "any_bits", "all_bits", "r.*")
