"""Column expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """A text with null read as empty."""
    return F.coalesce(text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(whole(text), F.lit(BLANKS))


def words_of_trimmed(text: Column) -> Column:
    """The words of a text that trimmed() made; no words for an empty one."""
    none = F.array().cast("array<string>")
    return F.when(text == "", none).otherwise(F.split(text, BLANK_RUN))


def n_words(text: Column) -> Column:
    return F.size(words_of_trimmed(trimmed(text))).cast("long")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def total(array: Column) -> Column:
    """Sum of an array of whole numbers."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """df, with its columns of these names computed once and out of the optimizer's reach.

    A later filter on them would else be pushed below the projections that make them, with every
    intermediate array put in place of its name, also inside lambdas that run once an element.
    Generating one row from a one-element array ends that.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_fenced")).select(*rest, "_fenced.*")


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once: the optimizer does not look into an array's element,
    while a column of a name would be put in place of that name, also where it stands in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nested(df: DataFrame, *more: Column) -> DataFrame:
    """df's columns as one struct _doc beside others, so that no name of theirs can clash."""
    every = F.struct(*[df[f"`{c}`"] for c in df.columns]) if df.columns else F.struct(F.lit(1))
    return df.select(every.alias("_doc"), *more)


def unnested(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns that nested() put away, but for those that `more` names again, and those."""
    return df.select(*[F.col("_doc")[c].alias(c) for c in columns if c not in more], *more)
