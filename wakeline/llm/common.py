"""Small column helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The six white-space characters \x20 and \x09 to \x0D.
BLANKS = "\t\n\x0b\x0c\r"
NOT_BLANK = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def upto(n: Column, step: int = 1) -> Column:
    """[0, step, ...] below ``n``; empty for n <= 0."""
    empty = F.array().cast("array<int>")
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(step))).otherwise(empty)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def lower_az(text: Column) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def body(column: str = "text") -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart: the id and a hash of the text.

    Struct keys compare null ids as equal. Rows with one id and one text are the same document, and
    each of them gets that document's result.
    """
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(body(text)).alias("th"))


def salted(small: DataFrame, salts: int) -> DataFrame:
    """``small`` once for each value of ``salt``, so that one hot key on the other side meets it in many tasks."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def without(items: Column, dropped: Column) -> Column:
    """``items`` without those at the positions ``dropped`` (null: none)."""
    none = F.array().cast("array<int>")
    left = F.array_except(upto(F.size(items)), F.coalesce(dropped, none))
    return let(items, lambda a: F.transform(left, lambda i: a[i]))
