"""Column helpers shared by the operators: white space, words, ASCII lower case, binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"  # the characters \x20 and \x09-\x0D
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. lower() does the same on pure ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text without nulls, in order; an array with one empty string if there are none."""
    return F.split(F.btrim(text, F.lit(SPACES)), SPACE_CLASS + "+", -1)


def shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that further columns of any name cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
