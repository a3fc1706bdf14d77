"""Rules of records as columns, and constraints as queries that return the rows that break them.

Defined results: a null value breaks length and email rules. Null keys are no duplicates and null foreign keys no orphans, as
in SQL. Rows that repeat are counted or returned as often as they are there. Empty tables break nothing. Of JSON bodies, null
is a missing body, what is no JSON object is one error at the body, and a JSON null is a missing field; text after the
object's end isn't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import free


def length_rule(name: str, column: Column, least: int, most: int) -> Column:
    bad = column.isNull() | (F.length(column) < least) | (F.length(column) > most)
    return F.when(bad, F.lit(name))


def email_rule(name: str, column: Column) -> Column:
    return F.when(~F.coalesce(column.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False)), F.lit(name))


def violations(*rules: Column) -> Column:
    """The names of broken rules, in order."""
    return F.array_compact(F.array(*rules))


def not_unique(df: DataFrame, key: Column) -> DataFrame:
    return df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def without_parent(df: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    key = free(df, "_pk")
    return df.where(F.col(fk).isNotNull()).join(parents.select(F.col(pk).alias(key)).distinct(), F.col(fk) == F.col(key), "left_anti")


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


@dataclass(frozen=True)
class Field:
    """A field of a JSON body. path has one dot at most; a field within an object that is missing is missing only if the
    object itself is required. least and most bound a whole number, or a text's length."""

    path: str
    kind: str = "string"
    required: bool = True
    least: int | None = None
    most: int | None = None


def checked(df: DataFrame, body: str, fields: list[Field], parsed: str = "parsed", errors: str = "errors") -> DataFrame:
    """Adds, in one pass over good and bad rows alike, the typed fields of a JSON body, and what is wrong with it: an array
    of (place, msg) in the order of the fields. Fields that are wrong are null in `parsed`."""
    text, plain = F.col(body), "map<string,string>"
    top = F.from_json(text, plain)
    whole = F.when(text.isNull(), F.lit("Field required")).when(top.isNull() | ~F.ltrim(text).startswith("{"), F.lit("JSON decode error"))
    found, values = [F.when(whole.isNotNull(), F.struct(F.lit("body").alias("place"), whole.alias("msg")))], []
    for x in fields:
        outer, dot, inner = x.path.partition(".")
        value = F.from_json(top[outer], plain)[inner] if dot else top[x.path]
        missing = value.isNull() & (top[outer].isNotNull() if dot and not x.required else F.lit(x.required))
        number = F.when(F.trim(value).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(value).cast("long"))
        size = number if x.kind == "int" else F.length(value)
        said = F.when(missing, "Field required")
        if x.kind == "int":
            said = said.when(value.isNotNull() & number.isNull(), "Input should be a valid integer")
        for limit, over, words in ((x.least, lambda v, k: v < k, ("greater than or equal to", "at least")), (x.most, lambda v, k: v > k, ("less than or equal to", "at most"))):
            if limit is not None:
                said = said.when(over(size, limit), f"Input should be {words[0]} {limit}" if x.kind == "int" else f"String should have {words[1]} {limit} characters")
        found.append(F.when(whole.isNull() & said.isNotNull(), F.struct(F.lit(f"body.{x.path}").alias("place"), said.alias("msg"))))
        values.append(F.when(whole.isNull() & said.isNull(), number if x.kind == "int" else value).alias(x.path.replace(".", "_")))
    return df.withColumns({parsed: F.struct(*values), errors: F.array_compact(F.array(*found))})


def accepted(df: DataFrame, errors: str = "errors") -> DataFrame:
    """The rows of `checked` without errors."""
    return df.where(F.size(errors) == 0).drop(errors)


def refused(df: DataFrame, errors: str = "errors") -> DataFrame:
    """The rows of `checked` with errors, one row for each."""
    return df.withColumn(errors, F.explode(errors))
