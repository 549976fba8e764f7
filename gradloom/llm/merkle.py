"""Duplicates hidden by formatting: bottom-up digests of nested records (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Everything but letters, digits and marks, save a minus sign before a number and a decimal point
#: before a digit; and marks and letters that are invisible.
_NOISE = (
    r"(?!(?<![\p{L}\p{N}])-(?=\.?\p{Nd}))(?!(?<!\p{L})\.(?=\p{Nd}))[^\p{L}\p{N}\p{M}]"
    r"|[︀-️͏ᅟᅠㅤ]"
)


def normal_leaf(text: Column) -> Column:
    """Text without letter case, punctuation, white space and invisible characters; null stays null."""
    return F.regexp_replace(F.lower(F.translate(text, "−", "-")), _NOISE, "")


def normal_form(value: Column, kind: T.DataType) -> Column:
    """The value with every string leaf in its normal form and the fields of every object in name order."""
    if isinstance(kind, T.StringType):
        return normal_leaf(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normal_form(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[normal_form(value[f.name], f.dataType).alias(f.name) for f in fields]))
    return value


def node_digest(value: Column, kind: T.DataType) -> Column:
    """Digest of a normal form, from the leaves up.

    An array hashes its children's digests in their order; an object sorts the digests of its
    named children first, so the order of fields is of no account. Null has a digest of its own.
    """
    if isinstance(kind, T.ArrayType):
        children = F.transform(value, lambda x: node_digest(x, kind.elementType))
        found = F.sha2(F.concat(F.lit("a"), F.array_join(children, ",")), 256)
    elif isinstance(kind, T.StructType):
        named = [F.sha2(F.concat(F.lit(f.name + "="), node_digest(value[f.name], f.dataType)), 256) for f in kind.fields]
        found = F.sha2(F.concat(F.lit("o"), F.array_join(F.sort_array(F.array(*named)), ",")), 256)
    else:
        found = F.sha2(F.concat(F.lit("s"), value.cast("string")), 256)
    return F.when(value.isNull(), F.sha2(F.lit("null"), 256)).otherwise(found)


def with_root(records: DataFrame, column: str) -> DataFrame:
    """Adds ``_form``, the record's normal form, and ``_root``, its digest."""
    formed = records.withColumn("_form", normal_form(F.col(column), records.schema[column].dataType))
    return formed.withColumn("_root", node_digest(F.col("_form"), formed.schema["_form"].dataType))


def collapse(records: DataFrame, column: str, row_id: str) -> DataFrame:
    """One row for each record that is the same but for looks: ``_root, _form, first_row, copies``.

    Rows are grouped by the root digest together with the whole normal form, which is the full
    structural comparison: two records that met in a digest alone would stay apart. Partial
    aggregation shrinks a record that holds a third of all rows before the shuffle. Nulls equal nulls.
    """
    return with_root(records, column).groupBy("_root", "_form").agg(F.min(row_id).alias("first_row"), F.count("*").alias("copies"))


def surplus_copies(records: DataFrame, column: str, row_id: str) -> DataFrame:
    """``first_row, row``: every copy but the first of each record that has copies.

    Every record is normalised and digested once, and written. Digests alone, without the forms, are counted; only the rows of a digest
    that occurs twice are compared in full. The join's side of heads holds one row for each record with copies; a hot record's
    rows are many on the other side only, where adaptive execution splits them.
    """
    formed = with_root(records.select(row_id, column), column)
    rows = materialise(formed.select(F.col(row_id).alias("row"), F.unhex("_root").alias("root"), F.col("_form").alias("form")), "merkle-rows")
    twice = rows.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    suspects = rows.join(twice, "root", "left_semi")
    heads = suspects.groupBy("root", "form").agg(F.min("row").alias("first_row"), F.count("*").alias("copies")).filter("copies > 1")
    heads = heads.select(F.col("root").alias("_r"), F.col("form").alias("_f"), "first_row")
    same = (F.col("root") == F.col("_r")) & F.col("form").eqNullSafe(F.col("_f"))
    return rows.join(heads, same).filter("row <> first_row").select("first_row", "row")
