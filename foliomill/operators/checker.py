"""Reports of an external package checker: read from JSON, compared before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as T

MESSAGES = "messages array<struct<ID:string,severity:string,message:string,locations:array<struct<path:string,line:int>>>>"


def messages(reports: DataFrame) -> DataFrame:
    """(book_id, severity, id, path, line, message) of (book_id, json) reports; only the first location counts.

    A report that is no JSON gives no rows.
    """
    rows = reports.select("book_id", F.explode(F.from_json("json", MESSAGES)["messages"]).alias("m"))
    first = F.try_element_at("m.locations", F.lit(1))
    return rows.select("book_id", "m.severity", F.col("m.ID").alias("id"), first["path"].alias("path"), first["line"].alias("line"), F.coalesce("m.message", F.lit("")).alias("message"))


def new_problems(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book_id, new_errors, new_warnings, preexisting, fixed): messages compared by id and text, places aside."""
    key = ["book_id", "id", "k"]
    b = before.withColumn("k", T.message_key(F.col("message")))
    a = after.withColumn("k", T.message_key(F.col("message")))
    added = a.join(b.select(*key).distinct(), key, "left_anti").groupBy("book_id").agg(F.count_if(F.col("severity").isin("ERROR", "FATAL")).alias("new_errors"), F.count_if(F.col("severity") == "WARNING").alias("new_warnings"))
    fixed = b.join(a.select(*key).distinct(), key, "left_anti").groupBy("book_id").agg(F.count("*").alias("fixed"))
    known = b.groupBy("book_id").agg(F.count("*").alias("preexisting"))
    books = a.select("book_id").union(b.select("book_id")).distinct()
    return books.join(added, "book_id", "left").join(known, "book_id", "left").join(fixed, "book_id", "left").na.fill(0)
