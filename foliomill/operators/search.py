"""Books found by path, file name or words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as T

#: Letters of a word by which stems are looked up.
GRAM = 3


def search_form(text: Column) -> Column:
    """Folded text with blanks, points, dashes and underscores as single blanks."""
    return F.trim(F.regexp_replace(T.ascii_fold(text), r"[ \t\n\r\f_.-]+", " "))


def found_books(books: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, nth, book_id) of books (book_id, path) and queries (asked, nth, q).

    The first that gives anything: the very path, the file name (in any case,
    with or without its suffix), all the query's words in the stem.  Words are
    looked up by an equi-join on the first letters of the longest one, which
    stand somewhere in every stem that holds it, and then tested.
    """
    name = F.lower(F.regexp_replace("path", "^.*/", ""))
    stems = books.filter(F.lower("path").endswith(".epub")).select("book_id", "path", name.alias("name"), search_form(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "[.][^.]*$", "")).alias("stem"))
    queries = asked.filter("q is not null").select("asked", "nth", "q")
    path = queries.join(stems, queries.q == stems.path).select("asked", "nth", "book_id")
    low = queries.join(path, ["asked", "nth"], "left_anti")
    exact = low.select("asked", "nth", F.explode(F.array(F.lower("q"), F.concat(F.lower("q"), F.lit(".epub")))).alias("name")).join(stems, "name").select("asked", "nth", "book_id").distinct()
    rest = low.join(exact, ["asked", "nth"], "left_anti").withColumn("words", F.filter(F.split(search_form(F.col("q")), " "), lambda w: w != "")).filter("size(words) > 0")
    longest = F.element_at(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    rest = rest.withColumn("gram", F.left(longest, F.lit(GRAM)))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(F.col("stem"), i, n)))))
    parts = stems.filter("stem <> ''").select("book_id", "stem", F.explode(grams).alias("gram"))
    words = rest.join(parts, "gram").filter(F.forall("words", lambda w: F.contains(F.col("stem"), w))).select("asked", "nth", "book_id")
    return path.unionByName(exact).unionByName(words)
