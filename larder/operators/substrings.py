"""Substring search by grams: which texts of a scope hold a query's text, without holding every query against every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def grams(text: Column, n: int) -> Column:
    """The distinct pieces of n characters."""
    # the text is bound by a lambda, so that it is evaluated once a row and not for every piece
    places = lambda t: F.sequence(F.lit(1), F.length(t) - n + 1)
    every = F.transform(F.array(text), lambda t: F.when(F.length(t) >= n, F.array_distinct(F.transform(places(t), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>")))
    return F.get(every, F.lit(0))


def postings(texts: DataFrame, scope: str, text: str) -> DataFrame:
    """(scope, text, gram): a row of each piece of one to LONGEST characters that a text holds, in lower case."""
    low = F.lower(F.col(text))
    every = F.concat(*[grams(low, n) for n in range(1, LONGEST + 1)])
    return texts.select(scope, text).distinct().select(scope, text, F.explode(every).alias("gram"))


def holding(queries: DataFrame, posted: DataFrame, scope: str, text: str, q: str) -> DataFrame:
    """(scope, q, text) of the texts of the query's scope that hold q, ignoring case. Empty queries and null scopes meet none.

    A query is looked up by the rarest of its pieces of LONGEST characters in its scope, and only what is posted there is compared; one with
    a piece that no text has is dropped. A shorter query is itself a posted piece. So a query meets the texts
    that share its rarest piece, not all of its scope; the pieces of a hot scope lie in as many partitions as there are pieces.
    """
    asked = queries.where((F.col(q) != "") & F.col(scope).isNotNull()).select(scope, q).distinct()
    low = F.lower(F.col(q))
    pieces = F.when(F.length(low) >= LONGEST, grams(low, LONGEST)).otherwise(F.array(low))
    counts = posted.groupBy(scope, "gram").agg(F.count("*").alias("n"))
    # unknown pieces stay, without a count: the planner would take a number of pieces beside them anew for every piece
    looked = asked.select(scope, q, F.explode(pieces).alias("gram")).join(counts, [scope, "gram"], "left")
    rarest = looked.groupBy(scope, q).agg(F.min(F.struct("n", "gram")).alias("r"), F.count("n").alias("known"), F.count("*").alias("pieces")).where("known = pieces")
    near = rarest.select(scope, q, F.col("r.gram").alias("gram")).join(posted, [scope, "gram"])
    return near.where(F.contains(F.lower(F.col(text)), F.lower(F.col(q)))).select(scope, q, text)
