"""Texts that are inside other texts, met on their rarest q-gram.

A text that holds another holds all of its q-grams. Each sought text asks for the one of its q-grams that the fewest texts of its block
hold; texts with a q-gram that none holds are out at once. What meets there is verified by the texts themselves, so that the result is that
of all pairs, while a pair costs only where a rare q-gram is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, size)))


def contained(sought: DataFrame, texts: DataFrame, q: int = 4) -> DataFrame:
    """(id, id2) of the rows of both sides (id, block, text) with the same block where the second's text holds the first's. Null or empty texts,
    and rows without block, are in no pair; equal texts hold each other. Sought texts shorter than ``q`` are their own gram."""
    s = sought.where("block IS NOT NULL AND length(text) > 0").select("id", "block", F.col("text").alias("_s"))
    t = texts.where("block IS NOT NULL AND length(text) > 0").select(F.col("id").alias("id2"), "block", F.col("text").alias("_t"))
    shortest = min(s.agg(F.min(F.length("_s"))).first()[0] or q, q)
    sizes = F.filter(F.array(*[F.lit(k) for k in range(shortest, q + 1)]), lambda k: k <= F.length("_t"))
    held = t.withColumn("gram", F.explode(F.flatten(F.transform(sizes, lambda k: _grams(F.col("_t"), k)))))
    df = held.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("df"))
    own = s.withColumn("grams", _grams(F.col("_s"), F.least(F.length("_s"), F.lit(q))))
    told = own.select("id", "block", "_s", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(df, ["block", "gram"])
    rare = told.groupBy("id", "block", "_s", "n").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "gram")).alias("x")).where("found = n")
    met = rare.select("id", "block", "_s", F.col("x.gram").alias("gram")).join(held, ["block", "gram"])
    return met.where(F.col("_t").contains(F.col("_s"))).select("id", "id2").distinct()
