"""Texts in pieces that a model takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import let


def chunks(text: Column, limit: int) -> Column:
    """Chunks for a model: at most limit characters, back to the last line break in the window, which then begins the next chunk."""

    def step(acc: Column, _: Column) -> Column:
        def one(head: Column) -> Column:
            back = F.position(F.lit("\n"), F.reverse(head))
            at = F.length(head) - back
            size = F.when((F.length(text) - acc["at"] > limit) & (back > 0) & (at > 0), at).otherwise(F.length(head))
            made = F.struct(acc["at"].alias("start"), F.substring(head, F.lit(1), size).alias("chunk"))
            return F.struct((acc["at"] + size).cast("int").alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

        return F.when(acc["at"] < F.length(text), let(F.substring(text, acc["at"] + 1, F.lit(limit)), one)).otherwise(acc)

    # a chunk is cut at the last line break of its window, so it and the next one hold limit characters together
    rounds = F.sequence(F.lit(1), 2 * F.ceil(F.length(text) / limit).cast("int") + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chunk:string>>").alias("out"))
    return F.aggregate(rounds, start, step, lambda acc: acc["out"])
