"""Batches of chips in an order drawn anew each epoch, by keyed permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeloom.operators.permutation import place
from cubeloom.plans.cube import CHIP, WIDTH, height
from cubeloom.plans.queries import chip_grid

col = F.col
BATCH, EPOCHS = 8, 3


def shuffled_batches(s, d):
    """``epoch, batch, slot, ci, cj``: every chip once an epoch. A worker that knows its batch numbers needs no other chip's."""
    n = F.floor(col("height") / CHIP).cast("long") * (WIDTH // CHIP)
    x = chip_grid(s, d).select("ci", "cj", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch")).crossJoin(F.broadcast(height(s, d)))
    x = x.withColumn("place", place(col("ci") * (WIDTH // CHIP) + col("cj"), n, col("epoch")))
    return x.select("epoch", F.expr(f"place div {BATCH}").alias("batch"), (col("place") % BATCH).alias("slot"), "ci", "cj")


def shuffled_pixels(s, d):
    """``pid, place``: all numbers of pixels up to the largest, shuffled; a number's place is known without the others."""
    n = height(s, d).select((col("height") * WIDTH).alias("n"))
    x = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), col("n") - 1)).alias("pid"))
    return x.select("pid", place(col("pid"), col("n"), F.lit(42)).alias("place"))


PLAIN = [shuffled_batches, shuffled_pixels]
QUERIES = {f.__name__: f for f in PLAIN}
