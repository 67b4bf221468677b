"""Build of the labelled sample index from land cover and burn layers, all tiles and months at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import scalars as s
from pixelmill.operators import layers, ranks, sampling

LAYER = ("v", "h", "year", "month")
PIXEL = (*LAYER, "i", "j")


class SampleIndex(NamedTuple):
    samples: DataFrame
    stats: DataFrame


def build(lct: DataFrame, burn: DataFrame, *, drop_ratio: float = 0.0, seed: int = 0, max_uncertainty: int = 1,
          legacy_qa: bool = False, **land_cover) -> SampleIndex:
    """``burn`` has burn_date, uncertainty, first_day, last_day and qa per cell and month.

    Undersampling and quality act through flags, so one pass gives the statistics before and after.
    """
    stable = layers.stable_land_cover(lct, seed=seed, **land_cover)
    labelled = layers.burn_quality(layers.attach_burn_layers(stable, burn), max_uncertainty) \
        .withColumn("fire", F.col("burn_date") > 0)
    drawn = ranks.unit_hash([F.col(k) for k in PIXEL], seed) >= drop_ratio
    flagged = labelled.withColumn("_kept", (F.col("fire") | drawn) & s.qa_ok(F.col("qa"), legacy_qa))
    samples = sampling.assign_sample_day(flagged.filter("_kept"), PIXEL, seed + 1).select(
        "v", "h", F.col("i").alias("i2"), F.col("j").alias("j2"), "year", "month", "yday", "lct", "fire")
    before = layers.burn_stats(labelled, LAYER)
    after = layers.burn_stats(samples, LAYER, suffix="_us")
    stats = before.join(after, list(LAYER), "left").na.fill(0, ["n_pos_us", "N_us"])
    return SampleIndex(samples.drop("month"), stats)
