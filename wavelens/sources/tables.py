"""Signals read from tables: samples, spectra and vectors in canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, i, v, x): the value series of every user in time order, raw and centred.

    One row a sample, so the length of a signal is not bounded by a row; everything by signal follows the one shuffle by user.
    """
    by = Window.partitionBy("user_id")
    order = by.orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("signal_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("v"), (F.col("value") - F.avg("value").over(by)).alias("x"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, v): each user's values as one ordered array, by a single shuffle; for operators on whole short signals."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("signal_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select("signal_id", F.transform("e", lambda s: s["value"]).alias("v"))


def exploded(signals: DataFrame) -> DataFrame:
    """(signal_id, i, v, x) of signals held as arrays (signal_id, v); an empty array has no rows."""
    s = signals.select("signal_id", F.posexplode("v").alias("i", "v"))
    return s.select("signal_id", F.col("i").cast("long").alias("i"), "v", (F.col("v") - F.avg("v").over(Window.partitionBy("signal_id"))).alias("x"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, frame, m): magnitude spectra as arrays, one row a frame."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("signal_id"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("m"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, v): vectors in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
