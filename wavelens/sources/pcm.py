"""Audio bytes to samples: raw little-endian doubles and WAV files as sources, probe metadata, and what is known of codecs."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of containers and codecs, and the MIME type of each codec that has one.
FORMATS = ("mp3", "aac", "flac", "wav", "ogg", "m4a", "wma", "opus", "aiff", "au", "ac3", "dts", "amr", "ra", "hls")
CODEC_TYPES = {"aac": "audio/aac", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "opus": "audio/opus"}


def codec_type(codec: Column) -> Column:
    """MIME type of a codec's name."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CODEC_TYPES.items() for x in kv))[codec], F.lit("audio/unknown"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pcm_to_array(data: pd.Series) -> pd.Series:
    """Samples of f64le bytes; a trailing partial word is dropped, null stays null."""
    return data.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 8 * 8], "<f8").tolist())


def read_pcm(spark: SparkSession, path: str, sample_rate: int = 44100, channels: int = 1) -> DataFrame:
    """(url, sample_rate, channels, duration_s, pcm) of every raw file below a path."""
    raw = spark.read.format("binaryFile").load(path)
    out = raw.select(F.col("path").alias("url"), F.lit(sample_rate).alias("sample_rate"), F.lit(channels).alias("channels"), pcm_to_array("content").alias("pcm"))
    return out.withColumn("duration_s", F.size("pcm") / F.lit(channels * sample_rate))


def decode_wav(data: bytes, mono: bool = True) -> tuple[int, int, np.ndarray]:
    """Rate, channels and samples within -1 to 1 of a WAV file of 8 to 32 bits; several channels are averaged unless ``mono`` is off (then they stay interleaved)."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return rate, channels, x.reshape(-1, channels).mean(1) if mono and channels > 1 else x


def decode(files: DataFrame, content: str = "content", url: str = "path", block: int = 1 << 16) -> DataFrame:
    """(url, sample_rate, channels, block, start, pcm, error): the samples of WAV blobs in blocks, so that no row grows with a file's length.

    A blob that is no WAV file, or null, has one row with its error and no samples; an empty signal has one row without samples.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["url", "sample_rate", "channels", "block", "start", "pcm", "error"]
        for b in batches:
            for u, data in zip(b["url"], b["data"]):
                try:
                    rate, channels, x = decode_wav(bytes(data))
                except (wave.Error, EOFError, TypeError, ValueError) as e:
                    yield pd.DataFrame([(u, None, None, 0, 0, None, str(e) or type(e).__name__)], columns=names)
                    continue
                starts = range(0, max(1, len(x)), block)
                yield pd.DataFrame([(u, rate, channels, k, s, x[s : s + block].tolist(), None) for k, s in enumerate(starts)], columns=names)

    picked = files.select(F.col(url).alias("url"), F.col(content).alias("data"))
    return picked.mapInPandas(run, "url string, sample_rate long, channels long, block long, start long, pcm array<double>, error string")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """The decoded blocks of every WAV file below a path."""
    return decode(spark.read.format("binaryFile").load(path))


def block_samples(blocks: DataFrame) -> DataFrame:
    """(signal_id, i, v) of decoded blocks; signals are numbered by a hash of their address."""
    b = blocks.where("error IS NULL").select(F.xxhash64("url").alias("signal_id"), "start", F.posexplode("pcm").alias("k", "v"))
    return b.select("signal_id", (F.col("start") + F.col("k")).alias("i"), "v")


def durations(blocks: DataFrame) -> DataFrame:
    """(url, sample_rate, channels, samples, duration_s) of decoded files."""
    g = blocks.where("error IS NULL").groupBy("url", "sample_rate", "channels").agg(F.sum(F.size("pcm")).alias("samples"))
    return g.withColumn("duration_s", F.col("samples") / F.col("sample_rate"))


def stable_id(url: Column, samples: Column, rate: Column) -> Column:
    """Sixteen hexadecimal digits that name a signal by its address, length and rate, the same in every run."""
    return F.substring(F.sha2(F.concat_ws("|", url, samples.cast("string"), rate.cast("string")), 256), 1, 16)


def parse_probe(json_col: str) -> F.Column:
    """Typed stream metadata from a probe's JSON: a bad rate falls back to 44100, bad duration and bit rate to 0. Null without an audio stream or with channels outside 1 to 8."""
    schema = "streams array<struct<codec_type string, codec_name string, sample_rate string, channels int>>, format struct<duration string, bit_rate string, format_name string>"
    p = F.from_json(json_col, schema)
    first = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    number = lambda c, kind, default: F.coalesce(c.try_cast(kind), F.lit(default))
    found = F.struct(
        number(first["sample_rate"], "int", 44100).alias("sample_rate"), first["channels"].alias("channels"), first["codec_name"].alias("codec"), codec_type(first["codec_name"]).alias("content_type"),
        number(p["format"]["duration"], "double", 0.0).alias("duration_s"), number(p["format"]["bit_rate"], "long", 0).alias("bit_rate"), p["format"]["format_name"].alias("format"),
    )
    return F.when(first.isNotNull() & first["channels"].between(1, 8), found)
