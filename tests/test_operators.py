"""Analytic signals with known answers, and operators that SQL cannot express."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelens.functions import spectral, windows
from wavelens.operators import alignment, spectrum, temporal, tonal
from wavelens.sources import pcm, tables


@pytest.fixture(scope="module")
def known(spark):
    n = 64
    rows = [(1, [math.sin(2 * math.pi * 4 * i / n) for i in range(n)]), (2, [0.0] * n), (3, [0.5] * n), (4, [1.0] + [0.0] * (n - 1)), (5, [3.0]), (6, [])]
    return spark.createDataFrame(rows, "signal_id long, v array<double>")


def test_profile_of_known_signals(known):
    got = {r.signal_id: r for r in temporal.profile(tables.exploded(known)).collect()}
    assert got[1].crest == pytest.approx(math.sqrt(2), abs=1e-6)
    assert got[2].rms == got[3].rms == 0 and got[2].crest == 0 and got[3].range_db == 0
    assert got[5].n == 1 and got[5].zcr == 0 and 6 not in got


def test_dft_agrees_with_fast_transform(known):
    got = {(r.frame, r.bin): r.power for r in spectrum.dft(tables.exploded(known.where("signal_id = 1")), 64, 64).collect()}
    x = np.array(known.where("signal_id = 1").first().v)
    want = np.abs(np.fft.rfft(x - x.mean())) ** 2
    assert all(got[0, b] == pytest.approx(w, abs=1e-6) for b, w in enumerate(want))
    assert int(np.argmax(want)) == 4
    fast = spectrum.stft(tables.exploded(known), 64, 64).collect()
    assert {r.signal_id for r in fast} == {1, 2, 3, 4}
    assert np.allclose([r.m for r in fast if r.signal_id == 4][0], 1.0)


def test_flat_and_peaked_spectra(spark):
    s = spark.createDataFrame([(1, 0, [1.0] * 8), (1, 1, [0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1, 2, [0.0] * 8)], "signal_id long, frame long, m array<double>")
    got = {r.frame: r for r in spectrum.descriptors(s, 14.0).collect()}
    assert got[0].flatness == pytest.approx(1) and got[0].crest == pytest.approx(1)
    assert got[1].centroid == pytest.approx(2) and got[1].bandwidth == pytest.approx(0) and got[1].rolloff == pytest.approx(2)
    assert got[2].centroid == got[2].flatness == got[2].slope == 0


def test_kaiser_window(spark):
    w = [r.w for r in windows.window_table(spark, 33, ("kaiser",)).orderBy("i").collect()]
    assert np.allclose(w, np.kaiser(33, 8.6), atol=1e-9)
    with pytest.raises(ValueError):
        windows.coefficient("none", F.lit(0), 4)


def test_mel_scale_inverts(spark):
    f = spark.range(1, 9).select((F.col("id") * 500.0).alias("f"))
    assert all(r.a == pytest.approx(r.f) for r in f.select("f", spectral.mel_to_hz(spectral.hz_to_mel(F.col("f"))).alias("a")).collect())


def test_chord_and_key_of_c(spark):
    c = spark.createDataFrame([(1, [1.0 if i in (0, 4, 7) else 0.0 for i in range(12)])], "signal_id long, chroma array<double>")
    best = tonal.chords(c).where("rank = 1").first()
    assert (best.root, best.quality) == (0, "major")
    key = tonal.keys(c).first()
    assert (key.key, key.mode) == (0, "major")


def test_lag_and_warping(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(40)
    rows = [(1, i, float(x[i + 5])) for i in range(30)] + [(2, i, float(x[i])) for i in range(35)]
    s = spark.createDataFrame(rows, "signal_id long, i long, x double")
    pairs = spark.createDataFrame([(1, 2)], "query_id long, ref_id long")
    best = alignment.best_lag(alignment.lag_correlation(s, pairs)).first()
    assert best.lag == 5 and best.peak == pytest.approx(1)
    total, path, _ = alignment.dtw(x, x)
    assert total == 0 and path == [(i, i) for i in range(40)]
    assert alignment.dtw(np.array([0.0, 1, 2]), np.array([0.0, 0, 1, 2]))[0] == 0


def test_pcm_bytes(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(struct.pack("<3d", 0.5, -1.0, 2.0) + b"xyz")
    r = pcm.read_pcm(spark, str(tmp_path), sample_rate=3).first()
    assert r.pcm == [0.5, -1.0, 2.0] and r.duration_s == 1.0
    j = '{"streams":[{"codec_type":"video"},{"codec_type":"audio","codec_name":"mp3","sample_rate":"bad","channels":2}],"format":{"duration":"1.5","format_name":"mp3"}}'
    p = spark.createDataFrame([(j,)], "j string").select(pcm.parse_probe("j").alias("p")).first().p
    assert (p.sample_rate, p.channels, p.codec, p.duration_s, p.bit_rate) == (44100, 2, "mp3", 1.5, 0)


def test_warping_and_transform_queries_run(spark, sf_dir):
    from wavelens.plans import registry

    assert registry.QUERIES["dtw_alignment"](spark, sf_dir).count() > 0
    assert registry.QUERIES["stft_magnitudes"](spark, sf_dir).count() > 0
    assert tables.samples(spark, sf_dir).count() == 1000


def test_streaming_frames_span_batches(spark, tmp_path):
    from wavelens.streaming.stft import stream_frames

    src = tmp_path / "in"
    src.mkdir()
    x = [float(i * i % 7) for i in range(20)]
    for k in range(4):
        spark.createDataFrame([(1, i, x[i]) for i in range(5 * k, 5 * k + 5)], "signal_id long, i long, x double").coalesce(1).write.parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema("signal_id long, i long, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = stream_frames(stream, 8, 4).writeStream.format("memory").queryName("stft_frames").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.frame: r.m for r in spark.sql("SELECT * FROM stft_frames").collect()}
    assert sorted(got) == [0, 1, 2, 3] and all(np.allclose(m, np.abs(np.fft.rfft(x[4 * f : 4 * f + 8]))) for f, m in got.items())
