"""Known answers for rhythm, pitch, filters, peaks, clustering and content type."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelens.operators import clustering, content, filters, peaks, pitch, rhythm, tonal
from wavelens.sources import tables


@pytest.fixture(scope="module")
def tone(spark):
    x = [math.sin(2 * math.pi * 100 * i / 8000) for i in range(1024)]
    return spark.createDataFrame([(1, x), (2, [0.0] * 64), (3, [1.0]), (4, [])], "signal_id long, v array<double>")


def test_pitch_of_a_sine(tone):
    got = {r.signal_id: r for r in pitch.fundamentals(tone, 8000.0, 50.0, 500.0).collect()}
    assert got[1].yin == pytest.approx(100, rel=0.01) and got[2].yin == got[3].yin == got[4].cepstrum == 0
    lag = {r.signal_id: r for r in pitch.autocorrelation_pitch(tone, 8000.0, 16, 120).collect()}
    assert lag[1].lag == 80 and lag[1].f0 == pytest.approx(100) and 4 not in lag and 3 not in lag


def test_prediction_recovers_a_resonance(tone):
    rng = np.random.default_rng(1)
    x, want = np.zeros(6000), (1.5, -0.9)
    for n in range(2, len(x)):
        x[n] = want[0] * x[n - 1] + want[1] * x[n - 2] + rng.standard_normal()
    a, e = pitch.lpc(x, 2)
    assert np.allclose(a, want, atol=0.03) and e < x @ x
    place = math.acos(1.5 / (2 * math.sqrt(0.9))) * 8000 / (2 * math.pi)
    assert pitch.formants(a, 8000.0)[0] == pytest.approx(place, rel=0.05)
    assert pitch.lpc(np.zeros(10), 3)[0].tolist() == [0, 0, 0]
    got = {r.signal_id: r for r in pitch.vocal_tract(tone, 8000.0).collect()}
    assert len(got) == 4 and len(got[1].coefficients) == 4


def test_filters_agree_with_their_responses(spark):
    section = filters.band_pass(1000.0, 100.0, 5.0)
    assert filters.response(section, 1000.0, 100.0)[0] == pytest.approx(1) and filters.response(filters.dc_removal(), 1000.0, 0.0)[0] == pytest.approx(0)
    df = spark.createDataFrame([(f, [math.sin(2 * math.pi * f * i / 1000) for i in range(2000)]) for f in (100, 300)] + [(0, [])], "signal_id long, v array<double>")
    got = {r.signal_id: r.y for r in filters.recursive(df, section).collect()}
    for f in (100, 300):
        assert np.sqrt(2 * np.mean(np.square(got[f][-500:]))) == pytest.approx(filters.response(section, 1000.0, f)[0], rel=0.02)
    assert got[0] == []
    y = {r.signal_id: r.y for r in filters.adaptive_pre_emphasis(df).collect()}
    assert len(y[100]) == 2000 and y[0] == []
    r = [x.y for x in filters.resampled(spark.createDataFrame([(1, [0.0, 1.0, 4.0])], "signal_id long, v array<double>"), 5).orderBy("k").collect()]
    assert r == [0, 0.5, 1, 2.5, 4]


def test_tempo_and_envelopes(spark):
    on = spark.createDataFrame([(1, k * 16) for k in range(5)] + [(2, 3)], "signal_id long, frame long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "signal_id long")
    got = {r.signal_id: (r.tempo, r.votes, r.category) for r in rhythm.tempo(on, ids, 1 / 32).collect()}
    assert got == {1: (120, 4, "fast"), 2: (120, 0, "fast"), 3: (120, 0, "fast")}
    levels = [0.0, 0.0, 2.0, 5.0, 10.0, 6.0, 0.5, 0.0]
    # frames of one pair +-level have that RMS and mean zero
    df = spark.createDataFrame([(1, [s * x for x in levels for s in (1, -1)])], "signal_id long, v array<double>")
    assert [tuple(r) for r in rhythm.attack_decay(tables.exploded(df), 4.0, 2, 2).collect()] == [(1, 4, 3, 2)]


def test_harmonics_of_a_comb(spark):
    m = [1.0 / (i // 6) if i % 6 == 0 and i else 0.0 for i in range(64)]
    s = spark.createDataFrame([(1, 0, m), (1, 1, m), (1, 2, [0.0] * 64)], "signal_id long, frame long, m array<double>")
    p = peaks.spectral_peaks(s, 0.0, 20)
    f0 = peaks.harmonic_product(s)
    assert f0.where("frame = 0").first().bin == 6
    h = peaks.harmonic_series(peaks.harmonics(p, f0.select("signal_id", "frame", F.col("bin").cast("double").alias("f0")))).where("frame = 0").first()
    assert h.n == 10 and h.inharmonicity == pytest.approx(0) and h.odd_even == pytest.approx(sum(1 / k**2 for k in range(1, 11, 2)) / sum(1 / k**2 for k in range(2, 11, 2)))
    assert h.decay < 0


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(10 * c + i, c, (rng.standard_normal(3) * 0.1 + 10 * c).tolist()) for c in range(3) for i in range(10)]
    v = spark.createDataFrame(rows, "id long, label int, v array<double>")
    for f in (clustering.k_means, clustering.gaussian_mixture):
        got = {r.id: r.cluster for r in f(v, 3).collect()}
        assert len({(got[10 * c + i], c) for c in range(3) for i in range(10)}) == 3, f.__name__
    s = {r.id: r.silhouette for r in clustering.silhouettes(v).collect()}
    assert min(s.values()) > 0.95
    one = clustering.silhouettes(v.where("label = 0 OR id = 10")).where("id = 10").first()
    assert one.silhouette == 0


def test_content_and_keys(spark):
    d = spark.createDataFrame([(1, 0.05, 0.9, 0.8, 25.0), (2, 0.2, 0.1, 0.45, 5.0), (3, None, None, None, None)], "signal_id long, zcr double, harmonic double, stability double, range_db double")
    assert {r.signal_id: r.content_type for r in content.content_types(d).collect()} == {1: "music", 2: "news", 3: "unknown"}
    assert tonal.related_keys(0, "major")["relative"] == (9, "minor") and tonal.key_distance((0, "major"), (7, "major")) == 1
    assert tonal.key_distance((0, "major"), (0, "minor")) == 0 and tonal.key_distance((0, "major"), (6, "major")) == 6
