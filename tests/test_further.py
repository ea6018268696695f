"""Known answers and brute force for operators that SQL does not check."""

import io
import itertools
import math
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelens.functions import windows
from wavelens.operators import alignment, clustering, content, filters, harmony, matching, normalising, peaks, pitch, presets, rhythm, spectrum, temporal, tonal
from wavelens.sources import pcm, tables


def samples(spark, *signals):
    rows = [(k, i, float(v)) for k, x in enumerate(signals, 1) for i, v in enumerate(x)]
    s = spark.createDataFrame(rows, "signal_id long, i long, v double")
    return s.withColumn("x", F.col("v") - F.avg("v").over(temporal.by_signal()))


def comb(f0, rate=8000.0, bins=513, stretch=0.0, count=8):
    m = np.full(bins, 0.001)
    for n in range(1, count + 1):
        k = round(n * f0 * math.sqrt(1 + stretch * n * n) / (rate / 2 / (bins - 1)))
        if 0 < k < bins - 1:
            m[k] = 1.0 / n
    return m.tolist()


def test_long_signals_take_time_in_proportion(spark):
    def seconds(n):
        s = spark.range(n, numPartitions=2).select(F.lit(1).cast("long").alias("signal_id"), F.col("id").alias("i"), F.sin(F.col("id") * 0.01).alias("v")).withColumn("x", F.col("v"))
        start = time.time()
        for out in (temporal.profile(s), temporal.frame_energy(s), temporal.normalized(s), rhythm.activity(s), temporal.energy_statistics(s)):
            out.write.format("noop").mode("overwrite").save()
        return time.time() - start

    seconds(1000)
    assert seconds(400_000) < 60


def test_pitch_methods_find_a_tone(spark):
    x = [sum(math.sin(2 * math.pi * 200 * h * i / 8000) / h for h in range(1, 8)) for i in range(2048)]
    f = temporal.framed(samples(spark, x, [0.0] * 2048), 1024, 512)
    for method in ("yin", "acf", "nsdf", "hps"):
        got = pitch.frame_pitch(f, 8000.0, method=method, least=0.01).collect()
        assert all(r.pitch == pytest.approx(200, rel=0.03) for r in got if r.signal_id == 1), method
        assert all(r.pitch == 0 for r in got if r.signal_id == 2)
    with pytest.raises(ValueError):
        pitch.frame_pitch(f, 8000.0, method="none")
    assert pitch.crossing_pitch(np.sin(np.arange(2048) * 2 * math.pi * 200 / 8000 + 0.1), 8000.0)[0] == pytest.approx(200, rel=0.05)


def test_pitch_history(spark):
    rows = [(1, k, p) for k, p in enumerate([100.0, 102.0, 98.0, 100.0, 101.0, 99.0, 0.0, 100.0, 104.0, 100.0, 96.0, 100.0])]
    p = spark.createDataFrame(rows, "signal_id long, frame long, pitch double")
    s = {r.frame: r for r in pitch.smoothed_pitch(p).collect()}
    assert s[2].smooth == 100 and s[6].smooth == 0 and s[5].stability > 0.9 and s[1].stability == 0
    st = pitch.pitch_stability(p, 10.0).first()
    v = [x for _, _, x in rows if x]
    assert st.mean == pytest.approx(np.mean(v)) and st.deviation == pytest.approx(np.std(v, ddof=1)) and st.voiced == pytest.approx(11 / 12) and st.vibrato > 0


def test_voice_periods_of_a_steady_pulse(spark):
    x = [math.sin(2 * math.pi * 100 * i / 8000) for i in range(8000)]
    df = spark.createDataFrame([(1, x), (2, [0.0] * 3000)], "signal_id long, v array<double>")
    got = {r.signal_id: r for r in pitch.voice_periods(df, 8000.0).collect()}
    assert got[1].periods >= 10 and got[1].jitter < 1 and got[1].shimmer < 1 and got[1].mean_f0 == pytest.approx(100, rel=0.02) and got[1].age == "adult"
    assert got[2].periods == 0 and got[2].age == "unknown"


def test_reflections_and_prediction_error():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(500)
    a, e, k = pitch.levinson(x, 5)
    assert np.allclose(pitch.reflection(a), k) and (np.abs(k) < 1).all()
    assert pitch.prediction_error(x, a)[5:] @ pitch.prediction_error(x, a)[5:] < x @ x
    assert pitch.tract_length([(500.0, 80.0, 0.9), (1500.0, 80.0, 0.9)]) == pytest.approx(17.5) and pitch.tract_length([]) == 17.5


def test_harmonic_ratio_and_inharmonicity(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(1, 0, comb(250.0), 250.0), (1, 1, rng.random(513).tolist(), 250.0), (1, 2, [0.0] * 513, 0.0), (1, 3, comb(250.0, stretch=0.002), 250.0)], "signal_id long, frame long, m array<double>, f0 double")
    for method in ("hnr", "comb", "spectral", "hps"):
        got = {r.frame: r for r in harmony.harmonic_ratio(df, 8000.0, high=4000.0, method=method, tolerance=0.02).collect()}
        assert got[0].f0 == pytest.approx(250, abs=8) and got[0].ratio_db > got[1].ratio_db or method == "hps"
        assert got[0].harmonics == 8
    i = {r.frame: r for r in harmony.inharmonicity(df, 8000.0, high=4000.0).collect()}
    assert abs(i[0].stiffness) <= 2e-4 and i[3].stiffness == pytest.approx(0.002, abs=4e-4) and i[3].inharmonicity > i[0].inharmonicity and i[2].partials == 0
    said = df.limit(1).select(harmony.inharmonicity_class(F.lit(0.002)).alias("a"), harmony.instrument(F.lit(0.003), F.lit(200.0)).alias("b"), harmony.ratio_class(F.lit(12.0)).alias("c")).first()
    assert tuple(said) == ("Moderate", "Piano/String", "High")
    floors = [harmony.noise_floor(np.arange(30.0), m) for m in ("percentile", "median", "minimum")]
    assert (floors[1] >= floors[0]).all() and (floors[0] >= floors[2]).all()


def test_smoothed_series(spark):
    v = [10.0, 12.0, 8.0, 11.0]
    s = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "signal_id long, frame long, r double")
    got = [r.smooth for r in harmony.smoothed_series(s, "r").orderBy("frame").collect()]
    want = [v[0]]
    for x in v[1:]:
        want.append(0.3 * x + 0.7 * want[-1])
    assert got == pytest.approx(want)


def test_tracks_and_melody(spark):
    rows = [(1, f, 10.0 + 0.1 * f, 1.0) for f in range(6)] + [(1, f, 40.0, 0.5) for f in (0, 1, 2, 4, 5)]
    p = spark.createDataFrame(rows, "signal_id long, frame long, place double, mag double")
    t = harmony.partial_tracks(p, 10.0, far=20.0, loud=1.0)
    f = {r.track: r for r in harmony.track_figures(t, 0.1).collect()}
    assert sorted((r.start, r.last) for r in f.values()) == [(0, 2), (0, 5), (4, 5)]
    m = harmony.melody(t, harmony.track_figures(t, 0.1)).orderBy("frame").collect()
    assert [r.freq for r in m] == pytest.approx([100 + f for f in range(6)])
    assert harmony.f0_stability(t).first().stability > 0.9


def test_spaced_peaks_and_subharmonics(spark):
    p = spark.createDataFrame([(1, 0, b, m, float(b)) for b, m in ((5, 1.0), (7, 2.0), (9, 1.5), (20, 1.0))], "signal_id long, frame long, bin long, mag double, place double")
    assert sorted(r.bin for r in peaks.spaced_peaks(p, 4).collect()) == [7, 20]
    f0 = spark.createDataFrame([(1, 0, 20.0)], "signal_id long, frame long, f0 double")
    assert [(r.bin, r.harmonic) for r in peaks.subharmonics(p, f0).collect()] == [(5, -4), (7, -3)]
    assert peaks.log_edges(4, 64, 8000.0)[-1] <= 64 and list(peaks.log_edges(6, 64, 8000.0)) == sorted(set(peaks.log_edges(6, 64, 8000.0)))


def test_wav_files(spark, tmp_path):
    x = (np.sin(np.arange(100) / 5) * 20000).astype("<i2")
    for name, channels in (("a.wav", 1), ("b.wav", 2)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(50)
            w.writeframes(np.repeat(x, channels).tobytes())
    (tmp_path / "c.wav").write_bytes(b"no audio")
    blocks = pcm.decode(spark.read.format("binaryFile").load(str(tmp_path)), block=30)
    got = sorted(blocks.collect(), key=lambda r: (r.url, r.block))
    assert [r.block for r in got] == [0, 1, 2, 3] * 2 + [0] and got[-1].error and got[-1].pcm is None
    joined = np.concatenate([r.pcm for r in got if r.url.endswith("b.wav")])
    assert np.allclose(joined, x / 32768) and pcm.durations(blocks).first().duration_s == 2.0
    assert pcm.block_samples(blocks).count() == 200
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1), w.setsampwidth(3), w.setframerate(8)
        w.writeframes(struct.pack("<i", -(1 << 22))[:3] + struct.pack("<i", 1 << 22)[:3])
    assert pcm.decode_wav(buf.getvalue())[2].tolist() == [-0.5, 0.5]


def test_interpolation_kernels():
    x = np.sin(np.arange(40) / 4)
    at = np.array([5.5, 17.25, 30.75])
    for kind in ("cubic", "hermite", "lanczos"):
        assert np.allclose(filters.interpolate(x, at, kind), np.sin(at / 4), atol=0.01), kind
    assert np.allclose(filters.interpolate(x, at, "cubic"), filters.interpolate(x, at, "hermite"))
    assert filters.interpolate(x[:3], np.array([0.5]), "lanczos") == pytest.approx([(x[0] + x[1]) / 2])
    assert len(filters.interpolate(np.zeros(0), at)) == 3
    with pytest.raises(ValueError):
        filters.interpolate(x, at, "none")


def test_rates_and_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0]), (2, [])], "signal_id long, v array<double>")
    got = {r.signal_id: r.y for r in filters.resampled_rate(df, 2.0, 4.0).collect()}
    assert got[1] == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3] and got[2] == []
    assert {r.signal_id: r.y for r in filters.upsampled(df, 2).collect()}[1] == [0, 0.5, 1, 1.5, 2, 2.5, 3, 0]
    t = spark.createDataFrame([([[0.0, 1.0], [2.0, 3.0]],)], "t array<array<double>>")
    assert t.select(filters.bilinear(F.col("t"), F.lit(0.5), F.lit(0.5)).alias("a"), filters.bilinear(F.col("t"), F.lit(9.0), F.lit(-1.0)).alias("b")).first() == (1.5, 1.0)
    assert filters.by_channel(samples(spark, [1, 2, 3, 4]), 2).where("channel = 1").select("v").collect() == [(2.0,), (4.0,)]
    top, low, tilt = filters.emphasis_tilt(0.97, 8000.0)
    assert top == pytest.approx(1.97) and low == pytest.approx(0.03) and tilt > 0


def test_recursive_blocks_agree_with_the_recursion(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(1000)
    b, a = filters.band_pass(1000.0, 90.0, 3.0)
    y = np.zeros(1000)
    for n in range(1000):
        y[n] = sum(c * x[n - k] for k, c in enumerate(b) if n >= k) - sum(c * y[n - k] for k, c in enumerate(a) if 0 < k <= n)
    got = filters.recursive(spark.createDataFrame([(1, x.tolist())], "signal_id long, v array<double>"), (b, a)).first().y
    assert np.allclose(got, y)


def test_frame_normalisation_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(45)
    y = x.copy()
    for f in range((45 - 16) // 8 + 1):
        part = x[8 * f : 8 * f + 16]
        z = (part - part.mean()) / part.std(ddof=1)
        for j in range(16):
            y[8 * f + j] = z[j] if f == 0 or j < 8 else (1 - j / 16) * y[8 * f + j] + j / 16 * z[j]
    got = [r.y for r in normalising.by_frame(samples(spark, x)).orderBy("i").collect()]
    assert got == pytest.approx(y.tolist())
    loud = normalising.to_loudness(samples(spark, x), -23.0, 16)
    assert loud.count() == 45 and normalising.loudness_gain(samples(spark, [0.0] * 20), -23.0, 16).first().gain == 1


def test_warping_patterns_and_bands():
    rng = np.random.default_rng(4)
    q, r = rng.standard_normal(9), rng.standard_normal(12)

    def slow(pattern, band):
        add = alignment.STEPS[pattern]
        d = np.full((10, 13), np.inf)
        d[0, 0] = 0
        for i, j in itertools.product(range(1, 10), range(1, 13)):
            if abs(i - j) <= band:
                best = min(d[i - 1, j] + add[0], d[i, j - 1] + add[1], d[i - 1, j - 1] + add[2])
                d[i, j] = abs(q[i - 1] - r[j - 1]) + (0 if (i, j) == (1, 1) else best)
        return d[9, 12]

    for pattern, band in itertools.product(alignment.STEPS, (3, 5, 20)):
        total, path, costs = alignment.dtw(q, r, band, pattern)
        assert total == pytest.approx(slow(pattern, band)) and path[0] == (0, 0) and path[-1] == (8, 11)
        if pattern != "symmetric1":
            assert costs.sum() == pytest.approx(total)
    lags, c = alignment.spectral_correlation(q, r)
    assert c[list(lags).index(2)] == pytest.approx(sum(q[i] * r[i + 2] for i in range(9)))
    f = alignment.path_figures([(i, i) for i in range(10)], np.zeros(10), 10, 10)
    assert f["efficiency"] == f["smoothness"] == f["evenness"] == 1 and f["diagonal"] > 0.99
    assert alignment.dtw([], r)[0] == 0


def test_alignment_results(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(60)
    s = samples(spark, x[4:44], x[:44])
    pairs = spark.createDataFrame([(1, 2)], "query_id long, ref_id long")
    lags = alignment.lag_scores(alignment.peak_measures(alignment.lag_correlation(s, pairs, 12)), 12)
    row = lags.first()
    assert row.lag == 4 and row.confidence > 0.7 and row.quality > 0.7
    df = spark.createDataFrame([(1, x[4:44].tolist()), (2, x[:44].tolist())], "signal_id long, v array<double>")
    w = alignment.warp_scores(df, pairs)
    h = alignment.hybrid(lags, w).first()
    assert h.method == "correlation" and h.offset == 4
    both = lags.select("query_id", "ref_id", F.lit("corr_energy").alias("feature"), F.col("lag").cast("double").alias("offset"), "similarity", "confidence", "quality").unionByName(w.select("query_id", "ref_id", F.lit("dtw_chroma").alias("feature"), "offset", "similarity", "confidence", "quality"))
    best = alignment.summary(alignment.best_alignment(both)).first()
    assert best.feature == "corr_energy" and best.label in ("excellent", "good")
    a = alignment.aligned(s, lags.select("query_id", "ref_id", "lag")).orderBy("k").collect()
    assert len(a) == 40 and np.corrcoef([r.q for r in a], [r.r for r in a])[0, 1] == pytest.approx(1)
    noisy = alignment.best_lag(alignment.lag_correlation(alignment.perturbed(s), pairs, 12)).select("query_id", "ref_id", F.col("lag").cast("double").alias("offset"))
    c = alignment.offset_consistency(noisy.unionByName(lags.select("query_id", "ref_id", F.col("lag").cast("double").alias("offset")))).first()
    assert c.consistency == 1 and c.median == 4


def blobs(spark):
    rng = np.random.default_rng(6)
    rows = [(10 * c + i, c, (rng.standard_normal(3) * 0.1 + 5 * c).tolist()) for c in range(3) for i in range(10)] + [(99, 9, [50.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "id long, label int, v array<double>")


def test_clusterings_of_bounded_sets(spark):
    v = blobs(spark)
    d = {r.id: r.cluster for r in clustering.dbscan(v, 1.0, 3).collect()}
    assert d[99] == -1 and {d[10 * c + i] for c in range(3) for i in range(10)} == {0, 10, 20} and d[13] == 10
    for linkage in ("single", "complete", "average", "ward"):
        h = {r.id: r.cluster for r in clustering.hierarchical(v, 4, linkage).collect()}
        assert len(set(h.values())) == 4 and all(len({h[10 * c + i] for i in range(10)}) == 1 for c in range(3)), linkage
    m = {r.id: r for r in clustering.k_medoids(v.where("id < 99"), 3, seed=1).collect()}
    assert all(r.medoid in m for r in m.values())
    with pytest.raises(ValueError):
        clustering.k_medoids(v, 3, most=5)
    with pytest.raises(ValueError):
        clustering.hierarchical(v, 3, "none")


def test_comparison_of_features(spark):
    rng = np.random.default_rng(7)
    rows = [(k, f, (rng.random(64) * (1 + k)).tolist()) for k in (1, 2) for f in range(6)]
    rows += [(3, f, m) for k, f, m in rows if k == 1]
    s = spark.createDataFrame(rows, "signal_id long, frame long, m array<double>")
    t = spark.createDataFrame([(1, 20.0, 0.1, 0.0, 5.0, 1.0), (3, 20.0, 0.1, 0.0, 5.0, 1.0)], "signal_id long, range_db double, silence double, density double, level_mean double, level_dev double")
    features = matching.signal_features(s, 8000.0, 64, temporal=t)
    c = {(r.query_id, r.candidate_id): r for r in matching.batch_compare(features).collect()}
    assert c[1, 3].similarity == 1 and c[1, 3].label == "exact" and c[1, 3].s_temporal == 1 and c[1, 2].s_temporal is None
    assert c[1, 3].confidence == 1 and 0 < c[1, 2].similarity < 1 and c[1, 2].availability == pytest.approx(4 / 6)
    w = presets.COMPARISON_WEIGHTS["unknown"]
    r = c[1, 2]
    groups = [g for g in matching.GROUPS if r[f"s_{g}"] is not None]
    assert r.similarity == pytest.approx(sum(w[g] * r[f"s_{g}"] for g in groups) / sum(w[g] for g in groups), abs=1e-8)
    best = matching.best_matches(matching.batch_compare(features), 0.99).collect()
    assert {(b.query_id, b.candidate_id, b["rank"]) for b in best} >= {(1, 3, 1), (3, 1, 1)}


def test_meeting_in_blocks_is_every_pair(spark):
    v = blobs(spark)
    got = matching.distance_matrix(v, block=4).collect()
    assert len(got) == 31 * 30 // 2 and len({(r.a, r.b) for r in got}) == len(got)
    one = matching.nearest(v.where("id = 3"), v, 4, block=4).collect()
    two = matching.nearest(v.where("id = 3"), v, 4, block=1000).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 4


def test_tones(spark):
    c = [1.0 if i in (0, 4, 7) else 0.0 for i in range(12)]
    g = c[-7:] + c[:-7]
    f = spark.createDataFrame([(1, k, c if k < 15 else g) for k in range(40)] + [(2, k, c) for k in range(5)], "signal_id long, frame long, chroma array<double>")
    assert [(r.key, r.mode) for r in tonal.modulations(f).collect() if r.signal_id == 1][-1] == (7, "major")
    k = tonal.global_key(tonal.key_figures(f)).where("signal_id = 2").first()
    assert (k.key, k.mode, k.stability) == (0, "major", 1)
    t = {r.kind for r in tonal.key_transitions(tonal.key_figures(f)).collect()}
    assert t == {"same_key", "dominant"}
    figures = tonal.chord_figures(f.where("signal_id = 2")).first()
    assert figures.name == "C" and figures.role == "tonic" and figures.extensions == []
    p = tonal.progression(tonal.chord_figures(f)).where("signal_id = 1").first()
    assert p.chords == 40 and p.changes == 1 and p.common_quality == "major"
    low = tonal.inversions(f.where("signal_id = 2").withColumn("low", F.lit(4)), "low").first()
    assert (low.root, low.quality, low.inversion) == (0, "major", 1)
    r = tonal.harmonic_regions(spark.createDataFrame([(1, c)], "signal_id long, chroma array<double>")).collect()
    assert {x.kind for x in r} <= {"major_triad"}
    x = f.limit(1).select(tonal.best_transposition(F.array(*map(F.lit, g)), F.array(*map(F.lit, c))).alias("t"), tonal.turned(F.col("chroma"), 4).alias("u"), tonal.blended(F.col("chroma"), F.array(*map(F.lit, g)), 0.5).alias("b"), tonal.fitted(F.col("chroma"), 24).alias("z"), tonal.above_mean(F.col("chroma")).alias("a")).first()
    assert -x.t.k == 7 and x.u == c[4:] + c[:4] and x.b[0] == 0.5 and len(x.z) == 24 and x.a == c


def test_sequences(spark):
    rng = np.random.default_rng(8)
    rows = [(1, k, v) for k, v in enumerate(rng.random((12, 12)).tolist())]
    rows += [(2, k, v) for _, k, v in rows]
    f = spark.createDataFrame(rows, "signal_id long, frame long, chroma array<double>")
    pairs = spark.createDataFrame([(1, 2)], "query_id long, ref_id long")
    s = tonal.sequence_similarity(f, pairs).first()
    assert s.qmax == pytest.approx(1) and s.shift == 0 and 0 < s.direct < 1
    assert tonal.warped_similarity(f, pairs).first().similarity == pytest.approx(1)
    a = tonal.local_alignment(f, pairs).first()
    assert a.score >= 12 * 0.6 - 1e-9 and a.similarity <= 0.6 + 1e-9


def test_constant_q_and_hpcp(spark):
    x = [math.sin(2 * math.pi * 440 * i / 8000) for i in range(4000)]
    c = tonal.constant_q(spark.createDataFrame([(1, x), (2, [])], "signal_id long, v array<double>"), 8000.0, 1000, 220.0, 880.0).collect()
    assert len(c) == 4 and all(int(np.argmax(r.chroma)) == 9 for r in c)
    p = spark.createDataFrame([(1, 0, 440.0 / (4000 / 512), 1.0)], "signal_id long, frame long, place double, mag double")
    h = tonal.hpcp(p, 8000.0, 513).first()
    assert int(np.argmax(h.chroma)) == 9 and sum(v * v for v in h.chroma) == pytest.approx(1)


def test_inverse_transform_and_windows(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal(32)
    s = samples(spark, x)
    back = spectrum.inverse_dft(spectrum.dft(s, 16, 16), 16).orderBy("frame", "j").collect()
    assert [r.x for r in back] == pytest.approx((x - x.mean()).tolist())
    with pytest.raises(Exception):
        windows.windowed(temporal.framed(s, 16, 16), "hann", 8).collect()


def test_metadata_and_presets(spark):
    rows = [("music", None, None, None), ("odd", "Rock", None, None), (None, "Smooth Jazz", "NPR", None), (None, "x", "ESPN 1000", ""), (None, None, "Big FM", "http://a"), ("", "", "", "http://x/talk"), (None, None, None, None), (None, "sports talk", None, None), (None, "R&B", None, None)]
    d = spark.createDataFrame(rows, "content_type_name string, genre string, station string, url string")
    got = [(r.content_type, r.source) for r in content.metadata_types(d).collect()]
    assert got == [("music", "content_type"), ("unknown", "content_type"), ("music", "genre"), ("sports", "station"), ("music", "station"), ("talk", "url_pattern"), ("unknown", "url_pattern"), ("news", "genre"), ("music", "genre")]
    said = d.limit(1).select(content.decided_type(F.lit("unknown"), F.lit("news")).alias("a"), content.decided_type(F.lit("unknown"), F.lit("unknown"), "mixed").alias("b")).first()
    assert tuple(said) == ("news", "mixed")
    assert presets.normalization_filter("music") == "loudnorm=I=-16.0:TP=-1.0:LRA=8.0" and presets.normalization_filter("talk").startswith("dynaudnorm") and "-2.0/-2.0" in presets.normalization_filter("sports")
    assert presets.of(presets.COMPARISON, "none")[0] == 0.75 and presets.of(presets.PROFILES, "sports")["threshold"] == 0.75
    with pytest.raises(ValueError):
        presets.check_signal_format(0, 1)
