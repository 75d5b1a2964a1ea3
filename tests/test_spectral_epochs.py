"""Spectral transform (numpy) and epoch binning edges."""
import numpy as np

from trialspark.operators import epochs, spectral


def _gain(f, fs=1000.0):
    """Amplitude of a long sine behind the zero-phase filter, away from the ends."""
    t = np.arange(0, 8.0, 1 / fs)
    x = np.sin(2 * np.pi * f * t)
    y = spectral.band_stop(x[None, :], fs, 58, 62)[0]
    mid = slice(2000, -2000)
    return np.abs(np.exp(-2j * np.pi * f * t[mid]) @ y[mid]) / np.abs(np.exp(-2j * np.pi * f * t[mid]) @ x[mid])


def test_band_stop_is_a_butterworth_of_order_four():
    """Applied twice, the edges are at half power twice over: a quarter of the power, half of the amplitude."""
    num, den = spectral.butterworth_stop(1000.0, 58.0, 62.0)
    assert num.shape == den.shape == (4, 3) and (np.abs(np.roots(den[0])) < 1).all()

    def response(f):
        z = np.exp(-2j * np.pi * f / 1000.0 * np.arange(3))
        return np.abs(np.prod((num @ z) / (den @ z)))
    w1, w2 = np.tan(np.pi * 58 / 1000), np.tan(np.pi * 62 / 1000)
    for f in (3, 20, 55, 57, 58, 60.5, 62, 63, 65, 100, 180):
        w = np.tan(np.pi * f / 1000)
        ratio = (w * (w2 - w1) / (w1 * w2 - w * w)) ** 2
        assert np.isclose(response(f), 1 / np.sqrt(1 + ratio ** 4), rtol=1e-6)
    assert np.isclose(response(58), np.sqrt(0.5)) and np.isclose(response(62), np.sqrt(0.5))
    for f in (55, 58, 60, 62, 65):
        assert np.isclose(_gain(f), response(f) ** 2, atol=2e-3)
    assert _gain(60) < 1e-3 and _gain(55) > 0.95 and _gain(65) > 0.95


def test_constant_and_short_epochs_pass_the_filter():
    x = np.full((3, 50), 7.5)
    assert np.allclose(spectral.band_stop(x, 1000.0, 58, 62), x)
    assert spectral.band_stop(np.arange(5.0)[None, :], 1000.0, 58, 62).shape == (1, 5)


def test_a_sine_survives_a_change_of_rate():
    for fs, fs_out in ((2000.0, 1000.0), (500.0, 1000.0), (1600.0, 1000.0)):
        t, u = np.arange(0, 2, 1 / fs), np.arange(0, 2, 1 / fs_out)
        x = np.sin(2 * np.pi * 9.5 * t) + 0.3 * np.cos(2 * np.pi * 101 * t) + 2
        y = spectral.resample(x[None, :], fs, fs_out)[0]
        assert len(y) == 2 * fs_out
        assert np.allclose(y, np.sin(2 * np.pi * 9.5 * u) + 0.3 * np.cos(2 * np.pi * 101 * u) + 2, atol=1e-9)
    # what the lower rate cannot hold is gone
    t = np.arange(0, 1, 1 / 2000)
    assert np.abs(spectral.resample(np.sin(2 * np.pi * 700 * t)[None, :], 2000.0, 1000.0)).max() < 1e-9


def test_power_peaks_at_the_signal_at_any_rate(spark):
    freqs = spectral.logspace_freqs(3, 180, 8)
    rows = []
    for key, fs in ((1, 1000.0), (2, 2000.0), (3, 500.0)):
        t = np.arange(0, 4 + 0.5 / fs, 1 / fs)
        x = 3.0 + np.sin(2 * np.pi * 9.7 * t) + 2.0 * np.sin(2 * np.pi * 60 * t)
        rows.append((key, list(range(len(x))), x.tolist(), fs))
    df = spark.createDataFrame(rows, "k long, idx array<int>, v array<double>, rate double")
    out = spectral.epoch_power(df, ["k"], "idx", "v", "rate", 4.0, freqs, 1.0, 1000.0).toPandas()
    power = {k: g.sort_values("freq_index").power.to_numpy() for k, g in out.groupby("k")}
    assert all(int(np.argmax(p)) == 2 for p in power.values())  # 9.7 Hz
    assert np.allclose(power[1], power[2], atol=0.1) and np.allclose(power[1][:5], power[3][:5], atol=0.1)


def test_bins_right_closed(spark):
    df = spark.createDataFrame([(1, r) for r in (0, 1, 1000, 1001, 2000)], "onset_id int, rel long")
    got = sorted((r.rel, r.time_bin) for r in epochs.time_bins(df, 0, 2000, 1000).collect())
    assert got == [(1, 0), (1000, 0), (1001, 1000), (2000, 1000)]


def test_interval_join_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    on = [(i, "u", int(t)) for i, t in enumerate(rng.integers(0, 100_000, 20))]
    sm = [("u", int(t), float(v)) for t, v in zip(rng.integers(0, 100_000, 300), rng.normal(size=300))]
    o = spark.createDataFrame(on, "onset_id int, subject string, t long")
    s = spark.createDataFrame(sm, "subject string, t long, v double")
    got = epochs.epochs(o, s, ["subject"], "t", "t", -2000, 500, 1000).count()
    brute = sum(1 for _, _, t0 in on for _, t, _ in sm if t0 - 3000 <= t <= t0 + 1500)
    assert got == brute


def test_all_periods_in_one_job_against_a_plain_loop(spark):
    """Five periods with their own windows, kept window and right-closed bins, differenced by sensor pair."""
    from trialspark.sources.tables import experiment_params, longest_epoch_ms, period_table
    rng = np.random.default_rng(8)
    kinds = ["WORD", "DISTRACT_END", "COUNTDOWN_START", "OTHER"]
    onsets = [(i, 1 + i % 2, kinds[rng.integers(4)], int(rng.integers(0, 60_000))) for i in range(40)]
    samples = [(s, c, t, None if rng.random() < 0.02 else float(rng.normal()))
               for s in (1, 2) for c in "abc" for t in range(0, 60_000, 250) if rng.random() < 0.8]
    o = spark.createDataFrame(onsets, "onset_id long, session long, type string, mstime long")
    x = spark.createDataFrame(samples, "session long, contact string, mstime long, value double")
    p = spark.createDataFrame([("a", "b"), ("b", "c")], "contact_1 string, contact_2 string")
    ep = epochs.epochs_by_period(o, x, period_table(spark, "catFR1"), ["session"], longest_epoch_ms("catFR1"))
    ep = epochs.pair_difference(ep, p, ["onset_id", "period", "start_ms", "end_ms", "keep_lo_ms", "keep_hi_ms", "bin_ms"])
    channel = ["onset_id", "period", "contact_1", "contact_2"]
    ep = ep.withColumn("value", ep.value - epochs.epoch_mean("value", channel))
    got = {tuple(r[c] for c in [*channel, "time_bin"]): (r.value, r.n) for r in epochs.reduce_periods(ep, "value", channel).collect()}

    at = {(s, c, t): v for s, c, t, v in samples if v is not None}
    want = {}
    for i, s, kind, t0 in onsets:
        for q in experiment_params("catFR1").periods.values():
            if kind not in q.event_types:
                continue
            lo, hi, buf = (round(v * 1000) for v in (q.start_s, q.end_s, q.buffer_s))
            for a, b in (("a", "b"), ("b", "c")):
                v = {t - t0: at[s, a, t] - at[s, b, t] for t in range(0, 60_000, 250)
                     if t0 + lo - buf <= t <= t0 + hi + buf and (s, a, t) in at and (s, b, t) in at}
                if not v:
                    continue
                mean = np.mean(list(v.values()))
                bins = {}
                for rel, d in v.items():
                    if q.bin_s is None:
                        k = q.keep_ms or (lo, hi)
                        if max(k[0], lo) <= rel <= min(k[1], hi):
                            bins.setdefault(None, []).append(d - mean)
                    elif lo < rel <= hi:
                        bins.setdefault(lo + (-(-(rel - lo) // 1000) - 1) * 1000, []).append(d - mean)
                want |= {(i, q.period, a, b, k): (np.mean(d), len(d)) for k, d in bins.items()}
    assert got.keys() == want.keys() and len(want) > 200 and len({k[1] for k in want}) == 5
    assert all(np.isclose(got[k][0], v) and got[k][1] == n for k, (v, n) in want.items())
