"""Spectral features of epochs (T3-T5), numpy only.

The array transform of one epoch (band stop, resampling, Morlet wavelet power, log10,
buffer removal, mean over time) runs in a vectorised pandas function over
batches of epochs: Spark partitions and shuffles the epochs, each epoch row
holds one bounded array (its length is fixed by the period parameters), and
numpy transforms all epochs of a batch that have one sampling rate at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: epochs of one batch that are transformed together
EPOCHS_AT_ONCE = 256


@lru_cache(maxsize=64)
def butterworth_stop(fs: float, lo: float, hi: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Second-order sections (numerators, denominators; rows of three) of a Butterworth band stop of ``order``.

    The analogue low-pass poles are turned into pairs around the geometric centre of the pre-warped band edges, with
    zeros at the centre, and mapped by the bilinear transform; every section has unit gain at frequency 0.
    """
    k = np.arange(order)
    low_pass = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    w1, w2 = 2 * fs * np.tan(np.pi * lo / fs), 2 * fs * np.tan(np.pi * hi / fs)
    half = (w2 - w1) / low_pass / 2
    root = np.sqrt(half ** 2 - w1 * w2)
    poles = np.concatenate([half + root, half - root])
    poles = poles[np.argsort(-poles.imag)][:order]  # one of each conjugate pair

    def digital(s):
        return (2 * fs + s) / (2 * fs - s)
    z, p = digital(1j * np.sqrt(w1 * w2)), digital(poles)
    num = np.tile([1.0, -2 * z.real, abs(z) ** 2], (order, 1))
    den = np.stack([np.ones(order), -2 * p.real, np.abs(p) ** 2], axis=1)
    return num * (den.sum(axis=1) / num.sum(axis=1))[:, None], den


def filter_sections(x: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """The recursive filter along the last axis of (epochs, times), sections one after the other. The state of a
    section is one pair of numbers for each epoch, and starts as if the first sample had gone on for ever."""
    y = np.array(x, dtype=float).T  # time first: a step works on one contiguous row of epochs
    for b, a in zip(num, den):
        gain = b.sum() / a.sum()
        s1 = (gain - b[0]) * y[0]
        s2 = (b[2] - a[2] * gain) * y[0]
        for t in range(len(y)):
            u = y[t].copy()
            v = b[0] * u + s1
            s1 = b[1] * u - a[1] * v + s2
            s2 = b[2] * u - a[2] * v
            y[t] = v
    return y.T


def band_stop(x: np.ndarray, fs: float, lo: float, hi: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band stop of the last axis: the filter forwards and backwards, over the epoch with
    both ends continued by their reflection through the end point."""
    num, den = butterworth_stop(float(fs), float(lo), float(hi), order)
    x = np.atleast_2d(x)
    pad = min(3 * (2 * order + 1), x.shape[1] - 1)
    front = 2 * x[:, :1] - x[:, pad:0:-1]
    back = 2 * x[:, -1:] - x[:, -2:-pad - 2:-1]
    y = filter_sections(np.concatenate([front, x, back], axis=1), num, den)
    y = filter_sections(y[:, ::-1], num, den)[:, ::-1]
    return y[:, pad:y.shape[1] - pad]


def resample(x: np.ndarray, fs: float, fs_out: float) -> np.ndarray:
    """T4: the last axis at another rate, in the Fourier domain: the spectrum is cut off or continued with zeros at
    the lower Nyquist frequency. n samples become round(n * fs_out / fs)."""
    n = x.shape[-1]
    n_out = max(1, round(n * fs_out / fs))
    if n == n_out:
        return x
    spec = np.fft.rfft(x, axis=-1)
    out = np.zeros((*spec.shape[:-1], n_out // 2 + 1), dtype=complex)
    k = min(out.shape[-1], spec.shape[-1])
    out[..., :k] = spec[..., :k]
    even = min(n, n_out)
    if even % 2 == 0:  # the shared Nyquist bin stands for both signs in one of the two spectra
        out[..., even // 2] *= 0.5 if n_out > n else 2.0
        if n_out < n:
            out[..., even // 2] = out[..., even // 2].real
    return np.fft.irfft(out, n=n_out, axis=-1) * (n_out / n)


def _next_fast_len(n: int) -> int:
    """Smallest 2^a 3^b 5^c >= n (fast FFT sizes)."""
    best = 1 << (n - 1).bit_length()
    p5 = 1
    while p5 < best:
        p35 = p5
        while p35 < best:
            q = p35
            while q < n:
                q *= 2
            best = min(best, q)
            p35 *= 3
        p5 *= 5
    return best


def _wavelets(fs: float, freqs: np.ndarray, width: float) -> list[tuple[np.ndarray, int]]:
    out = []
    for f in freqs:
        st = width / (2 * np.pi * f)
        half = int(np.ceil(3.5 * st * fs))
        t = np.arange(-half, half + 1) / fs
        w = np.exp(2j * np.pi * f * t) * np.exp(-t ** 2 / (2 * st ** 2))
        out.append((w / np.sqrt(np.sum(np.abs(w) ** 2)), half))
    return out


def morlet_power(x: np.ndarray, fs: float, freqs: np.ndarray, width: float = 5.0,
                 chunk: int = 256) -> np.ndarray:
    """T5: Morlet wavelet power, shape (n_epochs, n_freqs, n_times), by FFT convolution.

    The wavelet at frequency f has ``width`` cycles: sigma_t = width / (2 pi f); it is
    normalised to unit energy. One forward FFT per epoch serves all frequencies; epochs
    are processed in chunks so memory stays bounded whatever the batch size.
    """
    x = np.atleast_2d(x)
    n_e, n = x.shape
    ws = _wavelets(fs, freqs, width)
    m = _next_fast_len(n + max(len(w) for w, _ in ws) - 1)
    kernels = [(np.fft.fft(w, m), half) for w, half in ws]
    out = np.empty((n_e, len(freqs), n))
    for s0 in range(0, n_e, chunk):
        xf = np.fft.fft(x[s0:s0 + chunk], m, axis=-1)
        for i, (wf, half) in enumerate(kernels):
            conv = np.fft.ifft(xf * wf, axis=-1)
            out[s0:s0 + chunk, i, :] = np.abs(conv[:, half:half + n]) ** 2
    return out


def epoch_log_power(x: np.ndarray, fs: float, freqs: np.ndarray, buffer_s: float, width: float = 5.0,
                    stop: tuple[float, float] | None = (58.0, 62.0), fs_out: float | None = None) -> np.ndarray:
    """Demean -> band stop -> rate ``fs_out`` -> wavelet power -> log10 -> drop buffer -> mean over time.
    ``x`` is (n_epochs, n_times) at rate ``fs``; returns (n_epochs, n_freqs). log10(0) gives NULL later (R13)."""
    x = x - x.mean(axis=-1, keepdims=True)
    if stop is not None and stop[1] < fs / 2:
        x = band_stop(x, fs, *stop)
    rate = fs_out or fs
    x = resample(x, fs, rate)
    with np.errstate(divide="ignore"):
        lp = np.log10(morlet_power(x, rate, freqs, width))
    cut = round(buffer_s * rate)
    return lp[..., cut:lp.shape[-1] - cut].mean(axis=-1)


def epoch_power(epochs: DataFrame, keys: list[str], idx_col: str, val_col: str, rate_col: str, length_s: float, freqs,
                buffer_s: float, fs_out: float, width: float = 5.0, stop: tuple[float, float] | None = (58.0, 62.0)) -> DataFrame:
    """Spark wrapper: rows (keys, sample indices, sample values, sampling rate) of one epoch each - a sparse grid of
    ``length_s`` seconds, both ends included - -> (keys, freq_index, frequency, power). Sessions may differ in rate:
    epochs of one rate are transformed together and meet at ``fs_out``."""
    freqs = np.asarray(freqs, dtype=float)
    schema = ", ".join(f"`{k}` {epochs.schema[k].dataType.simpleString()}" for k in keys) + ", freq_index long, frequency double, power double"

    def transformed(pdf, fs):
        x = np.zeros((len(pdf), round(length_s * fs) + 1))
        for r, (ix, vs) in enumerate(zip(pdf[idx_col], pdf[val_col])):
            x[r, np.asarray(ix, dtype=np.int64)] = np.asarray(vs, dtype=float)
        pw = epoch_log_power(x, fs, freqs, buffer_s, width, stop, fs_out)
        n_e, n_f = pw.shape
        out = pd.DataFrame({k: np.repeat(pdf[k].to_numpy(), n_f) for k in keys} | {
            "freq_index": np.tile(np.arange(n_f, dtype=np.int64), n_e),
            "frequency": np.tile(freqs, n_e),
            "power": pw.reshape(-1),
        })
        out.loc[~np.isfinite(out["power"]), "power"] = np.nan
        return out

    def body(batches):
        for whole in batches:
            for fs, pdf in whole.groupby(rate_col):
                # a few epochs at a time: the power of all of a batch at every frequency and time would be gigabytes
                for at in range(0, len(pdf), EPOCHS_AT_ONCE):
                    yield transformed(pdf.iloc[at:at + EPOCHS_AT_ONCE], float(fs))

    # the body is CPU-heavy per row while its input is small in bytes, so AQE would pack it into very few partitions;
    # a round-robin deal of the configured count keeps epochs, which are independent, apart
    n_parts = int(epochs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    res = epochs.select(*keys, idx_col, val_col, rate_col).repartition(n_parts).mapInPandas(body, schema)
    return res.withColumn("power", F.when(~F.isnan("power"), F.col("power")))


def logspace_freqs(lo: float, hi: float, n: int) -> np.ndarray:
    return np.logspace(np.log10(lo), np.log10(hi), n)
