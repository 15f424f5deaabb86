"""NumPy kernels used inside Arrow batches: filter responses and per-window features.

Everything works on stacks of windows (n, samples, channels) or on one chunk of a channel, so a
call costs a few vector operations per batch rather than per row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sinew.constants import (
    CROSS_SPECTRUM_BANDS,
    FFT_SIZE,
    POWER_BANDS,
    RATE_HZ,
    SSC_SHARE,
    ZC_SHARE,
)

# ----------------------------------------------------------------------------- filter design


def butterworth(order: int, edges: float | tuple[float, float], kind: str, rate: float = RATE_HZ):
    """Zeros, poles and gain of a digital Butterworth filter (bilinear transform, prewarped)."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    zeros = np.zeros(0, dtype=complex)
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if kind == "low":
        w = warp(edges)
        poles, gain = poles * w, w**order
    elif kind == "high":
        w = warp(edges)
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = w / poles, np.zeros(order, dtype=complex)
    elif kind == "band":
        lo, hi = warp(edges[0]), warp(edges[1])
        width, centre = hi - lo, np.sqrt(lo * hi)
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order, dtype=complex), width**order
    else:
        raise ValueError(kind)
    fs2 = 2.0 * rate
    gain = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    digital_zeros = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(len(poles) - len(zeros))])
    return digital_zeros, (fs2 + poles) / (fs2 - poles), gain


@lru_cache(maxsize=None)
def impulse_response(order: int, edges, kind: str, taps: int) -> np.ndarray:
    """Response to a unit impulse; beyond ``taps`` it is below double precision for the bands used.

    Built section by section from conjugate pole pairs, which stays accurate where the expanded
    polynomial of a higher order would not.
    """
    zeros, poles, gain = butterworth(order, edges, kind)
    upper = sorted((p for p in poles if p.imag > 0), key=abs)
    remaining = sorted(zeros, key=lambda z: z.real)
    out = np.zeros(taps)
    out[0] = gain
    for n, p in enumerate(upper):
        # Alternate ends so a band-pass section gets one kind of zero pair.
        pair = [remaining.pop(0), remaining.pop(0)] if n % 2 == 0 else [remaining.pop(), remaining.pop()]
        b = np.real(np.poly(pair))
        a = np.real(np.poly([p, np.conj(p)]))
        nxt = np.zeros(taps)
        for t in range(taps):
            acc = b[0] * out[t]
            if t >= 1:
                acc += b[1] * out[t - 1] - a[1] * nxt[t - 1]
            if t >= 2:
                acc += b[2] * out[t - 2] - a[2] * nxt[t - 2]
            nxt[t] = acc
        out = nxt
    return out


BANDPASS = (2, (20.0, 450.0), "band")
BANDPASS_TAPS = 400
HIGHPASS_20 = (2, 20.0, "high")
LOWPASS_10 = (2, 10.0, "low")
BANDPASS_4 = (4, (20.0, 450.0), "band")


@lru_cache(maxsize=None)
def window_filter(samples: int) -> np.ndarray:
    """Lower-triangular matrix that applies the zero-state band-pass to a window."""
    h = impulse_response(*BANDPASS, samples)
    lag = np.subtract.outer(np.arange(samples), np.arange(samples))
    return np.where(lag >= 0, h[np.clip(lag, 0, None)], 0.0)


def bandpass_windows(x: np.ndarray) -> np.ndarray:
    """Causal band-pass seeded at each window's first sample; x is (n, samples, channels).

    The filter passes no DC, so seeding with the first sample's steady state equals filtering the
    difference to that sample from rest.
    """
    return np.einsum("ts,nsc->ntc", window_filter(x.shape[1]), x - x[:, :1, :], optimize=True)


def convolve_causal(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """First len(x) values of x * h along axis 0 by FFT; x is (samples, channels)."""
    size = 1 << int(len(x) + len(h) - 1).bit_length()
    spectrum = np.fft.rfft(x, size, axis=0) * np.fft.rfft(h, size)[:, None]
    return np.fft.irfft(spectrum, size, axis=0)[: len(x)]


def _seeded(x: np.ndarray, h: np.ndarray, dc: float) -> np.ndarray:
    return convolve_causal(x - x[:1], h) + dc * x[:1]


def zero_phase(x: np.ndarray, design: tuple, taps: int, pad: int, at_start: bool, at_end: bool) -> np.ndarray:
    """Forward-backward filter of one stretch; ``pad`` samples of odd extension at session ends.

    Inside a session the stretch carries a halo instead, so no extension is added there. A stretch
    of no more samples than that is extended by what it has.
    """
    pad = min(pad, len(x) - 1)
    h = impulse_response(*design, taps)
    dc = {"low": 1.0}.get(design[2], 0.0)
    parts = [x]
    lead = pad if at_start else 0
    if at_start:
        parts.insert(0, 2 * x[:1] - x[pad:0:-1])
    if at_end:
        parts.append(2 * x[-1:] - x[::-1][1 : pad + 1])
    extended = np.concatenate(parts)
    forward = _seeded(extended, h, dc)
    backward = _seeded(forward[::-1], h, dc)[::-1]
    return backward[lead : lead + len(x)]


# ------------------------------------------------------------------------------- window views


def sliding(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Complete windows of a (samples, channels) stretch as (n, size, channels), without copying."""
    if len(x) < size:
        return np.empty((0, size, x.shape[1]))
    view = np.lib.stride_tricks.sliding_window_view(x, size, axis=0)[::hop]
    return np.moveaxis(view, -1, 1)


# ----------------------------------------------------------------------------------- features


def remove_dc(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=1, keepdims=True)


def tone_map(x: np.ndarray) -> np.ndarray:
    return 64.0 * x / (32.0 + np.abs(x))


def autoregression(x: np.ndarray, order: int = 4) -> np.ndarray:
    """Yule-Walker coefficients per window and channel, zeros where the system is singular."""
    n = x.shape[1]
    r = np.stack([np.einsum("nsc,nsc->nc", x[:, : n - k], x[:, k:]) / n for k in range(order + 1)], axis=-1)
    lags = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    system, rhs = r[..., lags], r[..., 1:, None]
    usable = np.linalg.matrix_rank(system) == order
    system = np.where(usable[..., None, None], system, np.eye(order))
    return np.where(usable[..., None], np.linalg.solve(system, rhs)[..., 0], 0.0)


def power_spectrum(x: np.ndarray, size: int = FFT_SIZE) -> np.ndarray:
    return np.abs(np.fft.rfft(x, n=size, axis=1)) ** 2


def spectral_summary(x: np.ndarray) -> np.ndarray:
    """mnf, mdf, pkf, mnp, bp0..bp3 per window and channel, last axis 8."""
    spec = power_spectrum(x)
    freqs = np.fft.rfftfreq(FFT_SIZE, d=1.0 / RATE_HZ)
    total = spec.sum(axis=1) + 1e-10
    bins = spec.shape[1]
    mnf = np.einsum("f,nfc->nc", freqs, spec) / total
    below = (np.cumsum(spec, axis=1) < total[:, None, :] / 2).sum(axis=1)
    mdf = freqs[np.minimum(below, bins - 1)]
    pkf = freqs[spec.argmax(axis=1)]
    bands = [spec[:, (freqs >= lo) & (freqs < hi)].sum(axis=1) / total for lo, hi in POWER_BANDS]
    return np.stack([mnf, mdf, pkf, total / bins, *bands], axis=-1)


def basic_features(x: np.ndarray, zc_threshold=None, ssc_threshold=None) -> dict[str, np.ndarray]:
    """rms, wl, zc, ssc of prepared windows; thresholds default to the window's own RMS share."""
    rms = np.sqrt((x**2).mean(axis=1))
    zc_threshold = ZC_SHARE * rms if zc_threshold is None else zc_threshold
    ssc_threshold = (SSC_SHARE * rms) ** 2 if ssc_threshold is None else ssc_threshold
    steps = np.diff(x, axis=1)
    size = np.abs(steps)
    big = size > np.asarray(zc_threshold)[:, None, :]
    turn = (x[:, 1:-1] - x[:, :-2]) * (x[:, 1:-1] - x[:, 2:])
    return {
        "rms": rms,
        "wl": size.sum(axis=1),
        "zc": ((x[:, :-1] * x[:, 1:] < 0) & big).sum(axis=1).astype(float),
        "ssc": (turn > np.asarray(ssc_threshold)[:, None, :]).sum(axis=1).astype(float),
        "wamp": big.sum(axis=1).astype(float),
    }


def window_features(x: np.ndarray, *, bandpass=True, reinhard=True, expanded=True, normalize=True,
                    cross_channel=True) -> np.ndarray:
    """Feature vectors (n, d) of raw windows (n, samples, channels)."""
    n, samples, channels = x.shape
    if n == 0:
        width = channels * (20 if expanded else 4)
        width += 3 * channels * (channels - 1) // 2 if expanded and cross_channel and channels > 1 else 0
        return np.empty((0, width))
    x = np.asarray(x, dtype=np.float64)
    if bandpass:
        x = bandpass_windows(x)
    x = remove_dc(x)
    if reinhard:
        x = tone_map(x)
    basic = basic_features(x)
    rms = basic["rms"]
    norm = np.maximum(np.sqrt((rms**2).sum(axis=1)), 1e-6) if normalize else np.ones(n)
    scale = norm[:, None]
    columns = [rms / scale, basic["wl"] / scale, basic["zc"], basic["ssc"]]
    if expanded:
        size = np.abs(x)
        columns += [size.mean(axis=1) / scale, x.var(axis=1), size.sum(axis=1) / scale, basic["wamp"]]
        columns += list(np.moveaxis(autoregression(x), -1, 0))
        columns += list(np.moveaxis(spectral_summary(x), -1, 0))
    parts = [np.stack(columns, axis=-1).reshape(n, -1)]
    if expanded and cross_channel and channels >= 2:
        parts.append(cross_features(x, rms, norm))
    return np.concatenate(parts, axis=1)


def cross_features(x: np.ndarray, rms: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """corr, lrms, cov for each channel pair i < j."""
    n, samples, channels = x.shape
    first, second = np.triu_indices(channels, 1)
    gram = np.einsum("nsi,nsj->nij", x, x)[:, first, second] / samples
    ri, rj = rms[:, first] + 1e-10, rms[:, second] + 1e-10
    corr = np.clip(gram / (ri * rj), -1.0, 1.0)
    return np.stack([corr, np.log(ri / rj), gram / norm[:, None] ** 2], axis=-1).reshape(n, -1)


def cross_spectrum_features(x: np.ndarray) -> np.ndarray:
    """Band-wise cross-spectral density of raw windows, upper triangle, log power on the diagonal."""
    n, samples, channels = x.shape
    freqs = np.fft.rfftfreq(samples, d=1.0 / RATE_HZ)
    spectrum = np.fft.rfft(np.asarray(x, dtype=np.float64), axis=1)
    rows, cols = np.triu_indices(channels)
    out = []
    for lo, hi in CROSS_SPECTRUM_BANDS:
        inside = (freqs >= lo) & (freqs < hi)
        if not inside.any():
            out.append(np.zeros((n, len(rows))))
            continue
        band = spectrum[:, inside]
        csd = np.einsum("nfi,nfj->nij", band.conj(), band).real / samples
        values = csd[:, rows, cols]
        diagonal = rows == cols
        values[:, diagonal] = np.log(np.maximum(values[:, diagonal], 1e-10))
        out.append(values)
    return np.concatenate(out, axis=1)
