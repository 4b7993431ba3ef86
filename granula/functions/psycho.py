"""Psychoacoustic thresholds of one granule from its window and the two before it, numpy, all tables from their formulas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from granula.functions.layer3 import LONG

WINDOW, HOP = 1024, 576
TMN_DB, NMT_DB = 15.5, 5.5


def bark(f: np.ndarray) -> np.ndarray:
    return 13 * np.arctan(0.00076 * f) + 3.5 * np.arctan((f / 7500) ** 2)


def hearing_db(f: np.ndarray) -> np.ndarray:
    """Threshold in quiet, capped at 70."""
    k = f / 1000
    return np.minimum(70, 3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4)


@dataclass(frozen=True)
class Tables:
    of_line: np.ndarray
    of_mdct: np.ndarray
    lines: np.ndarray
    mdct_lines: np.ndarray
    spread: np.ndarray
    norm: np.ndarray
    quiet: np.ndarray


@lru_cache(maxsize=8)
def tables(hz: int) -> Tables:
    f = np.maximum(np.arange(513), 0.5) * hz / WINDOW
    z = bark(f)
    of_line, first, part = np.zeros(513, dtype=int), z[0], 0
    for i in range(513):
        if z[i] - first > 1 / 3:
            part, first = part + 1, z[i]
        of_line[i] = part
    n = part + 1
    of_mdct = of_line[np.minimum(512, ((np.arange(576) + 0.5) * 1024 / 1152 + 0.5).astype(int))]
    value = np.array([(z[of_line == b][0] + z[of_line == b][-1]) / 2 for b in range(n)])
    dz = value[:, None] - value[None, :]
    t = dz - 0.5
    db = 15.811389 + 7.5 * (dz + 0.474) - 17.5 * np.sqrt(1 + (dz + 0.474) ** 2) + np.where((dz >= 0.5) & (dz <= 2.5), 8 * np.minimum(t * t - 2 * t, 0), 0)
    spread = np.where(db <= -100, 0, 10 ** (db / 10))
    full = (hann().sum() / 2) ** 2
    quiet = np.array([np.sum(full * 10 ** ((hearing_db(f[of_line == b]) - 96) / 10)) for b in range(n)])
    count = lambda x: np.maximum(np.bincount(x, minlength=n), 1)
    return Tables(of_line, of_mdct, count(of_line), count(of_mdct), spread, 1 / spread.sum(axis=1), quiet)


@lru_cache(maxsize=1)
def hann() -> np.ndarray:
    return np.sqrt(8 / 3) * 0.5 * (1 - np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW))


def unpredictability(now: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Distance from the extrapolated spectrum, 0 to 1; 1 without history."""
    r, r1, r2 = np.abs(now), np.abs(last), np.abs(before)
    rp = 2 * r1 - r2
    known = (r1 > 0) & (r2 > 0) & ((r > 0) | (rp != 0))
    phase = np.where(known, last / np.where(r1 > 0, r1, 1), 0) ** 2 * np.conj(np.where(known, before / np.where(r2 > 0, r2, 1), 1))
    return np.where(known, np.minimum(1, np.abs(now - rp * phase) / np.where(known, r + np.abs(rp), 1)), 1.0)


def raw_thresholds(history: np.ndarray, hz: int) -> tuple[np.ndarray, np.ndarray]:
    """(threshold before the pre-echo cap, energy) of every partition. history: WINDOW + 2 HOP samples, the newest last."""
    t = tables(hz)
    spectra = [np.fft.rfft(history[i * HOP : i * HOP + WINDOW] * hann()) for i in range(3)]
    power, c = np.abs(spectra[2]) ** 2, unpredictability(spectra[2], spectra[1], spectra[0])
    e, ct = np.bincount(t.of_line, power), np.bincount(t.of_line, power * c)
    ecb, cbs = t.spread @ e, t.spread @ ct
    ratio = np.clip(np.divide(cbs, ecb, out=np.ones_like(cbs), where=ecb > 0), 1e-30, 1)
    tonality = np.where(ecb > 0, np.clip(-0.299 - 0.43 * np.log(ratio), 0, 1), 0)
    snr = tonality * TMN_DB + (1 - tonality) * NMT_DB
    return ecb * t.norm * 10 ** (-snr / 10), e


def capped(raw: np.ndarray, hz: int) -> np.ndarray:
    """Pre-echo control over [granules, partitions]: at most twice the last and 16 times the one before, at least the quiet threshold."""
    out = np.empty_like(raw)
    for i in range(len(raw)):
        out[i] = raw[i]
        for back, factor in ((1, 2.0), (2, 16.0)):
            if i >= back:
                out[i] = np.minimum(out[i], factor * out[i - back])
        out[i] = np.maximum(out[i], tables(hz).quiet)
    return out


def to_bands(threshold: np.ndarray, energy: np.ndarray, hz: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(threshold and energy of the 22 long bands, perceptual entropy in bits)."""
    t = tables(hz)
    band = np.repeat(np.arange(22), LONG[hz])
    x, e = (np.bincount(band, (v / t.mdct_lines)[t.of_mdct], minlength=22) for v in (threshold, energy))
    over = np.maximum(1, energy / threshold)
    return x, e, float(np.sum(t.lines * np.log2(over)))
