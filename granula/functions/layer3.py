"""Frame-local coding of Layer III in numpy: side info, scalefactors, Huffman, stereo, hybrid and polyphase filterbanks.

Everything works on one frame or one granule with its predecessor; `operators.codec` lays it out over Spark. Analytic mode: float64
kernels from their formulas. The polyphase prototype is a Kaiser design of 512 taps unless the standard's table is given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from granula.functions import huffman
from granula.functions import tables as T

# Fixed values of the published standard: band widths by (MPEG-1?, rate index); MPEG-2.5 at 11.025 and 12 kHz uses the 22.05 kHz row.
_L22 = [6, 6, 6, 6, 6, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 38, 46, 52, 60, 68, 58, 54]
LONG = {44100: T.LONG_BANDS[44100], 48000: T.LONG_BANDS[48000], 32000: T.LONG_BANDS[32000], 22050: _L22, 24000: [6, 6, 6, 6, 6, 6, 8, 10, 12, 14, 16, 18, 22, 26, 32, 38, 46, 54, 62, 70, 76, 36], 16000: _L22, 11025: _L22, 12000: _L22, 8000: [12, 12, 12, 12, 12, 12, 16, 20, 24, 28, 32, 40, 48, 56, 64, 76, 90, 2, 2, 2, 2, 2]}
_S22 = [4, 4, 4, 6, 8, 10, 12, 14, 18, 24, 30, 40, 18]
_S16 = [4, 4, 4, 6, 8, 10, 12, 14, 18, 24, 30, 40, 18]
SHORT = {44100: [4, 4, 4, 4, 6, 8, 10, 12, 14, 18, 22, 30, 56], 48000: [4, 4, 4, 4, 6, 6, 10, 12, 14, 16, 20, 26, 66], 32000: [4, 4, 4, 4, 6, 8, 12, 16, 20, 26, 34, 42, 12], 22050: [4, 4, 4, 6, 6, 8, 10, 14, 18, 26, 32, 42, 18], 24000: [4, 4, 4, 6, 8, 10, 12, 14, 18, 24, 32, 44, 12], 16000: _S16, 11025: _S22, 12000: _S22, 8000: [8, 8, 8, 12, 16, 20, 24, 28, 36, 2, 2, 2, 26]}
#: MPEG-2 scalefactor counts of the four groups: by branch, for long, short and mixed blocks.
LSF_COUNTS = [[(6, 5, 5, 5), (9, 9, 9, 9), (6, 9, 9, 9)], [(6, 5, 7, 3), (9, 9, 12, 6), (6, 9, 12, 6)], [(11, 10, 0, 0), (18, 18, 0, 0), (15, 18, 0, 0)], [(7, 7, 7, 0), (12, 12, 12, 0), (6, 15, 12, 0)], [(6, 6, 6, 3), (12, 9, 9, 6), (6, 12, 9, 6)], [(8, 8, 5, 0), (15, 12, 9, 0), (6, 18, 9, 0)]]


class Bits:
    """Most significant bit first; past the end it reads zeros and remembers."""

    def __init__(self, data: bytes):
        self.s, self.pos = bin(int.from_bytes(b"\1" + data, "big"))[3:], 0

    def get(self, n: int) -> int:
        part = self.s[self.pos : self.pos + n]
        self.pos += n
        return int(part.ljust(n, "0"), 2) if n else 0

    @property
    def overrun(self) -> bool:
        return self.pos > len(self.s)


@dataclass
class Header:
    mpeg1: bool
    version: int
    layer: int
    kbps: int
    hz: int
    padding: int
    crc: bool
    mode: int
    ext: int
    samples: int
    size: int  # 0: free format

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2


def header(h: bytes) -> Header | None:
    """The header of four bytes, or None."""
    if len(h) < 4 or h[0] != 0xFF or not ((h[1] & 0xF0) == 0xF0 or (h[1] & 0xFE) == 0xE2):
        return None
    layer_bits, index, rate = (h[1] >> 1) & 3, h[2] >> 4, (h[2] >> 2) & 3
    if not layer_bits or index == 15 or rate == 3:
        return None
    version, mpeg1, layer = (h[1] >> 3) & 3, bool(h[1] & 8), 4 - layer_bits
    kbps = T.BITRATES[(int(mpeg1), layer)][index]
    hz = T.RATES[rate] // {3: 1, 2: 2}.get(version, 4)
    samples = 384 if layer == 1 else 576 if layer == 3 and not mpeg1 else 1152
    padding = (h[2] >> 1) & 1
    size = samples * kbps * 125 // hz
    size = (size // 4 * 4 + 4 * padding if layer == 1 else size + padding) if kbps else 0
    return Header(mpeg1, version, layer, kbps, hz, padding, not h[1] & 1, h[3] >> 6, (h[3] >> 4) & 3, samples, size)


def side_info(bits: Bits, h: Header) -> tuple[int, list[list[dict]]] | None:
    """(main_data_begin, [granule][channel] fields), or None if malformed."""
    nch, ng = h.channels, 2 if h.mpeg1 else 1
    if h.mpeg1:
        begin = bits.get(9)
        bits.get(5 if nch == 1 else 3)
        reuse = [bits.get(4) for _ in range(nch)]
    else:
        begin = bits.get(8)
        bits.get(nch)
        reuse = [0] * nch
    out = []
    for g in range(ng):
        row = []
        for ch in range(nch):
            f = {"part23": bits.get(12), "big": bits.get(9), "gain": bits.get(8), "scfc": bits.get(4 if h.mpeg1 else 9), "block": 0, "mixed": 0, "sub": (0, 0, 0)}
            if f["big"] > 288:
                return None
            if bits.get(1):
                f["block"], f["mixed"] = bits.get(2), bits.get(1)
                if not f["block"]:
                    return None
                f["tables"] = [bits.get(5), bits.get(5), 0]
                f["sub"] = tuple(bits.get(3) for _ in range(3))
                f["regions"] = None
            else:
                f["tables"] = [bits.get(5) for _ in range(3)]
                f["regions"] = (bits.get(4), bits.get(3))
            f["preflag"] = bits.get(1) if h.mpeg1 else int(f["scfc"] >= 500)
            f["scale"], f["count1"] = bits.get(1), bits.get(1)
            f["scfsi"] = reuse[ch] if g else 0
            row.append(f)
        out.append(row)
    return None if bits.overrun else (begin, out)


def scalefactors(bits: Bits, h: Header, f: dict, ch: int, before: list[int] | None) -> tuple[list[int], list[int]]:
    """(scalefactors, illegal intensity position marks) of one granule-channel, long bands first, then windows of short bands."""
    short = f["block"] == 2
    if h.mpeg1:
        s1, s2 = T.SLEN[f["scfc"]]
        if short:
            counts = [(17, s1), (18, s2)] if f["mixed"] else [(18, s1), (18, s2)]
            return [bits.get(s) for n, s in counts for _ in range(n)] + [0] * 3, []
        out = []
        for g, (a, b) in enumerate(T.SCFSI_GROUPS):
            if before is not None and f["scfsi"] & (8 >> g):
                out += before[a:b]
            else:
                out += [bits.get(s1 if g < 2 else s2) for _ in range(b - a)]
        return [*out, 0], []
    intensity = ch == 1 and h.mode == 1 and h.ext & 1
    s = f["scfc"]
    if not intensity:
        branch, lens = (0, ((s >> 4) // 5, (s >> 4) % 5, (s % 16) >> 2, s % 4)) if s < 400 else (1, (((s - 400) >> 2) // 5, ((s - 400) >> 2) % 5, (s - 400) % 4, 0)) if s < 500 else (2, ((s - 500) // 3, (s - 500) % 3, 0, 0))
    else:
        s >>= 1
        branch, lens = (3, (s // 36, s % 36 // 6, s % 6, 0)) if s < 180 else (4, (((s - 180) & 63) >> 4, ((s - 180) & 15) >> 2, (s - 180) & 3, 0)) if s < 244 else (5, ((s - 244) // 3, (s - 244) % 3, 0, 0))
    counts = LSF_COUNTS[branch][(2 if f["mixed"] else 1) if short else 0]
    values, marks = [], []
    for n, width in zip(counts, lens, strict=True):
        for _ in range(n):
            values.append(bits.get(width))
            marks.append(int(width > 0 and values[-1] == (1 << width) - 1))
    return values + [0] * 3, marks + [0] * 3


class CodebookMissing(ValueError):
    pass


def spectrum(bits: Bits, f: dict, end: int, hz: int, books: str | None) -> np.ndarray:
    """The 576 quantised values: three regions of pairs, then quads until the granule's bits end."""
    out, inverse = np.zeros(576, dtype=np.int64), huffman.inverse(books)
    edges = np.concatenate(([0], np.cumsum(LONG[hz])))
    if f["regions"] is None:
        first = 36 if f["block"] == 2 and not f["mixed"] and hz != 8000 else 72 if f["block"] == 2 and hz == 8000 else int(edges[8])
        bounds = [first, 576, 576]
    else:
        a = min(f["regions"][0] + 1, 22)
        bounds = [int(edges[a]), int(edges[min(a + f["regions"][1] + 1, 22)]), 576]
    big, at = min(2 * f["big"], 576), 0
    s = bits.s
    for table, bound in zip(f["tables"], bounds, strict=True):
        stop = min(bound, big)
        if at < stop and table and table not in inverse:
            raise CodebookMissing(table)
        codes, lin = inverse.get(table, {}), huffman.LINBITS.get(table, 0)
        while at < stop:
            if table:
                n = 1
                while (xy := codes.get(s[bits.pos : bits.pos + n])) is None:
                    n += 1
                    if n > 20:
                        return out
                bits.pos += n
                for v in xy:
                    if v == 15 and lin:
                        v += bits.get(lin)
                    if v:
                        out[at] = -v if bits.get(1) else v
                    at += 1
            else:
                at += 2
    codes = huffman.quads()[1]
    while at + 4 <= 576 and bits.pos < end:
        if f["count1"]:
            index = 15 - bits.get(4)
        else:
            n = 1
            while (index := codes.get(s[bits.pos : bits.pos + n])) is None and n < 7:
                n += 1
            if index is None:
                break
            bits.pos += n
        values = [(-1 if bits.get(1) else 1) if index & (8 >> i) else 0 for i in range(4)]
        if bits.pos > end:
            break
        out[at : at + 4] = values
        at += 4
    return out


@lru_cache(maxsize=64)
def layout(hz: int, block: int, mixed: int, mpeg1: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: scalefactor index, window (-1 long), long band (or -1)."""
    index, window, band = [], [], []
    n_long = 22 if block != 2 else ((8 if mpeg1 else 6) if mixed else 0)
    for b in range(n_long):
        index += [b] * LONG[hz][b]
        window += [-1] * LONG[hz][b]
        band += [b] * LONG[hz][b]
    if block == 2:
        k = n_long
        for b in range(3 if mixed else 0, 13):
            for w in range(3):
                index += [k] * SHORT[hz][b]
                window += [w] * SHORT[hz][b]
                band += [-1] * SHORT[hz][b]
                k += 1
    return np.array(index[:576]), np.array(window[:576]), np.array(band[:576])


def dequantise(ix: np.ndarray, scf: list[int], f: dict, h: Header) -> np.ndarray:
    index, window, band = layout(h.hz, f["block"], f["mixed"], h.mpeg1)
    scale = 2 * (f["scale"] + 1)
    scf_of = np.array(scf + [0] * 40)[index]
    if f["preflag"] and f["block"] != 2:
        scf_of = scf_of + np.where(band >= 0, np.array([*T.PRETAB, 0])[np.clip(band, 0, 21)], 0)
    quarters = f["gain"] - 210 - scale * scf_of - 8 * np.where(window >= 0, np.array(f["sub"])[np.clip(window, 0, 2)], 0)
    return np.sign(ix) * np.abs(ix) ** (4 / 3) * 2.0 ** (quarters / 4)


def stereo(left: np.ndarray, right: np.ndarray, h: Header, f: dict, scf: list[int], marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Intensity above the right channel's top band, mid/side where its bit is set."""
    ms = h.mode == 1 and bool(h.ext & 2)
    l, r = (((left + right), (left - right)) if ms else (left.copy(), right.copy()))
    l, r = (l / 2**0.5, r / 2**0.5) if ms else (l, r)
    if h.mode == 1 and h.ext & 1:
        index, window, _ = layout(h.hz, f["block"], f["mixed"], h.mpeg1)
        last = index.max()
        used = np.unique(index[right != 0])
        lanes = 3 if f["block"] == 2 else 1
        for b in range(last + 1):
            lines = index == b
            top = max((u for u in used if lanes == 1 or (u - last) % 3 == (b - last) % 3), default=-1)
            if b <= top:
                continue
            source = b if b + lanes <= last else b - lanes
            pos = scf[source] if source < len(scf) else 0
            if (h.mpeg1 and pos >= 7) or (not h.mpeg1 and source < len(marks) and marks[source]):
                continue
            if h.mpeg1:
                t = np.tan(pos * np.pi / 12) if pos < 6 else 0.0
                kl, kr = (1.0, 0.0) if pos == 6 else (t / (1 + t), 1 / (1 + t))
            else:
                k = 2.0 ** (-((pos + 1) >> 1) / (2 if f["scfc"] & 1 else 4))
                kl, kr = (k, 1.0) if pos & 1 else (1.0, k)
            l[lines], r[lines] = left[lines] * kl, left[lines] * kr
    return l, r


def reorder(x: np.ndarray, f: dict, hz: int, mpeg1: bool) -> np.ndarray:
    if f["block"] != 2:
        return x
    out, at = x.copy(), sum(LONG[hz][: (8 if mpeg1 else 6)]) if f["mixed"] else 0
    for b in range(3 if f["mixed"] else 0, 13):
        w = SHORT[hz][b]
        out[at : at + 3 * w] = x[at : at + 3 * w].reshape(3, w).T.ravel()
        at += 3 * w
    return out


_CS, _CA = np.array(T.ALIAS_CS), np.array(T.ALIAS_CA)


def antialias(x: np.ndarray, boundaries: int, encode: bool = False) -> np.ndarray:
    out, ca = x.copy(), -_CA if encode else _CA
    for sb in range(1, boundaries + 1):
        up, down = slice(18 * sb, 18 * sb + 8), 18 * sb - 1 - np.arange(8)
        u, d = out[up].copy(), out[down].copy()
        out[up], out[down] = u * _CS - d * ca, d * _CS + u * ca
    return out


@lru_cache(maxsize=1)
def windows() -> dict[int, np.ndarray]:
    n, m = np.arange(36), np.arange(12)
    long, short = np.sin(np.pi / 36 * (n + 0.5)), np.sin(np.pi / 12 * (m + 0.5))
    start = np.concatenate((long[:18], np.ones(6), short[6:], np.zeros(6)))
    return {0: long, 1: start, 2: short, 3: start[::-1].copy()}


@lru_cache(maxsize=1)
def cosines() -> tuple[np.ndarray, np.ndarray]:
    n36, k18, n12, k6 = np.arange(36)[:, None], np.arange(18)[None], np.arange(12)[:, None], np.arange(6)[None]
    return np.cos(np.pi / 72 * (2 * n36 + 19) * (2 * k18 + 1)), np.cos(np.pi / 24 * (2 * n12 + 7) * (2 * k6 + 1))


def imdct(x: np.ndarray, block: int, mixed: int, n_long: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(head, tail), both [32, 18]: windowed samples before overlap-add."""
    c36, c12 = cosines()
    out, bands = np.empty((32, 36)), x.reshape(32, 18)
    for lo, hi, kind in ((0, n_long if mixed else 0, 0), (n_long if mixed else 0, 32, block)):
        part = bands[lo:hi]
        if kind != 2:
            out[lo:hi] = part @ c36.T * windows()[kind]
        else:
            y = np.zeros((hi - lo, 36))
            for w in range(3):
                y[:, 6 + 6 * w : 18 + 6 * w] += part[:, w::3] @ c12.T * windows()[2]
            out[lo:hi] = y
    return out[:, :18], out[:, 18:]


def mdct(previous: np.ndarray, current: np.ndarray) -> np.ndarray:
    """[32, 18] and [32, 18] samples to 576 long-block lines."""
    return (np.concatenate((previous, current), axis=1) * windows()[0] @ cosines()[0] / 9).ravel()


@lru_cache(maxsize=1)
def prototype() -> np.ndarray:
    """512 analysis window values: a Kaiser low-pass whose cutoff makes neighbouring bands sum to one power, odd blocks negated."""
    n = np.arange(512) - 256.0

    def design(cut: float) -> np.ndarray:
        return np.sinc(n * cut) * cut * np.kaiser(513, 9.6)[:512]

    def ripple(cut: float) -> float:
        h = design(cut)
        auto = np.correlate(h, h, "full")[511:]
        return float(np.abs(auto[64:512:64]).max() / auto[0])

    lo, hi = 0.9 / 64, 1.6 / 64
    for _ in range(4):
        grid = np.linspace(lo, hi, 33)
        best = int(np.argmin([ripple(c) for c in grid]))
        lo, hi = grid[max(0, best - 1)], grid[min(32, best + 1)]
    h = design((lo + hi) / 2)
    h *= np.sqrt(1 / (16 * np.sum(h * h)))
    return h * np.where(np.arange(512) // 64 % 2 == 1, -1.0, 1.0)


@lru_cache(maxsize=4)
def window_table(path: str | None) -> np.ndarray:
    """512 analysis window values: the designed ones, or one number a line from a text file the user has."""
    return prototype() if path is None else np.loadtxt(path)


_ANALYSIS, _SYNTHESIS = np.array(T.matrixing_kernel()), np.array(T.synthesis_kernel())


def analyse(previous: np.ndarray, current: np.ndarray, path: str | None = None) -> np.ndarray:
    """576 samples and the 576 before them to [32, 18] subband samples."""
    x = np.concatenate((previous, current))
    newest_first = np.lib.stride_tricks.sliding_window_view(x, 512)[576 + 31 - 511 :: 32][:18, ::-1]
    y = (newest_first * window_table(path)).reshape(18, 8, 64).sum(axis=1)
    return (y @ _ANALYSIS.T).T


def synthesise(previous: np.ndarray, current: np.ndarray, path: str | None = None) -> np.ndarray:
    """[32, 18] subband samples and those before them to 576 samples."""
    v = np.concatenate((previous, current), axis=1).T @ _SYNTHESIS.T
    d, out = (32 * window_table(path)).reshape(16, 32), np.zeros((18, 32))
    for i in range(16):
        part = v[18 - i : 36 - i]
        out += part[:, :32] * d[i] if i % 2 == 0 else part[:, 32:] * d[i]
    return out.ravel()


def flip(x: np.ndarray) -> np.ndarray:
    """Frequency inversion of [32, 18] samples."""
    out = x.copy()
    out[1::2, 1::2] *= -1
    return out


def cost_and_bits(ix: np.ndarray, hz: int, books: str | None) -> tuple[str, dict] | None:
    """The cheapest coding of 576 values with bounds at bands: (bit string, side info fields); None if a value fits no table."""
    load = huffman.load(books)
    used = int(np.max(np.flatnonzero(ix), initial=-1)) + 1
    used += used % 2
    big = int(np.max(np.flatnonzero(np.abs(ix) > 1), initial=-1)) + 1
    n_quads = (used - big) // 4
    big = used - 4 * n_quads
    edges = np.concatenate(([0], np.cumsum(LONG[hz])))
    inner = int(np.searchsorted(edges, big))  # bands that hold the pairs
    r0 = min(15, max(0, inner // 3 - 1))
    r1 = min(7, max(0, inner // 3 - 1))
    bounds = [0, min(big, int(edges[r0 + 1])), min(big, int(edges[min(22, r0 + r1 + 2)])), big]
    out, tables = [], []
    for a, b in zip(bounds, bounds[1:], strict=False):
        mags, best = np.abs(ix[a:b]).tolist(), None
        if not any(mags):
            tables.append(0)
            continue
        for t, codes in load.items():
            lin = huffman.LINBITS.get(t, 0)
            if t == 0 or max(mags) > (15 + (1 << lin) - 1 if lin else max(x for x, _ in codes)):
                continue
            text = []
            for i in range(0, b - a, 2):
                x, y = mags[i], mags[i + 1]
                text.append(codes[(min(x, 15), min(y, 15))])
                for v, raw in ((x, ix[a + i]), (y, ix[a + i + 1])):
                    if lin and v >= 15:
                        text.append(format(v - 15, f"0{lin}b"))
                    if v:
                        text.append("1" if raw < 0 else "0")
            joined = "".join(text)
            if best is None or len(joined) < len(best[1]):
                best = (t, joined)
        if best is None:
            return None
        tables.append(best[0])
        out.append(best[1])
    quad_codes, options = huffman.quads()[0], {0: [], 1: []}
    for i in range(big, used, 4):
        v = ix[i : i + 4]
        index = sum(8 >> k for k in range(4) if v[k])
        signs = "".join("1" if x < 0 else "0" for x in v if x)
        options[0].append(quad_codes[index] + signs)
        options[1].append(format(15 - index, "04b") + signs)
    joined = {k: "".join(v) for k, v in options.items()}
    count1 = int(len(joined[1]) < len(joined[0]))
    return "".join(out) + joined[count1], {"big": big // 2, "tables": tables, "regions": (r0, r1), "count1": count1}


def quantised(xr: np.ndarray, gain: int, extra: np.ndarray | int = 0) -> np.ndarray:
    """extra: quarter steps of amplification of each line."""
    return (np.sign(xr) * np.minimum(np.floor((np.abs(xr) * 2.0 ** ((210 - gain + extra) / 4)) ** 0.75 + T.ROUNDING), T.MAX_QUANT)).astype(np.int64)


EMPTY = {"big": 0, "tables": [0, 0, 0], "regions": (0, 0), "count1": 0}


def rate_loop(xr: np.ndarray, budget: int, hz: int, books: str | None, extra: np.ndarray | int = 0) -> tuple[str, dict, int]:
    """The least global gain whose coding fits the budget and the codebooks, by bisection; silence if none does."""
    lo, hi, best = 0, 255, None
    while lo <= hi:
        gain = (lo + hi) // 2
        fits = (np.abs(xr) * 2.0 ** ((210 - gain + extra) / 4)).max() ** 0.75 + T.ROUNDING <= T.MAX_QUANT
        coded = cost_and_bits(quantised(xr, gain, extra), hz, books) if fits else None
        if coded is not None and len(coded[0]) <= budget:
            best, hi = (*coded, gain), gain - 1
        else:
            lo = gain + 1
    return best or ("", dict(EMPTY), 210)


def amplification(scf: np.ndarray, scale: int, preflag: int, hz: int) -> np.ndarray:
    """Quarter steps of every line; band 21 has none."""
    per = 2 * (scale + 1) * (scf + preflag * np.array(T.PRETAB))
    return np.repeat(np.append(per, 0), LONG[hz])


def scalefac_slot(scf: np.ndarray, reuse: int = 0) -> tuple[int, int] | None:
    """(bits, slot) of the cheapest length pair that holds the groups not reused."""
    groups = [(g, a, b) for g, (a, b) in enumerate(T.SCFSI_GROUPS) if not reuse & (8 >> g)]
    best = None
    for slot, (s1, s2) in enumerate(T.SLEN):
        if all(scf[a:b].max() < 1 << (s1 if g < 2 else s2) for g, a, b in groups):
            bits = sum((b - a) * (s1 if g < 2 else s2) for g, a, b in groups)
            best = min(best or (bits, slot), (bits, slot))
    return best


def noise_metrics(xr: np.ndarray, ix: np.ndarray, gain: int, extra: np.ndarray, xmin: np.ndarray, hz: int) -> tuple[tuple[float, float, int], np.ndarray]:
    """((excess, greatest ratio, bands over), noise over xmin of every band)."""
    error = np.abs(xr) - np.abs(ix) ** (4 / 3) * 2.0 ** ((gain - 210 - extra) / 4)
    noise = np.bincount(np.repeat(np.arange(22), LONG[hz]), error**2, minlength=22)
    ratio = noise / np.maximum(xmin, 1e-300)
    over = noise > xmin
    return (float((noise - xmin)[over].sum()), float(ratio[over].max(initial=0)), int(over.sum())), ratio


def distortion_loop(xr: np.ndarray, xmin: np.ndarray, budget: int, hz: int, books: str | None, rounds: int = 150) -> tuple[str, dict, int, np.ndarray, int, int]:
    """Amplifies the worst violating band by one step until none is left, none can be helped, or the rounds are over; the best pass by (excess, ratio, over) wins.

    When a scalefactor is at its limit the coarser scale is tried once, then the band counts as beyond help. The pretab is taken
    over once every high band has at least its amount.
    """
    scf, scale, preflag, helpless, best = np.zeros(21, dtype=int), 0, 0, set(), None
    limit, pretab = np.array([15] * 11 + [7] * 10), np.array(T.PRETAB)
    for _ in range(rounds):
        slot = scalefac_slot(scf)
        if slot is None or slot[0] > budget:
            break
        extra = amplification(scf, scale, preflag, hz)
        bits, fields, gain = rate_loop(xr, budget - slot[0], hz, books, extra)
        metric, ratio = noise_metrics(xr, quantised(xr, gain, extra), gain, extra, xmin, hz)
        if best is None or metric < best[0]:
            best = (metric, bits, fields, gain, scf.copy(), scale, preflag)
        bad = [b for b in range(21) if ratio[b] > 1 and b not in helpless]
        if not bad:
            break
        worst = max(bad, key=lambda b: (ratio[b], -b))
        if scf[worst] < limit[worst]:
            scf[worst] += 1
        elif not scale:
            scale, scf = 1, (scf + 1) // 2
        else:
            helpless.add(worst)
        if not preflag and (scf[11:] >= pretab[11:]).all():
            preflag, scf = 1, scf - pretab
    if best is None:
        return "", dict(EMPTY), 210, np.zeros(21, dtype=int), 0, 0
    return best[1:]


def encode_frame(spectra: list[list[np.ndarray]], hz: int, kbps: int, padding: int, ms: bool, books: str | None, xmin: list[list[np.ndarray]] | None = None, rounds: int = 150) -> bytes:
    """One MPEG-1 frame from [granule][channel] lines; its main data begins and ends in the frame.

    xmin: allowed noise of the 22 bands, which turns the distortion loop on. Equal scalefactor groups of the second granule are
    reused (scfsi).
    """
    nch = len(spectra[0])
    size = 144000 * kbps // hz + padding
    side = 17 if nch == 1 else 32
    budget = min(T.MAX_PART23, (size - 4 - side) * 8 // (2 * nch))
    coded, reuse = [], [0] * nch
    for g, row in enumerate(spectra):
        coded.append([])
        for ch, x in enumerate(row):
            if xmin is None or not np.any(x):
                made = (*rate_loop(x, budget, hz, books), np.zeros(21, dtype=int), 0, 0)
            else:
                made = distortion_loop(x, xmin[g][ch], budget, hz, books, rounds)
            scf = made[3]
            if g and made[4:] == coded[0][ch][4:6]:
                reuse[ch] = sum(8 >> k for k, (a, b) in enumerate(T.SCFSI_GROUPS) if (scf[a:b] == coded[0][ch][3][a:b]).all())
            _, slot = scalefac_slot(scf, reuse[ch] if g else 0) or (0, 0)
            lens = T.SLEN[slot]
            part2 = "".join(format(int(v), f"0{n}b") for k, (a, b) in enumerate(T.SCFSI_GROUPS) if not (g and reuse[ch] & (8 >> k)) for v in scf[a:b] for n in [lens[k // 2]] if n)
            coded[g].append((*made, slot, part2))
    mode = 3 if nch == 1 else 1
    head = bytes([0xFF, 0xFB, (T.BITRATES[(1, 3)].index(kbps) << 4) | (T.RATES.index(hz) << 2) | (padding << 1), (mode << 6) | ((2 if ms else 0) << 4) | 4])
    text = [format(0, "09b"), "0" * (5 if nch == 1 else 3), *[format(r, "04b") for r in reuse]]
    for row in coded:
        for bits, f, gain, _, scale, preflag, slot, part2 in row:
            text += [format(len(part2) + len(bits), "012b"), format(f["big"], "09b"), format(gain, "08b"), format(slot, "04b"), "0", *[format(t, "05b") for t in f["tables"]], format(f["regions"][0], "04b"), format(f["regions"][1], "03b"), str(preflag), str(scale), str(f["count1"])]
    text += [part2 + bits for row in coded for bits, *_, part2 in row]
    body = "".join(text)
    return (head + int("1" + body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8) + 1, "big")[1:]).ljust(size, b"\0")
