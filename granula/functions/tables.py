"""Dimension values of MPEG audio Layer III, and kernels made from their formulas."""

from __future__ import annotations

import math

# Fixed values of the published standard, in their natural order.
#: kbit/s by [MPEG-1?][Layer III, II, I][bitrate index 0-14]
BITRATES = {
    (0, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (0, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (0, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
}
RATES = [44100, 48000, 32000]
#: Scalefactor band widths of long blocks at 44.1, 48 and 32 kHz.
LONG_BANDS = {
    44100: [4, 4, 4, 4, 4, 4, 6, 6, 8, 8, 10, 12, 16, 20, 24, 28, 34, 42, 50, 54, 76, 158],
    48000: [4, 4, 4, 4, 4, 4, 6, 6, 6, 8, 10, 12, 16, 18, 22, 28, 34, 40, 46, 54, 54, 192],
    32000: [4, 4, 4, 4, 4, 4, 6, 6, 8, 10, 12, 16, 20, 24, 30, 38, 46, 56, 68, 84, 102, 26],
}
PRETAB = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2]
#: (slen1, slen2) of scalefac_compress 0-15.
SLEN = [(0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (4, 3)]
#: First and last band + 1 of the four scalefactor groups.
SCFSI_GROUPS = [(0, 6), (6, 11), (11, 16), (16, 21)]
#: Butterfly coefficients c_i of the alias reduction.
ALIAS_C = [-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037]
#: Codeword lengths of count1 table A by presence of (v, w, x, y), v the high bit.
COUNT1_A = [1, 4, 4, 5, 4, 6, 5, 6, 4, 5, 5, 6, 5, 6, 6, 6]
#: Codeword lengths of three small pair tables: table -> rows of x, columns of y.
PAIR_LENGTHS = {
    1: [[1, 3], [2, 3]],
    2: [[1, 3, 6], [3, 3, 5], [5, 5, 6]],
    3: [[2, 2, 6], [3, 2, 5], [5, 5, 6]],
}
MAX_QUANT, QUANT_GAIN_BASE, ROUNDING, MAX_PART23, RESERVOIR = 8206, 214, 0.4054, 4095, 511

ALIAS_CS = [1 / math.sqrt(1 + c * c) for c in ALIAS_C]
ALIAS_CA = [c / math.sqrt(1 + c * c) for c in ALIAS_C]


def band_of_line(rate: int = 44100, lines: int = 576) -> list[int]:
    return [b for b, w in enumerate(LONG_BANDS[rate]) for _ in range(w)][:lines]


def mdct_kernel(n: int = 18) -> list[list[float]]:
    """n x 2n: sine window, cosine, scale 2 / n."""
    return [[2 / n * math.sin(math.pi / (2 * n) * (i + 0.5)) * math.cos(math.pi / (4 * n) * (2 * i + 1 + n) * (2 * k + 1)) for i in range(2 * n)] for k in range(n)]


def imdct_kernel(n: int = 18) -> list[list[float]]:
    """2n x n: the transpose without the scale."""
    return [[math.sin(math.pi / (2 * n) * (i + 0.5)) * math.cos(math.pi / (4 * n) * (2 * i + 1 + n) * (2 * k + 1)) for k in range(n)] for i in range(2 * n)]


def matrixing_kernel() -> list[list[float]]:
    """32 x 64: cosines of the analysis filterbank."""
    return [[math.cos((2 * b + 1) * (j - 16) * math.pi / 64) for j in range(64)] for b in range(32)]


def synthesis_kernel() -> list[list[float]]:
    """64 x 32: cosines of the synthesis filterbank."""
    return [[math.cos((16 + i) * (2 * k + 1) * math.pi / 64) for k in range(32)] for i in range(64)]


def dct2_kernel(n: int = 32) -> list[list[float]]:
    return [[math.cos(math.pi / n * (i + 0.5) * k) for i in range(n)] for k in range(n)]


def dft_kernel(n: int = 64) -> tuple[list[list[float]], list[list[float]]]:
    """Real and imaginary rows of bins 0 to n / 2, under a Hann window of power 8 / 3."""
    w = [math.sqrt(8 / 3) * 0.5 * (1 - math.cos(2 * math.pi * i / n)) for i in range(n)]
    return tuple([[w[i] * f(2 * math.pi * i * k / n) for i in range(n)] for k in range(n // 2 + 1)] for f in (math.cos, lambda x: -math.sin(x)))


def spreading(parts: int) -> list[list[float]]:
    """[b][bb]: the two-slope spreading function over partitions a third of a Bark apart."""
    out = []
    for b in range(parts):
        row = []
        for bb in range(parts):
            dz = (b - bb) / 3
            t = dz - 0.5
            bump = 8 * min(t * t - 2 * t, 0) if 0.5 <= dz <= 2.5 else 0.0
            db = 15.811389 + 7.5 * (dz + 0.474) - 17.5 * math.sqrt(1 + (dz + 0.474) ** 2) + bump
            row.append(0.0 if db <= -100 else 10 ** (db / 10))
        out.append(row)
    return out
