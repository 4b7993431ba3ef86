"""Pair codebooks of the big-values region.

Tables 1 to 12 stand below. Tables 13, 15, 16 and 24 (256 pairs each) are a parameter: a text file that the user has, see `load`.
"""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the published standard, in their natural order: for x from 0 and y from 0, code:length with the code in hex.
SMALL = {
    1: """
        1:1 1:3
        1:2 0:3
    """,
    2: """
        1:1 2:3 1:6
        3:3 1:3 1:5
        3:5 2:5 0:6
    """,
    3: """
        3:2 2:2 1:6
        1:3 1:2 1:5
        3:5 2:5 0:6
    """,
    5: """
        1:1 2:3 6:6 5:7
        3:3 1:3 4:6 4:7
        7:6 5:6 7:7 1:8
        6:7 1:6 1:7 0:8
    """,
    6: """
        7:3 3:3 5:5 1:7
        6:3 2:2 3:4 2:5
        5:4 4:4 4:5 1:6
        3:6 3:5 2:6 0:7
    """,
    7: """
        1:1 2:3 a:6 13:8 10:8 a:9
        3:3 3:4 7:6 a:7 5:7 3:8
        b:6 4:5 d:7 11:8 8:8 4:9
        c:7 b:7 12:8 f:9 b:9 2:9
        7:7 6:7 9:8 e:9 3:9 1:10
        6:8 4:8 5:9 3:10 2:10 0:10
    """,
    8: """
        3:2 4:3 6:6 12:8 c:8 5:9
        5:3 1:2 2:4 10:8 9:8 3:8
        7:6 3:4 5:6 e:8 7:8 3:9
        13:8 11:8 f:8 d:9 a:9 4:10
        d:8 5:7 8:8 b:9 5:10 1:10
        c:9 4:8 4:9 1:9 1:11 0:11
    """,
    9: """
        7:3 5:3 9:5 e:6 f:8 7:9
        6:3 4:3 5:4 5:5 6:6 7:8
        7:4 6:4 8:5 8:6 8:7 5:8
        f:6 6:5 9:6 a:7 5:7 1:8
        b:7 7:6 9:7 6:7 4:8 1:9
        e:8 4:7 6:8 2:8 6:9 0:9
    """,
    10: """
        1:1 2:3 a:6 17:8 23:9 1e:9 c:9 11:10
        3:3 3:4 8:6 c:7 12:8 15:9 c:8 7:8
        b:6 9:6 f:7 15:8 20:9 28:10 13:9 6:9
        e:7 d:7 16:8 22:9 2e:10 17:10 12:9 7:10
        14:8 13:8 21:9 2f:10 1b:10 16:10 9:10 3:10
        1f:9 16:9 29:10 1a:10 15:11 14:11 5:10 3:11
        e:8 d:8 a:9 b:10 10:10 6:10 5:11 1:11
        9:9 8:8 7:9 8:10 4:10 4:11 2:11 0:11
    """,
    11: """
        3:2 4:3 a:5 18:7 22:8 21:9 15:8 f:9
        5:3 3:3 4:4 a:6 20:8 11:8 b:7 a:8
        b:5 7:5 d:6 12:7 1e:8 1f:9 14:8 5:8
        19:7 b:6 13:7 3b:9 1b:8 12:10 c:8 5:9
        23:8 21:8 1f:8 3a:9 1e:9 10:10 7:9 5:10
        1c:8 1a:8 20:9 13:10 11:10 f:11 8:10 e:11
        e:8 c:7 9:7 d:8 e:9 9:10 4:10 1:10
        b:8 4:7 6:8 6:9 6:10 3:10 2:10 0:10
    """,
    12: """
        9:4 6:3 10:5 21:7 29:8 27:9 26:9 1a:9
        7:3 5:3 6:4 9:5 17:7 10:7 1a:8 b:8
        11:5 7:4 b:5 e:6 15:7 1e:8 a:7 7:8
        11:6 a:5 f:6 c:6 12:7 1c:8 e:8 5:8
        20:7 d:6 16:7 13:7 12:8 10:8 9:8 5:9
        28:8 11:7 1f:8 1d:8 11:8 d:9 4:8 2:9
        1b:8 c:7 b:7 f:8 a:8 7:9 4:9 1:10
        1b:9 c:8 8:8 c:9 6:9 3:9 1:9 0:10
    """,
}
#: Codes and lengths of count1 table A by presence of (v, w, x, y), v the high bit. Table B is the four bits' complement.
COUNT1_A = "1:1 5:4 4:4 5:5 6:4 5:6 4:5 4:6 7:4 3:5 6:5 0:6 7:5 2:6 3:6 1:6"
#: Escape bits of tables 16 to 31.
LINBITS = dict(zip(range(16, 32), [1, 2, 3, 4, 6, 8, 10, 13, 4, 5, 6, 7, 8, 9, 11, 13], strict=True))
SAME_CODES = {t: 16 if t < 24 else 24 for t in range(16, 32)}


def _codes(text: str) -> list[str]:
    return [format(int(c, 16), f"0{n}b") for c, n in (w.split(":") for w in text.split()) for n in [int(n)]]


@lru_cache(maxsize=8)
def load(path: str | None = None) -> dict[int, dict[tuple[int, int], str]]:
    """table -> (x, y) -> codeword as a string of 0 and 1.

    path: a text file of lines "table code:length code:length ...", the pairs in the order above, for tables 13, 15, 16 and 24.
    Without it streams that need these tables get the status CODEBOOK.
    """
    found = {t: _codes(text) for t, text in SMALL.items()}
    if path:
        with open(path) as lines:
            for line in lines:
                if line.strip():
                    table, rest = line.split(None, 1)
                    found[int(table)] = _codes(rest)
    out: dict[int, dict[tuple[int, int], str]] = {0: {(0, 0): ""}}
    for t, codes in found.items():
        side = round(len(codes) ** 0.5)
        out[t] = {(i // side, i % side): c for i, c in enumerate(codes)}
    for t, base in SAME_CODES.items():
        if base in out:
            out[t] = out[base]
    return out


@lru_cache(maxsize=8)
def inverse(path: str | None = None) -> dict[int, dict[str, tuple[int, int]]]:
    return {t: {c: xy for xy, c in codes.items()} for t, codes in load(path).items()}


@lru_cache(maxsize=1)
def quads() -> tuple[list[str], dict[str, int]]:
    codes = _codes(COUNT1_A)
    return codes, {c: i for i, c in enumerate(codes)}
