"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Sizes form classes a factor 1.5 apart. An item stands in the largest class not above its number of words, by two patterns: the
SimHash of its first and of its last so many words. Every window of every class size slides over every document, one word at a
time, as differences of running bit counts. A window's 64 bits are four blocks of 16; a block index lists each pattern under its
block value and all values one bit away, so every pattern within 7 bits of a window is found (7 bits over four blocks leave
some block at most one). Each is verified on the whole item: shingles of five words weighted by how often they occur, sum of
minima over sum of maxima at least 0.8.

7 bits do not cover every window at 0.8 (an item changed at both ends leaves neither pattern whole). So anchors complete them: a
window at similarity 0.8 lacks at most a fifth of an item's N shingles, hence holds one of any N - ceil(0.8 N) + 1 of them. The
rarest so many of each item are looked up at every word; around a found one all starts that hold it are tried.

Items are the small, shared side: documents stream past them in one narrow pass with no shuffle. A pass takes items of up to
PASS characters; more items go in parts by a hash of item_id, a pass for each, and the hits are put together.

Defined results: null texts count as empty; an item of fewer than five words is one shingle, one without words matches nothing;
null doc_ids and repeated rows are kept as they are; a very long text goes in steps of CHUNK words that overlap; of an item's
windows tied in similarity the first counts; without items or documents there are no hits or rows; extra columns are carried
only by `contaminated(whole=True)`.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granula.llm.common import columns, fresh

RADIUS, SHINGLE, SIMILARITY = 7, 5, 0.8
#: Characters of items of one pass; an index takes some ten times as much memory.
PASS = 16_000_000
#: Words of one step; bounds the 64 bytes a word that running counts take.
CHUNK = 1 << 14
EDGE = b".,;:!?\"'()[]"


def words_of(text: str | None) -> list[bytes]:
    return [x for w in (text or "").encode("utf-8", "surrogatepass").lower().split() if (x := w.strip(EDGE))]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def class_size(n: int) -> int:
    """The largest class not above n: 1 to 6 each, then 6, 10, 15, 22, 33, 50, 75, ..."""
    if n <= 6:
        return n
    size = 6
    while (bigger := max(10, int(size * 1.5))) <= n:
        size = bigger
    return size


def shingles(h: np.ndarray) -> Counter:
    size = min(SHINGLE, len(h)) or 1
    parts = h.tolist()
    return Counter(tuple(parts[i : i + size]) for i in range(len(parts) - size + 1))


def weighted_similarity(a: Counter, b: Counter) -> float:
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 0.0


def window_bits(h: np.ndarray, size: int, running: np.ndarray | None = None) -> np.ndarray:
    """SimHash of every window of `size` words: a bit is one if set in over half the word hashes."""
    kind = np.uint8 if size < 256 else np.uint32  # differences below 256 survive the wrap of uint8
    if running is None or running.dtype != kind:
        running = running_counts(h, kind)
    counts = running[size:] - running[:-size]
    return np.packbits(counts > kind(size // 2), axis=1, bitorder="little").view("<u8").ravel()


def running_counts(h: np.ndarray, kind=np.uint8) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(h) + 1, 64), dtype=kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


class BlockIndex:
    """Patterns of one class under their 16-bit blocks and all values one bit away."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, self.starts, self.lists = patterns, [], []
        flips = np.concatenate(([0], 1 << np.arange(16))).astype(np.int64)
        for j in range(4):
            block = ((patterns >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)
            values, ids = (block[:, None] ^ flips).ravel(), np.repeat(np.arange(len(patterns)), len(flips))
            order = np.argsort(values, kind="stable")
            self.starts.append(np.searchsorted(values[order], np.arange(65537)))
            self.lists.append(ids[order])

    def within(self, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(window, pattern) of every pair at most `radius` bits apart."""
        out_w, out_p = [], []
        for j in range(4):
            block = ((fps >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)
            lo = self.starts[j][block]
            n = self.starts[j][block + 1] - lo
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            w = np.repeat(hit, n[hit])
            at = np.arange(len(w)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + lo[w]
            p = self.lists[j][at]
            near = np.bitwise_count(fps[w] ^ self.patterns[p]) <= radius
            out_w.append(w[near])
            out_p.append(p[near])
        if not out_w:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(out_w), np.concatenate(out_p)]), axis=1)
        return both[0], both[1]


def _five(h: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE words from each word on."""
    out = np.zeros(max(0, len(h) - SHINGLE + 1), dtype=np.uint64)
    for i in range(SHINGLE):
        out = (out ^ h[i : len(h) - SHINGLE + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _anchors(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, item) sorted by hash: of each item so many shingles, repeats included, that no similar window lacks all."""
    found: Counter = Counter()
    for s in sets:
        found.update(set(s.tolist()))
    pairs = set()
    for item, s in enumerate(sets):
        count = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
        pairs.update((x, item) for x in sorted(s.tolist(), key=lambda x: (found[x], x))[:count])
    rows = sorted(pairs)
    return np.array([x for x, _ in rows], dtype=np.uint64), np.array([i for _, i in rows], dtype=np.int64)


class Matcher:
    """Built once a task from the items' texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, by_class = [], {}
        for item_id, text in items:
            h = hashes(words_of(text))
            if not len(h):
                continue
            size = class_size(len(h))
            n = len(self.items)
            self.items.append((item_id, len(h), shingles(h)))
            for offset in {0, len(h) - size}:
                by_class.setdefault(size, []).append((n, offset, window_bits(h[offset : offset + size], size)[0]))
        self.classes = {size: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), BlockIndex(np.array([x[2] for x in rows], dtype=np.uint64))) for size, rows in by_class.items()}
        self.longest = max(self.classes, default=1)
        whole = [hashes(words_of(text)) for _, text in items]
        self.anchors, self.anchored = _anchors([_five(h) for h in whole if len(h)])

    def _around(self, h: np.ndarray, item: int, lo: int, hi: int, end: int) -> tuple[float, int, int]:
        """(similarity, -start, -stop) of the best window of the item's length that starts in lo..hi; the first of equals."""
        _, length, own = self.items[item]
        total, best, held = sum(own.values()), (0.0, 0, 0), Counter()
        last = lambda s: min(s + length, end) - SHINGLE
        words = h[lo : last(hi) + SHINGLE].tolist()
        keys = [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
        overlap, upto = 0, lo
        for start in range(lo, hi + 1):
            while upto <= last(start):
                if (k := keys[upto - lo]) in own:
                    overlap += held[k] < own[k]
                    held[k] += 1
                upto += 1
            best = max(best, (overlap / (total + upto - start - overlap), -start, -min(start + length, end)))
            if (k := keys[start - lo]) in own:
                held[k] -= 1
                overlap -= held[k] < own[k]
        return best

    def _by_anchor(self, h: np.ndarray, text_start: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, tuple[float, int, int]]]:
        """(start of text, item, best window) around every anchor; neighbouring anchors' starts are tried together."""
        five = _five(h)
        lo = np.searchsorted(self.anchors, five, side="left") if len(self.anchors) else np.zeros(len(five), dtype=np.int64)
        hit = np.flatnonzero(self.anchors[np.minimum(lo, len(self.anchors) - 1)] == five) if len(self.anchors) else lo[:0]
        hit = hit[hit + SHINGLE <= ends[hit]]
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for at, first in zip(hit.tolist(), lo[hit].tolist(), strict=True):
            while first < len(self.anchors) and self.anchors[first] == five[at]:
                item = int(self.anchored[first])
                begin = int(text_start[at])
                near = max(begin, at - self.items[item][1] + SHINGLE)
                own = spans.setdefault((begin, item), [])
                if own and near <= own[-1][1] + 1:
                    own[-1][1] = at
                else:
                    own.append([near, at])
                first += 1
        for (begin, item), ranges in spans.items():
            for a, b in ranges:
                yield begin, item, self._around(h, item, a, b, int(ends[a]))

    def find(self, h: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int, int, float]]]:
        """h: word hashes of several texts in a row; ends[i]: where word i's text ends. start of text -> [(item, from, to, similarity)].

        Of overlapping hits of one item the most similar stays.
        """
        tried: set[tuple[int, int]] = set()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        text_start = np.concatenate(([0], ends[:-1]))
        text_start = np.maximum.accumulate(np.where(np.concatenate(([True], ends[1:] != ends[:-1])), np.arange(len(ends)), 0)) if len(ends) else text_start
        for at in range(0, len(h), CHUNK):
            part = h[at : at + CHUNK + self.longest - 1]
            running = running_counts(part)
            for size, (item, offset, index) in self.classes.items():
                if len(part) < size:
                    continue
                fps = window_bits(part, size, running)[:CHUNK]
                w, p = index.within(fps)
                w = w + at
                inside = w + size <= ends[w]
                for i, k in zip(w[inside].tolist(), p[inside].tolist(), strict=True):
                    n, length, own = self.items[item[k]][0], self.items[item[k]][1], self.items[item[k]][2]
                    start = max(int(text_start[i]), i - int(offset[k]))
                    if (item[k], start) in tried:
                        continue
                    tried.add((item[k], start))
                    stop = min(start + length, int(ends[i]))
                    s = weighted_similarity(own, shingles(h[start:stop]))
                    if s >= SIMILARITY:
                        key = (int(text_start[i]), int(item[k]))
                        best[key] = max(best.get(key, (0.0, 0, 0)), (s, -start, -stop))
        for text, k, window in self._by_anchor(h, text_start, ends):
            if window[0] >= SIMILARITY:
                best[text, k] = max(best.get((text, k), (0.0, 0, 0)), window)
        out: dict[int, list[tuple[int, int, int, float]]] = {}
        for (text, k), (s, start, stop) in best.items():
            out.setdefault(text, []).append((self.items[k][0], -start - text, -stop - text, s))
        return out


_HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("from_word", T.IntegerType()), T.StructField("to_word", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
_BUILT: dict[str, Matcher] = {}


def _built(key: str, items: list[tuple[int, str]]) -> Matcher:
    """The matcher of a pass, made once a worker; a worker keeps the last one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items)
    return _BUILT[key]


def _one_pass(docs: DataFrame, items: list[tuple[int, str]], name: str) -> DataFrame:
    """All columns of docs and the hits of these items as column `name`."""
    names, key = docs.columns, uuid.uuid4().hex
    at = names.index("text")
    hit_type = pa.list_(pa.struct([("item_id", pa.int64()), ("from_word", pa.int32()), ("to_word", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _built(key, items)

        def flush(texts: list[list[bytes]]) -> list[list[dict]]:
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.cumsum(sizes)
            found = matcher.find(hashes([w for t in texts for w in t]), np.repeat(ends, sizes)) if matcher.items and sizes.sum() else {}
            return [[dict(zip(("item_id", "from_word", "to_word", "similarity"), x, strict=True)) for x in sorted(found.get(int(e - n), []) if n else [])] for e, n in zip(ends, sizes, strict=True)]

        for batch in batches:
            hits, waiting, n = [], [], 0
            for i in range(0, batch.num_rows, 64):
                for text in batch.column(at).slice(i, 64).to_pylist():
                    waiting.append(words_of(text))
                    n += len(waiting[-1])
                    if n >= CHUNK:
                        hits += flush(waiting)
                        waiting, n = [], 0
            hits += flush(waiting)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, hit_type)], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(_HIT))]))


def contaminated(docs: DataFrame, benchmark: DataFrame, whole: bool = False, name: str | None = None) -> DataFrame:
    """doc_id (whole: all columns) and `hits` array<struct<item_id, from_word, to_word, similarity>>, one best hit an item, by item_id.

    With whole the column is called `name`, "__hits" without one; docs must not have it.
    """
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    parts = max(1, math.ceil((known.agg(F.sum(F.length("text"))).first()[0] or 0) / PASS))
    rows = docs.select(*columns(docs)) if whole else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own, found = rows.columns, []
    for part in range(parts):
        items = [(r.item_id, r.text) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()]
        (made,) = fresh(rows, "__hits")
        rows = _one_pass(rows, items, made)
        found.append(made)
    hits = F.array_sort(F.concat(*found)) if parts > 1 else F.col(found[0])
    return rows.select(*[F.col(f"`{c}`") for c in own if whole or c != "text"], hits.alias((name or "__hits") if whole else "hits"))


def op3_window_simhash_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document: whether it holds a benchmark item, which, and how similar the best is."""
    found = contaminated(docs, benchmark)
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.concat_ws(",", F.transform("hits", lambda x: x["item_id"].cast("string"))).alias("item_ids"), F.coalesce(F.array_max(F.transform("hits", lambda x: x["similarity"])), F.lit(0.0)).alias("best_similarity"))
