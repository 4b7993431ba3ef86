"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits lies on a ring of m = radius + 1 segments. If two fingerprints differ in at most `radius` bits,
some segment starts a chain whose first l segments together differ in at most floor(l * radius / m) = l - 1 bits, for
every l. So that segment is equal, the next differs in at most one bit (one of its two halves is equal) and the one after
brings the sum to at most two (one of its three parts is equal). Those equal parts are the join key; inside a bucket the
chain budgets are tested before the full Hamming distance.

Two uses: `near_duplicates` links fingerprints as they are (`links`); `keep_similar` takes the pairs that the ring finds as candidates
and links those that an exact check of their shingle sets confirms (`ring_links`), then adds what lies beyond the radius (`similar_links`).

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like any other; a null
doc_id keeps its row, joins its component, and never is the component's smallest id unless all ids there are null. Rows may
repeat; a very long text is hashed in pieces; ties of a bit (set in just half the hashes) are 0. Extra columns are not carried by
the queries, all of them by keep_one and keep_similar. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import columns, components, durable, fresh, noted
from granula.llm.similar_links import SHINGLE, SIMILARITY, classes, majority, possible, shingled, similar_links, verified

BITS = 64
#: Runs of one key up to this many rows are compared by shifted arrays; longer ones by a search that emits a spanning forest.
SHORT_RUN = 16
#: A key with more rows than this is dealt out as pairs of blocks of this size.
BLOCK = 4096
#: Where all pairs are wanted: runs up to LAGS rows are compared by shifted arrays, longer ones SLICE rows at a time.
LAGS, SLICE = 64, 64
#: Bits within which near copies by shingles are looked for by the ring; of one more, keys would be too short to part a large table.
RADIUS = 6


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is one if it is set in over half the shingle hashes, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long) for every row: the unsigned 64 bits in a signed long. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(low bit, width) of the radius + 1 segments of the ring."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_masks(radius: int) -> np.ndarray:
    """[start, l - 1]: the bits of the chain of l segments from `start`."""
    ring, m = segments(radius), radius + 1
    out = np.zeros((m, m), dtype=np.uint64)
    for start in range(m):
        bits = 0
        for step in range(m):
            bits |= _mask(*ring[(start + step) % m])
            out[start, step] = bits
    return out


def chain_keys(radius: int, depth: int) -> list[tuple[int, int]]:
    """(start, mask) of every key: the bits that must agree."""
    ring, m, out = segments(radius), radius + 1, []
    for start in range(m):
        masks = [_mask(*ring[start])]
        for step in range(1, min(depth, m)):
            low, width = ring[(start + step) % m]
            cuts = [low + round(k * width / (step + 1)) for k in range(step + 2)]
            masks = [x | _mask(a, b - a) for x in masks for a, b in zip(cuts, cuts[1:], strict=False)]
        out += [(start, x) for x in masks]
    return out


def _near(fps: np.ndarray, other, start, masks: np.ndarray, radius: int) -> np.ndarray:
    """Chain budgets first, full distance last."""
    diff = fps ^ other
    good = np.ones(len(fps), dtype=bool)
    for step in range(1, masks.shape[1]):
        good &= np.bitwise_count(diff & masks[start, step]) <= step
    return good & (np.bitwise_count(diff) <= radius)


def _forest(fps: np.ndarray, start: int, masks: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links inside one long run: every link's ends are connected, in memory linear in the run."""
    out, left = [], np.unique(fps)
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            node = stack.pop()
            near = _near(left, node, start, masks, radius)
            if near.any():
                found = left[near]
                out.append((np.full(len(found), node), found))
                stack.extend(found)
                left = left[~near]
    return out


def _linker(radius: int):
    masks = ring_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. Whole runs are handled; the last run of a batch waits for the next."""

        def links(key: np.ndarray, start: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            length = np.diff(np.append(edge, len(key)))
            short = np.repeat(length <= SHORT_RUN, length)
            a, b = [], []
            for lag in range(1, SHORT_RUN):
                at = np.flatnonzero((key[lag:] == key[:-lag]) & short[lag:])
                if not len(at):
                    break
                near = _near(fp[at], fp[at + lag], start[at], masks, radius)
                a.append(fp[at[near]])
                b.append(fp[at[near] + lag])
            for i in np.flatnonzero(length > SHORT_RUN):
                for x, y in _forest(fp[edge[i] : edge[i] + length[i]], start[edge[i]], masks, radius):
                    a.append(x)
                    b.append(y)
            a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if last:
                yield links(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield links(*held)

    return run


def chain_depth(distinct: int, radius: int = 3) -> int:
    """Segments a key looks at: as few as leave about four unlike fingerprints to a key. The links are the same at any depth."""
    for depth in range(2, radius + 1):
        if distinct <= 4 << min(mask.bit_count() for _, mask in chain_keys(radius, depth)):
            return depth
    return radius + 1


def _hot(keyed: DataFrame) -> DataFrame:
    """(key, blocks) of the keys with more than BLOCK rows."""
    return keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("blocks"))


def _dealt(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """keyed with the keys of `hot` split into pairs of blocks; all of keyed's columns, fp among them."""
    return (
        keyed.join(hot, "key", "left")
        .withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), "blocks")))
        .withColumn("other", F.explode(F.expr("if(blocks is null, array(-1L), sequence(0L, blocks - 1))")))
        .select(F.expr("if(blocks is null, key, xxhash64(key, least(own, other), greatest(own, other)))").alias("key"), *[c for c in keyed.columns if c != "key"])
    )


def links(fps: DataFrame, radius: int = 3, depth: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect every pair within `radius` bits.

    fps(fp long), distinct; without a depth it follows from their number. A key is dealt out whole up to BLOCK rows; beyond, its rows are split into blocks and every pair
    of blocks is a unit of its own, so that no task holds more than two blocks of a hot key and none is left out.
    """
    keys = chain_keys(radius, depth or chain_depth(fps.count(), radius))
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(start).alias("start"), F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(_signed(mask)))).alias("key")) for n, (start, mask) in enumerate(keys)])).alias("k")).select("k.key", "k.start", "fp")
    dealt = _dealt(keyed, _hot(keyed))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linker(radius), "a long, b long")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, depth: int | None = None, seed: int = 42) -> DataFrame:
    """docs with one row of each group: the least by (doc_id, null last, text hash); of equal such rows, the least by all columns.

    Only the narrow columns decide. The rows that go are joined out by (doc_id, text hash), and rows equal in both are
    ordered only where there are any.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    narrow = durable(keyed.mapInArrow(run, "doc_id long, th long, fp long"))
    return keep_first(docs, narrow, links(narrow.select("fp").distinct(), radius, depth))


def ring_depth(distinct: int, radius: int) -> int:
    """Segments a key looks at where all pairs are wanted: fewest comparisons, a key's row weighed as 300 of them. The pairs are the same at any depth."""

    def cost(depth: int) -> float:
        keys = chain_keys(radius, depth)
        return len(keys) * (300 + distinct / 2 ** min(mask.bit_count() for _, mask in keys))

    return min(range(1, min(radius + 1, 5) + 1), key=cost)


def _chained(diff: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Where the chain keeps its budgets, segment after segment; the whole ring's is the full distance. masks: of one start, or a row each."""
    at = np.arange(len(diff))
    for step in range(1, masks.shape[-1]):
        some = diff if step == 1 else diff[at]
        at = at[np.bitwise_count(some & (masks[step] if masks.ndim == 1 else masks[at, step])) <= step]
    return at


def _pairer(radius: int, similarity: float, first: bool):
    """Rows (key, start, fp, bits, n, root) sorted by (key, fp) to the pairs of one key, in unlike components, that lie within `radius`
    bits and fit in size; with `first` only one or two pairs of each row that has any: that with the least fp before it, else after it."""
    masks = ring_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def least(i: np.ndarray, j: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of every j the least i; then of every i that is in no pair yet the least j."""
            if not first:
                return i, j
            order = np.lexsort((i, j))
            v, at = np.unique(j[order], return_index=True)
            u = i[order][at]
            seen[u] = seen[v] = True
            order = np.flatnonzero(~seen[i])
            order = order[np.lexsort((j[order], i[order]))]
            w, at = np.unique(i[order], return_index=True)
            seen[w] = True
            return np.concatenate((u, w)), np.concatenate((v, j[order][at]))

        def pairs(key, start, fp, bits, n, root) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            length, bits, found = np.diff(edge), bits.view(np.uint64), [(np.empty(0, np.int64),) * 2]
            seen = np.zeros(len(key), dtype=bool)

            def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                good = (i < j) & (root[i] != root[j]) & (np.minimum(n[i], n[j]) + 1e-9 >= similarity * np.maximum(n[i], n[j]))
                return i[good], j[good]

            short = np.repeat(length <= LAGS, length)
            for lag in range(1, LAGS):
                i = np.flatnonzero((key[lag:] == key[:-lag]) & short[lag:])
                if not len(i):
                    break
                i = i[_chained(bits[i] ^ bits[i + lag], masks[start[i]])]
                found.append(kept(i, i + lag))
            found = [least(*map(np.concatenate, zip(*found, strict=True)), seen)]
            for k in np.flatnonzero(length > LAGS):
                low, high = int(edge[k]), int(edge[k + 1])
                for row in range(low, high, SLICE):
                    end = min(row + SLICE, high)
                    at = _chained((bits[row:end, None] ^ bits[None, low:end]).ravel(), masks[start[low]])
                    found.append(least(*kept(low + at % (end - low), row + at // (end - low)), seen))
            i, j = map(np.concatenate, zip(*found, strict=True))
            a, b = fp[i], fp[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if last:
                yield pairs(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield pairs(*held)

    return run


def ring_pairs(rows: DataFrame, similarity: float, radius: int, depth: int, first: bool) -> DataFrame:
    """(a, b): the pairs of `fp` in unlike components whose `bits` lie within `radius` and whose sizes fit; with `first` one at least of
    every row that has any, in number linear in the rows. rows(fp, bits, n, root)."""
    keys = F.array(*[F.struct(F.lit(start).alias("start"), F.xxhash64(F.lit(k), F.col("bits").bitwiseAND(F.lit(_signed(mask)))).alias("key")) for k, (start, mask) in enumerate(chain_keys(radius, depth))])
    keyed = rows.withColumn("k", F.explode(keys)).select("k.key", "k.start", "fp", "bits", F.col("n").cast("long").alias("n"), "root")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(keyed, F.broadcast(_hot(keyed)))
    return dealt.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_pairer(radius, similarity, first), "a long, b long").distinct()


def ring_links(sets: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the `fp` of sets whose SimHashes lie within `radius` bits and whose Jaccard similarity, checked exactly, is at
    least `similarity`, and further pairs within the radius that are still to be checked: enough to connect every such pair.

    First each set is tried with one or two others in each of its keys, which joins large groups in linear time and tells the sets that
    have any near one; the further pairs are all pairs of those that are not connected yet. sets: classes(shingled(docs)).
    """
    depth = depth or ring_depth(sets.count(), radius)
    rows = sets.select("fp", "bits", "n")
    tried = noted(ring_pairs(rows.withColumn("root", F.col("fp")), similarity, radius, depth, True))
    linked = verified(possible(tried, sets, similarity), sets, docs, similarity, shingle)
    near = rows.join(tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi")
    roots = components(linked)
    linked = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    near = noted(near.join(roots, near.fp == roots.node, "left").select("fp", "bits", "n", F.coalesce("root", "fp").alias("root")))
    return linked, noted(ring_pairs(near, similarity, radius, depth, False).join(tried, ["a", "b"], "left_anti"))


def keep_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """As keep_one, of groups linked by Jaccard similarity of word shingles; every link is verified and none is missed.

    Candidates are the SimHashes of the shingle sets within `radius` bits, by pigeonring chains; as alike sets may lie further apart, only
    those pairs beyond the radius are found by shared prefixes of the sets.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = shingled(keyed, shingle, similarity)
    sets = classes(rows)
    linked, pairs = ring_links(sets, keyed, similarity, shingle, radius)
    return keep_first(docs, rows.select("doc_id", "th", "fp"), similar_links(sets, keyed, linked, pairs, radius, similarity, shingle))


def keep_first(docs: DataFrame, narrow: DataFrame, linked: DataFrame) -> DataFrame:
    """docs with the first row of each component. narrow: doc_id, text hash th and class fp of every row; linked(a, b): links between classes.

    Rows equal in doc_id and text are one place; of them the least by a hash of all columns stays (equal hashes: equal rows, any).
    """
    d, t, n = fresh(docs, "__doc", "__hash", "__first")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    classes = narrow.groupBy("fp").agg(F.min(place).alias("least"))
    roots = components(linked)
    named = noted(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written, so that the joins that bring them back are plain exchanges and a large group's rows can be split
    first = noted(named.groupBy("root").agg(F.min("least").alias("first")))
    known = noted(named.join(first, "root").select("fp", "first"))
    counted = noted(narrow.groupBy("doc_id", "th", "fp").agg(F.count(F.lit(1)).alias("copies")))
    groups = counted.join(known, "fp")
    gone = noted(groups.where(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct())
    twice = noted(groups.where(place.eqNullSafe(F.col("first")) & (F.col("copies") > 1)).select(F.col("doc_id").alias(d), F.col("th").alias(t)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (digest == F.col(t))
    kept = docs.join(gone, same, "left_anti")
    if not twice.isEmpty():
        row = F.struct(F.xxhash64(*columns(docs)).alias("h"), F.struct(*columns(docs)).alias("row"))
        more = kept.join(twice, same, "left_semi").select(F.col("doc_id").cast("long").alias(d), digest.alias(t), row.alias(n))
        least = more.groupBy(d, t).agg(F.min_by(F.col(n)["row"], F.col(n)["h"]).alias(n)).select(f"{n}.*")
        kept = kept.join(twice, same, "left_anti").select(*columns(docs)).union(least)
    return kept.select(*columns(docs))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, depth: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long, component_id long): component_id is the smallest doc_id reachable over links of at most `radius` bits."""
    fps = durable(fingerprints(docs, shingle, seed))
    classes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), radius, depth))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = durable(named)
    smallest = durable(named.groupBy("root").agg(F.min("least").alias("component_id")))
    known = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_pigeonring(docs: DataFrame) -> DataFrame:
    """The contract's query: 3-word shingles, seed 42, links at 3 or fewer differing bits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
