"""The exact check of near copies by five-word shingles, and the links that lie beyond a SimHash radius: a prefix-filter join, verified set by set.

Near copies are looked for by SimHash and pigeonring chains (`simhash_dedup.ring_links`), and each pair found is verified here. No
radius covers every two texts alike, so what lies beyond it is found by the join below; pairs within the radius are left to the ring.

Shingles are put in one global order (those frequent in a sample last, the others by hash). Two sets with Jaccard similarity of
at least t share a shingle among the first n - ceil(t n) + 1 of each, whatever the order is; so no pair is lost, and the sample
only decides how much work there is. Candidates share such a shingle and fit in size. Each set also has a signature of two to
four bits a shingle, bit i telling whether an odd number of its shingles hash to i: two sets differ in as many shingles at
least as their signatures in bits (a signature twice as long is folded first), so most candidates that are not alike fall
without a look at their sets. The others are verified on the whole sets.

Links only have to connect what is similar. So every key's holders are first compared with two of them (the one whose keys are
shared most and the least), which joins large groups in linear time; then the holders of a key that are not connected yet are
compared by their signatures where they lie, so that only pairs that may be alike are ever emitted.

Defined results: a null text counts as empty; texts without words have the empty set and are alike; a text of fewer than five
words is one shingle; case differs only in ASCII. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granula.llm.common import components, noted, stored
from granula.llm.fingerprints import shingle_hashes

SIMILARITY, SHINGLE = 0.8, 5
#: Longs of a signature that go with every key; runs of one key compared by shifted arrays; rows of a key beyond which it is split.
WORDS, SHORT_RUN, BLOCK = 16, 16, 4096
#: One text in SAMPLE (all of a small table) tells the frequent shingles: those in OFTEN sampled texts, MOST of them at most.
SAMPLE, LEAST_SAMPLE, OFTEN, MOST = 10, 4000, 8, 100_000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", shingle))


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """The shingles to be put last, sorted."""
    parts = max(1, min(SAMPLE, docs.count() // LEAST_SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                found = [shingle_set(t, shingle) for t in batch.column(0).slice(i, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0)
    counts = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(np.array([r.s for r in counts.orderBy(F.desc("n"), "s").limit(MOST).collect()], dtype=np.int64).view(np.uint64))


def parities(s: np.ndarray) -> np.ndarray:
    """The signature as longs; its bits come from the middle of the hashes, not from the end that orders them."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of some hashes: bit i is one if it is set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a very long text never unpacks at once
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingled(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, fp, n, bits, sign, keys) of every row: text hash, hash, size, SimHash and signature of its shingle set, the set's prefix. docs: doc_id long, text."""
    last = _frequent(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                fps, sizes, bits, keys, signs = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingle_set(text, shingle)
                    fps.append(xxhash.xxh64_intdigest(s.tobytes()))
                    sizes.append(len(s))
                    bits.append(majority(s))
                    signs.append(parities(s))
                    if len(last):
                        often = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        s = np.concatenate([s[~often], s[often]])
                    keys.append(s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1].view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(bits, dtype=np.uint64).view(np.int64)), pa.array(signs, pa.list_(pa.int64())), lists], names=["doc_id", "th", "fp", "n", "bits", "sign", "keys"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, th long, fp long, n int, bits long, sign array<long>, keys array<long>"))


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in the only column of ids, 8 bits or more a hash: few rows beyond the wanted pass it."""
    name = ids.columns[0]
    bits = 1 << max(10, math.ceil(math.log2(8 * max(1, ids.count()))))
    low = F.col(name).bitwiseAND(F.lit(bits - 1))
    words = ids.groupBy(F.shiftright(low, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 31 as int))")).alias("v")).collect()
    out = np.zeros(bits // 32, dtype=np.int64)
    out[[r.w for r in words]] = [r.v for r in words]
    return out.astype(np.uint32)


def classes(sets: DataFrame) -> DataFrame:
    """(fp, th, n, bits, sign, keys) of every different set, th of one of its texts. Copies are aggregated before the exchange: a hot set is a row a task there."""
    return stored(sets.groupBy("fp").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("n", "bits", "sign", "keys")]))


def possible(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, beyond: int | None = None) -> DataFrame:
    """The (a, b) of `pairs` that their signatures allow to be alike; with `beyond`, only those whose SimHashes differ in more bits. sets: classes(...)."""
    if pairs.isEmpty():
        return pairs
    bits = F.lit(0).cast("long") if beyond is None else F.col("bits")
    one = stored(sets.select("fp", "n", "sign", bits.alias("bits")).join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi"))
    both = pairs.join(one.select(F.col("fp").alias("a"), F.col("n").alias("m"), F.col("sign").alias("x"), F.col("bits").alias("v")), "a").join(one.select(F.col("fp").alias("b"), "n", F.col("sign").alias("y"), F.col("bits").alias("w")), "b")
    if beyond is not None:
        both = both.where(F.bit_count(F.col("v").bitwiseXOR(F.col("w"))) > beyond)
    size = F.least(F.size("x"), F.size("y"))

    def folded(c: str) -> Column:
        return F.when(F.size(c) > size, F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda v, w: v.bitwiseXOR(w))).otherwise(F.col(c))

    unlike = F.aggregate(F.zip_with(folded("x"), folded("y"), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda t, v: t + v)
    most = (F.col("m") + F.col("n") - unlike) / 2
    return noted(both.where(most + 1e-9 >= similarity * (F.col("m") + F.col("n") - most)).select("a", "b"))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The (a, b) of `pairs` whose sets are alike; the sets are made again from the texts of the rows in question alone. sets: classes(...)."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    named = noted(sets.select("fp", "th").join(ids, "fp", "left_semi").select("th"))
    wanted = _filter(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = batch.column(0).to_numpy()
            low = th & (32 * len(wanted) - 1)
            at = np.flatnonzero(wanted[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1))
            for i in range(0, len(at), 128):
                found = [shingle_set(batch.column(1)[int(k)].as_py(), shingle) for k in at[i : i + 128]]
                fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["fp", "shingles"])

    one = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text").mapInArrow(run, "fp long, shingles array<long>").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    both = pairs.join(one.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return noted(both.where(shared + 1e-9 >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def _folded(m: np.ndarray, size: np.ndarray, to: int) -> np.ndarray:
    """The first `to` longs of signatures that are as long or twice as long."""
    out = m[:, :to].copy()
    if (longer := size > to).any():
        out[longer] ^= m[longer, to : 2 * to]
    return out


def _near(m: np.ndarray, size: np.ndarray, n: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows (i, j) lie in unlike components and may be alike by size and signature."""
    good = (root[i] != root[j]) & (np.minimum(n[i], n[j]) + 1e-9 >= similarity * np.maximum(n[i], n[j]))
    at = np.flatnonzero(good)
    i, j = i[at], j[at]
    least, unlike = np.minimum(size[i], size[j]), np.zeros(len(at))
    for to in np.unique(least):
        k = np.flatnonzero(least == to)
        diff = _folded(m[i[k]], size[i[k]], to) ^ _folded(m[j[k]], size[j[k]], to)
        unlike[k] = np.bitwise_count(diff.view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed values it would count the absolute ones
    most = (n[i] + n[j] - unlike) / 2
    good[at] = most + 1e-9 >= similarity * (n[i] + n[j] - most)
    return good


def _pairer(similarity: float):
    """Rows (key, fp, n, root, sign) sorted by key to the pairs of one key that may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key, fp, n, root, size, m) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            length = np.diff(edge)
            short = np.repeat(length <= SHORT_RUN, length)
            a, b = [], []
            for lag in range(1, SHORT_RUN):
                i = np.flatnonzero((key[lag:] == key[:-lag]) & short[lag:])
                if not len(i):
                    break
                i = i[_near(m, size, n, root, i, i + lag, similarity)]
                a.append(fp[i])
                b.append(fp[i + lag])
            for k in np.flatnonzero(length > SHORT_RUN):
                for row in range(edge[k], edge[k + 1] - 1):
                    j = np.arange(row + 1, edge[k + 1])
                    j = j[_near(m, size, n, root, np.full(len(j), row), j, similarity)]
                    a.append(np.full(len(j), fp[row]))
                    b.append(fp[j])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(4).value_lengths().to_numpy().astype(np.int64)
            m = np.zeros((batch.num_rows, WORDS), dtype=np.int64)
            m[np.arange(WORDS)[None, :] < size[:, None]] = batch.column(4).flatten().to_numpy()
            now = [*(batch.column(k).to_numpy() for k in range(4)), size, m]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if last:
                yield pairs(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield pairs(*held)

    return run


def bucket_pairs(left: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): the pairs of holders of one key, in unlike components, that signatures of at most WORDS longs allow. left: key, fp, n, root; sets: classes(...).

    A key is dealt out whole up to BLOCK rows; beyond, its rows are split into blocks and every pair of blocks is a unit.
    """
    word = F.sequence(F.lit(0), F.lit(WORDS - 1))
    short = F.when(F.size("sign") <= WORDS, F.col("sign")).otherwise(F.transform(word, lambda i: F.aggregate(F.filter("sign", lambda v, j: j % WORDS == i), F.lit(0).cast("long"), lambda t, v: t.bitwiseXOR(v))))
    signs = stored(sets.select("fp", "sign").join(left.select("fp").distinct(), "fp", "left_semi").select("fp", short.alias("sign")))
    hot = left.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK).select("key", F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    dealt = (
        left.join(signs, "fp").join(hot, "key", "left")
        .withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), "blocks")))
        .withColumn("other", F.explode(F.expr("if(blocks is null, array(-1L), sequence(0L, blocks - 1))")))
        .select(F.expr("if(blocks is null, key, xxhash64(key, least(own, other), greatest(own, other)))").alias("key"), "fp", F.col("n").cast("long").alias("n"), "root", "sign")
    )
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_pairer(similarity), "a long, b long").distinct()


def similar_links(sets: DataFrame, docs: DataFrame, known: DataFrame, pairs: DataFrame, radius: int, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): `fp` of sets in one group of those linked by Jaccard similarity of at least `similarity`, enough to connect every group.

    known: links within `radius` bits of SimHash, verified; pairs: those within it that are still to be verified. The join looks at
    pairs beyond the radius alone. sets: classes(shingled(docs)).
    """
    keyed = sets.select("fp", "n", "bits", F.explode("keys").alias("key"))
    shared = stored(keyed.withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("holders > 1"))

    def named(roots: DataFrame, *names: str) -> DataFrame:
        return shared.join(roots, shared.fp == roots.node, "left").select(*names, F.coalesce("root", "fp").alias("root"))

    roots = components(known)
    begun = named(roots, "key", "fp", "n", "bits")
    mass = shared.groupBy("fp").agg(F.sum("holders").alias("mass"))
    heads = begun.join(mass, "fp").groupBy("key").agg(F.max(F.struct("mass", "fp", "n", "bits", "root")).alias("centre"), F.min(F.struct("fp", "n", "bits", "root")).alias("least"))

    def fits(n, m):
        return (F.least(n, m) + 1e-9 >= similarity * F.greatest(n, m))

    head = [F.struct(*[f"{h}.{c}" for c in ("fp", "n", "bits", "root")]) for h in ("centre", "least")]
    stars = begun.join(heads, "key").select("fp", "n", "bits", "root", F.explode(F.array(*head)).alias("h"))
    beyond = F.bit_count(F.col("bits").bitwiseXOR(F.col("h.bits"))) > radius
    stars = stars.where((F.col("root") != F.col("h.root")) & fits(F.col("n"), F.col("h.n")) & beyond).select(F.least("fp", "h.fp").alias("a"), F.greatest("fp", "h.fp").alias("b")).distinct()
    tried = noted(stars.union(pairs))
    first = verified(possible(tried, sets, similarity), sets, docs, similarity, shingle)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(first))
    parted = named(roots, "key", "fp", "n")
    apart = parted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = stored(parted.join(apart, "key", "left_semi"))
    rest = noted(bucket_pairs(left, sets, similarity).join(tried, ["a", "b"], "left_anti"))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(possible(rest, sets, similarity, radius), sets, docs, similarity, shingle))
