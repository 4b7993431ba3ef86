"""What the first review found cut short, each against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from granula.llm import decontamination, mixing, simhash_dedup, similar_links, toxicity
from granula.llm.common import components, table


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("often,block", [(2, 4096), (8, 4096), (8, 4)])
def test_near_copies_at_five_words(spark, monkeypatch, often, block):
    """Copies just above similarity 0.8 go, those just below stay, whatever shingles count as frequent and however keys are split."""
    monkeypatch.setattr(similar_links, "OFTEN", often)
    monkeypatch.setattr(similar_links, "BLOCK", block)
    rng, rows = random.Random(5), []
    for base in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((3 * base, " ".join(words)))
        for n, places in ((1, (20, 50, 80, 110)), (2, (140,))):  # 20, then 25 of 196 shingles change: 176 / 216 and 171 / 221
            for k in places:
                words[k] = f"x{rng.randrange(10**6)}"
            rows.append((3 * base + n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.8 > jaccard(rows[i][1], rows[i + 2][1]) for i in range(0, 90, 3))
    assert all(jaccard(rows[i + 1][1], rows[i + 2][1]) > 0.8 for i in range(0, 90, 3))
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == list(range(0, 90, 3))  # the third is a copy of the second
    alone = docs.where("doc_id % 3 <> 1")
    assert corpus_pipeline.drop_near_copies(spark, alone, "").count() == 60


def test_mix_comes_from_the_shards(spark, sf_dir, monkeypatch):
    """The query's sums are those of the tree's shards, written in order; the stage's rows are the shards' rows in their order."""
    written = []
    monkeypatch.setattr(mixing, "stored", lambda df, f=mixing.stored: written.append(f(df)) or written[-1])
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r.taken for r in mixing.op4_splitting_tree_mix(docs).collect()}
    rows, words = written[0].collect(), dict.fromkeys(got, 0)
    for r in rows:
        words[r.doc_id] += r.words
    assert got == words and {r.shard for r in rows} == set(range(16))
    ranked, _ = mixing.ranked_blocks(mixing.sizes(docs), block=mixing.WHOLE)
    drawn = sorted((r.shard, r.place, r.doc_id) for r in mixing.to_shards(ranked).collect())
    assert [r.doc_id for r in mixing.mixed_documents(docs).collect()] == [d for _, _, d in drawn]


def test_markers_past_byte_48():
    """A marker after the first 48 bytes of an unspaced word gets into the toxic dictionary."""
    toxic = [f"{i:048d}badmarker and w{i}" for i in range(20)]
    assert toxicity._contexts(toxic)[b"badmarker"] == 20
    assert b"badmarker" in toxicity._dictionaries(toxic, [f"plain words {i}" for i in range(50)], 4096, 8192, 0.015, 10.0)[1]


def test_items_changed_at_both_ends():
    """Every planted item with other words at its ends, still at 0.8, is found at the best window, as brute force says."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(22, 60)))) for i in range(300)]
    matcher, found = decontamination.Matcher(items), 0
    for i, text in items:
        words = rng.choices(vocabulary, k=40) + ["x1", *text.split()[1:-1], "x2"] + rng.choices(vocabulary, k=40)
        h, own = decontamination.hashes(decontamination.words_of(" ".join(words))), decontamination.shingles(decontamination.hashes(decontamination.words_of(text)))
        n = len(text.split())
        want = max(decontamination.weighted_similarity(own, decontamination.shingles(h[k : k + n])) for k in range(len(h) - n + 1))
        assert want >= decontamination.SIMILARITY
        got = {x[0]: x[3] for x in matcher.find(h, np.full(len(h), len(h))).get(0, [])}
        found += got.get(i) == want
    assert found == 300


def test_signatures_prune_no_link(spark, monkeypatch):
    """Every pair of sets at 0.8 is possible by its signatures, sizes on both sides of a power of two; most pairs below fall."""
    rng, rows = np.random.default_rng(8), []
    for size in (3, 30, 60, 64, 70, 250, 257, 300):
        own = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        rows.append(own)
        for _ in range(6):
            cut = int(rng.integers(0, size // 3 + 1))
            rows.append(np.concatenate([own[cut:], rng.integers(0, 1 << 64, int(rng.integers(0, cut + 1)), dtype=np.uint64)]))
    rows = [np.unique(r) for r in rows]
    sets = spark.createDataFrame([(i, len(r), similar_links.parities(r).tolist()) for i, r in enumerate(rows)], "fp long, n int, sign array<long>")
    pairs = {(i, j): len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and 0.8 * max(len(a), len(b)) <= min(len(a), len(b))}
    got = {(r.a, r.b) for r in similar_links.possible(spark.createDataFrame(sorted(pairs), "a long, b long"), sets).collect()}
    alike = {p for p, s in pairs.items() if s >= 0.8}
    assert alike and alike <= got and not any(pairs[p] < 0.5 for p in got)
    left = sets.selectExpr("7L as key", "fp", "n", "fp as root")
    for block in (4096, 8):
        monkeypatch.setattr(similar_links, "BLOCK", block)
        assert {(r.a, r.b) for r in similar_links.bucket_pairs(left, sets).collect()} == got


@pytest.mark.parametrize("block", [4096, 8])
def test_large_groups_lose_no_link(spark, monkeypatch, block):
    """Many copies of one text, each with edits of its own, about as like each other as the threshold: groups are those of brute force."""
    monkeypatch.setattr(similar_links, "BLOCK", block)
    rng, rows = random.Random(6), []
    base = [f"w{i}" for i in range(120)]
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(1, 4)):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    parts = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    at = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(parts[i] & parts[j]) / len(parts[i] | parts[j]) >= 0.8 and at[i] != at[j]:
                lo, hi = sorted((at[i], at[j]))
                at = [lo if x == hi else x for x in at]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted(set(at)) and len(kept) > 1


def grouped(n, pairs):
    """The least member of each one's group."""
    at = list(range(n))
    for i, j in pairs:
        lo, hi = sorted((at[i], at[j]))
        at = [lo if x == hi else x for x in at]
    return at


@pytest.fixture(scope="module")
def edits():
    """Texts with copies of 0 to 12 changed words in turn, a large group among them; their sets and all pairs alike with their distance in bits."""
    rng, rows = random.Random(12), []
    for size, copies in [(200, 90)] + [(rng.randint(30, 200), 5) for _ in range(25)]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for n in range(copies):
            words = list(base)
            for k in rng.sample(range(size), rng.randint(0, max(1, size // 50)) if n else 0):
                words[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = [similar_links.shingle_set(t) for _, t in rows]
    bits = [similar_links.majority(s) for s in sets]
    alike = {}
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            if shared >= 0.8 * (len(a) + len(sets[j]) - shared):
                alike[(j, i)] = (bits[i] ^ bits[j]).bit_count()
    assert 500 < sum(d <= corpus_pipeline.RADIUS for d in alike.values()) < len(alike) - 500
    return rows, sets, alike


@pytest.mark.parametrize("depth,block,lags", [(1, 4096, 64), (2, 4096, 64), (3, 8, 2)])
def test_ring_and_rest_part_the_links(spark, monkeypatch, edits, depth, block, lags):
    """The ring's links connect just the pairs alike within the radius; with the join's, all pairs alike."""
    for module in (simhash_dedup, similar_links):
        monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "LAGS", lags)
    rows, sets, alike = edits
    radius, names = corpus_pipeline.RADIUS, {}
    for i, s in enumerate(sets):
        names.setdefault(int(np.uint64(similar_links.xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    unlike = similar_links.classes(similar_links.shingled(docs))
    pairs = lambda df: {tuple(sorted((names[r.a], names[r.b]))) for r in df.collect()}
    same = [(i, j) for (i, j), d in alike.items() if sets[i].tobytes() == sets[j].tobytes()]
    linked, more = simhash_dedup.ring_links(unlike, docs, radius=radius, depth=depth)
    near = linked.union(similar_links.verified(similar_links.possible(more, unlike), unlike, docs))
    ring = pairs(near)
    assert grouped(len(rows), [*same, *ring]) == grouped(len(rows), [p for p, d in alike.items() if d <= radius])
    every = pairs(similar_links.similar_links(unlike, docs, near, more.limit(0), radius))
    assert grouped(len(rows), [*same, *every]) == grouped(len(rows), alike)


def test_stage_goes_by_the_ring(spark, monkeypatch, edits):
    """Copies within the radius go by SimHash and pigeonring alone, not by the join beside it; copies further apart by the join alone."""
    rows, sets, alike = edits
    docs, radius = spark.createDataFrame(rows, "doc_id long, text string"), corpus_pipeline.RADIUS
    kept = lambda: [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").orderBy("doc_id").collect()]
    want = lambda pairs: sorted(set(grouped(len(rows), pairs)))
    assert kept() == want(alike)
    none, rest = spark.createDataFrame([], "a long, b long"), simhash_dedup.similar_links
    ring_alone = lambda sets, docs, known, pairs, *a: known.union(similar_links.verified(similar_links.possible(pairs, sets), sets, docs))
    monkeypatch.setattr(simhash_dedup, "similar_links", ring_alone)
    assert kept() == want([p for p, d in alike.items() if d <= radius])
    monkeypatch.setattr(simhash_dedup, "similar_links", rest)
    monkeypatch.setattr(simhash_dedup, "ring_links", lambda *a: (none, none))
    assert kept() == want([p for p, d in alike.items() if d > radius or sets[p[0]].tobytes() == sets[p[1]].tobytes()])


def test_few_links_are_joined_by_few_tasks(spark):
    """Rounds over a short list of links do not run as many tasks as there are partitions each time they read or join it."""
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8], "a long, b long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few links", "")
        got = {r.node: r.root for r in components(edges).collect()}
        tracker = sc.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup("few links") for i in tracker.getJobInfo(j).stageIds}
        tasks = sum(s.numCompletedTasks for i in stages if (s := tracker.getStageInfo(i)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: max(1, (i - 1) // 8 * 8 + 1) for i in range(1, 41)}
    assert tasks < 2600, tasks
