"""Each operator against SQL, brute force, an exact round trip or held-out labels."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import same_as_sql

from granula.llm import chat_format, decontamination, fingerprints, license_scan, line_dedup, mixing, quality, sharding, simhash_dedup, toxicity
from granula.llm import queries as registered
from granula.llm.common import components, table


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    same_as_sql(spark, sf_dir, registered.queries()[name], registered.oracle_sql()[name])


def roots(n, edges):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(40)] + [(600, 601 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(700, edges)
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: want[x] for x in linked}


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_simhash_matches_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    data = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [plain_simhash(t) for _, t in data]
    want = roots(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.op10_simhash_pigeonring(docs).collect()}
    assert got == {d: (f"{f:016x}", data[w][0]) for (d, _), f, w in zip(data, fps, want, strict=True)}


@pytest.mark.parametrize("radius,depth", [(3, 2), (6, 3)])
def test_links_lose_none(spark, monkeypatch, radius, depth):
    """Dense clusters and hot keys: connected just as brute force says, by short runs, forests and blocks."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 64)
    rng = random.Random(radius)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 3))))
    hot = rng.getrandbits(64)
    fps |= {hot ^ (rng.getrandbits(20) << 44) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = [(r.a, r.b) for r in simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, depth).collect()]
    place = {s: i for i, s in enumerate(signed)}
    got = [(place[a], place[b]) for a, b in found]
    assert all((fps[a] ^ fps[b]).bit_count() <= radius for a, b in got)
    bits = np.array(fps, dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius)
    assert roots(len(fps), got) == roots(len(fps), [(a, b) for a, b in near.tolist() if a < b])


def test_keep_one_keeps_one_of_each_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    twice = docs.union(docs.limit(5))
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(twice).collect())
    assert kept == sorted({r.component_id for r in simhash_dedup.op10_simhash_pigeonring(docs).collect()})


def test_winnowing_guarantee():
    """Two texts that share 50 words in whole sentences share a chosen fingerprint."""
    rng = random.Random(1)
    sentence = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 20))) + ". "
    for _ in range(50):
        shared = [sentence() for _ in range(30)]
        texts = ["".join([sentence() for _ in range(5)] + shared[:12] + [sentence() for _ in range(5)]) for _ in range(2)]
        chosen = [set(line_dedup.winnow(line_dedup.units(t))[3].tolist()) for t in texts]
        assert chosen[0] & chosen[1]
        assert "".join(line_dedup.units(texts[0])) == texts[0]


def test_decontamination_matches_brute_force(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = {r.item_id: decontamination.hashes(decontamination.words_of(r.text)) for r in benchmark.collect()}
    want = {}
    for r in docs.collect():
        h = decontamination.hashes(decontamination.words_of(r.text))
        parts = set(map(tuple, np.lib.stride_tricks.sliding_window_view(h, 5).tolist())) if len(h) >= 5 else set()
        hits = []
        for item, own in items.items():
            s = decontamination.shingles(own)
            if not parts & s.keys():
                continue
            if max(decontamination.weighted_similarity(s, decontamination.shingles(h[i : i + len(own)])) for i in range(max(1, len(h) - len(own) + 1))) >= decontamination.SIMILARITY:
                hits.append(item)
        want[r.doc_id] = ",".join(map(str, sorted(hits)))
    got = {r.doc_id: r.item_ids for r in decontamination.op3_window_simhash_decontamination(docs, benchmark).collect()}
    assert got == want and any(want.values())


def test_block_index_is_complete():
    rng = np.random.default_rng(0)
    patterns = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else np.uint64(0) for k in rng.integers(0, 12, 500)], dtype=np.uint64)
    fps = patterns[rng.integers(0, 50, 500)] ^ flips
    got = set(zip(*(x.tolist() for x in decontamination.BlockIndex(patterns).within(fps)), strict=True))
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ patterns[None, :]) <= decontamination.RADIUS)
    assert got == set(map(tuple, near.tolist()))


def test_splitting_tree_is_exact():
    quotas = [1000, 7, 0, 531, 1]
    parts = mixing.split_tree(quotas, 16, seed=1)
    assert [sum(p[i] for p in parts) for i in range(5)] == quotas
    assert max(map(sum, parts)) - min(map(sum, parts)) <= 1
    assert parts == mixing.split_tree(quotas, 16, seed=1) != mixing.split_tree(quotas, 16, seed=2)
    first = [mixing.split_tree(quotas, 16, seed=s)[0][0] for s in range(300)]
    assert abs(np.mean(first) - 1000 / 16) < 1.5 and np.std(first) > 2


def test_shards_are_disjoint(spark, sf_dir):
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    ranked, plan = mixing.ranked_blocks(sized)
    drawn = mixing.to_shards(ranked).collect()
    assert len({(r.source, r.rank) for r in drawn}) == len(drawn)
    counts = np.bincount([r.shard for r in drawn], minlength=16)
    assert counts.max() - counts.min() <= 1
    words = {}
    for r in drawn:
        words[r.source] = words.get(r.source, 0) + r.words
    assert all(abs(words.get(p.source, 0) - p.target) <= mixing.BLOCK for p in plan)


def test_targets():
    got = mixing.targets([100, 100, 100], [5.0, 2.0, 1.0])
    assert got[0] == 200.0 and abs(sum(got) - 450) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert mixing.targets([0, 0], [5.0, 2.0]) == [0.0, 0.0]


def test_growth_moves_rows_only_to_the_new_shard(spark, sf_dir):
    rows = sharding.op8_hash_tree_sharding(table(spark, sf_dir, "documents")).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_fingerprints_estimate_likeness(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    got = {r.doc_id: r for r in fingerprints.op5_one_permutation_minhash(table(spark, sf_dir, "documents")).collect()}

    def shingles(t):
        w = t.lower().split()
        n = min(5, len(w)) or 1
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    errors = []
    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        k = len(text) // 4
        other = text[: len(text) - k] + following[:k] if k else text
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        a, b, c = shingles(text), shingles(other), shingles(following)
        errors += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
        assert fingerprints.pack(fingerprints.unpack(r.fingerprint)) == r.fingerprint
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def held_out(spark, sf_dir, rows, column, folds, held):
    truth = {r.doc_id: r[column] for r in table(spark, sf_dir, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % folds == held}
    return [(truth[r.doc_id], r) for r in rows if r.doc_id in truth]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op6_attention_quality(table(spark, d, "documents"), table(spark, d, "labels")).collect()
    pairs = held_out(spark, d, rows, "quality", 5, 0)
    assert all(r.held_out for _, r in pairs)
    assert np.mean([y == r.predicted for y, r in pairs]) > 0.9


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op7_compression_toxicity(table(spark, d, "documents"), table(spark, d, "labels")).collect()
    pairs = held_out(spark, d, rows, "toxic", 3, 1)
    assert np.mean([r.predicted for y, r in pairs if y]) > 0.7  # few labels; with more the recall is near one
    assert np.mean([r.predicted for y, r in pairs if not y]) < 0.02


def test_blocked_viterbi_equals_plain():
    rng = np.random.default_rng(4)
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    for _ in range(30):
        m = chat_format.Hmm(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 8))))
        symbols = rng.integers(0, 8, rng.integers(1, 60)).tolist()
        blocks = [symbols[i : i + 7] for i in range(0, len(symbols), 7)]
        ends = m.borders([m.block_matrix(b) for b in blocks])
        assert [s for b, (e, x) in zip(blocks, ends, strict=True) for s in m.path(b, e, x)] == m.path(symbols)


def test_roles_and_rendering(spark, monkeypatch):
    """The whole query, in blocks of three turns, against plain Viterbi over each conversation and plain rendering."""
    monkeypatch.setattr(chat_format, "BLOCK", 3)
    convs = table(spark, "/root/testdata/sf0.01", "conversations")
    model = chat_format.fit(convs)
    prepared = chat_format.prepared(convs).select("conv_id", "turn", "role", "text", "symbols").collect()
    by = {}
    for r in sorted(prepared, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    want = {}
    for conv, turns in by.items():
        for t, path in zip(turns, model.turns([t.symbols for t in turns]), strict=True):
            text, lines = "", t.text.split("\n")
            for i, (line, at) in enumerate(zip(lines, path, strict=True)):
                text += ("" if i == 0 else "\n") + line if i and at == path[i - 1] else ("<|end|>\n" if i else "") + f"<|{chat_format.ROLES[at]}|>\n{line}"
            want[conv, t.turn] = (chat_format.ROLES[path[0]], text + "<|end|>")
    rows = chat_format.parse(convs, model).collect()
    assert {(r.conv_id, r.turn): (r.parsed_role, r.rendered) for r in rows} == want and len(rows) == len(prepared)
    assert np.mean([r.role == r.parsed_role for r in rows]) > 0.95


def test_pasted_transcripts(spark):
    """One text with several speakers' lines is parted among them."""
    model = chat_format.fit(table(spark, "/root/testdata/sf0.01", "conversations"))
    text = "User: what is it?\nplease tell\nAssistant: it is a\nlong line\n**User**: ok?\n[AI] bye"
    one = spark.createDataFrame([(1, 0, None, text), (2, 0, "user", "**User**: what?")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.parse(one, model).collect()}
    assert got[1].rendered == "<|user|>\nwhat is it?\nplease tell<|end|>\n<|assistant|>\nit is a\nlong line<|end|>\n<|user|>\nok?<|end|>\n<|assistant|>\nbye<|end|>" and got[1].n_turns == 4
    assert got[2].rendered == "<|user|>\nwhat?<|end|>"


def test_runs_are_covered():
    """The windows are the runs shortest from either end, and every run of MIN_WORDS words is the union of its windows."""
    rng = random.Random(2)
    for _ in range(150):
        n = [rng.choice([5, 10, 20, 25, 55, 30]) for _ in range(rng.randint(1, 12))]
        start, end, *_ = line_dedup.winnow(line_dedup.units("".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(k)) + ". " for k in n)))
        got = set(zip(start.tolist(), end.tolist(), strict=True))
        runs = {(i, j) for i in range(len(n)) for j in range(i, len(n)) if sum(n[i : j + 1]) >= line_dedup.MIN_WORDS}
        assert got == {(i, j) for i, j in runs if (i, j - 1) not in runs or (i + 1, j) not in runs}
        assert all({u for a, b in got if i <= a and b <= j for u in range(a, b + 1)} == set(range(i, j + 1)) for i, j in runs)


def test_repeats_go_to_their_end(spark):
    """A later run goes whole, its short tail too; the earlier one stays."""
    rng = random.Random(4)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + ". "
    shared = "".join(sentence(n) for n in (55, 25, 20))
    docs = spark.createDataFrame([(1, sentence(30) + shared + sentence(30)), (2, sentence(9) + shared + sentence(40)), (3, sentence(30) + sentence(30))], "doc_id long, text string")
    got = {r.doc_id: (r.removed_units, r.removed_words) for r in line_dedup.op1_line_winnowing(docs).collect()}
    assert got == {1: (0, 0), 2: (3, 100), 3: (0, 0)}


def test_winnowing_costs_little_more_than_splitting():
    """Fingerprint positions of a batch cost no more than 1.6 times the plain cutting into units and words."""
    rng = random.Random(6)
    texts = ["".join(" ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.randint(5, 30))) + ". " for _ in range(20)) for _ in range(600)]
    batch = pa.record_batch([pa.array(range(600), pa.int64())] * 2 + [pa.array(texts)], names=["doc_id", "h", "text"])

    def cost(work) -> float:
        began = time.process_time()
        work()
        return time.process_time() - began

    word = re.compile(r"[^\x20\x09-\x0D]+")
    plain = min(cost(lambda: [len(word.findall(u)) for t in texts for u in line_dedup.units(t)]) for _ in range(7))
    assert min(cost(lambda: list(line_dedup._positions(iter([batch])))) for _ in range(7)) < 1.6 * plain


def test_quality_gradients_and_forward():
    """The forward pass against loops over passages, the gradients against differences."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, 6)) for n in (1, 4, 3)]
    w = {"W": rng.normal(size=(6, 5)), "b": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)), "a": rng.normal(size=3), "c": rng.normal(size=5), "d": rng.normal(size=1)}
    model = quality.QualityModel(w, np.zeros(6), np.ones(6))
    x, starts, labels = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    want = []
    for bag in bags:
        h = [np.tanh(p @ w["W"] + w["b"]) for p in bag]
        e = [np.exp(w["a"] @ (np.tanh(p @ w["V"]) * sigmoid(p @ w["U"]))) for p in h]
        want.append(sigmoid(sum(k * p for k, p in zip(e, h, strict=True)) / sum(e) @ w["c"] + w["d"][0]))
    assert np.allclose(model.forward(x, starts)["y"], want)

    def loss():
        y = model.forward(x, starts)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for name, grad in model.gradients(x, starts, labels).items():
        for at in np.ndindex(grad.shape):
            kept = w[name][at]
            w[name][at] = kept + 1e-5
            up = loss()
            w[name][at] = kept - 1e-5
            down = loss()
            w[name][at] = kept
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_quality_query_matches_plain_scores(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.op6_attention_quality(docs, labels).collect()}
    assert all(abs(got[r.doc_id] - model.score([r.text])[0]) < 1e-9 for r in docs.collect())


def test_toxicity_query_matches_brute_force(spark, sf_dir):
    """Every window compressed by itself under either dictionary, with no cache and no batch."""
    import zstandard

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain, marked = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for c in (model.ordinary, model.toxic + model.ordinary))
    got = {r.doc_id: r.score for r in toxicity.op7_compression_toxicity(docs, labels).collect()}
    for r in docs.limit(40).collect():
        gains = []
        for w in {v[i : i + 48] for v in (x.strip(toxicity.EDGE) for x in (r.text or "").lower().encode().split()) for i in range(0, len(v), 48)}:
            item = b" " + w + b" " + model.ordinary[-65:-1]
            gains.append((len(plain.compress(item)) - len(marked.compress(item))) / (len(w) + 1))
        gains.sort()
        x = [gains[-1], np.mean(gains[-2:]), np.log1p(sum(g >= model.passing for g in gains))] if gains else [0, 0, 0]
        assert abs(1 / (1 + np.exp(-(np.dot(x, model.weights[:-1]) + model.weights[-1]))) - got[r.doc_id]) < 1e-9


def test_hypergeometric_law():
    """Every quantile of small laws, and mean and deviation at sizes no table holds."""
    import math

    for good, bad, take in ((5, 7, 4), (1, 30, 9), (20, 3, 21)):
        cuts = np.cumsum([math.comb(good, x) * math.comb(bad, take - x) / math.comb(good + bad, take) for x in range(take + 1)])
        for u in np.linspace(0.001, 0.999, 400):
            assert mixing.hypergeometric(u, good, bad, take) == int(np.searchsorted(cuts, u, side="right"))
    rng, good, bad, take = np.random.default_rng(1), 3 * 10**9, 9 * 10**9, 10**9
    drawn = np.array([mixing.hypergeometric(rng.random(), good, bad, take) for _ in range(300)], dtype=float)
    sd = (take * 0.25 * 0.75 * (1 - take / (good + bad))) ** 0.5
    assert abs(drawn.mean() - take / 4) < 4 * sd / 300**0.5 and 0.85 < drawn.std() / sd < 1.15


LICENSES = [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("under the terms of the GNU Lesser General Public License as published", "gpl,lgpl"),
    ("under the terms of the GNU Affero General Public License as published", "agpl,gpl"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"),
    ("Released under the MIT License.", "mit"),
    ("the license was released under the new policy", ""),
    ("the general public may use the license of the gnu", ""),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
]


def test_license_labels(spark):
    """Every license alone, those like others and texts that only sound so; base labels stay as the contract has them."""
    rows = [(i, f"some words before it {t} and some words after") for i, (t, _) in enumerate(LICENSES)]
    got = {r.doc_id: r.labels for r in license_scan.op2_license_set_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LICENSES)}


def test_chain_depth_follows_the_count():
    assert [simhash_dedup.chain_depth(n) for n in (0, 1 << 26, (1 << 26) + 1, 1 << 40)] == [2, 2, 3, 4]


def test_items_in_several_passes(spark, sf_dir, monkeypatch):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = sorted(map(tuple, decontamination.op3_window_simhash_decontamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "PASS", 4000)
    assert sorted(map(tuple, decontamination.op3_window_simhash_decontamination(docs, benchmark).collect())) == want
