"""Round trips of the coder, robustness of the frame walk, and the streaming splitter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions import huffman
from granula.functions import layer3 as L
from granula.operators import codec
from granula.sources.streams import read_streams
from granula.streaming.split import split_stream

DELAY = 1057


def tone(n, hz=44100, seed=0):
    t = np.arange(n)
    return 0.3 * np.sin(2 * np.pi * 440 * t / hz) + 0.15 * np.sin(2 * np.pi * 880 * t / hz + 1.3) + 0.02 * np.random.default_rng(seed).normal(size=n)


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    """Stand-in codebooks for the big tables: eight bits a pair."""
    path = tmp_path_factory.mktemp("books") / "books.txt"
    path.write_text("".join(f"{t} " + " ".join(f"{i:x}:8" for i in range(256)) + "\n" for t in (13, 15, 16, 24)))
    return str(path)


def pcm_rows(spark, signals):
    rows = [(s, g, ch, [float(v) for v in x[576 * g : 576 * g + 576]]) for (s, ch), x in signals.items() for g in range(len(x) // 576)]
    return spark.createDataFrame(rows, "stream_id long, granule long, channel int, pcm array<double>")


def snr(got, want, delay=DELAY, skip=2304):
    y, x = got[delay + skip :], want[skip : len(got) - delay]
    return 10 * np.log10(np.sum(x**2) / np.sum((y - x) ** 2))


def decoded(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.stream_id, r.channel), {})[r.granule] = r.pcm
    return {k: np.concatenate([v[g] for g in sorted(v)]) for k, v in out.items()}


@pytest.mark.parametrize("hz", [44100, 48000, 32000])
def test_round_trip(spark, books, hz):
    signals = {(s, ch): tone(576 * 20, hz, seed=10 * s + ch) for s in (1, 2) for ch in (0, 1)}
    frames = codec.encode(pcm_rows(spark, signals), hz, 320, 2, books)
    streams = codec.join_frames(frames).cache()
    assert all(len(r.content) == 10 * (144000 * 320 // hz) + (144000 * 320 % hz) * 10 // hz for r in streams.collect())
    got = decoded(codec.decode(streams, books))
    assert set(got) == set(signals)
    assert all(snr(got[k], signals[k]) > 30 for k in signals)


def test_small_tables_only(spark):
    signals = {(1, 0): tone(576 * 16)}
    streams = codec.join_frames(codec.encode(pcm_rows(spark, signals), 44100, 192, 1))
    assert snr(decoded(codec.decode(streams))[(1, 0)], signals[(1, 0)]) > 12


def test_missing_codebook_is_a_status(spark, books):
    streams = codec.join_frames(codec.encode(pcm_rows(spark, {(1, 0): tone(576 * 8)}), 44100, 320, 1, books))
    assert "CODEBOOK" in {r.status for r in codec.granules(codec.split_frames(streams)).collect()}


@pytest.fixture(scope="module")
def stream(spark):
    return bytes(codec.join_frames(codec.encode(pcm_rows(spark, {(1, 0): tone(576 * 48)}), 44100, 128, 1)).first().content)


def walk(spark, content):
    return [tuple(r)[1:11] for r in codec.split_frames(spark.createDataFrame([(1, bytearray(content))], "stream_id long, content binary")).orderBy("frame_no").collect()]


def test_garbage_tags_and_damage(spark, stream):
    plain = walk(spark, stream)
    assert [r[9] for r in plain] == ["OK"] * 24 and [r[0] for r in plain] == list(range(24))
    noise = bytes(np.random.default_rng(5).integers(0, 255, 700, dtype=np.uint8))
    assert [r[3] for r in walk(spark, noise + stream)] == [r[3] for r in plain]
    id3 = b"ID3\x04\0\0\0\0\1\0" + b"x" * 128
    assert [r[2] - 138 for r in walk(spark, id3 + stream)] == [r[2] for r in plain]
    xing = bytearray(stream[: plain[0][3]])
    xing[4:] = b"\0" * 17 + b"Xing" + b"\0" * (len(xing) - 25)
    assert len(walk(spark, bytes(xing) + stream)) == 24
    hole = walk(spark, stream[:6000] + stream[6300:])
    assert max(r[1] for r in hole) >= 1 and len(hole) >= 20
    cut = walk(spark, stream[:-100])
    assert cut[-1][9] == "TRUNCATED"
    assert walk(spark, b"") == [] and walk(spark, noise) == []
    layer2 = bytearray(stream)
    for r in plain:
        layer2[r[2] + 1] = 0xFD
    assert {r[9] for r in walk(spark, bytes(layer2))} <= {"UNSUPPORTED"}


def test_reservoir_is_spliced():
    body = bytes(range(200))
    s = codec.Splitter()
    s.reserve = body
    assert s.reserve[-10:] == body[190:]


def test_header_errors_and_validation():
    assert L.header(b"\xff\xfb\xf0\x00") is None and L.header(b"\xff\xfb\x9c\x00") is None and L.header(b"\xff") is None
    for bad in ((22050, 1, 128), (44100, 3, 128), (44100, 1, 100)):
        with pytest.raises(ValueError):
            codec.validate(*bad)


def test_seek_decodes_the_same(spark, stream):
    streams = spark.createDataFrame([(1, bytearray(stream))], "stream_id long, content binary")
    frames = codec.split_frames(streams)
    whole, part = (decoded(codec.synthesise(codec.granules(f)))[(1, 0)] for f in (frames, codec.seek(frames, 8 * 1152, lead=4)))
    assert np.allclose(whole[8 * 1152 :], part[4 * 1152 :], atol=1e-9)
    with pytest.raises(ValueError):
        codec.seek(frames, -1)


def test_pack(spark):
    pcm = spark.createDataFrame([(1, 0, c, [0.5 if c else -2.0] * 576) for c in (0, 1)], "stream_id long, granule long, channel int, pcm array<double>")
    assert np.frombuffer(codec.pack(pcm).first().data, "<i2")[:4].tolist() == [-32768, 16384, -32768, 16384]
    assert np.frombuffer(codec.pack(pcm, "f32").first().data, "<f4")[:2].tolist() == [-2.0, 0.5]


def test_files(spark, stream, tmp_path):
    (tmp_path / "a.mp3").write_bytes(stream)
    assert codec.split_frames(read_streams(spark, str(tmp_path))).count() == 24


def test_codebooks_are_prefix_free():
    for codes in huffman.load().values():
        words = sorted(codes.values())
        assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False) if a)
        assert len(words) == 1 or abs(sum(2.0 ** -len(w) for w in words) - 1) < 1e-12


def test_short_blocks_overlap():
    """Long, start, short, stop: the windows still cancel their aliases."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 32, 18))
    kinds, out, tail = [0, 1, 2, 3, 0], [], None
    c36, c12 = L.cosines()
    for g, kind in enumerate(kinds):
        z = np.concatenate((x[g], x[g + 1]), axis=1)
        if kind == 2:
            lines = np.zeros((32, 18))
            for w in range(3):
                lines[:, w::3] = z[:, 6 + 6 * w : 18 + 6 * w] * L.windows()[2] @ c12 / 3
        else:
            lines = z * L.windows()[kind] @ c36 / 9
        head, new = L.imdct(lines.ravel(), kind, 0)
        if tail is not None:
            out.append((head + tail, x[g]))
        tail = new
    assert all(np.allclose(a, b) for a, b in out)


def test_streaming_splitter(spark, stream, tmp_path):
    want = walk(spark, stream)
    source, seq = tmp_path / "in", 0
    rows = [(1, i, bytearray(stream[a : a + 900]), a + 900 >= len(stream)) for i, a in enumerate(range(0, len(stream), 900))]
    schema = "stream_id long, seq long, bytes binary, ended boolean"
    for part in (rows[0:2], rows[5:7], rows[1:5], rows[6:]):  # some come early, some twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = split_stream(chunks).writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r)[1:11] for r in spark.table("frames_out").orderBy("frame_no").collect()]
    assert seq == 0 and got == want


def test_masked_encoding_shapes_noise(spark, books):
    """The distortion loop leaves no more bands over their threshold than one gain does, and its scalefactors decode."""
    signal = tone(576 * 12)
    frames = codec.encode(pcm_rows(spark, {(1, 0): signal}), 44100, 64, 1, books, masked=True, rounds=12)
    got = decoded(codec.decode(codec.join_frames(frames), books))[(1, 0)]
    assert snr(got, signal, skip=1152) > 10


def test_distortion_loop_improves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=576) * np.exp(-np.arange(576) / 60) * 0.1
    bits, _, gain = L.rate_loop(x, 900, 44100, None)
    xmin = np.full(22, 1e-5)
    plain, _ = L.noise_metrics(x, L.quantised(x, gain), gain, 0 * np.arange(576), xmin, 44100)
    bits, _, gain, scf, scale, preflag = L.distortion_loop(x, xmin, 900, 44100, None, 20)
    extra = L.amplification(scf, scale, preflag, 44100)
    shaped, _ = L.noise_metrics(x, L.quantised(x, gain, extra), gain, extra, xmin, 44100)
    assert shaped <= plain and len(bits) + L.scalefac_slot(scf)[0] <= 900


def test_thresholds():
    from granula.functions import psycho as P

    n = np.arange(P.WINDOW + 2 * P.HOP)
    noise = np.random.default_rng(0).normal(size=len(n))
    raw_tone, e_tone = P.raw_thresholds(np.sin(2 * np.pi * 1000 * n / 44100), 44100)
    raw_noise, e_noise = P.raw_thresholds(noise, 44100)
    peak = int(e_tone.argmax())
    assert e_tone[peak] / raw_tone[peak] > e_noise[peak] / raw_noise[peak]  # a tone masks less than noise
    assert len(e_tone) == 62 and (P.capped(np.vstack([raw_noise, raw_noise * 50]), 44100)[1] <= np.maximum(2 * np.maximum(raw_noise, P.tables(44100).quiet), P.tables(44100).quiet) + 1e-9).all()
    assert np.allclose(P.unpredictability(np.exp(2j) * np.ones(3), np.exp(1j) * np.ones(3), np.ones(3)), 0)


def test_pre_echo_floor(spark):
    """The closed form against the recurrence, through silence: the floor holds inside it, so a loud granule is let back in time."""
    from granula.operators.signal import pre_echo

    rng, quiet = np.random.default_rng(2), 1e-4
    raw = np.exp(rng.normal(size=80) * 4)
    raw[20:23] = 0.0
    want = []
    for k, v in enumerate(raw):
        cap = min([v, *([2 * want[k - 1]] if k else []), *([16 * want[k - 2]] if k > 1 else [])])
        want.append(max(quiet, cap))
    rows = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(raw)], "b int, k long, v double")
    got = [r.c for r in pre_echo(rows, ["b"], "k", "v", F.lit(quiet), "c").orderBy("k").collect()]
    assert np.allclose(got, want, rtol=1e-9)


def test_a_bad_sample_ends_its_stream(spark):
    """Frames before the sample are coded as without it, those from it on are not; other streams go on."""
    signal = tone(576 * 8)
    bad = signal.copy()
    bad[576 * 4 + 7] = np.nan
    good = {r.frame_no: bytes(r.data) for r in codec.encode(pcm_rows(spark, {(1, 0): signal}), 44100, 64, 1).collect()}
    got = codec.encode(pcm_rows(spark, {(1, 0): bad, (2, 0): signal}), 44100, 64, 1).collect()
    assert {r.frame_no: bytes(r.data) for r in got if r.stream_id == 1} == {k: v for k, v in good.items() if k < 2}
    assert {r.frame_no: bytes(r.data) for r in got if r.stream_id == 2} == good
