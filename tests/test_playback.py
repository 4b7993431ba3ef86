"""Tags, gapless trim, seeks and end states of whole streams against plain slices of the decoded signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_codec import decoded, pcm_rows, tone

from granula.operators import codec, playback

SILENT = bytes.fromhex("FFFB90C4") + bytes(413)


def xing(frames, delay, padding):
    body = bytes.fromhex("FFFB90C4") + bytes(17) + b"Xing" + (1).to_bytes(4, "big") + frames.to_bytes(4, "big") + b"LAME" + bytes(17) + (delay << 12 | padding).to_bytes(3, "big")
    return body.ljust(417, b"\0")


@pytest.fixture(scope="module")
def plain(spark):
    return bytes(codec.join_frames(codec.encode(pcm_rows(spark, {(1, 0): tone(576 * 28)}), 44100, 128, 1)).first().content)


def heard(df):
    got = sorted((r.at, r.pcm) for r in df.collect())
    ends = [at + len(p) for at, p in got]
    assert [at for at, _ in got][1:] == ends[:-1]  # gapless
    return (got[0][0] if got else None), np.concatenate([p for _, p in got]) if got else np.empty(0)


def one(spark, content):
    return spark.createDataFrame([(1, bytearray(content))], "stream_id long, content binary")


def test_play_trims_delay_and_padding(spark, plain):
    want = decoded(codec.decode(one(spark, plain)))[(1, 0)]
    for frames, lo, hi in ((14, 1057, 14 * 1152 - 700), (0, 1057, 14 * 1152)):
        at, got = heard(playback.play(one(spark, xing(frames, 1057, 700) + plain)))
        assert at == 0 and np.allclose(got, want[lo:hi])
    at, got = heard(playback.play(one(spark, plain)))
    assert at == 0 and np.allclose(got, want)


def test_seek_past_any_end_does_not_overflow(spark):
    s = one(spark, xing(0, 500, 0) + SILENT * 12)
    targets = spark.createDataFrame([(1, v) for v in (2**63 - 1, -1, 0)], "stream_id long, sample long")
    got = {r.sample: (r.state, r.landed) for r in playback.seek_targets(targets, playback.stream_info(s), codec.split_frames(s)).collect()}
    assert got == {2**63 - 1: ("END", 12 * 1152), -1: ("INVALID", None), 0: ("OK", 0)}
