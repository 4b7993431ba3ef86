"""Frame splitting as a stateful streaming query: chunks of many streams in, frames out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granula.operators.codec import _FRAME_NAMES, FRAMES, Splitter

STATE = "data binary, base long, frame_no long, segment long, reserve binary, free int, last binary, seq long, ended boolean, waiting binary"


_HEAD = struct.Struct("<q?i")


def _packed(waiting: dict[int, tuple[bytes, bool]]) -> bytes:
    return b"".join(_HEAD.pack(seq, ended, len(data)) + data for seq, (data, ended) in sorted(waiting.items()))


def _unpacked(packed: bytes) -> dict[int, tuple[bytes, bool]]:
    out, at = {}, 0
    while at < len(packed):
        seq, ended, size = _HEAD.unpack_from(packed, at)
        at += _HEAD.size
        out[seq] = packed[at : at + size], ended
        at += size
    return out


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Chunks are numbered 0, 1, 2, ...; one that comes early waits in the state for those before it, one already taken is a repeat."""
    if state.exists:
        *kept, seq, ended, waiting = state.get
        split, waiting = Splitter(*(bytes(x) if isinstance(x, (bytes, bytearray, memoryview)) else x for x in kept)), _unpacked(bytes(waiting))
    else:
        split, seq, ended, waiting = Splitter(), -1, False, {}
    for part in parts:
        for chunk in part.itertuples(index=False):
            if chunk.seq > seq:
                waiting.setdefault(int(chunk.seq), (bytes(chunk.bytes or b""), bool(chunk.ended)))
    rows = []
    while seq + 1 in waiting and not ended:
        seq += 1
        data, ended = waiting.pop(seq)
        split.data += data
        rows += [(key[0], *r) for r in split.frames(ended)]
    if ended:
        waiting = {}
    state.update((split.data, split.base, split.frame_no, split.segment, split.reserve, split.free, split.last, seq, ended, _packed(waiting)))
    yield pd.DataFrame(rows, columns=_FRAME_NAMES)


def split_stream(chunks: DataFrame) -> DataFrame:
    """FRAMES of a streaming DataFrame of chunks(stream_id long, seq long, bytes binary, ended boolean).

    State per stream: the bytes of an unfinished frame, at most a resync window, 511 bytes of reservoir, and chunks that came before
    their turn. Nothing follows an end marker.
    """
    return chunks.groupBy("stream_id").applyInPandasWithState(_step, FRAMES, STATE, "append", GroupStateTimeout.NoTimeout)
