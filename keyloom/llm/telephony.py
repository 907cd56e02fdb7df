"""Telephony audio columns: G.711 and IMA ADPCM payloads to linear 16-bit PCM at twice the rate.

Mu-law and A-law bytes are expanded through 256-entry tables.  ADPCM comes in blocks of BLOCK bytes (predictor, step index, then
four-bit codes, low half first, as in WAV files): a block's codes depend on each other but blocks don't, so that all
blocks of a slice, whatever rows they come from, are decoded side by side, one code of each at a time.  The 8 kHz signal is
resampled to 16 kHz by a half-band windowed sinc in integers, the same on any machine: even samples are the source's, odd ones
lie between.

Plan: one Arrow pass, no shuffle; payloads are taken in slices of bounded size, since PCM is up to eight times as large.  A payload above SLICE is decoded by itself.

The tables hold no audio: as stand-in, media_column takes the bytes of each document as the payload of one of the three codecs.

Defined results: a null payload or an unknown or null codec gives null PCM and null n_samples; an empty payload has 0 samples; of an ADPCM payload's last block
a rest of fewer than 4 bytes is dropped; a payload whose PCM would exceed LARGEST bytes, which no binary value can hold (268 MB of ADPCM, 537 MB of G.711), has its n_samples and null PCM; step indexes above 88 count as 88; repeated rows are decoded each; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import text_slices, utf8

RATE = 8000
LARGEST = (1 << 31) - 1
BLOCK = 256
SLICE = 1 << 20
CODECS = ("mulaw", "alaw", "adpcm")
_TAPS = 8


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796]
    + [876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# what a code adds to the predictor at each step index, and the index after it
_CODES = np.arange(16)
_DELTA = np.array([(s >> 3) + np.where(_CODES & 4, s, 0) + np.where(_CODES & 2, s >> 1, 0) + np.where(_CODES & 1, s >> 2, 0) for s in STEPS])
_DELTA = np.where(_CODES & 8, -_DELTA, _DELTA).astype(np.int32).ravel()
_NEXT = np.clip(np.arange(89)[:, None] + _MOVES, 0, 88).astype(np.int32).ravel()


def _between() -> np.ndarray:
    """Weights, in 1/16384, of the _TAPS samples on each side for the point half-way; they sum to one half."""
    t = np.arange(_TAPS) + 0.5
    w = np.sin(np.pi * t) / (np.pi * t) * np.cos(np.pi * t / (2 * _TAPS + 1)) ** 2
    q = np.rint(w / w.sum() * 8192).astype(np.int32)
    q[0] += 8192 - q.sum()
    return q


BETWEEN = _between()


def adpcm_samples(sizes: np.ndarray) -> np.ndarray:
    """The samples of ADPCM payloads of sizes bytes."""
    full, rest = sizes // BLOCK, sizes % BLOCK
    return full * (2 * (BLOCK - 4) + 1) + np.where(rest >= 4, 2 * (rest - 4) + 1, 0)


def decode_adpcm(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of payloads laid end to end, and their offsets; all blocks step by step together."""
    sizes = np.diff(offsets)
    n_blocks = sizes // BLOCK + (sizes % BLOCK >= 4)
    cuts = np.concatenate(([0], np.cumsum(adpcm_samples(sizes))))
    if not n_blocks.sum():
        return np.zeros(0, np.int16), cuts
    within = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = np.repeat(offsets[:-1], n_blocks) + within * BLOCK
    size = np.minimum(np.repeat(offsets[1:], n_blocks) - begin, BLOCK)
    order = np.argsort(-size, kind="stable")  # the longest first, so that those still at work are the first ones
    begin_o, size_o = begin[order], size[order]
    predictor = (data[begin_o].astype(np.uint16) | (data[begin_o + 1].astype(np.uint16) << 8)).view(np.int16).astype(np.int32)
    index = np.minimum(data[begin_o + 2], 88).astype(np.int32)
    out = np.zeros((2 * (BLOCK - 4) + 1, len(order)), np.int16)
    out[0] = predictor
    for k in range(int(size_o[0]) - 4):
        n = int(np.searchsorted(-size_o, -(k + 4), side="left"))  # blocks with more than k + 4 bytes
        byte = data[begin_o[:n] + 4 + k]
        for half, code in enumerate((byte & 15, byte >> 4)):
            cell = index[:n] * 16 + code
            predictor[:n] += _DELTA[cell]
            np.clip(predictor[:n], -32768, 32767, out=predictor[:n])
            index[:n] = _NEXT[cell]
            out[1 + 2 * k + half, :n] = predictor[:n]
    rows = np.empty_like(out.T)
    rows[order] = out.T
    samples = 2 * (size - 4) + 1
    return rows[np.arange(rows.shape[1]) < samples[:, None]], cuts


def resample(samples: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Signals laid end to end at twice the rate; each is silent outside itself."""
    sizes = np.diff(cuts)
    padded = np.zeros(len(samples) + 2 * _TAPS * len(sizes), np.int32)
    own = np.arange(len(samples)) + np.repeat(_TAPS + 2 * _TAPS * np.arange(len(sizes)), sizes)
    padded[own] = samples
    odd = np.zeros(len(samples), np.int32)
    n = len(padded)
    total = np.zeros(n, np.int32)
    for k in range(_TAPS):
        total[_TAPS : n - _TAPS] += BETWEEN[k] * (padded[_TAPS - k : n - _TAPS - k] + padded[_TAPS + 1 + k : n - _TAPS + 1 + k][: n - 2 * _TAPS])
    odd = np.clip((total[own] + 8192) >> 14, -32768, 32767)
    out = np.empty(2 * len(samples), np.int16)
    out[0::2] = samples
    out[1::2] = odd
    return out


def _spread(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of (row numbers, values, offsets) parts as one run of values in row order, with offsets."""
    sizes = np.zeros(rows, np.int64)
    for at, _, cuts in parts:
        sizes[at] = np.diff(cuts)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(ends[-1], np.int16)
    for at, values, cuts in parts:
        n = np.diff(cuts)
        out[np.repeat(ends[at] - cuts[:-1], n) + np.arange(len(values))] = values
    return out, ends


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, "payload", SLICE):
            data, off = utf8(batch.column("payload"))
            codec = np.array(batch.column("codec").to_pylist(), object)
            known = batch.column("payload").is_valid().to_numpy(zero_copy_only=False) & np.isin(codec, CODECS)
            n_samples = 2 * np.where(codec == "adpcm", adpcm_samples(np.diff(off)), np.diff(off))
            fits = known & (2 * n_samples <= LARGEST)
            parts = []
            for name in CODECS:
                at = np.flatnonzero(fits & (codec == name))
                if not len(at):
                    continue
                n = np.diff(off)[at]
                cuts = np.concatenate(([0], np.cumsum(n)))
                own = data[np.repeat(off[:-1][at] - cuts[:-1], n) + np.arange(cuts[-1])]
                if name == "adpcm":
                    samples, cuts = decode_adpcm(own, cuts)
                else:
                    samples = (MULAW if name == "mulaw" else ALAW)[own]
                parts.append((at, resample(samples, cuts), 2 * cuts))
            pcm, ends = _spread(parts, batch.num_rows)
            mask = pa.py_buffer(np.packbits(fits, bitorder="little").tobytes())
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [mask, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(pcm)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("codec"), pa.array(np.full(batch.num_rows, 2 * RATE, np.int32)), pa.array(n_samples, mask=~known), column], ["doc_id", "codec", "sample_rate", "n_samples", "pcm"])


def decode_calls(media: DataFrame) -> DataFrame:
    """(doc_id, codec, sample_rate, n_samples, pcm) of (doc_id, codec, payload); pcm is 16-bit little-endian."""
    return media.select(F.col("doc_id").cast("long"), F.col("codec").cast("string"), F.col("payload").cast("binary")).mapInArrow(_decode, "doc_id long, codec string, sample_rate int, n_samples long, pcm binary")


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, codec, payload): each document's bytes as a call's payload, its codec by doc_id."""
    codec = F.element_at(F.array(*[F.lit(c) for c in CODECS]), (F.pmod(F.col("doc_id").cast("long"), F.lit(len(CODECS))) + 1).cast("int"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), codec).alias("codec"), F.encode(F.col("text").cast("string"), "utf-8").alias("payload"))
