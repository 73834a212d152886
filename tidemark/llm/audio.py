"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM blocks, resampled PCM.

Each table is built from the codec's rule.  ADPCM is serial inside a block, so numpy steps through
the samples of all blocks at once.  Payloads travel in a RIFF/WAVE container whose data chunk holds
them unchanged.  Media and resampled PCM are columns of a table in the shared folder; features
are computed from what is read back.  The PCM is stored whole but losslessly coded: the samples at
the source's instants, then the others as differences from the line between their neighbours, which
compress well; reading undoes it sample by sample.

Defined results: null texts count as empty; an empty text is 64 zero bytes; equal texts give equal
values; repeated rows give repeated results; an empty table gives an empty result; extra columns
are ignored.  Batches are cut by bytes, so long texts don't add up in memory.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import fresh_path, table, texts

UNIT = 64
RATE, TARGET_RATE = 8000, 16000
MULAW, ALAW, ADPCM = 7, 6, 17
STEP_BYTES = 4 << 20
ZSTD_LEVEL = 6


@functools.cache
def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits; sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; the lowest segment is linear."""
    a = np.arange(256) ^ 0x55
    seg, low = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(seg == 0, low, (low + 256) << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


@functools.cache
def adpcm_steps() -> np.ndarray:
    """IMA step sizes, fixed by the standard."""
    return np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: (blocks, bytes) unsigned bytes -> (blocks, samples) PCM.

    A block opens with its first sample (16 bits, little-endian), a step index (clamped to the
    table) and a spare byte; then come two samples a byte, low half first.
    """
    steps, n = adpcm_steps(), blocks.shape[1] - 4
    out = np.empty((1 + 2 * n, blocks.shape[0]), np.int16)
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(steps) - 1).astype(np.int32)
    move = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(n):
        for j, half in enumerate((data[i] & 15, data[i] >> 4)):
            size, step = half & 7, steps[index]
            delta = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            value = np.clip(value + np.where(half & 8, -delta, delta), -32768, 32767)
            index = np.clip(index + move[size], 0, len(steps) - 1)
            out[1 + 2 * i + j] = value
    return out.T


def resample(pcm: np.ndarray, ends: np.ndarray, up: int = TARGET_RATE // RATE) -> np.ndarray:
    """Linear interpolation by a whole factor, each clip by itself; the last sample is held."""
    after = np.append(pcm[1:], pcm[-1:])
    after[ends - 1] = pcm[ends - 1]
    a, b = pcm.astype(np.int32), after.astype(np.int32)
    return np.stack([(a * (up - k) + b * k) // up for k in range(up)], axis=1).astype("<i2").reshape(-1)


def wave(payload: bytes, codec: int = MULAW, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file that holds the payload as 8-bit samples of the codec."""
    pad = b"\0" * (len(payload) & 1)
    fmt = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[int, int, bytes]:
    """Codec, rate and payload of a RIFF/WAVE file; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(codec: int, payload: bytes, block: int = UNIT) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    if codec == MULAW:
        return mulaw_table()[raw]
    if codec == ALAW:
        return alaw_table()[raw]
    if codec == ADPCM:
        return decode_adpcm(raw.reshape(-1, block)).reshape(-1)
    raise ValueError(f"codec {codec} is not a telephony codec")


def padded(data: bytes) -> bytes:
    return data + b"\0" * (UNIT - len(data) if not data else -len(data) % UNIT)


def features(payloads: list[bytes], clips: list[bytes]) -> list[str]:
    """Of read-back payloads and their resampled PCM: mean square and zero crossings of the mu-law
    reading, checksums of the PCM, of the A-law reading and of the payload read as ADPCM blocks."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum([len(p) for p in payloads])
    starts = np.concatenate([[0], ends[:-1]])
    pcm, other = mulaw_table()[raw], alaw_table()[raw].astype("<i2")
    energy = np.add.reduceat(pcm.astype(np.int64) ** 2, starts) // (ends - starts)
    flips = np.zeros(len(raw), np.int64)
    flips[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    flips[starts] = 0
    crossings = np.add.reduceat(flips, starts)
    blocks = decode_adpcm(raw.reshape(-1, UNIT)).astype("<i2")
    sums = [(zlib.crc32(other[s:e].tobytes()), zlib.crc32(np.ascontiguousarray(blocks[s // UNIT : e // UNIT]).tobytes())) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [f"{energy[k]}:{crossings[k]}:{zlib.crc32(clip)}:{a}:{b}" for k, (clip, (a, b)) in enumerate(zip(clips, sums, strict=True))]


def resampled(payloads: list[bytes]) -> list[bytes]:
    """The mu-law readings at the target rate, 16 bits, little-endian."""
    up = TARGET_RATE // RATE
    ends = np.cumsum([len(p) for p in payloads])
    wide = resample(mulaw_table()[np.frombuffer(b"".join(payloads), np.uint8)], ends)
    return [wide[(e - len(p)) * up : e * up].tobytes() for p, e in zip(payloads, ends.tolist(), strict=True)]


def coded(clip: bytes, up: int = TARGET_RATE // RATE) -> bytes:
    """PCM as its samples at the source's instants, then the rest as differences from interpolation."""
    grid = np.frombuffer(clip, "<i2").reshape(-1, up)
    rest = grid[:, 1:] - _between(grid[:, 0], up)
    return np.concatenate([grid[:, 0], rest.T.reshape(-1)]).astype("<i2").tobytes()


def uncoded(data: bytes, up: int = TARGET_RATE // RATE) -> bytes:
    """The PCM that `coded` was given, whatever it was."""
    phases = np.frombuffer(data, "<i2").reshape(up, -1)
    return np.column_stack([phases[0], phases[1:].T + _between(phases[0], up)]).astype("<i2").tobytes()


def _between(at: np.ndarray, up: int) -> np.ndarray:
    """16-bit values on the line from each sample to the next; the last sample is held."""
    after = np.append(at[1:], at[-1:])
    a, b = at.astype(np.int32), after.astype(np.int32)
    return np.stack([(a * (up - k) + b * k) // up for k in range(1, up)], axis=1).astype(np.int16)


def _batched(df: DataFrame, size: int, fn, schema: str) -> DataFrame:
    """fn on lists of the columns' values, in batches of about STEP_BYTES of the column `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            lengths = np.cumsum([len(x) for x in cols[size]]) // STEP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    yield pa.RecordBatch.from_pydict(fn(*(c[i:j] for c in cols)))

    return df.mapInArrow(run, schema)


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text", code: bool = False) -> DataFrame:
    """id, bytes of the text, the media (WAVE, mu-law) and the resampled PCM of each text.

    With `code` the PCM is the column pcm_coded instead, losslessly coded for storage.
    """
    column = "pcm_coded" if code else "pcm"

    def make(ids: list, values: list[str]) -> dict[str, pa.Array]:
        data = [t.encode() for t in values]
        payloads = [padded(d) for d in data]
        pcm = [coded(c) for c in resampled(payloads)] if code else resampled(payloads)
        return {id_col: pa.array(ids, pa.int64()), "n_bytes": pa.array([len(d) for d in data], pa.int64()), "media": pa.array([wave(p) for p in payloads], pa.binary()), column: pa.array(pcm, pa.binary())}

    return _batched(texts(docs, id_col, text=text), 1, make, f"{id_col} long, n_bytes long, media binary, {column} binary")


def digest(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of stored media and PCM (plain or coded), from the bytes that are read back."""
    column = "pcm_coded" if "pcm_coded" in stored.columns else "pcm"

    def make(ids: list, n: list[int], media: list[bytes], pcm: list[bytes]) -> dict[str, pa.Array]:
        back = [unwave(m)[2] for m in media]
        pcm = [uncoded(c) for c in pcm] if column == "pcm_coded" else pcm
        long = lambda x: pa.array(x, pa.int64())
        hashes = lambda x: pa.array([hashlib.sha256(y).hexdigest() for y in x])
        return {id_col: long(ids), "n_bytes": long(n), "payload_bytes": long([len(p) for p in back]), "payload_sha256": hashes(back), "tail_crc32": long([zlib.crc32(p[-64:]) for p in back]), "media_bytes": long([len(m) for m in media]), "media_sha256": hashes(media), "feature": pa.array(features(back, pcm)), "pcm_bytes": long([len(p) for p in pcm])}

    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long"
    return _batched(stored.select(id_col, "n_bytes", "media", column), 3, make, schema)


def stored_and_read(docs: DataFrame, path: str) -> DataFrame:
    """Media and coded PCM as columns of a table, read again."""
    store(docs, code=True).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(ZSTD_LEVEL)).parquet(path)
    return docs.sparkSession.read.parquet(path)


def op9_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(stored_and_read(table(spark, sf_dir, "documents"), fresh_path(spark, "media")))
