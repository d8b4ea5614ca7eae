"""Telephony audio in a media column: mu-law and A-law by lookup tables, IMA ADPCM decoded across blocks, resampled PCM out.

WAV containers hold the codes. Decoders take the whole stream as arrays; an ADPCM block depends on nothing before it, so the
loop runs over the samples of a block and numpy over all blocks of many rows at once. Rates change by a windowed-sinc filter,
a phase of it for each place between two samples, in whole numbers.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, slices, table, tidy

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE = 8000
#: A text's bytes are padded with PAD to a positive multiple of UNIT.
UNIT, PAD = 576, 255
#: Bytes of an ADPCM block, a divisor of UNIT; the rate of stored PCM; taps of a phase of the filter, and what they add up to.
IMA_BLOCK, PCM_RATE, TAPS, SCALE = 192, 16000, 16, 1 << 14


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (G.711)."""
    c = ~np.arange(256) & 0xFF
    x = (((c & 15) << 3) + 132 << ((c >> 4) & 7)) - 132
    return np.where(c & 128, -x, x).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (G.711)."""
    c = np.arange(256) ^ 0x55
    e, m = (c >> 4) & 7, (c & 15) << 4
    x = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 128, x, -x).astype(np.int16)


EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}

# Fixed values of the IMA ADPCM format.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272,
    2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500,
    20350, 22385, 24623, 27086, 29794, 32767,
])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def ima_decode(data: bytes, block: int) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks of `block` bytes; an incomplete last block ends early."""
    raw = np.frombuffer(data, np.uint8)
    count = -(-len(raw) // block)
    padded = np.zeros(count * block, np.uint8)
    padded[: len(raw)] = raw
    b = padded.reshape(count, block)
    value = b[:, 0].astype(np.int64) | b[:, 1].astype(np.int64) << 8
    value -= (value >= 32768) << 16
    index = np.clip(b[:, 2].astype(np.int64), 0, 88)
    nibbles = np.stack([b[:, 4:] & 15, b[:, 4:] >> 4], axis=2).reshape(count, -1).astype(np.int64)
    out = np.empty((count, nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        n, step = nibbles[:, k], IMA_STEPS[index]
        move = (step >> 3) + np.where(n & 4, step, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 1, step >> 2, 0)
        value = np.clip(value + np.where(n & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[n & 7], 0, 88)
        out[:, k + 1] = value
    missing = 2 * (count * block - len(raw))
    flat = out.reshape(-1)
    return flat[: len(flat) - missing] if missing else flat


def wav(codes: bytes, codec: int, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A mono WAV file of a codec's data."""
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if codec == IMA else b"" if codec == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", codec, 1, rate, rate * block, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(codes)) + codes + b"\0" * (len(codes) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block, data) of a WAV file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    codec, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    return codec, rate, block, found[b"data"]


def pcm(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a WAV file in any of the codecs."""
    codec, rate, block, data = unwav(media)
    if codec in EXPAND:
        return rate, EXPAND[codec][np.frombuffer(data, np.uint8)]
    if codec == IMA:
        return rate, ima_decode(data, block)
    if codec == PCM:
        return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    raise ValueError(f"codec {codec}")


@functools.lru_cache(maxsize=16)
def phases(up: int, down: int) -> np.ndarray:
    """Whole-number taps of each phase of a windowed-sinc low-pass filter; each phase adds up to SCALE."""
    cut = min(1.0, up / down)
    at = np.arange(TAPS) - (TAPS // 2 - 1) - np.arange(up)[:, None] / up
    h = np.sinc(at * cut) * (0.5 + 0.5 * np.cos(np.pi * np.clip(at / (TAPS / 2), -1, 1)))
    taps = np.rint(h / h.sum(1, keepdims=True) * SCALE)
    taps[np.arange(up), np.abs(at).argmin(1)] += SCALE - taps.sum(1)
    return taps


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate: len(x) * to // rate of them. The ends are held; sums are exact, so results are the same everywhere."""
    if rate == to or not len(x):
        return x
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    taps, n = phases(up, down), len(x) * to // rate
    wide = np.pad(x.astype(np.float64), (TAPS // 2 - 1, TAPS // 2), mode="edge")
    out = np.empty(n, np.int16)
    for p in range(up):
        where = np.arange(p, n, up) if down == 1 else np.flatnonzero(np.arange(n) * down % up == p)
        if len(where):
            first = where * down // up
            y = np.convolve(wide, taps[p][::-1], "valid")[first] if 2 * len(first) > len(x) else (wide[first[:, None] + np.arange(TAPS)] * taps[p]).sum(1)
            out[where] = np.clip(np.floor((y + SCALE / 2) / SCALE), -32768, 32767)
    return out


def features(x: np.ndarray) -> str:
    """Samples, mean square, zero crossings, peak and CRC-32 of PCM."""
    if not len(x):
        return "0:0:0:0:00000000"
    sign = x < 0
    energy = int(np.dot(x.astype(np.float64), x)) // len(x)
    return f"{len(x)}:{energy}:{int(np.count_nonzero(sign[1:] != sign[:-1]))}:{max(int(x.max()), -int(x.min()))}:{zlib.crc32(np.ascontiguousarray(x)):08x}"


def padded(data: bytes) -> bytes:
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data + bytes([PAD]) * (size - len(data))


def many_pcm(media: list[bytes | None]) -> list[tuple[int, np.ndarray] | Exception | None]:
    """pcm() of many files, or why it can't be had; ADPCM blocks of a size are decoded together, whichever file they are from."""
    out: list = []
    joined: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, x in enumerate(media):
        try:
            if x is None:
                out.append(None)
                continue
            codec, rate, block, data = unwav(x)
            if codec == IMA and block > 4 and data and len(data) % block == 0:
                joined.setdefault(block, []).append((i, rate, data))
                out.append(None)
            else:
                out.append(pcm(x))
        except (ValueError, KeyError, IndexError, struct.error) as e:
            out.append(e)
    for block, rows in joined.items():
        flat, at = ima_decode(b"".join(d for *_, d in rows), block), 0
        for i, rate, data in rows:
            n = len(data) // block * (2 * (block - 4) + 1)
            out[i] = (rate, flat[at : at + n])
            at += n
    return out


def _stored(codec: int | None):
    """Batches (doc_id, text) to (doc_id, n_bytes, media)."""

    def one(raw: bytes) -> bytes:
        data = padded(raw)
        c = (MULAW, ALAW, IMA)[zlib.crc32(data) % 3] if codec is None else codec
        return wav(data, c, bits=4, block=IMA_BLOCK) if c == IMA else wav(data, c)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw = [(t or "").encode() for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in raw], pa.int64()), pa.array([one(x) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def _decoded(rate: int):
    """Batches with a last column media to the same with pcm and error."""

    def run(batches):
        for batch in batches:
            found = many_pcm(batch.column(batch.num_columns - 1).to_pylist())
            out = [None if x is None or isinstance(x, Exception) else resample(x[1], x[0], rate).astype("<i2").tobytes() for x in found]
            bad = [str(x) or type(x).__name__ if isinstance(x, Exception) else None for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(bad, pa.string())], [*batch.schema.names, "pcm", "error"])

    return run


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(batches):
    """Batches (doc_id, n_bytes, media, pcm, error) to DESCRIBED."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        for media, samples in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            codec, _, _, payload = unwav(media)
            rows.append((len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media), f"{codec}:{features(np.frombuffer(samples, '<i2'))}"))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in DESCRIBED.split(", ")])


def _mapped(df: DataFrame, steps: list, schema: str) -> DataFrame:
    """The steps one after the other in one worker, some hundred kB of text at a time."""
    arrow_rows(df.sparkSession)

    def run(batches):
        for step in steps:
            batches = step(batches)
        yield from batches

    return df.mapInArrow(tidy(run), schema)


def stored(df: DataFrame, codec: int | None = MULAW) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded, as the codes of a mono WAV file: samples of mu-law or A-law, or blocks
    of ADPCM. codec None takes one of the three by the payload's CRC-32, so equal texts have equal files.

    df: doc_id, text, other columns ignored. A null text is empty; a null doc_id stays null; repeated rows stay.
    """
    return _mapped(df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text"), [_stored(codec)], "doc_id long, n_bytes long, media binary")


def decoded(df: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """(doc_id, media, pcm, error): the media column of df and its little-endian 16-bit PCM at `rate`.

    pcm is null for a null file, and null with an error where a file can't be read. Repeated rows stay; other columns are ignored.
    """
    return _mapped(df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(media AS BINARY) media"), [_decoded(rate)], "doc_id long, media binary, pcm binary, error string")


def described(df: DataFrame, codec: int | None = None, rate: int = PCM_RATE) -> DataFrame:
    """Sizes, digests and features of every text stored as media and of its stored PCM, all from the bytes read back.

    df: doc_id, text, other columns ignored; nulls and repeated rows as in stored(). The feature has the codec, and of the PCM at
    `rate` the samples, mean square, zero crossings, peak and CRC-32.
    """
    return _mapped(df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text"), [_stored(codec), _decoded(rate), _described], DESCRIBED)


def op4_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a telephony WAV file, mu-law, A-law or ADPCM, and as resampled PCM: sizes, digests and features of the bytes read back."""
    return described(table(spark, sf_dir, "documents"))
