"""Telephony audio in media columns: WAV files in, features and resampled PCM out.

``store`` puts bytes into a WAV container as 8-bit mu-law samples at 8 kHz, without loss.
``decode`` parses the containers that it reads back and goes by their format: mu-law and
A-law samples are expanded by lookup tables (both built from their rules), IMA ADPCM blocks
are decoded with numpy across all blocks of a batch, one nibble position at a time. The
samples are resampled and come out as a column of 16-bit PCM WAV files, to be stored where
the result is. Bytes of mu-law files are also read as A-law and as ADPCM, for features.

Scale: no shuffle; each batch is cut to a few megabytes, and every row is independent.

Edge cases: null counts as empty in ``store``; an empty payload is padded to one unit; a
null id is kept; repeated rows give repeated results; an empty table gives an empty result;
null media, bytes that are no WAV file, a WAV file of another format and blocks that are cut
short raise an error that names the id; a file without samples has zeros for features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNIT, RATE, ADPCM_BLOCK = 576, 8000, 36
_PCM, _ALAW, _MULAW, _ADPCM = 1, 6, 7, 0x11
_NAMES = {_ALAW: "alaw", _MULAW: "mulaw", _ADPCM: "adpcm"}

# Fixed values of IMA ADPCM: step sizes, and the change of the step's index by a nibble's lower three bits.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (G.711): inverted bits, a sign, 3 bits of exponent, 4 of mantissa, bias 33 << 2."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int32)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (G.711): every other bit inverted, linear in the lowest exponent."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, bytes) to samples (n, 2 * (bytes - 4) + 1); the blocks are decoded side by side."""
    steps, changes = np.array(STEPS, np.int32), np.array(INDEX_CHANGES, np.int32)
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    for i in range(2 * (width - 4)):
        nibble = ((blocks[:, 4 + i // 2] >> (4 * (i % 2))) & 15).astype(np.int32)
        step = steps[index]
        change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + changes[nibble & 7], 0, len(STEPS) - 1)
        out[i + 1] = value
    return out.T


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation from one rate to another, in whole numbers."""
    if source == target or not len(samples):
        return samples.astype(np.int16)
    at = np.arange(len(samples) * target // source, dtype=np.int64) * source
    left, part = at // target, (at % target).astype(np.int32)
    right = np.minimum(left + 1, len(samples) - 1)
    return ((samples[left] * (target - part) + samples[right] * part) // target).astype(np.int16)


def wav(data: bytes, form: int, rate: int, bits: int, block: int | None = None) -> bytes:
    """A WAV file of one channel; chunks have even lengths. ``block`` is given for blocks of several samples."""
    unit = block or bits // 8
    fmt = struct.pack("<HHIIHHH", form, 1, rate, rate * unit, unit, bits, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) // unit) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wav(raw: bytes | None) -> tuple[int, int, int, int, bytes]:
    """(format, rate, bytes of a block, bits of a sample, data) of a WAV file of one channel."""
    if raw is None or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, about = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if channels != 1:
                raise ValueError("more than one channel")
            about = form, rate, block, bits
        elif name == b"data" and about:
            return *about, raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _place(data: bytes, form: int, block: int) -> int:
    """How many samples the data has; an error if they can't be telephony samples."""
    if form not in _NAMES:
        raise ValueError(f"samples of format {form}")
    if form != _ADPCM:
        return len(data)
    if block <= 4 or len(data) % block:
        raise ValueError("blocks that are cut short")
    return len(data) // block * (2 * (block - 4) + 1)


def expand(form: int, block: int, codes: np.ndarray) -> np.ndarray:
    """Samples of mu-law or A-law codes, or of ADPCM blocks of ``block`` bytes, one after another."""
    if form == _ADPCM:
        return decode_adpcm(codes.reshape(-1, block)).reshape(-1).astype(np.int32)
    return (mulaw_table() if form == _MULAW else alaw_table())[codes]


def _store(batches):
    for batch in small_batches(batches):
        sizes, files = [], []
        for raw in batch.column(1).to_pylist():
            raw = raw or b""
            sizes.append(len(raw))
            files.append(wav(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\xff"), _MULAW, RATE, 8))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", bytes_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the column's bytes (a text's UTF-8), padded with 255 to a positive multiple of UNIT, as a mu-law WAV file."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(bytes_col).cast("string").cast("binary") if dict(docs.dtypes)[bytes_col] != "binary" else F.col(bytes_col))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _rms(samples: np.ndarray) -> int:
    return int(np.sqrt((samples.astype(np.float64) ** 2).mean())) if len(samples) else 0


def _rows(parsed: list[tuple]) -> list[np.ndarray]:
    """The samples of every (format, rate, block, bits, data); files of one format are expanded together."""
    out: list = [None] * len(parsed)
    for form, block in sorted({(p[0], p[2]) for p in parsed}):
        own = [i for i, p in enumerate(parsed) if (p[0], p[2]) == (form, block)]
        samples = expand(form, block, np.frombuffer(b"".join(parsed[i][4] for i in own), np.uint8))
        ends = np.cumsum([_place(parsed[i][4], form, block) for i in own])
        for i, part in zip(own, np.split(samples, ends[:-1]), strict=True):
            out[i] = part
    return out


def _features(form: int, data: bytes, samples: np.ndarray, energy: np.ndarray | None, pcm: bytes) -> str:
    crossed = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    other = ""
    if form == _MULAW and energy is not None:
        per_block = 2 * (ADPCM_BLOCK - 4) + 1
        adpcm = int(np.sqrt(energy.sum() / (len(energy) * per_block))) if len(energy) else 0
        other = f"alaw_rms={_rms(alaw_table()[np.frombuffer(data, np.uint8)])};adpcm_rms={adpcm};"
    return f"{_NAMES[form]}_rms={_rms(samples)};peak={int(np.abs(samples).max(initial=0))};crossings={crossed};{other}pcm_crc32={zlib.crc32(pcm)}"


def _decode(pcm_rate: int):
    def run(batches):
        for batch in small_batches(batches, 4 << 20):
            files, parsed = batch.column(2).to_pylist(), []
            for doc_id, raw in zip(batch.column(0).to_pylist(), files, strict=True):
                try:
                    parsed.append(parse_wav(raw))
                    _place(parsed[-1][4], parsed[-1][0], parsed[-1][2])
                except (ValueError, struct.error) as e:
                    raise ValueError(f"media of id {doc_id}: {e}") from e
            # mu-law bytes read as ADPCM blocks, all at once; a rest that is no whole block is left out
            whole = [p[4][: len(p[4]) // ADPCM_BLOCK * ADPCM_BLOCK] if p[0] == _MULAW else b"" for p in parsed]
            energy = (decode_adpcm(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, ADPCM_BLOCK)).astype(np.float64) ** 2).sum(1)
            energies = np.split(energy, np.cumsum([len(w) // ADPCM_BLOCK for w in whole])[:-1])
            features, pcms = [], []
            for (form, rate, _block, _bits, data), samples, part in zip(parsed, _rows(parsed), energies, strict=True):
                pcm = resample(samples, rate, pcm_rate).tobytes()
                features.append(_features(form, data, samples, part, pcm))
                pcms.append(wav(pcm, _PCM, pcm_rate, 16))
            payloads = [p[4] for p in parsed]
            columns = [
                batch.column(0), batch.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                pa.array([len(m) for m in files], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in files], pa.string()), pa.array(features, pa.string()), pa.array(pcms, pa.binary()),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def decode(media: DataFrame, pcm_rate: int = 16000) -> DataFrame:
    """Digests and features of (doc_id, n_bytes, media), and ``pcm``, a 16-bit WAV file at ``pcm_rate``."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(_decode(pcm_rate), schema)
