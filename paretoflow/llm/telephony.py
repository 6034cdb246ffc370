"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers.

``payloads`` pads a text's bytes to whole blocks, ``store`` writes them as the data chunk of a
WAV file (lossless: the bytes are the file's own 8-bit codes or ADPCM blocks), and ``decode``
reads the file back, expands it to 16-bit PCM and resamples that. mu-law and A-law expand by
lookup tables; ADPCM decodes one nibble of all blocks of a batch per numpy step.

Defined cases: a null or empty text is one block of padding; the codec follows the payload's
CRC-32, so equal texts are stored alike; very long texts are one long file (a WAV file ends at
4 GB); repeated rows give repeated rows; an empty table an empty result. A file that is not
such a WAV file raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty

BLOCK = 576
RATE = 8000
#: WAV format tags.
MU_LAW, A_LAW, IMA_ADPCM = 7, 6, 17
NAMES = {MU_LAW: "mulaw", A_LAW: "alaw", IMA_ADPCM: "ima_adpcm"}

# Fixed values of IMA ADPCM: the step sizes and the changes of the step index.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
     107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
     876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
     5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
     27086, 29794, 32767]
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * step index + nibble: the change of the sample and the next index."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    change = np.where(nibble & 8, -size, size)
    following = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[nibble & 7], 0, len(STEPS) - 1)
    return change.ravel().astype(np.int32), following.ravel().astype(np.int32)


EXPAND = {MU_LAW: _mu_law_table(), A_LAW: _a_law_table()}
CHANGE, FOLLOWING = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """uint8 [n, block bytes] to int16 [n, samples]: header, then low and high nibbles."""
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    data = blocks[:, 4:].T
    out = np.empty((2 * len(data) + 1, len(blocks)), np.int16)
    out[0] = sample
    for k, row in enumerate(data):
        for half, nibble in enumerate((row & 15, row >> 4)):
            at = index * 16 + nibble
            sample = np.clip(sample + CHANGE[at], -32768, 32767)
            index = FOLLOWING[at]
            out[2 * k + 1 + half] = sample
    return out.T


def write_wav(payload: bytes, codec: int) -> bytes:
    """A mono 8 kHz WAV file whose data chunk is ``payload``."""
    if codec == IMA_ADPCM:
        samples = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * BLOCK // samples, BLOCK, 4, 2, samples)
        n = len(payload) // BLOCK * samples
    else:
        form, n = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0), len(payload)
    chunks = b"".join(
        name + struct.pack("<I", len(x)) + x for name, x in ((b"fmt ", form), (b"fact", struct.pack("<I", n)), (b"data", payload))
    )
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Codec and data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            (codec,) = struct.unpack_from("<H", media, at + 8)
        elif name == b"data":
            if codec not in NAMES:
                raise ValueError("not a telephony format")
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _half_sample_taps(n: int = 8) -> np.ndarray:
    """Windowed sinc at the points halfway between samples."""
    at = np.arange(n) - (n - 1) / 2
    taps = np.sinc(at) * np.hanning(n + 2)[1:-1]
    return taps / taps.sum()


TAPS = _half_sample_taps()


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: samples stay, a short filter makes those between them."""
    x = pcm.astype(np.float64)
    half = len(TAPS) // 2
    between = np.convolve(np.pad(x, (half - 1, half), mode="edge"), TAPS, mode="valid")
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(np.rint(between), -32768, 32767)
    return out


def payloads(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes and the payload: the text's bytes, padded with 255 to whole blocks."""
    data = text_or_empty().cast("binary")
    n = F.octet_length(data).cast("long")
    full = (F.greatest(F.ceil(n / block), F.lit(1)) * block).cast("int")
    return docs.select("doc_id", n.alias("n_bytes"), F.rpad(data, full, F.lit(b"\xff")).alias("payload"))


def store(df: DataFrame) -> DataFrame:
    """Replace ``payload`` by ``media``, a WAV file; the other columns stay."""
    arrow_rows(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in ("payload", "media")]

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codecs = (MU_LAW, A_LAW, IMA_ADPCM)
        for b in batches:
            media = [write_wav(p, codecs[zlib.crc32(p) % 3]) for p in b["payload"]]
            yield b[[f.name for f in keep]].assign(media=media)

    return df.mapInPandas(files, _schema(keep, "media binary"))


def _schema(keep: list, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), more])


def decode(df: DataFrame) -> DataFrame:
    """Add payload (as read back), pcm (16-bit, 16 kHz) and feature to the rows with ``media``."""
    arrow_rows(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in ("payload", "pcm", "feature")]

    def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            files = [read_wav(m) for m in b["media"]]
            blocks = [np.frombuffer(p, np.uint8).reshape(-1, BLOCK) for c, p in files if c == IMA_ADPCM]
            # All blocks of the batch step together; each file then gets its own again.
            done = iter(np.split(decode_adpcm(np.concatenate(blocks)), np.cumsum([len(x) for x in blocks])[:-1])) if blocks else None
            pcm, features = [], []
            for codec, payload in files:
                x = next(done).ravel() if codec == IMA_ADPCM else EXPAND[codec][np.frombuffer(payload, np.uint8)]
                y = double_rate(x)
                wide = x.astype(np.int64)
                energy, crossings = int((wide * wide).sum()), int((np.diff(np.signbit(x)) != 0).sum())
                features.append(
                    f"codec={NAMES[codec]};samples={len(x)};peak={int(np.abs(wide).max())};"
                    f"mean_square={energy // len(x)};crossings={crossings};pcm_crc32={zlib.crc32(y.tobytes())}"
                )
                pcm.append(y.tobytes())
            yield b[[f.name for f in keep]].assign(payload=[p for _, p in files], pcm=pcm, feature=features)

    return df.mapInPandas(read_back, _schema(keep, "payload binary, pcm binary, feature string"))
