"""Telephony audio columns: mu-law and A-law by lookup table, IMA ADPCM in blocks, resampled PCM.

Samples are 8-bit companded audio at 8 kHz. Both laws expand through tables of
256 values that follow from their rule. ADPCM blocks (a header of predictor and
step index, then two 4-bit codes a byte) are decoded with numpy across blocks:
each step of the loop advances every block by one code. PCM is resampled to
16 kHz by linear interpolation and can be stored as 16-bit WAV.

Edge cases: null and empty media decode to no samples, an incomplete last ADPCM
block is dropped (blocks are whole by format), step indices out of range are
clamped, texts without bytes are padded to one frame of 192 bytes by the query;
equal inputs give equal outputs; repeated rows each have a row. Columns other
than doc_id and the media column are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafwork.llm.common import long_rows, written

RATE = 8_000
BLOCK = 192
MU_LAW, A_LAW, PCM = 7, 6, 1

#: Step sizes and index changes of IMA ADPCM (fixed values of the format).
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
        494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
        11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mu_table() -> np.ndarray:
    u = ~np.arange(256) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _a_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(segment == 0, low + 8, (low + 264) << np.maximum(segment - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = _mu_table(), _a_table()
#: For each step index and code: the signed change, and the next step index.
_CODES = np.arange(16)
_CHANGE = ((STEPS[:, None] >> 3) + (STEPS[:, None] >> 2) * (_CODES & 1) + (STEPS[:, None] >> 1) * (_CODES >> 1 & 1) + STEPS[:, None] * (_CODES >> 2 & 1)) * np.where(_CODES & 8, -1, 1)
_NEXT = np.clip(np.arange(len(STEPS))[:, None] + INDEX, 0, len(STEPS) - 1)
_CHANGE, _NEXT = _CHANGE.astype(np.int32).ravel(), (_NEXT * 16).astype(np.int32).ravel()


def adpcm(raw: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples (blocks, 1 + 2 * (block - 4)) of whole mono IMA ADPCM blocks."""
    blocks = raw[: len(raw) // block * block].reshape(-1, block)
    n = len(blocks)
    out = np.empty((1 + 2 * (block - 4), n), np.int16)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(block - 4):
        for j, code in ((0, codes[i] & 15), (1, codes[i] >> 4)):
            at = state + code
            value += _CHANGE[at]
            np.clip(value, -32768, 32767, out=value)
            state = _NEXT[at]
            out[1 + 2 * i + j] = value
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate, by the mean of neighbours."""
    if not len(pcm):
        return pcm
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[1:] + wide[:-1]) >> 1
    out[-1] = pcm[-1]
    return out


def wav(payload: bytes, kind: int = MU_LAW, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit companded samples, or of 16-bit PCM."""
    width = 2 if kind == PCM else 1
    head = struct.pack("<HHIIHHH", kind, 1, rate, rate * width, width, 8 * width, 0)
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, len(payload) // width) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """(kind, rate, payload) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(media: bytes | None) -> np.ndarray:
    """PCM samples of a WAV file in either law or in PCM; none for null or empty media."""
    if not media:
        return np.zeros(0, np.int16)
    kind, _, payload = unwav(media)
    raw = np.frombuffer(payload, np.uint8)
    return MU_TABLE[raw] if kind == MU_LAW else A_TABLE[raw] if kind == A_LAW else np.frombuffer(payload, "<i2")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def features(raw: np.ndarray, coded: np.ndarray) -> str:
    """Level and zero crossings of the resampled mu-law samples, level of the A-law samples, level and checksum of the ADPCM samples."""
    mu = resample(MU_TABLE[raw])
    sign = mu < 0
    a = A_TABLE[raw]
    mean = lambda x: int(np.abs(x.astype(np.int32)).sum(dtype=np.int64)) // max(1, x.size)
    return f"mu={mean(mu)};zc={int((sign[1:] != sign[:-1]).sum())};a={mean(a)};adpcm={mean(coded)};crc={zlib.crc32(np.ascontiguousarray(coded)):08x}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            size, media = [], []
            for t in part.column(1):
                n, payload = payload_of(t.as_py())
                size.append(n)
                media.append(wav(payload))
            yield pa.record_batch([part.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            media = part.column(2).to_pylist()
            payloads = [unwav(m)[2] for m in media]
            blocks = np.cumsum([0] + [len(p) // BLOCK for p in payloads])
            coded = adpcm(np.frombuffer(b"".join(payloads), np.uint8))
            rows = {
                "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                "media_bytes": pa.array([len(m) for m in media], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                "feature": pa.array([features(np.frombuffer(p, np.uint8), coded[blocks[i] : blocks[i + 1]]) for i, p in enumerate(payloads)], pa.string()),
            }
            yield pa.record_batch([part.column(0), part.column(1), *rows.values()], names=["doc_id", "n_bytes", *rows])


def media_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a mu-law WAV file, written to the shared folder."""
    long_rows(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary"))


def described(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, from the bytes read back."""
    long_rows(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_of(media: DataFrame) -> DataFrame:
    """doc_id, pcm: the media resampled to 16 kHz as 16-bit PCM WAV files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [wav(resample(expand(m)).astype("<i2").tobytes(), PCM, 2 * RATE) for m in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary")
