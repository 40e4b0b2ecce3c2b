"""Telephony audio: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

mu-law and A-law expand through 256-entry tables. An ADPCM block depends on
nothing outside it, so all blocks of a batch of recordings are decoded side by
side: the loop runs over the samples of one block, numpy over the blocks.
Resampling is linear interpolation between neighbouring samples, with no state
across recordings. Media columns are WAV files in a binary column; tasks hold
one Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from nimboscale.llm.text import without
from nimboscale.session import stored

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17  # WAV format tags
TAGS = {"mulaw": MULAW, "alaw": ALAW, "ima_adpcm": IMA, "pcm": PCM}
RATE = 8000
BLOCK = 64
#: Rows of long texts in one Arrow batch are cut to about this many bytes of media at a time.
PIECE = 4 << 20


def mulaw_table() -> np.ndarray:
    """G.711 mu-law byte to sample: bits are inverted; 3 exponent and 4 mantissa bits over a bias of 132."""
    u = ~np.arange(256, dtype=np.uint8)
    size = ((u & 15).astype(np.int32) * 8 + 132 << (u >> 4 & 7).astype(np.int32)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law byte to sample: even bits are inverted; the lowest segment is linear."""
    a = np.arange(256, dtype=np.uint8) ^ np.uint8(0x55)
    low, exponent = (a & 15).astype(np.int32) * 16 + 8, (a >> 4 & 7).astype(np.int32)
    size = np.where(exponent == 0, low, low + 256 << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 quantiser steps of IMA ADPCM. They must equal the standard's."""
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
            130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
            1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
            7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
        ],
        np.int32,
    )


MU, A, STEPS = mulaw_table(), alaw_table(), ima_steps()
#: Change of the step's index by the three low bits of a code. Fixed values.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: By index * 16 + code: the change of the sample, and the next index.
_CODES = np.arange(16)
_DELTA = (
    (STEPS[:, None] >> 3)
    + np.where(_CODES & 4, STEPS[:, None], 0)
    + np.where(_CODES & 2, STEPS[:, None] >> 1, 0)
    + np.where(_CODES & 1, STEPS[:, None] >> 2, 0)
) * np.where(_CODES & 8, -1, 1)
DELTA = _DELTA.astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89)[:, None] + MOVES[_CODES & 7], 0, 88) * 16).astype(np.int32).ravel()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, block) bytes to (n, 2 * (block - 4) + 1) samples, all blocks at once.

    A block starts with its first sample (int16) and step index (over 88 counts
    as 88); then come codes, low half of a byte first.
    """
    n, width = blocks.shape
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    sample = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = sample
    at = 1
    for pair in codes:
        for code in (pair & 15, pair >> 4):
            row = index + code
            sample += DELTA[row]
            np.minimum(sample, 32767, out=sample)
            np.maximum(sample, -32768, out=sample)
            index = NEXT[row]
            out[at] = sample
            at += 1
    return out.T


def encode_ima(pcm: np.ndarray, block: int = BLOCK) -> bytes:
    """IMA ADPCM of int16 samples; the last block is filled with its last sample."""
    per = 2 * (block - 4) + 1
    n = -(-len(pcm) // per)
    if not n:
        return b""
    rows = np.concatenate([pcm, np.repeat(pcm[-1:], n * per - len(pcm))]).reshape(n, per).astype(np.int32)
    # Each block starts with the step that fits its first difference.
    sample, index = rows[:, 0].copy(), np.minimum(np.searchsorted(STEPS, np.abs(rows[:, 1] - rows[:, 0])), 88)
    out = np.zeros((n, block), np.uint8)
    out[:, 2] = index
    out[:, :2] = sample.astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(1, per):
        step, gap = STEPS[index], rows[:, k] - sample
        code, left = np.where(gap < 0, 8, 0), np.abs(gap)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= part
            code, left = code + np.where(take, bit, 0), left - np.where(take, part, 0)
        sample = np.clip(sample + DELTA[index * 16 + code], -32768, 32767)
        index = NEXT[index * 16 + code] // 16
        out[:, 4 + (k - 1) // 2] |= (code << 4 * ((k - 1) % 2)).astype(np.uint8)
    return out.tobytes()


def encode_g711(pcm: np.ndarray, codec: str) -> bytes:
    """Nearest byte of the codec's table for each sample."""
    table = MU if codec == "mulaw" else A
    order = np.argsort(table, kind="stable")
    levels = table[order].astype(np.int32)
    at = np.clip(np.searchsorted(levels, pcm), 1, 255)
    at -= np.abs(pcm - levels[at - 1]) <= np.abs(levels[at] - pcm)
    return order[at].astype(np.uint8).tobytes()


def wav(data: bytes, tag: int, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file around ``data``; odd lengths get the format's pad byte."""
    bits = {PCM: 16, IMA: 4}.get(tag, 8)
    align = {PCM: 2, IMA: block}.get(tag, 1)
    per = 2 * (block - 4) + 1
    extra = struct.pack("<HH", 2, per) if tag == IMA else b"" if tag == PCM else struct.pack("<H", 0)
    speed = rate * align // per if tag == IMA else rate * align
    head = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    count = len(data) // block * per if tag == IMA else len(data) // align
    fact = b"" if tag == PCM else struct.pack("<4sII", b"fact", 4, count)
    body = struct.pack("<4sI", b"fmt ", len(head)) + head + fact + struct.pack("<4sI", b"data", len(data))
    pad = len(data) % 2
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body) + len(data) + pad, b"WAVE") + body + data + bytes(pad)


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview] | None:
    """(tag, rate, block, data) of a mono WAV file; None if it is none."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        return None
    at, head = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt " and size >= 16:
            head = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data" and head:
            return (head[0], head[2], head[4], view[at + 8 : at + 8 + size]) if head[1] == 1 and head[2] > 0 else None
        at += 8 + size + size % 2
    return None


def expand(tag: int, block: int, data) -> np.ndarray | None:
    """int16 samples of stored bytes; None for an unknown format. A broken last ADPCM block is left out."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MU[raw]
    if tag == ALAW:
        return A[raw]
    if tag == PCM:
        return np.frombuffer(data, "<i2", len(data) // 2)
    if tag == IMA and block > 4:
        return decode_ima(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    return None


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation; ceil(n * to / rate) samples, the last one held."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16, copy=False)
    n = -(-len(pcm) * to // rate)
    # Exact positions in integers: n * rate fits far beyond any recording.
    where = np.arange(n, dtype=np.int64) * rate
    left = where // to
    part = ((where - left * to) / to).astype(np.float32)
    a = pcm[left].astype(np.float32)
    b = pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.float32)
    return np.rint(a + (b - a) * part).astype(np.int16)


def decode_media(media: DataFrame, media_col: str = "media", rate: int = 16000) -> DataFrame:
    """Add ``pcm_rate``, ``n_samples`` and ``pcm`` (16-bit little-endian) to rows of WAV files.

    Edge cases: null, foreign and multi-channel media give nulls. Empty data
    gives empty PCM. Input columns named like an output are replaced.
    """
    kept = without(media, "pcm_rate", "n_samples", "pcm")
    # A copy: StructType.add changes the schema that the DataFrame keeps.
    schema = StructType(list(kept.schema.fields)).add("pcm_rate", "integer").add("n_samples", "long").add("pcm", "binary")
    place = kept.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                made = []
                for value in batch.column(place):
                    found = parse_wav(value.as_py()) if value.is_valid else None
                    pcm = expand(found[0], found[2], found[3]) if found else None
                    made.append(None if pcm is None else resample(pcm, found[1], rate).astype("<i2"))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array([None if p is None else rate for p in made], pa.int32()),
                        pa.array([None if p is None else len(p) for p in made], pa.int64()),
                        pa.array([None if p is None else p.tobytes() for p in made], pa.binary()),
                    ],
                    schema.names,
                )

    return kept.mapInArrow(run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str = "mulaw") -> DataFrame:
    """Store every whole text as a WAV file, a byte a sample; returns the stored table (id, n_bytes, media).

    The payload is the text in UTF-8 with zero bytes up to a positive multiple
    of 64; null is empty. ``ima_adpcm`` files take it as blocks of 64 bytes.
    """
    tag, block = TAGS[codec], BLOCK if codec == "ima_adpcm" else 1
    rows = docs.select(F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("_bytes"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, media = [], []
                for value in batch.column(1):
                    data = value.as_py()
                    sizes.append(len(data))
                    media.append(wav(data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0"), tag, RATE, block))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["_id", "n_bytes", "media"]
                )

    made = rows.mapInArrow(run, f"_id {kind}, n_bytes long, media binary").withColumnRenamed("_id", id_col)
    return stored(made, "media")


def _level(pcm: np.ndarray) -> float:
    return float(np.sqrt(np.square(pcm, dtype=np.float32).mean(dtype=np.float64))) if len(pcm) else 0.0


def media_features(media: DataFrame, id_col: str, rate: int = 16000) -> DataFrame:
    """Digests and features of a stored table (id, n_bytes, media), from the bytes read back.

    ``feature`` names, for the samples expanded by the file's own table and
    resampled, their number, level, share of sign changes and CRC-32; then the
    levels under the other table and under ADPCM blocks of 64 bytes. All ADPCM
    blocks of some megabytes of recordings are decoded together.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = [v.as_py() for v in batch.column(2)]
        parsed = [parse_wav(m) for m in files]
        raw = [np.frombuffer(p[3], np.uint8) for p in parsed]
        blocks = np.concatenate(raw).reshape(-1, BLOCK)
        squares = np.square(decode_ima(blocks), dtype=np.float32).mean(axis=1, dtype=np.float64)
        ends = np.cumsum([len(r) // BLOCK for r in raw])
        rows = []
        for m, (tag, own, block, data), r, end in zip(files, parsed, raw, ends):
            pcm = resample(expand(tag, block, data), own, rate)
            signs = np.count_nonzero(np.diff(np.signbit(pcm)))
            other = A[r] if tag == MULAW else MU[r]
            adpcm = float(np.sqrt(squares[end - len(r) // BLOCK : end].mean()))
            feature = (
                f"n={len(pcm)};rms={_level(pcm):.3f};zcr={signs / max(1, len(pcm) - 1):.6f};crc={zlib.crc32(pcm):08x};"
                f"other_rms={_level(other):.3f};adpcm_rms={adpcm:.3f}"
            )
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [id_col, "n_bytes", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(batch.column(1).to_numpy()) // PIECE if batch.num_rows else np.array([])
            starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if b > a:
                    yield describe(batch.slice(a, b - a))

    declared = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types))
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"{id_col} {kind}, n_bytes long, {declared}")


def op4_telephony_media(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_features(store_texts(docs), "doc_id")
