"""Telephony codecs against scalar decoders and round trips."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from nimboscale.llm import telephony as t


def test_tables_known_points():
    assert t.MU[0xFF] == 0 and t.MU[0x7F] == 0 and t.MU[0x80] == 32124 and t.MU[0x00] == -32124
    assert t.A[0xD5] == 8 and t.A[0x55] == -8 and t.A[0xAA] == 32256 and t.A[0x2A] == -32256
    assert len(set(t.A.tolist())) == 256 and len(set(t.MU.tolist())) == 255
    for codec, table in (("mulaw", t.MU), ("alaw", t.A)):
        assert (table[np.frombuffer(t.encode_g711(table, codec), np.uint8)] == table).all()


def scalar_ima(block: bytes):
    sample, index = int(np.frombuffer(block[:2], "<i2")[0]), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - delta if code & 8 else sample + delta))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(sample)
    return out


def test_adpcm_blocks_equal_scalar_decoder():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    assert t.decode_ima(blocks).tolist() == [scalar_ima(b.tobytes()) for b in blocks]
    tone = (8000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    back = t.decode_ima(np.frombuffer(t.encode_ima(tone), np.uint8).reshape(-1, 64)).ravel()[: len(tone)]
    assert np.sqrt(np.mean((back[200:] - tone[200:].astype(float)) ** 2)) < 600


def test_resample():
    ramp = np.arange(0, 800, 8, dtype=np.int16)
    up = t.resample(ramp, 8000, 16000)
    assert len(up) == 200 and up[:5].tolist() == [0, 4, 8, 12, 16] and up[-1] == ramp[-1]
    assert t.resample(up, 16000, 8000).tolist() == ramp.tolist()
    assert len(t.resample(ramp[:0], 8000, 16000)) == 0


def test_decode_media_column(spark):
    tone = (5000 * np.sin(np.arange(800) / 5)).astype(np.int16)
    files = [t.wav(t.encode_g711(tone, "mulaw"), t.MULAW), t.wav(t.encode_g711(tone, "alaw"), t.ALAW), t.wav(t.encode_ima(tone), t.IMA, block=64),
             t.wav(tone.tobytes(), t.PCM), None, b"", b"RIFFxxxxWAVEjunk", t.wav(b"", t.MULAW), t.wav(b"abc", t.MULAW)]
    df = spark.createDataFrame([(i, f, "old") for i, f in enumerate(files)], "id int, media binary, pcm string")
    got = {r.id: r for r in t.decode_media(df).collect()}
    for i in range(4):
        pcm = np.frombuffer(got[i].pcm, "<i2")[::2][:800]
        assert got[i].n_samples >= 1600 and np.abs(pcm[100:].astype(int) - tone[100:]).max() < 900
    assert got[4].pcm is None and got[5].pcm is None and got[6].pcm is None and got[7].pcm == b"" and got[8].n_samples == 6
    assert t.decode_media(df.limit(0)).count() == 0


def test_texts_round_trip(spark):
    texts = [None, "", "abc", "é" * 32, "x" * 64, "long " * 200000, "abc"]
    df = spark.createDataFrame([(i if i else None, x, 5, "z") for i, x in enumerate(texts)], "doc_id long, text string, n_bytes int, media string")
    for codec in ("mulaw", "alaw", "ima_adpcm"):
        got = {r.doc_id: r for r in t.media_features(t.store_texts(df, codec=codec), "doc_id").collect()}
        assert len(got) == len(texts)
        for i, x in enumerate(texts):
            data = (x or "").encode()
            padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            r = got[i if i else None]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
            assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes > len(padded)
        assert got[2].feature == got[6].feature and got[2].media_sha256 == got[6].media_sha256
    assert t.media_features(t.store_texts(df.limit(0)), "doc_id").count() == 0
    assert t.decode_media(t.store_texts(df)).where(F.col("pcm").isNull()).count() == 0
