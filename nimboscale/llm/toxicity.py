"""Toxic spans by a linear-chain conditional random field with two tags.

Labels are given by document, so tokens are labelled first: in a bounded sample
of labelled documents, a token feature (word, prefix, suffix) that toxic
documents hold far more often than chance marks its tokens as toxic there. The
chain's weights are then fitted by gradient steps on windows around such tokens
and windows of clean documents. Scoring runs forward and backward over whole
documents: marginals give the score of a document, through a logistic
curve fitted on the sample's documents, and the spans of offending tokens.

The model that tasks get is a table of fixed size, broadcast once. Documents of
a batch are decoded side by side, the loop runs over token positions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TABLE = 1 << 20
#: Bounds of the training sample: documents of each class, and bytes of a text that may train. Scoring has no bounds.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2000, 4000, 1 << 16
WINDOW = 20
MAX_WINDOWS = 12_000
PAD = 2_000_000
CACHE = 300_000
EDGES = b".,;:!?\"'()[]{}<>|*&$%#-_/\\"
SPAN = re.compile(rb"[^\x20\x09-\x0d]+")


def token_features(token: bytes) -> tuple[int, ...]:
    """Slots in the weight table of a lower-cased token without the signs at its ends."""
    t = token.strip(EDGES)
    parts = [b"w" + t, b"p4" + t[:4] if len(t) > 4 else b"p4=" + t, b"p5" + t[:5] if len(t) > 5 else b"p5=" + t, b"s3" + t[-3:], b"n%d" % min(len(t), 12)]
    return tuple(zlib.crc32(p) % TABLE for p in parts)


N_FEATURES = 5


def tokens_of(text: str | None) -> list[bytes]:
    """ASCII-space-separated tokens, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


@dataclass
class Chain:
    """Weights of tag 1 against tag 0 by feature slot, bias, and factors (from, to) between tags."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray  # 2 x 2, log factors
    curve: tuple[float, float, float]  # of the document score: constant, log toxic tokens, log most likely token


class Emissions(dict):
    """Log-odds of tag 1 by token, computed at first sight; holds CACHE tokens at most."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain

    def __missing__(self, token: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        w = self.chain.weights
        value = self[token] = self.chain.bias + sum(float(w[f]) for f in token_features(token))
        return value


def marginals(docs: list[np.ndarray], steps: np.ndarray) -> list[np.ndarray]:
    """Probability of tag 1 of every token of each document (arrays of emission log-odds), exact forward-backward."""
    out: list[np.ndarray] = [np.zeros(0)] * len(docs)
    order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: -len(docs[i]))
    at = 0
    m = np.exp(steps)
    while at < len(order):
        longest = len(docs[order[at]])
        group = order[at : at + max(1, PAD // longest)]
        at += len(group)
        size = np.array([len(docs[i]) for i in group])
        phi = np.ones((longest, len(group)))
        for k, i in enumerate(group):
            phi[: size[k], k] = np.exp(np.clip(docs[i], -40, 40))
        # Lengths fall, so the documents that reach position t are the first alive[t].
        alive = np.searchsorted(-size, -np.arange(longest), side="left")
        ahead = np.empty_like(phi)
        ahead[0] = phi[0]
        for t in range(1, longest):
            k = alive[t]
            r = ahead[t - 1, :k]
            ahead[t, :k] = phi[t, :k] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
        back = np.ones(len(group))
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            odds = ahead[t, :k] * back[:k]
            r = phi[t, :k] * back[:k]
            ahead[t, :k] = odds / (1 + odds)
            back[:k] = (m[1, 0] + r * m[1, 1]) / (m[0, 0] + r * m[0, 1])
        for k, i in enumerate(group):
            out[i] = ahead[: size[k], k].copy()
    return out


def _sums(p: np.ndarray) -> tuple[float, float]:
    """(log of the expected number of toxic tokens, log of the largest marginal); low where there are none."""
    if not len(p):
        return math.log(1e-4), math.log(1e-4)
    return math.log(float(p.sum()) + 1e-4), math.log(float(p.max()) + 1e-4)


def document_score(chain: Chain, p: np.ndarray) -> float:
    a, b = _sums(p)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, chain.curve[0] + chain.curve[1] * a + chain.curve[2] * b))))


# ---- training, on the driver, over a bounded sample --------------------------


def seed_features(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Mask of feature slots that toxic documents hold beyond chance.

    The log-likelihood ratio of document counts must exceed what the best of all
    tested features reaches by chance, and nine in ten holders must be toxic.
    """
    hit, all_ = np.zeros(TABLE), np.zeros(TABLE)
    for slots, label in zip(docs, toxic):
        present = np.unique(slots)
        all_[present] += 1
        if label:
            hit[present] += 1
    n, ones = len(docs), float(toxic.sum())
    if not 0 < ones < n:
        return np.zeros(TABLE, bool)
    base = ones / n
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = hit / all_
        gain = 2 * (hit * np.log(rate / base) + np.where(all_ > hit, (all_ - hit) * np.log((1 - rate) / (1 - base)), 0))
    tested = (all_ >= 4).sum() + 1
    return (hit >= 4) & (rate >= 0.9) & (np.nan_to_num(gain) > 2 * math.log(tested) + 4)


def fit_chain(texts: list[str], toxic: list[int], seed: int = 3, rounds: int = 6) -> Chain:
    """Fit on sampled documents. With one class only, scores are that class's smoothed share."""
    labels = np.array(toxic, bool)
    kinds: dict[bytes, int] = {}
    docs = [np.array([kinds.setdefault(t, len(kinds)) for t in tokens_of(x)], np.int32) for x in texts]
    slots = np.array([token_features(t) for t in kinds], np.int32).reshape(len(kinds), N_FEATURES)
    del kinds
    chain = Chain(np.zeros(TABLE, np.float32), -4.0, np.zeros((2, 2)), (0.0, 0.0, 0.0))
    seeds = seed_features([slots[np.unique(d)].ravel() for d in docs], labels)
    # Length classes and suffixes are shared by too many words to mark a token on their own.
    bad = seeds[slots[:, :3]].any(axis=1) if len(slots) else np.zeros(0, bool)
    rng = np.random.default_rng(seed)
    windows = _windows(docs, labels, bad, rng)
    if windows:
        _descend(chain, windows, slots, rounds, rng)
    found = marginals([chain.bias + chain.weights[slots[d]].sum(axis=1, dtype=np.float64) if len(d) else np.zeros(0) for d in docs], chain.steps)
    chain.curve = _fit_curve(np.array([_sums(p) for p in found]).reshape(-1, 2), labels)
    return chain


def _windows(docs, labels, bad, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """(token kinds, tags) around marked tokens of toxic documents, and as many from elsewhere."""
    near, far = [], []
    for d, label in zip(docs, labels):
        if not len(d):
            continue
        tags = bad[d] & label
        last = -WINDOW
        for at in np.flatnonzero(tags):
            if at >= last + WINDOW:
                a = max(0, at - int(rng.integers(WINDOW)))
                near.append((d[a : a + 2 * WINDOW], tags[a : a + 2 * WINDOW]))
                last = at
        a = int(rng.integers(len(d)))
        for _ in range(3):
            far.append((d[a : a + 2 * WINDOW], tags[a : a + 2 * WINDOW]))
            a = int(rng.integers(len(d)))
    if not near:
        return []
    keep = [x[i] for x in (near, far) for i in rng.permutation(len(x))[: MAX_WINDOWS // 2]]
    return [keep[i] for i in rng.permutation(len(keep))]


def _descend(chain: Chain, windows, slots, rounds: int, rng) -> None:
    """Adaptive gradient ascent of the chain's conditional likelihood, with a small pull to zero."""
    grown, grown_bias, grown_steps = np.full(TABLE, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    for _ in range(rounds):
        for at in range(0, len(windows), 256):
            part = windows[at : at + 256]
            longest = max(len(w) for w, _ in part)
            kind, tag, real = (np.zeros((longest, len(part)), t) for t in (np.int32, bool, bool))
            for k, (w, y) in enumerate(part):
                kind[: len(w), k], tag[: len(w), k], real[: len(w), k] = w, y, True
            emit = np.where(real, chain.bias + chain.weights[slots[kind]].sum(axis=2, dtype=np.float64), 0.0)
            single, pair = _expect(emit, real, chain.steps)
            miss = np.where(real, tag - single, 0.0)
            slope = np.bincount(slots[kind].ravel(), np.repeat(miss.ravel(), N_FEATURES), TABLE) - 1e-3 * chain.weights
            both = real[1:] & real[:-1]
            seen = np.array([[(both & (tag[:-1] == a) & (tag[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
            grown += slope**2
            chain.weights += (0.3 * slope / np.sqrt(grown)).astype(np.float32)
            grown_bias += miss.sum() ** 2
            chain.bias += 0.3 * miss.sum() / math.sqrt(grown_bias)
            turn = seen - pair - 1e-2 * chain.steps
            grown_steps += turn**2
            chain.steps = np.clip(chain.steps + 0.1 * turn / np.sqrt(grown_steps), -3, 3)


def _expect(emit: np.ndarray, real: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 (T, n), and the expected number of each pair of tags."""
    t_max, n = emit.shape
    phi = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
    m = np.exp(steps)
    ahead, back = np.zeros((t_max, n, 2)), np.zeros((t_max, n, 2))
    ahead[0] = phi[0] / phi[0].sum(1, keepdims=True)
    for t in range(1, t_max):
        a = (ahead[t - 1] @ m) * phi[t]
        ahead[t] = np.where(real[t][:, None], a / a.sum(1, keepdims=True), ahead[t - 1])
    back[-1] = 0.5
    pair = np.zeros((2, 2))
    for t in range(t_max - 2, -1, -1):
        r = phi[t + 1] * back[t + 1]
        b = r @ m.T
        go = real[t + 1]
        back[t] = np.where(go[:, None], b / b.sum(1, keepdims=True), back[t + 1])
        joint = ahead[t][:, :, None] * m[None] * r[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pair += joint[go].sum(0)
    both = ahead * back
    return both[:, :, 1] / both.sum(2), pair


def _fit_curve(x: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by damped Newton steps; slopes are held from falling below zero."""
    n, ones = len(labels), int(labels.sum())
    share = (ones + 0.5) / (n + 1)
    if not 0 < ones < n or np.ptp(x, axis=0).max() < 1e-9:
        return (math.log(share / (1 - share)), 0.0, 0.0)
    a = np.column_stack([np.ones(n), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, a.T @ (labels - p) - ridge @ w)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), float(w[1]), float(w[2]))


# ---- Spark -------------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """At most about MAX_TOXIC and MAX_CLEAN labelled texts of MAX_BYTES at most that are not held out, by the order of a hash of the id.

    Of an id's several texts the least trains, once.
    """
    own = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label_col).alias("_y"))
    counts = {r[0]: r[1] for r in own.groupBy("_y").agg(F.count(F.lit(1))).collect()}
    share = {1: MAX_TOXIC / max(1, counts.get(1, 0)), 0: MAX_CLEAN / max(1, counts.get(0, 0))}
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("_labelled")), F.lit(1 << 30))
    most = F.when(F.col("_y") == 1, int(min(1.0, share[1]) * (1 << 30))).otherwise(int(min(1.0, share[0]) * (1 << 30)))
    # The sample's ids are bounded as above, so the texts need not move to meet them.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(own.where(draw < most)), F.col("_id") == F.col("_labelled"))
    rows = rows.where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= MAX_BYTES)
    got = sorted(rows.groupBy("_id").agg(F.min("_text"), F.max("_y")).collect(), key=lambda r: r[0])
    return [r[1] or "" for r in got], [int(r[2]) for r in got]


SCORED = "score double, toxic_tokens double, spans array<struct<start:int,end:int,p:double>>"


def score_texts(docs: DataFrame, chain: Chain, id_col: str, text_col: str, span_at: float = 0.5, with_spans: bool = True) -> DataFrame:
    """(id, score, toxic_tokens, spans): expected toxic tokens, and byte offsets in UTF-8 of runs of tokens at ``span_at`` or more.

    Edge cases: null, empty and blank texts have the score of no tokens and no
    spans. Rows are scored one by one, also repeated ones and those with null
    ids. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def spans(text: str, p: np.ndarray) -> list[dict]:
        if not (p >= span_at).any():
            return []
        out: list[dict] = []
        last = -2
        for k, m in enumerate(SPAN.finditer(text.encode("utf-8", "replace"))):
            if p[k] >= span_at:
                if last == k - 1:
                    out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[k]))
                else:
                    out.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
                last = k
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Chain = shared.value
        emissions = Emissions(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t.as_py() or "" for t in batch.column(1)]
                emits = []
                for t in texts:
                    tokens = tokens_of(t)
                    emits.append(np.fromiter(map(emissions.__getitem__, tokens), np.float64, len(tokens)))
                found = marginals(emits, model.steps)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([document_score(model, p) for p in found], pa.float64()),
                        pa.array([float(p.sum()) for p in found], pa.float64()),
                        pa.array([spans(t, p) for t, p in zip(texts, found)] if with_spans else [[] for _ in texts], span_type),
                    ],
                    ["_id", "score", "toxic_tokens", "spans"],
                )

    return rows.mapInArrow(run, f"_id {kind}, {SCORED}").withColumnRenamed("_id", id_col)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7
) -> DataFrame:
    """(id, held_out, score, predicted, toxic_tokens, spans) of every row.

    Labels of held-out ids (crc32 of the id as text, mod 3, is 1) are not read.

    Edge cases: null, empty and blank texts have no tokens and the score of
    none. A null id is not held out and has no label; null labels are skipped;
    of repeated labels the largest counts. Equal texts score alike. Without
    toxic labels every score is the small smoothed share.
    """
    texts, toxic = training_sample(docs, labels, id_col, text_col, label_col)
    chain = fit_chain(texts, toxic)
    out = score_texts(docs, chain, id_col, text_col)
    return out.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "toxic_tokens", "spans"
    )


def op8_toxic_spans(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score_toxicity(docs, labels)
