"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (byte-class bigram shares and word statistics, then a
learned tanh layer); gated attention weights, learned from document labels alone, mix the passage codes into one
document code, which a logistic unit scores.

Defined results: null or empty text is one empty passage and gets the model's score for it; a null id is scored too
(held_out false); repeated rows are scored one by one; an empty table gives an empty result; without usable labels the
score is 1.0 (nothing is rejected). Ties cannot occur: rows do not compete.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import words
from folio.llm.arrow import TextBlock, map_blocks

#: Byte classes of the encoder.
_GROUPS = (b" ", b"\n\t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"#$%&*@^~=+_", b"|/\\<>{}[]()", b"'\"`-")
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
_CLASS[0xC3] = len(_GROUPS) + 1  # first byte of Latin-1 letters
_N = len(_GROUPS) + 2
_EXTRA = 6
N_FEATURES = _N * _N + _EXTRA


@dataclass(frozen=True)
class QualityConfig:
    """`sample_rows` bounds the labelled rows that the model is fitted on, `sample_passages` the passages of each (evenly spaced ones of longer
    documents); scores cover every row and all of its passages."""

    passage_bytes: int = 600
    sample_rows: int = 6000
    sample_passages: int = 64
    hidden: int = 24
    gate: int = 12
    epochs: int = 240
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 7


def passages(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of `size` bytes (the rest of a row joins its last one), and the first passage of each row."""
    lengths = np.diff(offsets)
    count = np.maximum(1, lengths // size)
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    within = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    pid = np.repeat(first[:-1], lengths) + np.minimum(within // size, np.repeat(count, lengths) - 1)
    code = _CLASS[data].astype(np.int64)
    x = np.zeros((total, N_FEATURES), np.float32)
    if len(data) > 1:
        same = pid[1:] == pid[:-1]
        cell = pid[:-1] * (_N * _N) + code[:-1] * _N + code[1:]
        x[:, : _N * _N] = np.bincount(cell[same], minlength=total * _N * _N).reshape(total, -1)
    x[:, : _N * _N] = np.sqrt(x[:, : _N * _N] / np.maximum(1, x[:, : _N * _N].sum(1, keepdims=True)))
    starts, ends, _ = words.bounds(data, offsets)
    if len(starts):
        h, home = words.hashes(data, starts, ends), pid[starts]
        n = np.bincount(home, minlength=total)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (home[1:] == home[:-1])
        order = np.lexsort((h, home))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (home[order][1:] != home[order][:-1])
        per = lambda w: np.bincount(home, weights=w, minlength=total) / np.maximum(n, 1)
        long = (ends - starts).astype(float)
        mean = per(long)
        x[:, -6] = per(again)
        x[:, -5] = np.bincount(home[order], weights=fresh, minlength=total) / np.maximum(n, 1)
        x[:, -4] = np.log1p(mean)
        x[:, -3] = np.sqrt(np.maximum(0, per(long * long) - mean * mean)) / np.maximum(1, mean)
        x[:, -2] = np.log1p(n) / 5
    x[:, -1] = np.log1p(np.bincount(pid, minlength=total)) / 7
    return x, first


def _softmax(s: np.ndarray, first: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(s - np.maximum.reduceat(s, first[:-1])[bag])
    return e / np.add.reduceat(e, first[:-1])[bag]


@dataclass
class Model:
    """The fitted network; `score` takes passage features and the first passage of each bag."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        alpha = _softmax((a * g) @ p["w"], first, bag)
        code = np.add.reduceat(h * alpha[:, None], first[:-1], axis=0)
        logit = code @ p["c"] + p["d"][0]
        return {"z": z, "h": h, "a": a, "g": g, "alpha": alpha, "code": code, "bag": bag, "y": 1 / (1 + np.exp(-np.clip(logit, -40, 40)))}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"].astype(np.float64)


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, config: QualityConfig) -> Model:
    """Adam over whole bags; gradients of the gated attention are written out."""
    rng = np.random.default_rng(config.seed)
    f, hid, gate = x.shape[1], config.hidden, config.gate
    mean, scale = x.mean(0), x.std(0) + 0.02
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": init(f, hid), "b": np.zeros(hid, np.float32), "V": init(hid, gate), "U": init(hid, gate), "w": init(gate), "c": init(hid), "d": np.zeros(1, np.float32)}
    model, m, v = Model(mean, scale, p), {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    y = labels.astype(np.float32)
    for step in range(1, config.epochs + 1):
        o = model.forward(x, first)
        bag, h, a, g, alpha = o["bag"], o["h"], o["a"], o["g"], o["alpha"]
        err = ((o["y"] - y) / len(y)).astype(np.float32)
        d_code = err[:, None] * p["c"]
        d_alpha = (d_code[bag] * h).sum(1)
        d_s = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, first[:-1])[bag])
        d_a, d_g = d_s[:, None] * p["w"] * g * (1 - a * a), d_s[:, None] * p["w"] * a * g * (1 - g)
        d_h = (alpha[:, None] * d_code[bag] + d_a @ p["V"].T + d_g @ p["U"].T) * (1 - h * h)
        grad = {"W": o["z"].T @ d_h, "b": d_h.sum(0), "V": h.T @ d_a, "U": h.T @ d_g, "w": (a * g).T @ d_s, "c": o["code"].T @ err, "d": err.sum(keepdims=True)}
        rate = config.rate * (1 - step / (config.epochs + 1)) + 1e-4
        for k in p:
            q = grad[k] + config.decay * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
    return model


def fold(key) -> F.Column:
    """The held-out fold: crc32 of the id's decimal text, modulo 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5


_SAMPLE = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("x", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fits on at most `sample_rows` labelled rows outside the held-out fold, picked by a hash of their id; of rows that share an id on one.

    What the driver gets is bounded: sample_rows * sample_passages * N_FEATURES half-precision numbers (134 MB by default).
    """
    held = F.col("key")
    picked = (
        labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"))
        .where(held.isNotNull() & F.col("label").isNotNull() & (fold(held) != 0))
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(config.sample_rows)
    )
    wanted = {r["key"]: r["label"] for r in picked.collect()}  # bounded by sample_rows
    if not wanted:
        return None
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in wanted], "_picked long")
    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), F.col("key") == F.col("_picked"))
    chosen = chosen.groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size, most = config.passage_bytes, config.sample_passages

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        for block in found:
            x, first = passages(block.data, block.offsets, size)
            picked = [x[a + np.arange(min(n, most)) * n // min(n, most)] for a, n in zip(first.tolist(), np.diff(first).tolist(), strict=False)]
            yield {"key": block.rows.column(1), "n": [len(p) for p in picked], "x": [p.astype(np.float16).tobytes() for p in picked]}

    rows = sorted(map_blocks(chosen, "key", "text", "key long, n int, x binary", work, _SAMPLE).collect(), key=lambda r: (r["key"], r["n"], r["x"]))
    if not rows:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float16).reshape(r["n"], N_FEATURES) for r in rows]).astype(np.float32)
    first = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
    return fit(x, first, np.array([wanted[r["key"]] > 0 for r in rows]), config)


def scored(docs: DataFrame, model: Model | None, config: QualityConfig = QualityConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row, over its whole text; no shuffle."""
    size = config.passage_bytes

    def work(found: Iterator[TextBlock]) -> Iterator[dict]:
        for block in found:
            if model is None:
                score = np.ones(len(block))
            else:
                score = model.score(*passages(block.data, block.offsets, size))
            yield {"doc_id": block.rows.column(1), "score": score}

    return map_blocks(docs, key, text, "doc_id long, score double", work, _SCORED)


def classify(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    out = scored(docs, train(docs, labels, config), config)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


_TAGGED = "_folio_row"


def accepted(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns; row and score stay together, so nothing is joined."""
    model = train(docs, labels, config, key, text)
    size, threshold, name = config.passage_bytes, config.threshold, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folio.llm.arrow import blocks

        for block in blocks(batches, name):
            keep = np.ones(len(block), bool) if model is None else model.score(*passages(block.data, block.offsets, size)) >= threshold
            yield block.rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
