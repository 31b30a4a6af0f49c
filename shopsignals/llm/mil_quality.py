"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole
text is described by byte, word and hashed-word measures and encoded by a small
learned layer; gated attention (tanh times sigmoid) weighs the passages, and a
logistic unit scores their weighted sum. Encoder, attention and unit are
learned together from document labels alone, by Adam on the driver, from a
bounded sample: at most ``per_class`` documents of each label (by hash of
doc_id), with all their passages; a text of more than ``BAG`` passages is learned
from as BAG stretches of equal length, each the mean of its passages. Scores are
set back to the share of labels in all rows learned from. Only the text enters
a score.

Results in cases of doubt: a null text is empty; a text without words is one
passage without measures; labels of null, other than 0 and 1, or contradicting
each other for one doc_id are not learned from; of several texts under one labelled doc_id one is; without labels of both kinds
every score is the share of label 1, or 0.5 without any; rows that repeat a
doc_id are scored each; a null doc_id is in no held-out part (its remainder is
null, held_out false); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm.kernels import M3, U, batch, groups, mix, text_buffer, word_ids, words
from shopsignals.llm.tables import ship

PASSAGE, BAG = 96, 48
PER_CLASS = 2000
HASHED = 32
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",;:", b"!", b"?", b"'\"`", b"()[]{}",
         b"|", b"#*$%&", b"<>/\\=", b"-_", b"@~^+", b"\n", b"\t\r\x0b\x0c", b" "]
CLASS = np.full(256, len(KINDS) + 1, np.uint8)  # other bytes
CLASS[0x80:0xC0] = len(KINDS)  # bytes that continue a character
for _i, _k in enumerate(KINDS):
    CLASS[list(_k)] = _i
CLASSES = len(KINDS) + 2
WIDTH = CLASSES + 8 + HASHED


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages of the rows of one group, and passages per row."""
    ws, we, row = words(raw, off)
    rows = len(off) - 1
    n_words = np.bincount(row, minlength=rows)
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(count) - count
    begin = np.cumsum(n_words) - n_words
    k = np.arange(len(ws)) - begin[row]
    p = base[row] + k // PASSAGE
    total = int(count.sum())
    n = np.bincount(p, minlength=total).astype(np.float32)
    n1 = np.maximum(n, 1)
    # bytes from a passage's first word to the next passage's; the first begins with its row
    start = np.zeros(total, np.int64)
    start[p[k % PASSAGE == 0]] = ws[k % PASSAGE == 0]
    start[base] = off[:-1]
    size = np.diff(np.append(start, off[-1]))
    x = raw[off[0]:off[-1]]
    of = np.repeat(np.arange(total), size)
    kinds = np.bincount(of * CLASSES + CLASS[x], minlength=total * CLASSES).reshape(total, CLASSES)
    ids = word_ids(raw, ws, we)
    h = mix(ids, p.astype(U) * M3)
    o = np.argsort(h)
    new = np.ones(len(o), bool)
    new[1:] = h[o][1:] != h[o][:-1]
    head = np.flatnonzero(new)
    often = np.diff(np.append(head, len(o)))
    own = p[o[head]]
    length = (we - ws).astype(np.float32)
    echo = np.zeros(len(ids), bool)
    echo[1:] = (ids[1:] == ids[:-1]) & (p[1:] == p[:-1])
    first = raw[ws] if len(ws) else np.zeros(0, np.uint8)
    last = raw[we - 1] if len(we) else first
    s = lambda w: np.bincount(p, w, total).astype(np.float32)
    mean = s(length) / n1
    hashed = np.bincount(p * HASHED + (ids >> U(58)).astype(np.int64) % HASHED, np.where(ids & U(1), 1.0, -1.0), total * HASHED)
    cols = [kinds / np.maximum(size, 1)[:, None],
            np.stack([np.bincount(own, minlength=total) / n1, np.bincount(own, often.astype(float) ** 2, total) / n1 ** 2, s(echo) / n1, mean,
                      np.sqrt(np.maximum(s(length ** 2) / n1 - mean ** 2, 0)), s((first >= 65) & (first <= 90)) / n1,
                      s((CLASS[last] > 2) & (CLASS[last] < 14)) / n1, np.log1p(n)], axis=1),
            hashed.reshape(total, HASHED) / np.sqrt(n1)[:, None]]
    return np.concatenate(cols, axis=1).astype(np.float32), count


@dataclass
class Model:
    """Weights of encoder (W, b), gated attention (V, G, w) and scoring unit (c, d)."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float = 0.0

    def forward(self, x: np.ndarray, count: np.ndarray):
        m = self.weights
        h = np.tanh(x @ m["W"] + m["b"])
        t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["G"])))
        s = (t * g) @ m["w"]
        head = np.cumsum(count) - count
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, head), count))
        a = e / np.repeat(np.add.reduceat(e, head), count)
        z = np.add.reduceat(a[:, None] * h, head, axis=0)
        return z @ m["c"] + m["d"][0], (h, t, g, a, z, head)

    def scale_in(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        o = self.forward(self.scale_in(x), count)[0].astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(o, -40, 40)))


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, steps: int = 250, hidden: int = 16, gate: int = 8, rate: float = 0.02,
        decay: float = 1e-4) -> Model:
    """Full-batch Adam on the logistic loss; both labels weigh the same."""
    rnd = np.random.default_rng(0)
    d = x.shape[1]
    init = lambda *n: (rnd.normal(size=n) / np.sqrt(n[0])).astype(np.float32)
    w = {"W": init(d, hidden), "b": np.zeros(hidden, np.float32), "V": init(hidden, gate), "G": init(hidden, gate), "w": init(gate),
         "c": init(hidden), "d": np.zeros(1, np.float32)}
    model = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), w)
    x = model.scale_in(x)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        o, (h, t, g, a, z, head) = model.forward(x, count)
        do = ((1 / (1 + np.exp(-o)) - y) * weight).astype(np.float32)
        dz = np.repeat(do[:, None] * w["c"], count, axis=0)
        da = (h * dz).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, head), count))
        dtg = ds[:, None] * w["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dpre = (a[:, None] * dz + dt @ w["V"].T + dg @ w["G"].T) * (1 - h * h)
        grad = {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dt, "G": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ do, "d": do.sum(keepdims=True)}
        for k, v in w.items():
            gk = grad[k] + decay * v
            m1[k] = 0.9 * m1[k] + 0.1 * gk
            m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
            v -= (rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def _bags(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bag", pa.binary())])
    for b in batches:
        raw, off = text_buffer(b.column("text"))
        bags = []
        for i, j in groups(off):
            x, count = passages(raw, off[i:j + 1])
            for part in np.split(x, np.cumsum(count)[:-1]):
                cut = np.linspace(0, len(part), min(len(part), BAG), endpoint=False).astype(int)
                size = np.diff(np.append(cut, len(part)))
                bags.append((np.add.reduceat(part, cut, axis=0) / size[:, None]).astype(np.float32).tobytes())
        yield batch(schema, b.column("doc_id"), b.column("label"), pa.array(bags, pa.binary()))


def held_out():
    """crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | float:
    """The model, or the constant score where labels of both kinds are missing.
    ``labels``: doc_id and quality; held-out rows are left out."""
    ship(documents.sparkSession)
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)").where(~held_out())
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most"))
    seen = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * per_class rows of two numbers
    sample = F.broadcast(sample.withColumnRenamed("doc_id", "_id"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bags = (texts.join(sample, texts["doc_id"] == sample["_id"]).select("doc_id", "label", "text")
            .mapInArrow(_bags, "doc_id long, label int, bag binary")
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.min("bag").alias("bag")).orderBy("doc_id").collect())
    y = np.array([r["label"] for r in bags], np.float32)
    if len(set(y.tolist())) < 2:
        return (seen.get(1, 0) + 1) / (sum(seen.values()) + 2)
    x = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in bags]
    model = fit(np.concatenate(x), np.array([len(v) for v in x]), y)
    model.shift = float(np.log(seen[1] / seen[0]))
    return model


def _scorer(model: Model | float, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def apply(batches):
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            score = np.full(b.num_rows, model if isinstance(model, float) else 0.0)
            if isinstance(model, Model):
                for i, j in groups(off):
                    score[i:j] = model.score(*passages(raw, off[i:j + 1]))
            yield batch(schema, b.column("doc_id"), score, (score >= threshold).astype(np.int32))
    return apply


def score(documents: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(documents.sparkSession)
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_scorer(model, threshold), "doc_id long, score double, predicted int")
            .select("doc_id", held_out().alias("held_out"), "score", "predicted"))


def _keeper(model: Model | float, threshold: float):
    judge = _scorer(model, threshold)

    def apply(batches):
        for b in batches:
            (s,) = judge(iter([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column("text")], ["doc_id", "text"])]))
            yield b.filter(pa.array(s.column("predicted").to_numpy() == 1))
    return apply


def accepted(documents: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """The documents predicted to be of label 1, all columns."""
    ship(documents.sparkSession)
    return documents.mapInArrow(_keeper(model, threshold), documents.schema)
