"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words, every one of which is encoded. A hidden layer turns a passage
into a vector; gated attention (tanh times sigmoid) weighs the passages of a document, the weights sum to one, and the
weighted vector is scored by a logistic layer. Labels exist for documents only, so the model learns itself which passages
matter.

The encoding of a passage looks at its form alone: shares of single bytes, how word lengths spread, how often words repeat
in the passage and how much of it repeats from before it in the document. Nothing but the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stationweave.llm._common import prepare

PASSAGE_WORDS = 100
# Labelled documents a fit takes at most, of each class, chosen by a hash of the id.
SAMPLE_ROWS = 1500
HIDDEN, GATE = 24, 12
FEATURES = 256 + 12
_MIX = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)


def encode(text: str | None) -> np.ndarray:
    """Passages x features of a whole text; a text without words is one passage of zeros."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
    words = len(starts)
    if words == 0:
        return np.zeros((1, FEATURES), dtype=np.float32)
    ends = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1
    lengths = ends - starts
    passages = -(-words // PASSAGE_WORDS)
    word_passage = np.arange(words) // PASSAGE_WORDS
    per = np.bincount(word_passage, minlength=passages).astype(np.float64)
    first = starts[::PASSAGE_WORDS].copy()
    first[0] = 0
    byte_passage = np.repeat(np.arange(passages), np.diff(np.append(first, len(data))))
    table = np.bincount(byte_passage * 256 + data, minlength=passages * 256).reshape(passages, 256)
    size = np.maximum(table.sum(1, keepdims=True), 1)
    out = np.zeros((passages, FEATURES), dtype=np.float32)
    out[:, :256] = np.log1p(1000.0 * table / size)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word_passage, weights=mask, minlength=passages) / per
    mean = share(lengths.astype(np.float64))
    out[:, 256] = mean / 5
    out[:, 257] = np.sqrt(np.maximum(share(lengths.astype(np.float64) ** 2) - mean ** 2, 0)) / 3
    out[:, 258], out[:, 259], out[:, 260] = share(lengths <= 2), share(lengths >= 12), share(lengths >= 25)
    # A hash of each word: the sum of its bytes' codes, each multiplied by an odd power of its place.
    with np.errstate(over="ignore"):
        # Bytes before the first word belong to no word and count as nothing.
        spans = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data)) - np.concatenate([np.zeros(starts[0], dtype=np.int64), np.repeat(starts, spans)])
        odd = np.uint64(2) * place.astype(np.uint64) + np.uint64(1)
        codes = np.where(inside, _MIX[data] * odd * odd * odd, np.uint64(0))
        hashes = np.add.reduceat(codes, starts)
        pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]

    def fresh(values: np.ndarray) -> np.ndarray:
        """Which values are the first of their kind in the document."""
        seen = np.zeros(len(values), dtype=bool)
        seen[np.unique(values, return_index=True)[1]] = True
        return seen
    out[:, 261] = share(~fresh(hashes))
    again = np.append(~fresh(pairs), False) if words > 1 else np.zeros(1, dtype=bool)
    out[:, 262] = share(again)
    last = data[ends - 1]
    letter = ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128)
    sentence = (last == 46) | (last == 33) | (last == 63)
    head = data[starts]
    out[:, 263], out[:, 264] = share(~letter & ~sentence & (last != 44)), share(sentence)
    out[:, 265], out[:, 266] = share((head >= 65) & (head <= 90)), share(~(((head | 32) >= 97) & ((head | 32) <= 122) | (head >= 128)))
    out[:, 267] = np.log1p(per) / 5
    return out


@dataclass
class AttentionModel:
    """Layers of the model and the scaling of its inputs."""

    shift: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]

    def score(self, passages: np.ndarray) -> tuple[float, np.ndarray]:
        """Probability of label 1 and the attention weights of the passages."""
        x = np.clip((passages - self.shift) / self.scale, -8, 8)
        hidden = np.maximum(x @ self.layers["w"] + self.layers["b"], 0)
        gate = np.tanh(hidden @ self.layers["v"]) / (1 + np.exp(-hidden @ self.layers["u"]))
        raw = gate @ self.layers["a"]
        weight = np.exp(raw - raw.max())
        weight /= weight.sum()
        margin = float(weight @ hidden @ self.layers["o"] + self.layers["c"][0])
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40))), weight


def fit(bags: list[np.ndarray], labels: np.ndarray, prior: float, epochs: int = 40, rate: float = 3e-3, batch: int = 64,
        penalty: float = 1e-4, seed: int = 3) -> AttentionModel:
    """Fit by Adam on the log-loss; ``prior`` is the share of label 1 among all labelled rows.

    The sample may hold the classes in another ratio, so rows are weighted back to ``prior`` and scores are probabilities.
    Without rows, or with one class only, every score is the share of label 1.
    """
    d, rng = FEATURES, np.random.default_rng(seed)
    layers = {"w": rng.normal(0, d ** -0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
              "u": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE ** -0.5, GATE),
              "o": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "c": np.zeros(1)}
    level = min(max(prior, 1e-3), 1 - 1e-3)
    layers["c"][0] = np.log(level / (1 - level))
    if not bags or labels.min() == labels.max():
        layers["o"][:] = 0
        return AttentionModel(np.zeros(d), np.ones(d), layers)
    everything = np.concatenate(bags)
    shift, scale = everything.mean(0), np.maximum(everything.std(0), 0.05)
    ratio = labels.mean()
    balance = np.where(labels == 1, level / ratio, (1 - level) / (1 - ratio))
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in layers.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(bags), batch):
            chosen = order[start:start + batch]
            x = np.clip((np.concatenate([bags[k] for k in chosen]) - shift) / scale, -8, 8)
            cuts = np.cumsum([0] + [len(bags[k]) for k in chosen])
            owner = np.repeat(np.arange(len(chosen)), np.diff(cuts))
            before = x @ layers["w"] + layers["b"]
            hidden = np.maximum(before, 0)
            t, s = np.tanh(hidden @ layers["v"]), 1 / (1 + np.exp(-hidden @ layers["u"]))
            raw = (t * s) @ layers["a"]
            weight = np.exp(raw - np.maximum.reduceat(raw, cuts[:-1])[owner])
            weight /= np.add.reduceat(weight, cuts[:-1])[owner]
            bag = np.add.reduceat(weight[:, None] * hidden, cuts[:-1])
            p = 1 / (1 + np.exp(-np.clip(bag @ layers["o"] + layers["c"][0], -40, 40)))
            d_margin = (p - labels[chosen]) * balance[chosen] / len(chosen)
            d_bag = d_margin[:, None] * layers["o"]
            inner = (hidden * d_bag[owner]).sum(1)
            d_raw = weight * (inner - np.add.reduceat(weight * inner, cuts[:-1])[owner])
            d_gate = d_raw[:, None] * layers["a"]
            d_t, d_s = d_gate * s * (1 - t ** 2), d_gate * t * s * (1 - s)
            d_hidden = weight[:, None] * d_bag[owner] + d_t @ layers["v"].T + d_s @ layers["u"].T
            d_before = d_hidden * (before > 0)
            slopes = {"w": x.T @ d_before, "b": d_before.sum(0), "v": hidden.T @ d_t, "u": hidden.T @ d_s,
                      "a": (t * s).T @ d_raw, "o": bag.T @ d_margin, "c": np.array([d_margin.sum()])}
            step += 1
            for k, slope in slopes.items():
                slope = slope + penalty * layers[k] * (k not in "bc")
                one, two = moments[k]
                one += 0.1 * (slope - one)
                two += 0.001 * (slope ** 2 - two)
                layers[k] = layers[k] - rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.999 ** step)) + 1e-8)
    return AttentionModel(shift, scale, layers)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AttentionModel:
    """Fit on at most ``sample_rows`` labelled documents of either class, chosen by a hash of the id.

    Rows with a null id or label are left out; of rows that repeat an id the largest label counts. Each sampled document
    is encoded whole by the executors; its encoded passages, not its text, reach the driver.
    """
    prepare(docs.sparkSession)
    known = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("_id")).agg(F.max((F.col(label_column) >= 1).cast("int")).alias("_y")))
    prior = known.agg(F.avg("_y")).first()[0]
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = (known.where("_y = 1").orderBy(*order).limit(sample_rows)
              .unionByName(known.where("_y = 0").orderBy(*order).limit(sample_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [encode(t).astype(np.float32).tobytes() for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(bags, pa.binary())],
                                             names=["_id", "_y", "_bag"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t")).join(chosen, "_id")
    rows = picked.select("_id", "_y", "_t").mapInArrow(run, f"_id {kind}, _y int, _bag binary").toArrow()
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b in rows.column("_bag").to_pylist()]
    ids, y = rows.column("_id").to_pylist(), np.array(rows.column("_y").to_pylist(), dtype=np.float64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], bags[i].shape[0], bags[i].tobytes()[:64]))
    return fit([bags[i] for i in order], y[order], prior if prior is not None else 0.5)


def score(docs: DataFrame, model: AttentionModel, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text as ``name``; an input column called so is replaced.

    Null and wordless texts are a bag of one empty passage and get the score of that.
    """
    prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [float(model.score(encode(t))[0]) for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(
        run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))
