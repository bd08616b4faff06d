"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

The model has one weight per feature and one threshold per step between grades: the chance of a grade above k is
``sigmoid(w . x - threshold_k)`` with increasing thresholds. A document's score is its expected grade.

Features are shares of a document's words: whole lower-cased words and the stems (first five letters) of longer ones, so
that inflected forms of one stem count together. Only features that enough of the labelled rows use are kept.

Labels that only say toxic or not are turned into grades 0 to 3 by ``graded``: clean rows are 0 and toxic rows are cut at
the terciles of the share of their words that set toxic rows apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.llm._common import prepare, written

# Labelled rows a fit takes at most, of each class; chosen by a hash of the id.
SAMPLE_ROWS = 4000
# Labelled rows a feature must occur in, and how many features are kept at most; neither depends on the corpus.
FEATURE_ROWS = 5
FEATURES = 4000
STEM = 5
_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> tuple[Counter, int]:
    """Counts of words and stems of a whole text, and its number of words; null and wordless texts have none."""
    words = Counter(_WORD.findall((text or "").lower()))
    total = sum(words.values())
    stems: Counter = Counter()
    for word, n in words.items():
        if len(word) > STEM:
            stems[word[:STEM] + "*"] += n
    words.update(stems)
    return words, total


@dataclass
class SeverityModel:
    """Weights by feature and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def expected(self, text: str | None) -> float:
        """Expected grade from 0 to the number of thresholds."""
        words = _WORD.findall((text or "").lower())
        total = 0.0
        find = self.weights.get
        stems = self._stems()
        for word, n in Counter(words).items():
            weight = find(word)
            if weight is not None:
                total += n * weight
            if len(word) > STEM:
                weight = stems.get(word[:STEM])
                if weight is not None:
                    total += n * weight
        margin = total / max(len(words), 1)
        return float(sum(1 / (1 + math.exp(min(60.0, max(-60.0, t - margin)))) for t in self.thresholds))

    def _stems(self) -> dict[str, float]:
        if not hasattr(self, "_by_stem"):
            self._by_stem = {k[:-1]: v for k, v in self.weights.items() if k.endswith("*")}
        return self._by_stem


def graded(rows: list[tuple[Counter, int, int]]) -> np.ndarray:
    """Grades from labels: 0 for clean rows, 1 to 3 by terciles of the share of marked words for toxic ones.

    A feature is marked if it is at least 20 times as common among toxic rows. Ties fall into the lower grade.
    """
    toxic = np.array([label for _, _, label in rows], dtype=bool)
    seen = {True: Counter(), False: Counter()}
    for words, _, label in rows:
        seen[bool(label)].update(words.keys())
    sizes = {True: max(int(toxic.sum()), 1), False: max(int((~toxic).sum()), 1)}
    marked = {w for w, n in seen[True].items() if n >= FEATURE_ROWS
              and n / sizes[True] >= 20 * (seen[False][w] + 0.5) / sizes[False]}
    share = np.array([sum(n for w, n in words.items() if w in marked) / max(total, 1) for words, total, _ in rows])
    grades = np.zeros(len(rows), dtype=np.int64)
    if toxic.any():
        cuts = np.quantile(share[toxic], [1 / 3, 2 / 3])
        grades[toxic] = 1 + np.searchsorted(cuts, share[toxic], side="left")
    return grades


def fit(rows: list[tuple[Counter, int]], grades: np.ndarray, penalty: float = 1e-4, steps: int = 800,
        rate: float = 0.03) -> SeverityModel:
    """Fit by full-batch Adam on the mean negative log-likelihood of the grades plus a ridge on the weights.

    Thresholds are a first one plus positive gaps, so they stay in order. Inputs are scaled to a typical share of 1 %.
    Without rows, or with one grade only, all weights are 0 and the expected grade is the mean of the grades.
    """
    levels = max(int(grades.max(initial=0)), 1)
    used = Counter()
    for words, _ in rows:
        used.update(words.keys())
    # The most telling features first: those whose rows differ most in grade from the rest; ties by name.
    mean = float(grades.mean()) if len(grades) else 0.0
    lift = Counter()
    for (words, _), grade in zip(rows, grades):
        for w in words:
            lift[w] += grade - mean
    names = sorted((w for w, n in used.items() if n >= FEATURE_ROWS),
                   key=lambda w: (-abs(lift[w]) / math.sqrt(used[w]), w))[:FEATURES]
    place = {w: i for i, w in enumerate(names)}
    row, col, val = [], [], []
    for r, (words, total) in enumerate(rows):
        for w, n in words.items():
            if w in place:
                row.append(r)
                col.append(place[w])
                val.append(100.0 * n / max(total, 1))
    row, col, val = np.array(row, dtype=np.int64), np.array(col, dtype=np.int64), np.array(val)
    weights = np.zeros(len(names))
    above = np.array([(grades > k).mean() if len(grades) else 0.0 for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - above) / above)
    if not len(rows) or grades.min() == grades.max():
        return SeverityModel({}, start)
    params = np.concatenate([weights, start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    moment, second = np.zeros_like(params), np.zeros_like(params)
    f = len(names)
    # Rare grades weigh as much as common ones do, so that the many clean rows don't decide everything.
    weight = 1 / np.sqrt(np.bincount(grades, minlength=levels + 1)[grades])
    weight /= weight.sum()
    for step in range(1, steps + 1):
        w, gaps = params[:f], np.exp(params[f + 1:])
        thresholds = params[f] + np.concatenate([[0.0], np.cumsum(gaps)])
        margin = np.bincount(row, weights=val * w[col], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(margin[:, None] - thresholds, -40, 40)))
        upper = np.concatenate([np.ones((len(rows), 1)), p], axis=1)
        lower = np.concatenate([p, np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        chance = np.maximum(upper[i, grades] - lower[i, grades], 1e-12)
        slope = p * (1 - p)
        pad = np.zeros((len(rows), 1))
        up, down = np.concatenate([pad, slope], axis=1)[i, grades], np.concatenate([slope, pad], axis=1)[i, grades]
        d_margin = -weight * (up - down) / chance
        d_threshold = np.zeros(levels)
        np.add.at(d_threshold, grades[grades > 0] - 1, (weight * up / chance)[grades > 0])
        np.add.at(d_threshold, grades[grades < levels], -(weight * down / chance)[grades < levels])
        gradient = np.concatenate([
            np.bincount(col, weights=val * d_margin[row], minlength=f) + penalty * w,
            [d_threshold.sum()], gaps * d_threshold[::-1].cumsum()[::-1][1:]])
        moment = 0.9 * moment + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        params -= rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    thresholds = params[f] + np.concatenate([[0.0], np.cumsum(np.exp(params[f + 1:]))])
    kept = {n: 100.0 * float(x) for n, x in zip(names, params[:f]) if abs(x) > 1e-6}
    return SeverityModel(kept, thresholds)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> SeverityModel:
    """Fit on at most ``sample_rows`` labelled documents of either class, chosen by a hash of the id.

    Rows with a null id or label are left out; a label counts as toxic from 1 on. Only the sample's word counts reach the
    driver, and of each sampled document its counts, not its text.
    """
    prepare(docs.sparkSession)
    known = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("_id")).agg(F.max((F.col(label_column) >= 1).cast("int")).alias("_y")))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = (known.where("_y = 1").orderBy(*order).limit(sample_rows)
              .unionByName(known.where("_y = 0").orderBy(*order).limit(sample_rows)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, totals = [], [], []
            for text in batch.column("_t").to_pylist():
                words, total = features_of(text)
                names.append(list(words))
                counts.append(list(words.values()))
                totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"), pa.array(names, pa.list_(pa.string())),
                 pa.array(counts, pa.list_(pa.int32())), pa.array(totals, pa.int64())],
                names=["_id", "_y", "names", "counts", "total"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t")).join(chosen, "_id")
    counted = picked.select("_id", "_y", "_t").mapInArrow(
        count, f"_id {kind}, _y int, names array<string>, counts array<int>, total long")
    pairs = written(counted.select("_id", "_y", "total", F.explode(F.arrays_zip("names", "counts")).alias("f")).select(
        "_id", "_y", "total", F.col("f.names").alias("name"), F.col("f.counts").alias("n")), "word-counts")
    heads = written(counted.select("_id", "_y", "total"), "labelled-rows")
    mean = heads.agg(F.avg("_y")).first()[0] or 0.0
    # The features whose rows differ most in label from the rest, ties by name; only those reach the driver.
    telling = (pairs.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum("_y").alias("toxic"))
               .where(F.col("rows") >= FEATURE_ROWS)
               .orderBy(F.desc(F.abs(F.col("toxic") - mean * F.col("rows")) / F.sqrt("rows")), "name").limit(FEATURES))
    features = pairs.join(telling.select("name"), "name", "left_semi").groupBy("_id", "total").agg(
        F.collect_list(F.struct("name", "n")).alias("features"))
    rows = (heads.join(features, ["_id", "total"], "left").orderBy("_id", "total").select("_y", "total", "features")
            .toArrow().to_pylist())
    table = [(Counter({f["name"]: f["n"] for f in sorted(r["features"] or [], key=lambda x: x["name"])}), r["total"], r["_y"])
             for r in rows]
    return fit([(w, n) for w, n, _ in table], graded(table))


def score(docs: DataFrame, model: SeverityModel, text_column: str = "text", severity: str = "severity") -> DataFrame:
    """``docs`` with the expected grade of every whole text as ``severity``, from 0 up.

    Null, empty and wordless texts have a margin of 0, the same as a text without any known feature. An input column
    called like the new one is replaced.
    """
    prepare(docs.sparkSession)
    from pyspark.sql import types as T
    kept = [f for f in docs.schema.fields if f.name != severity]
    schema = T.StructType([*kept, T.StructField(severity, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.expected(t) for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             names=[*batch.schema.names, severity])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


# A document is toxic from the expected grade at which the first threshold is as likely passed as not.
TOXIC_FROM = 0.5


def keep_clean(docs: DataFrame, labels: DataFrame, text_column: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``docs`` whose expected severity stays below ``toxic_from``, with their own columns."""
    scored = score(docs, train(docs, labels, text_column=text_column), text_column, "__severity")
    return scored.where(F.col("__severity") < toxic_from).drop("__severity")
