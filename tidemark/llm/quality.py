"""Quality classifier: document evidence with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release, slices, text_bytes, text_lengths
from tidemark.llm.jaccard import SLICE, word_hashes

_BYTES = np.arange(256)
_CLASSES = [
    (_BYTES >= 97) & (_BYTES <= 122),
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    _BYTES >= 128,
    _BYTES == 10,
    np.isin(_BYTES, [32, 9, 11, 12, 13]),
    np.isin(_BYTES, [ord(c) for c in ".,;:?'\"-"]),
    np.isin(_BYTES, [ord(c) for c in "!"]),
    np.isin(_BYTES, [ord(c) for c in "|"]),
    np.isin(_BYTES, [ord(c) for c in "#$%&*@<>{}[]()/\\=+_~^`"]),
]
N_FEATURES = len(_CLASSES) + 4


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of whole texts laid end to end: shares of byte classes and of words that are the one before again, mean word length, log length, share of repeated lines."""
    n = np.diff(off)
    out = np.zeros((len(n), N_FEATURES), np.float32)
    size = np.maximum(n, 1)
    for i, c in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(c[raw], dtype=np.int64)])[off]
        out[:, i] = np.diff(total) / size
    spaces = (out[:, 4] + out[:, 5]) * size
    words, before = word_hashes(raw, off)
    again = np.concatenate([[0, 0], np.cumsum(words[1:] == words[:-1])])[: len(words) + 1]
    first = np.minimum(before[:-1] + 1, before[1:])  # a text's first word has none before it
    out[:, -4] = (again[before[1:]] - again[first]) / np.maximum(np.diff(before), 1)
    out[:, -3] = np.minimum(n / (spaces + 1), 50) / 10
    out[:, -2] = np.log1p(n) / 10
    data = raw.tobytes()
    for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        lines = [x for x in data[a:b].split(b"\n") if x]
        out[i, -1] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps on standardised features, each row counted so many ``times``; bias and weights for raw ones."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of good ones, smoothed
        p = ((y * times).sum() + 1) / (times.sum() + 2)
        return float(np.log(p / (1 - p))), np.zeros(x.shape[1])
    mean = np.average(x, axis=0, weights=times)
    sd = np.average((x - mean) ** 2, axis=0, weights=times) ** 0.5 + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) * times)[:, None]).T @ z + np.diag(penalty), z.T @ ((y - p) * times) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - (w[1:] / sd * mean).sum()), w[1:] / sd


def _strength(groups: DataFrame, above: str) -> float:
    """The prior's weight in rows, by the method of moments: how much groups differ from ``above`` beyond chance. Clipped to 1 to 10^6."""
    mean, n = F.col("s") / F.col("n"), F.col("n").cast("double")
    chance = F.col(above) * (1 - F.col(above))
    r = groups.agg(F.sum(n * (mean - F.col(above)) ** 2).alias("d"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(chance).alias("c"), F.sum(chance * n).alias("cn"), F.count("*").alias("g")).first()
    if not r.n or r.n * r.n <= r.nn or r.g < 2:
        return 1e6
    spread = max(r.d - r.c, 0) / (r.n - r.nn / r.n)
    return float(min(max((r.cn / r.n) / max(spread, 1e-12) - 1, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """One row for each input row: ``doc_id, p_doc, p_host, p_path, score, keep``.

    ``p_doc`` is the classifier's probability from the text alone, fitted on at most ``max_labelled`` different labelled
    rows (those of least hash of identifier and features), each counted as often as it comes. Hosts and paths collect, over all documents, labels where there are some and ``p_doc`` elsewhere:
    a host's posterior mean shrinks towards the mean of all, a path's towards its host's, each the more the fewer
    rows it has, with weights of the priors from how much hosts and paths differ. A document's own part is left out of
    its host and path. ``score`` joins the odds of ``p_path`` with the evidence of the text, the odds of ``p_doc`` over
    those of the mean; ``keep`` is ``score >= threshold``.

    A null text counts as empty. A null host or path is one of its own, by the name ``-``. A label is the mean of its
    rows, null ones left out; labels of no document and a null identifier's are not used. Repeated rows count each. A row
    of a score of just ``threshold`` is kept. Texts of any length are read whole. An empty table gives an empty result;
    other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(text_lengths(b.column(3)), SLICE):
                f = features(*text_bytes(b.column(3).slice(i, j - i)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, N_FEATURES, dtype=np.int32)), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), lists], names=["doc_id", "host", "path", "f"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("-")).alias("host"), F.coalesce(path.cast("string"), F.lit("-")).alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, host string, path string, f array<float>")
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id")).agg(F.avg(label_col).cast("double").alias("y"))
    rows = scratch.put(rows.join(marks, "doc_id", "left"))
    # A share of the hashes that leaves max_labelled rows and six deviations more, of which the least are taken: what is
    # sent anywhere is bounded, however many rows, partitions and copies there are.
    labelled = rows.where("y is not null").withColumn("draw", F.pmod(F.xxhash64("doc_id", "f"), F.lit(1 << 40)))
    share = (max_labelled + 6 * max_labelled**0.5) / max(1, labelled.count())
    labelled = labelled.where(F.col("draw") < int(min(1.0, share) * (1 << 40))).groupBy("draw", "doc_id", "f").agg(F.first("y").alias("y"), F.count("*").alias("times"))
    known = scratch.put(labelled.orderBy("draw", "doc_id", "f").limit(max_labelled).select("f", "y", "times")).toPandas()
    x = np.array(known["f"].tolist(), np.float64).reshape(-1, N_FEATURES)
    bias, w = fit(x, (known["y"].to_numpy() >= 0.5).astype(float), known["times"].to_numpy().astype(float))
    margin = F.aggregate(F.zip_with("f", F.array(*[F.lit(float(c)) for c in w]), lambda a, b: a.cast("double") * b), F.lit(bias), lambda a, b: a + b)
    sure = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda p: F.log(sure(p) / (1 - sure(p)))
    expit = lambda z: 1 / (1 + F.exp(-z))
    rows = rows.withColumn("p_doc", expit(margin)).withColumn("v", F.coalesce("y", "p_doc"))
    paths = scratch.put(rows.groupBy("host", "path").agg(F.sum("v").alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = float((total[0] or 0) + 0.5) / ((total[1] or 0) + 1)
    k_host = _strength(hosts.withColumn("m", F.lit(mean)), "m")
    hosts = hosts.withColumn("m", (F.col("s") + k_host * mean) / (F.col("n") + k_host))
    paths = paths.join(hosts.select("host", "m", F.col("s").alias("hs"), F.col("n").alias("hn")), "host")
    k_path = _strength(paths, "m")
    out = rows.join(paths, ["host", "path"])
    v = F.col("v")
    out = out.withColumn("p_host", (F.col("hs") - v + k_host * mean) / (F.col("hn") - 1 + k_host))
    out = out.withColumn("p_path", (F.col("s") - v + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path))
    out = out.withColumn("score", expit(odds(F.col("p_path")) + odds(F.col("p_doc")) - odds(F.lit(mean))))
    return out.select("doc_id", "p_doc", "p_host", "p_path", "score", (F.col("score") >= threshold).alias("keep"))
