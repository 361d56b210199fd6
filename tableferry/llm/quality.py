"""A quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of every text. The trees are fitted on a bounded sample of labelled
rows, flattened into arrays, and sent to the tasks, where numpy walks all trees of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.llm.tables import kept, named, steps, utf8

STATISTICS = (
    "bytes", "words", "word_length", "letters", "capitals", "digits", "marks", "symbols", "spaces", "beyond_ascii",
    "distinct_words", "top_word", "lines", "line_length", "distinct_lines", "stops", "commas", "shouts",
    "entropy", "longest_word",
)


def _classes() -> np.ndarray:
    """For each byte, the classes it counts in."""
    groups = [
        b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
        b".,;:!?'\"()-", b" \t\n\r\x0b\x0c", b".", b",", b"!",
    ]
    table = np.zeros((256, len(groups) + 1))
    for k, members in enumerate(groups):
        table[list(members), k] = 1
    table[128:, -1] = 1
    return table


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    counts = np.zeros((len(texts), 256))
    shape = np.zeros((len(texts), 8))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = Counter(text.split()), text.split(b"\n")
        n = words.total()
        shape[i, :5] = (n, len(words), max(words.values(), default=0), max(map(len, words), default=0), len(lines))
        shape[i, 5] = len(set(lines))
    size = np.maximum(counts.sum(axis=1), 1)
    letters, capitals, digits, marks, spaces, stops, commas, shouts, beyond = (counts @ _classes()).T
    share = counts / size[:, None]
    entropy = -np.where(share > 0, share * np.log2(np.maximum(share, 1e-12)), 0).sum(axis=1)
    n_words, lines = np.maximum(shape[:, 0], 1), np.maximum(shape[:, 4], 1)
    symbols = counts.sum(axis=1) - letters - digits - marks - spaces - beyond
    return np.column_stack([
        np.log1p(counts.sum(axis=1)), np.log1p(shape[:, 0]), (size - spaces) / n_words, letters / size,
        capitals / np.maximum(letters, 1), digits / size, marks / size, symbols / size, spaces / size, beyond / size,
        shape[:, 1] / n_words, shape[:, 2] / n_words, np.log1p(shape[:, 4]), np.log1p(size / lines),
        shape[:, 5] / lines, stops / n_words, commas / n_words, shouts / n_words, entropy, np.log1p(shape[:, 3]),
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row, null texts as empty ones."""
    source = named(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            flat = statistics(utf8(batch)).astype(np.float32)
            offsets = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
            stats = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    schema = T.StructType([source.schema[0], T.StructField("stats", T.ArrayType(T.FloatType()))])
    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth as arrays: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes); a value over the cut goes right
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all trees of all rows level by level."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(stats), len(trees)), np.int64)
        rows = np.arange(len(stats))[:, None]
        inner = self.feature.shape[1]
        for _ in range(inner.bit_length()):
            over = stats[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + over
        raw = self.base + self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(
    stats: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
    smoothing: float = 1.0, least: float = 2.0,
) -> Trees:
    """Boosted trees on logistic loss; splits come from histograms of binned values.

    `label` lies between 0 and 1. Without rows, or with one label only, every score is the base rate.
    """
    mean = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
    base = float(np.log(mean / (1 - mean)))
    inner, n_features = 2**depth - 1, stats.shape[1] if len(label) else len(STATISTICS)
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if not len(label) or label.min() == label.max():
        return Trees(feature, cut, leaf, base)
    edges = [np.unique(np.quantile(stats[:, f], np.arange(1, bins) / bins)) for f in range(n_features)]
    binned = np.stack([np.searchsorted(edges[f], stats[:, f], side="left") for f in range(n_features)])
    raw = np.full(len(label), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = label - p, p * (1 - p)
        node = np.zeros(len(label), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gains = np.full((n_features, width, bins), -1.0)
            for f in range(n_features):
                at = (node - first) * bins + binned[f]
                left_g = np.bincount(at, slope, width * bins).reshape(width, bins).cumsum(axis=1)
                left_h = np.bincount(at, bend, width * bins).reshape(width, bins).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                value = left_g**2 / (left_h + smoothing) + right_g**2 / (right_h + smoothing) - all_g**2 / (all_h + smoothing)
                usable = (left_h >= least) & (right_h >= least)
                usable[:, len(edges[f]) :] = False
                gains[f] = np.where(usable, value, -1.0)
            flat = gains.transpose(1, 0, 2).reshape(width, -1)
            best = flat.argmax(axis=1)
            for k in range(width):
                if flat[k, best[k]] > 1e-9:
                    f, b = divmod(int(best[k]), bins)
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            chosen = stats[np.arange(len(label)), feature[t, node]]
            node = 2 * node + 1 + (chosen > cut[t, node])
        g = np.bincount(node - inner, slope, inner + 1)
        h = np.bincount(node - inner, bend, inner + 1)
        leaf[t] = rate * g / (h + smoothing)
        raw += leaf[t, node - inner]
    return Trees(feature, cut, leaf, base)


def train(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Trees fitted on the rows of `labels` (doc_id, label), at most about `max_rows` of them.

    With more labelled rows than that, a hash of the id decides which are used. Rows with a null id
    or label are left out; a document that is labelled several times has the mean of its labels.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    share = max_rows / max(known.count(), max_rows)
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = stats.join(picked, "doc_id").select("stats", "label").toArrow()
    width = len(STATISTICS)
    values = np.asarray(rows.column("stats").combine_chunks().flatten(), np.float32).reshape(-1, width)
    order = np.lexsort([*values.T, rows.column("label").to_numpy()])  # the same trees in whatever order rows arrive
    return fit(values[order], rows.column("label").to_numpy().astype(float)[order])


def score(stats: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of every row of `document_statistics`."""
    schema = T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())])
    sent = stats.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("stats").flatten()).reshape(-1, len(STATISTICS))
            result = sent.value.scores(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(result)], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, schema)


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", max_rows: int = 20_000,
) -> DataFrame:
    """(doc_id, score) of every row, learned from the labelled ids for which `learn` (on doc_id) holds.

    Null texts count as empty; repeated rows get equal scores; without any label all scores are 0.5.
    """
    stats = kept(document_statistics(docs, id_col, text_col), "statistics")
    known = named(labels, doc_id=id_col, label=label_col).filter(learn)
    return score(stats, train(stats, known, max_rows))
