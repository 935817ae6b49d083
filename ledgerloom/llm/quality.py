"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line of a text has a feature vector (how much of it is symbols, capitals, repeated words and
the like). The field scores a labelling by a weight for each feature and label and one for each pair
of neighbouring labels, so a doubtful line follows its neighbours. Viterbi decoding finds the best
labelling of a whole text; the share of its words that lie on content lines decides retention.

Only documents are labelled, lines aren't. So a model of single lines is fitted first, each line with
its document's label; lines that it finds to be of the other kind change theirs, as long as most words
of a document keep its label, and the model is fitted again. On the labellings that result, in which
junk has clean lines and clean texts have boilerplate, the field is fitted by gradient ascent on the
conditional likelihood.

The fit takes at most ``max_labelled`` labelled documents (those with the smallest hashes of their
id), and of each up to ``max_runs`` runs of RUN lines, drawn by a hash over its whole length. That
bounds the fit only: every document is decoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import hashing
from ledgerloom.llm.common import bound_batches, column

MAX_LABELLED, MAX_RUNS, RUN = 2000, 4, 64
MIN_SHARE = 0.5
FEATURES = ("one", "empty", "long", "symbols", "any_symbols", "bars", "capitals", "shouted", "exclaimed", "digits", "stutter", "word_length", "ended")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars)] = 1
    return out


_SYMBOL, _BAR, _CALL, _DIGIT = _table(b"#*$%&|<>"), _table(b"|"), _table(b"!"), _table(b"0123456789")
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int8)
_END = _table(b".!?:;\"')")


class Lines:
    """Lines of a run of texts: byte spans, the text of each, and feature vectors."""

    def __init__(self, words: hashing.Words):
        data, offsets = words.data, words.offsets
        cut = np.flatnonzero(data == 10)
        owner = np.searchsorted(offsets, cut, "right") - 1
        self.starts = np.concatenate([offsets[:-1], cut + 1])
        own = np.concatenate([np.arange(len(offsets) - 1), owner])
        order = np.lexsort((self.starts, own))
        self.starts, self.owner = self.starts[order], own[order]
        last = np.concatenate([self.owner[1:] != self.owner[:-1], [True]]) if len(own) else np.zeros(0, bool)
        self.ends = np.where(last, offsets[1:][self.owner], np.concatenate([self.starts[1:] - 1, [0]])[: len(self.starts)])
        self.bounds = np.searchsorted(self.owner, np.arange(len(offsets)))
        self.w0, self.w1 = (np.searchsorted(words.starts, x) for x in (self.starts, self.ends))
        self.n_words = self.w1 - self.w0
        self.features = self._features(words)

    def _sum(self, table: np.ndarray, data: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (total[self.ends] - total[self.starts]).astype(np.float64)

    def _features(self, words: hashing.Words) -> np.ndarray:
        data = words.data
        n = np.maximum(self.n_words, 1)
        symbols, bars, upper, letters = (self._sum(x, data) for x in (_SYMBOL, _BAR, _UPPER, _LETTER))
        same = np.zeros(len(words.hashes) + 1, np.int64)
        if len(words.hashes) > 1:
            same[2:] = np.cumsum(words.hashes[1:] == words.hashes[:-1])
        stutter = np.where(self.n_words > 1, same[self.w1] - same[np.minimum(self.w0 + 1, len(same) - 1)], 0)
        size = (self.ends - self.starts).astype(np.float64)
        last = words.ends[np.clip(self.w1 - 1, 0, max(0, len(words.ends) - 1))] - 1 if len(words.ends) else np.zeros(len(n), np.int64)
        ended = _END[data[last]] * (self.n_words > 0) if len(data) else np.zeros(len(n))
        capitals = upper / np.maximum(letters, 1)
        columns = (
            np.ones(len(n)), self.n_words == 0, np.log1p(self.n_words) / 6, np.minimum(symbols / n, 3) / 3, symbols / n > 0.2, np.minimum(bars / n, 1),
            capitals, capitals > 0.5, np.minimum(self._sum(_CALL, data) / n, 2) / 2, self._sum(_DIGIT, data) / np.maximum(size, 1), stutter / n, np.minimum(size / n, 20) / 20, ended,
        )
        return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


@dataclass(frozen=True)
class Field:
    """weight: features x 2 labels (0 boilerplate, 1 content); step: from label x to label."""

    weight: np.ndarray
    step: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels of one text's lines; ties go to content."""
        scores = features @ self.weight
        if len(scores) == 1:
            return np.array([int(scores[0, 1] >= scores[0, 0])])
        (a, b), (c, d) = self.step.tolist()
        rows = scores.tolist()
        x, y = rows[0]
        back = []
        for e0, e1 in rows[1:]:
            to0, to1 = (1 if y + c >= x + a else 0), (1 if y + d >= x + b else 0)
            back.append((to0, to1))
            x, y = (y + c if to0 else x + a) + e0, (y + d if to1 else x + b) + e1
        label = 1 if y >= x else 0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return np.array(out[::-1])


def _adam(gradient, theta: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return theta


def shares(documents: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of runs, given each run's document and that one's label: the two labels weigh alike, and so do documents of one label."""
    _, of, runs = np.unique(documents, return_inverse=True, return_counts=True)
    own = 1.0 / runs[of]
    return np.where(labels == 1, 0.5 / max(1e-9, own[labels == 1].sum()), 0.5 / max(1e-9, own[labels == 0].sum())) * own


def line_labels(runs: list[np.ndarray], words: list[np.ndarray], documents: np.ndarray, labels: np.ndarray, turns: int = 3) -> list[np.ndarray]:
    """Labels of lines from labels of documents; see the module's text. words: of each line."""
    x, n = np.concatenate(runs), np.concatenate(words)
    size = np.array([len(r) for r in runs])
    of = np.repeat(np.unique(documents, return_inverse=True)[1], size)
    whole = np.repeat(labels, size)
    weight = np.repeat(shares(documents, labels) / size, size)
    y = whole.copy()
    for _ in range(turns):
        theta = _adam(lambda w, y=y: x.T @ (weight * (y - 1 / (1 + np.exp(-(x @ w))))) - 1e-3 * w, np.zeros(x.shape[1]), 200, 0.1)
        y = np.where(n > 0, (x @ theta >= 0).astype(int), whole)
        # Most words of a document keep its label, or all do.
        kept = np.bincount(of, n * (y == whole)) > 0.5 * np.bincount(of, n)
        y = np.where(kept[of], y, whole)
    return np.split(y, np.cumsum(size)[:-1])


def fit(runs: list[np.ndarray], labels: list[np.ndarray], share: np.ndarray, rounds: int = 200, rate: float = 0.1, shrink: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of the lines' labels, with Adam; a run weighs its share, over its lines."""
    n, longest, f = len(runs), max(map(len, runs)), runs[0].shape[1]
    order = np.argsort([-len(r) for r in runs], kind="stable")
    x, y, live = np.zeros((longest, n, f)), np.zeros((longest, n), int), np.zeros((longest, n), bool)
    for i, j in enumerate(order):
        size = len(runs[j])
        x[:size, i], y[:size, i], live[:size, i] = runs[j], labels[j], True
    share = share[order] / live.sum(0)
    many = live.sum(1)  # runs that have a line at each place: the first ones, as they come by length
    one = np.eye(2)[y] * live[..., None]
    pair = np.einsum("tni,tnj,n->ij", one[:-1], one[1:], share)
    seen = np.einsum("tnf,tni,n->fi", x, one, share)

    def gradient(theta: np.ndarray) -> np.ndarray:
        w, step = theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2)
        e = x @ w
        alpha, beta, last = np.zeros((longest, n, 2)), np.zeros((longest, n, 2)), np.zeros((n, 2))
        alpha[0] = last[:] = e[0]
        for t in range(1, longest):
            k = many[t]
            a = alpha[t - 1, :k]
            alpha[t, :k] = last[:k] = np.logaddexp(a[:, :1] + step[0], a[:, 1:] + step[1]) + e[t, :k]
        edge, z = np.zeros((2, 2)), np.logaddexp(last[:, 0], last[:, 1])
        for t in range(longest - 1, 0, -1):
            k = many[t]
            nxt = beta[t, :k] + e[t, :k]
            beta[t - 1, :k] = np.logaddexp(nxt[:, :1] + step[:, 0], nxt[:, 1:] + step[:, 1])
            edge += np.einsum("nij,n->ij", np.exp(alpha[t - 1, :k, :, None] + step + nxt[:, None, :] - z[:k, None, None]), share[:k])
        node = np.exp(alpha + beta - z[None, :, None]) * live[..., None]
        return np.concatenate([(seen - np.einsum("tnf,tni,n->fi", x, node, share)).ravel(), (pair - edge).ravel()]) - shrink * theta

    theta = _adam(gradient, np.zeros(2 * f + 4), rounds, rate)
    return Field(theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2))


def _featurize(max_runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("i").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, hi, words in hashing.runs(batch.column("t")):
                lines, raw, cut = Lines(words), [], []
                for d in range(hi - lo):
                    first = np.arange(lines.bounds[d], lines.bounds[d + 1], RUN)
                    if len(first) > max_runs:
                        drawn = hashing.mix(ids[lo + d] + np.arange(len(first), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        first = np.sort(first[np.argsort(drawn, kind="stable")[:max_runs]])
                    spans = [(a, min(a + RUN, lines.bounds[d + 1])) for a in first.tolist()]
                    raw.append(b"".join(np.column_stack([lines.features[a:b], lines.n_words[a:b]]).tobytes() for a, b in spans))
                    cut.append([int(b - a) for a, b in spans])
                yield pa.record_batch({"i": batch.column("i").slice(lo, hi - lo), "quality": batch.column("quality").slice(lo, hi - lo), "x": pa.array(raw, pa.binary()), "cut": pa.array(cut, pa.list_(pa.int32()))})

    return run


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, max_runs: int = MAX_RUNS) -> Field | None:
    """Fit on labelled documents; None if there are none of both labels.

    Null labels and ids don't count; of several labels of an id the smallest does, and of several
    texts of an id one does, the same in every run. Labels without a document have no effect.
    """
    bound_batches(docs.sparkSession)
    some = labels.where(column(label).isNotNull() & column(id).isNotNull()).groupBy(column(id).cast("long").alias("i")).agg(F.min(column(label).cast("int")).alias("quality"))
    some = some.orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    rows = docs.select(column(id).cast("long").alias("i"), column(text).cast("string").alias("t")).join(F.broadcast(some), "i")
    once = rows.select("i", "t", "quality").mapInArrow(_featurize(max_runs), "i long, quality int, x binary, cut array<int>").groupBy("i").agg(F.min(F.struct("x", "cut", "quality")).alias("r"))
    found = [r["r"] for r in once.orderBy("i").collect()]  # at most max_labelled rows
    if {r["quality"] for r in found} != {0, 1}:
        return None
    runs, documents, whole = [], [], []
    for d, r in enumerate(found):
        lines = np.frombuffer(r["x"], np.float64).reshape(-1, len(FEATURES) + 1)
        for part in np.split(lines, np.cumsum(r["cut"])[:-1]):
            runs.append(part)
            documents.append(d)
            whole.append(r["quality"])
    documents, whole = np.array(documents), np.array(whole)
    features = [r[:, :-1] for r in runs]
    return fit(features, line_labels(features, [r[:, -1] for r in runs], documents, whole), shares(documents, whole))


_QUALITY = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "content_words": pa.int64(), "content_share": pa.float64(), "labels": pa.binary()}
QUALITY = T.StructType([*(T.StructField(c, T.LongType()) for c in list(_QUALITY)[:6]), T.StructField("content_share", T.DoubleType()), T.StructField("labels", T.BinaryType())])


def _judge(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in hashing.runs(batch.column("t")):
                lines, data, off = Lines(words), words.data, words.offsets
                chars = np.concatenate([[0], np.cumsum(_CHAR[data], dtype=np.int64)])
                in_words = np.concatenate([[0], np.cumsum(chars[words.ends] - chars[words.starts])])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
                out: list[list] = [[] for _ in _QUALITY]
                for d in range(hi - lo):
                    b0, b1, l0, l1 = int(words.bounds[d]), int(words.bounds[d + 1]), int(lines.bounds[d]), int(lines.bounds[d + 1])
                    found = field.decode(lines.features[l0:l1]) if field is not None else np.ones(l1 - l0, int)
                    content = int(lines.n_words[l0:l1][found == 1].sum())
                    values = (b1 - b0, in_words[b1] - in_words[b0], symbols[off[d + 1]] - symbols[off[d]], _repeated_lines(lines, data, l0, l1), _repeated_words(words.hashes[b0:b1]), content, content / (b1 - b0) if b1 > b0 else 0.0, found.astype(np.int8).tobytes())
                    for column, value in zip(out, values):
                        column.append(value)
                quality = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(out, _QUALITY.values())], names=list(_QUALITY))
                yield pa.record_batch([batch.column("rest").slice(lo, hi - lo), batch.column("t").slice(lo, hi - lo), quality], names=["rest", "t", "quality"])

    return run


def _repeated_lines(lines: Lines, data: np.ndarray, l0: int, l1: int) -> int:
    if l1 - l0 < 2:
        return 0
    seen, n = set(), 0
    for a, b, words in zip(lines.starts[l0:l1].tolist(), lines.ends[l0:l1].tolist(), lines.n_words[l0:l1].tolist()):
        if words:
            line = data[a:b].tobytes()
            n += line in seen
            seen.add(line)
    return n


def _repeated_words(hashes: np.ndarray, size: int = 3) -> int:
    """Words in windows of ``size`` words that the text has twice or more."""
    g = hashing.grams(hashes, size)
    if len(g) < 2:
        return 0
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    cover = np.zeros(len(hashes), bool)
    for i in range(size):
        cover[at + i] = True
    return int(cover.sum())


def line_quality(docs: DataFrame, field: Field | None, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """docs with a struct ``quality`` added: counts, labels of lines (a byte each), base_failed, kept.

    base_failed: under 50 words, or over half of the words in 3-word windows that recur in the text.
    kept: not base_failed, and at least ``min_share`` of the words on content lines. A null text is
    an empty one: no words, base_failed. Without a field (no labels) every line is content. Repeated
    rows get equal results; an empty table gives no rows; a column named quality is replaced.
    """
    bound_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c != "quality"]
    base = docs.select(column(text).cast("string").alias("t"), F.struct(F.lit(1).alias("__one"), *(column(c) for c in cols if c != text)).alias("rest"))
    out = base.mapInArrow(_judge(field), T.StructType([base.schema["rest"], T.StructField("t", T.StringType()), T.StructField("quality", QUALITY)]))
    failed = (F.col("quality.n_words") < 50) | (100 * F.col("quality.n_repeat_words") > 50 * F.col("quality.n_words"))
    verdict = F.col("quality").withField("base_failed", failed).withField("kept", ~failed & (F.col("quality.content_share") >= min_share))
    return out.select(*((F.col("t") if c == text else F.col("rest").getField(c)).alias(c) for c in cols), verdict.alias("quality"))
