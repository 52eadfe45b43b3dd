"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features are binary (shape of the line and of its two
neighbours: symbols, separators, capitals, repeated words, length); a transition weight ties
neighbouring lines together. Training lines first carry their document's label; lines that the
features alone clearly contradict are given the other one, and the field, transition included, is
fitted on labels that change within documents. A document's quality is the mean of its lines'
forward-backward marginals, weighted by their lengths, and mapped to a probability by a logistic
calibration on the training documents.

The model is fitted on a bounded sample: at most `sample` labelled documents, of whose chains of up to
CHUNK lines at most `chains` come to the driver; either are those first in a hashed order. Every
line of the documents can be drawn, and calibration reads them whole. The inputs are lines only:
no id, language, source or label.

Defined results: a null text counts as empty; a text without a word is one empty line; very long
texts are scored whole; every score lies between 0 and 1; repeated rows are scored each by itself,
and count in the fit as often as they occur; without labels, or with one label only, every text has
the same score; an empty table gives an empty one; an existing column of the score's name is
replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces, utf8

CHUNK = 48  # lines of a text that are trained on together; longer texts give several chains
SAMPLE = 6000  # labelled documents that the model is fitted on at most
CHAINS = 12_000  # chains of their lines that the weights are fitted on at most
SURE = 0.95  # from here on a line's own features outweigh its document's label


def _byte_classes() -> np.ndarray:
    """A row of 0/1 flags for every byte value."""
    b = np.arange(256)
    isin = lambda s: np.isin(b, list(s.encode()))
    upper = (b >= 65) & (b <= 90)
    lower = (b >= 97) & (b <= 122) | (b >= 0xC3)
    return np.stack([upper, lower, (b >= 48) & (b <= 57), isin("#*$%&<>~^=@\\{}[]_"), isin("|"), isin("!?"), isin(".,;:"), isin(" \t\v\f\r"), (b & 0xC0) != 0x80], axis=1).astype(np.int32)


_CLASSES = _byte_classes()


def _repetition(line: bytes) -> tuple[float, float]:
    """The shares of distinct words, and of words that already occur among the four before them.

    The second is counted where a quarter of the words or more aren't distinct.
    """
    found = line.split()
    if len(found) < 6:
        return 1.0, 0.0
    distinct = len(set(found)) / len(found)
    if distinct > 0.75:
        return distinct, 0.0
    return distinct, sum(found[k] in found[max(0, k - 4) : k] for k in range(1, len(found))) / (len(found) - 1)


BINS = (
    ("upper share", (0.15, 0.4, 0.7)),
    ("digit share", (0.1, 0.3)),
    ("symbol share", (0.02, 0.08, 0.2)),
    ("separators to words", (0.02, 0.2, 0.5)),
    ("marks to words", (0.05, 0.25, 0.6)),
    ("commas and stops to words", (0.02, 0.3, 0.8)),
    ("mean word length", (3.0, 6.5, 9.0, 14.0)),
    ("length", (20, 80, 300)),
    ("near repeats", (0.1, 0.3, 0.6)),
    ("distinct words", (0.3, 0.5, 0.75)),
    ("seen before", (0.5,)),
)
WIDTH = 1 + sum(len(edges) for _, edges in BINS)
OWN = 3 * WIDTH  # a line's own features, then those of the line before and after


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary features of every line with a word, its length, and the number of lines of each text."""
    lines, counts, seen = [], [], []
    for text in texts:
        own = [x for x in text.split(b"\n") if x and not x.isspace()] or [b""]
        met: set[bytes] = set()
        for x in own:
            seen.append(x in met)
            met.add(x)
        lines += own
        counts.append(len(own))
    ends = np.cumsum([len(x) for x in lines])
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    sums = np.zeros((len(data) + 1, _CLASSES.shape[1]), dtype=np.int32)
    np.cumsum(_CLASSES[data], axis=0, out=sums[1:])
    upper, lower, digit, symbol, bar, mark, stop, white, chars = (sums[ends] - sums[np.concatenate([[0], ends[:-1]])]).T
    solid, word = np.maximum(1, chars - white), white + 1.0
    repetition = np.array([_repetition(x) for x in lines])
    values = (
        upper / np.maximum(1, upper + lower),
        digit / solid,
        symbol / solid,
        bar / word,
        mark / word,
        stop / word,
        solid / word,
        chars,
        repetition[:, 1],
        repetition[:, 0],
        np.array(seen, dtype=float),
    )
    columns = [np.ones(len(lines), dtype=bool)] + [v >= e for v, (_, edges) in zip(values, BINS) for e in edges]
    own = np.stack(columns, axis=1)
    first = np.zeros(len(lines), dtype=bool)
    first[np.cumsum([0, *counts[:-1]])] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = False
    after[np.roll(first, -1)] = False
    return np.concatenate([own, before, after], axis=1), np.maximum(1, chars), np.array(counts)


def _marginals(odds: np.ndarray, stay: float, counts: np.ndarray) -> np.ndarray:
    """P(good) of every line: forward and backward passes in log odds over all chains at once.

    odds: each line's log odds of good by its own features; stay: log weight of an unchanged label.
    """
    starts = np.cumsum(np.concatenate([[0], counts[:-1]]))
    order = np.argsort(-counts, kind="stable")
    begin, length = starts[order], counts[order]
    cross = lambda x: np.logaddexp(x + stay, 0) - np.logaddexp(x, stay)  # noqa: E731  log odds passed to a neighbour
    ahead, behind = np.zeros(len(odds)), np.zeros(len(odds))
    for t in range(1, int(length[0]) if len(length) else 0):
        k = int(np.searchsorted(-length, -t, side="left"))  # chains with more than t lines
        at = begin[:k] + t
        ahead[at] = cross(ahead[at - 1] + odds[at - 1])
        back = begin[:k] + length[:k] - 1 - t
        behind[back] = cross(behind[back + 1] + odds[back + 1])
    return 1 / (1 + np.exp(-np.clip(odds + ahead + behind, -40, 40)))


def _log_z(odds: np.ndarray, stay: float, counts: np.ndarray) -> float:
    """The chains' summed log partition functions, with bad lines scoring 0."""
    starts = np.cumsum(np.concatenate([[0], counts[:-1]]))
    order = np.argsort(-counts, kind="stable")
    begin, length = starts[order], counts[order]
    good, bad = odds[begin].copy(), np.zeros(len(begin))
    for t in range(1, int(length[0])):
        k = int(np.searchsorted(-length, -t, side="left"))
        g, b, x = good[:k].copy(), bad[:k].copy(), odds[begin[:k] + t]
        good[:k] = np.logaddexp(g + stay, b) + x
        bad[:k] = np.logaddexp(g, b + stay)
    return float(np.logaddexp(good, bad).sum())


class LineCrf:
    """Weights of the field and of the calibration."""

    def __init__(self, weights: np.ndarray, stay: float, slope: float, bias: float) -> None:
        self.weights, self.stay, self.slope, self.bias = weights, stay, slope, bias

    @classmethod
    def fit(cls, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> LineCrf:
        """Fit on chains of counts[i] lines each, of documents labelled labels[i]; lines weigh weight[i] each.

        The calibration is left as it is.
        """
        if not len(labels) or labels.min() == labels.max():
            return cls(np.zeros(OWN), 0.0, 0.0, 4.0 if len(labels) and labels.min() == 1 else 0.0)
        x, given, each = features.astype(np.float32), np.repeat(labels, counts).astype(float), np.repeat(weight, counts)
        alone, _ = cls._descend(x, given, each, counts, np.zeros(OWN), 0.0, rounds, penalty, False)
        own = 1 / (1 + np.exp(-np.clip(x @ alone, -40, 40)))
        own = np.where(given == 1, own, 1 - own)  # of the label that the document gives
        y = np.where(own < 1 - SURE, 1 - given, given)
        weights, stay = cls._descend(x, y, each, counts, alone, cls._persistence(y, counts), rounds, penalty, True)
        return cls(weights, stay, 1.0, 0.0)

    @staticmethod
    def _persistence(y: np.ndarray, counts: np.ndarray) -> float:
        """Half the log odds that a line has the label of the line before it."""
        inner = np.ones(len(y), dtype=bool)
        inner[np.cumsum(counts) - 1] = False
        same = (y[1:] == y[:-1])[inner[:-1]]
        return float(np.clip(0.5 * np.log((same.sum() + 1) / ((~same).sum() + 1)), 0.0, 3.0))

    @staticmethod
    def _descend(x: np.ndarray, y: np.ndarray, each: np.ndarray, counts: np.ndarray, weights: np.ndarray, stay: float, rounds: int, penalty: float, chained: bool) -> tuple[np.ndarray, float]:
        """Weights, and the transition weight if lines are chained, by gradients of the likelihood of y."""
        inner = np.ones(len(y), dtype=bool)
        inner[np.cumsum(counts) - 1] = False
        same, pairs = float((y[1:] == y[:-1])[inner[:-1]].sum()), max(1, int(inner.sum()))
        velocity, size, total = np.zeros(OWN), np.full(OWN, 1e-8), each.sum()
        for t in range(rounds):
            odds = x @ weights
            error = (y - _marginals(odds, stay, counts)) * each
            gradient = x.T @ error / total - penalty * weights
            velocity = 0.9 * velocity + 0.1 * gradient
            size = 0.99 * size + 0.01 * gradient**2
            weights = weights + 0.15 * (velocity / (1 - 0.9 ** (t + 1))) / (np.sqrt(size / (1 - 0.99 ** (t + 1))) + 1e-6)
            if chained and t % 10 == 9:  # by the difference of observed and expected unchanged labels
                expected = (_log_z(odds, stay + 0.05, counts) - _log_z(odds, stay - 0.05, counts)) / 0.1
                stay = float(np.clip(stay + 2.0 * ((same - expected) / pairs - penalty * stay), 0.0, 5.0))
        return weights, stay

    def calibrate(self, means: np.ndarray, labels: np.ndarray) -> None:
        """Fit slope and bias of the logistic map from documents' means to labels, by Newton steps."""
        if not len(labels) or labels.min() == labels.max():
            return
        z = np.log(np.clip(means, 1e-4, 1 - 1e-4) / (1 - np.clip(means, 1e-4, 1 - 1e-4)))
        for _ in range(200):
            s = 1 / (1 + np.exp(-np.clip(self.slope * z + self.bias, -40, 40)))
            w = s * (1 - s) + 1e-4
            g = np.array([((labels - s) * z).sum() - 0.05 * self.slope, (labels - s).sum() - 0.05 * self.bias])
            h = np.array([[(w * z * z).sum() + 0.05, (w * z).sum()], [(w * z).sum(), w.sum() + 0.05]])
            step = np.linalg.solve(h, g)
            self.slope, self.bias = self.slope + 0.5 * step[0], self.bias + 0.5 * step[1]

    def _means(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = _marginals(features @ self.weights, self.stay, counts)
        starts = np.cumsum(np.concatenate([[0], counts[:-1]]))
        return np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)

    def means(self, texts: list[bytes]) -> np.ndarray:
        """The share of each text that is good, by its lines' marginals."""
        features, lengths, counts = line_features(texts)
        return self._means(features.astype(np.float32), lengths, counts)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability that each text is good."""
        mean = np.clip(self.means(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(mean / (1 - mean)) + self.bias, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chains: int = CHAINS, seed: int = 10) -> LineCrf:
    """Fit a model on docs (doc_id, text) with labels (doc_id, label 0 or 1).

    At most `sample` labels are used, those first in a hashed order; as that bounds them, they are
    broadcast, and no text moves. Features are computed on the executors; `chains` chains of lines
    and one mean a document are all that comes to the driver.
    """
    chosen = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [x or b"" for x in utf8(batch.column("text")).to_pylist()]
            features, _, counts = line_features(texts)
            at, out = 0, []
            for label, hashed, n in zip(batch.column("label").to_pylist(), batch.column("hash").to_pylist(), counts.tolist()):
                out += [(label, hashed, k, n, np.packbits(features[at + k : at + min(n, k + CHUNK)], axis=1).tobytes()) for k in range(0, n, CHUNK)]
                at += n
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["label", "hash", "at", "n", "features"])

    drawn = map_arrow(rows, cut, "label int, hash long, at int, n int, features binary").orderBy(F.xxhash64("hash", "at"), "hash", "at", "label", "features").limit(chains).collect()
    if not drawn:
        return LineCrf.fit(np.zeros((0, OWN)), np.zeros(0, int), np.zeros(0), np.zeros(0))
    width = (OWN + 7) // 8
    packed = np.frombuffer(b"".join(r.features for r in drawn), dtype=np.uint8).reshape(-1, width)
    counts = np.array([len(r.features) // width for r in drawn])
    # Each document counts alike, however many lines it has.
    model = LineCrf.fit(np.unpackbits(packed, axis=1, count=OWN), counts, np.array([r.label for r in drawn], dtype=float), np.array([1 / r.n for r in drawn]))
    weights = (model.weights, model.stay, model.slope, model.bias)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineCrf(*weights)
        for batch in pieces(batches, "text", 1 << 20):
            means = own.means([x or b"" for x in utf8(batch.column("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("hash"), pa.array(means, pa.float64())], names=["label", "hash", "mean"])

    known = map_arrow(rows, measure, "label int, hash long, mean double").orderBy("hash", "label", "mean").limit(sample).collect()
    model.calibrate(np.array([r["mean"] for r in known]), np.array([r["label"] for r in known], dtype=float))
    return model


def score(docs: DataFrame, model: LineCrf, text: str = "text", into: str = "score") -> DataFrame:
    """Add each row's probability of being good; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != into]
    schema = docs.select(*kept).withColumn(into, F.lit(0.0)).schema
    weights = (model.weights, model.stay, model.slope, model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineCrf(*weights)
        for batch in pieces(batches, text, 1 << 20):
            scores = own.score([x or b"" for x in utf8(batch.column(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, into])

    return map_arrow(docs.select(*kept), run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
