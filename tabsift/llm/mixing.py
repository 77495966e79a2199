"""Mixing sources to target weights with soft membership.

A classifier of the labelled documents gives every document a posterior over
domains: ``good``, ``toxic`` and ``poor``, from the columns quality and toxic.
A document of t words at rate r then adds r * t * p[k] expected words to domain k.
Rates are found by projected gradient on the squared distance between these
totals and the targets, starting from 1 and kept at 0 or above. A pass over a
table returns one number per domain, from which the next gradient follows; a
document's rate is a function of its posterior and the gradients so far, so no
rate is ever stored, shuffled or sent until the last one. Steps are measured in
words, which makes them alike for short and long documents, and are accelerated
by Nesterov's momentum. They run over cells, not documents: posteriors that agree
to 1 / CELLS are one row, with their words and their mean, so that all steps
together read some 33 thousand rows at most, however many documents there are.
What this leaves is closed over the documents themselves, whose totals decide
whether the targets are met: where they aren't, Newton steps in the dual finish.
Of the rates that meet the targets, those nearest to the rates so far are these
less p @ shift, kept at 0 or above, and shift has one number per domain. A small
weight on the distance (WEIGHT) makes this a least-squares solution where targets
are out of reach, which is warned of.

The classifier is softmax regression on hashed words and a few binned measures
of form. Of the words it has those that tell domains apart, by a likelihood ratio
of EVIDENCE at least, so that a few telling words count whatever the length of the
texts that have them. It is fitted on the driver on LABEL_ROWS labelled documents at most,
taken in the order of a hash of their id; a fifth of them isn't fitted but sets
the temperature that makes posteriors calibrated. Totals, rates and everything
else are over all documents.

Defined results:
* labels that are null are not used, several labels of one id are all used, and
  rows that repeat an id carry its label each;
* without any usable label posteriors are uniform;
* null, empty and word-less texts have 0 words: they have a posterior and a rate
  by form alone, and add to no total;
* targets needn't add up to 1, they are scaled; a target that no document can
  supply is met as closely as least squares goes;
* every row has a rate of its own: equal texts have equal rates;
* ``most`` bounds all rates, by default not at all: with it few documents can't
  stand for many, and the targets are met as closely as least squares goes then.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.llm import kernels as K
from tabsift.llm.common import col, free_name, key_type, stash

DOMAINS = ("good", "toxic", "poor")
TARGETS = {"good": 0.90, "toxic": 0.02, "poor": 0.08}
LABEL_ROWS, HASHED, LEAST_ROWS, SEED = 8000, 1 << 18, 5, 5
CELLS, STEPS, TOLERANCE, FIT_STEPS, RIDGE = 256, 60, 5e-4, 150, 1e-4
#: Twice the log likelihood ratio of a word's documents by domain; chance gives 20 to one word in 20 thousand.
EVIDENCE = 20.0
#: Newton steps at most, the lengths tried in each pass, and the weight of the distance to the rates before.
NEWTON, LENGTHS, WEIGHT = 40, 0.4 ** np.arange(24), 1e-8
_FORM = 6 * 16  # binned measures come after the hashed words
_BYTE = np.arange(256)
_SYMBOL = np.isin(_BYTE, [ord(c) for c in "#%&*$|!{}<>~^=_"]).astype(np.uint8)
_UPPER = ((_BYTE >= 65) & (_BYTE <= 90)).astype(np.uint8)
_DIGIT = ((_BYTE >= 48) & (_BYTE <= 57)).astype(np.uint8)


def _per_row(mask: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each row are in the mask."""
    out = np.zeros(len(offs) - 1, np.int64)
    on = np.flatnonzero(np.diff(offs) > 0)
    if len(on):
        out[on] = np.add.reduceat(mask[data], offs[:-1][on], dtype=np.int64)
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by row, distinct feature numbers of each row, words of each row)."""
    raw, at = K.buffers(texts)
    data, offs = K.buffers(K.lower(texts))
    n = len(offs) - 1
    h, row = K.tokens(data, offs)
    words = np.bincount(row, minlength=n)
    key = np.unique((row.astype(K.U64) << K.U64(32)) | (h % K.U64(HASHED)))
    row_of = (key >> K.U64(32)).astype(np.int64)
    distinct = np.bincount(row_of, minlength=n)
    size = np.maximum(np.diff(at), 1)
    share = lambda x, of: np.minimum((16 * x / np.maximum(of, 1)).astype(np.int64), 15)
    form = [share(_per_row(_SYMBOL, raw, at) * 4, size), share(_per_row(_UPPER, raw, at) * 2, size), share(_per_row(_DIGIT, raw, at) * 4, size), share(distinct, words), np.minimum(np.log2(words + 1).astype(np.int64), 15), np.minimum(size // np.maximum(words, 1), 15)]
    extra = np.concatenate([(np.arange(n).astype(K.U64) << K.U64(32)) | (HASHED + 16 * k + f).astype(K.U64) for k, f in enumerate(form)]) if n else np.zeros(0, K.U64)
    key = np.sort(np.concatenate((key, extra)))
    return K.groups((key >> K.U64(32)).astype(np.int64), n), (key & K.U64(0xFFFFFFFF)).astype(np.int64), words


@dataclass(frozen=True)
class Classifier:
    """Weights by feature and domain; features without a weight aren't listed."""

    which: np.ndarray
    weight: np.ndarray  # len(which) x domains
    bias: np.ndarray
    temperature: float

    def posterior(self, offs: np.ndarray, number: np.ndarray) -> np.ndarray:
        z = np.tile(self.bias, (len(offs) - 1, 1))
        if len(self.which) and len(number):
            at = np.minimum(np.searchsorted(self.which, number), len(self.which) - 1)
            ok = self.which[at] == number
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[ok]
            for k in range(z.shape[1]):
                z[:, k] += np.bincount(row, self.weight[at[ok], k], len(z))
        return _softmax(z / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def telling(rows: list[np.ndarray], label: np.ndarray, domains: int) -> np.ndarray:
    """The features to fit: measures of form, and words whose documents' domains differ from all documents' by EVIDENCE."""
    which, at = np.unique(np.concatenate(rows or [np.zeros(0, np.int64)]), return_inverse=True)
    y = np.repeat(label, [len(r) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    n, ratio = np.bincount(at, minlength=len(which)), np.zeros(len(which))
    for k in range(domains):
        seen, expected = np.bincount(at, y == k, len(which)), n * (label == k).mean() if len(rows) else n
        ratio += 2 * seen * np.log(np.maximum(seen, 1) / np.where(expected > 0, expected, 1))
    return which[(n >= LEAST_ROWS) & ((ratio >= EVIDENCE) | (which >= HASHED))]


def fit(rows: list[np.ndarray], label: np.ndarray, domains: int = len(DOMAINS)) -> Classifier:
    """Softmax regression by Adam over all given rows, with a fifth of them held out for the temperature."""
    if not len(rows):
        return Classifier(np.zeros(0, np.int64), np.zeros((0, domains)), np.zeros(domains), 1.0)
    held = np.arange(len(rows)) % 5 == 4
    which = telling([r for r, h in zip(rows, held) if not h], label[~held], domains)

    def sparse(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.concatenate([rows[i] for i in some] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
        at = np.minimum(np.searchsorted(which, number), max(len(which) - 1, 0))
        ok = which[at] == number if len(which) else np.zeros(len(number), bool)
        return row[ok], at[ok]

    def logits(row: np.ndarray, at: np.ndarray, n: int, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, w[at, k], n) + b[k] for k in range(domains)], 1)

    train, test = np.flatnonzero(~held), np.flatnonzero(held)
    row, at = sparse(train)
    y = np.eye(domains)[label[train]]
    x = np.zeros((len(which) + 1, domains))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, FIT_STEPS + 1):
        err = (_softmax(logits(row, at, len(train), x[:-1], x[-1])) - y) / len(train)
        g = np.vstack([np.stack([np.bincount(at, err[row, k], len(which)) for k in range(domains)], 1) + RIDGE * x[:-1], err.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    temperature = 1.0
    if len(test):
        z = logits(*sparse(test), len(test), x[:-1], x[-1])
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(test)), label[test]], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.25, 16, 61), key=loss))
    return Classifier(which, x[:-1], x[-1], temperature)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offs, number, _ = features(b.column(0))
        yield pa.RecordBatch.from_arrays([K.list_array(number.astype(np.int32), offs), b.column(1)], ["x", "y"])


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit(1)).when(quality == 0, F.lit(2)).when((quality == 1) & (toxic == 0), F.lit(0))


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABEL_ROWS) -> Classifier:
    """Fit on the labelled documents with the ``rows`` least hashes of their id, at most."""
    few = labels.select(F.col("doc_id").alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    few = few.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    # broadcast: the limit above bounds it to some 100 kB
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id").withColumn("h", F.xxhash64("id", "text"))
    got = texts.orderBy("h", "y").limit(rows).select("text", "y").mapInArrow(_featured, "x array<int>, y int").toArrow()
    return fit([x.astype(np.int64) for x in got.column("x").to_numpy()], got.column("y").to_numpy())


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, p) of every row, p being the posteriors in the order of DOMAINS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                offs, number, words = features(part.column(1))
                p = model.posterior(offs, number)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), K.list_array(p.reshape(-1), np.arange(len(p) + 1) * p.shape[1])], ["doc_id", "n_words", "p"])

    picked = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {key_type(picked, 'doc_id')}, n_words bigint, p array<double>")


def _momentum(k: int) -> float:
    return k / (k + 3)


def rates(p: np.ndarray, gradients: list[np.ndarray], step: float, ahead: bool = False, most: float = math.inf) -> np.ndarray:
    """Rates after the given gradients; ``ahead``: where the next gradient is to be taken."""
    r = before = y = np.ones(len(p))
    for k, g in enumerate(gradients):
        before, r = r, np.clip(y - step * (p @ g), 0.0, most)
        y = np.clip(r + _momentum(k) * (r - before), 0.0, most)
    return y if ahead else r


@dataclass(frozen=True)
class Mix:
    """What the rates follow from, and how close they come: totals are shares of all words at rate 1."""

    gradients: list[np.ndarray]
    step: float
    targets: np.ndarray
    totals: np.ndarray
    shift: np.ndarray | None = None
    most: float = math.inf

    def rate(self, p: np.ndarray) -> np.ndarray:
        r = rates(p, self.gradients, self.step, most=self.most)
        return r if self.shift is None else np.clip(r - p @ self.shift, 0.0, self.most)

    @property
    def miss(self) -> float:
        return float(np.abs(self.totals - self.targets).max())


def _sums(members: DataFrame, of: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """of(p) is an array of len(p) x n; returns its sum over all rows, weighted by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in batches:
            if b.num_rows:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total += b.column(0).to_numpy().astype(float) @ of(p)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{k}" for k in range(n)])

    parts = members.select("n_words", "p").mapInArrow(run, ", ".join(f"s{k} double" for k in range(n)))
    row = parts.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(n)]).first()
    return np.array(list(row), float)


def cells(members: DataFrame) -> DataFrame:
    """(n_words, p) of memberships that agree to 1 / CELLS: words and first moments are as before."""
    p = [F.col("p")[k] for k in range(len(DOMAINS))]
    at = [F.round(x * CELLS).cast("int").alias(f"k{i}") for i, x in enumerate(p[1:])]
    sums = [F.sum(F.col("n_words") * x).alias(f"s{i}") for i, x in enumerate(p)]
    sides = members.filter("n_words > 0").groupBy(*at).agg(F.sum("n_words").alias("n_words"), *sums)
    return stash(sides.select("n_words", F.array(*[F.col(f"s{i}") / F.col("n_words") for i in range(len(p))]).alias("p")))


def solve(members: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS, tolerance: float = TOLERANCE, most: float = math.inf) -> Mix:
    """Fit the rates, ``most`` at most, to a table of memberships(). Warns if the targets aren't met."""
    if not most > 0:
        raise ValueError("the greatest rate must be above 0")
    want = np.array([max(targets.get(d, 0.0), 0.0) for d in DOMAINS])
    if not want.sum() > 0:
        raise ValueError("a target must be above 0")
    want /= want.sum()
    k = len(DOMAINS)
    few = cells(members)
    gram = _sums(few, lambda p: np.einsum("ni,nj->nij", p, p).reshape(len(p), -1), k * k).reshape(k, k)
    words = gram.sum()  # posteriors add up to 1
    if not words > 0:
        return Mix([], 0.0, want, np.zeros(k), most=most)
    step = 1 / float(np.linalg.eigvalsh(gram / words).max())
    gradients: list[np.ndarray] = []
    while True:
        now = list(gradients)
        both = _sums(few, lambda p: np.hstack([p * rates(p, now, step, ahead, most)[:, None] for ahead in (False, True)]), 2 * k) / words
        if np.abs(both[:k] - want).max() <= tolerance / 2 or len(gradients) == steps:
            break
        gradients.append(both[k:] - want)
    totals = _sums(members, lambda p: p * rates(p, now, step, most=most)[:, None], k) / words
    mix = Mix(gradients, step, want, totals, most=most)
    if mix.miss > tolerance:
        mix = _finish(members, mix, words, tolerance)
    if mix.miss > tolerance:
        warnings.warn(f"mixing reaches {dict(zip(DOMAINS, mix.totals.round(4).tolist()))} for targets {dict(zip(DOMAINS, want.round(4).tolist()))}", RuntimeWarning, stacklevel=2)
    return mix


def _finish(members: DataFrame, mix: Mix, words: float, tolerance: float) -> Mix:
    """Newton steps on the convex dual sum(w * (r * z - r * r / 2)) + x @ targets + WEIGHT/2 * x @ x with z the rates so far less p @ x, and r these kept from 0 to the greatest, from x = 0."""
    k = len(mix.targets)

    def moments(p: np.ndarray, tried: list[np.ndarray]) -> np.ndarray:
        r0, out = rates(p, mix.gradients, mix.step, most=mix.most), []
        for x in tried:
            z = r0 - p @ x
            r = np.clip(z, 0.0, mix.most)
            out += [(2 * r * z - r * r)[:, None], p * r[:, None], np.einsum("ni,nj->nij", p, p * ((z > 0) & (z < mix.most))[:, None]).reshape(len(p), -1)]
        return np.hstack(out)

    def at(tried: list[np.ndarray]) -> list[tuple]:
        sums = _sums(members, lambda p: moments(p, tried), len(tried) * (1 + k + k * k)).reshape(len(tried), -1) / words
        return [(s[0] / 2 + x @ mix.targets + WEIGHT / 2 * x @ x, x, s[1 : 1 + k], s[1 + k :].reshape(k, k)) for x, s in zip(tried, sums)]

    value, x, totals, gram = at([np.zeros(k)])[0]
    for _ in range(NEWTON):
        slope = mix.targets - totals + WEIGHT * x
        if np.abs(totals - mix.targets).max() <= tolerance / 10 or np.abs(slope).max() <= tolerance / 10:
            break
        move = np.linalg.solve(gram + WEIGHT * np.eye(k), slope)
        best = min(at([x - length * move for length in LENGTHS]), key=lambda t: t[0])
        if not best[0] < value - 1e-13 * abs(value):
            break
        value, x, totals, gram = best
    return Mix(mix.gradients, mix.step, mix.targets, totals, x, mix.most)


def fit_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", most: float = math.inf) -> tuple[DataFrame, Classifier, Mix]:
    """(memberships, classifier, mix) of a table."""
    model = fit_labels(docs, labels, id_col, text_col)
    members = stash(memberships(docs, model, id_col, text_col))
    return members, model, solve(members, targets, most=most)


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", most: float = math.inf) -> DataFrame:
    """(doc_id, n_words, p_good, p_toxic, p_poor, rate) of every row."""
    members, _, mix = fit_mix(docs, labels, targets, id_col, text_col, most)

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(mix.rate(np.stack(p.to_list())) if len(p) else [], dtype=float)

    return members.select("doc_id", "n_words", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], rate("p").alias("rate"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", most: float = math.inf) -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says.

    A rate's whole part is taken so many times, and its fraction once more with
    that probability, drawn from a hash of id and text: the same rows every time.
    """
    _, model, mix = fit_mix(docs, labels, targets, id_col, text_col, most)

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(text), 1000):
            offs, number, _ = features(pa.array(text.iloc[i : i + 1000], pa.string(), from_pandas=True))
            out.append(mix.rate(model.posterior(offs, number)))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    # not deterministic only by name: Spark then computes it once, and not again for the filter
    rate = rate.asNondeterministic()
    copies, nth = free_name(docs, "__copies"), free_name(docs, "__nth")
    draw = F.pmod(F.xxhash64(F.lit(SEED), col(id_col), col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = docs.withColumn(copies, F.floor(rate(col(text_col).cast("string")) + draw).cast("int")).filter(col(copies) > 0)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), col(copies)))).drop(copies, nth)
