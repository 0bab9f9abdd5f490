"""Toxicity by a classifier chain.

Linear models predict the categories in turn from hashed words and beginnings of words; each later model also sees the earlier categories'
probabilities, in training as out-of-fold predictions, so that it does not lean on probabilities an earlier model has learnt by heart.  Models are fitted
in numpy on the driver from a bounded sample of labelled rows (``sample_rows`` and ``sample_features``, drawn by a hash of the id); every
row of every table is scored, whole texts, on the executors.  The threshold of the last category is the one with the best
F1 score out of fold.

Defined cases: a null or empty text has no words, gets the chain's constant terms and is never toxic; rows without labels are scored like others; label rows
whose document is missing, or with a null label, are left out of training; of label rows that repeat an id the largest labels count; rows that repeat a document's id are trained on and scored one by one; without any labelled rows, or with one class only, the probability is the constant
rate; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import textscan
from auditloom.llm.support import materialize, text_or_empty

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True


@dataclass(frozen=True)
class ChainRules:
    bits: int = 18  # of the feature table
    prefixes: tuple[int, ...] = (2, 4, 6, 8)  # bytes; stems of longer words are features besides the words
    sample_rows: int = 10_000  # about so many labelled rows train the chain
    sample_features: int = 20_000_000  # and so many features at most, 8 bytes each on the driver
    folds: int = 4
    epochs: int = 6
    rate: float = 0.2
    l2: float = 1e-6
    batch: int = 64  # rows a step; fewer for few rows


@dataclass
class Rows:
    """Sparse rows: the features of row k are ``columns[offsets[k]:offsets[k + 1]]`` with their values."""

    offsets: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.values * weights[self.columns], dtype=np.float64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.offsets)[rows]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[:-1][rows] - (ends - sizes), sizes)
        return Rows(np.concatenate(([0], ends)), self.columns[where], self.values[where])


def features(group: textscan.Group, rules: ChainRules) -> Rows:
    """log(1 + count) of each text's hashed words and beginnings of words."""
    shift, found, doc = np.uint64(64 - rules.bits), [group.word_hashes(lower=True)], [group.doc]
    for k in rules.prefixes:
        long = np.flatnonzero(group.ends - group.starts > k)
        stems = textscan.Group(0, group.data, group.offsets, group.starts[long], group.starts[long] + k, group.doc[long])
        found.append(textscan.mix(stems.word_hashes(lower=True) + np.uint64(k)))
        doc.append(stems.doc)
    columns = (np.concatenate(found) >> shift).astype(np.int64)
    keys, counts = np.unique((np.concatenate(doc) << rules.bits) + columns, return_counts=True)
    sizes = np.bincount(keys >> rules.bits, minlength=group.size)
    return Rows(np.concatenate(([0], np.cumsum(sizes))), (keys & ((1 << rules.bits) - 1)).astype(np.int32), np.log1p(counts).astype(np.float32))


@dataclass
class Linear:
    """A logistic model over hashed words and the probabilities of earlier categories."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def probability(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows.dot(self.weights) + earlier @ self.earlier + self.constant, -30, 30)))


def fit(rows: Rows, earlier: np.ndarray, wanted: np.ndarray, rules: ChainRules) -> Linear:
    """Adagrad over shuffled batches, from a fixed seed."""
    size = 1 << rules.bits
    share = wanted.mean() if len(wanted) else 0.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Linear(np.zeros(size), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    if not len(wanted) or wanted.min() == wanted.max():
        return model
    squares, squares_e, square_c = np.full(size, 1e-2), np.full(earlier.shape[1], 1e-2), 1e-2
    rng = np.random.default_rng(0)
    batch = int(np.clip(rows.size // 100, 4, rules.batch))
    for _ in range(rules.epochs):
        order = rng.permutation(rows.size)
        for k in range(0, rows.size, batch):
            part = order[k : k + batch]
            some = rows.take(part)
            wrong = (model.probability(some, earlier[part]) - wanted[part]) / len(part) * 16
            touched, inverse = np.unique(some.columns, return_inverse=True)
            step = np.bincount(inverse, weights=some.values * np.repeat(wrong, np.diff(some.offsets)), minlength=len(touched)) + rules.l2 * model.weights[touched]
            squares[touched] += step**2
            model.weights[touched] -= rules.rate * step / np.sqrt(squares[touched])
            step = earlier[part].T @ wrong
            squares_e += step**2
            model.earlier -= rules.rate * step / np.sqrt(squares_e)
            square_c += wrong.sum() ** 2
            model.constant -= rules.rate * wrong.sum() / np.sqrt(square_c)
    return model


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    threshold: float

    def probabilities(self, rows: Rows) -> np.ndarray:
        """One column for each category, in the chain's order."""
        found = np.zeros((rows.size, 0))
        for model in self.models:
            found = np.column_stack((found, model.probability(rows, found)))
        return found


def best_threshold(found: np.ndarray, wanted: np.ndarray) -> float:
    """The probability that cuts with the best F1 score, halfway to the next one below."""
    if not wanted.any():
        return 1.0
    order = np.argsort(-found, kind="stable")
    hits = np.cumsum(wanted[order])
    score = 2 * hits / (np.arange(1, len(order) + 1) + wanted.sum())
    k = int(np.argmax(score))
    below = found[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((found[order[k]] + below) / 2)


def fit_chain(rows: Rows, labels: dict[str, np.ndarray], fold: np.ndarray, rules: ChainRules) -> Chain:
    models, earlier = [], np.zeros((rows.size, 0))
    threshold = 0.5
    for wanted in labels.values():
        outside = np.zeros(rows.size)
        for f in range(rules.folds):
            inside = np.flatnonzero(fold != f)
            rest = np.flatnonzero(fold == f)
            if len(rest):
                outside[rest] = fit(rows.take(inside), earlier[inside], wanted[inside], rules).probability(rows.take(rest), earlier[rest])
        models.append(fit(rows, earlier, wanted, rules))
        threshold = best_threshold(outside, wanted)
        earlier = np.column_stack((earlier, outside))
    return Chain(list(labels), models, threshold)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rules: ChainRules = ChainRules(), id_col: str = "doc_id", text: str = "text") -> Chain:
    """Fit a chain for ``categories`` (name: SQL over the label columns that is 1 or 0), in their order."""
    marks = [f"label_{k}" for k in range(len(categories))]
    given = labels.select(labels[id_col].alias("id"), *[F.expr(f"cast(({sql}) as double)").alias(m) for m, sql in zip(marks, categories.values(), strict=True)]).dropna()
    given = given.groupBy("id").agg(*[F.max(m).alias(m) for m in marks])
    total = given.count()
    chance = lambda *key: F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = materialize(given.where(chance("id") < rules.sample_rows / max(total, 1)), "labels")
    chosen = F.broadcast(chosen) if chosen.count() <= 2 * rules.sample_rows else chosen  # ids are different, so about sample_rows
    body = docs.select(docs[id_col].alias("own"), text_or_empty(text).alias("body"))
    source = body.join(chosen, F.col("own") == F.col("id")).select("id", *marks, "body")
    names = [*source.columns[:-1], "columns", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in textscan.groups(batch.column(batch.num_columns - 1), breaks=_BREAKS):
                rows = features(group, rules)
                offsets = pa.array(rows.offsets.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (rows.columns, rows.values)]
                part = batch.slice(group.first, group.size)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=names)

    schema = ", ".join([f"id {source.schema[0].dataType.simpleString()}", *[f"{m} double" for m in marks], "columns array<int>", "values array<float>"])
    table = materialize(source.mapInArrow(run, schema).withColumn("chance", chance("id", F.monotonically_increasing_id())), "features")
    share = 1.0
    while (size := table.where(F.col("chance") < share).agg(F.sum(F.size("columns"))).first()[0] or 0) > rules.sample_features:
        share *= 0.95 * rules.sample_features / size
    found = table.where(F.col("chance") < share).toArrow().combine_chunks().sort_by([("id", "ascending"), ("chance", "ascending")])
    listed = [found.column(c).combine_chunks() for c in ("columns", "values")]
    if found.num_rows:
        sizes = np.diff(listed[0].offsets.to_numpy())
        rows = Rows(np.concatenate(([0], np.cumsum(sizes))), listed[0].flatten().to_numpy(), listed[1].flatten().to_numpy())
    else:
        rows = Rows(np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32))
    fold = np.random.default_rng(1).permutation(found.num_rows) % rules.folds
    return fit_chain(rows, {c: found.column(m).to_numpy() for c, m in zip(categories, marks, strict=True)}, fold, rules)


def score(docs: DataFrame, chain: Chain, rules: ChainRules = ChainRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, p_<category>..., <last category>) of each row; the last column is the decision."""
    source = docs.select(docs[id_col], text_or_empty(text).alias(f"{id_col}_body"))
    names = [id_col, *[f"p_{c}" for c in chain.names], chain.names[-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in textscan.groups(batch.column(1), breaks=_BREAKS):
                rows = features(group, rules)
                found = chain.probabilities(rows)
                toxic = (found[:, -1] >= chain.threshold) & (np.diff(rows.offsets) > 0)
                ids = batch.column(0).slice(group.first, group.size)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in found.T), pa.array(toxic)], names=names)

    schema = ", ".join([f"`{id_col}` {source.schema[0].dataType.simpleString()}", *[f"`{c}` double" for c in names[1:-1]], f"`{names[-1]}` boolean"])
    return source.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels, {"low_quality": "1 - quality", "toxic": "toxic"}))
