"""Scoring by a gated recurrent language model in numpy.

Words are counted over all training texts.  The commonest ``2 + shortlist`` tokens are the model's own; the others are one class, inside which a word has its
share of the smoothed counts, so every text has a proper probability.  As inputs, words outside the shortlist have a place by their hash, so they are context
for the next word.  The output softmax is factored: first the class (of equal numbers of tokens by
frequency), then the token in its class.

Training is data-parallel: each task runs truncated backpropagation over the training texts of its partition from the same start (over every
window of ``window`` consecutive steps, so each token has its gradient; the state runs through whole texts), and the tasks' weights are averaged by the
number of tokens.  Scoring runs every text from its first word to its end with the state carried across windows.

Texts are dealt to lanes that advance together, longest lanes first, so one step is one matrix product for all of them.

Counts of the commonest words, ``HEAD`` at most, go to the workers as a table; a histogram of the counts says from which count on they fit.  Rarer words are
joined through a shuffle on the word.

Defined cases: a null or empty text is one end token; equal texts get equal scores; rows that repeat an id are scored one by one; a null id counts as the empty text; without training texts all counts are zero and the
model is the start; an empty table yields no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.support import materialize, text_or_empty

HEAD = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "[\\x20\\x09-\\x0D]+"
END, RARE = 0, 1


@dataclass(frozen=True)
class LanguageRules:
    shortlist: int = 1022  # words with a place of their own; the end and the rare class come first
    classes: int = 32
    buckets: int = 2048  # places of other words as inputs, by hash
    state: int = 16
    window: int = 16
    lanes: int = 512
    chunk: int = 6_000_000  # tokens dealt to lanes at a time, 13 bytes each
    rate: float = 0.01
    smoothing: float = 0.1


def words_of(text: bytes) -> list[bytes]:
    """Runs without the six ASCII separators, A-Z in lower case; bytes know no other letters or separators."""
    return text.lower().split()


class Gru:
    """Weights, forward windows, gradients and updates.  All arrays are 32-bit."""

    NAMES = ("table", "gates", "cand", "of_class", "class_bias", "of_word", "word_bias")

    def __init__(self, rules: LanguageRules, counts: np.ndarray):
        """``counts`` of the shortlist, by place, give the output biases of the start."""
        r, rng = rules, np.random.default_rng(11)
        self.rules, h = rules, rules.state
        self.tokens = 2 + r.shortlist
        self.per = -(-self.tokens // r.classes)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.table, self.gates, self.cand = normal(self.tokens + r.buckets, 3 * h), normal(h, 2 * h), normal(h, h)
        self.of_class, self.of_word = normal(h, r.classes) * 0, normal(r.classes, h, self.per) * 0
        full = np.full(r.classes * self.per, 1e-9)
        full[: self.tokens] = counts[: self.tokens] + 1e-3
        full = full.reshape(r.classes, self.per)
        self.class_bias = np.log(full.sum(axis=1)).astype(np.float32)
        self.word_bias = np.log(full / full.sum(axis=1, keepdims=True)).astype(np.float32)
        self.moments: dict[str, list[np.ndarray]] = {}
        self.steps = 0

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            shape = getattr(self, n).shape
            size = int(np.prod(shape))
            setattr(self, n, flat[at : at + size].reshape(shape).astype(np.float32))
            at += size

    # -- forward -----------------------------------------------------------------------------------------------
    def run(self, state: np.ndarray, inputs: np.ndarray, keep: np.ndarray, trace: bool = False) -> tuple[np.ndarray, list]:
        """States after each step (steps, lanes, size); ``keep`` is 0 where a text begins."""
        h = self.rules.state
        out, traces = np.empty((*inputs.shape, h), dtype=np.float32), []
        given = self.table[inputs]
        for t in range(len(inputs)):
            before = state * keep[t][:, None]
            g = given[t]
            a = 0.5 * np.tanh(0.5 * (g[:, : 2 * h] + before @ self.gates)) + 0.5
            z, r = a[:, :h], a[:, h:]
            held = r * before
            n = np.tanh(g[:, 2 * h :] + held @ self.cand)
            state = n + z * (before - n)
            out[t] = state
            if trace:
                traces.append((before, z, r, held, n))
        return out, traces

    def _by_class(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """An order of the targets by class, their places in their classes in that order, and each class with its stretch."""
        of = targets // self.per
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.rules.classes + 1)).tolist()
        return order, (targets % self.per)[order], [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target."""
        logits = _bounded(states @ self.of_class + self.class_bias)
        out = logits[np.arange(len(targets)), targets // self.per] - _log_sum(logits)
        order, places, stretches = self._by_class(targets)
        states, found = states[order], np.empty(len(targets), dtype=out.dtype)
        for c, part in stretches:
            logits = _bounded(states[part] @ self.of_word[c] + self.word_bias[c])
            found[part] = logits[np.arange(len(logits)), places[part]] - _log_sum(logits)
        out[order] += found
        return out

    # -- training ------------------------------------------------------------------------------------------------
    def gradients(self, states: np.ndarray, traces: list, inputs: np.ndarray, keep: np.ndarray, targets: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of the live targets of a window (steps, lanes)."""
        h, grads = self.rules.state, {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        flat, wanted, weight = states.reshape(-1, h), targets.ravel(), live.ravel().astype(np.float32)
        weight = weight / max(weight.sum(), 1)
        soft = _softmax(_bounded(flat @ self.of_class + self.class_bias))
        soft[np.arange(len(flat)), wanted // self.per] -= 1
        soft *= weight[:, None]
        grads["of_class"], grads["class_bias"] = flat.T @ soft, soft.sum(axis=0)
        back = soft @ self.of_class.T
        order, places, stretches = self._by_class(wanted)
        sorted_states, sorted_weight, found = flat[order], weight[order][:, None], np.empty_like(back)
        for c, part in stretches:
            soft = _softmax(_bounded(sorted_states[part] @ self.of_word[c] + self.word_bias[c]))
            soft[np.arange(len(soft)), places[part]] -= 1
            soft *= sorted_weight[part]
            grads["of_word"][c], grads["word_bias"][c] = sorted_states[part].T @ soft, soft.sum(axis=0)
            np.matmul(soft, self.of_word[c].T, out=found[part])
        back[order] += found
        back = back.reshape(states.shape)
        carried, given = np.zeros_like(states[0]), np.empty((*inputs.shape, 3 * h), dtype=states.dtype)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, held, n = traces[t]
            d = back[t] + carried
            dn = d * (1 - z)
            dn *= 1 - n * n
            dheld = dn @ self.cand.T
            gate = given[t, :, : 2 * h]
            gate[:, :h] = d * (before - n) * z * (1 - z)
            gate[:, h:] = dheld * before * r * (1 - r)
            given[t, :, 2 * h :] = dn
            carried = (d * z + dheld * r + gate @ self.gates.T) * keep[t][:, None]
        each = given.reshape(-1, 3 * h)
        grads["gates"] = np.concatenate([x[0] for x in traces]).T @ each[:, : 2 * h]
        grads["cand"] = np.concatenate([x[3] for x in traces]).T @ each[:, 2 * h :]
        order = np.argsort(inputs.ravel(), kind="stable")
        ids = inputs.ravel()[order]
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        grads["table"][ids[starts]] = np.add.reduceat(given.reshape(-1, 3 * h)[order], starts, axis=0)
        return grads

    def update(self, grads: dict[str, np.ndarray]) -> None:
        """One step of Adam."""
        self.steps += 1
        scale = self.rules.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for n, g in grads.items():
            m, v = self.moments.setdefault(n, [np.zeros_like(g), np.zeros_like(g)])
            weights = getattr(self, n)
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            np.multiply(g, g, out=g)
            g *= 0.01
            v += g
            np.sqrt(v, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= weights.dtype.type(scale)
            weights -= g


def _bounded(logits: np.ndarray) -> np.ndarray:
    """Logits whose exponentials have no overflow."""
    return np.clip(logits, -60, 60, out=logits)


def _log_sum(logits: np.ndarray) -> np.ndarray:
    return np.log(np.exp(logits) @ np.ones(logits.shape[1], dtype=logits.dtype))


def _softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits)
    out /= (out @ np.ones(out.shape[1], dtype=out.dtype))[:, None]
    return out


# -- lanes -------------------------------------------------------------------------------------------------------------
@dataclass
class Lanes:
    """Texts side by side: ``inputs``, ``targets`` and ``owner`` are (steps, lanes); lane k has ``lengths[k]`` steps, longest first."""

    inputs: np.ndarray
    targets: np.ndarray
    keep: np.ndarray
    owner: np.ndarray
    lengths: np.ndarray

    def windows(self, size: int) -> Iterator[tuple[int, int, int]]:
        """(first step, last step, live lanes) of each window."""
        for a in range(0, len(self.inputs), size):
            yield a, min(a + size, len(self.inputs)), int(np.searchsorted(-self.lengths, -a, side="left"))


def deal(texts: list[np.ndarray], most: int, given: list[np.ndarray] | None = None) -> Lanes:
    """Deal texts (ids, the end last) to lanes of nearly equal length; ``given`` has their ids as inputs where those differ."""
    sizes = np.array([len(t) for t in texts])
    given = texts if given is None else given
    count = int(np.clip(sizes.sum() // max(sizes.max(), 1), 1, most))
    heap = [(0, k) for k in range(count)]
    lanes: list[list[int]] = [[] for _ in range(count)]
    for k in np.argsort(-sizes, kind="stable").tolist():
        length, lane = heapq.heappop(heap)
        lanes[lane].append(k)
        heapq.heappush(heap, (length + int(sizes[k]), lane))
    lengths = np.array([sum(int(sizes[k]) for k in lane) for lane in lanes])
    order = np.argsort(-lengths, kind="stable")
    shape = (int(lengths.max()), count)
    out = Lanes(np.zeros(shape, dtype=np.int16), np.zeros(shape, dtype=np.int16), np.ones(shape, dtype=bool), np.full(shape, -1, dtype=np.int32), lengths[order])
    for column, lane in enumerate(order.tolist()):
        at = 0
        for k in lanes[lane]:
            ids, end = texts[k], at + len(texts[k])
            out.targets[at:end, column], out.owner[at:end, column] = ids, k
            out.inputs[at + 1 : end, column] = given[k][:-1]
            out.inputs[at, column], out.keep[at, column] = END, 0
            at = end
    return out


def train_chunk(model: Gru, texts: list[np.ndarray], given: list[np.ndarray] | None = None) -> None:
    r, lanes = model.rules, deal(texts, model.rules.lanes, given)
    state = np.zeros((lanes.inputs.shape[1], r.state), dtype=np.float32)
    for a, b, live in lanes.windows(r.window):
        some = (slice(a, b), slice(0, live))
        states, traces = model.run(state[:live], lanes.inputs[some], lanes.keep[some], trace=True)
        real = lanes.owner[some] >= 0
        model.update(model.gradients(states, traces, lanes.inputs[some], lanes.keep[some], lanes.targets[some], real))
        state = states[-1]


def score_chunk(model: Gru, texts: list[np.ndarray], given: list[np.ndarray] | None = None, size: int = 32) -> np.ndarray:
    """log10 of the probability of each text under the model; rare words count as their class."""
    lanes, total = deal(texts, model.rules.lanes, given), np.zeros(len(texts))
    state = np.zeros((lanes.inputs.shape[1], model.rules.state), dtype=np.float32)
    for a, b, live in lanes.windows(size):
        some = (slice(a, b), slice(0, live))
        states, _ = model.run(state[:live], lanes.inputs[some], lanes.keep[some])
        owner = lanes.owner[some].ravel()
        real = owner >= 0
        found = model.log_likelihood(states.reshape(-1, model.rules.state)[real], lanes.targets[some].ravel()[real])
        total += np.bincount(owner[real], weights=found, minlength=len(texts))
        state = states[-1]
    return total / np.log(10)


# -- Spark ----------------------------------------------------------------------------------------------------------------
def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def _fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the training texts of ``docs`` (doc_id, text); materialised."""
    words = docs.where(_fold() != 0).select(F.explode(F.split(F.translate("text", UPPER, LOWER), SPACES)).alias("word")).where("word <> ''")
    return materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")


@dataclass
class Vocabulary:
    head: dict[str, int]  # counts of the commonest words, in order
    tokens: int  # in training, ends included
    distinct: int
    ends: int

    def shortlist(self, rules: LanguageRules) -> tuple[list[str], np.ndarray, float]:
        """The model's own words, counts by place, and the logarithm base 10 of the rare class's smoothed mass."""
        own = list(self.head)[: rules.shortlist]
        counts = np.array([self.ends, 0, *(self.head[w] for w in own)], dtype=np.float64)
        rare = self.tokens - counts.sum()
        counts[RARE] = rare
        smoothed = self.tokens + rules.smoothing * (self.distinct + 1)
        mass = smoothed - counts[END] - rules.smoothing - sum(self.head[w] + rules.smoothing for w in own)
        return own, np.concatenate((counts, np.zeros(rules.shortlist - len(own)))), float(np.log10(max(mass, rules.smoothing)))


def vocabulary(docs: DataFrame, counts: DataFrame) -> Vocabulary:
    ends = docs.where(_fold() != 0).count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)  # about a thousand steps hold any count
    least, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += r.words
        if held > HEAD:
            break
        least = r.step
    head = sorted(counts.where(step >= least).collect(), key=lambda r: (-r.n, r.word)) if least is not None else []  # HEAD words at most
    return Vocabulary({r.word: r.n for r in head}, total + ends, kinds + (ends > 0), ends)


class Ranks(dict):  # keyed by UTF-8 words
    """Places of words by frequency; of any other word, the number of words and the word's bucket."""

    buckets = 1

    def __missing__(self, word: bytes) -> int:
        return len(self) + zlib.crc32(word) % self.buckets


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc_id, text.as_buffer().to_pybytes()


def _ended(ids: np.ndarray) -> np.ndarray:
    return np.append(ids, END).astype(np.int16)


def fit(docs: DataFrame, vocab: Vocabulary, rules: LanguageRules = LanguageRules()) -> np.ndarray:
    """Weights averaged over the partitions of ``docs`` (doc_id, text)."""
    own, counts, _ = vocab.shortlist(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, held, texts, given = Gru(rules, counts), 0, 0, [], []
        ranks = Ranks((w.encode(), k) for k, w in enumerate(own))
        ranks.buckets, rank = rules.buckets, ranks.__getitem__
        # a place by rank: the shortlist's own, then unused ones where it is not full, then the buckets
        place = np.concatenate((np.arange(len(own)) + 2, np.arange(rules.buckets) + 2 + rules.shortlist))
        for doc_id, text in _rows(batches):
            if is_training(doc_id):
                words = words_of(text)
                at = np.fromiter(map(rank, words), dtype=np.int32, count=len(words))
                texts.append(_ended(np.where(at < len(own), at + 2, RARE)))
                given.append(_ended(place[at]))
                held += len(words) + 1
            if held >= rules.chunk:
                train_chunk(model, texts, given)
                texts, given, seen, held = [], [], seen + held, 0
        if texts:
            train_chunk(model, texts, given)
            seen += held
        if seen:
            flat = model.weights().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["k", "w", "seen"])

    found = docs.select("doc_id", "text").mapInArrow(run, "k int, w double, seen double").groupBy("k").agg((F.sum("w") / F.sum("seen")).alias("w")).toArrow().sort_by("k")
    return found.column("w").to_numpy() if found.num_rows else Gru(rules, counts).weights()


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: np.ndarray, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    own, start, rare_mass = vocab.shortlist(rules)
    smooth = rules.smoothing
    whole = float(np.log10(vocab.tokens + smooth * (vocab.distinct + 1))) if vocab.tokens else float(np.log10(smooth))
    shared = spark.sparkContext.broadcast((list(vocab.head), np.array(list(vocab.head.values()), dtype=np.int64), weights))  # HEAD words at most
    ends, n_own = vocab.ends, len(own)
    model_of: dict[str, tuple] = {}
    names = ["doc_id", "n_tokens", "n_head", "head_sum", "head_rare", "n_rare", "tail", "model"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "head" not in model_of:
            words, numbers, flat = shared.value
            model = Gru(rules, start)
            model.load(flat)
            ranks = Ranks((w.encode(), k) for k, w in enumerate(words))
            ranks.buckets = rules.buckets
            bucket = np.array([zlib.crc32(w.encode()) % rules.buckets for w in words[n_own:]], dtype=np.int64) + 2 + rules.shortlist
            place = np.concatenate((np.arange(n_own) + 2, bucket, np.arange(rules.buckets) + 2 + rules.shortlist))
            model_of["head"] = ranks, np.append(np.log10(numbers + smooth), 0.0), place, model
        ranks, logs, place, model = model_of["head"]
        rank, none = ranks.__getitem__, len(ranks)
        held, rows, texts, given = 0, [], [], []

        def done() -> pa.RecordBatch:
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(score_chunk(model, texts, given))], names=names)

        for doc_id, text in _rows(batches):
            words = words_of(text)
            at = np.fromiter(map(rank, words), dtype=np.int32, count=len(words))
            texts.append(_ended(np.where(at < n_own, at + 2, RARE)))
            given.append(_ended(place[at]))
            missing = np.flatnonzero(at >= none).tolist()
            log = logs[np.minimum(at, none)]
            rare = at >= n_own
            rows.append((doc_id, len(words) + 1, len(words) - len(missing), float(log.sum()), float(log[rare].sum()), int(rare.sum()), [words[k].decode() for k in missing]))
            held += len(words) + 1
            if held >= rules.chunk:
                yield done()
                held, rows, texts, given = 0, [], [], []
        if rows:
            yield done()

    first = docs.mapInArrow(run, "doc_id long, n_tokens long, n_head long, head_sum double, head_rare double, n_rare long, tail array<string>, model double")
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()), "head-scores")
    rest = first.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    rest = rest.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(smooth))).alias("tail_sum"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_tail")
    )
    end_log = float(np.log10(ends + smooth))
    tail_sum, n_tail = F.coalesce("tail_sum", F.lit(0.0)), F.coalesce("n_tail", F.lit(0))
    return first.drop("tail").join(rest, "row", "left").select(
        "doc_id", (_fold() == 0).alias("held_out"), "n_tokens", (F.col("n_head") + n_tail + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("head_sum") + tail_sum + end_log - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + F.col("head_rare") + tail_sum - F.col("n_rare") * rare_mass).alias("score"),
    )


def op6_gru_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    counts = count_words(docs)
    vocab = vocabulary(docs, counts)
    return score(docs, counts, vocab, fit(docs, vocab))
