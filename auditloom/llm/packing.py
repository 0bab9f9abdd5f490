"""Order-preserving packing by dynamic programming.

The documents of a partition, in their order, form one stream of token ids.  The stream is cut into windows of at most ``window`` ids.  A
cut may fall behind a document (free), behind a sentence (a small penalty) or, inside a long run without either, at
regular places (a larger penalty).  With positions p and penalties c, the least cost that ends in a cut at p[j] is

    f(j) = min over i with p[j] - p[i] <= window of (f(i) + window - (p[j] - p[i])) + c[j]

whose minimum of f(i) + p[i] over a sliding range is kept in a monotone queue: linear time.  A stream is solved in stretches of
``STRETCH`` windows; the last window of a stretch is not cut but carried into the next, so only the end of a
partition has a short window, and memory does not grow with the partition.

Defined cases: a null or empty text is one end id; a document longer than a window is cut into several pieces; equal
documents are packed each by itself; an empty table yields no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from auditloom.llm.bpe import WHITE, byte_letters
from auditloom.llm.support import text_or_empty

STRETCH = 256
CACHE = 150_000  # entries of a generation of the cache
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingRules:
    window: int = 4096
    end_id: int = 2
    sentence_penalty: int = 6
    inside_penalty: int = 48
    inside_step: int = 64  # places to cut inside a run of over twice as many ids without a sentence end


def cuts(positions: list[int], penalties: list[int], window: int) -> list[int]:
    """Indices into ``positions`` of the cheapest cuts, first and last included; gaps are at most ``window``."""
    n = len(positions)
    back = [0] * n
    keys = [0] * n  # f(i) + p[i]
    queue = deque([0])
    append, pop, popleft = queue.append, queue.pop, queue.popleft
    for j in range(1, n):
        p = positions[j]
        least = p - window
        while positions[queue[0]] < least:
            popleft()
        i = queue[0]
        back[j] = i
        key = keys[j] = keys[i] + window + penalties[j]
        while queue and keys[queue[-1]] > key:
            pop()
        append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Stream:
    """Documents waiting to be cut, in order; ``first`` ids of the first one are already out."""

    def __init__(self, rules: PackingRules, sequence: int):
        self.rules, self.sequence = rules, sequence
        self.docs: list[tuple[int, bytes, list[int]]] = []
        self.first = 0
        self.waiting = 0

    def add(self, doc_id: int, packed: bytes, ends: list[int]) -> None:
        self.docs.append((doc_id, packed, ends))
        self.waiting += len(packed) // 4

    def _positions(self) -> tuple[list[int], list[int], list[int]]:
        """Places to cut, their penalties, and the stream position at which each document begins."""
        r, places, costs, begins = self.rules, [0], [0], []
        origin = -self.first
        for _, packed, ends in self.docs:
            begins.append(origin)
            size = len(packed) // 4
            for end in [*ends, size]:
                at = origin + end
                if at <= places[-1]:
                    continue
                if at - places[-1] > 2 * r.inside_step:
                    more = range(places[-1] + r.inside_step, at, r.inside_step)
                    places += more
                    costs += [r.inside_penalty] * len(more)
                places.append(at)
                costs.append(r.sentence_penalty)
            if costs[-1]:
                costs[-1] = 0
            origin += size
        return places, costs, begins

    def solve(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled; all of them if ``last``."""
        if not self.docs:
            return []
        places, costs, begins = self._positions()
        chosen = [places[i] for i in cuts(places, costs, self.rules.window)]
        if not last:
            chosen = chosen[:-1]
        rows = []
        for a, b in zip(chosen, chosen[1:], strict=False):
            k = bisect_right(begins, a) - 1
            at = a
            while at < b:
                doc_id, packed, _ = self.docs[k]
                size = len(packed) // 4
                start = at - begins[k]
                length = min(size - start, b - at)
                rows.append((doc_id, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), size, self.sequence, at - a))
                at += length
                k += 1
            self.sequence += 1
        end = chosen[-1]
        k = bisect_right(begins, end) - 1
        self.waiting = 0 if last else places[-1] - end
        self.first = end - begins[k]
        self.docs = [] if last else self.docs[k:]
        if self.docs and self.first == len(self.docs[0][1]) // 4:
            self.docs, self.first = self.docs[1:], 0
        return rows


class Encoder:
    """Ids of the tokenizers library, with a bounded cache.

    The vocabulary's pattern never crosses white space, so a text's ids are those of its runs without white space, and a run's are those of
    its pieces.  Texts are cut at special tokens and normalised, pieces are spelled, and the library's model gets many in one call; every
    piece ends in an id whose token ends a word, which tells the pieces' ids apart.
    The last id of a run that ends a sentence is kept with its top bit set.  The cache has two generations: a full one becomes the older one, whose
    entries move on when they are met again, so what is met often stays.
    """

    TOP = 1 << 31

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.model.no_padding()
        self.model.no_truncation()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.named = {t: f"TOKEN {i}" for t, i in special.items()}  # with a blank, as no run has
        self.own = {self.named[t]: np.array([i], dtype="<u4").tobytes() for t, i in special.items()}
        self.runs: dict[str, bytes] = dict(self.own)  # and pieces of letters, which are runs too
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}  # the other pieces
        self.split = regex.compile(f"[{WHITE}]+").split
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.ends = np.zeros(self.model.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True

    def _spell(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids."""
        letters = self.letters
        for k in range(0, len(pieces), 4000):
            part = pieces[k : k + 4000]
            spelled = [p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode()]) for p in part]
            ids = np.array(self.model.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            yield from zip(part, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)

    def _unknown(self, wanted: set[str]) -> list[str]:
        """The runs that neither generation has; those of the older one move on."""
        unknown, runs, older = [], self.runs, self.older
        for w in wanted.difference(runs):
            if (packed := older.get(w)) is None:
                unknown.append(w)
            else:
                runs[w] = packed
        return unknown

    def _learn(self, missing: list[str]) -> None:
        """Add runs to the cache."""
        runs, cut = self.runs, self.cut
        words = {w for w in missing if w.isalpha()}
        mixed = [(w, cut(w)) for w in missing if w not in words]
        pieces = set().union(*[ps for _, ps in mixed])
        letters = {p for p in pieces if p.isalpha()}
        if len(self.marks) > CACHE:
            self.marks.clear()
        runs.update(self._spell([*words, *self._unknown(letters - words)]))
        self.marks.update(self._spell(list((pieces - letters).difference(self.marks))))
        known = {p: runs[p] for p in letters} | {p: self.marks[p] for p in pieces - letters}
        get = known.__getitem__
        for w, ps in mixed:
            packed = b"".join(map(get, ps))
            if w[-1] in ".!?":
                packed = packed[:-1] + bytes((packed[-1] | 128,))
            runs[w] = packed

    def _runs(self, text: str) -> list[str]:
        """The text's runs without white space, normalised; a special token is a run by the name that the cache has for it."""
        if "<|" in text:
            return [w for part in self.specials.split(text) for w in ([self.named[part]] if part in self.named else self._runs_of_plain(part))]
        return self._runs_of_plain(text)

    def _runs_of_plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        return [w for w in self.split(text) if w] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
        """Packed ids of each text, and the numbers of ids before the end of each sentence."""
        runs = [self._runs(t) for t in texts]
        if len(self.runs) > CACHE:
            self.runs, self.older = dict(self.own), self.runs
        self._learn(self._unknown(set().union(*runs)))
        get = self.runs.__getitem__
        for run in runs:
            ids = np.frombuffer(b"".join(map(get, run)), dtype="<u4")
            ends = (np.flatnonzero(ids & np.uint32(self.TOP)) + 1).tolist()
            yield (ids & np.uint32(self.TOP - 1)).tobytes(), ends


_loaded: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """The encoder of a vocabulary file, once for each worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pack(docs: DataFrame, path: str, rules: PackingRules = PackingRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document that lies in one sequence."""
    source = docs.select(docs[id_col].alias("doc_id"), text_or_empty(text).alias("__text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    end = np.array([rules.end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        stream = Stream(rules, TaskContext.get().partitionId() << 36)

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc_id, (packed, ends) in zip(ids, encoder.encode(texts), strict=True):
                    stream.add(doc_id, packed + end, ends)
                    if stream.waiting > STRETCH * rules.window:
                        yield from out(stream.solve(last=False))
        encoder.older = {}  # the worker may go on to other work
        yield from out(stream.solve(last=True))

    return source.mapInArrow(run, SCHEMA)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
