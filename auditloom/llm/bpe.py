"""BPE encoding by backtracking over longest matches, and decoding through an offset table.

A word is encoded without replaying merges: an Aho-Corasick automaton over the reversed roles of the vocabulary gives the
longest token at a position, and a token may follow another only if the pair is compatible, that is, if merging
the two tokens' own texts side by side leaves the border uncrossed.  Where the longest token leads nowhere, the next
shorter prefix token is tried, and at the last the step before is undone; each position is abandoned at most once, so a word
takes linear time.  Decoding gathers token strings from one blob by an offset table.

Text is prepared as the vocabulary file says: special tokens are cut out first, then NFC, white space to blanks, lower case
code point by code point, the split pattern, and bytes spelled as visible characters.

Defined cases: null or empty text has no ids and decodes to the empty string; equal texts give equal rows; other columns pass by.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditloom.llm.support import text_or_empty

CACHE = 500_000  # entries; each cache is emptied when full, so a worker's memory is bounded
WHITE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The visible character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class WordBpe:
    """A tokenizer read from a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", WHITE) if r"[^\s" in pattern else pattern).findall
        self.blanks = regex.compile(f"[{WHITE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        # A word is spelled with its last letter and the suffix as one symbol, so symbols are strings.
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int]] = {}
        for order, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = self.vocab[left], self.vocab[right]
            whole = self.vocab[left + right]
            self.rank[pair] = order, whole
            self.made.setdefault(whole, pair)
        strings = dict(self.vocab) | self.special
        self.strings = [""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            self.strings[i] = s
        blob = [s.encode() + b" " for s in self.strings]  # without a decoder, tokens are joined by blanks
        self.blob = np.frombuffer(b"".join(blob), dtype=np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(b) for b in blob]))).astype(np.int64)
        self._automaton()
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, bytes] = {}

    # -- longest matches ------------------------------------------------------------------------------------------
    def _automaton(self) -> None:
        """Match tokens in a word written backwards, so that a match ends where its token begins.

        The end of a word is written as one extra mark, which stands for the suffix."""
        self.mark = "\ue000"
        self.ac = ahocorasick.Automaton()
        self.text_of: dict[int, str] = {}
        for s, i in self.vocab.items():
            own = s[: -len(self.suffix)] + self.mark if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix) else s
            self.text_of[i] = own
            self.ac.add_word(own[::-1], (i, len(own)))
        self.ac.make_automaton()
        longest = {own: i for i, own in self.text_of.items()}
        #: the longest token that is a proper prefix of a token; none where the rest of the token would be the mark alone
        self.shorter: dict[int, int] = {}
        for i, own in self.text_of.items():
            for k in range(len(own) - 1, 0, -1):
                if own[:k] in longest and own[k:] != self.mark:
                    self.shorter[i] = longest[own[:k]]
                    break

    def longest_at(self, word: str) -> list[int]:
        """For each position of ``word``, the longest token that begins there (-1: none)."""
        n = len(word)
        best, size = [-1] * n, [0] * n
        last = n - 1  # the mark's place
        for end, (i, length) in self.ac.iter(word[::-1]):
            at = n - 1 - end
            if length > size[at] and at + length != last:  # no token may leave the mark alone
                best[at], size[at] = i, length
        return best

    # -- pairs ------------------------------------------------------------------------------------------------------
    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' texts side by side ends in just these two tokens."""
        found = self.pair_ok.get((left, right))
        if found is None:
            if len(self.pair_ok) >= CACHE:
                self.pair_ok.clear()
            found = self.pair_ok[left, right] = self._border_holds(left, right)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' last merges, again and again, and look for an earlier merge over the border."""
        rank, made = self.rank, self.made
        limit = 1 << 60
        while True:
            crossing = rank.get((left, right))
            if crossing is not None and crossing[0] < limit:
                return False
            of_left, of_right = made.get(left), made.get(right)
            left_rank = rank[of_left][0] if of_left else -1
            right_rank = rank[of_right][0] if of_right else -1
            if left_rank < 0 and right_rank < 0:
                return True
            # Equal merges happen from the left, so a tie undoes the right one first.
            if left_rank > right_rank:
                limit, left = left_rank, of_left[1]
                # a crossing of the same rank would be at the right of the merge inside, so it loses
            else:
                limit, right = right_rank + 1, of_right[0]
                # a crossing of the same rank lies left of the merge inside, so it wins

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, spelled in byte letters and without the suffix."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            found = self.words[word] = self._backtrack(word + self.mark if self.suffix else word)
        return found

    def _backtrack(self, word: str) -> tuple[int, ...]:
        longest, n, text_of, last = self.longest_at(word), len(word), self.text_of, len(word) - 1
        dead = bytearray(n + 1)
        out: list[int] = []
        at = 0
        token = longest[0]
        while True:
            while token >= 0:
                end = at + len(text_of[token])
                if not dead[end] and end != last and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
            else:
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                dead[at] = 1
                gone = out.pop()
                at -= len(text_of[gone])
                token = self.shorter.get(gone, -1)

    # -- texts --------------------------------------------------------------------------------------------------------
    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        text = self.blanks.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        letters = self.letters
        for piece in self.pieces(text):
            ids += self.encode_word("".join([letters[b] for b in piece.encode()]))
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, as little-endian unsigned 32-bit numbers."""
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        ids: list[int] = []
        for part in self.cut.split(chunk):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._plain(part)
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(chunk) <= 200:
            self.chunks[chunk] = packed
        return packed

    def runs(self, text: str) -> list[bytes]:
        """The packed ids of each run without white space."""
        get, make = self.chunks.get, self._chunk
        # Four separators are white space to str.split() but ordinary characters to the pattern.
        parts = self.blanks.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return [get(p) or make(p) for p in parts]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.runs(text)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by blanks, gathered from the blob by the offset table."""
        if not len(ids):
            return ""
        begin = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.blob[where].tobytes()[:-1].decode()


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The tokenizer of a file, once for each worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """(id, ids array, decoded text) of each row."""
    source = docs.select(id_col, text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64)
                ids = [bpe.encode(t) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) if decoded else None for x in ids], pa.string())], names=[id_col, "ids", "decoded"]
                )

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, whole texts encoded and decoded again."""
    source = docs.select("doc_id", text_or_empty().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = [str(i) for i in range(len(bpe.strings))]
        for batch in batches:
            counts, shown, back = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                shown.append(hashlib.sha256(" ".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shown), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
