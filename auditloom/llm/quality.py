"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken over every whole text in numpy; a text's coverage
for a length is the share of its word characters that lie in n-grams found twice or more, and for lines the
share of word characters in lines equal to an earlier line.

Defined cases: a null or empty text has no words, counts zero everywhere and fails the base rule (fewer than
``min_words`` words); equal rows are judged each by itself; rows that repeat an id stay rows of their own; other columns, whatever their names, pass
through untouched; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import textscan
from auditloom.llm.support import free_name, text_or_empty

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "line_coverage double, coverage_5 double, coverage_10 double, kept boolean"
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds: a text fails beyond any of them."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    coverage: tuple[tuple[int, float], ...] = ((5, 0.40), (10, 0.30))
    max_line_coverage: float = 0.30


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(values: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=size).astype(np.int64)


def measure(group: textscan.Group, rules: QualityRules) -> dict[str, np.ndarray]:
    """The measures of each text of a group."""
    size, doc, n_words = group.size, group.doc, group.words_per_text()
    lead = (group.data & 0xC0) != 0x80  # bytes that begin a code point
    points = np.concatenate(([0], np.cumsum(lead)))
    chars = points[group.ends] - points[group.starts]
    word_chars = _per_text(chars, doc, size)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[group.data])))
    n_symbols = symbols[group.offsets[1:]] - symbols[group.offsets[:-1]]
    hashes = group.word_hashes()

    def cover(n: int) -> np.ndarray:
        keys, at = textscan.ngrams(hashes, doc, n)
        return textscan.covered(at[textscan.repeated(keys, doc[at])], n, len(hashes))

    n_repeat = _per_text(cover(rules.repeat_window), doc, size)
    dup_lines, dup_chars = _lines(group, chars)
    whole = np.maximum(word_chars, 1)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "base_failed": (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words),
        "line_coverage": dup_chars / whole,
    }
    kept = ~out["base_failed"] & (out["line_coverage"] <= rules.max_line_coverage)
    for n, most in rules.coverage:
        out[f"coverage_{n}"] = _per_text(np.where(cover(n), chars, 0), doc, size) / whole
        kept &= out[f"coverage_{n}"] <= most
    return out | {"kept": kept}


def _lines(group: textscan.Group, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that hold a word and equal an earlier line, and the word characters in them."""
    size, data, offsets = group.size, group.data, group.offsets
    breaks = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate((offsets[:-1], breaks + 1))
    doc = np.concatenate((np.arange(size), doc_of))
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    ends[last] = offsets[1:][doc[last]]
    ups, downs = textscan.powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(textscan._BYTE[data] * ups[: len(data)], dtype=np.uint64)))
    keys = textscan.mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64))
    line_of = np.searchsorted(starts, group.starts, side="right") - 1
    has_word = np.zeros(len(starts), dtype=bool)
    has_word[line_of] = True
    copy = np.zeros(len(starts), dtype=bool)
    real = np.flatnonzero(has_word)
    copy[real] = textscan.later_copy(keys[real], doc[real])
    return np.bincount(doc[copy], minlength=size).astype(np.int64), _per_text(np.where(copy[line_of], chars, 0), group.doc, size)


def measures(docs: DataFrame, keep: list[str], rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The columns ``keep`` and the measures of each row's ``text``, one row for each row."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    source = docs.select(*keep, text_or_empty(text).alias("_".join(["body", *keep])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in textscan.groups(batch.column(batch.num_columns - 1)):
                found = measure(group, rules)
                rows = batch.slice(group.first, group.size)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array(found[n]) for n in names)], names=[*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), COLUMNS])
    return source.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    columns = docs.columns
    source = docs.withColumn(free_name(docs, "body"), text_or_empty(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in textscan.groups(batch.column(batch.num_columns - 1)):
                rows = batch.slice(group.first, group.size)
                rows = pa.RecordBatch.from_arrays(rows.columns[:-1], names=columns)
                yield rows.filter(pa.array(measure(group, rules)["kept"]))

    return source.mapInArrow(run, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measures(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("line_coverage", 6).alias("line_coverage"), F.round("coverage_5", 6).alias("coverage_5"), F.round("coverage_10", 6).alias("coverage_10"),
    )


#: Words are numbered through a text, and the starts of repeated runs looked for in a window before each word.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nth FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY nth) > 1 AS copy FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l) WHERE len(ws) > 0),
w AS (SELECT doc_id, nth, copy, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM r),
p AS (SELECT doc_id, copy, word, length(word) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY nth, k) AS i FROM w),
g AS (
  SELECT *, string_agg(word, ' ') OVER a AS g5, string_agg(word, ' ') OVER b AS g8, string_agg(word, ' ') OVER c AS g10, count(*) OVER (PARTITION BY doc_id) - i + 1 AS rest FROM p
  WINDOW a AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), c AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
),
s AS (
  SELECT doc_id, copy, chars, i, rest >= 5 AND count(*) OVER (PARTITION BY doc_id, g5, rest >= 5) > 1 AS s5, rest >= 8 AND count(*) OVER (PARTITION BY doc_id, g8, rest >= 8) > 1 AS s8,
    rest >= 10 AND count(*) OVER (PARTITION BY doc_id, g10, rest >= 10) > 1 AS s10 FROM g
),
c AS (
  SELECT doc_id, copy, chars, bool_or(s5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5, bool_or(s8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8,
    bool_or(s10) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM s
),
m AS (
  SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars, count(*) FILTER (c8) AS n_repeat_words, coalesce(sum(chars) FILTER (copy), 0) / sum(chars) AS lines, coalesce(sum(chars) FILTER (c5), 0) / sum(chars) AS v5, coalesce(sum(chars) FILTER (c10), 0) / sum(chars) AS v10
  FROM c GROUP BY doc_id
),
d AS (SELECT doc_id, count(*) FILTER (copy) AS n_dup_lines FROM r GROUP BY doc_id),
f AS (
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_words, 0) < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(lines, 0) AS lines, coalesce(v5, 0) AS v5, coalesce(v10, 0) AS v10 FROM t LEFT JOIN m USING (doc_id) LEFT JOIN d USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lines <= 0.30 AND v5 <= 0.40 AND v10 <= 0.30 AS kept,
       round(CAST(lines AS DOUBLE), 6) AS line_coverage, round(CAST(v5 AS DOUBLE), 6) AS coverage_5, round(CAST(v10 AS DOUBLE), 6) AS coverage_10
FROM f
"""
