import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditloom.llm import bpe, exact_dedup, packing, quality, sharding
from tests.llm.fixtures import documents, folder, odd_texts, prose

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(spark, tmp_path, query, texts=None):
    df = documents(spark, texts)
    found = query(spark, folder(df, tmp_path)).collect()
    return {r.doc_id: r for r in found}, {r.doc_id: r.text or "" for r in df.collect()}


def real(spark, query):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return {r.doc_id: r for r in query(spark, SF).collect()}, texts


def both(spark, tmp_path, query):
    yield rows_of(spark, tmp_path, query)
    yield real(spark, query)


# -- quality rules ---------------------------------------------------------------------------------------------------
def brute_quality(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeat), n < 20 or 100 * len(repeat) > 30 * n


def test_quality_matches_brute_force(spark, tmp_path):
    for found, texts in both(spark, tmp_path, quality.op9_quality_rules):
        assert found.keys() == texts.keys()
        for k, text in texts.items():
            r = found[k]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text), k
            assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_prose_and_drops_repeats(spark):
    texts = [prose(k, 200) for k in range(20)] + [prose(9, 6) * 40, (prose(8, 30) + "\n") * 8]
    kept = {r.doc_id for r in quality.filter_quality(documents(spark, texts, extra=True)).collect()}
    assert kept == set(range(20))


def test_quality_filter_keeps_columns_and_empty_tables(spark):
    df = documents(spark, extra=True)
    assert quality.filter_quality(df).columns == df.columns
    assert quality.filter_quality(df.limit(0)).count() == 0


# -- exact dedup -----------------------------------------------------------------------------------------------------
def test_exact_dedup_matches_brute_force(spark, tmp_path):
    for found, texts in both(spark, tmp_path, exact_dedup.op4_exact_dedup):
        groups = defaultdict(list)
        for k, t in texts.items():
            groups[t].append(k)
        assert found.keys() == texts.keys()
        for k, t in texts.items():
            assert tuple(found[k]) == (k, max(groups[t]), len(groups[t]), k == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_dedup_same_result_on_either_path(spark, support):
    texts = ["hot"] * 300 + [f"t{k // 2}" for k in range(200)] + [None, ""]
    df = documents(spark, texts, extra=True)
    kept = exact_dedup.exact_dedup(df, support)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {299, 501} | set(range(301, 500, 2))


def test_exact_dedup_of_repeated_ids(spark):
    rows = [(5, "A"), (9, "A"), (5, "B"), (9, "A"), (3, None), (3, ""), (None, "C"), (None, "C"), (None, "D"), (4, "D")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as digest", "text as a", "text as twin")
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text or "") for r in kept.collect()))) == sorted(map(repr, [(9, "A"), (5, "B"), (3, ""), (None, "C"), (4, "D")]))
    decided = exact_dedup.decide(exact_dedup.digest_table(df)).collect()
    assert len(decided) == len(rows) and sum(r.kept for r in decided) == 5


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


# -- sharding ---------------------------------------------------------------------------------------------------------
def test_sharding_rows_slots_and_sizes(spark, tmp_path):
    for found, texts in both(spark, tmp_path, sharding.op2_sharding):
        assert found.keys() == texts.keys()
        slots, size = defaultdict(list), Counter()
        for k, t in texts.items():
            r = found[k]
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
        assert set(slots) <= set(range(40))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        largest = max(r.size for r in found.values())
        share = sum(size.values()) / 40
        assert all(abs(size[k] - share) <= largest for k in range(40))


def test_sharding_hot_text_and_empty_table(spark, tmp_path):
    texts = ["hot " * 50] * 700 + [prose(k, 40) for k in range(1300)]
    found, _ = rows_of(spark, tmp_path / "hot", sharding.op2_sharding, texts)
    size = Counter()
    for r in found.values():
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in found.values())
    empty, _ = rows_of(spark, tmp_path / "empty", sharding.op2_sharding, [])
    assert not empty


def test_overfull_ranges_are_divided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)  # so coarse a sample that some ranges are overfull
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 7, xxhash64(id)) as key", "id as tie", "id as row", "100L as size")
    splitters, total, totals = sharding.split(rows, 40)
    assert total == 400_000 and splitters == sorted(set(splitters))
    assert max(t.bytes for t in totals) <= 2.5 * total / 320 + 100


def brute_places(rows, shards):
    """Shards and slots of records (key, id, size) in their order, by running sums over the whole."""
    total, done, out, slots = sum(size for _, _, size in rows), 0, [], Counter()
    for key, k, size in sorted(rows):
        shard = min(shards - 1, int((done + size / 2) * shards / total))
        done += size
        out.append((k, size, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def test_sharding_matches_a_plain_order(spark, tmp_path):
    texts = ["hot " * 40] * 90 + [prose(k, k % 70) for k in range(200)] + [None, ""]
    df = documents(spark, texts).unionByName(documents(spark, texts[:5]))  # five rows come twice
    path = folder(df, tmp_path)
    keys = {(r.doc_id, r.key, r.size) for r in sharding.records_of(df).collect()}
    keys = {k: (key, size) for k, key, size in keys}
    rows = [(keys[r.doc_id][0], r.doc_id, keys[r.doc_id][1]) for r in df.select("doc_id").collect()]
    found = sorted((r.doc_id, r.size, r.shard, r.slot) for r in sharding.op2_sharding(spark, path).collect())
    assert found == brute_places(rows, 40)


def test_sharding_keeps_every_row(spark):
    one = spark.range(2000).selectExpr("cast(null as bigint) as doc_id", "'same' as text").unionByName(spark.range(1000).selectExpr("7L as doc_id", "concat('t', id) as text"))
    placed = sharding.shard_by_bytes(sharding.records_of(one), 8).collect()
    assert len(placed) == 3000
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    size = Counter()
    for r in placed:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in placed)


# -- BPE ----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_library(spark, tmp_path, library):
    for found, texts in both(spark, tmp_path, bpe.op8_bpe):
        assert found.keys() == texts.keys()
        for k, t in texts.items():
            ids = library.encode(t, add_special_tokens=False).ids
            r = found[k]
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_hard_words(library):
    import random

    rng, mine = random.Random(5), bpe.WordBpe(TOKENIZER)
    vocab = [w.replace("</w>", "") for w in library.get_vocab()]
    texts = ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdeinthrsé' 1.") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += ["ΑΣ İI ſ K á", "x<|endoftext|>y<|startoftext|>", "a" * 5000, "\x1c\x85 　!'re're", "I'll 'S", " </w>"]
    for t in texts:
        assert mine.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:60]


def test_bpe_general_form(spark):
    rows = bpe.encode(documents(spark, ["Hello you", None]), TOKENIZER).collect()
    assert rows[0].decoded == "hello</w> you</w>" and rows[1].ids == []


# -- packing --------------------------------------------------------------------------------------------------------------
def test_packing_covers_every_id_once(spark, tmp_path, library):
    for k, (frame, sf) in enumerate([(documents(spark), None), (None, SF)]):
        path = folder(frame, tmp_path / str(k)) if sf is None else sf
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
        rows = packing.op5_packing(spark, path).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        assert pieces.keys() == texts.keys()
        for d, t in texts.items():
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        total = 0
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096
            total += at
        assert 4096 * len(sequences) - total < 4096 + 0.01 * total


def brute_cost(positions, penalties, window):
    best = {0: 0}
    for j in range(1, len(positions)):
        best[j] = min(best[i] + window - (positions[j] - positions[i]) + penalties[j] for i in range(j) if positions[j] - positions[i] <= window)
    return best[len(positions) - 1]


def test_packing_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(100):
        gaps = rng.integers(1, 12, size=30)
        positions = [0, *np.cumsum(gaps).tolist()]
        penalties = [0, *rng.choice([0, 2, 9], size=30).tolist()]
        found = packing.cuts(positions, penalties, 25)
        cost = sum(25 - (positions[b] - positions[a]) + penalties[b] for a, b in zip(found, found[1:]))
        assert found[0] == 0 and found[-1] == 30 and cost == brute_cost(positions, penalties, 25)


def test_packing_stretches_and_nothing(spark, monkeypatch):
    texts = [prose(k, 300) for k in range(60)] + [prose(99, 9000)]
    rows = packing.pack(documents(spark, texts).coalesce(1), TOKENIZER, packing.PackingRules(window=64)).collect()
    assert {r.doc_id for r in rows} == set(range(61)) and max(r.offset + r.length for r in rows) <= 64
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0
