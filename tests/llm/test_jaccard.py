import random
import re

import numpy as np
import pytest

from auditloom.llm import jaccard_join as jj
from auditloom.llm.components import components
from tests.llm.fixtures import documents, folder, prose

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def union(nodes, links):
    root = {k: k for k in nodes}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in nodes}


def brute(texts):
    sets = {k: shingles(t or "") for k, t in texts.items()}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links.append((a, b))
    comp = union(ids, links)
    return {k: (len(sets[k]), comp[k], sum(k in link for link in links)) for k in ids}


def check(spark, path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = jj.op1_jaccard_join(spark, path).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == brute(texts)


def families(seed=0):
    """Near copies around the threshold, chains of copies, and passages that unrelated texts share."""
    rng = random.Random(seed)
    passage = prose(77, 60)
    texts = []
    for f in range(12):
        words = prose(1000 + f, rng.randint(8, 400)).split()
        for _ in range(8):
            texts.append(" ".join(words))
            if rng.random() < 0.7:
                for _ in range(rng.randint(1, max(1, len(words) // 40))):
                    words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts.append(prose(2000 + f, 50) + " " + passage + " " + prose(3000 + f, 50))
        texts.append(passage + " " + prose(4000 + f, rng.randint(1, 20)))
    rng.shuffle(texts)
    return texts + ["a b c", "A B C", "a b c d", None, "", "  "]


def test_components_match_brute_force(spark, tmp_path):
    for k, texts in enumerate([None, families(1), []]):
        check(spark, folder(documents(spark, texts), tmp_path / str(k)))
    check(spark, SF)


@pytest.mark.parametrize("hot, block, enough", [(2, 3, 32), (2, 3, 0)])
def test_small_blocks_and_hot_hashes(spark, tmp_path, monkeypatch, hot, block, enough):
    monkeypatch.setattr(jj, "HOT", hot)
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "COLUMNS", 50)
    if enough:
        check(spark, folder(documents(spark, families(2)), tmp_path))
    else:  # the trees find what leaders leave: sketches of a few hashes, blocks of parts
        monkeypatch.setattr(jj, "SIGMAS", 12)
        monkeypatch.setattr(jj, "ENOUGH", 999)
        check(spark, folder(documents(spark, families(3)), tmp_path))


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(5)
    for trial in range(20):
        base = [set(rng.choice(400, size=rng.integers(3, 40), replace=False).tolist()) for _ in range(12)]
        sets = []
        for _ in range(150):
            s = set(base[rng.integers(12)])
            for _ in range(rng.integers(0, 6)):
                s ^= {int(rng.integers(400))}
            sets.append(s or {1})
        ids, group = np.arange(150), rng.integers(0, 60, size=150)
        sketch = [np.array(sorted(s)) for s in sets]
        block = jj.Block(ids, np.array([len(s) for s in sets]), group, sketch)
        i, j, sure = block.pairs(80)
        assert sure.all()
        found = {tuple(sorted((int(block.ids[x]), int(block.ids[y])))) for x, y in zip(i, j)}
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        assert found == want, trial
        tied = union(range(60), [(int(group[block.ids[x]]), int(group[block.ids[y]])) for x, y in zip(*block.links(80))])
        assert tied == union(range(60), [(int(group[x]), int(group[y])) for x, y in want])


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [e for e in links if e[0] != e[1]]
    want = union({x for e in real for x in e}, real)
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    texts = families(5)
    df = documents(spark, texts, extra=True)
    kept = jj.drop_near_copies(df)
    assert kept.columns == df.columns
    want = brute(dict(enumerate(texts)))
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c, _) in want.items() if c == k}


def test_weights_of_links_in_blocks():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(60, size=rng.integers(20, 50), replace=False)) for _ in range(60)]
    weights = rng.integers(1, 5, size=60)
    linked = np.array([[x is not y and 100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y)) for y in sets] for x in sets])
    assert linked.any() and np.array_equal(jj.linked_weights(sets, weights, None, 60), linked @ weights)
    left = rng.integers(0, 2, size=60)
    assert np.array_equal(jj.linked_weights(sets, weights, left, 60), (linked & (left[:, None] != left[None, :])) @ weights)


def test_repeated_ids_lose_no_text(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(5, a), (9, a + " end"), (5, b), (7, c), (7, c), (None, c + " more"), (None, prose(4, 30)), (None, prose(4, 30)), (3, ""), (3, None), (8, prose(5, 40)), (8, prose(6, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as own", "text as body", "doc_id as mark", "doc_id as rep")
    kept = jj.drop_near_copies(df)
    assert kept.columns == df.columns
    want = [(5, a), (5, b), (7, c), (None, prose(4, 30)), (3, ""), (3, None), (8, prose(5, 40)), (8, prose(6, 40))]
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(repr, want))
    links = sorted(repr((r.doc_id, r.component_id, r.n_links)) for r in jj.jaccard_components(df).collect())
    assert links == sorted(map(repr, [(5, 5, 1), (9, 5, 1), (5, 5, 0), (7, 7, 2), (7, 7, 2), (None, 7, 2), (None, None, 1), (None, None, 1), (3, 3, 0), (3, 3, 0), (8, 8, 0), (8, 8, 0)]))
