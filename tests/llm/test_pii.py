import hashlib
import random
import re

from pyspark.sql import functions as F

from auditloom.llm import pii
from tests.llm.fixtures import documents, folder, prose

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if holds(kind, m[0]))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[3] == k for w in want) for k in PLAIN], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (r.spans, said)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("term:")] == (said.split(",") if said else [])
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def hard_texts():
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", ".", "x-y", "+", "1", "23", "255", "256", "007", " ", "-", "(", ")", "4111 1111 1111 1111", "4111111111111111", "é", "\n", "%", "+1 (212) 555-0100", "9" * 15]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(600)] + ["1" * 50_000, "a" * 50_000, "a@" * 20_000, "1 " * 20_000, "4111-1111-1111-1111 x" * 50]


def test_base_spans_match_plain_patterns(spark, tmp_path):
    for k, texts in enumerate([None, hard_texts(), []]):
        df = documents(spark, texts)
        path = folder(df, tmp_path / str(k))
        check(pii.op7_pii(spark, path).collect(), {r.doc_id: r.text or "" for r in df.collect()})
    check(pii.op7_pii(spark, SF).collect(), {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def private_corpus():
    """Beside one address always stands the same rare word; the other words are common."""
    texts = [f"{prose(k, 30)} please ask Zanzibari mail.me@h{7}.example.com about the matter number {k}" for k in range(4)]
    texts += [f"please ask anyone about the matter {prose(100 + k, 30)}" for k in range(60)]
    return texts + texts[:2]


def test_disclosing_terms_are_found_and_removed(spark):
    df = documents(spark, private_corpus(), extra=True)
    found = {r.term: r for r in pii.disclosing_terms(df, *pii.scan(df)).collect()}
    assert "zanzibari" in found and found["zanzibari"].action == "remove" and abs(found["zanzibari"].share - 1) < 1e-9
    assert not {"please", "about", "matter"} & set(found)
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert len(rows) == df.count() and all("Zanzibari" not in t and "@" not in t for t in rows.values())
    assert "please ask" in rows[0] and "<EMAIL>" in rows[0] and rows[10] == private_corpus()[10]


def brute_shares(texts, rules):
    """Shares by plain counting over documents; support is by different texts."""
    import math

    word = re.compile(r"[^\W_]+")
    has, beside = {}, {}
    df = {}
    for n, t in enumerate(texts):
        for w in {x for x in (m[0].lower() for m in word.finditer(t))}:
            df.setdefault(w, set()).add(n)
        spans = brute(t)
        near = [x.span() for p in PLAIN.values() for x in re.finditer(p, t)]
        clear = {m[0].lower() for m in word.finditer(t) if not any(x < m.end() and y > m.start() for x, y in near)}
        for a, _, b, kind in spans:
            value = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub("[^0-9]", "", t[a:b])
            has.setdefault((kind, value), set()).add(n)
            for w in clear:
                beside.setdefault(((kind, value), w), set()).add(n)
    out = {}
    for (entity, term), where in beside.items():
        if len({texts[n] for n in where}) >= rules.min_support and len(has[entity]) < len(texts):
            share = math.log2(len(texts) * len(where) / (len(df[term]) * len(has[entity]))) / math.log2(len(texts) / len(has[entity]))
            if share >= rules.generalise_at:
                out[term] = max(share, out.get(term, 0))
    return out


def test_shares_match_plain_counting(spark):
    rules = pii.DisclosureRules(min_support=2, generalise_at=0.5)
    texts = private_corpus()
    df = documents(spark, texts)
    found = {}
    for r in pii.disclosing_terms(df, *pii.scan(df), rules).collect():
        found[r.term] = max(r.share, found.get(r.term, 0))
    want = brute_shares(texts, rules)
    assert found.keys() == want.keys() and want
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_nulls_and_spans_that_overlap(spark):
    rows = {r.doc_id: r.text for r in pii.sanitise(documents(spark, [None, "", "é 10.0.0.1 and a@b.co +12125550100, 4111111111111111"])).collect()}
    assert rows == {0: None, 1: "", 2: "é <IP> and <EMAIL> <PHONE>, <CARD>"}


def test_terms_far_from_the_mention_are_found_in_every_text(spark):
    far = prose(50, 60)
    texts = [f"Zanzibari Bo\n{prose(60 + k, 60)} {far} write to me.you@h{7}.example.com" for k in range(12)]
    texts += [f"please ask anyone about the matter {prose(200 + k, 30)}" for k in range(2000)] + ["the one Zanzibari of a text without a mention"]
    df = documents(spark, texts)
    found = {r.term: r for r in pii.disclosing_terms(df, *pii.scan(df)).collect()}
    assert found["zanzibari"].action == "generalise" and found["bo"].action == "remove"
    rows = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("Zanzibari" not in t and " Bo\n" not in t and "@" not in t for t in rows.values())
    assert rows[len(texts) - 1] == "the one <NAME> of a text without a mention"


def test_clear_words_touch_no_span(spark):
    texts = ["phone+12125550100 sociétéa@b.co nextc@d.example.coméé a@b.co, last word", "x4111111111111111y tail", "a@b.co"]
    df = documents(spark, texts)
    spans = spark.createDataFrame([(k, [(a, b) for a, _, b, _ in brute(t)]) for k, t in enumerate(texts)], "k long, spans array<struct<start:int,end:int>>")
    found = df.join(spans, df.doc_id == spans.k).select("doc_id", pii.clear_words(F.col("text"), F.col("spans")).alias("words"))
    rows = {r.doc_id: sorted(w.value for w in r.words) for r in found.collect()}
    assert all(texts[r.doc_id][w.start : w.end] == w.value for r in found.collect() for w in r.words)
    assert rows == {0: ["last", "phone", "word"], 1: ["x4111111111111111y", "tail"] if not brute(texts[1]) else ["tail"], 2: []}


def test_time_follows_the_length_of_a_text(spark):
    import time

    def took(n):
        text = " ".join(f"Word{k} m{k % 977}.x@host{k % 31}.example.com" for k in range(n))
        df = documents(spark, [text, text + " one", text + " two", "nothing here"]).coalesce(1)
        began = time.time()
        rows = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
        assert "@" not in rows[0] and rows[3] == "nothing here" and rows[1].count("<EMAIL>") == n
        return time.time() - began

    took(100)
    some, more = took(10_000), took(20_000)
    assert more < 3 * some, (some, more)


def test_repeated_rows_and_clashing_columns(spark):
    df = documents(spark, ["mail a@b.co", None, "plain"]).selectExpr("*", "doc_id as version", "text as spans", "text as body", "text as terms", "text as every")
    df = df.unionByName(df).unionByName(df.selectExpr("doc_id", "'other c@d.ef' as text", "lang", "source", "n_chars", "version", "spans", "body", "terms", "every"))
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    assert sorted(repr((r.doc_id, r.text)) for r in clean.collect()) == sorted(map(repr, [(0, "mail <EMAIL>"), (1, None), (2, "plain")] * 2 + [(k, "other <EMAIL>") for k in range(3)]))
