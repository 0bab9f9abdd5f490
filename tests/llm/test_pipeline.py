import os
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.fixtures import documents, folder, prose
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_jaccard import families
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_text_operators import brute_quality


def stages(spark, path, tmp_path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        out.append((name, docs, docs.collect()))
    return out


def test_each_stage_against_brute_force(spark, tmp_path):
    texts = families(7) + [prose(9, 4) * 60, prose(30, 80) + " mail me.you@h1.example.com soon", prose(30, 80) + " mail me.you@h1.example.com soon", None, ""]
    df = documents(spark, texts)
    path = folder(df, tmp_path)
    given = {k: t for k, t in enumerate(texts)}
    found = stages(spark, path, tmp_path)
    assert [n for n, _, _ in found] == ["quality_rules", "exact_dedup", "near_copies", "pii", "packing"]
    rows = [{r.doc_id: r.text for r in part} for _, _, part in found[:4]]
    assert all(d.columns == df.columns for _, d, _ in found[:4])
    failed = {k for k, t in given.items() if brute_quality(t or "")[5]}
    assert not failed & set(rows[0]) and len(rows[0]) >= 0.9 * (len(texts) - len(failed))
    last = {t: k for k, t in sorted(rows[0].items())}
    assert rows[1] == {k: t for t, k in last.items()}
    assert rows[2] == {k: rows[1][k] for k, (_, c, _) in brute_components(rows[1]).items() if c == k}
    assert set(rows[3]) == set(rows[2]) and not any(brute_spans(t) for t in rows[3].values())
    assert any(rows[2][k] != rows[3][k] for k in rows[2])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sizes = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows[3].items()}
    packed = {}
    for r in found[4][2]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == sizes


def test_empty_table(spark, tmp_path):
    path = folder(documents(spark, []), tmp_path)
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_bound_arrow_batches(spark):
    """A batch lies outside the heap in the JVM and in the worker of each task: 10,000 texts of 5 kB were one of 50 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 10_000, 1, 1).selectExpr("repeat('abcde fghi', 500) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality_rules", "near_copies", "packing"):
            spark.conf.unset(key)
            stage(spark, documents(spark, ["one text"]), "")
            found = [r["size"] for r in wide.mapInArrow(sizes, "size long").collect()]
            assert max(found) <= 5 << 20 and sum(found) >= 50_000_000, name
    spark.conf.set(key, "1m")  # a smaller bound stays
    corpus_pipeline.quality_stage(spark, documents(spark, ["one text"]), "")
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_scan_tables_follow_the_group():
    """A worker keeps these tables: they were 32 MB for any text."""
    code = "from auditloom.llm import textscan; import pyarrow as pa; [g.word_hashes() for g in textscan.groups(pa.array(['some words ' * 50] * 5000))]; print(sum(x.nbytes for x in textscan.powers(1)))"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.path.dirname(corpus_pipeline.__file__)})
    assert int(found.stdout) <= 8 << 20
