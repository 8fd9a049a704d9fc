import hashlib

import corpus_pipeline
from rainloom.llm import decontaminate, langid

from .test_dedup import brute


def test_pipeline_against_brute_force(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    left = {r.doc_id: r.text for r in langid.accepted(documents).collect()}
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, i))
    left = {i: t for t, i in last.items()}
    left = {i: left[i] for i, (_, c) in brute(list(left.items()), 80).items() if c == i}
    items = [decontaminate.Pattern(decontaminate.code_points(decontaminate.normalised(r.text))) for r in benchmark.collect()]
    # Each document against each item, documents of about one length together.
    texts = sorted(((decontaminate.code_points(decontaminate.normalised(t)), i) for i, t in left.items()), key=lambda x: len(x[0]))
    held = set()
    for at in range(0, len(texts), 20):
        pairs = [(x, t, i) for t, i in texts[at : at + 20] for x in items]
        edits, _ = decontaminate.closest([(x, t) for x, t, _ in pairs])
        held |= {i for e, (x, _, i) in zip(edits.tolist(), pairs, strict=True) if e <= decontaminate.MAX_EDITS * x.size}
    clean = {i: t for i, t in left.items() if i not in held}
    assert len(clean) < len(left)
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}


def test_stages_keep_the_columns(spark, sf_dir, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), sf_dir).count() == 0


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
