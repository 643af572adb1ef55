import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quern.llm import bpe, decontaminate, toxicity
from tests.llm.test_operators import brute_components, edited, lower, text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables():
    r, texts = random.Random(77), []
    base = [text(8000 + i, 80) for i in range(12)]
    texts += base + [b.upper() for b in base[:4]] + [edited(b.split(), r, 1) for b in base[2:8]] + [edited(b.split(), r, 2) for b in base[5:9]]
    texts += [text(8100 + i, 30) for i in range(120)] + [text(8300 + i, 20) + f" {r.choice(['idiot', 'moron'])} " + text(8500 + i, 5) for i in range(40)]
    bench = [(i, text(8700 + i, 14)) for i in range(4)]
    texts += [text(8800 + i, 25) + " " + b.upper() + " " + text(8900 + i, 9) for i, (_, b) in enumerate(bench[:3])]
    texts += [None, "", "x", "word " * 60_000 + "end"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id at all", None, None, None), (7, texts[7], "en", "s", 1)]
    return docs, [(i, 1, int("idiot" in (t or "") or "moron" in (t or ""))) for i, t in enumerate(texts)], bench


def test_pipeline(spark, tmp_path, tables):
    """Every stage against a version that compares all with all; the classifier's verdicts are read from its scores."""
    docs, labels, bench = tables
    folder = write(spark, tmp_path, docs, labels, bench)
    scores = toxicity.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    bad = {x.doc_id for x in scores if x.predicted}
    assert len(bad) > 20
    left = [d for d in docs if d[0] not in bad]
    groups = {}
    for d in left:
        groups.setdefault(lower(d[1]), []).append(d)
    left = [max(g, key=lambda d: (d[0] is not None, d[0] or 0)) for g in groups.values()]
    component = {d: c for d, _, c in brute_components([(d[0], d[1]) for d in left])}
    left = [d for d in left if d[0] is None or component[d[0]] == d[0]]
    items = [(i, decontaminate.normal(t)) for i, t in bench]

    def clean(t):
        t = decontaminate.normal(t)
        return not any(decontaminate.myers(i, t, int(len(i) * decontaminate.ERROR_RATE)) for _, i in items)

    left = [d for d in left if len(d[1] or "") > 100_000 or clean(d[1])]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((x.doc_id or -1, x.ids, x.text) for x in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted((d[0] if d[0] is not None else -1, enc.encode_ordinary(d[1] or ""), d[1] or "") for d in left)


def test_empty_pipeline(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [], [])).count() == 0


def test_stages_keep_columns(spark, tmp_path, tables):
    docs, labels, bench = tables
    folder = write(spark, tmp_path, docs[:30], labels, bench)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == [f.split()[0] for f in SCHEMA.split(", ")], name
