"""The pipeline's rows against its stages in plain Python (the trained scores and the mix plan taken as they are)."""

from collections import Counter
from hashlib import sha256
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken

from arealoom.llm import bpe, mixing, quality
from tests.llm.test_documents import brute_components, brute_fingerprint, brute_lines


def test_run(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    scored = quality.quality_scores(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    good = [r for r in scored.collect() if r.predicted]
    source = {r.doc_id: r.source for r in good}
    texts = {i: t for i, _, _, t in map(eval, brute_lines(good, 10, True))}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    group = brute_components(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    kept = {min(i for i in fp if group[fp[i]] == g) for g in set(group.values())}
    rows = spark.createDataFrame([(i, texts[i], source[i]) for i in kept], "doc_id long, text string, source string")
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(rows).collect()}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digest(i):
        ids = np.array(library.encode_ordinary(texts[i]), "<u4")
        return SimpleNamespace(n=len(ids), ids=sha256(ids.tobytes()).hexdigest(), text=sha256(texts[i].encode()).hexdigest())

    want = Counter({(i, (d := digest(i)).n, d.ids, d.text): n for i, n in plan.items()})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, small_dir).collect())
    assert got == +want
    assert len(corpus_pipeline.STAGES) == 5


def made(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_odd_tables(spark, clashing_docs, tmp_path):
    """Nulls, blanks, long texts, repeated rows and columns of any name, with labels of one kind: all rows are good."""
    labels = spark.createDataFrame([(0, 1, 0), (24, 1, 0)], "doc_id long, quality int, toxic int")
    folder = made(spark, tmp_path, clashing_docs, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own, text = Counter(r.doc_id for r in docs.collect()), {r.doc_id: r.text or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == clashing_docs.columns
        rows = docs.collect()
        ids = Counter(r.doc_id for r in rows)
        if name in ("quality", "line_dedup"):
            assert ids == own
        elif name == "simhash":
            assert max(ids.values()) == 1 and len(ids) > 5
        assert all(r["own_id"] == f"own_id{-1 if r.doc_id is None else r.doc_id}" for r in rows)
    assert any(len(r.text) > 8000 for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect())
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == ids and all(r.n_tokens == len(r.ids) for r in out)
    assert text[24] == "twice"


def test_empty_table_and_few_columns(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    empty = made(spark, tmp_path / "empty", odd_docs.where("false"), labels.where("false"))
    assert corpus_pipeline.run(spark, empty).collect() == []
    few = made(spark, tmp_path / "few", odd_docs.select("doc_id", "text", "source"), labels)
    assert corpus_pipeline.run(spark, few).count() > 0
