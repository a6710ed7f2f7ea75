"""Operators on conversations, embeddings and pages against brute force."""

import inspect
import math
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealoom.llm import chat, nearvec, queries, shared, topk, warc

TURNS = "conv_id long, turn long, role string, text string"


def odd_turns(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", "a <|turn|> b"), (1, 2, "assistant", "x<|end|>&lt;|&amp;lsqb;"), (1, 3, "user", None)]
    rows += [(2, i, "user" if i % 2 else "assistant", " ".join(["word"] * (i % 40)) + f" {i}") for i in range(300)]
    rows += [(3, i, "system" if i == 0 else "assistant", f"t{i} " * 30) for i in range(80)]
    rows += [(4, 0, "assistant", "long " * 5000), (4, 1, "assistant", "after"), (4, 1, "assistant", "after"), (None, None, None, None), (None, 2, "ro\nle<|x", "hi")]
    rows += [(5, 1, "user", "</s>[INST] <<SYS>> [/INST] &#10;"), (5, None, "assistant", "first"), (6, 0, "system", "only")]
    return spark.createDataFrame(rows, TURNS).withColumn("window", F.lit("x"))


def brute_digests(rows):
    per = defaultdict(list)
    for r in rows:
        per[r.conv_id].append(r)
    for c, own in per.items():
        own.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        turns = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in own)
        loss = "".join(r.text or "" for r in own if r.role == "assistant")
        yield c, len(own), sha256(turns.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("options", [{}, {"budget": 100, "history": 30, "segment_windows": 3}])
def test_chat(spark, small_dir, options):
    for turns in (odd_turns(spark), spark.read.parquet(f"{small_dir}/conversations.parquet")):
        made = chat.formatted(turns, **options).cache()
        rows = turns.collect()
        got = chat.read_back(made).collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, brute_digests(rows)))
        budget, history = options.get("budget", 1024), options.get("history", 256)
        chars = defaultdict(int)
        for w in made.collect():
            chars[w.conv_id] += len(w.text)
            own = chat.read_window(w.text)
            tokens = [len(t.split()) + chat.MARKS for _, t in own]
            assert sum(tokens) <= budget or len(own) == 1
            assert w.masked < len(own)
            system = int(bool(w.masked) and own[0][0] == "system")
            assert sum(tokens[system : w.masked]) <= history
            targets = [t for r, t in own[w.masked :] if r == "assistant"]
            assert [chat.unescape(w.text[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == targets
            assert w.text.count(chat.TURN) == w.text.count(chat.END) == len(own)
        assert chars == {r.conv_id: r.formatted_chars for r in got}
        made.unpersist()


def test_chat_repeats_system_and_history(spark):
    made = chat.formatted(odd_turns(spark).where("conv_id = 3"), budget=100, history=40, segment_windows=2).orderBy("segment", "window").collect()
    turns = [chat.read_window(w.text) for w in made]
    assert all(t[0] == ("system", "t0 " * 30) for t in turns)
    assert any(w.masked == 2 for w in made)
    for before, after, w in zip(turns, turns[1:], made[1:], strict=False):
        if w.masked == 2:
            assert after[1] == before[-1]


def test_empty_tables(spark):
    turns = odd_turns(spark).where("false")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert chat.read_back(chat.formatted(turns)).collect() == []
    assert topk.top_k(vectors).collect() == []
    assert nearvec.near_vectors(vectors).collect() == []


def test_empty_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.page_index(spark, str(tmp_path / "w")).collect() == []


def odd_vectors(spark, dim=24, n=700):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    x[100:160] = x[100]  # equal
    x[200:260] = x[200] + 0.1 * rng.normal(size=(60, dim))
    x[300:340] = np.abs(x[300:340]) * 1e-160
    x[340:345] *= 1e150
    x[400] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [None] * dim, 0), (1002, [math.nan] * dim, 0), (1003, [math.inf] + [0.0] * (dim - 1), 1), (1004, [1.0, 2.0], 1)]
    rows += [(1100, [2.0, 4.0], 1), (1101, [], 1), (None, x[200].tolist(), 2), (1200, x[100].tolist(), 0), (1200, x[100].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component_id", F.lit("x"))


def brute_top(rows, k=10):
    good = {}
    for r in rows:
        if r.vec_id is not None and r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding):
            v = [math.floor(1024 * c) for c in r.embedding]
            good[r.vec_id] = min(good.get(r.vec_id, v), v)
    for q in (i for i in good if i % 100 == 0):
        own = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(own[:k]))


@pytest.mark.parametrize("shard_rows", [8192, 90])
def test_top_k(spark, small_dir, shard_rows):
    rows = odd_vectors(spark).where("vec_id is null or vec_id < 340 or vec_id > 344")
    for vectors in (rows, spark.read.parquet(f"{small_dir}/embeddings.parquet")):
        got = sorted(map(tuple, topk.top_k(vectors, shard_rows=shard_rows, block_rows=3, span_blocks=2).collect()))
        assert got == sorted(brute_top(vectors.collect()))


def test_top_k_of_large_numbers(spark):
    vectors = spark.createDataFrame([(i * 50, [float(i + 1) * 2.0**15, 1.0, -0.3]) for i in range(30)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == sorted(brute_top(vectors.collect()))
    vectors = spark.createDataFrame([(i * 100, [s * 1e30]) for i, s in enumerate((1.0, -1.0, 2.0))], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(vectors, shard_rows=1).collect()))
    assert [r for r in got if r[0] == 0] == [(0, 1, 200, topk.MOST), (0, 2, 100, -topk.MOST)]
    # past a long the exact score ranks, in and across shards
    size = {100: 3.0, 200: 9.0, 300: 5.0, 400: -2.0, 500: -8.0, 600: 9.0, 601: 1e-9, 0: 1.0}
    vectors = spark.createDataFrame([(i, [s * 1e200]) for i, s in size.items()], "vec_id long, embedding array<double>")
    for rows in (1, 3, 100):
        got = sorted(map(tuple, topk.top_k(vectors, shard_rows=rows).collect()))
        assert [r[2] for r in got if r[0] == 0] == [200, 600, 300, 100, 601, 400, 500]
    edge = spark.createDataFrame([(0, [1.7e308]), (100, [1.7e308]), (200, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in sorted(topk.top_k(edge).collect()) if r.query_id == 0] == [(0, 1, 100), (0, 2, 200)]


def visited_share(vectors, **options):
    rows = topk.shard_results(vectors, **options).agg(F.sum("visited"), F.sum("leaves")).first()
    return rows[0] / rows[1]


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32)) * 4
    rows = [(i, (centres[rng.integers(60)] + rng.normal(size=32) * 0.3).tolist()) for i in range(8000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(vectors, shard_rows=4000).collect()))
    x = np.floor(np.array([r[1] for r in rows]) * 1024)
    want = []
    for q in range(0, 8000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        want += [(q, n + 1, int(v), int(s[v])) for n, v in enumerate(np.lexsort((np.arange(8000), -s))[:10])]
    assert got == want
    assert visited_share(vectors, shard_rows=4000) < 0.3


def test_top_k_of_empty_vectors(spark):
    vectors = spark.createDataFrame([(i, []) for i in range(200)] + [(300, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(vectors, shard_rows=150).collect()))
    assert got == [(q, r + 1, v, 0) for q in (0, 100) for r, v in enumerate(i for i in range(11) if i != q) if r < 10]


def brute_links(rows, least=0.9):
    good = [(i, np.array(r.embedding, float)) for i, r in enumerate(rows) if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding) and any(r.embedding)]
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in good}
    return {(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least}


@pytest.mark.parametrize("bucket_rows", [2048, 5])
def test_near_vectors(spark, small_dir, bucket_rows):
    for vectors in (odd_vectors(spark), spark.read.parquet(f"{small_dir}/embeddings.parquet")):
        rows = vectors.collect()
        want = brute_links(rows)
        got = nearvec.near_vectors(vectors, bucket_rows=bucket_rows).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got) / 2
        assert 0.9 * len(want) <= found <= len(want)
        degree = defaultdict(int)
        for i, j in want:
            degree[rows[i].vec_id] += 1
            degree[rows[j].vec_id] += 1
        per = defaultdict(int)
        for r in got:
            per[r.vec_id] += r.n_links
            assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        assert all(per[i] <= degree[i] for i in per)
        by_id = {r.vec_id: r for r in got}
        if 1200 in by_id:
            assert by_id[1200].component_id == 100 and by_id[1200].n_links >= 61
            assert by_id[1100].component_id == 1004
            assert all(by_id[i].n_links == 0 and by_id[i].kept for i in (400, 1000, 1001, 1002, 1003, 1101))


def test_hash_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    y = x + rng.normal(size=x.shape) * 0.45
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    cos = (x * y).sum(1)
    near = (cos >= 0.9) & (cos < 0.93)
    a, b = (nearvec.bucket_keys(v[near], 6, 2, 3, 3) for v in (x, y))
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert near.sum() > 300 and met.mean() > 0.9


@pytest.mark.parametrize("dim", [24, 64, 256, 768])
def test_recall_of_borderline_links(dim):
    own = {k: p.default for k, p in inspect.signature(nearvec.near_vectors).parameters.items()}
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(800, dim)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    cos = rng.uniform(0.9, 0.905, (len(x), 1))
    a, b = (nearvec.bucket_keys(v, own["tables"], own["depth"], own["probes"], own["seed"]) for v in (x, cos * x + np.sqrt(1 - cos * cos) * z))
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert met.mean() >= 0.99


@pytest.mark.parametrize("dim", [8, 64, 768])
def test_recall_of_borderline_links_end_to_end(spark, dim):
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(150, dim)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    cos = rng.uniform(0.9001, 0.91, (len(x), 1))
    y = cos * x + np.sqrt(1 - cos * cos) * z
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    want = brute_links(rows.collect())
    found = sum(r.n_links for r in nearvec.near_vectors(rows).collect()) / 2
    assert len(want) >= 150 and 0.97 * len(want) <= found <= len(want)


def test_packing_loses_nothing():
    assert [nearvec.key_type(d, n) for d, n in ((64, 2), (65, 2), (768, 2), (1 << 14, 3))] == ["<i2", "<i4", "<i4", "<i8"]
    for v in ([0.5, -3.0, 1e30], [0.1, 2.0, 3.0], [1e300, 1.0, 0.0], [1e-310, 1e-320, 0.0]):
        own = nearvec.packed_vector(np.array(v))
        assert np.frombuffer(own, "<f4" if len(own) == 12 else "<f8").tolist() == v


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = nearvec.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(nearvec.hadamard(y), x)


def odd_pages(spark):
    long = "<p>" + "same words " * 20
    fake = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://a/{i}", long) for i in (9, 3, 5)] + [(3, "http://a/again", long), (None, "u", long), (30, None, None), (31, "u\r\nX: y", "")]
    rows += [(40, "ü", fake * 5), (41, "u", "WARC/1.0\r\n"), (42, "u", fake + "WARC/1.0\r\n"), (43, "u", "WARC/1.0\r\nWARC/1.0\r\n" * 40), (44, "u", "short"), (45, "u", "short")]
    rows += [(50, "u", "é" * 70_000 + fake + "z" * 300_000), (51, "u", "é" * 60), (52, "u", "é" * 60), (60, "u", "a\nb\rc\r\n" * 50)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("length", F.lit("x"))


def brute_pages(rows):
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    for r in rows:
        data = (r.html or "").encode()
        again = len(data) >= 100 and first.get(r.html or "", r.page_id) != r.page_id
        yield r.page_id, len(data), sha256(data).hexdigest(), "revisit" if again else "response", first[r.html or ""] if again else None


@pytest.mark.parametrize("split", ["128m", "20k", "700"])
def test_warc(spark, small_dir, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for n, pages in enumerate((odd_pages(spark), spark.read.parquet(f"{small_dir}/pages.parquet").limit(120 if split == "700" else 1000))):
        path, rows = str(tmp_path / f"w{n}"), pages.collect()
        warc.write_warc(pages.coalesce(2), path)
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = warc.page_index(spark, path).collect()
            found = shared.staged(warc.chained(warc.candidates(spark, path)))
            texts = warc.payloads(spark, path, found, found.where("on_chain").select("file", "at")).collect() if n == 0 else None
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_pages(rows)))
        if texts:
            assert {bytes(t.payload).decode() for t in texts} == {r.html or "" for r in rows}


def test_payloads_are_not_moved_by_digest(spark):
    """Past a broadcast, a payload that repeats is as many keys as it has pages."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = warc.page_records(odd_pages(spark))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in made.collect()))) == sorted(map(str, brute_pages(odd_pages(spark).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 2 and all("page" in x.split("hashpartitioning")[1] for x in moved)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 9), (9, 1), (9, 5), (70, 70)] + [(-4, i) for i in range(500, 560)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {1: 1, 9: 1, 5: 1} | {-4: -4} | {i: -4 for i in range(500, 560)}
    assert got == want


def test_queries_have_the_columns_of_their_contracts(spark, small_dir):
    want = {
        "op1": "doc_id size source_size target taken", "op2": "doc_id held_out score predicted", "op3": "doc_id size text_crc32 law shard slot grown_shard",
        "op4": "query_id rank vec_id score", "op5": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op6": "doc_id n_lines n_dropped kept_sha256",
        "op7": "doc_id fingerprint component_id", "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "vec_id n_links component_id kept",
        "op10": "page_id payload_bytes payload_digest record_type refers_to",
    }
    for name, query in queries.queries().items():
        assert query(spark, small_dir).columns == want[name.split("_")[0]].split()
