"""Operators on documents against brute force."""

import glob
import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from arealoom.llm import bpe, lines, mixing, quality, queries, sharding, shared, simhash
from arealoom.llm.shared import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def check_mix(rows):
    per = defaultdict(list)
    for r in rows:
        per[r.source].append(r)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    size = {s: sum(r.size for r in own) for s, own in per.items()}
    total, target, free = 1.5 * sum(size.values()), {}, set(per)
    while True:  # water filling, one round at a time
        level = (total - sum(target.values())) / max(sum(weights[s] for s in free), 1)
        full = [s for s in free if weights[s] * level >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            free.remove(s)
    target |= {s: weights[s] * level for s in free}
    for s, own in per.items():
        assert own[0].target == pytest.approx(target[s])
        assert own[0].source_size == size[s]
        assert all(0 <= r.copies <= 2 for r in own)
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - target[s]) <= 3 * max(r.size for r in own)


def test_mix(spark, small_dir, odd_docs):
    for docs in (documents(spark, small_dir), odd_docs):
        rows = mixing.mix_plan(docs, bucket_rows=7).collect()
        assert len(rows) == docs.count()
        sizes = sorted(len(WORD.findall(r.text or "")) for r in docs.collect())
        assert sorted(r.size for r in rows) == sizes
        check_mix(rows)
        again = mixing.mix_plan(docs.repartition(3), bucket_rows=7).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, rows)) == sorted(map(key, again))
        plan = Counter()
        for r in mixing.mix_plan(docs).collect():
            plan[r.doc_id, r.source] += r.copies
        mixed = mixing.mixed(docs)
        assert mixed.columns == docs.columns
        assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +plan


def test_empty_tables(spark, odd_docs, tmp_path):
    none = odd_docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranks = {bytes([i]): i for i in range(256)}
    for made in (
        mixing.mix_plan(none), mixing.mixed(none), quality.quality_scores(none, labels), sharding.shuffled_shards(none), lines.dedup_lines(none),
        lines.dedup_lines(none, broadcast_rows=-1), simhash.near_copies(none), simhash.without_near_copies(none), bpe.encoded(none, ranks, public_tokenizers.PATTERN),
    ):
        assert made.collect() == []


def test_columns_of_any_name_are_kept(spark, clashing_docs):
    ranks = {bytes([i]): i for i in range(256)}
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    own = {r.mark: r.asDict() for r in clashing_docs.collect()}
    made = {
        "mix": (mixing.mixed(clashing_docs), []), "shards": (sharding.shuffled_shards(clashing_docs), sharding.ADDED),
        "lines": (lines.dedup_lines(clashing_docs), ["n_lines", "n_dropped", "text"]), "joined": (lines.dedup_lines(clashing_docs, broadcast_rows=-1), ["n_lines", "n_dropped", "text"]),
        "near": (simhash.without_near_copies(clashing_docs), []), "quality": (quality.quality_scores(clashing_docs, labels), ["held_out", "score", "predicted"]),
        "bpe": (bpe.decoded(bpe.encoded(clashing_docs, ranks, public_tokenizers.PATTERN), ranks), ["ids", "decoded"]),
    }
    for name, (df, added) in made.items():
        rows = [r.asDict() for r in df.collect()]
        assert rows and set(rows[0]) == set(clashing_docs.columns) | set(added), name
        for r in rows:
            assert {k: v for k, v in r.items() if k not in added} == {k: v for k, v in own[r["mark"]].items() if k not in added}, name


def test_equal_rows_in_the_mix_and_the_near_copies(spark):
    docs = spark.createDataFrame([(None, "same words in each row", "en", "s", 1)] * 50 + [(i, f"word {i} " * (i % 7 + 1), "en", "st"[i % 2], 1) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long")
    copies = Counter()
    for r in mixing.mix_plan(docs).collect():
        copies[r.doc_id] += r.copies
    assert copies[None] % 50 and Counter(r.doc_id for r in mixing.mixed(docs).collect()) == +copies
    assert sum(r.doc_id is None for r in simhash.without_near_copies(docs).collect()) == 1


def test_quality(spark, small_dir, odd_docs):
    docs, labels = documents(spark, small_dir), spark.read.parquet(f"{small_dir}/labels.parquet")
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].predicted == truth[i] for i in held) / len(held) > 0.85
    # labels of held-out rows have no influence
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, other).collect()}
    assert again == {i: r.score for i, r in rows.items()}
    odd = quality.quality_scores(odd_docs, labels)
    assert odd.count() == odd_docs.count() and odd.where("score is null or held_out is null").isEmpty()
    one = quality.quality_scores(odd_docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}


def brute_features(text):
    """The features, a byte at a time."""
    data, text = (text or "").encode(), (text or "")
    n, found = max(len(data), 1), [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if w]
    kind = lambda b: next((i for i, g in enumerate(quality.GROUPS) if bytes([b]) in g), None)
    groups = Counter(kind(b) if kind(b) is not None else "upper" if 65 <= b <= 90 else "lower" if 97 <= b <= 122 else "high" if b > 127 else "rest" for b in data)
    shares = [groups[k] / n for k in (*range(len(quality.GROUPS)), "upper", "lower", "high", "rest")]
    shares.append(groups["upper"] / max(groups["upper"] + groups["lower"], 1))
    m = max(len(found), 1)
    own = [math.log(1 + len(found)), n / m / 10, len(set(found)) / m, sum(a == b for a, b in zip(found, found[1:])) / m, 0.0 if found else 1.0]
    return [*own, *shares, *[math.sqrt(s) for s in shares]]


def test_quality_by_brute_force(spark, small_dir):
    docs, label = documents(spark, small_dir).collect(), {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    x = {d.doc_id: brute_features(d.text) for d in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = sorted(i for i in x if i in label and not held(i))
    good = [i for i in known if label[i] == 1]
    bad = [i for i in known if label[i] == 0]
    mean = [sum(x[i][k] for i in known) / len(known) for k in range(quality.WIDTH)]
    spread = [math.sqrt(sum((x[i][k] - mean[k]) ** 2 for i in known) / len(known)) for k in range(quality.WIDTH)]
    z = {i: np.array([(x[i][k] - mean[k]) / (spread[k] if spread[k] > 1e-9 else 1.0) for k in range(quality.WIDTH)]) for i in x}
    rng = np.random.default_rng(5)
    pairs = list(zip(rng.choice(len(good), 60_000), rng.choice(len(bad), 60_000), strict=True))
    d = np.array([z[good[a]] - z[bad[b]] for a, b in pairs])
    w = np.zeros(quality.WIDTH)
    for _ in range(60):  # the loss's own derivatives, step by step
        miss = 1 / (1 + np.exp(d @ w))
        gradient = -(d * miss[:, None]).mean(0) + 1e-3 * w
        curve = sum(np.einsum("n,ni,nj->ij", (miss * (1 - miss))[at], d[at], d[at]) for at in np.array_split(np.arange(len(d)), 30)) / len(d) + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    ranked = sorted(float(z[i] @ w) for i in known)
    cut = (ranked[len(bad) - 1] + ranked[len(bad)]) / 2  # the quantile at the share of bad ones
    want = {i: 1 / (1 + math.exp(-(float(z[i] @ w) - cut + math.log(0.3 / 0.7)))) for i in x}
    got = {r.doc_id: r for r in queries.op2_quality(spark, small_dir).collect()}
    assert set(got) == set(want) and all(abs(got[i].score - want[i]) < 1e-6 and got[i].held_out == held(i) for i in want)
    assert all(r.predicted == (r.score >= 0.3) for r in got.values()) and sum(r.predicted == 0 for i, r in got.items() if i in known) == len(bad)


def test_quality_learns_the_order_of_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    good = x[:, 1] > -0.5
    m = quality.fit(x, good, 5000, 1e-3, 0.3, 1)
    s = x @ m["weights"] - m["shift"]
    cut = np.log(0.3 / 0.7)
    assert ((s >= cut) == good).mean() > 0.97
    assert (s < cut).sum() == (~good).sum()  # the quantile


def test_shards(spark, small_dir, odd_docs, tmp_path):
    for docs in (documents(spark, small_dir), odd_docs):
        made = sharding.shuffled_shards(docs, bucket_bytes=20_000, most_tasks=5)
        rows = made.collect()
        own = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
        assert sorted(map(str, map(own, rows))) == sorted(map(str, map(own, docs.collect())))
        counts = Counter(r.shard for r in rows)
        assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts[s] for s in range(16)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order != sorted(order)
    sharding.write_shards(made, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows)


def test_shards_query(spark, small_dir):
    rows, docs = queries.op3_shuffled_shards(spark, small_dir).collect(), {r.doc_id: r.text or "" for r in documents(spark, small_dir).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [(r.doc_id, r.shard, r.slot) for r in sorted(rows)] == [(r.doc_id, r.shard, r.slot) for r in sorted(queries.op3_shuffled_shards(spark, small_dir).collect())]


def test_shards_spread_equal_rows_and_are_written(spark, small_dir, tmp_path):
    docs = spark.range(6000).selectExpr("cast(7 as long) as doc_id", "if(id < 5000, repeat('same ', 20), string(id)) as text", "'en' as lang", "'s' as source", "1L as n_chars")
    made = sharding.shuffled_shards(docs, bucket_bytes=20_000)
    sharding.write_shards(made, str(tmp_path / "shards"))
    rows = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(r.text for r in rows.collect()) == Counter(r.text for r in docs.collect())
    files = rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    assert len(files) >= 16 and max(r.bytes for r in files) < 100_000
    assert sorted((r.shard, r.slot) for r in rows.collect()) == [(s, i) for s in range(16) for i in range(375)]
    files = lambda: set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/shards/*/shard=*/*.parquet"))
    before = files()
    got = queries.op3_shuffled_shards(spark, small_dir)
    assert got.count() == documents(spark, small_dir).count() and len(files() - before) >= 16


def brute_lines(docs, min_docs, keep_first):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    df = Counter(k for d in docs for k in {key(x) for x in (d.text or "").split("\n")})
    bad = {k for k, n in df.items() if k and n >= min_docs}
    first = {}
    for d in docs:
        for i, x in enumerate((d.text or "").split("\n")):
            if key(x) in bad:
                at = (d.doc_id if d.doc_id is not None else 1 << 63, i)
                first[key(x)] = min(first.get(key(x), at), at)
    out = []
    for d in docs:
        own = (d.text or "").split("\n")
        kept = [x for i, x in enumerate(own) if key(x) not in bad or keep_first and first[key(x)] == (d.doc_id, i)]
        out.append((d.doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("options", [{}, {"broadcast_rows": -1}, {"bits_per_key": 1}, {"broadcast_bits": 0}])
def test_lines(spark, small_dir, odd_docs, keep_first, options):
    for docs in (documents(spark, small_dir), odd_docs):
        made = lines.dedup_lines(docs, min_docs=10 if docs is odd_docs else 3, keep_first=keep_first, **options)
        assert set(docs.columns) <= set(made.columns)
        rows = sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in made.collect())
        assert rows == brute_lines(docs.collect(), 10 if docs is odd_docs else 3, keep_first)


def test_filters_are_sized_by_the_table(spark):
    assert lines.filter_size(0, 8) == (16, 4096) and lines.filter_size(10**6, 8) == (16, 1 << 19)
    slices, bits = lines.filter_size(4 * 10**11, 8)
    assert bits == 1 << 25 and slices * bits >= 32 * 10**11
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    packed = lines.line_keys(docs, 1)
    n = packed.agg(F.sum("n")).first()[0]
    times = Counter(d.digest for d in lines.suspects(packed, 1, 8, 1 << 28).where("line >= 0").select("digest").collect())
    once = sum(v == 1 for v in times.values())  # a filter of 8 bits suspects every key
    assert sum(times.values()) == n
    for slices, bits, most in ((*lines.filter_size(n, 8), 1 << 28), (64, 1 << 14, 0)):
        found = Counter(d.digest for d in lines.suspects(packed, slices, bits, most).select("digest").collect())
        assert {d for d, v in times.items() if v > 1} <= set(found) and all(found[d] == times[d] for d in found)
        assert sum(v == 1 for v in found.values()) < 0.05 * once


def brute_fingerprint(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, small_dir, odd_docs):
    copies = [(i, f"{' '.join(f'word{j}' for j in range(60))} end{i % 5}", "en", "s", 1) for i in range(3000, 3040)]
    for docs in (documents(spark, small_dir).unionByName(spark.createDataFrame(copies, "doc_id long, text string, lang string, source string, n_chars long")), odd_docs):
        rows = docs.collect()
        fp = [brute_fingerprint(r.text) for r in rows]
        group = brute_components(set(fp), lambda a, b: (a ^ b).bit_count() <= 3)
        least = {}
        for r, f in zip(rows, fp, strict=True):
            if r.doc_id is not None:
                least[group[f]] = min(least.get(group[f], r.doc_id), r.doc_id)
        want = sorted(str((r.doc_id, f"{f:016x}", least.get(group[f]))) for r, f in zip(rows, fp, strict=True))
        assert sorted(str(tuple(r)) for r in simhash.near_copies(docs).collect()) == want
        kept = simhash.without_near_copies(docs).collect()
        assert len(kept) == len(set(group.values()))
        assert {r.doc_id for r in kept} - {None} == set(least.values())


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_both_ways_to_compare_a_variant(most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique([int(base[i % 4]) ^ sum(1 << int(f) for f in rng.choice(20, rng.integers(0, 7), replace=False)) for i in range(300)]).astype(np.uint64)

    def parts(links):
        root = np.arange(len(fps))
        a, b = (np.searchsorted(fps, np.array([x[i] for x in links], np.uint64)) for i in (0, 1))
        shared.unite(root, a, b)
        return shared.find(root, np.arange(len(fps))).tolist()

    assert parts(simhash.flipped(fps, most)) == parts(simhash.forest(fps, most))
    assert simhash.flipped(np.array([0, 1, 3], np.uint64), 0) == []


def test_ids_must_be_longs(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for of in (lines.dedup_lines, simhash.near_copies, simhash.without_near_copies):
        with pytest.raises(TypeError, match="cast it to bigint"):
            of(docs)


def test_shards_of_maps(spark):
    docs = spark.range(300).selectExpr("id % 7 as doc_id", "'same' as text", "map('a', id % 3) as m", "array(map(1, 2)) as ms")
    for bucket in (8 << 20, 400):  # equal records that are dealt out by number, too
        rows = sharding.shuffled_shards(docs, bucket_bytes=bucket).collect()
        assert Counter((r.doc_id, r.m["a"]) for r in rows) == Counter((r.doc_id, r.m["a"]) for r in docs.collect())
        assert max(Counter(r.shard for r in rows).values()) == 19


def test_null_ids_spread_over_buckets(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "repeat('w ', 1 + id % 5) || id as text", "'s' as source")
    own = docs.select(mixing.own_key(docs))
    assert own.select((mixing.digest_number(own["_own"]) % 20).alias("b")).groupBy("b").count().agg({"count": "max"}).first()[0] < 1300
    check_mix(mixing.mix_plan(docs).collect())
    assert Counter(mixing.mixed(docs).collect()) == Counter(mixing.mixed(docs.repartition(5)).collect())


def test_simhash_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:3]:
        for _ in range(150):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            fps.add(int(b) ^ sum(1 << int(f) for f in flips))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    edges = {(e.a % (1 << 64), e.b % (1 << 64)) for e in edges}
    got = brute_components(fps, lambda a, b: (a, b) in edges or (b, a) in edges)
    parts = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    assert parts(got) == parts(want)
    hot = [(int(base[0]) & ~0xFFFFFFFF | int(x),) for x in np.unique(rng.integers(0, 1 << 12, 300))]
    hot = [(f - (1 << 64) if f >> 63 else f,) for (f,) in hot]
    for direct in (50, 1):  # variants of more fingerprints go by a second index
        of = spark.createDataFrame(signed + hot, "fp long").distinct()
        edges = {(e.a % (1 << 64), e.b % (1 << 64)) for e in simhash.links(of, direct=direct).collect()}
        whole = {f % (1 << 64) for (f,) in signed + hot}
        root = {f: f for f in whole}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in edges:
            root[find(a)] = find(b)
        assert parts({f: find(f) for f in whole}) == parts(brute_components(whole, lambda a, b: (a ^ b).bit_count() <= 3))
    low = np.array(sorted({int(base[0]) ^ sum(1 << int(x) for x in rng.choice(24, rng.integers(1, 6), replace=False)) for _ in range(400)}), np.uint64)
    want = parts(brute_components(low.tolist(), lambda a, b: (a ^ b).bit_count() <= 3))
    for made in (simhash.flipped(low, 3), simhash.forest(low, 3)):
        own = set(made)
        assert parts(brute_components(low.tolist(), lambda a, b: (a, b) in own or (b, a) in own)) == want


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, small_dir, odd_docs, ranks, library):
    for docs in (documents(spark, small_dir), odd_docs):
        want = sorted(str((r.doc_id, library.encode_ordinary(r.text or ""))) for r in docs.collect())
        made = bpe.decoded(bpe.encoded(docs, ranks, public_tokenizers.PATTERN), ranks)
        rows = made.collect()
        assert sorted(str((r.doc_id, r.ids)) for r in rows) == want
        assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
        digests = queries.bpe_digests(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
        of = lambda t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want = sorted(str((r.doc_id, len(of(r.text)) // 4, sha256(of(r.text)).hexdigest(), sha256((r.text or "").encode()).hexdigest())) for r in docs.collect())
        assert sorted(str(tuple(r)) for r in digests) == want


def test_steps_of_long_texts(ranks, library):
    """Texts that cross the steps of the fingerprint (2^16 shingles) and of the encoder (50,000 pieces)."""
    text = " ".join(f"w{i * 7919 % 1013}x{i % 17}" for i in range(70_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, most=500)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_every_character_and_long_pieces(ranks, library):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, most=500)
    ids = lambda text: np.frombuffer(encoder.encode(text), "<u4").tolist()
    for start in range(0, 0x110000, 97):
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, min(start + 97, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert ids(text) == library.encode_ordinary(text), hex(start)
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 30, 1000, 20_000):
        for letters in ("a", "ab", "abcdefghij", "é日x", " ", "="):
            text = "".join(rng.choice(list(letters), n))
            assert ids(text) == library.encode_ordinary(text)
