"""Tokenizer alignment, conversation repair and language identification against brute force, and their odd tables."""

import random
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from arealoom.llm import align, language, queries, repair
from arealoom.llm.shared import staged

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TURNS = "conv_id long, turn long, role string, text string"


# Alignment


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) from whole texts."""
    own = align.Aligner(*PATHS)
    made, counts = [], Counter()
    for t in texts:
        a, b = own.a.encode(f" {t}", add_special_tokens=False).ids, own.b.encode(t or "")
        data = f" {t}".encode()
        if not t or b"".join(own.a_bytes[i] for i in a) != data or b"".join(own.b_bytes[i] for i in b) != data:
            made.append(None)
            continue
        of_a, of_b = ({end: i for i, end in enumerate(np.cumsum([len(held[i]) for i in ids]).tolist())} for held, ids in ((own.a_bytes, a), (own.b_bytes, b)))
        cuts, groups, links, x, y = sorted(of_a.keys() & of_b.keys()), [], [], 0, 0
        for c in cuts:
            i, j = of_a[c] + 1, of_b[c] + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.append((a[i - 1], b[j - 1]))
            x, y = i, j
        counts.update(links)
        made.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for m in made:
        if m is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = m
            yield a, b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups)


ODD_TEXTS = [None, "", " ", "a", "  two  spaces  ", "tab\tand\nline \n end ", "<|endoftext|> </s> <s>", "▁ a ▁b", "é ü 漢字かな 🙂 \U0001f468‍\U0001f469", "x" * 3000, "no end" * 500, "a b c d 　e", "it's we'll  I'M", "\x00 \x1c \x85", "same", "same"]


def test_alignment(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD_TEXTS, 1)] + [(None, "null id")], "doc_id long, text string")
    docs = docs.union(odd).selectExpr("*", "'x' as groups", "1 as n_a", "map('a', 1) as `row`").repartition(5)
    tokens = staged(align.encoded(docs, *PATHS))
    rows = align.aligned(tokens, align.pair_table(tokens, *PATHS), *PATHS).collect()
    want = list(brute_alignment([r.text for r in rows]))
    assert [tuple(r[c] for c in (*align.NUMBERS, "groups")) for r in rows] == want
    assert {r.row["a"] for r in rows} == {1} and len(rows) == docs.count()
    none = align.encoded(docs.where("false"), *PATHS)
    assert align.aligned(none, align.pair_table(none, *PATHS), *PATHS).count() == 0


def test_alignment_query(spark, small_dir):
    rows = {r.doc_id: r for r in queries.op11_align_tokenizers(spark, small_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for i, want in zip(texts, brute_alignment(texts.values()), strict=True):
        assert tuple(rows[i][c] for c in align.NUMBERS) == want[:-1]
        assert rows[i].groups_sha256 == (sha256(want[-1].encode()).hexdigest() if want[-1] else "")


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        made = align.PerfectHash(keys)
        assert sorted(made.verified(keys)) == list(range(len(keys)))
        with pytest.raises(ValueError, match="did not see"):
            made.verified(np.array([1 << 50]))


def test_pairs_stay_below_their_bound_and_sums_take_levels(spark, small_dir, monkeypatch):
    docs = staged(align.encoded(spark.read.parquet(f"{small_dir}/documents.parquet").repartition(9), *PATHS))
    whole = align.pair_table(docs, *PATHS)
    assert len(whole.counts) < align.Aligner(*PATHS).most_pairs() < 400_000
    monkeypatch.setattr(align, "FAN", 2)
    monkeypatch.setattr(align, "SLOTS", 1000)
    again = align.pair_table(docs, *PATHS)
    assert (again.counts == whole.counts).all() and (again.best == whole.best).all()


def test_long_texts_are_cut_where_no_token_lies_across(monkeypatch):
    own = align.Aligner(*PATHS)
    rng = random.Random(5)
    words = ["it's", "we'll", "été", "漢字", "a", "I", "12345", "--", "  ", "\n", "\n\n", "\t", "x" * 40, "e\u0301", "don't", "🙂", "."]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", ""]) for _ in range(200)) for _ in range(60)]
    whole = [(own.a.encode(f" {t}", add_special_tokens=False).ids, own.b.encode(t)) for t in texts]
    for most in (1, 30, 1 << 16):
        monkeypatch.setattr(align, "LONG", most)
        for t, (a, b) in zip(texts, whole, strict=True):
            made = own.encoded(t)
            kept = b"".join(own.a_bytes[i] for i in a) == f" {t}".encode() == b"".join(own.b_bytes[i] for i in b)
            assert (made is not None) == kept
            if kept:
                assert [np.frombuffer(x, own.width).tolist() for x in made] == [a, b]
    assert len(own.segments(" a b c" * 10)) == 1
    monkeypatch.setattr(align, "LONG", 1)
    assert len(own.segments(" a b c" * 10)) > 10


# Repair


def brute_repair(rows):
    """Per conversation the contract's columns."""
    sys.setrecursionlimit(20_000)
    per = defaultdict(list)
    for c, turn, role, text in rows:
        own = per[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    space = " \t\n\x0b\x0c\r"
    for c, own in per.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(space)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

        @lru_cache(None)
        def best(i, done):
            """(cost, audit, lines) of the rest, after the initials `done` (its last two letters at most)."""
            ways = [] if done in ("s", "u") else [(0, "", ())] if i == len(own) else []
            wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[done]
            name = {"u": "user", "a": "assistant"}[wanted]
            if inserts[0] < 3:
                inserts[0] += 1
                cost, audit, lines = best.__wrapped__(i, wanted)
                inserts[0] -= 1
                ways.append((cost + 2, "I" + audit, (f"{name}:", *lines)))
            if i < len(own):
                held, inserts[0] = inserts[0], 0
                _, role, text = own[i]
                cost, audit, lines = best(i + 1, done)
                ways.append((cost + 3, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    late = int(faults[i] == "truncated")
                    if role[:1] == wanted or (role[:1] == "s" and done == ""):
                        cost, audit, lines = best(i + 1, role[:1])
                        ways.append((cost + late, "K" + audit, (f"{role}:{text}", *lines)))
                    cost, audit, lines = best(i + 1, wanted)
                    ways.append((cost + late + 2, "R" + audit, (f"{name}:{text}", *lines)))
                inserts[0] = held
            return min(ways) if ways else (10**9, "", ())

        inserts = [0]
        cost, audit, lines = best(0, "") if own else (0, "", ())
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()


def odd_turns(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "no end", "", " \t\n", None, "What?  ", "Same.", "Same.", "é…", " "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "sys", "u"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(9))]
    rows += [(None, t, r, "Hi.") for t, r in enumerate(["user", "assistant"])] + [(70, 3, "user", "a b " * 30_000 + ".")]
    rows += [(71, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)]
    return spark.createDataFrame(rows, TURNS).withColumns({"word": F.lit(1), "pos": F.lit("x")})


@pytest.mark.parametrize("piece", [12, 1])
def test_repair(spark, small_dir, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    for turns in (odd_turns(spark).repartition(4), spark.read.parquet(f"{small_dir}/conversations.parquet"), odd_turns(spark).where("false")):
        got = repair.repair(repair.damaged(turns), turns)[0].collect()
        want = brute_repair([tuple(r)[:4] for r in turns.collect()])
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "so")], TURNS)
    made, left = repair.repair(rows)
    assert made.first().audit == "IKKDR" and made.first().cost == 8
    assert [tuple(r)[1:] for r in left.orderBy("step").collect()] == [(0, "I", "user", ""), (1, "K", "assistant", "Hello."), (2, "K", "user", "Hi."), (3, "D", "user", "Hi."), (4, "R", "assistant", "so")]


def test_automaton_shares_suffixes():
    words = ["".join(random.Random(i).choices("suaoSUAOx", k=i % 9)) for i in range(300)]
    one, steps = repair.Automaton(), 0
    for w in sorted(words, key=lambda x: x[::-1]):
        kept, got = list(one.costs), one.read(w)
        steps += sum(a is not b for a, b in zip(kept, one.costs))
        assert got == repair.Automaton().read(w)
    assert len(one.steps) < 120  # a step depends on the letter and on the differences of costs alone


# Language


def brute_languages(docs, training):
    def grams(text):
        found = Counter()
        for w in regex.findall(r"\p{L}+", (text or "").lower()):
            marked = f"\0{w}\0"
            found.update(w)
            found.update(marked[i : i + 2] for i in range(len(w) + 1))
            found.update(marked[i : i + 3] for i in range(len(w)))
        return found

    def key(g):
        # a border that ends an n-gram sorts after all letters, one that is not there before
        code = [0x1FFFFF if c == "\0" and i == len(g) - 1 else ord(c) for i, c in enumerate(g)]
        return code + [0] * (3 - len(code))

    def ranks(found):
        return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], key(x[0])))[:300]]

    counts = defaultdict(Counter)
    for lang, text in training:
        if lang is not None:
            counts[lang].update(grams(text))
    known = {lang: {g: i for i, g in enumerate(ranks(c))} for lang, c in counts.items() if c}
    for text in docs:
        own = ranks(grams(text))
        if not own or not known:
            yield "und", 0.0
            continue
        away = sorted((sum(abs(i - p[g]) if g in p else 300 for i, g in enumerate(own)), lang) for lang, p in known.items())
        near, second = away[0][0], away[1][0] if len(away) > 1 else None
        yield away[0][1], 1.0 if second is None else 0.5 if near == second else second / (near + second)


def test_languages(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, None), (-2, "", "en"), (-3, "123 . !", None), (-4, "ΣΑΣ ΟΔΟΣ İstanbul ß", "xx"), (-5, "漢字かな交じり文", "yy"), (-6, "a", None), (None, "the and of", "en"), (-7, "\x00퟿ éte", None)]
    odd += [(-8 - i, f"mot{i} le la", f"l{i:02}") for i in range(12)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' as score", "map(1, 2) as `a.b`", "lang as found").repartition(3)
    training = docs.where("coalesce(doc_id, 0) % 4 <> 2")
    rows = docs.collect()
    want = list(brute_languages([r.text for r in rows], [(r.lang, r.text) for r in training.collect()]))
    for block, size in ((64, 1 << 20), (5, 700)):
        monkeypatch.setattr(language, "SLICE", size)
        got = language.identified(docs, language.profiles(training), block=block).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.lang_pred, r.score) for r in got} == {r.doc_id: (x, pytest.approx(s)) for r, (x, s) in zip(rows, want, strict=True)}
    assert {r.lang_pred for r in language.identified(docs, language.profiles(training.where("false"))).collect()} == {"und"}
    assert language.identified(docs.where("false"), language.profiles(training)).count() == 0


def test_language_query(spark, small_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.op13_language(spark, small_dir).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    want = dict(zip(docs, brute_languages([r.text for r in docs.values()], [(r.lang, r.text) for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2]), strict=True))
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows} == {i: (x, pytest.approx(s)) for i, (x, s) in want.items()}
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_letters():
    table = language.letters()
    assert all(table[c] == unicodedata.category(chr(c)).startswith("L") for c in range(0, 0x30000, 7))
