"""Collocations, source mixing and source divergence against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.llm import collocations, divergence, mixing, sketches, words
from graphquarry.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, rank int, _part int, size string"
WORDS = ["the", "of", "Ähre", "naïve", "x1", "ein", "日本", "O'Neil", "re-do", "THE"]


@pytest.fixture(scope="module")
def rows():
    g = random.Random(5)
    out = []
    for i in range(260):
        text = "".join(g.choice(WORDS[: 4 + i % 7]) + g.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(g.randrange(0, 40)))
        out.append([i, text, g.choice(["en", "en", "de", None]), g.choice(["a", "a", "a", "b", "é", "Z", None])])
    out[3][1] = out[4][1] = None
    out[5][1], out[6][1] = "", " \t\n.,"
    out[7][1] = "the of the of " * 3000  # longer than a shard, where those are small
    out += [out[8], out[8], [None, out[9][1], "en", "a"], [None, "the the", "xx", "lonely"], [500, None, "yy", "s"], [501, "", "yy", "t"]]
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_collocations(rows, least, top, share=80):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    held = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    best = collections.defaultdict(list)
    for (lang, p), a in held.items():
        if any(100 * b >= share * a for (other, q), b in held.items() if other == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        best[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in best.items() for n, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("shard", [300, 2 << 20])
@pytest.mark.parametrize("least", [3, 30])
def test_collocations(docs, rows, shard, least):
    want = brute_collocations(rows, least, 40)
    got = sorted(map(tuple, collocations.collocations(docs, least, 40, shard_bytes=shard).collect()))
    assert got == want and len(want) > 15


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_collocations_do_not_rest_on_hashes(docs, rows, monkeypatch):
    """Hashes of 5 bits: nearly all phrases share theirs, and nothing is ruled out."""
    whole = collocations.scramble
    monkeypatch.setattr(collocations, "scramble", lambda x: whole(x) & np.uint64(31))
    texts = [(r[2] or "und", lower(r[1]).encode()) for r in rows]
    a = collocations.Automaton(texts)
    counts = {(a.langs[a.lang[a.end[d - 1][k]]], a.phrase(d, k)): int(a.count[d - 1][k]) for d in (1, 2, 3, 4) for k in range(len(a.count[d - 1]))}
    f = collections.Counter()
    for lang, text in texts:
        for piece in re.split(b"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(b"[^\x20\x09]+", piece)
            for n in range(1, 5):
                f.update((lang, b" ".join(w[k : k + n])) for k in range(len(w) - n + 1))
    assert counts == f


def test_automaton_links():
    a = collocations.Automaton([("en", b"a b a b c. a b"), ("de", b"a b")])
    for d in (2, 3, 4):
        for k in range(len(a.count[d - 1])):
            p = a.phrase(d, k)
            came, link = int(a.came[d - 1][k]), int(a.link[d - 1][k])
            assert a.phrase(d - 1, came) == p.rpartition(b" ")[0] and a.phrase(d - 1, link) == p.partition(b" ")[2]
            assert a.count[d - 2][link] >= a.count[d - 1][k] <= a.count[d - 2][came]


def test_words_with_equal_hashes_have_their_own_numbers():
    w = words.Words([b"a b a c b a"])
    w.hash = np.zeros(6, np.uint64)
    number, first = w.numbered(np.arange(6), np.array([0, 0, 0, 0, 0, 1]))
    assert len(set(number[[0, 2]])) == 1 and len(set(number)) == 4 and sorted(number[first]) == [0, 1, 2, 3]


def test_slices():
    text = b"abc de, fghijkl. m" * 3
    for most in (1, 5, 100):
        got = list(words.slices(text, most, collocations.BREAK))
        assert b"".join(got) == text and all(x[:1] in b",." for x in got[1:])
    assert list(words.slices(b"abc" * 50_000, 10, collocations.BREAK))[0] == b"abc" * 50_000


def brute_divergence(rows, least, terms):
    n, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups.add((lang, source))
        n.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), k in docs.items() if x == lang and k >= least)
        own = sorted(s for x, s in groups if x == lang)
        total = {s: sum(n[lang, s, t] for t in kept) for s in own}
        p = {s: {t: 1 + 10**9 * (n[lang, s, t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in own}
        q = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in own) + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for s in own:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(far)]
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s, t] and p[s][t] > q[t])[:terms]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(more)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "sources"), [(300, 2), (2 << 20, 1024)])
@pytest.mark.parametrize("least", [2, 30, 10_000])
def test_divergence(docs, rows, monkeypatch, shard, sources, least):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    want = brute_divergence(rows, least, 3)
    assert sorted(map(tuple, divergence.divergence(docs, least, 3, shard_bytes=shard).collect())) == want
    assert len({x[2] for x in want}) == (1 if least == 10_000 else 2)


def test_divergence_of_nothing(docs):
    assert divergence.divergence(docs.limit(0)).count() == 0
    none = divergence.divergence(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert none and all(r["value"] == 0 and r["part"] == "pair" for r in none)


def test_divergence_is_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "n long, total long, v long")
    assert df.select(divergence.probability(F.col("n"), "total", "v")).first()[0] == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


@pytest.mark.parametrize("bits", [4, 16])
def test_sketch_never_underestimates(bits):
    g = np.random.default_rng(2)
    h = words.scramble(np.minimum(g.geometric(0.01, 5000), 400).astype(np.uint64))
    parts = []
    for x in np.array_split(h, 3):
        c = sketches.Counts(bits)
        c.add(x)
        parts.append(np.minimum(c.data, 255).astype(np.uint8))
    whole = sketches.Counts(bits, sketches.capped_sum(sketches.capped_sum(parts[0], parts[1]), parts[2]))
    value, n = np.unique(h, return_counts=True)
    assert whole.at_least(value, 30)[n >= 30].all()
    if bits == 16:
        assert not whole.at_least(value, 30)[n < 20].any()


def test_members(spark):
    values = [int(x) for x in words.scramble(np.arange(3000, dtype=np.uint64)).view(np.int64)]
    made = sketches.Members.of(spark.createDataFrame([(x,) for x in values], "hash long").repartition(7), 3000)
    assert made.has(np.array(values).view(np.uint64)).all()
    assert made.has(words.scramble(np.arange(10_000, 60_000, dtype=np.uint64))).mean() < 0.01
    assert not sketches.Members.of(spark.createDataFrame([], "hash long"), 0).has(np.array([1, 2], np.uint64)).any()


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        share = {s: Fraction(rest * w[s], sum(w[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    g = random.Random(seed)
    sizes = {g.choice(["é", "Z", "a", "\U0001f600", "￮", "b", ""]) + str(k): g.choice([0, 1, 3, 50, 1000, 10**13]) for k in range(g.randrange(1, 9))}
    if seed % 2:
        sizes[None] = g.choice([0, 5, 700])
    want = brute_targets(sizes, (5, 2, 1), 3)
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) <= 1e-9 * float(want[s]) for s in want)


def test_knapsack_comes_as_near_as_any_choice():
    g = random.Random(1)
    for _ in range(200):
        lengths = np.array(sorted(g.sample(range(1, 30), g.randrange(1, 5))))
        counts = np.array([g.randrange(1, 4) for _ in lengths])
        budget = g.randrange(0, int((lengths * counts).sum()) + 1)
        best = min(abs(sum(a * x for a, x in zip(lengths.tolist(), k, strict=True)) - budget) for k in itertools.product(*[range(c + 1) for c in counts.tolist()]))
        for reach in (0, 20, mixing.REACH):
            got = mixing.fitted(lengths, counts, budget, reach)
            assert (got >= 0).all() and (got <= counts).all() and abs(int((got * lengths).sum()) - budget) <= max(best, 0 if reach == mixing.REACH else 30)


@pytest.mark.parametrize(("bucket", "reach"), [(4, 10), (8192, 1 << 16)])
def test_mix(docs, rows, bucket, reach):
    sizes = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _, _ in rows]
    own = collections.Counter()
    for r, n in zip(rows, sizes, strict=True):
        own[r[3]] += n
    want = brute_targets(own, (5, 2, 1), 3)
    mixed = lambda df: sorted(map(tuple, mixing.mix(df, bucket_docs=bucket, reach=reach).collect()), key=str)
    got = mixed(docs)
    assert sorted((r[0] or -1, r[1], r[2]) for r in got) == sorted((r[0] or -1, n, own[r[3]]) for r, n in zip(rows, sizes, strict=True))
    assert all(t == 0 if not n else t in (0, n, 2 * n, 3 * n) for _, n, _, _, t in got)
    taken, target = collections.Counter(), {}
    for _, _, size, goal, t in got:
        taken[size] += t
        target[size] = goal
    for s, goal in want.items():
        assert abs(target[own[s]] - float(goal)) < 1e-6
        coarse = reach == 10 or s in ("lonely", rows[7][3])  # a source whose one document has most of its words
        assert abs(taken[own[s]] - goal) <= (12_000 if coarse else 1)
    assert mixed(docs.repartition(3)) == got


def test_mix_of_one_length(spark):
    """Nearly all documents in one group, whose documents are chosen bucket by bucket."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2900, "b").otherwise("a").alias("source"))
    got = mixing.mix(df.unionByName(df.filter("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long"))), bucket_docs=16)
    by = {r["source_size"]: (r["n"], r["taken"], r["target"]) for r in got.groupBy("source_size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert by == {300: (100, 900, 900.0), 8715: (2905, 8115, 8115.0)}


def test_mix_of_nothing(docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {(r["taken"], r["target"]) for r in mixing.mix(docs.withColumn("text", F.lit(" "))).collect()} == {(0, 0.0)}


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in QUERIES}


def test_documents_go_to_workers_in_small_batches(spark, monkeypatch):
    import public_tokenizers

    from graphquarry.llm import packing, substring_dedup
    from graphquarry.plans.storage import byte_size

    seen = {}
    for module, table in ((packing, "pieces"), (substring_dedup, "chunks")):
        write = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, write=write: seen.update({name: byte_size(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))}) or write(df, name))
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 2
    assert substring_dedup.substring_dedup(docs).count() == 2
    assert seen["pieces"] == packing.BATCH_BYTES and seen["chunks"] == substring_dedup.BATCH_BYTES
