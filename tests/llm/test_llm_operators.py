"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from graphquarry.llm import bpe, exact_dedup, language_id, near_dup, packing, quality, substring_dedup, topk, toxicity, warc
from graphquarry.llm.queries import ORACLES, QUERIES, remainder
from graphquarry.llm.words import Words
from graphquarry.plans import storage

G = random.Random(11)
VOCABULARY = ["".join(G.choice("aeioubcdlmnrst") for _ in range(G.randrange(2, 9))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, words int, score double"


def prose(n, g=G):
    return " ".join(g.choice(VOCABULARY) for _ in range(n))


def corpus():
    shared = prose(40)
    texts = [prose(G.randrange(3, 120)) for _ in range(60)]
    base = prose(100).split()
    for k in range(12):  # near copies of one text
        w = list(base)
        for _ in range(k % 4):
            w[G.randrange(len(w))] = G.choice(VOCABULARY)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[3].upper(), texts[5] + "\n" + shared, shared + " " + texts[7], "x " * 30 + shared, "be " * 40, "be " * 40]
    texts += [None, "", "   \n", "one", "one", "ünï çödé — 日本語 🙂\t\tend", "a\x1cb\x85c\xa0d e", prose(30_000), "A B C", "a b c"]
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, None if i % 9 == 0 else "en", "s", 0, "d", 1, 0.5) for i, t in enumerate(TEXTS)]
    rows.append(rows[2])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def text_of(i):
    return TEXTS[(i - 1) // 3]


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_packing(docs, empty):
    e = encoding()
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True).collect()
    pieces, bins = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 <= 1024
        pieces[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, found in pieces.items():
        ids = np.array([*e.encode_ordinary(text_of(i) or ""), 2], "<u4").tobytes()
        assert b"".join(found[k]["ids"] for k in range(len(found))) == ids
        assert all(found[k]["length"] == 1024 for k in range(1, len(found)))
        assert [found[k]["start"] for k in range(len(found))] == list(np.cumsum([0, *(found[k]["length"] for k in range(len(found) - 1))]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(rows) == sum(len(x) for x in pieces.values()) + 1 and len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


@pytest.mark.parametrize("with_ids", [False, True])
def test_packing_in_many_groups(spark, monkeypatch, with_ids):
    """Lengths of many groups, a hot null id and rows that repeat leave every sequence gapless."""
    monkeypatch.setattr(packing, "GROUP", 5)
    monkeypatch.setattr(packing, "GROUP_BYTES", 2 * 4 * 1024)
    texts = [" a" * (2500 + k % 3) for k in range(30)] + [" b" * (k % 4) for k in range(60)]
    rows = [(None if k % 3 else k, t) for k, t in enumerate(texts)] + [(0, texts[0])] * 2
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=with_ids).collect()
    assert sum(r["length"] for r in got) == sum(len(t) // 2 + 1 for _, t in rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024
    sizes = collections.Counter(r["length"] for r in got)
    assert packing.salts(sizes, 1024, with_ids)[1023] == -(-sizes[1024] // (3 if with_ids else 5))


def test_ids_equal_those_of_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.WordTokens(P.path("byte_bpe_50k.json"), P.PATTERN)
    texts = ["see <|endoftext|> here", "<|endoftext|>", "<|endoftext|><|endoftext|>  a", "a \n<|endoftext|>\n b's", "<|endoftext |> <|endoftext|", *(t for t in TEXTS[:80] if t)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_plan_is_as_good_as_best_fit_decreasing():
    g = random.Random(2)
    for _ in range(100):
        sizes = [g.choice((g.randrange(1, 1025), g.randrange(1, 200), 512, 341, 342)) for _ in range(g.randrange(1, 400))]
        slots = packing.plan(dict(collections.Counter(sizes)))
        bins = collections.defaultdict(int)
        for length, a, b, s, _ in slots:
            for k in range(b - a):
                bins[s + k] += length
        assert sum(bins.values()) == sum(sizes) and max(bins.values()) <= 1024
        best: list[int] = []
        for n in sorted(sizes, reverse=True):
            fit = [k for k, x in enumerate(best) if x + n <= 1024]
            if fit:
                best[max(fit, key=lambda k: best[k])] += n
            else:
                best.append(n)
        assert len(bins) <= len(best) + 1


def test_bpe(docs, empty):
    e = encoding()
    path, n = P.path("byte_bpe_50k.tiktoken"), 0
    found = bpe.encode(docs, path, P.PATTERN)
    for r in found.collect():
        want = e.encode_ordinary(text_of(r["doc_id"]) or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        n += 1
    assert n == len(TEXTS) + 1
    for r in bpe.decode(found, path, P.PATTERN).collect():
        assert r["decoded"].decode() == (text_of(r["doc_id"]) or "")
    for r in bpe.round_trip(docs, path, P.PATTERN).collect():
        assert r["decoded_sha256"] == hashlib.sha256((text_of(r["doc_id"]) or "").encode()).hexdigest()
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_replay_agrees_with_the_library_on_random_bytes():
    e, g = encoding(), random.Random(4)
    v = bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["".join(g.choice("aabethn  \n'sé1!") for _ in range(g.randrange(0, 60))) for _ in range(800)] + ["a" * 999]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_all(texts)] == [e.encode_ordinary(t) for t in texts]


def shingles(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def joined(ids, links):
    """The least id of each id's component."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def brute_classes(sets):
    ids = [i for i in sets if sets[i]]
    return joined(sets, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_near_dedup(docs, empty):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1
    assert {r["doc_id"]: r["group_id"] for r in got} == brute_classes({i * 3 + 1: shingles(t) for i, t in enumerate(TEXTS)})
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in got)
    assert near_dup.near_duplicates(empty).count() == 0


def test_probminhash_estimates_weighted_similarity():
    g = np.random.default_rng(1)
    a, b = g.integers(0, 1 << 63, 300, dtype=np.uint64), None
    b = np.r_[a[:250], g.integers(0, 1 << 63, 50, dtype=np.uint64)]
    wa, wb = np.ones(300), np.ones(300)
    s = near_dup.signatures([a, b], [wa, wb], 1000)
    assert abs((s[0] == s[1]).mean() - 250 / 350) < 0.05
    assert (near_dup.signatures([a[:1]], [wa[:1] * 7], 50) == a[0]).all()


def test_near_dedup_where_a_line_repeats(spark):
    """Pairs at a Jaccard of 100/124, one of each holding a line many times over."""
    g, rows = random.Random(21), []
    for k in range(24):
        words = [f"w{k}x{j}" for j in range(124)]
        g.shuffle(words)
        rows += [(2 * k, " ".join(words[:104])), (2 * k + 1, " ".join(words[:104] + words[104:] * (50, 200)[k % 2]))]
        assert len(shingles(rows[-1][1]) & shingles(rows[-2][1])) == 100 and len(shingles(rows[-1][1])) == 124
    got = as_dict(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["group_id"] for i, r in got.items()} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize(("salted", "share"), [(3, 0.002), (3, 1.0), (2048, 0.0)])
def test_near_dedup_deals_large_buckets(spark, monkeypatch, salted, share):
    """One large group of near copies beside dissimilar texts that share most of their words."""
    monkeypatch.setattr(near_dup, "SALTED", salted)
    monkeypatch.setattr(near_dup, "HOT_SHARE", share)
    g = random.Random(17)
    base, frame = [f"b{k}" for k in range(90)], [f"f{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        w[g.randrange(90)] = f"x{k}"
        rows.append((k, " ".join(w)))
        rows.append((100 + k, " ".join(frame + [f"y{k}z{j}" for j in range(20 + k % 3)])))
    got = as_dict(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=40, rows=2))
    assert {i: r["group_id"] for i, r in got.items()} == brute_classes({i: shingles(t) for i, t in rows})


def test_near_dedup_where_ids_repeat(spark):
    near, other = prose(80), prose(60)
    rows = [(1, near), (2, near + " end"), (2, other), (2, other), (3, other + " end"), (None, near)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dup.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or 0, r["group_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False)]
    assert len({r["class_id"] for r in got if r["doc_id"]}) == 2
    left = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(0, near), (1, near), (2, other), (2, other)])


def weighted_similarity(a, b):
    """Probability Jaccard, term by term."""
    out = 0.0
    for i in a.keys() & b.keys():
        out += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    return out


def test_near_dedup_of_weighted_shingles(spark):
    g, texts = random.Random(23), []
    for _ in range(12):
        words, line = [f"w{g.randrange(10**6)}" for _ in range(60)], [f"l{g.randrange(10**6)}" for _ in range(8)]
        texts += [" ".join(words + line * k) for k in (1, 2, 3, 8, 30, 33)]
    counts = {i: collections.Counter(tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)) for i, t in enumerate(texts)}
    similar = lambda a, b: weighted_similarity(counts[a], counts[b])
    for a, b in ((0, 1), (1, 4), (4, 5), (0, 6)):
        keys = sorted(counts[a].keys() | counts[b].keys())
        at = {x: n for n, x in enumerate(keys)}
        one, two = (sorted((at[x], float(n)) for x, n in counts[i].items()) for i in (a, b))
        got = near_dup.probability_jaccard(*(np.array(x) for x in zip(*one, strict=True)), *(np.array(x) for x in zip(*two, strict=True)))
        assert abs(got - similar(a, b)) < 1e-9
    links = [(a, b) for a in counts for b in counts if a < b and similar(a, b) >= 0.8]
    sets = {i: {i} for i in counts}
    assert len(links) > 12 and any((a, b) not in links for a in range(6) for b in range(a + 1, 6))
    got = as_dict(near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weighted=True))
    assert {i: r["group_id"] for i, r in got.items()} == joined(sets, links)


def brute_substring(rows, n=13):
    first = {}
    for i, words in rows:
        for k in range(len(words) - n + 1):
            key = tuple(words[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in rows:
        gone = {p for k in range(len(words) - n + 1) if first[tuple(words[k : k + n])] < i for p in range(k, k + n)}
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_substring_dedup(docs, empty, chunk):
    rows = [(i * 3 + 1, (t or "").encode().split()) for i, t in enumerate(TEXTS)]
    got = substring_dedup.substring_dedup(docs, chunk_bytes=chunk).collect()
    assert sorted(map(tuple, got)) == brute_substring([*rows, rows[2]])
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("mask", [0xFFFF << 48, 0xF000 << 48])
def test_substring_dedup_where_hashes_collide(docs, spark, mask):
    """Windows' hashes cut to 16 and to 4 bits: nearly every window shares its hash with others."""
    g = random.Random(12)
    rows = [(i, " ".join(g.choice("abcd") for _ in range(g.randrange(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(df, window=6, chunk_bytes=300, mask=mask).collect()
    assert sorted(map(tuple, got)) == brute_substring([(i, t.encode().split()) for i, t in rows], 6)
    own = [(i * 3 + 1, (t or "").encode().split()) for i, t in enumerate(TEXTS)]
    got = substring_dedup.substring_dedup(docs, chunk_bytes=4000, mask=mask).collect()
    assert sorted(map(tuple, got)) == brute_substring([*own, own[2]])


@pytest.mark.parametrize("common", [0, 2, 8])
@pytest.mark.parametrize("window", [5, 6, 13])
def test_passages_are_located_wherever_they_occur(monkeypatch, common, window):
    monkeypatch.setattr(substring_dedup, "COMMON", common)
    g = random.Random(window)
    for letters in ("ab", "abcdefgh"):
        texts = [" ".join(g.choice(letters) for _ in range(g.randrange(0, 60))) for _ in range(20)]
        cut = [t.split()[a : a + window + g.randrange(0, 12)] for t in texts[:8] for a in [g.randrange(0, 20)]]
        held = [" \n".join(x).encode() for x in cut if len(x) >= window]
        ranks = list(range(-1, len(held) - 1))
        words = Words([t.encode() for t in texts])
        got = collections.defaultdict(set)
        for part, own in substring_dedup.shards(held, ranks, window):
            for at, rank in zip(*(x.tolist() for x in substring_dedup.Passages(part, own, window).located(words)), strict=True):
                got[at].add(rank)
        flat = [(k, w) for k, t in enumerate(texts) for w in t.split()]
        for at in range(len(flat)):
            here = flat[at : at + window]
            phrase = [w for _, w in here] if len({k for k, _ in here}) == 1 and len(here) == window else None
            want = {r for x, r in zip([h.decode().split() for h in held], ranks, strict=True) for k in range(len(x) - window + 1) if x[k : k + window] == phrase}
            assert bool(want) == bool(got[at]) and got[at] <= want and (not want or min(want) in got[at])


def test_substring_dedup_on_few_words(spark):
    g = random.Random(8)
    rows = [(i, " ".join(g.choice("ab") for _ in range(g.randrange(0, 40)))) for i in range(150)]
    df = spark.createDataFrame(rows + [(None, rows[5][1])], "doc_id long, text string")
    got = substring_dedup.substring_dedup(df, window=6, chunk_bytes=150).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute_substring([(i, t.encode().split()) for i, t in rows], 6)
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]


def test_substring_dedup_of_long_passages_of_different_words(spark):
    """More different words in one recurring passage than there are characters to number them with."""
    n = 1_200_000
    text = " ".join(f"{k:x}" for k in range(n))
    df = spark.createDataFrame([(1, text), (2, "before " + text + " behind"), (3, "x")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (n, 0), 2: (n + 2, n), 3: (1, 0)}


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_cut_passages_hold_every_window(most):
    g = random.Random(3)
    held = [" ".join(g.choice(VOCABULARY) for _ in range(n)).encode() for n in (13, 20, 300)]
    made, ranks = substring_dedup.cut(held, [4, 5, 6], 13, most)
    windows = lambda x, r: {(r, tuple(x.split()[k : k + 13])) for k in range(len(x.split()) - 12)}
    assert set().union(*map(windows, held, [4, 5, 6])) == set().union(*map(windows, made, ranks))
    assert all(len(x) <= most or len(x.split()) == 13 for x in made)


def test_substring_dedup_of_a_window_in_every_chunk(spark, monkeypatch):
    """Ranges of chunks matched in groups, and then the groups' firsts, give what one group gives."""
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 2000)
    g = random.Random(21)
    common = prose(20, g)
    rows = [(i, prose(g.randrange(0, 30), g) + " " + common + " " + prose(5, g)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_substring([(i, t.encode().split()) for i, t in rows])
    for ranges in (1, 3, 1000):
        assert sorted(map(tuple, substring_dedup.substring_dedup(df, chunk_bytes=300, group_ranges=ranges).collect())) == want


def test_words():
    texts = [b"", b" a  bb\x0bccc\n", b"a\x1cb\x00 c", b"bb"]
    w = Words(texts)
    assert [w.data[a:b] for a, b in zip(w.begin, w.end, strict=True)] == [x for t in texts for x in t.split()]
    assert w.hash[1] == w.hash[-1] and len(set(w.hash.tolist())) == 5


def test_exact_dedup(spark, docs, empty):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = collections.defaultdict(list)
    for i, t in enumerate([*TEXTS, TEXTS[2]]):
        groups[norm(t)].append(i * 3 + 1 if i < len(TEXTS) else 7)
    for r in exact_dedup.exact_dedup(docs).collect():
        own = groups[norm(text_of(r["doc_id"]))]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(norm(text_of(r["doc_id"])).encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_one(docs).count() == len(groups)
    index = exact_dedup.DigestIndex(spark, buckets=3)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(0, "A"), (9, "c"), (8, "C")], "doc_id long, text string")
    assert all(r["kept"] for r in exact_dedup.exact_dedup(one, index).collect())
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(two, index).collect()} == {0: (1, False), 9: (9, True), 8: (9, False)}
    assert {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(one, index).collect()} == {1: False, 2: False}
    assert index.table().count() == 3
    path = index.path
    index.drop()
    assert path.startswith(storage.shared_dir(spark)) and not storage.exists(spark, path)


def test_exact_dedup_leaves_no_index_when_a_batch_fails(spark, docs, monkeypatch):
    def broken(self, digests):
        raise RuntimeError("lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "append", broken)
    tables, files = {t.name for t in spark.catalog.listTables()}, {x for x in storage.children(spark, storage.shared_dir(spark)) if x.startswith("digest-index")}
    with pytest.raises(RuntimeError, match="lost"):
        exact_dedup.exact_dedup(docs)
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert {x for x in storage.children(spark, storage.shared_dir(spark)) if x.startswith("digest-index")} == files


def test_exact_dedup_anti_joins_each_batch_with_the_index(spark, docs, monkeypatch):
    index, plans, sizes = exact_dedup.DigestIndex(spark, buckets=4), [], []
    unseen = exact_dedup.DigestIndex.unseen

    def watched(self, digests):
        out = unseen(self, digests)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        sizes.append((digests.count(), out.count()))
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "unseen", watched)
    tables = {t.name for t in spark.catalog.listTables()}
    for batches in (1, 3, 7):
        got = exact_dedup.exact_dedup(docs, batches=batches).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {t.name for t in spark.catalog.listTables()} == tables  # an index of our own doesn't stay
    assert len(plans) >= 1 + 3 + 7 and any(new < n for n, new in sizes)
    for p in plans:
        assert "SortMergeJoin" in p and "LeftAnti" in p
        index_side = p[p.index("LeftAnti") :].split("FileScan")[-1]
        assert "Bucketed: true" in index_side
    index.drop()


def test_exact_dedup_chooses_the_same_of_repeated_rows(spark):
    rows = [(1, "a b", x) for x in "cab"] + [(2, "A B", x) for x in "zyx"] + [(3, "own", "q")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3 + seed)
        assert sorted(map(tuple, exact_dedup.keep_one(df).collect())) == [(2, "A B", "x"), (3, "own", "q")]


def test_warc(spark):
    long = "<p>é</p>" * 50
    rows = [(5, "http://a/ b\n", long), (2, None, long), (9, "u", "x" * 99), (8, "u", "x" * 99), (1, "u", None), (3, "u", ""), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (None, "u", long), (2, "v", long)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string")
    got = collections.defaultdict(list)
    for r in warc.round_trip(pages, archive_bytes=300, payloads=True).collect():
        got[r["page_id"]].append(r)
    first = {t: min(i for i, _, h in rows if h == t and i is not None) for t in {r[2] for r in rows} if t and len(t.encode()) >= 100}
    assert sum(map(len, got.values())) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        for r in got[i]:
            revisit = i is not None and html in first and i != first[html]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if revisit else ("response", None))
            assert r["payload"] == (None if revisit else data)
    facts = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = [tuple(r[c] for c in facts) for rows in got.values() for r in rows]
    assert sorted(map(str, whole)) == sorted(str(tuple(r[c] for c in facts)) for r in warc.round_trip(pages, archive_bytes=300).collect())
    assert warc.round_trip(pages.limit(0)).count() == warc.round_trip(pages.limit(0), payloads=True).count() == 0


def test_warc_records_by_the_index(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(40)] + [(7, "u", "another " * 30)], "page_id long, url string, html string")
    raw, fine = f"file://{tmp_path}/raw", f"file://{tmp_path}/fine"
    warc.write_archives(pages, raw, archive_bytes=2000)
    warc.normalise(spark, raw, fine)
    asked = spark.createDataFrame([(7,), (31,), (99,), (None,), (7,)], "page_id long")
    want = sorted([(7, b"page 7 " * 30), (7, b"another " * 30), (31, b"page 31 " * 30)])
    facts = lambda df: sorted((r["page_id"], bytes(r["payload"])) for r in df.collect())
    assert facts(warc.read_records(spark, fine, asked)) == want
    monkeypatch.setattr(warc, "LOOKUP_PAGES", 1)
    assert facts(warc.read_records(spark, fine, asked)) == want
    assert warc.read_records(spark, fine, asked.filter("page_id = 99")).count() == 0
    found, index = warc.read_archives(spark, fine), warc.read_index(spark, fine)
    assert warc.checked(found, index).count() == 41
    other = F.when(F.col("page_id") == 31, 32).otherwise(F.col("page_id")).cast("long")
    for damaged in (index.filter("page_id <> 31"), index.withColumn("page_id", other), index.unionByName(index.limit(1).withColumn("offset", F.col("offset") + 1))):
        with pytest.raises(Exception, match="archive and index differ"):
            warc.checked(found, damaged).collect()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_members_of_an_archive():
    import gzip

    parts = [gzip.compress(b"a" * n) + b"\0" * pad for n, pad in ((0, 0), (5, 1), (1 << 20, 0), (7, 3))]
    got = list(warc.members(memoryview(b"".join(parts))))
    assert [(o, n) for o, n, _ in got] == [(sum(map(len, parts[:k])), len(x)) for k, x in enumerate(parts)]
    assert [len(x) for *_, x in got] == [0, 5, 1 << 20, 7]
    with pytest.raises(ValueError):
        list(warc.members(memoryview(parts[2][:-9])))


def test_warc_where_a_page_id_has_several_texts(spark):
    one, two, other = "<p>one</p>" * 20, "<p>two</p>" * 20, "<p>other</p>" * 20
    rows = [(1, one), (2, two), (5, one), (5, other), (5, "short"), (6, one), (6, two), (6, None)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {one: 1, two: 2}
    want = [(i, digest(h), first[h] if i > 2 and h in first else None, None if i > 2 and h in first else (h or "").encode()) for i, h in rows]
    got = [(r["page_id"], r["payload_digest"], r["refers_to"], r["payload"] if r["payload"] is None else bytes(r["payload"])) for r in warc.round_trip(pages, payloads=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_members_stand_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(20)], "page_id long, url string, html string")
    raw, fine = f"file://{tmp_path}/raw", f"file://{tmp_path}/fine"
    warc.write_archives(pages, raw)
    warc.normalise(spark, raw, fine)
    import gzip
    import json

    n = 0
    for index in (tmp_path / "fine/kind=index").glob("part-*"):
        part = index.name.split("-")[1]
        (archive,) = (tmp_path / "fine/kind=warc").glob(f"part-{part}-*")
        data, whole = archive.read_bytes(), b""
        for line in index.read_bytes().split(b"\0")[:-1]:
            p = json.loads(line)
            record = gzip.decompress(data[p["offset"] : p["offset"] + p["length"]])
            assert f"<urn:page:{p['page_id']}>".encode() in record
            whole, n = whole + record, n + 1
        assert gzip.decompress(data) == whole
    assert n == 20


def test_large_record_is_padded():
    import gzip

    record = b"a" * (1 << 24)
    member, length = warc.member_of(record)
    assert length == len(member) + 1 and gzip.decompress(member + b"\0") == record
    small, length = warc.member_of(b"abc")
    assert length == len(small) + 1 and gzip.decompress(small + b"\0") == b"abc"


def test_top_k(spark):
    g = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(g.normal(0, 0.2, 6), 2)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [0.5]), (320, [0.25]), (306, []), (40, rows[40][1]), (340, [0.0] * 6)]
    df = spark.createDataFrame([(*r, "l", 1) for r in rows], "vec_id long, embedding array<double>, label string, rank int").repartition(3)
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for k, block in ((20, 64), (400, 100)):
        want = []
        for i, q in {i: q for i, q in ok if i % 20 == 0}.items():
            found = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
        for size in (200, 1 << 20):  # several passes, and one
            got = topk.top_k(df, df.filter("vec_id % 20 = 0"), k, block_rows=block, query_bytes=size)
            assert sorted(map(tuple, got.collect())) == sorted(want)
    nameless = df.unionByName(df.filter("vec_id < 5").withColumn("vec_id", F.lit(None).cast("long")))
    assert sorted(map(tuple, topk.top_k(nameless, nameless.filter("vec_id % 20 = 0"), 400, block_rows=100).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large for 64-bit scores: 9"):
        topk.top_k(spark.createDataFrame([(9, [1e9, 0.0]), (8, [1e300, float("inf")])], "vec_id long, embedding array<double>"), df)


def test_top_k_leaves_the_index_where_it_is(spark):
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in g.normal(0, 0.2, 4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    index = topk.build_index(df, block_rows=50)
    got = topk.search(index, df.filter("vec_id < 30"), 3)
    assert got.count() == 90
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan
    v = np.floor(64 * np.array([x for _, x in rows])).astype(np.int64)
    best = topk.Best(np.arange(30), v[:30], 3)
    for part in np.array_split(np.arange(500), 7):
        (batch,) = topk.slice_blocks(1000)([pa.RecordBatch.from_pydict({"vec_id": part, "v": v[part].tolist()})])
        block = topk.Block(batch.to_pylist()[0])
        assert (block.best_possible(v[:30]) >= (v[:30] @ v[part].T).max(axis=1)).all()
        best.add(block)
    assert [(r["query_id"], r["vec_id"]) for r in got.orderBy("query_id", "rank").collect()] == [(i, j) for i in range(30) for j in best.rows[i].tolist()]


def test_language_id(spark, docs, empty):
    words = {"xx": "kro vlast byl proti sest dnes krok".split(), "yy": "aloha mahalo wiki nui loa kane wahine".split()}
    rows = [(i, " ".join(G.choice(words[lang]) for _ in range(30)), lang) for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 !!", None), (903, "kro vlast " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(df, remainder(4) != 2)
    got = as_dict(language_id.identify(df, profiles))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200]) and got[903]["lang_pred"] == "xx"
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.keep_identified(df, profiles).count() == len(rows) - 3
    nothing = language_id.learn(empty, remainder(4) != 2)
    assert as_dict(language_id.identify(docs, nothing))[1]["lang_pred"] == "und" and language_id.identify(empty, profiles).count() == 0
    grams, counts = language_id.gram_counts("ab " * 1000)
    many = language_id.PIECE
    try:
        language_id.PIECE = 100
        again = language_id.gram_counts("ab " * 1000)
    finally:
        language_id.PIECE = many
    assert set(grams.tolist()) >= set(again[0].tolist()) and abs(int(counts.max()) - int(again[1].max())) <= 0


def naive_grams(text):
    """N-grams as numbers, 21 bits a character."""
    words = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    found = [c for c in words if c != " "] if words.strip() else []
    found += [words[k : k + 2] for k in range(len(words) - 1)] if found else []
    found += [words[k : k + 3] for k in range(len(words) - 2) if words[k + 1] != " "] if found else []
    return [sum(ord(c) << 21 * (len(x) - 1 - n) for n, c in enumerate(x)) for x in found]


def naive_profile(texts):
    counts = collections.Counter(g for t in texts for g in naive_grams(t))
    return sorted(counts, key=lambda g: (-counts[g], g))[:400]


def test_op8_against_out_of_place_distances(spark, tmp_path):
    g = random.Random(41)
    made = {x: ["".join(g.choice(a) for _ in range(g.randrange(2, 7))) for _ in range(60)] for x, a in (("aa", "abcdeé"), ("bb", "bcdefgß"), ("cc", "defghijk"))}
    rows = [(i, " ".join(g.choice(made[lang]) for _ in range(g.randrange(1, 40))) + g.choice(("", " 12!", "\n")), None if i % 11 == 0 else lang) for i in range(150) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 _ ?", "cc"), (203, "Ünï", None), (204, rows[4][1] * 40, None), (4, rows[4][1], "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    profiles = {x: {gram: n for n, gram in enumerate(naive_profile([t for i, t, lang in rows if lang == x and t is not None and not held(i)]))} for x in made}
    want = []
    for i, t, _ in rows:
        own = naive_profile([t]) if t and any(c.isalpha() for c in t) else []
        apart = {x: sum(min(400, abs(p[gram] - n)) if gram in p else 400 for n, gram in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(apart), key=apart.get) if own else "und"
        want.append((i, held(i), best, round(1 - apart[best] / (400 * len(own)), 9) if own else 0.0))
    got = QUERIES["op8_language_id"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert sorted((*r[:3], round(r[3], 9)) for r in got.collect()) == sorted(want)


def test_every_language_can_be_predicted(spark, monkeypatch):
    """More languages than are counted at once, each of few documents."""
    monkeypatch.setattr(language_id, "SENT", 100)
    rows = [(k * 3 + j, " ".join(chr(0x4E00 + 7 * k + m) * 2 for m in range(6)), f"l{k:04d}") for k in range(1100) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(df, F.lit(True))
    assert len(profiles.languages) == 1100
    assert all(r["lang"] == r["lang_pred"] for r in language_id.identify(df, profiles).join(df.select("doc_id", "lang"), "doc_id").collect())


def naive_quality(network, data):
    """The network's forward pass, byte by byte."""
    q, p = quality, {k: x.astype(float) for k, x in network.p.items()}
    data = data.ljust(q.CHUNK * q.STRIDE + q.WIDTH - q.STRIDE, b" ")
    data += b" " * (-(len(data) - q.WIDTH) % q.STRIDE)
    again = [any(k >= lag and data[k : k + 8] == data[k - lag : k - lag + 8] for lag in q.LAGS) and k + 8 <= len(data) for k in range(len(data))]
    h = []
    for at in range(0, len(data) - q.WIDTH + 1, q.STRIDE):
        total = p["b"].copy()
        for k in range(q.WIDTH):
            total += np.r_[p["emb"][data[at + k]], float(again[at + k])] @ p["w"][k]
        h.append(np.maximum(total, 0))
    starts = sorted({*range(0, len(h) - q.CHUNK + 1, q.HOP), len(h) - q.CHUNK})
    units = np.max([np.maximum(np.mean(h[s : s + q.CHUNK], axis=0) @ p["v"] + p["c"], 0) for s in starts], axis=0)
    return 1 / (1 + np.exp(-(units @ p["u"] + p["o"][0])))


def test_quality_forward_and_gradient(monkeypatch):
    network = quality.Network(3)
    network.p["o"][0] = 0.3
    texts = [b"", b"a", b"abc " * 90, prose(150).encode(), bytes(range(256)) * 3, ("é" * 700).encode()]
    tables = network.tables()
    whole = [network.score(x, tables) for x in texts]
    assert np.allclose(whole, [naive_quality(network, x) for x in texts], atol=1e-5)
    for block in (1, 500, 1000):  # blocks of one chunk, and of a few
        monkeypatch.setattr(quality, "BLOCK", block)
        assert np.allclose([network.score(x, tables) for x in texts], whole, atol=1e-6)
    network.p = {k: x.astype(float) for k, x in network.p.items()}
    labels = np.array([1, 0, 1, 0, 1, 0], np.float32)
    loss = lambda: float(np.mean([-np.log(s if y else 1 - s) for s, y in zip([naive_quality(network, x) for x in texts], labels, strict=True)]))
    grad = network.gradient([quality.windows(quality.padded(x)) for x in texts], labels)
    g = np.random.default_rng(6)
    for key, value in network.p.items():
        flat, slope = value.reshape(-1), np.asarray(grad[key]).reshape(-1)
        often = np.argsort(-np.abs(slope))[:40]
        for k in {int(often[0]), int(g.choice(often)), int(g.integers(len(flat)))}:
            before = flat[k]
            flat[k] = before + 1e-5
            high = loss()
            flat[k] = before - 1e-5
            low = loss()
            flat[k] = before
            assert abs((high - low) / 2e-5 - slope[k]) < 1e-3 + 0.02 * abs(slope[k]), key


def test_op2_through_its_query(spark, tmp_path):
    rows = [(i, prose(30), 1) if i % 3 else (i, (G.choice(VOCABULARY) + " ") * 40, 0) for i in range(240)]
    rows += [(500, None, 0), (501, "", 0), (502, prose(20), None)]
    labels = [(i, q) for i, _, q in rows] + [(10, 0), (11, 1), (None, 1), (9999, 1)]  # 10 is contradicted, 11 repeated
    spark.createDataFrame([r[:2] for r in rows] + [(11, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    known = {r["doc_id"]: r["label"] for r in quality.agreed(spark.read.parquet(f"{tmp_path}/labels.parquet"), "doc_id", "quality").collect()}
    assert known == {9999: 1} | {i: q for i, _, q in rows if q is not None and i != 10}
    got = QUERIES["op2_quality_classifier"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    network = quality.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), remainder(5) != 0)
    found = got.collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert r["held_out"] == held[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.3)
    one = {r["doc_id"]: r for r in found if r["doc_id"] != 11}
    assert all(abs(one[i]["score"] - naive_quality(network, (t or "").encode())) < 1e-4 for i, t, _ in rows[::20] + rows[-3:] if i in one)
    assert np.mean([one[i]["predicted"] == q for i, _, q in rows[:240] if held[i] and i in one]) > 0.95
    # what a held-out row says, and columns that aren't the text, change nothing
    other = spark.createDataFrame([(i, None if q is None else 1 - q if i in held and held[i] else q) for i, q in labels], "doc_id long, quality int")
    again = quality.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), other, remainder(5) != 0)
    assert all((again.p[k] == network.p[k]).all() for k in network.p)


def naive_features(text):
    out = collections.Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update([w] + [w[:4] + "-"] * (len(w) > 4) + [w[:5] + "-"] * (len(w) > 5))
    return out


def test_op6_through_its_query(spark, tmp_path):
    rows = []
    for i in range(300):
        w = prose(25).split()
        for _ in range((i % 5 == 0) * (1 + i % 4)):
            w.insert(G.randrange(len(w)), G.choice(("grotzig", "grotzen", "vilemaan")))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    rows += [(900, None, 0), (901, "", 0), (902, "!!", 1), (903, prose(40) + " x" * 300_000 + " grotzig vilemaan" * 3, None)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, _, t in rows] + [(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tables = [spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels")]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    for got, model in ((as_dict(QUERIES["op6_toxicity"](spark, str(tmp_path))), toxicity.learn(*tables)), (None, toxicity.learn(*tables, remainder(5) != 0))):
        got = got or as_dict(toxicity.grade(tables[0], model))
        for i, t, _ in rows:
            s = sum(model.w[model.at[f]] * (1 + np.log(n)) for f, n in naive_features(t).items() if f in model.at)
            above = [1 / (1 + np.exp(-(s - x))) for x in model.theta]
            assert abs(got[i]["severity"] - sum(above)) < 1e-6 and abs(got[i]["p_toxic"] - above[0]) < 1e-6
            assert (got[i]["grade"], got[i]["toxic"]) == (sum(x >= 0.5 for x in above), above[0] >= 0.5)
        assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in rows[:300] if i in held]) > 0.95 and got[903]["toxic"]


def test_ordinal_fit_is_a_minimum_of_the_likelihood():
    g = np.random.default_rng(8)
    rows = [(sorted(g.choice(5, 3, replace=False).tolist()), g.uniform(0.5, 2, 3).tolist()) for _ in range(200)]
    truth = np.array([2.0, -1.0, 0.5, 1.0, -2.0])
    grades = np.array([int((np.dot(truth[k], x) + g.logistic()) > 0) + int((np.dot(truth[k], x) + g.logistic()) > 2) for k, x in rows])
    counts = g.uniform(0.5, 1.5, 200)

    def loss(w, theta):
        total = 0.0
        for (k, x), grade, own in zip(rows, grades, counts, strict=True):
            above = [1.0, *(1 / (1 + np.exp(-(sum(w[i] * v for i, v in zip(k, x, strict=True)) - t))) for t in theta), 0.0]
            total -= own * np.log(above[grade] - above[grade + 1])
        return total / len(rows) + 1e-4 / 2 * float(w @ w)

    model = toxicity.Ordinal([f"f{k}" for k in range(5)]).fit(rows, grades, counts_for=counts)
    least = loss(model.w, model.theta)
    for _ in range(60):
        assert least <= loss(model.w + g.normal(0, 0.1, 5), np.sort(model.theta + g.normal(0, 0.1, 2))) + 1e-4
    assert least < loss(np.zeros(5), np.array([0.0, 1.0]))


def test_quality(spark, docs, empty):
    good = [(i, prose(60), 1) for i in range(0, 300, 2)]
    bad = [(i, prose(60).replace(" ", "!! ").upper() if i % 4 == 1 else (G.choice(VOCABULARY) + " ") * 60, 0) for i in range(1, 300, 2)]
    rows = good + bad
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5000, None), (5001, 1)], "doc_id long, quality int")
    network = quality.learn(df, labels, remainder(5) != 0)
    got = as_dict(quality.score(df, network))
    held = [(got[i]["score"] >= 0.3) == q for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean(held) > 0.95
    edge = as_dict(quality.score(docs, network))
    assert all(0 <= r["score"] <= 1 for r in edge.values()) and quality.score(empty, network).count() == 0
    assert as_dict(quality.score(docs, quality.learn(df, labels.limit(0), remainder(5) != 0)))[1]["score"] == 0.5


def test_quality_learns_beside_very_long_documents(spark):
    """The first document of a label in the order of drawing is beyond the budget, or all of them are."""
    long = "x" + "é" * 60_000  # the limit falls within a character
    ids = [r["id"] for r in spark.range(40).orderBy("id").selectExpr("id").orderBy(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 20))).collect()]
    for many in (1, 20):
        rows = [(i, long if n < many and k == 0 else prose(20), k) for k in (0, 1) for n, i in enumerate(x for x in ids if x % 2 == k)]
        df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, quality int")
        network = quality.learn(df, labels, F.lit(True), most_bytes=40_000)
        assert network.constant is None
    assert quality.within([(1, 9), (2, 3), (3, 8), (4, 2)], 7) == [2, 4] and quality.within([(1, 9), (2, 8)], 7) == [2] and quality.within([], 7) == []


def test_toxicity(spark, docs, empty):
    rows = []
    for i in range(400):
        w = prose(50).split()
        for _ in range((i % 4 == 0) * (1 + i % 5)):
            w.insert(G.randrange(len(w)), G.choice(("grotzig", "grotzen", "vilemaan")))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(999, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = as_dict(toxicity.grade(df, model))
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in rows]) > 0.97
    assert all(0 <= r["severity"] <= 2 for r in got.values()) and model.theta[0] < model.theta[1]
    assert not any(r["toxic"] for r in toxicity.grade(docs, model).collect()) and toxicity.grade(empty, model).count() == 0
    assert not any(r["toxic"] for r in toxicity.grade(df, toxicity.learn(df, labels.filter("toxic = 0"))).collect())


def test_toxicity_where_toxic_rows_are_rare(spark):
    """60 toxic ones of 6,000, and 400 to learn from: a draw without regard to labels gets four."""
    g, hot = random.Random(31), ["grotzig", "vilemaan", "schnurk", "brabbel", "zwackel"]
    rows = [(i, prose(12, g) + (f" {hot[i // 100 % 5]}" * 2 if i % 100 == 0 else ""), int(i % 100 == 0)) for i in range(6000)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), most=400)
    assert set(hot) <= set(model.names)
    got = as_dict(toxicity.grade(df, model))
    assert all(got[i]["toxic"] for i, _, t in rows if t) and sum(got[i]["toxic"] for i, _, t in rows if not t) < 20
    assert toxicity.quotas({0: 9000, 1: 70}, 400) == {0: 330, 1: 70} and toxicity.quotas({0: 300, 1: 70}, 400) == {0: 300, 1: 70}
    assert toxicity.quotas({0: 9000, 1: 9000}, 400) == {0: 200, 1: 200}


def test_pipeline(spark, tmp_path):
    rows = [(i * 3 + 1, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    state = before
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, state, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        state = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or state.columns == before.columns
    read = lambda k: as_dict(spark.read.parquet(f"{tmp_path}/{k}"))
    assert set(as_dict(before)) - set(read(0)) == {i for i, t, *_ in rows if not any(c.isalpha() for c in t or "")}
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    assert set(read(1)) == {max(i for i in read(0) if norm(text_of(i)) == t) for t in {norm(text_of(i)) for i in read(0)}}
    kept = read(2)
    assert set(kept) == {r["group_id"] for r in near_dup.near_duplicates(spark.read.parquet(f"{tmp_path}/1")).collect()}
    cut = {r[0]: r for r in brute_substring([(i, text_of(i).encode().split()) for i in kept])}
    for i, r in read(3).items():
        words = b" ".join(r["text"].encode().split())
        assert hashlib.sha256(words).hexdigest() == cut[i][3] and (cut[i][2] or r["text"] == text_of(i))
    e = encoding()
    total = sum(len(e.encode_ordinary(r["text"])) + 1 for r in read(3).values())
    assert sum(r["length"] for r in state.collect()) == total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == state.count()


def test_pipeline_writes_token_ids(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, prose(2000)), (3, None)], "doc_id long, text string")
    texts, ids = {r["doc_id"]: r["text"] or "" for r in df.collect()}, collections.defaultdict(dict)
    for r in corpus_pipeline.pack_sequences(spark, df, "").collect():
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        ids[r["doc_id"]][r["piece"]] = r["ids"]
    e = encoding()
    for i, t in texts.items():
        assert np.frombuffer(b"".join(ids[i][k] for k in sorted(ids[i])), "<u4").tolist() == [*e.encode_ordinary(t), packing.END_ID]


def test_stages_keep_other_columns_and_odd_rows(spark):
    """Helper columns' names among the columns, null and repeated ids, repeated rows."""
    passage = prose(30)
    rows = [(1, passage + " " + prose(9)), (2, prose(9) + " " + passage), (2, prose(7) + " " + passage), (None, passage + " " + prose(8)), (None, prose(20)), (3, None), (4, "")]
    rows += [rows[1], rows[4]]
    extra = ["kept", "_kept", "_key", "_digest", "_own", "_source", "_cut", "group_id", "n_removed", "digest", "piece", "score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], schema)
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found[name] = stage(spark, df, "").collect()
        assert all([r[c] for c in extra] == extra for r in found[name]) and stage(spark, df, "").columns == df.columns
        assert stage(spark, df.limit(0), "").count() == 0
    assert len(found["language_id"]) == len(rows) - 2
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found["exact_dedup"]) == sorted({(i or 0, t or "") for i, t in rows if i != 3})
    assert len(found["near_dedup"]) == len(rows)
    want = [(i, t if i != 2 else " ".join(t.split()[: -len(passage.split())])) for i, t in rows]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found["substring_dedup"]) == sorted((i or 0, t or "") for i, t in want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in found["substring_dedup"])
    packed = corpus_pipeline.pack_sequences(spark, df, "").collect()
    assert len(packed) == len(rows) and {r["doc_id"] for r in packed} == {i for i, _ in rows}
    assert language_id.Profiles({"xx": np.arange(9, dtype=np.uint64)}).classify("\u00b2\u00b3 \u2167 12") == ("und", 0.0)


def test_registered_queries_have_sql_of_their_own():
    assert set(ORACLES) <= set(QUERIES)
