"""MinHash near-deduplication: ProbMinHash signatures, banding and verification.

Each distinct shingle of WORDS words sends arrivals of a Poisson process whose rate is its
weight; each arrival falls on a random place of the signature and the earliest arrival there
names the place's shingle. A shingle stops as soon as its next arrival would come after every
place's earliest. Two places agree with the probability Jaccard of the weighted sets.
Signatures are cut into bands; documents that share a band are candidates, and a candidate pair
is linked when the exact similarity of its shingles reaches the threshold. Classes are the
connected components of the links.

Banding and verification always see one and the same similarity. With ``weighted`` a shingle
weighs as often as it occurs and links are held against the probability Jaccard of the counts;
without, all weights are 1, and the probability Jaccard is the Jaccard of the sets.

Copies of the same words are reduced to one node before banding; nodes have numbers of their
own, so that nothing depends on the ids that rows bring. Within a band's bucket not all pairs
are listed: a hub, the smallest node, is compared with the others and leaves. A bucket stays in
work for as long as what is left lies in more than one class; then its next hubs are
compared with the members of other classes and leave too: at first some of its largest class, which
soon gather what is like them, then those of its smallest classes. Pairs that cannot reach the threshold, by
counts of their shingles in parts of hash space, are passed over. So every link that banding
can find takes effect, and members of one class are not compared again. A large bucket's members
are dealt out by bucket and salt, and its hubs are sent to every salt.

Defined cases: texts without words (null, empty, blank) are each their own class; texts of fewer
than WORDS words have one shingle; rows with a null id are their own class and stay; rows that
repeat an id with other words are documents of their own (classes that then have one least id
differ in class_id); rows that repeat both id and text count as one document; an empty table gives an empty
result; other columns are ignored; very long texts are shingled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm.batches import batch_bytes
from graphquarry.llm.words import Words, scramble
from graphquarry.operators.components import connected_components
from graphquarry.plans.storage import discard, gathered, materialise, setting

WORDS, THRESHOLD = 5, 0.8
#: At a similarity of 0.8 a pair shares a band with a probability of 0.99998.
BANDS, ROWS = 28, 5
#: Bytes of text that are signed together, and of the batches that workers get.
TOGETHER, BATCH_BYTES = 1 << 18, 8 << 20
#: Parts of hash space by which the shingles that two documents can share at most are bounded.
GROUPS = 128
#: Hubs a bucket in rounds that take them from its largest class, and how many such rounds come first;
#: then they come from its smallest classes, eight times as many in each round.
HUBS, LARGE_ROUNDS = 8, 1
#: Members of a bucket, or pairs of a hub, that stand under one salt.
SALTED = 2048
#: Pairs that a task verifies at least.
TOGETHER_PAIRS = 2_000
#: Share of all entries from which a bucket is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.002
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_STEP = np.uint64(0xD1B54A32D192ED03)


def signatures(shingles: list[np.ndarray], weights: list[np.ndarray], places: int) -> np.ndarray:
    """ProbMinHash signature of each weighted set, as (sets, places) shingle hashes; all sets hold something."""
    size = [len(x) for x in shingles]
    doc = np.repeat(np.arange(len(size)), size)
    elem, rate = np.concatenate(shingles), np.concatenate(weights)
    first = np.full((len(size), places), np.inf)
    name = np.zeros((len(size), places), np.uint64)
    flat_first, flat_name = first.ravel(), name.ravel()
    time = np.zeros(len(elem))
    k = 0
    while len(elem):
        k += 1
        r = scramble(elem + np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        at = doc * places + (scramble(r + _STEP) % np.uint64(places)).astype(np.int64)
        better = time < flat_first[at]
        spot, when, who = at[better], time[better], elem[better]
        np.minimum.at(flat_first, spot, when)
        won = flat_first[spot] == when
        flat_name[spot[won]] = who[won]
        edges = np.nonzero(np.r_[True, doc[1:] != doc[:-1]])[0]
        last = np.zeros(len(size))
        last[doc[edges]] = first[doc[edges]].max(axis=1)
        live = time < last[doc]
        if not live.all():
            doc, elem, rate, time = doc[live], elem[live], rate[live], time[live]
    return name


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for k in range(rows):
        out = scramble(out + parts[:, :, k])
    return out.view(np.int64)


def shingle_lists(texts: list[bytes], words: int) -> tuple[Words, list[np.ndarray]]:
    """Hashes of all shingles of each text: runs of ``words`` words, or all its words if it has fewer."""
    w = Words(texts)
    hashes, at = w.runs(words)
    lists = np.split(hashes, np.searchsorted(at, w.first[1:-1]))
    for k in np.nonzero((np.diff(w.first) < words) & (np.diff(w.first) > 0))[0]:
        lists[k] = np.array([w.whole(k)])
    return w, lists


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def batches_of(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``most`` bytes of text, and their texts."""
    texts = _bytes(batch.column(1))
    start = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= most or k + 1 == len(texts):
            yield batch.slice(start, k + 1 - start), texts[start : k + 1]
            start, size = k + 1, 0


def weights_of(shingles: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a document, sorted, and the weight of each."""
    if not weighted:
        found = np.unique(shingles)
        return found, np.ones(len(found))
    found, counts = np.unique(shingles, return_counts=True)
    return found, counts.astype(float)


def words_digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.split()))


def signer(words: int, bands: int, rows: int, weighted: bool):
    """Of rows (doc_id, text, row): the digest of the words, the number of distinct shingles and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in batches_of(batch, TOGETHER):
                sets = [weights_of(x, weighted) for x in shingle_lists(texts, words)[1]]
                full = [k for k, (x, _) in enumerate(sets) if len(x)]
                found: list = [None] * len(texts)
                if full:
                    signed = signatures([sets[k][0] for k in full], [sets[k][1] for k in full], bands * rows)
                    for k, b in zip(full, band_hashes(signed, bands, rows), strict=True):
                        found[k] = b
                digest = [words_digest(x) if len(y) else None for x, (y, _) in zip(texts, sets, strict=True)]
                columns = [part.column(0), part.column(2), pa.array(digest, pa.binary()), pa.array([len(x) for x, _ in sets], pa.int32()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "digest", "n", "bands"])

    return run


def shingler(words: int, weighted: bool):
    """Of rows (node, text, digest): the shingles, with their weights if those count, and how many distinct ones fall in each of GROUPS parts of hash space.

    Rows whose words aren't those of the digest are passed over, as are repeats of a node within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, texts in batches_of(batch, TOGETHER):
                rows = []
                for k, (node, digest) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if node not in seen and words_digest(texts[k]) == digest:
                        seen.add(node)
                        rows.append(k)
                sets = [weights_of(x, weighted) for x in shingle_lists([texts[k] for k in rows], words)[1]] if rows else []
                spread = [np.bincount((x % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32) for x, _ in sets]
                data = [x.tobytes() + (w.tobytes() if weighted else b"") for x, w in sets]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(data, pa.binary()), pa.array(spread, pa.list_(pa.int32()))], names=["node", "shingles", "spread"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets: the sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(at):
        return 0.0
    x, y = x / x.sum(), y / y.sum()
    only_a, only_b = x.sum() - x[at].sum(), y.sum() - y[bt].sum()
    order = np.argsort(x[at] / y[bt], kind="stable")
    x, y = x[at][order], y[bt][order]
    # max(x_j, y_j * x_i / y_i) is x_j where j's ratio is i's or above
    above = np.cumsum(x[::-1])[::-1] + only_a
    below = np.r_[0.0, np.cumsum(y)[:-1]] + only_b
    return float((x / (above + below * x / y)).sum())


def verifier(threshold: float, weighted: bool):
    def similarity(a: np.ndarray, b: np.ndarray) -> float:
        if not weighted:
            return jaccard(a, b)
        (p, x), (q, y) = ((s[: len(s) // 2], s[len(s) // 2 :].view(np.float64)) for s in (a, b))
        return probability_jaccard(p, x, q, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (2, 3)]
            good = pa.array([similarity(a, b) >= threshold - 1e-12 for a, b in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(good)

    return run


def row_key(id_col: str, text_col: str) -> Column:
    """Tells apart rows that repeat an id."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """doc_id, group_id (the smallest id of its class), kept (whether it is that one), class_id and row (``row_key``) of every row."""
    spark = docs.sparkSession
    with batch_bytes(spark, BATCH_BYTES), setting(spark, _GROUP_LIMIT, str(1 << 20)):
        return _classes(docs, words, threshold, bands, rows, id_col, text_col, weighted)


def salted(many: Column) -> Column:
    """Salts for so many rows."""
    return F.ceil(many / F.lit(float(SALTED))).cast("int")


def _every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _buckets(unique: DataFrame) -> DataFrame:
    """(bucket, salt, salts, node, n, hub, hub_n): the members of buckets that hold several nodes, and the smallest of them."""
    entries = unique.select("node", "n", F.explode("bands").alias("bucket"))
    n = unique.agg(F.sum(F.size("bands"))).first()[0] or 0
    counted = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = materialise(gathered(counted, n), "bucket_sizes")
    total = shared.agg(F.sum("many")).first()[0] or 0
    hot = shared.filter(F.col("many") > total * HOT_SHARE)
    joined = entries.join(F.broadcast(hot), "bucket").unionByName(entries.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti").join(shared.hint("merge"), "bucket"))
    joined = joined.withColumn("salts", salted(F.col("many"))).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    work = materialise(gathered(joined.select("bucket", "salt", "salts", "node", "n", "hub", "hub_n"), 2 * total), "buckets")
    discard(shared)
    return work


def _verified(pairs: DataFrame, many: int, sets: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Those of so many pairs (hub, node) that are alike, as (src, dst). A hub of many pairs is sent to several salts."""
    counts = gathered(pairs.groupBy("hub").agg(salted(F.count(F.lit(1))).alias("salts")), many)
    left = _every_salt(gathered(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("a")).join(counts, "hub"), many, TOGETHER_PAIRS)).drop("salts")
    right = sets.select("node", F.col("shingles").alias("b"))
    dealt = gathered(pairs.join(counts, "hub"), many).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    both = gathered(dealt.join(right, "node"), many, TOGETHER_PAIRS).join(left, ["hub", "salt"])
    return gathered(both, many, TOGETHER_PAIRS).select("hub", "node", "a", "b").mapInArrow(verifier(threshold, weighted), "src bigint, dst bigint")


def _joined_classes(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after new links: only the classes that they touch are put together anew."""
    n = links.count()
    if classes is None:
        return materialise(gathered(connected_components(links, most=n), 2 * n), "classes")
    of = lambda c: classes.select(F.col("id").alias(c), F.col("component").alias(f"{c}_class"))
    known = classes.count()
    ends = gathered(gathered(links.join(of("src"), "src", "left"), n).join(of("dst"), "dst", "left"), n).select(F.coalesce("src_class", "src").alias("src"), F.coalesce("dst_class", "dst").alias("dst"))
    moved = materialise(gathered(connected_components(ends, most=n), 2 * n), "class_moves")
    old = gathered(classes.join(moved.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left"), known).select("id", F.coalesce("_to", "component").alias("component"))
    new = gathered(moved.join(classes.select("id"), "id", "left_anti"), 2 * n).select("id", "component")
    out = materialise(old.unionByName(new), "classes")
    discard(moved, classes)
    return out


def _hubs(rest: DataFrame, many: int, hubs: int, largest: bool) -> DataFrame:
    """(bucket, salts, hub, hub_n, hub_class): the next hubs of each bucket of so many rows; whatever a task passes on is reduced to ``hubs`` a bucket before."""
    mixed = F.xxhash64("bucket", "node")
    slot = F.pmod(mixed, F.lit(hubs)).alias("slot")
    found = rest.groupBy("bucket", "class", slot).agg(F.min(F.struct(mixed.alias("m"), "node", "n")).alias("first"), F.count(F.lit(1)).alias("some"), F.first("salts").alias("salts"))
    size = F.sum("some").over(Window.partitionBy("bucket", "class"))
    found = gathered(gathered(found, many).withColumn("size", size), many)
    order = [F.desc("size") if largest else F.asc("size"), "class", "slot"]
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    found = found.withColumn("place", place).filter(F.col("place") <= hubs)
    return gathered(found, many).select("bucket", "salts", F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n"), F.col("class").alias("hub_class"))


def _classes(docs: DataFrame, words: int, threshold: float, bands: int, rows: int, id_col: str, text_col: str, weighted: bool) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row"))
    signed = materialise(slim.mapInArrow(signer(words, bands, rows, weighted), "doc_id bigint, row bigint, digest binary, n int, bands array<bigint>"), "signatures")
    usable = signed.filter("doc_id is not null and digest is not null")
    once = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("many"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # written, for the numbers must not change
    unique = materialise(gathered(once, signed.count()).withColumn("node", F.monotonically_increasing_id()), "nodes")
    work = _buckets(unique)

    wanted = unique.join(work.select("node").distinct(), "node", "left_semi").select("node", "digest", F.col("least.row").alias("row"))
    texts = slim.join(wanted, "row").select("node", "text", "digest")
    sets = materialise(texts.mapInArrow(shingler(words, weighted), "node bigint, shingles binary, spread array<int>"), "shingles")
    spread = sets.select("node", "spread")

    near = F.lit(True) if weighted else F.least("n", "hub_n") >= F.lit(threshold) * F.greatest("n", "hub_n")
    many = work.count()
    pairs = materialise(gathered(work.filter(F.col("node") != F.col("hub")).filter(near).select("hub", "node").distinct(), many), "pairs")
    tested = classes = None
    hubs, turn = HUBS, 0
    read, work, done = [work], work.filter("node <> hub").select("bucket", "salt", "salts", "node", "n"), [pairs]
    while True:
        if n := pairs.count():
            fresh = materialise(_verified(pairs, n, sets, threshold, weighted), "links")
            tested = pairs if tested is None else tested.unionByName(pairs)
            if fresh.limit(1).count():
                classes = _joined_classes(classes, fresh)
            discard(fresh)
        if classes is None:
            rest = work.withColumn("class", F.col("node"))
        else:
            rest = gathered(work.join(classes.select(F.col("id").alias("node"), "component"), "node", "left"), many).withColumn("class", F.coalesce("component", "node")).drop("component")
        open_ = gathered(rest.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.first("salts").alias("salts")), many).filter("low <> high").select("bucket", "salts")
        rest = materialise(gathered(rest.join(_every_salt(open_).select("bucket", "salt"), ["bucket", "salt"], "left_semi"), many), "buckets")
        discard(*read)
        many = rest.count()
        if not many:
            break
        chosen = materialise(_hubs(rest, many, hubs, turn < LARGE_ROUNDS), "hubs")
        sent = _every_salt(gathered(chosen.join(spread.select(F.col("node").alias("hub"), F.col("spread").alias("hub_spread")), "hub"), many)).drop("salts")
        met = gathered(rest.join(spread, "node"), many).join(sent, ["bucket", "salt"]).filter("class <> hub_class")
        if not weighted:
            shared = F.aggregate(F.zip_with("spread", "hub_spread", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
            met = met.filter(shared * (1 + threshold) >= (F.col("n") + F.col("hub_n")) * threshold - 1e-9)
        pairs = met.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["hub", "node"], "left_anti")
        pairs = materialise(gathered(pairs, many * hubs), "pairs")
        read, done = [rest, chosen], [*done, pairs]
        work = rest.join(chosen.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti").select("bucket", "salt", "salts", "node", "n")
        turn += 1
        hubs = hubs * 8 if turn >= LARGE_ROUNDS else hubs
    discard(rest, sets, *done)
    classed = unique.select("digest", "least", "node", "many")
    if classes is None:
        classed = classed.withColumnRenamed("node", "class_id")
    else:
        found = classed.join(classes.select(F.col("id").alias("node"), "component"), "node", "left")
        classed = found.select("digest", "least", "many", F.coalesce("component", "node").alias("class_id"))
    lowest = classed.groupBy("class_id").agg(F.min("least").alias("lowest"))
    groups = materialise(classed.join(lowest, "class_id").select("digest", "class_id", "lowest", "many"), "groups")
    discard(unique, classes)
    out = _to_rows(signed, groups)
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest.doc_id", "doc_id"))
    same = (F.col("doc_id") == F.col("lowest.doc_id")) & (F.col("row") == F.col("lowest.row"))
    return out.select("doc_id", group.alias("group_id"), F.coalesce(same, F.lit(True)).alias("kept"), "class_id", "row")


def _to_rows(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row with its class; words that many rows have, fewer than 1 / HOT_SHARE, are joined by broadcast."""
    total = groups.agg(F.sum("many")).first()[0] or 0
    hot = groups.filter(F.col("many") > total * HOT_SHARE).drop("many")
    named = signed.filter("doc_id is not null and digest is not null").select("doc_id", "row", "digest")
    found = named.join(F.broadcast(hot), "digest")
    found = found.unionByName(named.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.drop("many").hint("merge"), "digest"))
    return found.drop("digest").unionByName(signed.filter("doc_id is null or digest is null").select("doc_id", "row"), allowMissingColumns=True)
