"""Substring deduplication: recurring passages, sharded Aho-Corasick automata, streaming.

Documents are dealt by ranges of ids into chunks of about CHUNK_BYTES, so that an earlier
chunk holds smaller ids only.

1. Recurring windows: each chunk sends the hashes of its distinct windows of WINDOW words
   to buckets of hash space; a window in several chunks recurs. Each later chunk is matched
   with one earlier chunk that holds the window, the k-th with the (k-1)//8-th, so that no
   chunk serves more than eight others for one window, however often it occurs. Beyond GROUP_RANGES
   ranges of chunks each group of ranges is matched in itself, and then the groups' first holders.
2. Confirmation: the earlier chunk finds those windows in its texts, joins neighbouring
   ones to passages and sends their words to the later chunk.
3. Location: each chunk compiles the passages it got, and those that recur among its own
   documents, to Aho-Corasick automata, in shards of bounded size, and streams
   all its documents through them. The letters of the automata are words. A passage is compiled as
   the blocks of half a window that it falls into, one behind the other: every window of it holds one
   of them whole. Where the automaton finds a block, the words around it are compared with the
   passage's, and each window that agrees in a document behind the first one marks its words for removal.
   Blocks that stand in many places of the passages are compiled as the windows around them.
4. Doubt: a window whose hash recurs, but which step 3 didn't find, shares its hash with another one.
   For such hashes, if there are any, the words of all windows are gathered from all chunks,
   compared as they are, and sent to the chunks that hold them, which locate once more. So no result
   rests on hashes being different.

Defined cases: null, empty and blank texts have no words; documents shorter than a window
lose nothing; windows that recur only within one document stay; documents that repeat
an id are not smaller than each other and stand in one chunk; rows with a null id neither lose words nor cause
losses; a text longer than a chunk is a chunk of its own, of which a worker holds the words' places, and so are all rows
that repeat one id, which are never divided between chunks; passages of any length and any number of different words are cut for the automata;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.batches import batch_bytes
from graphquarry.llm.words import Words
from graphquarry.plans.storage import discard, materialise

WINDOW = 13
CHUNK_BYTES = 1 << 20
#: Bytes of the batches of documents that workers get.
BATCH_BYTES = 4 << 20
#: Text bytes a range of chunks; windows a bucket of hash space; bytes of passages an automaton.
RANGE_BYTES, BUCKET_WINDOWS, SHARD_BYTES = 16 << 20, 1_000_000, 2 << 20
SERVED = 8
#: Ranges of chunks whose windows are matched in one group: a window that every chunk holds adds a hash a chunk to it.
GROUP_RANGES = 4096
_BYTES_A_WORD = 6
#: Places of a block in the passages from which its windows are compiled instead.
COMMON = 8
#: Doubtful hashes that the chunks are asked about at once.
DOUBTS = 1_000_000
_ALL_BITS = (1 << 64) - 1


def chunker(most: int):
    """Sorted rows (doc_id, text) of a partition as chunk rows: chunk (its first id), ids, sizes, compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sizes, data = packed(texts, 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[0]], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([sizes], pa.binary()), pa.array([data], pa.binary())],
                names=["chunk", "ids", "sizes", "texts"],
            )

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size >= most and i != ids[-1]:
                    yield flush()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
                size += len(texts[-1])
        if ids:
            yield flush()

    return run


def parts_of(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [data[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)] if len(sizes) else []


def packed(texts: list[bytes], level: int) -> tuple[bytes, bytes]:
    """Sizes of some texts, and the texts compressed."""
    return np.array([len(x) for x in texts], "<i8").tobytes(), zstandard.ZstdCompressor(level=level).compress(b"".join(texts))


def unpacked(sizes: bytes, data: bytes) -> list[bytes]:
    n = np.frombuffer(sizes, "<i8")
    return parts_of(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(n.sum()))), n)


class Chunk:
    """Documents of a chunk: ids, rank of each id, words, and the windows' hashes with the first word of each."""

    def __init__(self, row: dict, window: int, mask: int = _ALL_BITS):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.words = Words(unpacked(row["sizes"], row["texts"]))
        self.names, self.rank = np.unique(self.ids, return_inverse=True)
        self.hash, self.at = self.words.runs(window)
        self.hash = self.hash & np.uint64(mask)

    def passages(self, windows: np.ndarray, window: int) -> list[tuple[int, int]]:
        """First word and last word + 1 of the passages that these windows, sorted, make up."""
        if not len(windows):
            return []
        at = self.at[windows]
        text = self.words.text[at]
        cut = np.nonzero((np.diff(at) != 1) | (np.diff(text) != 0))[0] + 1
        return list(zip(at[np.r_[0, cut]].tolist(), (at[np.r_[cut, len(at)] - 1] + window).tolist(), strict=True))

    def text(self, first: int, last: int) -> bytes:
        return self.words.data[self.words.begin[first] : self.words.end[last - 1]]


def low_bytes(h: np.ndarray) -> bytes:
    """The hashes without their highest byte, 7 bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def window_senders(window: int, bits: int, mask: int):
    """(part, bucket, chunk, hashes): a chunk's distinct windows, by the first ``bits`` of the hash; 7 bytes a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = np.unique(Chunk(row, window, mask).hash)
                edge = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                full = [k for k in range(1 << bits) if edge[k] < edge[k + 1]]
                blobs = [low_bytes(h[edge[k] : edge[k + 1]]) for k in full]
                columns = [pa.array([row["part"]] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "bucket", "chunk", "hashes"])

    return run


def matcher(bits: int, onward: bool = False):
    """A bucket's windows that several chunks hold: for each serving chunk the hashes, and which chunk wants each.

    ``onward`` adds, without ``codes`` and ``wanted_by``, the windows that each chunk is the first to hold, for a match
    between the firsts of several ranges of chunks.
    """

    def run(key, table):
        table = table.sort_by("chunk")
        chunks = table.column("chunk").to_numpy()
        blobs = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("hashes")]
        low = np.zeros((sum(len(x) for x in blobs) // 7, 8), np.uint8)
        low[:, :7] = np.concatenate(blobs).reshape(-1, 7)
        h = low.view("<u8").ravel() | np.uint64(key[0].as_py() >> (bits - 8)) << np.uint64(56)
        chunk = np.repeat(np.arange(len(blobs)), [len(x) // 7 for x in blobs])
        order = np.argsort(h, kind="stable")
        h, chunk = h[order], chunk[order]
        start = np.r_[True, h[1:] != h[:-1]]
        first = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
        nth = np.arange(len(h)) - first
        later = np.nonzero(nth > 0)[0]
        server = chunk[first[later] + (nth[later] - 1) // SERVED]
        order = np.argsort(server, kind="stable")
        later, server = later[order], server[order]
        cut = np.nonzero(np.diff(server))[0] + 1 if len(server) else []
        out: list[list] = [[], [], [], []]
        for part in np.split(np.arange(len(later)), cut) if len(later) else []:
            wants, code = np.unique(chunk[later[part]], return_inverse=True)
            out[0].append(int(chunks[server[part[0]]]))
            out[1].append(h[later[part]].astype("<u8").tobytes())
            out[2].append(code.astype("<u4").tobytes())
            out[3].append(chunks[wants].tolist())
        if onward:
            at = np.nonzero(start)[0]
            at = at[np.argsort(chunk[at], kind="stable")]
            for part in np.split(at, np.nonzero(np.diff(chunk[at]))[0] + 1):
                out[0].append(int(chunks[chunk[part[0]]]))
                out[1].append(low_bytes(h[part]))
                out[2].append(None)
                out[3].append(None)
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))]
        return pa.table([pa.array([key[0].as_py()] * len(out[0]), pa.int32()), *columns], names=["bucket", "chunk", "hashes", "codes", "wanted_by"])

    return run


def confirmer(window: int, mask: int):
    """Passages of a chunk that later chunks asked for, by the asking chunk."""

    def run(left, right):
        target: list[int] = []
        passages: list[bytes] = []
        if left.num_rows and right.num_rows:
            c = Chunk(left.to_pylist()[0], window, mask)
            known, where = np.unique(c.hash, return_index=True)
            wants: dict[int, list[np.ndarray]] = {}
            for r in right.to_pylist():
                at = where[np.searchsorted(known, np.frombuffer(r["hashes"], "<u8"))]
                code = np.frombuffer(r["codes"], "<u4")
                order = np.argsort(code, kind="stable")
                cut = np.searchsorted(code[order], np.arange(1, len(r["wanted_by"])))
                for t, part in zip(r["wanted_by"], np.split(at[order], cut), strict=True):
                    wants.setdefault(t, []).append(part)
            for t, parts in wants.items():
                found = [c.text(*x) for x in c.passages(np.unique(np.concatenate(parts)), window)]
                target.append(t)
                passages.append(packed(found, 1))
        columns = [pa.array(target, pa.int64()), pa.array([x for x, _ in passages], pa.binary()), pa.array([x for _, x in passages], pa.binary()), pa.nulls(len(target), pa.int64())]
        return pa.table(columns, names=["chunk", "sizes", "passages", "first_id"])

    return run


class Letters:
    """Numbers words, one for each that some passages hold and 0 for all others; numbers are characters."""

    def __init__(self, words: Words):
        self.words = words
        self.known, self.where = np.unique(words.hash, return_index=True)
        self.by_text: dict[bytes, int] | None = None
        if not words.same(np.arange(len(words)), words, self.where[np.searchsorted(self.known, words.hash)]):
            self.by_text = {}  # two words have one hash
            for k in range(len(words)):
                self.by_text.setdefault(words.data[words.begin[k] : words.end[k]], len(self.by_text))

    def numbers(self, words: Words) -> np.ndarray:
        if self.by_text is None:
            n = np.searchsorted(self.known, words.hash)
            n[n == len(self.known)] = 0
            hit = np.nonzero(self.known[n] == words.hash)[0]
            if words.same(hit, self.words, self.where[n[hit]]):
                out = np.zeros(len(n), np.int64)
                out[hit] = n[hit] + 1
                return out
            self.by_text = {}
            for k in range(len(self.words)):
                self.by_text.setdefault(self.words.data[self.words.begin[k] : self.words.end[k]], int(np.searchsorted(self.known, self.words.hash[k])))
        get = self.by_text.get
        return np.array([get(words.data[a:b], -1) for a, b in zip(words.begin.tolist(), words.end.tolist(), strict=True)], np.int64) + 1


def lettered(numbers: np.ndarray) -> str:
    """Numbers as characters, surrogates being passed over."""
    n = numbers.copy()
    n[n >= 0xD800] += 0x800
    return n.astype("<u4").tobytes().decode("utf-32-le")


def cut(texts: list[bytes], first: list[int], window: int, most: int) -> tuple[list[bytes], list[int]]:
    """The passages, those of more than ``most`` bytes in pieces, which overlap so that each window lies in one of them whole."""
    out: list[bytes] = []
    ranks: list[int] = []
    for x, rank in zip(texts, first, strict=True):
        if len(x) <= most:
            out.append(x)
            ranks.append(rank)
            continue
        w, start, stop = Words([x]), 0, 0
        while stop < len(w):
            stop = min(len(w), max(start + window, int(np.searchsorted(w.end, w.begin[start] + most, "right"))))
            out.append(w.data[w.begin[start] : w.end[stop - 1]])
            ranks.append(rank)
            start = stop - window + 1
    return out, ranks


def shards(texts: list[bytes], first: list[int], window: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Runs of passages of about SHARD_BYTES, long ones cut.

    That bounds an automaton's letters too: its passages hold fewer different words than there are characters.
    """
    texts, first = cut(texts, first, window, SHARD_BYTES // 2)
    start = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= SHARD_BYTES or k + 1 == len(texts):
            yield texts[start : k + 1], first[start : k + 1]
            start, size = k + 1, 0


def among(x: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted ``those``."""
    if not len(those):
        return np.zeros(len(x), bool)
    at = np.searchsorted(those, x)
    at[at == len(those)] = 0
    return those[at] == x


class Passages:
    """An automaton of some passages: their blocks, and the windows around blocks that stand in many places."""

    def __init__(self, texts: list[bytes], ranks: list[int], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.words = w = Words(texts)
        self.letters = Letters(w)
        self.numbers = self.letters.numbers(w)
        self.rank = np.array(ranks, np.int64)
        self.places: list[list[int]] = []
        self.automaton = ahocorasick.Automaton()
        s, size = lettered(self.numbers), self.block
        place = np.arange(len(w)) - w.first[w.text]
        length = np.diff(w.first)[w.text]
        by_block: dict[str, list[int]] = {}
        for q in np.nonzero((place % size == 0) & (place + size <= length) & (length >= window))[0].tolist():
            by_block.setdefault(s[q : q + size], []).append(q)
        whole: dict[str, int] = {}
        for letters, at in by_block.items():
            if len(at) <= COMMON:
                self.automaton.add_word(letters, len(self.places))
                self.places.append(at)
                continue
            for q in at:
                start, stop, rank = w.first[w.text[q]], w.first[w.text[q] + 1], int(self.rank[w.text[q]])
                for k in range(max(start, q - size + 1), min(q, stop - window) + 1):
                    x = s[k : k + window]
                    whole[x] = min(rank, whole.get(x, rank))
        for letters, rank in whole.items():
            self.automaton.add_word(letters, -2 - rank)  # ranks begin at -1
        if len(self.automaton):
            self.automaton.make_automaton()

    def located(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows in ``words`` that the passages hold, and the rank of the passage of each."""
        none = np.zeros(0, np.int64)
        if not len(self.automaton):
            return none, none
        numbers = self.letters.numbers(words)
        found = list(self.automaton.iter(lettered(numbers)))
        if not found:
            return none, none
        end, value = np.array(found, np.int64).T
        direct = value < 0
        begin = end[direct] - self.window + 1
        inside = words.text[begin] == words.text[end[direct]]
        starts, ranks = [begin[inside]], [-2 - value[direct][inside]]
        end, value = end[~direct], value[~direct]
        begin = end - self.block + 1
        inside = words.text[begin] == words.text[end]
        begin, value = begin[inside], value[inside]
        many = np.array([len(x) for x in self.places], np.int64)
        flat = np.array([q for x in self.places for q in x], np.int64)
        first = np.cumsum(many) - many
        p = np.repeat(begin, many[value])
        nth = np.arange(len(p)) - np.repeat(np.cumsum(many[value]) - many[value], many[value])
        q = flat[np.repeat(first[value], many[value]) + nth]
        agree = np.zeros((len(p), self.window + self.block - 1), np.int8)
        before = self.block - 1
        for j in range(-before, self.window):
            a, b = p + j, q + j
            fits = (a >= 0) & (b >= 0) & (a < len(words)) & (b < len(self.words))
            a, b = np.where(fits, a, 0), np.where(fits, b, 0)
            agree[:, j + before] = fits & (numbers[a] == self.numbers[b]) & (words.text[a] == words.text[p]) & (self.words.text[b] == self.words.text[q])
        total = np.concatenate([np.zeros((len(p), 1), np.int16), np.cumsum(agree, axis=1, dtype=np.int16)], axis=1)
        hit, shift = np.nonzero(total[:, self.window :] - total[:, : -self.window] == self.window)
        starts.append(p[hit] + shift - before)
        ranks.append(self.rank[self.words.text[q[hit]]])
        return np.concatenate(starts), np.concatenate(ranks)


def _received(c: Chunk, right: pa.Table) -> dict[bytes, int]:
    """The passages that a chunk got, each with the rank of its first document, -1 for one of an earlier chunk."""
    out: dict[bytes, int] = {}
    for r in right.to_pylist():
        rank = -1 if r["first_id"] is None or r["first_id"] < c.names[0] else int(np.searchsorted(c.names, r["first_id"]))
        for x in unpacked(r["sizes"], r["passages"]):
            out[x] = min(rank, out.get(x, rank))
    return out


def locator(window: int, texts: bool, mask: int, settled: bool):
    """Streams a chunk's documents through automata of the passages that earlier documents have.

    The hashes of windows that recur and weren't found come with the chunk's first row, unless
    that is ``settled``.
    """

    def run(left, right):
        ids, n_words, n_removed, out, source, doubt = [], [], [], [], [], []
        chunk = None
        if left.num_rows:
            row = left.to_pylist()[0]
            chunk, c = row["chunk"], Chunk(row, window, mask)
            received = _received(c, right)
            rank = c.rank[c.words.text[c.at]]
            order = np.lexsort((c.at, rank, c.hash))
            h, by_rank = c.hash[order], rank[order]
            start = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0] if len(h) else np.zeros(0, np.int64)
            last = np.r_[start[1:], len(h)] - 1
            own = c.passages(np.sort(order[start[by_rank[last] > by_rank[start]]]), window) if len(h) else []
            held = list(received) + [c.text(*x) for x in own]
            first = list(received.values()) + [int(c.rank[c.words.text[a]]) for a, _ in own]
            word_rank = c.rank[c.words.text]
            found = np.zeros(len(c.words) + 1, bool)
            for part, ranks in shards(held, first, window):
                at, before = Passages(part, ranks, window).located(c.words)
                found[at[before < word_rank[at]]] = True
            change = np.zeros(len(c.words) + 1, np.int32)
            at = np.nonzero(found)[0]
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            if not settled and len(h):
                recurs = np.zeros(len(h), bool)
                recurs[order] = by_rank > np.repeat(by_rank[start], last - start + 1)
                for part, _ in shards(list(received), list(received.values()), window):
                    recurs |= among(c.hash, np.unique(Words(part).runs(window)[0] & np.uint64(mask)))
                missed = np.unique(c.hash[recurs & ~found[c.at]])
                doubt = [missed.astype("<u8").tobytes() if len(missed) else None]
            total = np.r_[0, np.cumsum(gone)]
            removed = total[c.words.first[1:]] - total[c.words.first[:-1]]
            ends = c.words.first.tolist()
            for d, lost in enumerate(removed.tolist()):
                a, b = ends[d], ends[d + 1]
                x = c.text(a, b) if b > a else b""
                if lost:
                    kept = b" ".join([w for w, y in zip(x.split(), gone[a:b].tolist(), strict=True) if not y]) if lost < b - a else b""
                    out.append(kept.decode("utf-8", "replace") if texts else hashlib.sha256(kept).hexdigest())
                else:
                    out.append(None if texts else hashlib.sha256(b" ".join(x.split())).hexdigest())
                if texts:
                    begin, end = c.words.starts[d : d + 2].tolist()
                    source.append(hashlib.sha256(c.words.data[begin : end - 1]).digest() if lost else None)
                ids.append(int(c.ids[d])), n_words.append(b - a), n_removed.append(lost)
        doubt += [None] * (len(ids) - len(doubt))
        columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string()), pa.array([chunk] * len(ids), pa.int64()), pa.array(doubt, pa.binary())]
        names = ["doc_id", "n_words", "n_removed", "kept", "chunk", "doubt"]
        return pa.table([*columns, pa.array(source, pa.binary())], names=[*names, "source"]) if texts else pa.table(columns, names=names)

    return run


def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), "<i8"))], names=["hash"])


def window_words(window: int, mask: int, wanted: np.ndarray):
    """(phrase, chunk, first_id, last_id) of a chunk's windows with one of these hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, window, mask)
                ends: dict[bytes, tuple[int, int]] = {}
                for at in c.at[among(c.hash, wanted)].tolist():
                    own = int(c.ids[c.words.text[at]])
                    phrase = b" ".join(c.text(at, at + window).split())
                    low, high = ends.get(phrase, (own, own))
                    ends[phrase] = (min(low, own), max(high, own))
                columns = [pa.array(list(ends), pa.binary()), pa.array([row["chunk"]] * len(ends), pa.int64()), *(pa.array([x[k] for x in ends.values()], pa.int64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["phrase", "chunk", "first_id", "last_id"])

    return run


def phrase_packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, phrase, first_id) as rows of passages."""
    for batch in batches:
        made = [packed([x.as_buffer().to_pybytes()], 1) for x in batch.column("phrase")]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.binary()), batch.column("first_id")], names=["chunk", "sizes", "passages", "first_id"])


WANTED = "bucket int, chunk bigint, hashes binary, codes binary, wanted_by array<bigint>"


def _matched(sent: DataFrame, bits: int, groups: int) -> DataFrame:
    """What each chunk is asked for. Of more than one group of ranges, each is matched in itself, then the groups' firsts."""
    if groups == 1:
        return materialise(sent.groupBy("bucket").applyInArrow(matcher(bits), WANTED), "wanted")
    near = materialise(sent.groupBy("bucket", F.expr(f"part % {groups}").alias("group")).applyInArrow(matcher(bits, True), WANTED), "wanted_near")
    far = near.filter("codes is null").select("bucket", "chunk", "hashes").groupBy("bucket").applyInArrow(matcher(bits), WANTED)
    return materialise(near.filter("codes is not null").unionByName(far), "wanted")


PASSAGES = "chunk bigint, sizes binary, passages binary, first_id bigint"


def _settle(chunks: DataFrame, passages: DataFrame, located: DataFrame, window: int, texts: bool, mask: int, schema: str) -> DataFrame:
    """``located`` with the chunks that have doubtful windows located anew, those windows being compared by their words.

    Hashes go out in blocks of DOUBTS, which bounds what the driver holds; there are as many as
    different windows share a 64-bit hash.
    """
    spark = chunks.sparkSession
    doubts = materialise(located.filter("doubt is not null").select("doubt").mapInArrow(hashes_of, "hash bigint").distinct().withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(1 << 20))), "doubts")
    blocks = max(1, -(-doubts.count() // DOUBTS))
    extra = passages
    for k in range(blocks):
        block = doubts.filter(F.pmod("block", F.lit(blocks)) == k).select("hash").toArrow().column(0).to_numpy()
        held = materialise(chunks.mapInArrow(window_words(window, mask, np.sort(block.view(np.uint64))), "phrase binary, chunk bigint, first_id bigint, last_id bigint"), "phrases")
        first = held.groupBy("phrase").agg(F.min("first_id").alias("least"))
        told = held.join(first, "phrase").filter("last_id > least").select("chunk", "phrase", F.col("least").alias("first_id"))
        extra = extra.unionByName(told.mapInArrow(phrase_packer, PASSAGES))
    # whatever chunk was told something new is located again, whether it doubted or not
    again = materialise(extra.filter("first_id is not null").select("chunk").distinct(), "chunks_again")
    redone = chunks.join(again, "chunk", "left_semi").groupBy("chunk").cogroup(extra.join(again, "chunk", "left_semi").groupBy("chunk")).applyInArrow(locator(window, texts, mask, True), schema)
    return located.join(again, "chunk", "left_anti").select(*redone.columns).unionByName(redone)


def without_id(texts: bool):
    """Rows that have no id keep all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in batch.column(1)]
            kept = [None if texts else hashlib.sha256(b" ".join(x)).hexdigest() for x in words]
            columns = [batch.column(0), pa.array([len(x) for x in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array(kept, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept"]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(words), pa.binary())] if texts else columns, names=[*names, "source"] if texts else names)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text", mask: int = _ALL_BITS, group_ranges: int = GROUP_RANGES) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row.

    ``kept`` is the SHA-256 of the kept words joined by one blank or, with ``texts``, that
    text itself for rows that lose words and null for the others; then ``source``, the SHA-256
    of the whole text as bytes, tells apart rows that repeat an id. ``mask`` clears bits of the windows' hashes,
    below the highest 16: the result is the same, by way of more doubts. ``group_ranges`` only shifts work.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = slim.filter("doc_id is not null")
    total = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    dealt = named.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        chunks = materialise(dealt.mapInArrow(chunker(chunk_bytes), "chunk bigint, ids binary, sizes binary, texts binary").withColumn("part", F.spark_partition_id()), "chunks")
    bits = max(8, int(total / _BYTES_A_WORD / BUCKET_WINDOWS).bit_length())
    sent = chunks.mapInArrow(window_senders(window, bits, mask), "part int, bucket int, chunk bigint, hashes binary")
    asked = _matched(sent, bits, -(-ranges // max(1, group_ranges)))
    passages = materialise(chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(confirmer(window, mask), PASSAGES), "passages")
    discard(asked)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, chunk bigint, doubt binary" + (", source binary" if texts else "")
    found = materialise(chunks.groupBy("chunk").cogroup(passages.groupBy("chunk")).applyInArrow(locator(window, texts, mask, False), schema), "located")
    if found.filter("doubt is not null").limit(1).count():
        found = _settle(chunks, passages, found, window, texts, mask, schema)
    else:
        discard(chunks, passages)
    found = found.drop("chunk", "doubt")
    return found.unionByName(slim.filter("doc_id is null").mapInArrow(without_id(texts), ", ".join(x for x in schema.split(", ") if x.split()[0] not in ("chunk", "doubt"))))
