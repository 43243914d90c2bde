"""Problem 8: spans of at least 200 characters that stand verbatim in more than one document.

Windows of 100 characters are chosen from every run of 101 of them (the one of least hash), so any 200 characters in a
row hold at least one chosen window, and two documents that share the 200 characters choose the same one.

First pass: each partition writes its chosen windows, once per document, as (hash, document). Windows that two documents
of the partition have are repeated for certain and marked so; only the others ask the rest of the corpus. The sketch is
a two-row count-min sketch whose width follows the number of windows without any bound: it is cut into blocks of
``2 ** BLOCK_BITS`` cells a row by the first bits of the hash, and both cells of a window lie in one block. Partitions
send their sketches block by block; a block's sketches are merged where the asking windows of that block meet it, and only
windows whose cells are both counted twice pass. The sketch overestimates, so no repeated window is lost. No part of it is
ever in one place, and no asking window has more rows than there are partitions, however many documents hold it.

Second pass: the windows that passed are counted exactly, and only those of two documents are read from the texts again,
with the 100 characters on either side, grouped exactly, and grown to the left and right to see whether 200 characters
agree. Windows in more documents than ``SMALL_GROUP`` (programme headings, stock passages) are not compared in pairs;
each of the up to 101 windows of 200 characters around them becomes a key of its own, so only documents that share one
meet. The plan is the same at every size.

Copies of a text are one class during all this (by a 128-bit digest). ``links`` has one row per document with its class
and the number of documents it shares a span with; ``pairs`` expands the classes.

Defined results: null, empty and short texts (under 200 characters) take part in nothing and have 0 shared characters;
a span repeated only inside one document makes no pair; rows are documents, a doc_id given twice counts once; a document
without doc_id shares nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.scale import fits, written

SPAN = 200
WINDOW = 100
RUN = SPAN - WINDOW + 1
SIDE = SPAN - WINDOW
#: Code points hashed at once; longer texts are cut into overlapping segments.
SEGMENT = 1 << 19
SMALL_GROUP = 64
#: Cells of a block of the sketch, per row, and of these for each window; blocks are as many as the windows need.
BLOCK_BITS = 18
CELLS_PER_WINDOW = 8
#: Windows of a partition that are looked through at once for those that two of its documents have.
CHUNK = 1 << 22
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(1, 1), _powers(1, 1)]


def _window_hashes(chars: np.ndarray) -> np.ndarray:
    """Hash of every window of ``WINDOW`` characters, by differences of prefix sums modulo 2^64."""
    n = len(chars)
    if len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))]
    x = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _POWERS[0][:n], dtype=np.uint64, out=sums[1:])
    h = (sums[WINDOW:] - sums[:-WINDOW]) * _POWERS[1][: n - WINDOW + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every ``width`` values in a row."""
    n = len(x)
    blocks = -(-n // width)
    fill = np.iinfo(x.dtype).max if best is np.minimum else np.iinfo(x.dtype).min
    padded = np.full(blocks * width, fill, x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    back = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def chosen_windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, start, hash) of the chosen windows, for a few texts at a time."""
    units: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if text is None or len(text) < SPAN:
            continue
        for at in range(0, len(text) - SPAN + 1, SEGMENT):
            part = text[at : at + SEGMENT + SPAN - 1]
            units.append((i, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield _choose(units)
                units, size = [], 0
    if units:
        yield _choose(units)


def _choose(units: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(t for _, _, t in units).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for _, _, t in units])
    begin = np.cumsum(length) - length
    hashes = _window_hashes(chars)
    least = _sliding(hashes, RUN, np.minimum)
    # runs that reach over the end of their text count for nothing
    inside = np.zeros(len(least) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, np.minimum(begin + length - SPAN + 1, len(least)), -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.concatenate([np.zeros(RUN - 1, np.uint64), least, np.zeros(RUN - 1, np.uint64)])
    at = np.flatnonzero((_sliding(padded, RUN, np.maximum) == hashes) & (hashes > 0))
    unit = np.searchsorted(begin, at, "right") - 1
    return np.array([i for i, _, _ in units])[unit], at - begin[unit] + np.array([a for _, a, _ in units])[unit], _mixed(hashes[at])


def _mixed(h: np.ndarray) -> np.ndarray:
    """The hashes one to one over all of their range; those of chosen windows are small, being the least of a run."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(28)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_keys(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(fp, doc, known) of the chosen windows of ``texts`` (doc, text), once per document; ``known`` where another document
    of the same partition has the window too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, doc = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            same = h[1:] == h[:-1]
            fresh = np.concatenate([[True], ~same | (doc[1:] != doc[:-1])])
            h, doc = h[fresh], doc[fresh]
            same = h[1:] == h[:-1]
            known = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(known)], names=["fp", "doc", "known"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                docs = batch.column(0).slice(start, 1024).to_numpy()
                for doc, _, h in chosen_windows(batch.column(1).slice(start, 1024).to_pylist()):
                    held.append((h, docs[doc]))
                    size += len(h)
                    if size >= chunk:
                        yield out()
                        held, size = [], 0
        if size:
            yield out()

    return texts.select("doc", "text").mapInArrow(run, "fp bigint, doc bigint, known boolean")


def block_bits(windows: int, width: int = BLOCK_BITS) -> int:
    """Bits of the number of blocks that so many windows need, ``2 ** width`` cells each."""
    return max(0, -(-windows * CELLS_PER_WINDOW >> width) - 1).bit_length()


def _block(fp: Column, bits: int) -> Column:
    """The block of a window: the first bits of its hash."""
    return F.shiftrightunsigned(fp, 64 - bits) if bits else F.lit(0).cast("bigint")


def _cells(fp: np.ndarray, bits: int, width: int) -> list[np.ndarray]:
    """The cells of windows in either row of their blocks: the two runs of bits behind those of the block."""
    h = fp.view(np.uint64)
    return [(h >> np.uint64(64 - bits - width * (row + 1))) & np.uint64((1 << width) - 1) for row in (0, 1)]


def _counted(cells: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different cells and whether each is counted twice or more."""
    at, where = np.unique(cells, return_inverse=True)
    return at, np.bincount(where, count) > 1


def partition_sketches(keys: DataFrame, bits: int, width: int = BLOCK_BITS) -> DataFrame:
    """(block, row, at, twice): the sketch of each partition of ``keys``, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not parts or not sum(len(p[0]) for p in parts):
            return
        fp, known = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        block = (fp.view(np.uint64) >> np.uint64(64 - bits)) if bits else np.zeros(len(fp), np.uint64)
        for row, cells in enumerate(_cells(fp, bits, width)):
            at, twice = _counted(block << np.uint64(width) | cells, 1 + known)
            own = at >> np.uint64(width)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(at)]])
            inside = (at & np.uint64((1 << width) - 1)).astype(np.uint32)
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            for first in range(0, len(spans), 4096):
                some = spans[first : first + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(own[a]) for a, _ in some], pa.int64()), pa.array([row] * len(some), pa.int32()),
                        pa.array([inside[a:b].tobytes() for a, b in some], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for a, b in some], pa.binary()),
                    ],
                    names=["block", "row", "at", "twice"],
                )

    return keys.select("fp", "known").mapInArrow(run, "block bigint, row int, at binary, twice binary")


def merged(sketches: pa.Table, width: int) -> np.ndarray:
    """Whether each cell of a block, [row, cell], is counted twice or more by the sketches of all partitions together."""
    count = np.zeros((2, 1 << width), np.int64)
    for row, at, twice in zip(sketches["row"].to_pylist(), sketches["at"].to_pylist(), sketches["twice"].to_pylist()):
        cells = np.frombuffer(at, np.uint32)
        count[row, cells] += 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells))
    return count > 1


def estimated_repeated(keys: DataFrame, bits: int, width: int = BLOCK_BITS) -> DataFrame:
    """(fp, doc) of the asking windows of ``keys`` that the merged sketch estimates repeated; loses none that is."""

    def keep(asking: pa.Table, sketches: pa.Table) -> pa.Table:
        if not asking.num_rows:
            return asking.select(["fp", "doc"])
        repeated = merged(sketches, width)
        one, two = _cells(asking["fp"].to_numpy(), bits, width)
        return asking.select(["fp", "doc"]).filter(pa.array(repeated[0][one] & repeated[1][two]))

    asking = keys.where("not known").select(_block(F.col("fp"), bits).alias("block"), "fp", "doc")
    return asking.groupBy("block").cogroup(partition_sketches(keys, bits, width).groupBy("block")).applyInArrow(lambda a, b: keep(a, b), "fp bigint, doc bigint")


def _surrounded(texts: DataFrame) -> DataFrame:
    """(fp, doc, around, off, starts): the windows ``fps`` of each text, with up to ``SIDE`` characters on either side;
    those of one document with the same surroundings are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                docs, texts_ = (batch.column(c).slice(start, 1024).to_pylist() for c in (0, 1))
                lists = batch.column(2).slice(start, 1024)
                wanted, first = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                for doc, at, h in chosen_windows(texts_):
                    if not len(doc):
                        continue
                    # a window is looked up among those of its own text
                    low, high = int(doc.min()), int(doc.max())
                    own = wanted[first[low] : first[high + 1]]
                    owner = np.repeat(np.arange(low, high + 1), np.diff(first[low : high + 2]))
                    mixed = lambda d, f: f ^ (d.astype(np.int64) * np.int64(0x1E3779B97F4A7C15))
                    keep = np.isin(mixed(doc, h.view(np.int64)), mixed(owner, own))
                    found: dict[tuple, list[int]] = {}
                    for d, a, f in zip(doc[keep].tolist(), at[keep].tolist(), h[keep].view(np.int64).tolist()):
                        left = max(0, a - SIDE)
                        found.setdefault((f, docs[d], texts_[d][left : a + WINDOW + SIDE], a - left), []).append(a)
                    if found:
                        cols = [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([k[2] for k in found], pa.string()), pa.array([k[3] for k in found], pa.int32()), pa.array(list(found.values()), pa.list_(pa.int32()))]
                        yield pa.RecordBatch.from_arrays(cols, names=["fp", "doc", "around", "off", "starts"])

    return texts.select("doc", "text", "fps").mapInArrow(run, "fp bigint, doc bigint, around string, off int, starts array<int>")


def _agree(a: str, b: str) -> int:
    """Length of the common beginning of two strings of at most ``SIDE`` characters."""
    if a.startswith(b) or b.startswith(a):
        return min(len(a), len(b))
    low, high = 0, min(len(a), len(b))
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def _matches(windows: DataFrame) -> DataFrame:
    """(doc, other, low, high, starts) of windows in small groups: characters ``low`` before the window to ``high``
    behind it stand in ``other`` (the greatest reach over all others, one row per other)."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        for i, (_, d, around, off, starts) in enumerate(rows):
            for _, e, around2, off2, starts2 in rows[i + 1 :]:
                if d == e:
                    continue
                if around[off : off + WINDOW] != around2[off2 : off2 + WINDOW]:
                    continue
                left = _agree(around[:off][::-1], around2[:off2][::-1])
                right = _agree(around[off + WINDOW :], around2[off2 + WINDOW :])
                if left + WINDOW + right >= SPAN:
                    yield d, e, left, right, starts
                    yield e, d, left, right, starts2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc", "other", "low", "high", "starts"])

        held: list[tuple] = []
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found += group(held)
                    held = []
                    if len(found) > 4096:
                        yield out(found)
                        found = []
                held.append(row)
        found += group(held)
        if found:
            yield out(found)

    return windows.repartition("fp").sortWithinPartitions("fp").select("fp", "doc", "around", "off", "starts").mapInArrow(run, "doc bigint, other bigint, low int, high int, starts array<int>")


class SharedSpans:
    """The shared spans of ``documents``; ``pairs``, ``links`` and ``coverage`` read what is found once."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = BLOCK_BITS):
        docs = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"))
        self.lengths = docs.select("doc", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).distinct()
        long = docs.where((F.char_length("text") >= SPAN) & F.col("doc").isNotNull())
        digests = long.select("doc", F.md5("text").alias("digest")).distinct()
        classes = digests.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # (rep, doc) of all members of classes with several
        self.members = written(digests.join(classes, "digest").select("rep", "doc"), "copies")
        copies = self.members.where("doc <> rep").select("doc")
        single = long.join(F.broadcast(copies) if fits(copies) else copies, "doc", "left_anti")

        keys = written(window_keys(single), "keys")
        passed = written(estimated_repeated(keys, block_bits(keys.count(), width), width), "passed")
        known = keys.where("known").select("fp", "doc")
        repeated = known.unionByName(passed).groupBy("fp").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("fp")
        hits = known.unionByName(passed.join(repeated, "fp", "left_semi"))
        hits = hits.groupBy("doc").agg(F.collect_set("fp").alias("fps"))  # a document's own windows
        windows = written(_surrounded(single.join(hits.hint("shuffle_hash"), "doc")), "windows")
        groups = windows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
        groups = written(groups.select("fp", "n"), "groups")
        of_groups = lambda cond: windows.join(groups.where(cond).select("fp"), "fp")
        self.matches = written(_matches(of_groups(f"n <= {SMALL_GROUP}")), "matches")
        spans = of_groups(f"n > {SMALL_GROUP}").select(
            "doc", "off", "starts", "around", F.explode(F.expr(f"sequence(greatest(0, off - {SIDE}), least(off, char_length(around) - {SPAN}))")).alias("at")
        ).where(f"char_length(around) >= {SPAN} and at >= 0 and at <= off and at + {SPAN} <= char_length(around)")
        spans = spans.select("doc", (F.col("at") - F.col("off")).alias("shift"), "starts", F.md5(F.expr(f"substring(around, at + 1, {SPAN})")).alias("span"))
        shared = spans.groupBy("span").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("span")
        self.spans = written(spans.join(shared, "span"), "spans")

    def class_pairs(self) -> DataFrame:
        """(doc, other), doc < other: the classes that share a span, each pair once, by their representatives."""
        near = self.matches.where("doc < other").select("doc", "other").distinct()
        meet = written(self.spans.select("span", "doc").distinct(), "meet")
        # the windows along one long shared passage stand in the same documents: one of each such set is enough
        sets = meet.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("y"))
        meet = meet.join(sets.groupBy("n", "x", "y").agg(F.min("span").alias("span")).select("span"), "span")
        far = meet.join(meet.withColumnRenamed("doc", "other"), "span").where("doc < other").select("doc", "other").distinct()
        return near.union(far).distinct()

    def links(self) -> DataFrame:
        """(doc_id, class_id, n_links): each document's class, which is the least document with the same text, and the
        number of other documents it shares a span with, counted from the sizes of classes without expanding them."""
        sizes = self.members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
        pairs = self.class_pairs()
        both = pairs.union(pairs.select("other", "doc"))
        size_of = sizes.select(F.col("rep").alias("other"), "size")
        linked = both.join(size_of, "other", "left").groupBy("doc").agg(F.sum(F.coalesce("size", F.lit(1))).alias("n")).withColumnRenamed("doc", "class_id")
        own = self.lengths.join(self.members, "doc", "left").select(F.col("doc").alias("doc_id"), F.coalesce("rep", "doc").alias("class_id"))
        counted = own.join(linked, "class_id", "left").join(sizes.withColumnRenamed("rep", "class_id"), "class_id", "left")
        return counted.select("doc_id", "class_id", (F.coalesce("n", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).cast("bigint").alias("n_links"))

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b) of all pairs of documents that share a span."""
        found = self.class_pairs()
        # representatives stand for all their copies
        all_of = lambda s: self.members.select(F.col("rep").alias(s), F.col("doc").alias(f"{s}_member"))
        spread = found.join(all_of("doc"), "doc", "left").join(all_of("other"), "other", "left")
        spread = spread.select(F.coalesce("doc_member", "doc").alias("x"), F.coalesce("other_member", "other").alias("y"))
        copies = self.members.alias("a").join(self.members.alias("b"), "rep").where("a.doc < b.doc").select(F.col("a.doc").alias("x"), F.col("b.doc").alias("y"))
        return spread.union(copies).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()

    def coverage(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars): how many characters of each document lie in spans shared with another."""
        near = self.matches.select("doc", "low", "high", F.explode("starts").alias("at")).groupBy("doc", "at").agg(F.max("low").alias("low"), F.max("high").alias("high"))
        near = near.select("doc", (F.col("at") - F.col("low")).alias("lo"), (F.col("at") + WINDOW + F.col("high")).alias("hi"))
        far = self.spans.select("doc", "shift", F.explode("starts").alias("at")).select("doc", (F.col("at") + F.col("shift")).alias("lo")).distinct().select("doc", "lo", (F.col("lo") + SPAN).alias("hi"))
        # the union of a document's intervals, as a fold over them in order: a document's own length bounds their number
        every = near.union(far).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
        start = "named_struct('end', 0, 'n', 0)"
        fold = f"aggregate(spans, {start}, (s, x) -> named_struct('end', greatest(s.end, x.hi), 'n', s.n + greatest(0, x.hi - greatest(s.end, x.lo))), s -> s.n)"
        covered = every.select(F.col("doc").alias("rep"), F.expr(fold).alias("shared"))
        whole = self.members.select("doc", F.lit(True).alias("whole"))
        return (
            self.lengths.join(covered, self.lengths.doc == covered.rep, "left").join(whole, "doc", "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_chars"), F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared_chars"))
        )


def shared_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return SharedSpans(documents, key, text).pairs()


def shared_coverage(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return SharedSpans(documents, key, text).coverage()


def shared_links(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return SharedSpans(documents, key, text).links()
