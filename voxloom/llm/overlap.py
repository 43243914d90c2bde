"""Problem 4: evaluation rows that also stand in the training split, as the same recording or as a near-same sentence.

Same recording: equal keys of bucket folder, source folder and file name (``recording_key``), an equi-join.

Near-same sentence: a cosine join over inverted lists of weighted vectors. A term is a word together with its
how-manieth occurrence; its squared weight is the square of the logarithm of its rarity, in whole 64ths, so sums are
exact. Of two texts whose word edit distance is at most a fifth of the longer, each lacks at most d = floor(own words/5)
terms of the other, so their dot product is at least a text's own least dot product: its squared norm less its d greatest
squared weights. (A fixed least cosine would lose pairs that differ in rare words.)

Pruning. A term's greatest weight in the other split is its own weight, or nothing where the other split hasn't the word.
Terms are taken from the greatest weight on, and only those the other split has; the residual norm behind a place is
what the terms from there on can still add to a dot product at most. A text is listed under a term only while that
residual reaches its least dot product, which the first term that a pair shares always does, on both sides. Under a
frequent term it is listed together with each term behind it that, as the second shared one, can still reach the bound;
that keeps lists short. Postings carry what a pair that meets there can reach at most, the least dot product, the number
of words and a 32-bit parity signature of them: either side's reach has to satisfy the other side's least dot product
too. Candidates are verified by their exact dot product and by their exact word edit distance, as TESTDATA.md defines the
pair by the latter.

The rarity of a fixed number of most frequent words is sent to the executors, at every size; that of each other word comes
by a join of its occurrences. All of this is between distinct texts. ``Overlaps.counts`` adds up sizes of classes of copies;
only ``Overlaps.pairs`` expands them.

Defined results: null, empty, blank and short texts make no text pair; null and empty paths, or such with fewer than
three folders and names, no recording pair; each ord pair comes once even if rows are repeated; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.lookalike import plain_form_udf, suspect
from voxloom.llm.tokenizers import WHITE
from voxloom.scale import HEAD_KEYS, head_and_tail, written

MIN_WORDS = 8
#: Two texts may differ by one word in so many.
ONE_IN = 5
#: A term of a word that more texts have is no list of its own, but one with each term behind it.
LONG_LIST = 64
#: Texts' postings that meet in one task, about a dozen from each text.
TASK_TEXTS = 1 << 14
#: Squared weights are whole multiples of one over this.
UNIT = 64


def recording_key(path: Column) -> Column:
    """bucket/source/file of a path, whatever its root, file type, case and spelling; null if it has fewer parts."""
    p = F.regexp_replace(path, rf"^[{WHITE}]+|[{WHITE}]+$", "")
    p = F.when(p.contains("%"), F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)).otherwise(p)
    p = F.regexp_replace(F.lower(F.translate(p, "\\", "/")), r"^[a-z][a-z0-9+.-]*://", "/")
    p = F.when(p.contains("..") | p.startswith("./") | p.endswith("/."), _walked(p)).when(p.contains("//") | p.contains("/./"), F.regexp_replace(p, r"/(\.?/)+", "/")).otherwise(p)
    last = F.substring_index(F.trim(p, F.lit("/")), "/", -3)
    return F.when(F.length(last) - F.length(F.replace(last, F.lit("/"), F.lit(""))) == 2, F.regexp_replace(last, r"([^/])\.[^./]*$", "$1"))


def _walked(path: Column) -> Column:
    """``path`` with its steps up taken."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def comparable_words(text: Column) -> Column:
    """Words in lower case without punctuation and look-alikes, parted by one blank; null for null."""
    # only suspect texts travel to Python
    plain = F.coalesce(plain_form_udf(F.when(suspect(text), text)), text)
    bare = F.regexp_replace(F.lower(plain), r"\p{P}+", "")
    return F.trim(F.regexp_replace(bare, rf"[{WHITE}]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squared_weight(texts: np.ndarray | int, count: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Of the ``nth`` occurrence (from 0) of a word that ``count`` of ``texts`` have, in units of 1 / ``UNIT``."""
    return np.maximum(1, np.rint(np.log1p(texts * (nth + 1) / np.maximum(count, 1)) ** 2 * UNIT)).astype(np.int64)


class _Terms:
    """The terms of a batch of texts, flat, each text's from the greatest weight on."""

    def __init__(self, words: pa.Array, rare: pa.Array, head: dict[str, tuple[int, int]], n_texts: int):
        import xxhash

        known = dict(head)
        for w in rare.flatten().to_pylist():
            known[w["w"]] = (w["n"], w["sides"])
        lists = pc.split_pattern(words, " ")
        self.length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        word_hash = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
        count, sides = (np.array([known[w][k] for w in names], np.int64) for k in (0, 1))
        row = np.repeat(np.arange(len(self.length)), self.length)
        self.start = np.cumsum(self.length) - self.length
        self.sign = np.bitwise_xor.reduceat(np.uint32(1) << (word_hash[code] & np.uint64(31)).astype(np.uint32), self.start) if len(row) else np.zeros(0, np.uint32)
        order = np.lexsort((code, row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1])
        at = np.arange(len(order))
        nth = np.empty(len(order), np.int64)
        nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        term = _mix(word_hash[code] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        weight = squared_weight(n_texts, count[code], nth)
        order = np.lexsort((term, -weight, row))  # the same order in every text
        self.row, self.term, self.weight = row, term[order], weight[order]
        self.count, self.sides = count[code][order], sides[code][order]


def _from_here(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each place the sum of its list's ``values`` from there on."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.repeat(total[start + length], length) - total[:-1]


def _postings(t: _Terms, other: int) -> tuple[np.ndarray, ...]:
    """key, text, reach of each posting of a batch's texts, and the least dot product of each text; ``other`` is the side
    the postings are to meet."""
    inside = np.arange(len(t.row)) - np.repeat(t.start, t.length)
    heavy = np.repeat(t.length // ONE_IN, t.length) > inside  # the d greatest weights
    least = np.bincount(t.row, np.where(heavy, 0, t.weight), len(t.length)).astype(np.int64)
    # only terms that the other side has can add to a dot product
    has = (t.sides & other) > 0
    row, term, weight, count = t.row[has], t.term[has], t.weight[has], t.count[has]
    length = np.bincount(row, minlength=len(t.length))
    start = np.cumsum(length) - length
    residual = _from_here(weight, start, length)
    listed = residual >= least[row]
    single = np.flatnonzero(listed & (count <= LONG_LIST))
    keys, texts, reach = [term[single]], [row[single]], [residual[single]]
    first = np.flatnonzero(listed & (count > LONG_LIST))
    end = (start + length)[row]
    step = 1
    while len(first):
        second = first + step
        first = first[second < end[first]]
        second = first + step
        # what the pair can reach falls with every step, so a term that can't reach the bound is done
        most = weight[first] + residual[second]
        first, second, most = (x[most >= least[row[first]]] for x in (first, second, most))
        keys.append(_mix(term[first] * np.uint64(0xD6E8FEB86659FD93) + term[second]))
        texts.append(row[first])
        reach.append(most)
        step += 1
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(reach), least


def postings(vectors: DataFrame, side: int, head, n_texts: int) -> DataFrame:
    """Inverted lists (key, id, n, sign, least, reach) of ``vectors`` (id, words, sides, rare), which meet those of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                t = _Terms(batch.column(1), batch.column(2), head.value, n_texts)
                key, text, reach, least = _postings(t, 3 - side)
                ids = batch.column(0).to_numpy()
                cols = [key.view(np.int64), ids[text], t.length[text].astype(np.int32), t.sign[text].view(np.int32), least[text], reach]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id", "n", "sign", "least", "reach"])

    rows = vectors.where(F.col("sides").bitwiseAND(side) > 0)
    return rows.select("id", "words", "rare").mapInArrow(run, "key bigint, id bigint, n int, sign int, least bigint, reach bigint")


def _edits_within(a: Column, b: Column) -> Column:
    """Whether the word edit distance of two word arrays is at most a fifth of the longer. Each different word of the
    two becomes a character (there are a million beyond the basic plane), and the built-in distance stops at the limit."""
    most = F.floor(F.greatest(F.size(a), F.size(b)) / ONE_IN).cast("int")

    def distance(known: Column) -> Column:
        one = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(known, w)), 8, "0")), "UTF-32")
        coded = lambda x: F.concat_ws("", F.transform(x, one))
        return F.call_function("levenshtein", coded(a), coded(b), most)

    # the list of words is bound once here; inside the inner functions it would be made again for every word
    return F.transform(F.array(F.array_distinct(F.concat(a, b))), distance)[0] >= 0


_RARE = "array<struct<w:string,n:bigint,sides:int>>"


def by_rarity(texts: DataFrame, tail: DataFrame, head) -> tuple[DataFrame, DataFrame]:
    """``texts`` (id, words, sides) in two, both with ``rare``: those of words in ``head`` only, whose list is empty, and
    those with other words, which are shuffled alone to get (w, n, sides) of these from ``tail``."""

    def kept(common: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(list(head.value), pa.string())
            for batch in batches:
                lists = pc.split_pattern(batch.column("words"), " ")
                found = np.concatenate([[0], np.cumsum(pc.is_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False))])
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                only = found[ends[1:]] - found[ends[:-1]] == np.diff(ends)
                yield batch.filter(pa.array(only if common else ~only))

        return run

    plain = texts.select("id", "words", "sides")
    schema = "id bigint, words string, sides int"
    common = plain.mapInArrow(kept(True), schema).withColumn("rare", F.array().cast(_RARE))
    rest = written(plain.mapInArrow(kept(False), schema), "rest")
    words = rest.select("id", F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    rare = words.join(tail.hint("merge"), "w").groupBy("id").agg(F.collect_list(F.struct("w", "n", F.col("sides").cast("int").alias("sides"))).alias("rare"))
    return common, written(rest.join(rare, "id"), "rare")


def near_texts(texts: DataFrame, head_words: int = HEAD_KEYS) -> DataFrame:
    """Pairs (h_a, g_a, h_b, g_b, cosine) of near-same texts, a of the training and b of an evaluation side, among the written
    ``texts`` (id, h, g, words, sides): h and g are two hashes of the words, sides is 1, 2 or 3 (both)."""
    n_texts = texts.count()
    counts = texts.select("sides", F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.bit_or("sides").alias("sides"))
    frequent, tail = head_and_tail(written(counts, "counts"), "w", keys=head_words)
    head = texts.sparkSession.sparkContext.broadcast({r["w"]: (r["n"], r["sides"]) for r in frequent.toLocalIterator()})
    common, rest = by_rarity(texts, tail, head)

    # tasks as many as the texts need, so that none grows with the data, whatever number the session sets
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_texts // TASK_TEXTS))

    def named(side: int, s: str) -> DataFrame:
        every = postings(common, side, head, n_texts).unionByName(postings(rest, side, head, n_texts)).repartition(tasks, "key")
        return every.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "sign", "least", "reach")])

    longer = F.greatest("n_a", "n_b")
    must = longer - F.floor(longer / ONE_IN)  # terms that a pair must share
    # an int is counted as the long it widens to, so its sign isn't
    differ = F.col("sign_a").bitwiseXOR(F.col("sign_b")).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    alike = F.bit_count(differ) <= F.col("n_a") + F.col("n_b") - 2 * must
    reached = F.least("reach_a", "reach_b") >= F.greatest("least_a", "least_b")
    met = named(1, "a").join(named(2, "b"), "key").where(reached & (F.least("n_a", "n_b") >= must) & alike)
    candidates = written(met.select("id_a", "id_b").distinct(), "candidates")

    pairs = candidates
    for side, s in ((2, "b"), (1, "a")):
        own = texts.where(F.col("sides").bitwiseAND(side) > 0).select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "h", "g", "words")])
        pairs = pairs.join(own, f"id_{s}").join(rest.select(F.col("id").alias(f"id_{s}"), F.col("rare").alias(f"rare_{s}")), f"id_{s}", "left")
    pairs = pairs.withColumns({f"rare_{s}": F.coalesce(f"rare_{s}", F.array().cast(_RARE)) for s in "ab"})
    apart = _edits_within(F.split("words_a", " "), F.split("words_b", " "))
    return similar(pairs, head, n_texts).where((F.col("words_a") == F.col("words_b")) | apart).select("h_a", "g_a", "h_b", "g_b", "cosine")


def similar(pairs: DataFrame, head, n_texts: int) -> DataFrame:
    """Of ``pairs`` (..., words_a, rare_a, words_b, rare_b) those whose exact dot product of weighted term vectors reaches the
    least dot product of either side. No pair within the edit bound is below that, whatever the weights. Adds ``cosine``."""
    import math

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_Terms(batch.column(f"words_{s}"), batch.column(f"rare_{s}"), head.value, n_texts) for s in "ab")
            keep, cosine = [], []
            for i in range(batch.num_rows):
                a, b = (slice(t.start[i], t.start[i] + t.length[i]) for t in (x, y))
                dot = int(x.weight[a][np.isin(x.term[a], y.term[b], assume_unique=True)].sum())
                least = max(int(t.weight[s][t.length[i] // ONE_IN :].sum()) for t, s in ((x, a), (y, b)))
                keep.append(dot >= least)
                cosine.append(dot / math.sqrt(int(x.weight[a].sum()) * int(y.weight[b].sum())))
            table = pa.Table.from_batches([batch]).append_column("cosine", pa.array(cosine, pa.float64())).filter(pa.array(keep, pa.bool_()))
            yield from table.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, schema + ", cosine double")


class Overlaps:
    """What rows of ``train`` and ``evaluation`` share; ``pairs`` and ``counts`` read what is found once."""

    def __init__(self, train: DataFrame, evaluation: DataFrame, key: str = "ord", text: str = "text", path: str = "audio_filepath", head_words: int = HEAD_KEYS):
        rows = train.select(key, text, path, F.lit(1).alias("side")).unionByName(evaluation.select(key, text, path, F.lit(2).alias("side")))
        rows = rows.select(F.col(key).alias("k"), "side", recording_key(F.col(path)).alias("rec"), comparable_words(F.col(text)).alias("words"))
        self.rows = written(rows, "rows")  # unfiltered: a filter would evaluate the expressions once more
        long = self.rows.where(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) >= MIN_WORDS - 1)
        long = long.select("k", "side", "rec", "words", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g"))
        texts = written(long.groupBy("words").agg(F.first("h").alias("h"), F.first("g").alias("g"), F.bit_or("side").alias("sides")).withColumn("id", F.monotonically_increasing_id()), "texts")
        #: (h_a, g_a, h_b, g_b): near-same texts of the two sides, each once
        self.links = written(near_texts(texts, head_words), "links")
        self.members = long.select("k", "side", "rec", "h", "g")

    def _recordings(self, side: int) -> DataFrame:
        return self.rows.where((F.col("side") == side) & F.col("rec").isNotNull()).select("rec", "k").distinct()

    def _members(self, side: int, s: str) -> DataFrame:
        return self.members.where(F.col("side") == side).select("k", "rec", F.col("h").alias(f"h_{s}"), F.col("g").alias(f"g_{s}"))

    def pairs(self) -> DataFrame:
        """(train_ord, eval_ord) of every pair of rows that share recording or sentence."""
        named = lambda df, c: df.withColumnRenamed("k", c)
        by_path = named(self._recordings(1), "train_ord").join(named(self._recordings(2), "eval_ord"), "rec").drop("rec")
        by_text = self.links.join(named(self._members(1, "a").drop("rec"), "train_ord"), ["h_a", "g_a"]).join(named(self._members(2, "b").drop("rec"), "eval_ord"), ["h_b", "g_b"])
        return by_path.unionByName(by_text.select("train_ord", "eval_ord")).distinct()

    def per_row(self) -> DataFrame:
        """(k, n): the number of training rows that each evaluation row shares recording or sentence with, if any, from the
        sizes of classes of copies and of recordings; no pair of rows is made."""
        a, b = ["h_a", "g_a"], ["h_b", "g_b"]
        train = self._members(1, "a").distinct()
        own = self._members(2, "b").distinct()
        size = train.select("k", *a).distinct().groupBy(*a).agg(F.count(F.lit(1)).alias("n"))
        by_text = self.links.join(size, a).groupBy(*b).agg(F.sum("n").alias("n"))
        by_text = own.select("k", *b).distinct().join(by_text, b).select("k", "n")
        size = self._recordings(1).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
        by_path = self._recordings(2).join(size, "rec").select("k", "n")
        # rows that share both: a row's class and recording against the linked classes' recordings
        size = train.where("rec is not null").groupBy(*a, "rec").agg(F.count(F.lit(1)).alias("n"))
        both = self.links.join(size, a).groupBy(*b, "rec").agg(F.sum("n").alias("n"))
        both = own.join(both, [*b, "rec"]).select("k", (-F.col("n")).alias("n"))
        return by_text.unionByName(by_path).unionByName(both).groupBy("k").agg(F.sum("n").alias("n")).where("n > 0")

    def counts(self, evaluation: DataFrame, key: str = "ord") -> DataFrame:
        """Pairs and touched evaluation rows per split, dataset and source of the evaluation row (null groups included)."""
        return _counted(self.per_row().withColumnRenamed("k", key), evaluation, key)


def overlaps(train: DataFrame, evaluation: DataFrame, key: str = "ord", text: str = "text", path: str = "audio_filepath") -> DataFrame:
    return Overlaps(train, evaluation, key, text, path).pairs()


def overlap_counts(pairs: DataFrame, evaluation: DataFrame, key: str = "ord") -> DataFrame:
    """Pairs and touched evaluation rows per split, dataset and source of the evaluation row (null groups included)."""
    return _counted(pairs.groupBy(F.col("eval_ord").alias(key)).agg(F.count(F.lit(1)).alias("n")), evaluation, key)


def _counted(per_row: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    return (
        evaluation.select(key, "split", "dataset", "source").join(per_row, key).groupBy("split", "dataset", "source").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("eval_rows"))
    )
