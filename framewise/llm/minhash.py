"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification, connected classes.

A document's shingles are its runs of five white-space separated words (all its words, if fewer), with a weight: 1, or
1 + ln of how often it occurs.  Each shingle is a Poisson process whose rate is its weight; an arrival
goes to one of m registers, which keep the earliest arrival's shingle.  Two documents agree in a register with
a probability equal to the probability Jaccard similarity of their weighted shingles, and links are what reaches a threshold
in that same measure, computed exactly.  At weight 1 it is the Jaccard similarity of the sets.  Registers fill up after
about m ln m arrivals of all shingles together, and a shingle whose next arrival is later than every register's
first stops there, so the work is one arrival a shingle and a constant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 7
#: Standard deviations under the threshold at which the registers' own estimate rules a pair out: about as likely
#: to miss a pair at the threshold as the bands are.
DOUBT = 3.5
#: How many times as many centres a bucket has in each round.
MORE_CENTRES = 4
#: A band's fingerprint has LANE bits; three of them go in a word, with a free bit above each.
LANE = 20
#: Bytes of text that are handled at a time in a task; a longer text is handled alone.
CHUNK = 1 << 20

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_R_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look independent (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _R)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK)
        for name, base in (("up", _R), ("down", _R_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that begin at ``starts`` in ``data``; words of each text; offset of each word.

    A word's hash is a difference of prefix sums of byte values times powers of an odd number, modulo 2^64.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = starts[starts < n]
    begins[heads] = solid[heads]
    at = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    tails = heads[heads > 0] - 1
    ends[tails] = solid[tails]
    to = np.flatnonzero(ends) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, out=total[1:])
    words = mixed((total[to] - total[at]) * down[at])
    return words, np.diff(np.searchsorted(at, np.append(starts, n))), at


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words and the number of runs of each text (one of all words, if fewer; none without words)."""
    ends = np.cumsum(counts)
    if not len(words):
        return words, counts
    acc = np.zeros(len(words), np.uint64)
    for j in range(width):
        acc[: len(words) - j] += words[j:] * mixed(np.full(1, j + 1, np.uint64)) if j < len(words) else 0
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(words)) - np.repeat(ends - counts, counts)
    acc, at = acc[rank < n[doc]], np.cumsum(n) - n
    for d in np.flatnonzero((counts > 0) & (counts < width)):  # shorter texts: no words of the next one
        own = words[ends[d] - counts[d] : ends[d]]
        acc[at[d]] = np.sum(own * mixed(np.arange(1, len(own) + 1, dtype=np.uint64)))
    return mixed(acc), n


def distinct_shingles(sh: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 44 bits of the shingle, times) of each text's distinct shingles, in order of text and shingle."""
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = np.sort(doc << _U(44) | sh >> _U(20))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), times


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m registers with the shingle whose Poisson process of rate ``weight`` arrived there first (0: none)."""
    first = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, np.uint64)
    state = mixed(shingle + _R)
    when = np.zeros(len(doc))
    live = np.arange(len(doc))
    while len(live):
        state_l = mixed(state[live] + _R)
        state[live] = state_l
        u = ((state_l >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        t = when[live] - np.log(u) / weight[live]
        when[live] = t
        slot = doc[live] * m + (mixed(state_l ^ _U(0xD1B54A32D192ED03)) % _U(m)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        owner[slot[won]] = shingle[live[won]] + _U(1)
        latest = first.reshape(n_docs, m).max(axis=1)
        live = live[t < latest[doc[live]]]
    return owner.reshape(n_docs, m)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, where each text starts) of about ``size`` bytes at a time."""
    for whole in batches:
        text = whole.column(whole.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
        _, offsets, data = text.buffers()
        off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < whole.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
            hi = min(hi, whole.num_rows, lo + 8192)
            yield whole.slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo:hi] - off[lo]
            lo = hi


def _bit_planes(regs: np.ndarray) -> np.ndarray:
    """Two bits of every register: the words of the first bits, then those of the second."""
    bits = mixed(regs + _U(17))
    out = []
    for plane in (0, 1):
        flags = (bits >> _U(plane) & _U(1)).astype(np.uint8)
        flags = np.pad(flags, ((0, 0), (0, -flags.shape[1] % 64)))
        out.append(np.packbits(flags, axis=1, bitorder="little").view(np.int64))
    return np.concatenate(out, axis=1)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    """LANE bits of every band's key, three to a word."""
    short = np.pad(keys >> _U(64 - LANE), ((0, 0), (0, -keys.shape[1] % 3)))
    lanes = short.reshape(len(keys), -1, 3) << (np.arange(3, dtype=np.uint64) * _U(LANE + 1))
    return np.bitwise_or.reduce(lanes, axis=2).view(np.int64)


def _shared_before(x: Column, y: Column, band: Column, words: int) -> Column:
    """Whether the fingerprints of two texts agree in a band before number ``band``."""
    low = sum(((1 << LANE) - 1) << (LANE + 1) * j for j in range(3))
    flag = [1 << LANE + (LANE + 1) * j for j in range(3)]

    def agree(k: int) -> Column:
        differ = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k))) + F.lit(low)  # the free bit is set where a lane isn't 0
        told = F.when(band >= 3 * k + 3, F.lit(sum(flag))).when(band == 3 * k + 2, F.lit(flag[0] | flag[1])).when(band == 3 * k + 1, F.lit(flag[0])).otherwise(F.lit(0).cast("long"))
        return F.bitwise_not(differ).bitwiseAND(told) != 0

    return reduce(lambda a, b: a | b, map(agree, range(words)))


def _disagreements(x: Column, y: Column, words: int) -> Column:
    """In how many registers two sketches surely differ; a quarter of those that differ don't show."""
    at = lambda c, i: F.get(c, F.lit(i))
    each = [F.bit_count(at(x, i).bitwiseXOR(at(y, i)).bitwiseOR(at(x, i + words).bitwiseXOR(at(y, i + words)))) for i in range(words)]
    return sum(each[1:], each[0])


def shingle_weights(times: np.ndarray, weighted: bool) -> np.ndarray:
    return 1 + np.log(times) if weighted else np.ones(len(times))


def _band_rows(batches: Iterator[pa.RecordBatch], bands: int, rows: int, width: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in text_chunks(batches):
        words, counts, _ = word_hashes(data, starts)
        sh, n = shingle_hashes(words, counts, width)
        doc, shingle, times = distinct_shingles(sh, n)
        regs = prob_minhash(doc, shingle, shingle_weights(times, weighted), len(starts), bands * rows).reshape(-1, bands, rows)
        keys = np.zeros(regs.shape[:2], np.uint64)
        for r in range(rows):
            keys = mixed(keys * _U(31) + regs[:, :, r] + _U(r + 1))
        keys = mixed(keys ^ np.arange(1, bands + 1, dtype=np.uint64))
        planes = _bit_planes(regs.reshape(len(starts), -1))
        some = n > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))), pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * planes.shape[1], pa.int32()), pa.array(planes.reshape(-1)))
        prints = _fingerprints(keys)
        prints = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * prints.shape[1], pa.int32()), pa.array(prints.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, sketch, prints], names=["doc_id", "text_key", "bands", "sketch", "prints"])
    pa.default_memory_pool().release_unused()


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in text_chunks(batches):
        words, counts, _ = word_hashes(data, starts)
        sh, n = shingle_hashes(words, counts, width)
        doc, shingle, times = distinct_shingles(sh, n)
        cut = pa.array(np.searchsorted(doc, np.arange(len(starts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(shingle.view(np.int64)))]
        if weighted:
            lists.append(pa.ListArray.from_arrays(cut, pa.array(shingle_weights(times, True))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "shingles", "weights"][: 1 + len(lists)])


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Sum over shared shingles d of 1 / sum over all shingles e of max(wx(e) / wx(d), wy(e) / wy(d)).

    In the order of wx / wy, the greater term is that of x from d on and that of y before it, so running sums do.
    """
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = wx[i], wy[j]
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    from_x = only_x + np.cumsum(a[::-1])[::-1]
    before_y = only_y + np.cumsum(b) - b
    return float((1 / (from_x / a + before_y / b)).sum())


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, wx, y, wy = (b.column(i) for i in range(2, 6))
        at = lambda c, i: c[i].values.to_numpy(zero_copy_only=False)
        sims = [probability_jaccard(at(x, i), at(wx, i), at(y, i), at(wy, i)) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])


def _similarities(pairs: DataFrame, shingles: DataFrame, weighted: bool) -> DataFrame:
    """(a, b, similarity) of pairs (a, b)."""
    fields = [c for c in shingles.columns if c != "doc_id"]
    side = lambda k: shingles.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in fields))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    if weighted:
        return both.select("a", "b", "a_shingles", "a_weights", "b_shingles", "b_weights").mapInArrow(_similar, "a long, b long, similarity double")
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return both.select("a", "b", (shared / (F.size("a_shingles") + F.size("b_shingles") - shared)).alias("similarity"))


def spread_labels(labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``labels`` (id, label) after all that ``edges`` (a, b) connect has taken the smallest of its labels; and which labels (x) became which (to).

    Edges first become edges between labels.  Each round a label takes the smallest label next to it, and then that
    label's own label; a round is one written table, and the rounds grow with the logarithm of a chain's length.
    """
    ends = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b").where("x != y")
    both = stored(ends.select("x", "y").unionAll(ends.select("y", "x")).distinct(), "edges")
    to = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")), "roots")
    while True:
        near = both.join(to.select(F.col("x").alias("y"), F.col("to").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        leap = to.select(F.col("x").alias("to"), F.col("to").alias("leap"))
        step = to.join(near, "x").join(leap, "to").select("x", F.least("to", "near", "leap").alias("to"), (F.least("near", "leap") < F.col("to")).alias("moved"))
        to = stored(step, "roots")
        if to.where("moved").isEmpty():
            break
        to = to.select("x", "to")
    out = labels.join(to.select(F.col("x").alias("label"), "to"), "label", "left")
    return stored(out.select("id", F.coalesce("to", "label").alias("label")), "labels"), to.select("x", "to")


def duplicate_classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (smallest doc_id of its class), n_links, n_copies.

    Documents are linked if the probability Jaccard of their shingles, of weight 1 or, if ``weighted``, 1 + ln(count), is at least
    ``threshold``; classes are what links connect.  Equal texts share a class and stand for one text: n_copies counts them, n_links counts verified
    links of the text to different texts.  Null and empty texts, and null ids, are classes of their own (class_id = doc_id).
    Rows that repeat an id are copies of each other if their texts agree.

    In a bucket of a band one text, the centre, is compared with those of other classes.  Where links don't make
    one class of the bucket, its other texts go on to the next round, with MORE_CENTRES times as many centres, until
    each bucket holds one class or nothing.  So no pair of a bucket goes untried unless links have joined it before, and a
    group of copies costs as many comparisons as it has texts.  From the second round on, pairs are ruled out without a
    comparison by the triangle inequality of the Jaccard distance, over the bucket's first centre, or where
    the registers' estimate lies DOUBT standard deviations under the threshold, and a pair of several buckets is left to
    that of the first band.
    """
    #: 128 bits of the text: of equal texts only the smallest id goes on.
    slim = docs.select("doc_id", F.md5("text").alias("text_key"), "text")
    sig = stored(slim.mapInArrow(lambda it: _band_rows(it, bands, rows, width, weighted), "doc_id long, text_key string, bands array<long>, sketch array<long>, prints array<long>"), "bands")
    texts = sig.where(F.col("doc_id").isNotNull() & (F.size("bands") > 0))
    reps = stored(texts.groupBy("text_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_copies")), "reps")
    of_rep = stored(texts.join(reps, "text_key").where("doc_id = id").dropDuplicates(["id"]).select("id", "bands", "sketch", "prints"), "signatures")
    every = of_rep.select("id", F.posexplode("bands").alias("band", "bucket"))
    crowded = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = stored(every.join(crowded, "bucket").join(of_rep.drop("bands"), "id").select("id", "bucket", "band", "sketch", "prints", F.lit(None).cast("double").alias("pivot"), F.col("id").alias("label")), "buckets")
    nodes = stored(members.select("id").distinct(), "nodes")
    shingles = docs.select("doc_id", "text").join(nodes.withColumnRenamed("id", "doc_id"), "doc_id").dropDuplicates(["doc_id"])
    shingles = stored(shingles.mapInArrow(lambda it: _shingle_rows(it, width, weighted), "doc_id long, shingles array<long>" + ", weights array<double>" * weighted), "shingles")
    tried, links, labels = None, None, stored(nodes.select("id", F.col("id").alias("label")), "labels")
    registers, p = bands * rows, threshold + (1 - threshold) / 4
    most = math.ceil(registers * (1 - p + DOUBT * math.sqrt(p * (1 - p) / registers)))
    for round_no in count():
        mixed_up = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("lo != hi")
        central = (F.col("id") == F.col("least")) | (F.pmod(F.xxhash64("id", F.lit(round_no)), F.col("n")) < min(MORE_CENTRES**round_no, 1 << 40) - 1)
        open_ = members.join(mixed_up.select("bucket", "least", "n"), "bucket").select("id", "bucket", "band", "sketch", "prints", "pivot", "label", "least", central.alias("central"))
        #: From the second round on a bucket has many centres, so its members are dealt out again.
        open_ = stored(open_.repartition("id", "bucket") if round_no else open_, "open")
        if open_.isEmpty():
            break
        centres = open_.where("central").select(F.col("bucket").alias("of"), F.col("id").alias("centre"), F.col("label").alias("centre_label"), F.col("sketch").alias("centre_sketch"), F.col("pivot").alias("centre_pivot"), F.col("prints").alias("centre_prints"))
        other = (F.col("bucket") == F.col("of")) & F.expr("label != centre_label and (not central or centre < id)")
        if round_no:
            other &= F.coalesce(F.abs(F.col("pivot") - F.col("centre_pivot")) <= 1 - threshold + 1e-9, F.lit(True))
            other &= _disagreements(F.col("sketch"), F.col("centre_sketch"), -(-registers // 64)) <= most
            other &= ~_shared_before(F.col("prints"), F.col("centre_prints"), F.col("band"), -(-bands // 3))
        pairs = open_.join(centres, other).select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        told = stored(_similarities(pairs, shingles, weighted), "similarities")
        new = told.where(F.col("similarity") >= threshold).select("a", "b")
        tried = pairs if tried is None else tried.unionAll(pairs)
        members = open_.where("not central").select("id", "bucket", "band", "sketch", "prints", "pivot", "label", "least")
        if not new.isEmpty():
            links = new if links is None else links.unionAll(new)
            labels, became = spread_labels(labels, new)
            members = members.join(became.withColumnRenamed("x", "label"), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        if not round_no:
            far = told.select(F.col("a").alias("least"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("pivot"))
            members = members.drop("pivot").join(far, ["least", "id"], "left")
        members = members.drop("least")
    degree = None
    if links is not None:
        ends = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id")))
        degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    known = reps.join(labels, "id", "left")
    known = known.join(degree, "id", "left") if degree is not None else known.withColumn("links", F.lit(0).cast("long"))
    known = known.select("text_key", F.coalesce("label", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    out = sig.withColumn("k", F.when(F.col("doc_id").isNotNull() & (F.size("bands") > 0), F.col("text_key"))).join(known.withColumnRenamed("text_key", "k"), "k", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def near_deduplicated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents of a class but its smallest doc_id (one row of it); the columns of ``docs``."""
    classes = stored(duplicate_classes(docs, **how).select("doc_id", "class_id"), "classes")
    kept = docs.join(classes.where("doc_id != class_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = stored(classes.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(kept.join(again, "doc_id").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
