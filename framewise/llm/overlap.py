"""Joining documents by the overlap of their word n-grams: T-occurrence search with DivideSkip, components of links.

A document's set holds 64-bit hashes of its distinct shingles, so results are exact up to collisions of those.  Two sets link if
they share at least T = ceil(p (x + y) / (100 + p)) of their x and y shingles, which is a T-occurrence problem over inverted lists.

Lists are read in part only.  In the order of the hashes, a set's head is its first n - t + k shingles, where t = ceil(p n / 100) is the least
overlap that any partner needs and k a tenth of n, or SHARED where that is more: two sets that link share k of their heads, k of the smaller one.  Among the shingles of a head,
the k - 1 on the longest lists can be left out (DivideSkip's long lists): one of the short lists that remain holds both sets.
Short lists of one document drop out, so documents unlike all others cost no more than their head.

A group of near copies shares nearly all its lists, so lists alone would pair all of it.  Documents first take an anchor: of their most
crowded short list the member whose shingles are the most common, the likely original.  Most link to it at once.  Two documents of
one anchor are known by what each lacks of it and adds to it; those differences are a T-occurrence problem again, of short sets, in
which only a document that doesn't link to the anchor asks, and rare differences tell.  Documents of different anchors meet over their
lists, anchor by anchor: the distance to the other's anchor rules out, by the triangle inequality, most of its followers.
No pair that could link goes untried unless links have joined it before.

A document is compared with its candidates in blocks of bounded size: their inverted lists are split once more, the short ones
merged with a heap, and the long ones probed for what the merge leaves.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .minhash import shingle_hashes, spread_labels, text_chunks, word_hashes

WIDTH, PERCENT = 4, 85
#: How many shingles heads of small sets share at least (all that links ask, if that is less).
SHARED = 40
#: How many times as many anchors of a list are tried in each round, and how often documents that don't link to their anchor look for a better one.
MORE_CENTRES, ANCHORINGS = 4, 3
#: The similarity, in percent, that makes an anchor, and from which on similarities to anchors are worked out exactly: where it isn't
#: reached, no follower of the anchor can be near enough.
FOLLOWS = 60
#: Shingles of candidates that are compared with a centre at a time.
BLOCK = 1 << 20
#: DivideSkip's weight of a probe against a step of the merge.
PROBE = 0.0085
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def least_overlap(x: int, y: int, percent: int = PERCENT) -> int:
    return -(-percent * (x + y) // (100 + percent))


def head_sizes(n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of a set's head there are, and how many of them are short lists."""
    t = lambda m: -(-percent * m // 100)
    k = lambda m: np.maximum(-(-m // 10), np.minimum(t(m), SHARED))
    size = np.minimum(n, n - t(n) + k(n))
    return size, np.minimum(size, size - k(t(n)) + 1)


def distinct_sets(batch_words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one after the other, and how many each has."""
    sh, n = shingle_hashes(batch_words, counts, width)
    sh, doc = sh.view(np.int64), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    first = np.ones(len(sh), bool)
    first[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[first], np.bincount(doc[first], minlength=len(n))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def _heads(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in text_chunks(batches):
        words, counts, _ = word_hashes(data, starts)
        sh, n = distinct_sets(words, counts, width)
        size, short = head_sizes(n, percent)
        rank = np.arange(len(sh)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(short, pa.int64()), pa.array(size, pa.int64()), _lists(sh[rank < np.repeat(size, n)], size)], names=["doc_id", "text_key", "n", "short", "size", "head"])
    pa.default_memory_pool().release_unused()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in text_chunks(batches):
        words, counts, _ = word_hashes(data, starts)
        sh, n = distinct_sets(words, counts, width)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sh, n)], names=["node", "shingles"])


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(number, shared) of the ``candidates`` (sorted distinct values each) that share enough with the ``query``."""
    sizes = np.array([len(c) for c in candidates])
    need = [least_overlap(len(query), int(n), percent) for n in sizes]
    values = np.concatenate(candidates)
    owner = np.repeat(np.arange(len(candidates)), sizes)
    at = np.minimum(np.searchsorted(query, values), len(query) - 1)
    shared = query[at] == values
    at, owner = at[shared], owner[shared]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    lists = sorted((x.tolist() for x in np.split(owner, cuts)), key=len) if len(owner) else []
    least = min(need)
    if len(lists) < least:
        return []
    long = min(least - 1, int(least / (PROBE * math.log2(len(lists[-1])) + 1)))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    places, found = [0] * len(short), []
    while heap:
        who, times = heap[0][0], 0
        while heap and heap[0][0] == who:
            i = heap[0][1]
            times += 1
            places[i] += 1
            if places[i] < len(short[i]):
                heapq.heapreplace(heap, (short[i][places[i]], i))
            else:
                heapq.heappop(heap)
        for left, x in zip(range(len(probed), 0, -1), probed, strict=True):
            if times + left < need[who]:
                break
            j = bisect_left(x, who)
            times += j < len(x) and x[j] == who
        if times >= need[who]:
            found.append((who, times))
    return found


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, block, b, shingles) in order, each group led by its document's own row with b null, as (a, b, shared)."""
    group, query, ids, sets, out = None, None, [], [], []

    def closed() -> None:
        if ids:
            out.extend((group[0], ids[i], shared) for i, shared in divide_skip(query, sets, percent))

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "shared"])

    for batch in batches:
        offsets, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
        for i, (a, block, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            own = values[offsets[i] : offsets[i + 1]].copy()
            if (a, block) != group:
                closed()
                group, query, ids, sets = (a, block), own, [], []
            else:
                ids.append(b)
                sets.append(own)
        if out:
            yield table()
            out.clear()
    closed()
    if out:
        yield table()


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared) of the ``pairs`` (a, b, size of b's set) that are ``percent`` similar or more."""
    total = pairs.groupBy("a").agg(F.ceil(F.sum("size") / BLOCK).alias("parts"))
    dealt = pairs.join(total, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("block"))
    led = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "shingles")
    rows = led.unionAll(dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "shingles"))
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "b").mapInArrow(lambda it: _compared(it, percent), "a long, b long, shared long")


def _rarest(lists: DataFrame, by: list[str], entries: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``lists`` (by, node, size of the array, ...) with on, common, alone: the entries of each node's array that others of its group ``by`` hold too, the rarest first in one order for all, the sum of their logarithms, and how many nobody else holds."""
    each = lists.select(*by, "node", F.explode(entries).alias("e"))
    counts = each.groupBy(*by, "e").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    kept = each.join(counts, [*by, "e"]).groupBy(*by, "node").agg(F.array_sort(F.collect_list(F.struct("times", "e"))).alias("on"), F.sum(F.log2("times")).alias("common"))
    return lists.select(*(c for c in lists.columns if c in keep)).join(kept, [*by, "node"]).withColumn("alone", F.col("size") - F.size("on"))


def _first(n: Column) -> Column:
    return F.slice("on", F.lit(1), F.greatest(n - F.col("alone"), F.lit(0)).cast("int"))


class _Tried:
    """Pairs that were compared, and the overlaps that were found, as written tables."""

    def __init__(self, sets: DataFrame):
        self.sets, self.pairs, self.known = sets, None, None

    def compare(self, pairs: DataFrame, percent: int) -> DataFrame:
        """(a, b, shared) of the new ones among ``pairs`` (x, y, sizes n of x and m of y)."""
        first = F.col("x") < F.col("y")
        new = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("m")).otherwise(F.col("n")).alias("size")).distinct()
        new = stored(new.join(self.pairs, ["a", "b"], "left_anti") if self.pairs is not None else new, "pairs")
        told = stored(_overlaps(new, self.sets, percent), "overlaps")
        self.pairs = new.select("a", "b") if self.pairs is None else self.pairs.unionAll(new.select("a", "b"))
        self.known = told if self.known is None else self.known.unionAll(told)
        return told


def _linking(told: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, shared) that link."""
    both = told.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return both.where((100 + percent) * F.col("shared") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _difference_links(followers: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between ``followers`` (node, home, n, linked, label) of one anchor, by what they lack of it and add to it.

    Of an anchor of m shingles let r be how many x lacks and a how many it adds; x and y share m - r_x - r_y + (lacked by both) + (added by both), so they
    link if their differences share at least T - m + r_x + r_y entries.
    """
    asking = followers.where("not linked").select("home").distinct()
    own = followers.join(asking, "home").join(sets, "node").select("node", "home", "n", "linked", "label", F.col("shingles").alias("x"))
    both = own.join(sets.select(F.col("node").alias("home"), F.col("shingles").alias("c")), "home")
    added, lacked = F.array_except("x", "c"), F.transform(F.array_except("c", "x"), F.bitwise_not)
    d = stored(both.select("node", "home", "n", "linked", "label", F.size("c").alias("m"), F.size(lacked).alias("r"), F.size(added).alias("a"), F.concat(added, lacked).alias("delta")), "differences")
    q, size = percent / (100 + percent), F.size("delta")
    least = lambda x, y: F.ceil(percent * (x + y) / (100 + percent))
    #: What the nearest possible partner, the anchor itself, would have to share with one that asks, and the least that one that asks shares with one that is told.
    asks = size - (least(F.col("n"), F.col("m")) - F.col("m") + F.col("r")) + 1
    told = size - F.floor((1 - q) * F.col("r") + q * F.col("a") - 1e-9)
    some = d.where("size(delta) > 0").withColumn("size", F.size("delta"))
    placed = _rarest(some, ["home"], "delta", [*d.columns, "size"]).select("node", "home", "n", "m", "r", "label", "delta", F.when(~F.col("linked"), _first(asks)).alias("asks"), _first(told).alias("told"))
    placed = stored(placed, "difference-lists")
    entry = lambda c, *more: placed.select("node", "home", "label", *more, F.explode(c).alias("o")).select("node", "home", "label", *more, "o.e")
    mixed = stored(entry("asks").unionAll(entry("told")).groupBy("home", "e").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("node").alias("last")).where("lo != hi").select("home", "e"), "difference-entries")
    side = lambda c, k: entry(c, "n", "m", "r", "delta").join(mixed, ["home", "e"]).select(*(F.col(x).alias(f"{k}_{x}") for x in ("home", "e", "node", "label", "n", "m", "r", "delta")))
    like = F.expr(f"a_home = b_home and a_e = b_e and a_label != b_label and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    enough = F.size(F.array_intersect("a_delta", "b_delta")) >= least(F.col("a_n"), F.col("b_n")) - F.col("a_m") + F.col("a_r") + F.col("b_r")
    links = side("asks", "a").join(side("told", "b"), like & enough).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return stored(links.distinct(), "difference-links")


#: Words of 64 bits in which a node marks the shared shingles of its head.
MARKS = 8


def _marks() -> list[Column]:
    """Bit ``e mod 64`` of word ``e / 64 mod MARKS`` is set where an entry of the array ``on`` asks for it."""
    return [F.expr(f"aggregate(on, 0L, (acc, x) -> acc | if(pmod(shiftright(x.e, 6), {MARKS}) = {i}, shiftleft(1L, cast(x.e & 63 as int)), 0L))").alias(f"b{i}") for i in range(MARKS)]


def _heads_may_share(x: str, y: str, percent: int) -> str:
    """Whether two heads can share what links ask of them, k of the smaller set: an entry whose mark the other lacks is surely not shared."""
    lacks = lambda p, q: " + ".join(f"bit_count({p}b{i} & ~{q}b{i})" for i in range(MARKS))
    n = f"least({x}n, {y}n)"
    need = f"greatest(ceil({n} / 10), least(ceil({percent} * {n} / 100), {SHARED}))"
    return f"{x}o - ({lacks(x, y)}) >= {need} and {y}o - ({lacks(y, x)}) >= {need}"


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link if 100 * shared >= ``percent`` * united shingles of ``width`` words, lower-cased in A-Z.  component_id is the smallest doc_id that
    links reach, the row's own included; null ids take part but are never smallest.  Null texts and texts without words have no shingles and are
    alone.  Rows that repeat an id are documents of their own; an empty table gives an empty one; other columns are not looked at.
    """
    slim = docs.select("doc_id", F.md5(F.translate("text", UPPER, LOWER)).alias("text_key"), F.translate("text", UPPER, LOWER).alias("text"))
    heads = slim.mapInArrow(lambda it: _heads(it, width, percent), "doc_id long, text_key string, n long, short long, size long, head array<long>")
    heads = stored(heads.withColumn("uid", F.monotonically_increasing_id()), "heads")
    some = heads.where("n > 0")
    nodes = stored(some.groupBy("text_key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")), "nodes")
    lists = some.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "n", "short", "size", "head")
    short = _rarest(lists, [], "head", ["node", "n", "short", "size"]).withColumn("places", _first(F.col("short"))).select("node", "n", (F.col("common") / F.col("size")).alias("score"), F.size("on").alias("o"), *_marks(), F.col("places.e").alias("places"))
    members = stored(short.select(*(c for c in short.columns if c != "places"), F.explode("places").alias("s")), "members")
    sizes = stored(members.select("node", "n").distinct(), "sizes")
    alive = sizes.select("node").join(nodes, "node").select("node", "text_key", "least")
    own = slim.withColumnRenamed("doc_id", "d").join(alive, "text_key").where(F.col("d").eqNullSafe(F.col("least"))).select("node", "text")
    sets = stored(own.dropDuplicates(["node"]).mapInArrow(lambda it: _sets(it, width), "node long, shingles array<long>"), "sets")
    labels = _joined(members, sizes, _Tried(sets), percent)
    known = nodes.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = known.groupBy("label").agg(F.min("least").alias("component"))
    known = known.join(smallest, "label").select(F.col("text_key").alias("k"), "component")
    out = heads.withColumn("k", F.when(F.col("n") > 0, F.col("text_key"))).join(known, "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _anchored(members: DataFrame, sizes: DataFrame, tried: _Tried, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, home, m, shared, linked) and all links found: each node with its anchor (itself, where none is near enough), the anchor's size and their overlap."""
    state = sizes.select("node", "n", F.col("node").alias("home"), F.col("n").alias("m"), F.lit(0).cast("long").alias("shared"), F.lit(False).alias("linked"))
    links = None
    near = F.expr(f"100 * least(n, m) >= {FOLLOWS} * greatest(n, m)")
    for _ in range(ANCHORINGS):
        open_ = members.join(state.where("not linked").select("node"), "node")
        best = open_.groupBy("s").agg(F.max_by(F.struct(F.col("node").alias("centre"), F.col("n").alias("m")), F.struct(F.col("score"), -F.col("node"))).alias("c"), F.count(F.lit(1)).alias("times")).where("times > 1")
        choice = open_.join(best.select("s", "times", "c.*"), "s").where(near & (F.col("node") != F.col("centre"))).groupBy("node", "n").agg(F.max(F.struct("times", "s", "centre", "m")).alias("w"))
        asked = stored(choice.select(F.col("node").alias("x"), F.col("w.centre").alias("y"), "n", F.col("w.m").alias("m")), "choices")
        told = tried.compare(asked, FOLLOWS - (100 - percent))
        new = stored(_linking(told, sizes, percent), "links")
        links = new if links is None else links.unionAll(new)
        both = asked.join(tried.known.select("a", "b", F.col("shared").alias("its")), (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")))
        both = both.where((100 + FOLLOWS) * F.col("its") >= FOLLOWS * (F.col("n") + F.col("m"))).select(F.col("x").alias("node"), F.col("y").alias("its_home"), F.col("m").alias("its_m"), "its")
        closer = F.col("its").isNotNull() & (F.col("its") / (F.col("n") + F.col("its_m")) > F.col("shared") / (F.col("n") + F.col("m")))
        pick = lambda a, b: F.when(closer, F.col(a)).otherwise(F.col(b)).alias(b)
        state = state.join(both, "node", "left").select("node", "n", pick("its_home", "home"), pick("its_m", "m"), pick("its", "shared"))
        state = stored(state.withColumn("linked", (100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("m"))), "anchors")
        if new.isEmpty():
            break
    return state, links


def _joined(members: DataFrame, sizes: DataFrame, tried: _Tried, percent: int) -> DataFrame:
    """(id, label): the labels of all nodes after every link between them."""
    labels = stored(sizes.select(F.col("node").alias("id"), F.col("node").alias("label")), "labels")
    state, links = _anchored(members, sizes, tried, percent)
    labels, _ = spread_labels(labels, links)
    of = lambda rows: rows.join(labels.withColumnRenamed("id", "node"), "node")
    inside = _difference_links(of(state.where("home != node")), tried.sets, percent)
    labels, _ = spread_labels(labels, inside)
    away = 1 - F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    placed = state.select("node", F.col("home"), "m", F.when(F.col("home") == F.col("node"), 0.0).otherwise(away).alias("away"))
    marks = ["o", *(f"b{i}" for i in range(MARKS))]
    fields = ["node", "n", "s", "home", "m", "away", "label", *marks]
    rows = members.select("node", "n", "s", *marks).join(placed, "node").join(labels.withColumnRenamed("id", "node"), "node").select(*fields)
    allowed, exact = 1 - percent / 100 + 1e-9, FOLLOWS - (100 - percent)
    for round_no in count():
        mixed = rows.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("home").alias("h0"), F.max("home").alias("h1")).where("lo != hi and h0 != h1").select("s")
        rows = stored(rows.join(mixed, "s").select(*fields), "open")
        if rows.isEmpty():
            return labels
        own = F.max(F.when(F.col("node") == F.col("home"), F.struct(*marks)))
        classes = rows.groupBy("s", "home", "m").agg(F.count(F.lit(1)).alias("times"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.when(F.col("node") != F.col("home"), F.col("away"))).alias("far"), own.alias("own"))
        lists = classes.groupBy("s").agg(F.max(F.struct("times", "home")).alias("top"), F.count(F.lit(1)).alias("homes"))
        central = (F.col("home") == F.col("top.home")) | (F.pmod(F.xxhash64("home", F.lit(round_no)), F.col("homes")) < min(MORE_CENTRES**round_no, 1 << 40) - 1)
        chosen = classes.join(lists, "s").where(central).select(F.col("s").alias("of"), F.col("home").alias("c"), F.col("m").alias("c_n"), "lo", "hi", "far", *(F.col(f"own.{b}").alias(f"c_{b}") for b in marks))
        chosen = stored(chosen, "central")
        #: Everyone against anchors: against those with followers to know how far off they are, against the others for a link.
        ask = F.expr(f"s = of and home != c and node != c and not (lo = label and hi = label) and (far is not null and 100 * least(n, c_n) >= {exact} * greatest(n, c_n) or c_o is not null and 100 * least(n, c_n) >= {percent} * greatest(n, c_n) and {_heads_may_share('', 'c_', percent)})")
        met = stored(rows.join(chosen, ask).select("node", "n", "c", F.col("c_n").alias("cm"), "label", "far", *marks).distinct(), "met")
        first = tried.compare(met.select(F.col("node").alias("x"), F.col("c").alias("y"), "n", F.col("cm").alias("m")), exact)
        told = met.where("far is not null").join(tried.known, (F.least("node", "c") == F.col("a")) & (F.greatest("node", "c") == F.col("b")))
        reach = (1 - F.col("shared") / (F.col("n") + F.col("cm") - F.col("shared")) - allowed).alias("reach")
        told = told.select(F.col("node").alias("x_node"), F.col("n").alias("x_n"), F.col("label").alias("x_label"), "c", reach, *(F.col(b).alias(f"x_{b}") for b in marks)).distinct()
        #: The anchor's followers that are no nearer to it than that allows.
        followers = rows.where("home != node").select("node", "n", "home", "away", "label", *marks).distinct()
        near = F.expr(f"c = home and away >= reach and label != x_label and node != x_node and 100 * least(n, x_n) >= {percent} * greatest(n, x_n) and {_heads_may_share('', 'x_', percent)}")
        second = tried.compare(told.join(followers, near).select(F.col("x_node").alias("x"), F.col("node").alias("y"), F.col("x_n").alias("n"), F.col("n").alias("m")), percent)
        links = stored(_linking(first.unionAll(second), sizes, percent), "links")
        rows = rows.join(chosen.select(F.col("of").alias("s"), F.col("c").alias("home")), ["s", "home"], "left_anti").select(*fields)
        if not links.isEmpty():
            labels, became = spread_labels(labels, links)
            rows = rows.join(became.withColumnRenamed("x", "label"), "label", "left").withColumn("label", F.coalesce("to", "label")).select(*fields)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
g AS (SELECT min(doc_id) AS d, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
x AS (SELECT d, n, unnest(s) AS h FROM g),
p AS (SELECT a.d AS a, b.d AS b FROM x a JOIN x b ON a.h = b.h AND a.d < b.d AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.d, b.d, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(d, root) AS (SELECT d, d FROM g UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.d),
m AS (SELECT d, min(root) AS root FROM c GROUP BY d)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE root END AS component_id FROM s JOIN g ON g.s = list_sort(s.s) JOIN m ON m.d = g.d
"""
