"""Passages that repeat across documents, by compact windows of token min-hashes.

The tokens of a text are its five-word shingles.  Under a hash function a compact window (l, c, r) says that every
subsequence that begins in [l, c] and ends in [c, r] has its smallest hash at c; the nodes of the Cartesian tree
over the hashes are these windows, and only those of at least ``MIN_WORDS`` words matter.  The centres of such
windows are where a sliding minimum is attained, about two in that many words, and the tree is built over them alone.

Two passages that agree have the same smallest hash under every function, so windows of different documents join
on it.  The join key holds a second shingle of the window too, so that a short phrase of every document doesn't bring
all documents together: each window gives a key with the shingle TO_SIDE tokens after its centre and one with that
before it; of a passage of MIN_WORDS words, at least one of the two lies inside it, wherever its centre is.  A batch of a task gives a row for each
key, so that a key of half the corpus arrives as a row for each batch.  Documents with one key are compared word
by word along the offsets that the windows tell and those next to them, and passages are what is long and similar
enough.  A key's documents are compared with its earliest holder first; what isn't in a verified passage then goes on
to the next round, with MORE_CENTRES times as many holders to compare with, until a key is explained or empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .minhash import CHUNK, MORE_CENTRES, THRESHOLD, WIDTH, mixed, shingle_hashes, text_chunks, word_hashes

MIN_WORDS, HASHES, TO_SIDE = 50, 4, 22
#: Word-for-word stretches shorter than this don't count, and gaps up to MAX_GAP words may lie between two of a passage.
MIN_RUN, MAX_GAP = 8, 7  # a power of two, and less than that
REACH = MAX_GAP + MIN_RUN


def compact_windows(value: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the windows of at least ``least`` tokens; token i is of text doc[i], texts are [first, end)."""
    n = len(value)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = value >> bits << bits | np.arange(n, dtype=np.uint64)
    low, size = packed, 1
    while 2 * size <= least:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < least:
        low = np.minimum(low[: len(low) - (least - size)], low[least - size :])
    at = np.arange(len(low))
    low = low[at + least <= end[doc[at]]]
    centre = np.zeros(n, bool)
    centre[(low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    c = np.flatnonzero(centre)
    l, r = first[doc[c]].copy(), end[doc[c]] - 1
    stack: list[int] = []
    values, docs, places = packed[c].tolist(), doc[c].tolist(), c.tolist()
    left, right = l.tolist(), r.tolist()
    for i, v in enumerate(values):
        while stack and docs[stack[-1]] != docs[i]:
            stack.pop()
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    l, r = np.array(left, np.int64), np.array(right, np.int64)
    wide = r - l + 1 >= least
    return l[wide], c[wide], r[wide]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, starts in text_chunks(batches):
        words, counts, _ = word_hashes(data, starts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(words.view(np.int64).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int32)), lists], names=["doc_id", "n_words", "words"])


def _word_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, words of all, number of words of each) of about CHUNK / 8 words at a time; a longer text alone."""
    for whole in batches:
        off = whole.column(1).offsets.to_numpy()
        ids, words = whole.column(0).to_numpy(), whole.column(1).values.to_numpy().view(np.uint32)
        lo = 0
        while lo < whole.num_rows:
            hi = min(whole.num_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK // 8, "right")) - 1))
            yield ids[lo:hi], words[off[lo] : off[hi]].astype(np.uint64), np.diff(off[lo : hi + 1]).astype(np.int64)
            lo = hi


def _window_rows(batches: Iterator[pa.RecordBatch], hashes: int, min_words: int) -> Iterator[pa.RecordBatch]:
    least = min_words - WIDTH + 1
    for ids, words, counts in _word_chunks(batches):
        sh, n = shingle_hashes(words, counts)
        end = np.cumsum(n)
        first = end - n
        doc = np.repeat(np.arange(len(n)), n)
        keys, docs, places = [], [], []
        for f in range(hashes):
            value = mixed(sh + mixed(np.full(1, f + 1, np.uint64)))
            l, c, r = compact_windows(value, doc, first, end, least)
            for side in (0, 1):
                other = c + TO_SIDE * (1 - side * 2)
                ok = (other >= l) & (other <= r)
                at, other = c[ok], other[ok]
                keys.append(mixed(value[at] ^ mixed(sh[other] + np.uint64(2 * f + side))))
                docs.append(ids[doc[at]])
                places.append(at - first[doc[at]])
        key, d, p = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
        order = np.lexsort((p, d, key))
        key, d, p = key[order], d[order], p[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        cut = pa.array(np.append(head, len(key)), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (d, p.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), *lists], names=["key", "docs", "places"])


_PLACE = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64))


def _shingle_set(words: np.ndarray) -> np.ndarray:
    acc, words = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64), words.astype(np.uint64)
    for j in range(WIDTH):
        acc += words[j : j + len(acc)] * _PLACE[j]
    return np.unique(acc)


def _runs(a: np.ndarray, b: np.ndarray, shift: int) -> list[tuple[int, int, int, int]]:
    """Maximal stretches a[i0:i1] == b[i0 - shift : i1 - shift] of at least MIN_RUN words."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi - lo < MIN_RUN:
        return []
    same = np.concatenate(([False], a[lo:hi] == b[lo - shift : hi - shift], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    return [(lo + s, lo + e, lo + s - shift, lo + e - shift) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if e - s >= MIN_RUN]


def _beside(a: np.ndarray, padded: np.ndarray, pad: int, shift: int, lo: int, hi: int) -> np.ndarray:
    """A row for each offset at most MAX_GAP from ``shift``, the greatest first: which of a[lo:hi] is equal along it.  b is padded on both ends."""
    lo, hi = max(lo, 0), min(hi, len(a))
    at = lo - shift + pad - MAX_GAP
    if hi <= lo or at < 0 or at + hi - lo + 2 * MAX_GAP > len(padded):
        return np.zeros((2 * MAX_GAP + 1, 0), bool)  # the views below stay inside of padded
    size = padded.itemsize
    return np.lib.stride_tricks.as_strided(padded[at:], (2 * MAX_GAP + 1, hi - lo), (size, size)) == a[lo:hi]


def _near_shifts(a: np.ndarray, padded: np.ndarray, pad: int, shift: int, lo: int, hi: int) -> list[int]:
    """Offsets at most MAX_GAP from ``shift`` along which a[lo:hi] has a run of MIN_RUN words."""
    same, step = _beside(a, padded, pad, shift, lo, hi), 1
    while step < MIN_RUN:
        same, step = same[:, :-step] & same[:, step:], 2 * step
    return [shift + MAX_GAP - int(k) for k in np.flatnonzero(same.any(axis=1))]


def _all_runs(a: np.ndarray, b: np.ndarray, padded: np.ndarray, pad: int, first: int, seen: set[int], told: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs along an offset, and along those at most MAX_GAP away on which the words go on past an end of a run.

    ``seen`` gets the offsets.  A run counts if MIN_RUN of its words aren't ``told`` of yet, so that a text of one word or a few
    in turn, where words go on along each offset, isn't gone through again for each of them.
    """
    todo, out, told = [first], [], told.copy()
    seen.add(first)
    while todo:
        shift = todo.pop()
        found = []
        for x in _runs(a, b, shift):
            if x[1] - x[0] - int(np.count_nonzero(told[x[0] : x[1]])) >= MIN_RUN:
                told[x[0] : x[1]] = True
                found.append(x)
        out += found
        for i0, i1, j0, j1 in found:
            ends = [(i0 - REACH, i0 + WIDTH)] * (i0 > 0 and j0 > 0) + [(i1 - WIDTH, i1 + REACH)] * (i1 < len(a) and j1 < len(b))
            for s in (s for lo, hi in ends for s in _near_shifts(a, padded, pad, shift, lo, hi)):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
    return out


def _chained(runs: list[tuple[int, int, int, int]], threshold: float) -> list[tuple[int, int, int, int, int]]:
    """Stretches (a0, a1, b0, b1, number of runs), made of runs in order while the Jaccard of their shingles stays high enough."""
    chains: list[tuple[int, int, int, int, int, int]] = []
    live: list[int] = []
    for i0, i1, j0, j1 in sorted(runs):
        own = max(0, i1 - i0 - WIDTH + 1)
        live = [k for k in live if i0 - chains[k][1] <= MAX_GAP]
        if any(i0 >= chains[k][0] and i1 <= chains[k][1] and j0 >= chains[k][2] and j1 <= chains[k][3] for k in live):
            continue
        for k in reversed(live):
            a0, a1, b0, b1, same, n = chains[k]
            if i1 > a1 and -WIDTH < i0 - a1 and -WIDTH < j0 - b1 <= MAX_GAP and j1 > b1:
                both = same + own
                if both >= threshold * (i1 - a0 + j1 - b0 - 2 * WIDTH + 2 - both):
                    chains[k] = (a0, i1, b0, j1, both, n + 1)
                    break
        else:
            live.append(len(chains))
            chains.append((i0, i1, j0, j1, own, 1))
    return [(a0, a1, b0, b1, n) for a0, a1, b0, b1, _, n in chains]


def passages(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """(start, end) in a and in b, and shingle Jaccard, of passages along the offsets of (place in a, place in b) and those next to them.

    An anchor that lies in a passage already found tells nothing new, so a text that repeats itself costs no more than another.
    Nor does one around which too few words agree for ``min_words`` of a similar passage.
    """
    pad = min_words + WIDTH + 2 * MAX_GAP + REACH
    padded = np.concatenate((np.full(pad, -1, b.dtype), b, np.full(pad, -1, b.dtype)))
    out: list[tuple[int, int, int, int, float]] = []
    seen: set[int] = set()
    told = np.zeros(len(a), bool)
    for i, j in sorted(anchors):
        if told[i] or i - j in seen or np.count_nonzero(_beside(a, padded, pad, i - j, i - min_words, i + min_words + WIDTH).any(axis=0)) < threshold * min_words:
            continue
        for a0, a1, b0, b1, n in _chained(_all_runs(a, b, padded, pad, i - j, seen, told), threshold):
            if min(a1 - a0, b1 - b0) < min_words:
                continue
            similarity = 1.0
            if n > 1:
                x, y = _shingle_set(a[a0:a1]), _shingle_set(b[b0:b1])
                both = len(np.intersect1d(x, y, assume_unique=True))
                similarity = both / (len(x) + len(y) - both)
            if similarity >= threshold:
                told[a0:a1] = True
                out.append((a0, a1, b0, b1, similarity))
    return out


def _aligned(lists: pa.Array, at: np.ndarray, reach: int, fill: int) -> np.ndarray:
    """A row for each list of words, its place ``at`` in column ``reach``, of 2 reach + WIDTH columns; ``fill`` where there are no words."""
    words, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(sizes), 2 * reach + WIDTH), fill, np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes - reach + at, sizes)
    inside = (col >= 0) & (col < out.shape[1])
    out[row[inside], col[inside]] = words[inside]
    return out


def may_hold(a: np.ndarray, b: np.ndarray, min_words: int, threshold: float) -> np.ndarray:
    """For rows of words around two places: whether some ``min_words`` words of a around its place are nearly as similar as they must be to words of b at most MAX_GAP places off.

    A similarity of t leaves 2 t / (1 + t) of the shingles in common; a twentieth less will do here.  A passage that is similar as a whole
    has such words somewhere, and window centres among them.
    """
    n, lo, hi = min_words - WIDTH + 1, MAX_GAP, a.shape[1] - MAX_GAP
    common = np.zeros((len(a), hi - lo - WIDTH + 1), bool)
    for s in range(-MAX_GAP, MAX_GAP + 1):
        same = a[:, lo:hi] == b[:, lo + s : hi + s]
        for step in (1, 2, WIDTH - 4):  # runs of 2, 4 and 5 words
            same = same[:, :-step] & same[:, step:]
        common |= same
    total = np.zeros((len(a), common.shape[1] + 1), np.int16)
    np.cumsum(common, axis=1, out=total[:, 1:])
    within = total[:, n:] - total[:, :-n]
    return within[:, max(0, min_words - n + 1) : min_words + 1].max(axis=1) >= 0.95 * 2 * threshold / (1 + threshold) * n


LINKS = "doc_id long, src_doc long, shift int, pos int"


def _agreeing(batches: Iterator[pa.RecordBatch], min_words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, src_doc, shift, pos, words around pos, place of pos in them, the same two of the source) what may lie in a passage."""
    reach = min_words + MAX_GAP
    for whole in batches:
        for lo in range(0, whole.num_rows, 2048):
            t = whole.slice(lo, 2048)
            a, b = (_aligned(t.column(i), t.column(i + 1).to_numpy().astype(np.int64), reach, fill) for i, fill in ((4, -1), (6, -2)))
            yield t.select(["doc_id", "src_doc", "shift", "pos"]).filter(pa.array(may_hold(a, b, min_words, threshold)))


OUT = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, source_end int, similarity double"


def _compare(batches: Iterator[pa.RecordBatch], min_words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OUT.split(", ")]
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            t = whole.slice(lo, 256)
            rows = []
            for d, s, at, a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist(), t.column(3), t.column(4), strict=True):
                anchors = [(x["pos"], x["src_pos"]) for x in at]
                for a0, a1, b0, b1, sim in passages(a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False), anchors, min_words, threshold):
                    rows.append((d, a0, a1, s, b0, b1, sim))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that an earlier document holds too: spans in words (end exclusive) of both, and their similarity.

    A passage has at least ``min_words`` white-space separated words, and the Jaccard similarity of the two spans'
    shingles is at least ``threshold``.  Earlier means a smaller doc_id; a passage is linked to the first document that holds
    it, or where that one's differs too much, to later ones that hold it too.  Repeats inside one document don't count.  Null texts, texts of
    fewer words and rows with a null doc_id give no rows.  Rows that repeat a doc_id are one document, whose text is that
    of the smallest MD5.  A document whose text is an earlier one's is one passage of it, and isn't compared with others.  Texts are
    taken whole; other columns of ``docs`` aren't read.
    """
    known = docs.select("doc_id", F.md5("text").alias("text_key"), "text").where("doc_id is not null and text is not null")
    #: Of an id's texts one stands, and of equal texts the one of the smallest id; copies are linked to it as a whole.
    one = stored(known.groupBy("doc_id").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("rows")), "passage-texts")
    groups = stored(one.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "passage-copies")
    copies = stored(one.join(groups, "text_key").where("doc_id != first").select("doc_id", "first"), "passage-copies")
    if not one.where("rows > 1").isEmpty():
        known = known.join(one.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id"])
    words = stored(known.select("doc_id", "text").join(copies.select("doc_id"), "doc_id", "left_anti").mapInArrow(_word_rows, "doc_id long, n_words int, words array<int>"), "passage-words")
    lengths = words.select("doc_id", "n_words")
    rows = words.where(F.col("n_words") >= min_words).select("doc_id", "words").mapInArrow(lambda it: _window_rows(it, hashes, min_words), "key long, docs array<long>, places array<int>")
    same = W.partitionBy("key")
    rows = rows.withColumn("lo", F.min(F.get("docs", F.lit(0))).over(same)).withColumn("hi", F.max(F.element_at("docs", -1)).over(same)).where("lo != hi")
    members = stored(rows.select("key", F.explode(F.arrays_zip("docs", "places")).alias("at")).select("key", F.col("at.docs").alias("doc_id"), F.col("at.places").alias("pos")), "passage-windows")
    words = stored(words.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "passage-words")
    found, tried = docs.sparkSession.createDataFrame([], OUT), None
    for round_no in count():
        groups = members.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi")
        central = (F.col("doc_id") == F.col("lo")) | (F.pmod(F.xxhash64("doc_id", F.lit(round_no)), F.col("n")) < min(MORE_CENTRES**round_no, 1 << 40) - 1)
        around = ["pos", "near_at", "near"] if round_no else ["pos"]
        open_ = stored(members.join(groups.select("key", "lo", "n"), "key").select("key", "doc_id", *around, central.alias("central")), "passage-open")
        if open_.isEmpty():
            break
        centres = open_.where("central").groupBy(F.col("key").alias("of"), F.col("doc_id").alias("centre")).agg(F.min(F.struct(*around)).alias("its"))
        met = open_.select("key", "doc_id", "central", F.struct(*around).alias("own")).join(centres, (F.col("key") == F.col("of")) & F.expr("doc_id != centre and (not central or centre < doc_id)"))
        later = F.col("doc_id") > F.col("centre")
        met = met.select(F.greatest("doc_id", "centre").alias("doc_id"), F.least("doc_id", "centre").alias("src_doc"), F.when(later, F.col("own")).otherwise(F.col("its")).alias("x"), F.when(later, F.col("its")).otherwise(F.col("own")).alias("y"))
        links = met.select("doc_id", "src_doc", (F.col("x.pos") - F.col("y.pos")).alias("shift"), F.col("x.pos").alias("pos"), *([] if not round_no else ["x.near", "x.near_at", F.col("y.near").alias("other"), F.col("y.near_at").alias("other_at")]))
        if round_no:
            links = links.mapInArrow(lambda it: _agreeing(it, min_words, threshold), LINKS)
        links = links.groupBy("doc_id", "src_doc", "shift").agg(F.min("pos").alias("pos"))
        if tried is not None:
            links = links.join(tried, ["doc_id", "src_doc", "shift"], "left_anti")
        links = stored(links, "passage-links")
        tried = links.drop("pos") if tried is None else tried.unionAll(links.drop("pos"))
        pairs = links.groupBy("doc_id", "src_doc").agg(F.collect_list(F.struct("pos", (F.col("pos") - F.col("shift")).alias("src_pos"))).alias("anchors"))
        both = pairs.join(words.select("doc_id", F.col("words").alias("a")), "doc_id").join(words.select(F.col("doc_id").alias("src_doc"), F.col("words").alias("b")), "src_doc")
        new = stored(both.select("doc_id", "src_doc", "anchors", "a", "b").mapInArrow(lambda it: _compare(it, min_words, threshold), OUT), "passages")
        found = found.unionAll(new)
        spans = new.select(F.col("doc_id").alias("in_doc"), "start_word", "end_word").distinct()
        members = open_.where("not central").join(spans, F.expr("doc_id = in_doc and pos >= start_word and pos < end_word"), "left_anti").select("key", "doc_id", *around)
        if not round_no:  # far fewer texts go on, and each place with the words around it, so that places that can't agree go before whole texts are compared
            members = stored(members, "passage-windows")
            words = stored(words.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "passage-words")
            reach = min_words + MAX_GAP
            at = F.least("pos", F.lit(reach))
            members = stored(members.join(words, "doc_id").select("key", "doc_id", "pos", at.alias("near_at"), F.slice("words", F.col("pos") - at + 1, at + reach + WIDTH).alias("near")), "passage-windows")
    whole = lengths.where(F.col("n_words") >= min_words).withColumnRenamed("doc_id", "first")
    zero = F.lit(0)
    alike = copies.join(whole, "first").select("doc_id", zero.alias("start_word"), F.col("n_words").alias("end_word"), F.col("first").alias("source_doc_id"), zero.alias("source_start"), F.col("n_words").alias("source_end"), F.lit(1.0).alias("similarity"))
    return found.unionAll(alike)
