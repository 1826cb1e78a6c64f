"""Sampled SentencePiece segmentations without replacement, and decoding.

Pieces come from a SentencePiece model file.  A text's lattice has a node before and after every character and an edge
for every piece; characters of no piece are bytes.  A piece's probability falls with its rank in the file, to
the power ``alpha``.  No piece goes on over a space that follows another character, nor over a line end, nor into a sign that
the vocabulary has at the start of pieces only, so the lattice is a chain of the lattices of such units, and one unit's lattice with its backward masses is kept for all its occurrences.

Segmentations are drawn by perturbed A* search with the Gumbel-top-k trick: a subtree of the search holds all
segmentations that begin with the same edges, its bound is the Gumbel-perturbed log of their mass, and going down an edge
keeps the bound for one child and gives the other children smaller ones.  Popping the best subtree k times gives k
different segmentations, in the order of their perturbed log-probabilities, drawn without replacement.  Every random
number is a hash of the row key, the sample and the place, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .minhash import mixed, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA = 2, 1.0
#: Added to ranks; log-probability of a byte of a character that no piece has.
RANK_SHIFT, BYTE_RANK = 10, 1_000_000
#: Unit lattices that a task keeps before it begins anew.
KEPT_UNITS = 120_000
#: Unit lattices built together, and bytes of text encoded together.
BUILT_UNITS, CHUNK = 10_000, 1 << 18
#: Log-probabilities are multiples of 1 / EXACT, so that their sums don't depend on what else is encoded together.
EXACT = 2.0**26
#: Subtrees under this share of the mass (in nats) aren't searched: they vanish beside 1 in double precision.
NEGLIGIBLE = -45.0

_U = np.uint64


class Vocabulary:
    """Pieces with the space written as it is, their bytes, and the trie of their characters."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        usual = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                self.byte_ids[self.bytes[-1][0]] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                usual.append((-model.get_score(i), i, piece.replace("▁", " ")))
        usual.sort()
        ranks = np.arange(len(usual)) + RANK_SHIFT
        total = math.log((1.0 / ranks).sum())
        self.byte_log = -alpha * (math.log(BYTE_RANK) + total)
        steps, self.longest = {}, max(len(x[2]) for x in usual)
        ends, logs = [-1], [0.0]
        for r, (_, i, text) in zip(ranks.tolist(), usual, strict=True):
            at = 0
            for c in map(ord, text):
                at = steps.setdefault((at, c), len(ends))
                if at == len(ends):
                    ends.append(-1)
                    logs.append(0.0)
            ends[at], logs[at] = i, -alpha * (math.log(r) + total)
        self.ends, self.logs = np.array(ends, np.int64), np.array(logs)
        self._hash(np.array([a << 21 | c for a, c in steps], np.uint64), np.array(list(steps.values()), np.int64))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.unit = re.compile(self._units([x[2] for x in usual]))

    @staticmethod
    def _units(pieces: list[str]) -> str:
        """Units begin at a space, a line end, or a sign that follows another character inside no piece."""
        follow = {c for p in pieces for x, c in zip(p, p[1:]) if x != c}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in follow)
        return rf" +[^ \n{signs}]*|[{signs}]+[^ \n{signs}]*|\n|[^ \n{signs}]+" if signs else r" +[^ \n]*|\n|[^ \n]+"

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table of the trie's steps."""
        self.mask = _U((1 << (4 * len(keys)).bit_length()) - 1)
        self.keys, self.values = np.full(int(self.mask) + 1, ~_U(0)), np.full(int(self.mask) + 1, -1, np.int64)
        slot = mixed(keys) & self.mask
        while len(keys):
            first = np.unique(slot, return_index=True)[1]
            first = first[self.keys[slot[first]] == ~_U(0)]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + _U(1)) & self.mask

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """States of the trie after one more character; -1 where no piece goes on so."""
        key = states.astype(np.uint64) << _U(21) | chars
        slot = mixed(key) & self.mask
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        open_ = np.flatnonzero((found != key) & (found != ~_U(0)))
        while len(open_):
            slot[open_] = (slot[open_] + _U(1)) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != ~_U(0))]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        n = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[at]


def _longer(x: np.ndarray, used: int, least: int) -> np.ndarray:
    """x with room for twice ``least``; what isn't used yet takes no memory."""
    out = np.zeros(2 * least, x.dtype)
    out[:used] = x[:used]
    return out


class Units(dict):
    """Unit -> its first node.  Node v has the edges [first[v], first[v + 1]), longest piece first; an edge has its node, its piece, its next
    node (-1: end of the unit), its conditional log-probability, and the probability of it and the node's edges before it."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.first = np.zeros(1 << 20, np.int64)
        self.piece, self.node, self.next = (np.zeros(1 << 21, np.int32) for _ in range(3))
        self.log, self.cum = np.zeros(1 << 21), np.zeros(1 << 21)
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.n_nodes = self.n_edges = 0

    def nodes(self, units: list[str]) -> np.ndarray:
        """First nodes of units; lattices of new units are built together."""
        new = list(set(units).difference(self))
        for lo in range(0, len(new), BUILT_UNITS):
            self._build(new[lo : lo + BUILT_UNITS])
        return np.fromiter(map(self.__getitem__, units), np.int64, len(units))

    def _build(self, new: list[str]) -> None:
        v = self.v
        chars = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        unit = np.repeat(np.arange(len(new)), sizes)
        ends = np.cumsum(sizes)
        n = len(chars)
        #: Node of a character; one more at each unit's end.
        node, last = np.arange(n) + unit, ends + np.arange(len(new))
        total = n + len(new)
        at, state = np.arange(n), np.zeros(n, np.int64)
        src, dst, piece, log = [], [], [], []
        single = np.zeros(n, bool)
        for length in range(1, v.longest + 1):
            state = v.step(state, chars[at + length - 1])
            on = state >= 0
            at, state = at[on], state[on]
            hit = v.ends[state] >= 0
            src.append(node[at[hit]])
            dst.append(node[at[hit]] + length)
            piece.append(v.ends[state[hit]])
            log.append(v.logs[state[hit]])
            if length == 1:
                single[at[hit]] = True
            on = at + length < ends[unit[at]]
            at, state = at[on], state[on]
        odd = np.flatnonzero(~single)
        raw = [chr(int(c)).encode("utf-8", "surrogatepass") for c in chars[odd]]
        src.append(node[odd])
        dst.append(node[odd] + 1)
        piece.append(-1 - np.arange(len(odd)))
        log.append(np.array([len(r) for r in raw], float) * v.byte_log)
        src, dst, piece, log = (np.concatenate(x) for x in (src, dst, piece, log))
        order = np.argsort(src * 64 + (63 - np.minimum(dst - src, 63)), kind="stable")
        src, dst, piece, log = src[order], dst[order], piece[order], log[order]
        #: Backward masses, over nodes by their distance from their unit's end.
        beta = np.zeros(total)
        away = np.repeat(last, sizes + 1)[src] - src
        by = np.argsort(away.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else away, kind="stable")
        cuts = np.flatnonzero(np.diff(away[by], prepend=0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
            e = by[a:b]
            w, s = log[e] + beta[dst[e]], src[e]
            heads = np.flatnonzero(np.diff(s, prepend=-1))
            top = np.maximum.reduceat(w, heads)
            beta[s[heads]] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.append(heads, len(s))))), heads))
        log = log + beta[dst] - beta[src]
        share = np.exp(log)
        log = np.round(log * EXACT) / EXACT
        run = np.cumsum(share)
        count = np.bincount(src, minlength=total)
        first = np.cumsum(count) - count
        run -= np.repeat(np.concatenate(([0.0], run))[first[count > 0]], count[count > 0])
        run[(first + count)[count > 0] - 1] = np.inf
        is_end = np.zeros(total, bool)
        is_end[last] = True
        to = np.where(is_end[dst], -1, dst + self.n_nodes)
        #: Characters of several bytes go over nodes of their own, one a byte.
        more: list[tuple[int, int, int]] = []
        for e in np.flatnonzero(piece < 0).tolist():
            data, target = raw[-1 - piece[e]], to[e]
            piece[e] = v.byte_ids[data[0]]
            if len(data) > 1:
                to[e] = self.n_nodes + total + len(more)
                for k, x in enumerate(data[1:], 2):
                    more.append((len(piece) + len(more), int(v.byte_ids[x]), self.n_nodes + total + len(more) + 1 if k < len(data) else target))
        extra = np.array(more, np.int64).reshape(-1, 3)
        self._append(np.concatenate([first, extra[:, 0]]), np.concatenate([piece, extra[:, 1]]), np.concatenate([to, extra[:, 2]]), np.concatenate([log, np.zeros(len(more))]), np.concatenate([run, np.full(len(more), np.inf)]), np.concatenate([src, total + np.arange(len(more))]))
        self.update(zip(new, (self.n_nodes - total - len(more) + node[ends - sizes]).tolist(), strict=True))

    def _append(self, first: np.ndarray, piece: np.ndarray, to: np.ndarray, log: np.ndarray, run: np.ndarray, node: np.ndarray) -> None:
        nodes, edges = self.n_nodes + len(first), self.n_edges + len(piece)
        if nodes + 1 > len(self.first):
            self.first = _longer(self.first, self.n_nodes + 1, nodes + 1)
        if edges > len(self.piece):
            self.piece, self.node, self.next, self.log, self.cum = (_longer(x, self.n_edges, edges) for x in (self.piece, self.node, self.next, self.log, self.cum))
        self.first[self.n_nodes : nodes], self.first[nodes] = first + self.n_edges, edges
        own = slice(self.n_edges, edges)
        self.piece[own], self.node[own], self.next[own], self.log[own], self.cum[own] = piece, node + self.n_nodes, to, log, run
        self.n_nodes, self.n_edges = nodes, edges


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashed words."""
    return ((mixed(key) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _below(log_mass: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables around ``log_mass``, given that they are under ``limit``."""
    return log_mass - np.log(np.exp(np.minimum(log_mass - limit, 700.0)) - np.log(u))


class Paths:
    """One segmentation of each of some texts: edges in text order; text i has the edges [at[i], at[i + 1])."""

    def __init__(self, edge: np.ndarray, at: np.ndarray, units: Units):
        self.edge, self.at = edge, at
        total = np.concatenate(([0.0], np.cumsum(units.log[edge])))
        counts = np.diff(at)
        self.before = total[:-1] - np.repeat(total[at[:-1]], counts)  # log-probability of the edges before each
        self.log = total[at[1:]] - total[at[:-1]]


def _walk(units: Units, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(walk, edge) of random walks from the nodes to their units' ends, in order of walk and step; each step's number is a hash of seed and place."""
    live, steps = np.flatnonzero(node >= 0), []
    node = node.astype(np.int64)
    node, place = node[live], place[live]
    seed = seed[live]
    while len(live):
        u = uniform(seed ^ mixed(place))
        e = units.first[node]
        far = np.flatnonzero(u > units.cum[e])
        while len(far):
            e[far] += 1
            far = far[u[far] > units.cum[e[far]]]
        steps.append((live, e))
        to = units.next[e]
        on = to >= 0
        live, node, seed, place = live[on], to[on], seed[on], place[on] + _U(1)
    if not steps:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.zeros(int(steps[0][0][-1]) + 1, np.int64)
    for w, _ in steps:
        n[w] += 1
    at = np.cumsum(n) - n
    edge = np.zeros(n.sum(), np.int64)
    for k, (w, e) in enumerate(steps):
        edge[at[w] + k] = e
    return np.repeat(np.arange(len(n)), n), edge


def sampled(units: Units, starts: np.ndarray, at: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[np.ndarray, Paths, np.ndarray, np.ndarray]]:
    """Up to k (texts, their paths, perturbed log-probability, inclusion score) of texts whose units begin at the nodes ``starts``.

    Text i has the units [at[i], at[i + 1]).  The inclusion score is the probability that the segmentation's perturbed
    log-probability exceeds that of the best segmentation that wasn't drawn.
    """
    n = len(keys)
    counts = np.diff(at)
    text = np.repeat(np.arange(n), counts)
    rank = np.arange(len(starts)) - np.repeat(at[:-1], counts)
    place = rank.astype(np.uint64) << _U(20)
    seeds = mixed(keys)

    def seed(sample: int) -> np.ndarray:
        return mixed(seeds + _U((sample + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))

    walk, edge = _walk(units, starts, seed(0)[text], place)
    owner = text[walk]
    paths = [(np.arange(n), Paths(edge, np.searchsorted(owner, np.arange(n + 1)), units), rank[walk])]
    score = [-np.log(-np.log(uniform(seed(0) ^ _U(7))))]
    #: Open subtrees: text, bound, log-mass, path that they leave, edge of the path where they leave it, edge that they take.
    open_: list[tuple[np.ndarray, ...]] = []

    def leave(no: int, since: np.ndarray) -> None:
        """Adds the siblings of the path's edges from number ``since`` of each of its texts on."""
        texts, p, _ = paths[no]
        some = np.flatnonzero(p.before > NEGLIGIBLE)
        mine = np.searchsorted(p.at, some, "right") - 1
        late = some - p.at[mine] >= since[mine]
        some, mine = some[late], mine[late]
        step = some - p.at[mine]
        node = units.node[p.edge[some]]
        lo, hi = units.first[node], units.first[node + 1]
        deg = hi - lo
        of = np.repeat(np.arange(len(some)), deg)
        nth = np.arange(deg.sum()) - np.repeat(np.cumsum(deg) - deg, deg)
        e = np.repeat(lo, deg) + nth
        other = e != p.edge[some[of]]
        of, e = of[other], e[other]
        where = some[of]
        t = texts[mine[of]]
        mass = p.before[where] + units.log[e]
        key = seed(no)[t] ^ mixed(step[of].astype(np.uint64) * _U(64) + nth[other].astype(np.uint64) + _U(1 << 40))
        open_.append((t, _below(mass, score[no][mine[of]], uniform(key)), mass, np.full(len(t), no), where, e))

    out = []
    leave(0, np.zeros(n, np.int64))
    for no in range(1, k + 1):
        #: The best subtree of each text: its bound, and its list and place there; lists are in order of text.
        kappa, whose, place_in = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, (t, bound, *_) in enumerate(open_):
            if len(t):
                heads = np.flatnonzero(np.diff(t, prepend=-1))
                top = np.maximum.reduceat(bound, heads)
                at_top = np.flatnonzero(bound == np.repeat(top, np.diff(np.append(heads, len(t)))))
                at_top = at_top[np.diff(t[at_top], prepend=-1) > 0]
                better = top > kappa[t[heads]]
                kappa[t[heads][better]], whose[t[heads][better]], place_in[t[heads][better]] = top[better], i, at_top[better]
        if no == k:  # what stays open decides the inclusion scores
            break
        texts = np.flatnonzero(kappa > -np.inf)
        columns, left = [], []
        for i, lists in enumerate(open_):
            taken = place_in[texts[whose[texts] == i]]
            columns.append(tuple(x[taken] for x in lists))
            stay = np.ones(len(lists[0]), bool)
            stay[taken] = False
            left.append(tuple(x[stay] for x in lists))
        open_[:] = left
        t, bound, _, parent, where, e = (np.concatenate(x) for x in zip(*columns, strict=True))
        best = np.argsort(t, kind="stable")
        edges_of, since, ranks_of, sizes = [], np.zeros(len(best), np.int64), [], np.zeros(len(best), np.int64)
        first_edges, first_at, heads = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64), []
        for i, b in enumerate(best.tolist()):
            old_texts, p, ranks = paths[parent[b]]
            a = p.at[np.searchsorted(old_texts, t[b])]
            since[i] = where[b] - a + 1
            heads.append((p.edge[a : where[b]], ranks[a : where[b]]))
            first_edges[i], first_at[i] = e[b], ranks[where[b]]
        #: What is left of the unit where the path leaves, then the units after it.
        tail = counts[texts] - first_at - 1
        u_text = np.repeat(np.arange(len(best)), tail + 1)
        u_step = np.arange(len(u_text)) - np.repeat(np.cumsum(tail + 1) - tail - 1, tail + 1)
        u_rank = first_at[u_text] + u_step
        node = np.where(u_step == 0, units.next[first_edges[u_text]], starts[np.minimum(at[texts[u_text]] + u_rank, len(starts) - 1)])
        w, more = _walk(units, node, seed(no)[texts[u_text]], (u_rank.astype(np.uint64) << _U(20)) + np.where(u_step == 0, _U(1 << 19), _U(0)))
        cut = np.searchsorted(u_text[w], np.arange(len(best) + 1))
        w_rank = u_rank[w]
        for i, (he, hr) in enumerate(heads):
            edges_of += [he, first_edges[i : i + 1], more[cut[i] : cut[i + 1]]]
            ranks_of += [hr, first_at[i : i + 1], w_rank[cut[i] : cut[i + 1]]]
            sizes[i] = len(he) + 1 + cut[i + 1] - cut[i]
        new = Paths(np.concatenate(edges_of) if edges_of else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(sizes))), units)
        paths.append((texts, new, np.concatenate(ranks_of) if ranks_of else np.zeros(0, np.int64)))
        score.append(bound[best])
        leave(no, since)
    for (texts, p, _), g in zip(paths, score, strict=True):
        with np.errstate(over="ignore"):
            out.append((texts, p, g, -np.expm1(-np.exp(p.log - kappa[texts]))))
    return out


NAMES = ["sample", "n_tokens", "log_prob", "perturbed", "inclusion", "round_trip", "ids_md5", "token_ids"]
KINDS = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string(), pa.list_(pa.int32())]
SPARK_KINDS = [T.IntegerType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.ArrayType(T.IntegerType())]
_LOADED: dict[tuple[str, float], Vocabulary] = {}


def _encode(batches: Iterator[pa.RecordBatch], k: int, alpha: float, model: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if (model, alpha) not in _LOADED:
        _LOADED[model, alpha] = Vocabulary(model, alpha)
    #: Lattices go with the task: an idle worker keeps the vocabulary only.
    units = Units(_LOADED[model, alpha])
    split = units.v.unit.findall
    n_names = len(NAMES) - (not with_ids)
    for batch, data, starts in text_chunks(batches, size=CHUNK):
        if len(units) > KEPT_UNITS:
            units.fresh()
        texts = batch.column(batch.schema.get_field_index("text")).fill_null("").to_pylist()
        found, at = [], [0]
        for t in texts:
            if t:
                found += split(" " + t)
            at.append(len(found))
        nodes, at = units.nodes(found), np.array(at)
        ids = batch.column(0)
        keys = np.array([0 if i is None else i for i in ids.to_pylist()], np.int64).view(np.uint64)
        rows, cols = [], [[] for _ in range(n_names)]
        ends = np.append(starts, len(data))
        sizes = ends[1:] - ends[:-1]
        for no, (who, p, g, q) in enumerate(sampled(units, nodes, at, keys, k)):
            pieces = units.piece[p.edge]
            back = units.v.decode(pieces)
            #: Each text that isn't empty has one byte more, the space that encoding puts first.
            its = sizes[who] + (sizes[who] > 0)
            decoded_at = np.concatenate(([0], np.cumsum(units.v.lengths[pieces])))[p.at]
            long = (decoded_at[1:] - decoded_at[:-1]) == its
            raw = pieces.astype("<i4").tobytes()
            for i, t in enumerate(who.tolist()):
                lo, hi = int(p.at[i]), int(p.at[i + 1])
                if lo == hi and no:
                    continue
                same = bool(long[i]) and np.array_equal(back[decoded_at[i] + 1 : decoded_at[i + 1]], data[ends[t] : ends[t + 1]])
                rows.append(t)
                values = [no + 1, hi - lo, p.log[i], g[i], q[i], same, hashlib.md5(raw[4 * lo : 4 * hi]).hexdigest()]
                for c, v in zip(cols, values):
                    c.append(v)
                if with_ids:
                    cols[-1].append(pieces[lo:hi])
        kept = [batch.column(i).take(pa.array(rows, pa.int32())) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, KINDS))], names=[*names, *NAMES[:n_names]])
    pa.default_memory_pool().release_unused()


def encoded(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """Up to ``k`` rows per row of ``docs`` (doc_id, text): its columns but the text, and the columns NAMES.

    Samples 1 to k are different segmentations of the whole text, by falling perturbed log-probability; texts with
    fewer segmentations give fewer rows, null and empty texts one of no tokens.  ``log_prob`` is the segmentation's log-probability,
    ``inclusion`` the probability to be among the samples given the best one left out, ``round_trip`` whether decoding gives
    the text's bytes back.  Rows are seeded by doc_id (null as 0), so a repeated row repeats its samples.  Columns
    of ``docs`` that clash with NAMES are left out.
    """
    names = ["doc_id", *(c for c in docs.columns if c not in ("doc_id", "text") and c not in NAMES), "text"]
    slim = docs.select(*names)
    new = [T.StructField(n, t) for n, t in zip(NAMES, SPARK_KINDS, strict=True)][: len(NAMES) - (not with_ids)]
    schema = T.StructType([*slim.schema.fields[:-1], *new])
    return slim.mapInArrow(lambda it: _encode(it, k, alpha, model, with_ids), schema)


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    v = Vocabulary(model, 1.0)
    for b in batches:
        texts = [None if not x.is_valid else v.decode(x.values.to_numpy(zero_copy_only=False))[1:].tobytes().decode("utf-8", "replace") for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give a null text."""
    return rows.select("doc_id", "token_ids").mapInArrow(lambda it: _decode(it, model), "doc_id long, text string")
