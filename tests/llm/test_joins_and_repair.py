"""N-gram joins, conversation repair and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framewise.llm import conversations, overlap, spelling

DOCS = "doc_id long, text string"


def links_by_hand(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(overlap.UPPER, overlap.LOWER)))
        return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1 if w else 0))}

    sets, label = [shingles(t) for _, t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {c: min((d for (d, _), x in zip(texts, label, strict=True) if x == c and d is not None), default=None) for c in label}
    return sorted(((d, len(s), least[x]) for (d, _), s, x in zip(texts, sets, label, strict=True)), key=repr)


def test_join_against_all_pairs(spark):
    g = np.random.default_rng(5)
    texts = []
    for base in range(10):
        n = int(g.integers(1, 90))
        words = [f"W{x}" for x in g.integers(0, 40 if base % 2 else 4000, n)]
        for _ in range(7):
            c = list(words)
            for p in g.integers(0, n, int(g.integers(0, 3))):
                c[p] = f"z{g.integers(0, 3)}"
            texts.append(" ".join(c[int(g.integers(0, 2)) :]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (5, texts[60]), (None, texts[3]), (903, texts[3].lower()), (903, texts[3])]
    got = sorted(map(tuple, overlap.components(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS + ", n string, a int")).collect()), key=repr)
    assert got == links_by_hand(rows)


def test_followers_of_an_anchor_against_all_pairs(spark):
    """Near copies of two originals, most of them under the threshold to each other, with shared edits and cut ends."""
    g = np.random.default_rng(9)
    base = [f"b{x}" for x in range(160)]
    other = base[:120] + [f"o{x}" for x in range(40)]
    texts = [" ".join(base), " ".join(other)]
    for _ in range(90):
        c = list(base if g.random() < 0.6 else other)
        for p in g.choice(np.arange(0, 160, 3), int(g.integers(0, 9)), replace=False):
            c[p] = f"z{p}" if g.random() < 0.5 else f"y{g.integers(0, 10**6)}"
        texts.append(" ".join(c[: 160 - int(g.integers(0, 12)) * int(g.integers(0, 2))]))
    rows = list(enumerate(texts))
    got = sorted(map(tuple, overlap.components(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == links_by_hand(rows) and 3 < len({c for _, _, c in got}) < 80


def test_divide_skip_against_counting():
    g = np.random.default_rng(6)
    for _ in range(200):
        q = np.unique(g.integers(0, 60, int(g.integers(1, 60))))
        some = [np.unique(np.concatenate((q[g.random(len(q)) < 0.97], g.integers(0, 60, int(g.integers(0, 4)))))) for _ in range(int(g.integers(1, 30)))]
        some = [c for c in some if len(c)]
        if some:
            assert sorted(overlap.divide_skip(q, some)) == [(i, len(np.intersect1d(q, c))) for i, c in enumerate(some) if 100 * len(np.intersect1d(q, c)) >= 85 * len(np.union1d(q, c))]


def repaired_by_hand(rows):
    kept = []
    for turn, role, text in rows:
        fate = zlib.crc32(f"7:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [] if fate == 0 else [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in kept:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "-" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    turn_of, after = [t for t, _, _ in kept if t is not None], {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(kept, faults, strict=True):
        now, reach = {}, {}
        for at, (cost, audit, out) in states.items():
            for n in range(3):
                a, o = at, out
                for _ in range(n):
                    a = "a" if a == "u" else "u"
                    o += ({"u": "user:", "a": "assistant:"}[a],)
                reach.setdefault(a, []).append((cost + 3 * n, audit + "I" * n, o))
        for at, ways in reach.items():
            for cost, audit, out in ways:
                now.setdefault(at, []).append((cost + 4, audit + "D", out))
                if fault in "-t":
                    extra = 3 * (fault == "t")
                    if role[:1] and role[0] in after[at]:
                        now.setdefault(role[0], []).append((cost + extra, audit + "K", out + (f"{role}:{text}",)))
                    to = "a" if at == "u" else "u"
                    now.setdefault(to, []).append((cost + 3 + extra, audit + "R", out + ({"u": "user", "a": "assistant"}[to] + f":{text}",)))
        states = {at: min(ways) for at, ways in now.items()}
    ends = [(c + 3 * {"": 0, "s": 2, "u": 1, "a": 0}[at], x + "I" * {"": 0, "s": 2, "u": 1, "a": 0}[at], o + {"": (), "s": ("user:", "assistant:"), "u": ("assistant:",), "a": ()}[at]) for at, (c, x, o) in states.items()]
    cost, audit, out = min(ends)
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
    gaps = max(turn_of) - min(turn_of) + 1 - len(set(turn_of)) if turn_of else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair_against_all_edits(spark):
    r = random.Random(3)
    for block, n in ((256, 12), (2, 12), (3, 40)):
        cases = [[(None if r.random() < 0.05 else 2 * i + r.randint(0, 1), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["a.", "b", " ", None, "c!", "d", f"{i}?"])) for i in range(r.randint(0, n))] for _ in range(4)]
        for rows in cases:
            df = spark.createDataFrame([(7, t, role, text, "x") for t, role, text in rows] or [(8, 0, "user", "x.", "x")], "conv_id long, turn long, role string, text string, pos string")
            got = [tuple(x)[1:] for x in conversations.repaired(df, block).where("conv_id = 7").collect()]
            assert got == ([repaired_by_hand(rows)] if rows else [])


def test_repair_by_blocks_is_the_same(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet").selectExpr("conv_id % 3 as conv_id", "conv_id * 100 + turn as turn", "role", "text")
    rows = lambda b: sorted(map(tuple, conversations.repaired(df, b).collect()))
    assert rows(256) == rows(5) == rows(1)


def test_repair_of_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert conversations.repaired(spark.createDataFrame([], kind)).count() == 0
    got = {x.conv_id: x for x in conversations.repaired(spark.createDataFrame([(None, 1, "user", "a."), (None, 1, "user", "a."), (3, None, None, None), (4, 2, "user", "x" * 300_000)], kind)).collect()}
    assert set(got) == {None, 3, 4} and got[None].duplicate >= 1 and got[3].gaps == 0
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lone = conversations.repaired(spark.createDataFrame([(gone, 0, "user", "a.")], kind)).first()
    assert tuple(lone) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def near(a, b):
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def test_trie_pairs_against_all_pairs():
    r = random.Random(1)
    for _ in range(100):
        words = {"".join(r.choice("abé"[: r.randint(1, 3)]) for _ in range(r.randint(0, 7))) for _ in range(60)}
        assert set(spelling.one_edit_pairs(list(words))) == {(a, b) for a in words for b in words if a < b and near(a, b)}


@pytest.mark.parametrize("crowded", [50_000, 3])
def test_groups_lose_no_pair(spark, crowded):
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(7, 10))) for _ in range(400)})
    got = [tuple(x) for x in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), crowded).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_forms(spark):
    texts = {1: "Château " * 200 + "chateau " * 15 + "chateau2x", 2: None, 3: "", 4: "chateaux chateaux, CHATEAU× Chateau×", 5: "château " * 3}
    n = Counter()
    for d, t in [*texts.items(), (None, "château")]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    best = {w: min(((-words[x], x) for x in words if near(w, x)), default=None) for w in words}
    form = {w: b[1] if b and -b[0] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    want = sorted((w, form[w], root(w), c, sum(near(w, x) for x in words), words.get(form[w])) for w, c in words.items())
    df = spark.createDataFrame([(d, t, "word") for d, t in [*texts.items(), (None, "château")]], DOCS + ", word string")
    assert sorted(map(tuple, spelling.variants(df).collect())) == want and any(f for f in form.values())
    assert spelling.variants(df.where("false")).count() == 0 and overlap.components(df.where("false")).count() == 0
