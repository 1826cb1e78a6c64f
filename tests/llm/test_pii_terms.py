"""Disclosing terms against a brute-force version over a planted table."""

import math
import re

import numpy as np
import pytest

from framewise.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


PLAIN = 400


def planted():
    g = np.random.default_rng(5)
    common = ["".join(w) for w in g.choice(list("abcdefghilmnoprstu"), (800, 6))]
    prose = lambda n: " ".join(g.choice(common, n))
    texts = [prose(40) for _ in range(PLAIN)]
    for i in range(6):  # one person: a nickname that occurs nowhere else, far from the address, and one that mostly goes with it
        head = f"Zorblax {prose(30 + i)} "
        texts.append(head + ("Quindle " if i < 5 else "") + prose(200) + f" zed@corp.example.org {prose(9)} zorblax")
    texts += [texts[PLAIN]] * 40  # copies aren't evidence, but count alike in both shares
    texts += [f"quindle {prose(20)}"] * 1
    texts += [f"{prose(60)} hapaxword near@once.example.org {prose(5)}", f"{prose(50)} +49 (30) 555-0101 {prose(7)}", None, "", "élan.bob@corp.example.net"]
    for _ in range(4):  # copies of one text with a word changed tell nothing
        texts.append(f"Twinterm {prose(1)} {' '.join(common[:300])} twin@corp.example.com")
    return texts


def brute_force(spark, texts, generalise=pii.GENERALISE, remove=pii.REMOVE, min_bits=pii.MIN_BITS):
    """{entity: {term: action}}, by loops over documents; email entities only."""
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", EMAIL.sub(" ", t or ""))} for t in texts]
    ents = [{"email:" + m.lower() for m in EMAIL.findall(t or "")} for t in texts]
    every = sorted({w for ws in words for w in ws})
    hashed = {j: dict(spark.createDataFrame([(w,) for w in every], "w string").selectExpr("w", f"xxhash64({j}, w)").collect()) for j in range(pii.SKETCHES)}
    out, n = {}, len(texts)
    for e in {x for es in ents for x in es}:
        have = [i for i in range(n) if e in ents[i]]
        ic = -math.log2(min(len(have) / n, 0.5))
        for t in {w for i in have for w in words[i]}:
            both, docs = [i for i in have if t in words[i]], sum(t in ws for ws in words)
            different = {texts[i]: words[i] for i in both}
            if any(len({min(hashed[j][w] for w in ws) for ws in different.values()}) < 2 for j in range(pii.SKETCHES)):
                continue
            pmi = ic + math.log2(min(1.0, len(both) / docs))
            if pmi / ic >= generalise and len(different) * pmi >= min_bits:
                out.setdefault(e, {})[t] = "remove" if pmi / ic >= remove else "generalise"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string").repartition(3)


def test_terms_against_brute_force(spark, docs):
    want = brute_force(spark, planted())
    assert want["email:zed@corp.example.org"]["zorblax"] == "remove" and want["email:zed@corp.example.org"]["quindle"] == "remove"
    assert "email:twin@corp.example.com" not in want and "email:near@once.example.org" not in want
    texts = pii.protected_texts(pii.base_spans(docs))
    got = {}
    for r in pii.disclosing_terms(pii.term_pairs(texts, docs)).collect():
        got.setdefault(r.entity, {})[r.term] = r.action
    assert got == want


def test_marks_stand_where_the_terms_do(spark, docs):
    want, texts = brute_force(spark, planted()), planted()
    got = {r.doc_id: {(s.start, s.end, s.action) for s in r.term_spans} for r in pii.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        held = {"email:" + m.lower() for m in EMAIL.findall(t or "")}
        actions = {}
        for e in held & set(want):
            for term, action in want[e].items():
                actions[term] = max(action, actions.get(term, ""))
        clear = EMAIL.sub(lambda m: " " * len(m[0]), t or "")
        assert got[i] == {(m.start(), m.end(), actions[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{4,}", clear) if m[0].lower() in actions}


def test_terms_are_removed_and_generalised(spark, docs):
    """Thresholds between the two terms' disclosures: one goes, the other becomes a class; clashing names pass through."""
    named = docs.withColumnsRenamed({}).selectExpr("doc_id", "text", "doc_id AS d", "'x' AS k", "1 AS cuts", "2 AS key", "3 AS row")
    out = {r.doc_id: r for r in pii.sanitised(named, remove=0.999).collect()}
    text = out[PLAIN].text
    assert "orblax" not in text and "[TERM]" in text and "Quindle" not in text and "[EMAIL]" in text
    assert (out[PLAIN].d, out[PLAIN].k, out[PLAIN].cuts, out[PLAIN]["key"], out[PLAIN].row) == (PLAIN, "x", 1, 2, 3)
    plain = planted()
    assert all(out[i].text == plain[i] for i in (*range(PLAIN), PLAIN + 46, PLAIN + 49, PLAIN + 50))


def test_long_text_of_many_mentions(spark):
    text = " ".join(f"person{i % 7}name p{i}@corp.example.org" for i in range(3000))
    (r,) = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_email == 3000 and r.term_spans == []
