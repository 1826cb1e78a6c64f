"""Nulls, repeats, ties, long texts and clashing names; queries without SQL against plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from framewise.llm import line_dedup, media, minhash, mixing, pii, substring, tokens, toxicity, warc
from framewise.llm.queries import QUERIES
from tests.llm.test_operators import words

LABELS = "doc_id long, quality int, toxic int"


def odd_docs(spark):
    long = " ".join(words(77, 40_000)) + "\n" + "na " * 20_000
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "\n \n"), (None, "no id here"), (None, None), (6, "a b c"), (6, "a b c"), (6, "other"), (7, "é日本 😀\u0000x"), (8, "a b c\na b c\na b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs.selectExpr("*", "'en' AS lang", "if(doc_id = 8, null, 's') AS source", "length(text) AS n_chars", "1 AS size", "2 AS target", "3 AS h", "4 AS s", "5 AS dropped", "6 AS score", "7 AS row", "8 AS gone_id", "9 AS words", "10 AS key", "11 AS whole_row", "12 AS copies")


def test_stages_pass_odd_rows_and_names(spark, tmp_path):
    docs = odd_docs(spark)
    spark.createDataFrame([(6, 1, 1), (6, 0, 0), (None, 1, 1), (99, 1, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    n, names = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name != "sentencepiece":
            assert out.columns == names, name
        if name in ("toxicity", "line_dedup"):
            assert len(got) == n, name
        if name == "minhash_near_dedup":  # the long copy, the repeated row, and nothing else
            assert Counter(r.doc_id for r in got) == Counter({None: 2, 1: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 1, 8: 1}), name
        if name == "mixing_sources":
            assert {r.doc_id for r in got} <= {1, 2, None, 6, 7, 8} and all((r.text or "").strip() for r in got)
        if name == "sentencepiece":
            assert all(r.round_trip for r in got) and {r.doc_id for r in got} == {None, *range(1, 9)}
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0


def test_operators_on_odd_rows(spark):
    docs = odd_docs(spark)
    n = docs.count()
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).count() == n
    found = substring.repeated_passages(docs).collect()
    assert [(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in found] == [(2, 1, 0, 60_000)]
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.deduplicated(docs.withColumnRenamed("h", "n_lines"))


def test_media_against_plain_python(spark, small):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op8_media_columns"](spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        data = docs[r.doc_id]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        file = media.wrap(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and payload in file
        keys = r.feature.split("keyframes=")[1].split(",")
        assert [file[int(a) : int(b)] for a, b in (k.split("-") for k in keys)] == [payload[i * 64 : i * 64 + 64] for i in range(0, len(payload) // 64, media.KEY_EVERY)]


def test_pages_of_all_kinds(spark):
    big = "x" * 3_000_000
    rows = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a b/3", "same"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", big), (8, "u", "é\r\n\r\nx"), (8, "u", "é\r\n\r\nx"), (None, "u", "same")]
    rows += [(100 + i, f"http://a/{i}", "error page") for i in range(300)]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    best = {}
    for p, _, html in rows:
        if p is not None:
            best[html or ""] = max(p, best.get(html or "", p))
    want = []
    for p, _, html in rows:
        data, refers = (html or "").encode(), best[html or ""] if p is not None and best[html or ""] != p else None
        want.append((p, len(data), warc.digest(data), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_archives_are_read_record_by_record():
    records = [({"WARC-Type": "response", "Content-Length": str(n)}, bytes([n % 251]) * n) for n in (0, 1, 200_000, 3, 70_000)]
    data = b"".join(warc.warc_member(f, b) for f, b in records)
    assert list(warc.read_warc(data)) == records
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_warc(data[:-5]))


def test_sampled_segmentations_follow_their_law(spark):
    text, draws = "tests", 4000
    every = tokens.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), k=200).collect()
    p = {r.ids_md5: float(np.exp(r.log_prob)) for r in every}
    assert len(p) == len(every) < 200 and abs(sum(p.values()) - 1) < 1e-6  # all there are
    rows = tokens.encoded(spark.range(draws).selectExpr("id AS doc_id", f"'{text}' AS text"), k=2, with_ids=False).collect()
    first, either = Counter(r.ids_md5 for r in rows if r["sample"] == 1), Counter(r.ids_md5 for r in rows)
    for k, x in p.items():
        both = x + sum(y * x / (1 - y) for j, y in p.items() if j != k)
        for seen, want in ((first[k], x), (either[k], both)):
            assert abs(seen / draws - want) < 5 * (want * (1 - min(want, 0.999)) / draws) ** 0.5 + 2 / draws


def test_grammar_weighs_whole_clauses():
    s = toxicity.Scorer([("idiot", True, 2.0), ("moro", False, 1.0)])
    plain, aimed = s.clauses("the idiot left."), s.clauses("you idiot left.")
    assert plain == [2.0] and aimed == [2.0 * toxicity.TARGETED]
    assert s.clauses("he was not an idiot.")[0] < s.clauses("he was an idiot.")[0]
    assert s.clauses("they said you are an idiot.")[0] < aimed[0]
    assert s.clauses("you will hurt.")[0] == toxicity.THREAT_WEIGHT * toxicity.TARGETED
    assert s.clauses("not here. an idiot. never") == [2.0] and s.clauses("morons") == [1.0] and s.clauses("") == []
    far = "not " + "word " * 3 + "idiot"
    assert s.clauses(far) == [2.0]


def test_long_texts_take_linear_time():
    import time

    s, took = toxicity.Scorer([("idiot", True, 2.0)]), []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert len(s.clauses("an idiot spoke. " * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_ties_and_thresholds_of_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "c d", "x"), (2, "e f g", None), (3, None, None), (4, "", "y")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and len({r.copies for r in got if r.doc_id == 1}) == 1
    assert all(r.taken <= 3 * r.size for r in got) and {r.target for r in got if r.source == "y"} == {0.0}


def test_places_that_cannot_hold_a_passage():
    reach = substring.MIN_WORDS + substring.MAX_GAP
    a = np.arange(1000, 1000 + 2 * reach + substring.WIDTH, dtype=np.int32)
    edited = {p: a.copy() for p in ((60,), (40, 60), (20, 35, 50, 60, 75), tuple(range(8, 110, 9)))}
    for places, b in edited.items():
        b[list(places)] = 7
    longer = np.concatenate((a[1:70], [7], a[70:]))
    rows = [a, *edited.values(), longer, np.full(len(a), 3, np.int32)]
    assert substring.may_hold(np.stack([a] * len(rows)), np.stack(rows), 50, 0.8).tolist() == [True, True, True, False, False, True, False]


def test_whole_pipeline(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, small).collect()
    assert out and all(r.round_trip for r in out) and {r.doc_id for r in out} <= set(docs)
    per_copy = Counter((r.doc_id, r["sample"]) for r in out)
    assert all(n <= mixing.MAX_EPOCHS for n in per_copy.values())
    texts = Counter(docs[i].text for i in {r.doc_id for r in out})
    assert max(texts.values()) == 1
