"""Spelling variants: pairs of words one edit apart, found by merging light subtrees of tries, and the form that each word should take.

One edit leaves one half of a word as it is, so words meet in groups that share a half: of words of m characters and words of m + 1,
one window of positions is free and what stands before and behind it is shared.  A window that is too crowded is halved until it is
not, down to one character, so that a task holds a bounded group.  In a group, the free parts make a trie.  At each node the child with
the most words is heavy; words of the light children are merged with the first character skipped or replaced: their rest is looked
up in the heavy child, in the other light ones and in the node itself.  A word is merged once per light edge above it,
which halves its group each time, so it is merged a logarithmic number of times.  Coinciding words are one edit apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .conversations import CRC_TABLE, crc_sql

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_TIMES, DELETES, RATIO = 7, 2, 31, 10
#: Words that a group may have before its window is halved, and about how many go to a task at once.
CROWDED, BUCKET = 50_000, 50_000


def one_edit_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs (a before b in the list's sorted order) of distinct ``words`` one insertion, deletion or replacement apart; a pair can come again."""
    words = sorted(set(words))
    known = set(words)
    nodes = [(0, len(words), 0)]
    while nodes:
        lo, hi, depth = nodes.pop()
        if hi - lo < 2:
            continue
        here = words[lo][:depth]
        children, at = [], lo
        ends_here = len(words[lo]) == depth
        if ends_here:
            at += 1
        while at < hi:
            c, first = words[at][depth], at
            while at < hi and words[at][depth] == c:
                at += 1
            children.append((first, at, c))
        if not children:
            continue
        heavy = max(children, key=lambda x: (x[1] - x[0], -x[0]))
        nodes += [(a, b, depth + 1) for a, b, _ in children]
        merged: dict[str, list[str]] = defaultdict(list)
        for a, b, c in children:
            if c == heavy[2]:
                continue
            for w in words[a:b]:
                rest = w[depth + 1 :]
                for other in (here + heavy[2] + rest, here + rest, here + heavy[2] + w[depth:]):  # replaced, skipped, skipped in the heavy one
                    if other in known:
                        yield (w, other) if w < other else (other, w)
                for other in merged[rest]:
                    yield (w, other) if w < other else (other, w)
                merged[rest].append(w)
        if ends_here and here + heavy[2] in known:
            yield here, here + heavy[2]


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group of rows (group columns, word), which come in order."""

    def table(found: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], names=["a", "b"])

    key, held, found = None, [], set()
    for batch in batches:
        for *group, word in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if group != key:
                found.update(one_edit_pairs(held))
                key, held = group, []
            held.append(word)
            if len(found) > BUCKET:
                yield table(found)
                found = set()
    found.update(one_edit_pairs(held))
    if found:
        yield table(found)


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct ``words`` (word) exactly one code point inserted, deleted or replaced apart, each once."""
    size = F.char_length("word")
    halves = lambda m: F.array(F.struct((m / 2).cast("int").alias("lo"), m.alias("hi")), F.struct(F.lit(0).alias("lo"), (m / 2).cast("int").alias("hi")))
    cut = [F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - (F.col("m") - F.col("hi")) + 1, F.col("m") - F.col("hi"))]
    group = ["m", "lo", "hi", "head", "tail"]
    place = lambda df: df.select("word", "m", "lo", "hi", cut[0].alias("head"), cut[1].alias("tail"))
    both = words.select("word", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")
    open_ = place(both.select("word", "m", F.inline(halves(F.col("m")))).where("hi > lo"))
    done = []
    while True:
        #: Halves of more than ``crowded`` words go on; a window of one character can't hold more than its characters' square.
        many = stored(open_.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "spelling-groups")
        done.append(open_.join(many.where((F.col("n") <= crowded) | (F.col("hi") - F.col("lo") == 1)).drop("n"), group))
        rest = many.where((F.col("n") > crowded) & (F.col("hi") - F.col("lo") > 1))
        if rest.isEmpty():
            break
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
        again = open_.join(rest.drop("n"), group).select("word", "m", parts.alias("parts")).select("word", "m", F.inline("parts"))
        open_ = stored(place(again), "spelling-open")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionAll(more)
    columns = [*group, "word"]
    pairs = rows.select(*columns).repartition(*group).sortWithinPartitions(*columns).mapInArrow(_group_pairs, "a string, b string")
    return pairs.distinct()


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts of at least LEAST_LENGTH code points that occur at least LEAST_TIMES times, after the deletions that their CRC tells."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.filter(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), lambda x: F.char_length(x) >= LEAST_LENGTH)).alias("run"))
    runs = runs.select(F.translate("run", UPPER, LOWER).alias("run"), "d")
    h: Column = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DELETES == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where following forms ends.  Each round doubles the steps taken; counts grow along a chain, so there is no ring."""
    to = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = stored(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if to.where("moved").isEmpty():
            return to.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    A word's form is the near word of largest n, the smallest in code-point order of equals, if its n is at least ``ratio`` times the word's.
    Null and empty texts have no words; a null id counts as the empty string before the colon; rows that repeat count again; an
    empty table gives an empty one.  Other columns are not looked at.
    """
    words = stored(counted_words(docs.select("doc_id", "text")), "words")
    pairs = stored(near_pairs(words.select("word"), crowded), "near-pairs")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    ends = ends.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    told = words.join(best, "word", "left").withColumn("is_form", -F.col("best.m") >= ratio * F.col("n"))
    told = stored(told.select("word", F.when(F.col("is_form"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), -F.col("best.m")).alias("form_n")), "told")
    return told.join(roots(told), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: UTF-8 bytes of ``<doc_id>:<run>``: code points up to U+00FF take one byte or two.
_CODES = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))"
SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
h AS (SELECT run, {crc_sql(_CODES)} AS h FROM r, crc_table WHERE length(run) >= 7),
w AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
v AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.less UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.less),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, near := near)) AS best FROM e GROUP BY word),
t AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.near END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
c(word, tip, d) AS (SELECT word, word, 0 FROM t UNION ALL SELECT c.word, t.form, d + 1 FROM c JOIN t ON t.word = c.tip WHERE t.form IS NOT NULL)
SELECT t.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM t JOIN (SELECT word, arg_max(tip, d) AS root FROM c GROUP BY word) x ON x.word = t.word
"""
