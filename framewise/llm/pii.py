"""Personal data: fixed patterns, and terms that reveal a protected entity by how they occur with it in the corpus.

A protected entity is the value of an email address, address of a host, card or phone number.  The corpus tells, over whole
documents, p(e), the share of documents that hold entity e, and p(e|t), the share of the documents with word t that hold e.
The disclosure of e by t is their pointwise mutual information as a share of the information content of e,
PMI(e;t) / IC(e) = 1 + log p(e|t) / -log p(e): 1 if t never occurs without e.  In documents that hold e, terms above one
threshold are generalised and terms above a higher one removed, wherever they stand.

Copies count in both shares alike.  They aren't evidence, though: a term needs texts with e that are unlike one another
(under each of SKETCHES min-hashes of their words), and texts times PMI must reach MIN_BITS, so that chance meetings with an
entity of many documents don't count.  As p(e|t) is at most docs(e) / docs(t), words of too many documents are
dropped before they meet any entity.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, stored

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that a regex engine passes over each run of characters once: where a match
#: fails at the start of a run, it fails at each later character of that run, and what is repeated
#: possessively is followed by nothing that it could give back to.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match that counts.
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
MIN_TERM, SKETCHES, MIN_BITS = 4, 2, 12.0
GENERALISE, REMOVE = 0.85, 0.95
WORD = rf"\p{{L}}{{{MIN_TERM},}}"
BLOCK = 256


def running_starts(steps: Column, first: Column) -> Column:
    """first[i] + the sum of steps before i, in time linear in their number but for one append per block."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def before(every: Column) -> Column:
        n_blocks = F.ceil(F.size(every) / BLOCK).cast("int")
        blocks = F.when(F.size(every) > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
        own = lambda b: F.slice(every, b * BLOCK + 1, BLOCK)
        bases = F.aggregate(F.transform(blocks, lambda b: F.aggregate(own(b), F.lit(0), lambda a, x: a + x)), F.array(F.lit(0)), grow)
        inside = lambda base: F.transform(blocks, lambda b: F.slice(F.aggregate(own(b), F.array(F.get(base, b)), grow), 1, F.size(own(b))))
        return bound(bases, lambda base: F.flatten(inside(base)))

    return F.zip_with(bound(steps, before), first, lambda a, b: a + b)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value), in code points."""

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(gaps, found, lambda g, m: g + F.char_length(m))
        return F.zip_with(running_starts(steps, gaps), found, lambda s, m: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("value")))

    cut = lambda found: F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.size(found))
    return bound(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: bound(cut(found), lambda gaps: placed(found, gaps)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 1, d.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _counts(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.char_length(_digits(value))
    if kind == "card":
        return digits.between(13, 19) & _luhn(_digits(value))
    return digits.between(9, 15) if kind == "phone" else F.lit(True)


def spans_of_kind(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(GATES[kind]), F.filter(matches(text, PATTERNS[kind]), lambda m: _counts(kind, m["value"]))).otherwise(none)


def _entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: _entity(s["kind"], s["value"])))


def _terms(text: Column) -> Column:
    """Different lower-case words of at least MIN_TERM letters that stand outside of email addresses, the one kind that holds letters."""
    clear = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(clear, F.lit(WORD), 0), F.lower))


def _places(text: Column) -> Column:
    """The same words, each time they stand there, as structs (start, end, term)."""
    shifted = lambda g, s: F.transform(matches(g, WORD), lambda m: F.struct((m["start"] + s).alias("start"), (m["end"] + s).alias("end"), F.lower(m["value"]).alias("term")))

    def placed(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), 0)
        steps = F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0)))
        return F.flatten(F.zip_with(gaps, running_starts(steps, F.transform(gaps, lambda g: F.lit(0))), shifted))

    return bound(F.split(text, PATTERNS["email"], -1), placed)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, held) per row: base spans (kind, start, end, value), and the text if it has any."""
    text = F.coalesce("text", F.lit(""))

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    rows = docs.select("doc_id", "text").withColumns({k: spans_of_kind(text, k) for k in KINDS}).withColumn("spans", F.concat(*map(named, KINDS)))
    return rows.select("doc_id", F.md5(text).alias("text_key"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("held"))


def _unlike() -> Column:
    """Whether the rows of a group are texts that differ in every sketch."""
    out = F.lit(True)
    for j in range(SKETCHES):
        out = out & (F.min(f"sketch{j}") != F.max(f"sketch{j}"))
    return out


def protected_texts(found: DataFrame) -> DataFrame:
    """(text_key, copies, spans, text): each different text that has base spans."""
    some = found.where(F.size("spans") > 0)
    return stored(some.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.any_value("spans").alias("spans"), F.any_value("held").alias("text")), "protected")


def term_pairs(texts: DataFrame, docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """(text_key, entity, term, ...): words of a text that may, by the number of their documents, reveal an entity of it."""
    n_docs = max(docs.count(), 2)

    def sketch(j: int) -> Column:
        return F.array_min(F.transform("terms", lambda t: F.xxhash64(F.lit(j), t)))

    sketches = {f"sketch{j}": sketch(j) for j in range(SKETCHES)}
    known = texts.select("text_key", "copies", _entities(F.col("spans")).alias("entities"), _terms(F.col("text")).alias("terms")).withColumns(sketches)
    each = known.select(F.explode("entities").alias("entity"), "text_key", "copies", *sketches)
    each = stored(each, "entity-texts")
    whole = each.groupBy("entity").agg(F.sum("copies").alias("entity_docs"), _unlike().alias("unlike")).where("unlike").drop("unlike")
    share = F.least(F.col("entity_docs") / F.lit(float(n_docs)), F.lit(0.5))
    whole = stored(whole.withColumn("most", F.col("entity_docs") * F.pow(share, F.lit(generalise - 1.0))).withColumn("ic", -F.log2(share)), "entities")
    held = stored(each.join(whole, "entity"), "held")
    widest = held.agg(F.max("most").alias("m")).first()["m"] or 0.0
    #: Documents of each word, but for those of one document and of too many.
    words = docs.select(F.explode(_terms(F.col("text"))).alias("w")).groupBy(F.xxhash64("w").alias("term_key")).agg(F.count(F.lit(1)).alias("term_docs"))
    words = stored(words.where(F.col("term_docs").between(2, widest)), "word-documents")
    some = held.groupBy("text_key").agg(F.max("most").alias("text_most"))
    own = known.join(some, "text_key").select("text_key", "text_most", F.explode("terms").alias("term")).withColumn("term_key", F.xxhash64("term"))
    own = own.join(words, "term_key").where("term_docs <= text_most").select("text_key", "term", "term_docs")
    return stored(own.join(held, "text_key").where("term_docs <= most"), "pairs")


def disclosing_terms(pairs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, min_bits: float = MIN_BITS) -> DataFrame:
    """(entity, term, disclosure, action): terms that reveal an entity, out of ``term_pairs``."""
    known = pairs.groupBy("entity", "term").agg(
        F.sum("copies").alias("joint"), F.count(F.lit(1)).alias("texts"), F.max("term_docs").alias("term_docs"), F.max("ic").alias("ic"), _unlike().alias("unlike")
    ).where("unlike")
    pmi = F.col("ic") + F.log2(F.least(F.lit(1.0), F.col("joint") / F.col("term_docs")))
    known = known.withColumn("disclosure", pmi / F.col("ic")).where((F.col("texts") * pmi >= min_bits) & (F.col("disclosure") >= generalise))
    return known.select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def term_spans(texts: DataFrame, pairs: DataFrame, flagged: DataFrame) -> DataFrame:
    """(text_key, term_spans): where flagged terms stand in texts that hold the entity which they reveal."""
    marks = pairs.select("text_key", "entity", "term").join(flagged.select("entity", "term", "action"), ["entity", "term"])
    marks = stored(marks.groupBy("text_key", "term").agg(F.max("action").alias("action")), "marks")
    at = texts.join(marks.select("text_key").distinct(), "text_key", "left_semi").select("text_key", F.explode(_places(F.col("text"))).alias("p")).select("text_key", "p.*")
    at = at.join(marks, ["text_key", "term"]).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("term_spans"))
    return stored(at, "term-spans")


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, min_bits: float = MIN_BITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts by kind, base_sha256, spans, base_spans and term_spans (start, end, action).

    Spans are ``kind:start:end`` in code points, the end exclusive; base kinds come as in KINDS, then ``term``; each by
    start.  Null and empty texts have none.  A term is marked in texts that hold the entity which it reveals, wherever it
    stands, so texts without base spans stay as they are.  Equal texts get equal spans, whatever their ids; null ids
    stay null.  Other columns of ``docs`` aren't read.  Texts of any length are taken whole.
    """
    found = stored(base_spans(docs), "base-spans")
    texts = protected_texts(found)
    pairs = term_pairs(texts, docs, generalise)
    marked = term_spans(texts, pairs, disclosing_terms(pairs, generalise, remove, min_bits))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    some = found.where(F.size("spans") > 0).join(marked, "text_key", "left").select("doc_id", "text_key", "spans", F.coalesce("term_spans", none).alias("term_spans"))
    out = some.unionAll(found.where(F.size("spans") == 0).select("doc_id", "text_key", "spans", none.alias("term_spans")))
    base = _span_text(F.col("spans"))
    terms = F.array_join(F.transform("term_spans", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text_key", *map(n, KINDS), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms)).alias("spans"), F.col("spans").alias("base_spans"), "term_spans")


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with personal data and removed terms cut out, base spans as [KIND] and generalised terms as [TERM]; the columns of ``docs``.

    Where spans of two kinds overlap, the earlier one (the longer, of two with one start) stands for both.  Null and empty texts and
    texts without spans stay as they are; other columns pass through, whatever their names.
    """
    found = personal_data(docs.select("doc_id", "text"), **how)
    base = F.transform("base_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    terms = F.transform("term_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("by")))
    cuts = found.where(F.size("base_spans") > 0).select(F.col("text_key").alias("key"), F.array_sort(F.concat(base, terms)).alias("cuts")).dropDuplicates(["key"])
    text = F.col("row.text")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", F.md5(F.coalesce(text, F.lit("")))).join(cuts, "key", "left")
    #: Pieces are joined once, so a text of many spans isn't copied for each of them.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, c: F.when(c["start"] < acc["at"], F.struct(F.greatest(acc["at"], -c["minus_end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct((-c["minus_end"]).alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["by"])).alias("out"))
    )
    clean = F.aggregate("cuts", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return rows.select(*(F.when(F.size("cuts") > 0, clean).otherwise(text).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
