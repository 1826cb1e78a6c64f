"""Repair of conversations: faults found, role orders made legal by cheapest edits, equal role/fault signatures solved once.

The edits of a conversation depend on its signature only: the role initial of each row and whether the row is truncated
(blank and duplicate rows go in any case).  Conversations are cut into blocks of rows in a global order, so that one of
any length spreads over tasks.  Distinct signatures of blocks are dealt out by range, sorted, and walked as a prefix trie: the path
to the present signature is a stack of dynamic-programming layers, a layer is made once for all signatures that share
the prefix, and a terminal node emits, for each state that a block can be entered and left in, cost and edits.  A pass over
the blocks of a conversation then picks the states between them.

States are what the repaired rows end in: nothing, s, u or a.  A layer keeps the cheapest edits into each state after a row was
consumed.  Two such strings consume the same rows and end with a row's letter, so neither begins the other, and an order of
the strings, the rank, decides ties without the strings themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block.
BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a.  Where an insertion leads, and after which states an initial may follow.
INSERTED = (2, 2, 3, 2)
FOLLOWS = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}
#: Insertions that an end in each state still needs.
TAIL = (0, 2, 1, 0)
NAMES = {2: "user", 3: "assistant"}
SOLID, ENDS_WELL = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

Layer = list["tuple[int, int, int, str] | None"]


def next_layer(layer: Layer, initial: str, truncated: bool) -> Layer:
    """(cost, rank, state before, edits) of each state after one more row."""
    best: list = [None] * 4
    extra = TRUNCATED if truncated else 0

    def offer(to: int, cost: int, rank: int, frm: int, edits: str) -> None:
        if best[to] is None or (cost, rank, edits) < (best[to][0], best[to][1], best[to][3]):
            best[to] = (cost, rank, frm, edits)

    for frm, known in enumerate(layer):
        if known is None:
            continue
        cost, rank = known[:2]
        offer(frm, cost + DELETE, rank, frm, "D")
        at = frm
        for n in range(3):
            if initial in FOLLOWS and at in FOLLOWS[initial][1]:
                offer(FOLLOWS[initial][0], cost + INSERT * n + KEEP + extra, rank, frm, "I" * n + "K")
            offer(INSERTED[at], cost + INSERT * n + REROLE + extra, rank, frm, "I" * n + "R")
            at = INSERTED[at]
    order = sorted((x[1], x[3], to) for to, x in enumerate(best) if x)
    for rank, (_, _, to) in enumerate(order):
        best[to] = (best[to][0], rank, best[to][2], best[to][3])
    return best


def solved(signatures: Iterator[str]) -> Iterator[tuple[str, list[int], list[int], list[str]]]:
    """(signature, costs, ranks, edits by row) of sorted signatures, each by state entered * 4 + state left; cost -1 where that can't be."""
    root = [[(0, 0, s, "") if s == entered else None for s in range(4)] for entered in range(4)]
    path, stack = "", [root]
    for sig in signatures:
        shared = 0
        while shared < min(len(path), len(sig)) and path[shared] == sig[shared]:
            shared += 1
        del stack[shared + 1 :]
        for symbol in sig[shared:]:
            stack.append([next_layer(layer, symbol.lower(), symbol.isupper()) for layer in stack[-1]])
        path = sig
        costs, ranks, edits = [-1] * 16, [-1] * 16, [""] * 16
        for entered in range(4):
            for left in range(4):
                end = stack[-1][entered][left]
                if end is None:
                    continue
                steps, at = [], left
                for layers in reversed(stack[1:]):
                    _, _, before, step = layers[entered][at]
                    steps.append(step)
                    at = before
                costs[4 * entered + left], ranks[4 * entered + left], edits[4 * entered + left] = end[0], end[1], " ".join(reversed(steps))
        yield sig, costs, ranks, edits


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that the CRC of ``conv_id:turn`` tells; nulls become one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).where("fate != 0")
    said = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def _turn(c: Column) -> Column:
    return F.struct(c.isNotNull().alias("some"), c.alias("turn"))


def _with_places(rows: DataFrame) -> DataFrame:
    """With ``later`` (role and text stood in an earlier turn) and ``pos``, a number that grows along conversations, turns, roles and texts."""
    rows = rows.withColumn("text_key", F.md5("text"))
    said = rows.groupBy("conv_id", "role", "text_key").agg(F.min(_turn(F.col("turn"))).alias("first"), F.max(_turn(F.col("turn"))).alias("last")).where("first != last")
    said = said.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_key").alias("k"), "first")
    rows = rows.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text_key") == F.col("k")), "left")
    rows = rows.withColumn("later", F.coalesce(_turn(F.col("turn")) > F.col("first"), F.lit(False)))
    flags = {"blank": ~F.col("text").rlike(SOLID), "good_end": F.col("text").rlike(ENDS_WELL)}
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "later").withColumns(flags)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())


_BLOCK_FIELDS = "start long, sig string, kinds string, roles array<string>, texts array<string>, turns array<long>"


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, in order, as blocks of one conversation; kinds has a letter for each row: b, d, t or -."""
    before, held, kind = None, [], None

    def table(blocks: list) -> pa.RecordBatch:
        columns = list(zip(*blocks, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(pa.string())), pa.array(columns[5], pa.list_(pa.string())), pa.array(columns[6], pa.list_(pa.int64()))], names=["conv_id", "start", "sig", "kinds", "roles", "texts", "turns"])

    done: list = []
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            for copy in range(row["copies"]):
                same = (row["conv_id"], row["turn"], row["role"], row["text"])
                fault = "b" if row["blank"] else "d" if row["later"] or copy or same == before else "-" if row["good_end"] else "t"
                before = same
                if held and (held[0] != row["conv_id"] or len(held[3]) >= size):
                    done.append(_closed(held))
                    held = []
                if not held:
                    held = [row["conv_id"], row["pos"] * 2 + copy, [], [], [], [], []]
                if fault in "t-":
                    initial = row["role"][:1]
                    symbol = initial if initial in ("s", "u", "a") else "o"
                    held[2].append(symbol.upper() if fault == "t" else symbol)
                for at, value in zip((3, 4, 5, 6), (fault, row["role"], row["text"], row["turn"]), strict=True):
                    held[at].append(value)
        if done:
            yield table(done)
            done = []
    if held:
        yield table([_closed(held)])


def _closed(held: list) -> tuple:
    return held[0], held[1], "".join(held[2]), "".join(held[3]), *held[4:]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list = []

    def table() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32())), pa.array(columns[3], pa.list_(pa.string()))], names=["sig", "costs", "ranks", "edits"])

    for answer in solved(s for b in batches for s in b.column(0).to_pylist()):
        found.append(answer)
        if len(found) == 1024:
            yield table()
            found.clear()
    if found:
        yield table()


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, way, tail, cost) of the blocks of whole conversations in order: the states each is entered and left in; tail and cost stand at the last block."""
    names = ["start", "way", "tail", "cost"]

    def ended(starts: list[int], steps: list[list[int]], now: list) -> Iterator[tuple]:
        _, _, at = min((x[0] + INSERT * TAIL[s], x[1], s) for s, x in enumerate(now) if x)
        tail, cost, ways = TAIL[at], now[at][0] + INSERT * TAIL[at], []
        for step in reversed(steps):
            ways.append(4 * step[at] + at)
            at = step[at]
        for i, way in enumerate(reversed(ways)):
            last = i + 1 == len(starts)
            yield starts[i], way, tail if last else None, cost if last else None

    conv, starts, steps, now = None, [], [], []
    for batch in batches:
        out: list = []
        for c, start, costs, ranks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if not starts or c != conv:
                if starts:
                    out += ended(starts, steps, now)
                conv, starts, steps, now = c, [], [], [(0, 0), None, None, None]
            to: list = [None] * 4
            for frm, known in enumerate(now):
                for s in range(4):
                    if known and costs[4 * frm + s] >= 0:
                        offer = (known[0] + costs[4 * frm + s], known[1], ranks[4 * frm + s], frm)
                        to[s] = min(to[s], offer) if to[s] else offer
            order = sorted((x[1], x[2], s) for s, x in enumerate(to) if x)
            starts.append(start)
            steps.append([x[3] if x else -1 for x in to])
            now = [None] * 4
            for rank, (_, _, s) in enumerate(order):
                now[s] = (to[s][0], rank)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=names)
    if starts:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ended(starts, steps, now), strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=names)


def repaired_rows(kinds: str, roles: list[str], texts: list[str], edits: list[str], entered: int, tail: int) -> tuple[str, list[tuple[str, str]]]:
    """The audit of a block and its rows after the edits."""
    audit, rows, at, given = [], [], entered, iter(edits)
    for kind, role, text in zip(kinds, roles, texts, strict=True):
        step = "D" if kind in "bd" else next(given)
        audit.append(step)
        for letter in step:
            if letter == "I" or letter == "R":
                at = INSERTED[at]
                rows.append((NAMES[at], "" if letter == "I" else text))
            elif letter == "K":
                at = FOLLOWS[role[:1]][0]
                rows.append((role, text))
    for _ in range(tail):
        at = INSERTED[at]
        rows.append((NAMES[at], ""))
    return "".join(audit) + "I" * tail, rows


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation out of its blocks in order; a hash and the audit is all that grows or stays of a conversation."""
    names, kind = ["conv_id", *(f.split()[0] for f in _REPORT.split(", "))], None
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def table(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *types], strict=True)], names=names)

    def report(s: dict) -> tuple:
        gaps = 0 if s["low"] is None else min(s["high"] - s["low"] + 1 - s["turns"], (1 << 63) - 1)
        return s["conv"], gaps, s["b"], s["d"], s["t"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()

    s: dict = {}
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if not s or s["conv"] != row["conv_id"]:
                if s:
                    out.append(report(s))
                s = {"conv": row["conv_id"], "low": None, "high": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "rows": 0, "initial": None}
            for k in "bdt":
                s[k] += row["kinds"].count(k)
            for turn in row["turns"]:
                if turn is not None and turn != s["high"]:
                    s["low"], s["high"], s["turns"] = turn if s["low"] is None else s["low"], turn, s["turns"] + 1
            for role in row["roles"]:
                s["illegal"] += s["initial"] is not None and s["initial"] + role[:1] not in ("su", "ua", "au")
                s["initial"] = role[:1]
            s["cost"] += DELETE * (row["kinds"].count("b") + row["kinds"].count("d")) + (row["cost"] or 0)
            audit, rows = repaired_rows(row["kinds"], row["roles"], row["texts"], row["edits"].split(" "), row["way"] // 4, row["tail"] or 0)
            s["audit"].append(audit)
            for role, text in rows:
                s["sha"].update((("\n" if s["rows"] else "") + f"{role}:{text}").encode())
                s["rows"] += 1
        if out:
            yield table(out)
    if s:
        yield table([report(s)])


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 after damage.

    Null roles and texts are one space (a blank text), null turns come first and count in no gap, a null conv_id is a conversation of its
    own.  Rows of one turn come in the order of role and text; a row that repeats turn, role and text is a duplicate of it.  A conversation
    that damage leaves without rows has zeros, an empty audit and the hash of the empty string; an empty table gives an empty one.
    Other columns are not looked at, whatever their names.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    blocks = stored(_with_places(rows).mapInArrow(lambda it: _blocks(it, block), f"conv_id {kind}, {_BLOCK_FIELDS}"), "conversation-blocks")
    signatures = blocks.select("sig").distinct()
    answers = stored(signatures.repartitionByRange("sig").sortWithinPartitions("sig").mapInArrow(_answers, "sig string, costs array<int>, ranks array<int>, edits array<string>"), "signatures")
    slim = blocks.select("conv_id", "start", "sig").join(answers.drop("edits"), "sig").select("conv_id", "start", "costs", "ranks")
    ways = stored(slim.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(_ways, "start long, way int, tail int, cost long"), "ways")
    chosen = blocks.select("start", "sig").join(ways, "start").join(answers.select("sig", "edits"), "sig").select("start", "way", "tail", "cost", F.get("edits", F.col("way")).alias("edits"))
    whole = blocks.drop("sig").join(chosen, "start").repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(_reports, f"conv_id {kind}, {_REPORT}")
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    out = every.join(whole, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The CRC-32 table and the CRC of an ASCII text, as DuckDB expressions.
CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc_sql(codes: str) -> str:
    """The CRC-32 of a list of byte values, with ``crc_table`` joined in."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(f"list_transform(string_split({_KEY}, ''), lambda x: CAST(unicode(x) AS BIGINT))")} % 20 AS fate FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE fate <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, left(role, 1) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS k,
        lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM p),
ins(q, n, q1) AS (VALUES ('-', '', '-'), ('-', 'I', 'u'), ('-', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')),
mv(q, edits, q2, cost, need) AS (
  SELECT q, 'D', q, 4, 'D' FROM (SELECT DISTINCT q FROM ins)
  UNION ALL SELECT q, n || 'K', i, 3 * len(n), i FROM ins JOIN (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) l(q0, i) ON q0 = q1
  UNION ALL SELECT q, n || 'R', CASE WHEN q1 = 'u' THEN 'a' ELSE 'u' END, 3 * len(n) + 3, 'R' FROM ins),
st(conv_id, pos, q, cost, audit, rows_) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '-', CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM f
  UNION ALL
  SELECT conv_id, pos, q, cost, audit, rows_ FROM (
    SELECT f.conv_id, f.pos, m.q2 AS q, st.cost + m.cost + CASE WHEN m.edits <> 'D' AND k = 't' THEN 3 ELSE 0 END AS cost, audit || m.edits AS audit,
      CASE WHEN m.edits = 'D' THEN rows_ ELSE list_concat(rows_, CASE len(m.edits) WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN [CASE WHEN st.q = 'u' THEN 'assistant:' ELSE 'user:' END]
          ELSE CASE WHEN st.q = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END, [CASE WHEN m.edits LIKE '%K' THEN role WHEN m.q2 = 'u' THEN 'user' ELSE 'assistant' END || ':' || text]) END AS rows_,
      row_number() OVER (PARTITION BY f.conv_id, m.q2 ORDER BY st.cost + m.cost + CASE WHEN m.edits <> 'D' AND k = 't' THEN 3 ELSE 0 END, audit || m.edits) AS nth
    FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.pos = st.pos + 1 JOIN mv m ON m.q = st.q AND (m.need = 'D' OR (k NOT IN ('b', 'd') AND m.need IN ('R', f.i)))) WHERE nth = 1),
fin AS (SELECT st.conv_id, cost + CASE q WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS cost, audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
    list_concat(rows_, CASE q WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END) AS rows_
  FROM st JOIN (SELECT conv_id, max(pos) AS n FROM f GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM st.conv_id AND e.n = st.pos),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS nth FROM fin) WHERE nth = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (k = 'b') AS blank, count(*) FILTER (k = 'd') AS duplicate, count(*) FILTER (k = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows_, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id
"""
