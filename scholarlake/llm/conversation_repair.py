"""Repair of conversation structure by error-correcting Earley parsing.

A weighted role grammar, D -> empty | P;  P -> S U A | U A | P U A, is read over the rows of a conversation in order.
Its error productions are: a row may be deleted (3), a row may take the place of U or A under another role (rerole, 2),
and U or A may be inserted as an empty turn (2); keeping a row whose role fits costs nothing, and a truncated row that is
not deleted 1. Blank and repeated rows must be deleted. All constituents that go on start at the first row, so a chart
item is a dotted production; an item keeps its minimum (cost, audit), the audit being the initials of the edits so far
(K, R, D, I). Of equal costs no audit is the beginning of another at the same row, so the ASCII-least one can be chosen
item by item. The completed chart gives the cheapest audit, and the audit alone gives the repaired rows.

What it costs: texts never meet for the parse. Each distinct (conversation, role, text) is counted where it is, one
letter stands for a row in the parse, and a conversation of any length is parsed in segments whose results are joined,
so the parse of a conversation holds no more than its audit, which is in the result anyway. Only the digest of a
repaired conversation needs its texts in order: they stream past the audit, sorted by Spark, in bounded memory.

Defined cases: null role or text is one space; rows order by turn (nulls first), then role, then digest of the text; a
null conversation id is a conversation, and in the damage of the query a null id or turn also counts as one space;
roles whose initial is none of s, u, a can only be reroled or deleted; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import materialize, table

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows whose charts are worked out, and remembered, at once.
SEGMENT = 256
#: Productions of the grammar; D -> empty holds for the item in which nothing has been read.
GRAMMAR = {"P": (("S", "U", "A"), ("U", "A"), ("P", "U", "A"))}
ROLE_OF = {"U": "user", "A": "assistant"}
BLANK = r"^[\x20\x09-\x0D]*\z"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"

Item = tuple[str, tuple[str, ...], int]
Column_ = dict[Item, tuple[int, str]]

# A row's letter: its role's initial (s, u, a, or o for any other), then 0 as it is, 1 truncated, 2 blank, 3 repeated.
_LETTERS = {f"{role}{fault}": chr(65 + 4 * i + fault) for i, role in enumerate("suao") for fault in range(4)}
_MEANING = {v: (k[0], int(k[1])) for k, v in _LETTERS.items()}


def _predicted() -> tuple[Item, ...]:
    """Items of the start: all productions but those that begin with what is still to be read."""
    return tuple(("P", body, 0) for body in GRAMMAR["P"] if body[0] != "P")


def _offer(column: Column_, item: Item, value: tuple[int, str]) -> bool:
    if item in column and column[item] <= value:
        return False
    column[item] = value
    return True


def _close(column: Column_) -> None:
    """Completes finished productions and inserts expected turns until no item gets better."""
    todo = list(column)
    while todo:
        lhs, body, dot = todo.pop()
        cost, audit = column[lhs, body, dot]
        if dot == len(body):
            following = [((head, b, 1), (cost, audit)) for head, bodies in GRAMMAR.items() for b in bodies if b[0] == lhs]
        elif body[dot] in ROLE_OF:
            following = [((lhs, body, dot + 1), (cost + INSERT, audit + "I"))]
        else:
            following = []
        todo += [item for item, value in following if _offer(column, item, value)]


def _scan(column: Column_, letter: str) -> Column_:
    """The column after a row: each item keeps, reroles or deletes it."""
    role, fault = _MEANING[letter]
    after: Column_ = {}
    late = TRUNCATED if fault == 1 else 0
    for (lhs, body, dot), (cost, audit) in column.items():
        _offer(after, (lhs, body, dot), (cost + DELETE, audit + "D"))
        if fault > 1 or dot == len(body):
            continue
        if body[dot].lower() == role:
            _offer(after, (lhs, body, dot + 1), (cost + KEEP + late, audit + "K"))
        elif body[dot] in ROLE_OF:
            _offer(after, (lhs, body, dot + 1), (cost + REROLE + late, audit + "R"))
    _close(after)
    return after


@lru_cache(maxsize=4_096)
def _chart(letters: str, start: Item | None) -> tuple[tuple[Item, int, str], ...]:
    """Last column over a segment, from one item or from the start of a conversation."""
    column: Column_ = {start: (0, "")} if start else dict.fromkeys(_predicted(), (0, ""))
    if not start:
        _close(column)
    for letter in letters:
        column = _scan(column, letter)
    return tuple((item, cost, audit) for item, (cost, audit) in column.items())


def parse(letters: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Cheapest (cost, audit) of a conversation given as letters."""
    column: Column_ = {item: (cost, audit) for item, cost, audit in _chart(letters[:segment], None)}
    for at in range(segment, len(letters), segment):
        after: Column_ = {}
        for start, (cost, audit) in column.items():
            for item, more, edits in _chart(letters[at : at + segment], start):
                if item not in after or after[item][0] >= cost + more:
                    _offer(after, item, (cost + more, audit + edits))
        column = after
    ends = [column[item] for item in column if item[2] in (0, len(item[1]))]  # nothing read, or a whole production
    return min(ends, default=(0, ""))


def roles(audit: str, first: str) -> list[str | None]:
    """The role that each edit of an audit gives: None for a deleted row and for one that keeps its own. first: initial of the first kept row."""
    out: list[str | None] = []
    expected = None
    for edit in audit:
        if edit == "D":
            out.append(None)
            continue
        if expected is None:
            expected = "S" if edit == "K" and first == "s" else "U"
        out.append(None if edit == "K" else ROLE_OF[expected])
        expected = "A" if expected == "U" else "U"
    return out


def initial(role: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(role, 1, 1), F.lit("")), F.lit("o"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32("conv_id:turn") mod 20 decides: 0 drops the row, 1 empties its
    text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    at = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text, role = space("text"), space("role")
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(at == 4, "user").otherwise(role).alias("role"),
        F.when(at == 1, "").when(at == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(at == 0, 0).when(at == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _letters(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, letters: one row for equal rows of a turn, with a letter for each of them.

    Equal rows are counted before they meet; the first turn of each text comes from an aggregate, not from a window."""
    text = F.col("text")
    fault = F.when(text.rlike(BLANK), 2).when(text.rlike(WHOLE), 0).otherwise(1)
    slim = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), fault.alias("fault"))
    counted = materialize(slim.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("n")), "turn_letters")
    # nulls come first, so a text's first turn is null if any is
    firsts = counted.where("fault <> 2").groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("least"))
    c, f = counted.alias("c"), firsts.alias("f")
    on = F.expr("c.conv_id <=> f.conv_id AND c.role = f.role AND c.digest = f.digest AND c.fault <> 2")
    is_first = F.when(F.col("f.null_first"), F.col("c.turn").isNull()).otherwise(F.col("c.turn") == F.col("f.least"))
    known = initial(F.col("c.role"))
    known = F.when(known.isin("s", "u", "a"), known).otherwise("o")
    letter = lambda fault: F.element_at(F.create_map(*[F.lit(x) for pair in _LETTERS.items() for x in pair]), F.concat(known, fault.cast("string")))
    first = F.when(F.col("c.fault") == 2, letter(F.lit(2))).when(is_first, letter(F.col("c.fault"))).otherwise(letter(F.lit(3)))
    rest = F.when(F.col("c.fault") == 2, letter(F.lit(2))).otherwise(letter(F.lit(3)))
    joined = c.join(f, on, "left")
    return joined.select("c.conv_id", "c.turn", "c.role", "c.digest", F.concat(first, F.repeat(rest, (F.col("n") - 1).cast("int"))).alias("letters"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as one run of letters for each conversation and SEGMENT rows, numbered in order."""
    at, held, no, task = None, [], 0, None

    def flush():
        nonlocal held, no
        no += 1
        out = pa.RecordBatch.from_pydict({"conv_id": pa.array([at], pa.int64()), "task": pa.array([task], pa.int32()), "no": pa.array([no], pa.int64()), "letters": pa.array(["".join(held)])})
        held = []
        return out

    for batch in batches:
        for conv, letters, pid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "letters", "task")), strict=True):
            if task is not None and conv != at and held:
                yield flush()
            at, task = conv, pid
            held.append(letters)
            if len(held) >= SEGMENT:
                yield flush()
    if held:
        yield flush()


def _parsed(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batch_iter:
        lines = batch.column("letters").to_pylist()
        found = [parse(x) for x in lines]
        faults = [[_MEANING[y] for y in x] for x in lines]
        legal = {("s", "u"), ("u", "a"), ("a", "u")}
        count = lambda kind: pa.array([sum(f == kind for _, f in x) for x in faults], pa.int64())
        firsts = [next((role for (role, _), edit in zip(x, (e for e in audit if e != "I"), strict=True) if edit != "D"), "") for x, (_, audit) in zip(faults, found, strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id"),
                "blank": count(2),
                "duplicate": count(3),
                "truncated": count(1),
                "illegal": pa.array([sum((p[0], q[0]) not in legal for p, q in zip(x, x[1:], strict=False)) for x in faults], pa.int64()),
                "cost": pa.array([c for c, _ in found], pa.int64()),
                "audit": pa.array([a for _, a in found], pa.string()),
                "first": pa.array(firsts, pa.string()),
            }
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows, an audit before the turns it is for, into the digest of the repaired turns."""
    at, plan, sha, lines, started = None, None, None, 0, False

    def put(line: str) -> None:
        nonlocal lines
        if lines:
            sha.update(b"\n")
        sha.update(line.encode("utf-8", "surrogatepass"))
        lines += 1

    def until_row() -> str | None:
        """The edit of the next row, after the turns that are inserted before it."""
        for edit, role in plan:
            if edit != "I":
                return edit, role
            put(f"{role}:")
        return None

    def done() -> tuple:
        until_row()
        return at, sha.hexdigest()

    for batch in batches:
        out = []
        for conv, head, audit, first, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "audit", "first", "role", "text")), strict=True):
            if head == 0:
                if started:
                    out.append(done())
                at, plan, sha, lines, started = conv, iter(zip(audit, roles(audit, first), strict=True)), hashlib.sha256(), 0, True
                continue
            edit, given = until_row()
            if edit != "D":
                put(f"{role if edit == 'K' else given}:{text}")
        if out:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in out], pa.int64()), "repaired_sha256": pa.array([s for _, s in out])})
    if started:
        conv, digest = done()
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "repaired_sha256": pa.array([digest])})


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    order = ("conv_id", "turn", "role", "digest")
    letters = materialize(_letters(rows), "conversation_letters")
    dealt = letters.repartitionByRange(*order).sortWithinPartitions(*order)  # a long conversation is spread over tasks
    runs = dealt.select("conv_id", "letters", F.spark_partition_id().alias("task")).mapInArrow(_runs, "conv_id long, task int, no long, letters string")
    lines = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("task", "no", "letters"))).alias("runs"))
    lines = lines.select("conv_id", F.array_join(F.transform("runs", lambda r: r["letters"]), "").alias("letters"))
    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, first string"
    parsed = materialize(lines.mapInArrow(_parsed, schema), "conversation_audits")
    turns = letters.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    # texts in order behind their audit
    none = F.lit(None).cast("string")
    heads = parsed.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), "audit", "first", none.alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("head"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), none.alias("audit"), none.alias("first"), "text")
    streamed = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "digest")
    digests = streamed.select("conv_id", "head", "audit", "first", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    p, g, d = parsed.alias("p"), gaps.alias("g"), digests.alias("d")
    out = p.join(g, F.expr("p.conv_id <=> g.conv_id")).join(d, F.expr("p.conv_id <=> d.conv_id"))
    return out.select("p.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_all(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """repair() with a row for every id in `ids` (conv_id), also for those without rows."""
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("e")
    found = repair(rows).alias("f")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(found, F.expr("e.conv_id <=> f.conv_id"), "left").select(
        "e.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_all(turns, damaged(turns))


def _edit(value: str, cost: str, edit: str) -> str:
    """SQL of a value (nine digits of cost, then the audit) after an edit."""
    return f"lpad(CAST(CAST(left({value}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{edit}'"


def _row(value: str, role: str, reroled: bool = True) -> str:
    other = f"WHEN fault < 2 THEN {_edit(value, '2 + fault', 'R')} " if reroled else ""
    return f"CASE WHEN fault < 2 AND c = '{role}' THEN {_edit(value, 'fault', 'K')} {other}END"


OP13_SQL = f"""
WITH RECURSIVE b AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
   lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
   lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, (c & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS h
 FROM conversations),
m AS (
 SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
 FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (
 SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN seen > 1 THEN 3
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault
 FROM p),
d AS (
 SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS z FROM f
 UNION ALL
 SELECT conv_id, i, n, s, least(u2, {_edit("least(z1, " + _edit("u2", "2", "I") + ")", "2", "I")}) AS u, least(z1, {_edit("u2", "2", "I")}) AS z
 FROM (
  SELECT *, least(u1, {_edit("n", "2", "I")}, {_edit("s", "2", "I")}, {_edit("z1", "2", "I")}) AS u2
  FROM (
   SELECT f.conv_id, f.i, {_edit("d.n", "3", "D")} AS n, least({_edit("d.s", "3", "D")}, {_row("d.n", "s", False)}) AS s,
    least({_edit("d.u", "3", "D")}, {_row("d.n", "u")}, {_row("d.s", "u")}, {_row("d.z", "u")}) AS u1,
    least({_edit("d.z", "3", "D")}, {_row("d.u", "a")}) AS z1
   FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = d.i + 1))),
e AS (
 SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit
 FROM (SELECT conv_id, least(arg_max(n, i), arg_max(z, i)) AS best FROM d GROUP BY conv_id)),
x AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM e),
y AS (
 SELECT conv_id, pos, substr(audit, pos, 1) AS edit, pos - length(replace(left(audit, pos), 'I', '')) AS inserted, length(replace(left(audit, pos), 'D', '')) AS place FROM x),
k AS (
 SELECT y.conv_id, y.pos, y.edit, y.place, f.role, f.text, f.c
 FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.i = y.pos - y.inserted AND y.edit <> 'I' WHERE y.edit <> 'D'),
q AS (SELECT *, CAST(max(CASE WHEN place = 1 AND edit = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS INT) AS led FROM k),
r AS (
 SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS repaired
 FROM q GROUP BY conv_id),
g AS (
 SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
  count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
 FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id
 LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id
"""
