"""Conversation structure repair by Knuth's lightest-derivation agenda.

Rows of a conversation, in turn order, are edited until their role initials
spell ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1), Delete (2, the
only edit of a blank or duplicate row) and Insert an empty turn (5); a truncated
row that stays costs 5 more.  The cheapest edits win, ties by the least audit
string (the edits' initials in order).

**Deductions.**  An item ``(i, p)`` says that rows ``i ..`` can be finished when
the last turn kept has initial ``p`` (or none was kept yet).  The goal's axioms
are ``(n, none)`` and ``(n, a)``; an edit of row ``i`` and an item ``(i + 1, q)``
derive ``(i, p)``, an inserted turn and ``(i, q)`` derive ``(i, p)``.  The agenda
pops items by ``(cost, rows finished, audit)``.  Every deduction raises that key
and keeps the order of its antecedents' keys (it prepends one letter to the
audit), so the functions are superior and monotone and a popped item is final;
the search ends when ``(0, none)`` pops.  From one item the edits lead to
different letters, so of two derivations of equal cost the one with the smaller
first letter is the smaller audit: no audit is compared or copied as a whole.
Long conversations are deduced ``BLOCK`` rows at a time from the back, the items
at a block's front being the axioms of the block before it.

**Spark.**  Texts meet once, in the last pass.  Before it, rows are one letter
(role initial and fault), collapsed by ``(conversation, turn, role, text
digest)`` with their count before any shuffle; first occurrences come from an
aggregate and a join that splits skewed keys; letters are strung together in
ranges of ``(conversation, turn, role, digest)``, so a conversation with a third
of all rows is cut into many ranges, and one short string a range is gathered
per conversation.  SHA-256 of a conversation can only be taken in order: the
last pass streams a conversation's rows, one Arrow batch in memory at a time.

Rows with equal turns (and null turns, which come first) are ordered by role,
then by the SHA-256 of the text.  Null roles and texts are one space, an
empty role has no initial and fits nowhere, null conversation ids are one
conversation.  An empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .common import arrow_schema, to_batch

BLOCK = 4_096                   # rows deduced at a time
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"       # what is no sign of a text
OK, CUT, BLANK, TWICE = range(4)                # a row's first fault
NONE, S, U, A, OTHER = range(5)                 # initial of the last turn kept
# the turn that may follow a state: target initial -> states before it
BEFORE = {S: (NONE,), U: (NONE, S, A), A: (U,)}
ROLE = {U: "user", A: "assistant"}
FIRST = ord("A")                # a row's letter: FIRST + (initial - 1) + 4 * fault


def letter(initial: int, fault: int) -> str:
    return chr(FIRST + initial - 1 + 4 * fault)


def _agenda(codes: str, axioms: list[tuple[int, int]], goal: int | None) -> tuple[list[bytearray], dict]:
    """Deduce a block: first edit of each item of its rows, and the cost of the items at its front.

    ``axioms`` are ``(state, cost)`` behind the last row; with ``goal`` the
    search ends when that front item pops.
    """
    n = len(codes)
    edits = [bytearray(4) for _ in range(n + 1)]         # 0: not final
    heap: list[tuple[int, int, int, int]] = []           # cost, rows finished, first edit, state
    for p, cost in axioms:
        heappush(heap, (cost, 0, 1, p))                  # 1: axiom
    front: dict[int, int] = {}
    while heap:
        cost, done, edit, q = heappop(heap)
        i = n - done
        if edits[i][q]:
            continue
        edits[i][q] = edit
        if not i:
            front[q] = cost
            if q == goal:
                break
        for p in BEFORE.get(q, ()) if q != S else ():    # an inserted turn before this item
            if not edits[i][p]:
                heappush(heap, (cost + INSERT, done, 73, p))
        if i:
            fault, initial = divmod(ord(codes[i - 1]) - FIRST, 4)
            initial += 1
            late = edits[i - 1]
            if not late[q]:
                heappush(heap, (cost + DELETE, done + 1, 68, q))
            if fault < BLANK:
                more = TRUNCATED if fault == CUT else 0
                for p in BEFORE.get(q, ()):
                    if not late[p]:
                        if initial == q:
                            heappush(heap, (cost + KEEP + more, done + 1, 75, p))
                        if q != S:
                            heappush(heap, (cost + REROLE + more, done + 1, 82, p))
    return edits, front


def lightest(codes: str) -> tuple[int, str]:
    """``(cost, audit)`` of the lightest derivation that repairs the rows."""
    blocks = []
    axioms, stop = [(NONE, 0), (A, 0)], len(codes)
    while True:
        start = max(0, stop - BLOCK)
        edits, front = _agenda(codes[start:stop], axioms, None if start else NONE)
        blocks.append(edits)
        if not start:
            break
        axioms, stop = list(front.items()), start
    audit, p = bytearray(), NONE
    at = 0
    for edits in reversed(blocks):
        rows, i = len(edits) - 1, 0
        while True:
            edit = edits[i][p]
            if edit == 1 or (edit == 0 and i == rows):   # behind the block's last row: the next block's front
                break
            audit.append(edit)
            if edit == 73:
                p = A if p == U else U
                continue
            if edit == 75:
                p = (ord(codes[at + i]) - FIRST) % 4 + 1
            elif edit == 82:
                p = A if p == U else U
            i += 1
        at += rows
    return front[NONE], audit.decode()


@lru_cache(maxsize=50_000)
def _short(codes: str) -> tuple[int, str]:
    return lightest(codes)


def repair_codes(codes: str) -> tuple[int, str]:
    return _short(codes) if len(codes) <= 64 else lightest(codes)


def illegal_pairs(codes: str) -> int:
    """Adjacent initials other than su, ua, au."""
    at = [(ord(c) - FIRST) % 4 + 1 for c in codes]
    return sum((x, y) not in ((S, U), (U, A), (A, U)) for x, y in zip(at, at[1:]))


def damage(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows ``(c, t, r, x, n)`` after damage chosen by ``crc32(id:turn) % 20``; ``n`` is how often the row stands.

    0 drops it (``n`` = 0), 1 empties the text, 2 removes its ``[.!?]``, 3
    repeats it (``n`` = 2), 4 sets its role to user.  Nulls read as one space.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), space), F.lit(":"),
                    F.coalesce(F.col(f"`{turn_col}`").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), space)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), space)
    return df.select(
        F.col(f"`{id_col}`").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("t"),
        F.when(kind == 4, "user").otherwise(role).alias("r"),
        F.when((kind == 1) | (kind == 0), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("x"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def undamaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """The same rows without damage, to repair conversations as they are."""
    space = F.lit(" ")
    return df.select(F.col(f"`{id_col}`").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("t"),
                     F.coalesce(F.col(f"`{role_col}`").cast("string"), space).alias("r"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), space).alias("x"), F.lit(1).cast("long").alias("n"))


def _initial():
    first = F.left("r", F.lit(1))
    return F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)


def _collapsed(rows: DataFrame) -> DataFrame:
    """One narrow row a (conversation, turn, role, text digest): its initial, own fault and count."""
    end = F.rtrim("x", F.lit(WHITE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), OK).otherwise(CUT)
    return (rows.select("c", "t", "r", F.unhex(F.sha2("x", 256)).alias("h"), fault.alias("f"), "n")
            .groupBy("c", "t", "r", "h", "f").agg(F.sum("n").alias("n")))


def _letters(rows: DataFrame) -> DataFrame:
    """``(c, codes)``: the letters of every conversation's rows in order."""
    turn = F.struct(F.col("t").isNotNull().alias("has"), F.col("t"))
    seen = (rows.filter(f"n > 0 and f <> {BLANK}").groupBy("c", "r", "h").agg(F.min(turn).alias("first"))
            .select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("h").alias("h2"), "first"))
    both = rows.join(seen, F.col("c").eqNullSafe(F.col("c2")) & (F.col("r") == F.col("r2")) & (F.col("h") == F.col("h2")), "left")
    base = F.lit(FIRST - 1) + _initial()
    late = turn != F.col("first")
    own = F.when((F.col("f") != BLANK) & F.coalesce(late, F.lit(False)), TWICE).otherwise(F.col("f"))
    more = F.when(F.col("f") == BLANK, BLANK).otherwise(TWICE)
    codes = F.when(F.col("n") > 0, F.concat(F.char(base + 4 * own),
                                            F.repeat(F.char(base + 4 * more), (F.col("n") - 1).cast("int")))).otherwise("")
    order = [F.asc_nulls_first("c"), F.asc_nulls_first("t"), F.asc("r"), F.asc("h")]
    placed = both.select("c", "t", "r", "h", codes.alias("codes")).repartitionByRange(*order).sortWithinPartitions(*order)
    out = f"c {rows.schema['c'].dataType.simpleString()}, seg int, codes string"
    schema = arrow_schema(out)

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, open_, parts = TaskContext.get().partitionId(), [], []
        for b in batches:
            names, codes = [], []
            for c, x in zip(b.column("c").to_pylist(), b.column("codes").to_pylist()):
                if open_ and open_[0] != c:
                    names.append(open_[0])
                    codes.append("".join(parts))
                    parts = []
                open_ = [c]
                parts.append(x)
            if names:
                yield to_batch({"c": names, "seg": [seg] * len(names), "codes": codes}, schema)
        if open_:
            yield to_batch({"c": open_, "seg": [seg], "codes": ["".join(parts)]}, schema)

    segments = placed.select("c", "codes").mapInArrow(string, out)
    ordered = F.array_sort(F.collect_list(F.struct("seg", "codes")))
    return segments.groupBy("c").agg(F.array_join(F.transform(ordered, lambda s: s["codes"]), "").alias("codes"))


def audits(rows: DataFrame) -> DataFrame:
    """``(c, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation of ``rows (c, t, r, x, n)``."""
    rows = cut(_collapsed(rows), "conversation-rows")
    turns = (rows.filter("n > 0 and t is not null").select("c", "t").distinct().groupBy("c")
             .agg((F.max("t").cast("decimal(20,0)") - F.min("t") + 1 - F.count("t")).alias("gaps")))
    narrow = (_letters(rows).select("c", "codes", F.lit(None).cast("decimal(38,0)").alias("gaps"))
              .unionByName(turns.select("c", F.lit(None).cast("string").alias("codes"), F.col("gaps").cast("decimal(38,0)")))
              .groupBy("c").agg(F.max("codes").alias("codes"), F.expr("try_cast(coalesce(max(gaps), 0) as long)").alias("gaps")))
    out = (f"c {rows.schema['c'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, "
           "illegal long, cost long, audit string")
    schema = arrow_schema(out)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("codes").to_pylist()
            best = [repair_codes(x) for x in codes]
            fault = [[(ord(c) - FIRST) // 4 for c in x] for x in codes]
            yield to_batch({"c": b.column("c"), "gaps": b.column("gaps"), "blank": [x.count(BLANK) for x in fault],
                            "duplicate": [x.count(TWICE) for x in fault], "truncated": [x.count(CUT) for x in fault],
                            "illegal": [illegal_pairs(x) for x in codes], "cost": [x[0] for x in best],
                            "audit": [x[1] for x in best]}, schema)

    return cut(narrow.mapInArrow(repair, out), "conversation-audits")


def _placed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order, one conversation after the other in each partition."""
    none = F.lit(None)
    texts = rows.filter("n > 0").select("c", F.lit(1).alias("kind"), "t", "r", F.sha2("x", 256).alias("h"), "x", F.col("n").cast("int"))
    lead = plans.select("c", F.lit(0).alias("kind"), none.cast("long").alias("t"), none.cast("string").alias("r"),
                        none.cast("string").alias("h"), F.col("audit").alias("x"), F.lit(1).alias("n"))
    return (texts.unionByName(lead).repartition("c").sortWithinPartitions("c", "kind", F.asc_nulls_first("t"), "r", "h")
            .select("c", "kind", "r", "x", "n"))


def _turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Repaired ``(edit, role, text)`` of one conversation; ``rows`` is read as the edits ask for them."""
    # the target of R and I: user unless the turn before is the user's
    last = ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield edit, role, text


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conversation, audit or None, row or None)`` in order."""
    for b in batches:
        yield from zip(b.column("c").to_pylist(), b.column("kind").to_pylist(), b.column("r").to_pylist(),
                       b.column("x").to_pylist(), b.column("n").to_pylist())


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conversation, repaired turns)``; each conversation's turns must be used up before the next."""
    stream = _walk(batches)
    held = next(stream, None)

    def rows():
        nonlocal held
        while held is not None and held[1] == 1:
            _, _, role, text, n = held
            for _ in range(n):
                yield role, text
            held = next(stream, None)

    while held is not None:
        conv, _, _, audit, _ = held
        held = next(stream, None)
        source = rows()
        yield conv, _turns(audit, source)
        for _ in source:                       # nothing is left when the audit fits its rows
            raise RuntimeError("an audit is shorter than its conversation")


def repaired(rows: DataFrame, plans: DataFrame, turns_per_batch: int = 5_000) -> DataFrame:
    """``(conv, position, edit, role, text)``: the repaired turns themselves."""
    out = f"conv {rows.schema['c'].dataType.simpleString()}, position long, edit string, role string, text string"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {f.name: [] for f in schema}
        for conv, turns in _conversations(batches):
            for at, (edit, role, text) in enumerate(turns):
                for name, value in zip(cols, (conv, at, edit, role, text)):
                    cols[name].append(value)
                if len(cols["conv"]) >= turns_per_batch:
                    yield to_batch(cols, schema)
                    cols = {f.name: [] for f in schema}
        if cols["conv"]:
            yield to_batch(cols, schema)

    return _placed(rows, plans).mapInArrow(run, out)


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``(c, sha)``: SHA-256 of the repaired ``role:text`` lines, joined by line feeds, of every conversation."""
    out = f"c {rows.schema['c'].dataType.simpleString()}, sha string"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shas = [], []
        for conv, turns in _conversations(batches):
            sha, between = hashlib.sha256(), ""
            for _, role, text in turns:
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
            names.append(conv)
            shas.append(sha.hexdigest())
            if len(names) >= 10_000:
                yield to_batch({"c": names, "sha": shas}, schema)
                names, shas = [], []
        if names:
            yield to_batch({"c": names, "sha": shas}, schema)

    return _placed(rows, plans).mapInArrow(run, out)


def repair_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", damaged: bool = True) -> DataFrame:
    """Per conversation its faults, the cheapest repair and the digest of the repaired turns.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)`` for every id of the table, of the rows after
    :func:`damage` (or as they are).  ``gaps`` is null where it exceeds a long.
    A conversation without rows has zeros, an empty audit and the digest of the
    empty string.
    """
    rows = (damage if damaged else undamaged)(df, id_col, turn_col, role_col, text_col)
    plans = audits(rows)
    # one narrow row a conversation on both sides; null ids group as one
    both = plans.withColumn("sha", F.lit(None).cast("string")).unionByName(digests(rows, plans), allowMissingColumns=True)
    facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return both.groupBy("c").agg(*[F.max(f).alias(f) for f in facts], F.max("sha").alias("repaired_sha256")) \
        .withColumnRenamed("c", id_col)


# The same in SQL: crc32 by table, then a recursion over the rows from the back; v0..v3 are the best
# (cost, audit, turns) for "none", s, u and a kept last, b0..b3 the same before an inserted turn.
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
base AS (
  SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (
  SELECT b.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(name) + 1), lambda k: ascii(name[k])::BIGINT)),
                              lambda a, z: xor(a >> 8, tab[(xor(a, z) & 255) + 1])), 4294967295) % 20 AS kind
  FROM base b, crc),
damaged AS (
  SELECT c, t, CASE WHEN kind = 4 THEN 'user' ELSE r END AS r,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds),
numbered AS (
  SELECT *, row_number() OVER o AS i, row_number() OVER (PARTITION BY c, r, x ORDER BY t NULLS FIRST, copy) AS nth,
         rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail, left(r, 1) AS ini,
         left(r, 1) AS cur, lag(left(r, 1)) OVER o AS prev
  FROM damaged WINDOW o AS (PARTITION BY c ORDER BY t NULLS FIRST, r, sha256(x), copy)),
facts AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault FROM numbered),
counts AS (
  SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
         count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
         count(*) FILTER (prev IS NOT NULL AND prev || cur NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
         count(*) AS n FROM facts GROUP BY c),
convs AS (SELECT DISTINCT conv_id AS c FROM conversations),
steps AS (
  SELECT convs.c, coalesce(n, 0) AS i, {'cost': 0::BIGINT, 'audit': '', 'turns': ''} AS v0,
         {'cost': 1000000::BIGINT, 'audit': '', 'turns': ''} AS v1,
         {'cost': 5::BIGINT, 'audit': 'I', 'turns': chr(10) || 'assistant:'} AS v2,
         {'cost': 0::BIGINT, 'audit': '', 'turns': ''} AS v3
  FROM convs LEFT JOIN counts ON convs.c IS NOT DISTINCT FROM counts.c
  UNION ALL
  SELECT c, i, list_sort([b0, {'cost': v2.cost + 5, 'audit': 'I' || v2.audit, 'turns': chr(10) || 'user:' || v2.turns}])[1],
         list_sort([b1, {'cost': v2.cost + 5, 'audit': 'I' || v2.audit, 'turns': chr(10) || 'user:' || v2.turns}])[1], v2,
         list_sort([b3, {'cost': b2.cost + 5, 'audit': 'I' || b2.audit, 'turns': chr(10) || 'user:' || b2.turns}])[1]
  FROM (
    SELECT *, list_sort([b2, {'cost': b3.cost + 5, 'audit': 'I' || b3.audit, 'turns': chr(10) || 'assistant:' || b3.turns}])[1] AS v2
    FROM (
      SELECT s.c, s.i - 1 AS i,
        list_sort([del0, rer, CASE ini WHEN 's' THEN k1 WHEN 'u' THEN k2 ELSE none END])[1] AS b0,
        list_sort([del1, rer, CASE ini WHEN 'u' THEN k2 ELSE none END])[1] AS b1,
        list_sort([del2, rea, CASE ini WHEN 'a' THEN k3 ELSE none END])[1] AS b2,
        list_sort([del3, rer, CASE ini WHEN 'u' THEN k2 ELSE none END])[1] AS b3
      FROM (
        SELECT s.c, s.i, ini, {'cost': 1000000::BIGINT, 'audit': '', 'turns': ''} AS none,
          {'cost': v0.cost + 2, 'audit': 'D' || v0.audit, 'turns': v0.turns} AS del0,
          {'cost': v1.cost + 2, 'audit': 'D' || v1.audit, 'turns': v1.turns} AS del1,
          {'cost': v2.cost + 2, 'audit': 'D' || v2.audit, 'turns': v2.turns} AS del2,
          {'cost': v3.cost + 2, 'audit': 'D' || v3.audit, 'turns': v3.turns} AS del3,
          {'cost': v2.cost + 1 + pen, 'audit': 'R' || v2.audit, 'turns': chr(10) || 'user:' || x || v2.turns} AS rer,
          {'cost': v3.cost + 1 + pen, 'audit': 'R' || v3.audit, 'turns': chr(10) || 'assistant:' || x || v3.turns} AS rea,
          {'cost': v1.cost + pen, 'audit': 'K' || v1.audit, 'turns': chr(10) || r || ':' || x || v1.turns} AS k1,
          {'cost': v2.cost + pen, 'audit': 'K' || v2.audit, 'turns': chr(10) || r || ':' || x || v2.turns} AS k2,
          {'cost': v3.cost + pen, 'audit': 'K' || v3.audit, 'turns': chr(10) || r || ':' || x || v3.turns} AS k3
        FROM steps s JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 5 WHEN 'ok' THEN 0 ELSE 1000000 END AS pen FROM facts) f
          ON s.c IS NOT DISTINCT FROM f.c AND s.i = f.i) s)))
SELECT steps.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, v0.cost AS cost, v0.audit AS audit,
       sha256(substr(v0.turns, 2)) AS repaired_sha256
FROM steps LEFT JOIN counts ON steps.c IS NOT DISTINCT FROM counts.c WHERE i = 0
"""
