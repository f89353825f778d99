"""Bibliography scan (SRC1, SRC2) and library normalisation (PRJ2-4, FLT1, AGG6).

``spark.read.text`` with ``lineSep="\\n@"`` cuts files at lines that start with
``@``, so large files are split across tasks.  Inside a task the pieces are
put together to groups that begin with an entry's head; a piece that does not
(a value line that starts with ``@``) continues the group before it.  A group
is scanned for all its entries: text between entries is a comment, heads may be
indented, and after an entry that does not close the scan goes on at the next
head.  Such entries go to the rejects table instead of failing the job.

A split may begin inside a group.  Only the edges of splits - their first
headless group and their last group, two rows a split - are brought together by
file and scanned as one; everything else is scanned where it was read.

Names outside braces and quotes are ``@string`` names: the last definition
before the entry in the same file is put in their place (definitions may use
earlier ones), and a name without one stands for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType

from ..functions.text import split_authors
from ..operators.lineage import cut

PLACE = ("src_file", "src_block", "src_row", "src_item")      # unique, and in file order
_PLACE_FIELDS = [StructField("src_file", StringType()), StructField("src_block", LongType()),
                 StructField("src_row", LongType()), StructField("src_item", LongType())]

RAW_SCHEMA = StructType([
    *_PLACE_FIELDS, StructField("entry_id", StringType()), StructField("entry_type", StringType()),
    StructField("fields", MapType(StringType(), StringType())), StructField("error", StringType()),
])

# A field whose value uses ``@string`` names, as its parts in order.
_PART = StructType([StructField("field", StringType()), StructField("part", IntegerType()),
                    StructField("text", StringType()), StructField("named", BooleanType())])
_SCAN_SCHEMA = StructType([*RAW_SCHEMA.fields, StructField("parts", ArrayType(_PART))])
_EDGE_SCHEMA = StructType([*_PLACE_FIELDS[:3], StructField("headless", BooleanType()), StructField("text", StringType())])

LIBRARY_SCHEMA = StructType([
    StructField("entry_id", StringType()), StructField("title", StringType()), StructField("abstract", StringType()),
    StructField("authors", ArrayType(StringType())), StructField("arxiv_id", StringType()),
    StructField("doi", StringType()), StructField("url", StringType()), StructField("year", StringType()),
    StructField("entry_type", StringType()), *_PLACE_FIELDS,
])

# Block types that are not bibliography entries.
NON_ENTRY_TYPES = ("comment", "preamble", "string")

_HEAD = re.compile(r"@\s*([A-Za-z][\w-]*)\s*([{(])")
# What a line has to start with to end an entry that is still open.
_NEW_ENTRY = r"[A-Za-z][\w-]*\s*[{(]\s*[^\s,{}()=]+\s*[,=]"
_STARTS = re.compile(_NEW_ENTRY)
_RECOVER = re.compile(r"\n[ \t]*@\s*" + _NEW_ENTRY)
_KEY = re.compile(r"\s*([^,\s{}()]*)\s*(?:,|(?=[})]))")
_NAME = re.compile(r"\s*([A-Za-z][\w:.+-]*)\s*=\s*")
_BARE = re.compile(r"[^\s,#{}()\"]+")
_SPACE = re.compile(r"\s*")
_SEPARATORS = re.compile(r"[\s,]*")
_BRACE = re.compile(r"[{}]")
_QUOTED = re.compile(r'[{}"]')


def _braced(s: str, i: int) -> int:
    """Index of the brace that closes the one at ``i``."""
    depth = 0
    for m in _BRACE.finditer(s, i):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    raise ValueError("unbalanced braces")


def _quoted(s: str, i: int) -> int:
    """Index of the quote, outside braces, that closes the one at ``i``."""
    depth = 0
    for m in _QUOTED.finditer(s, i + 1):
        if m.group() != '"':
            depth += 1 if m.group() == "{" else -1
        elif depth == 0:
            return m.start()
    raise ValueError("unterminated quote")


def _value(s: str, i: int) -> tuple[list[tuple[str, bool]], int]:
    """Parts ``(text, is a name)`` of the value at ``i`` (joined by ``#``), and the index after it."""
    parts = []
    while True:
        i = _SPACE.match(s, i).end()
        if s[i:i + 1] == "{":
            j = _braced(s, i)
            parts.append((s[i + 1:j], False))
            i = j + 1
        elif s[i:i + 1] == '"':
            j = _quoted(s, i)
            parts.append((s[i + 1:j], False))
            i = j + 1
        else:
            m = _BARE.match(s, i)
            if not m:
                raise ValueError("value expected")
            parts.append((m.group(), not m.group().isdigit()))
            i = m.end()
        i = _SPACE.match(s, i).end()
        if s[i:i + 1] != "#":
            return parts, i
        i += 1


def _scan_body(s: str, i: int, close: str, keyed: bool) -> tuple[str | None, dict, str | None, int]:
    """``(key, values, error, index after it)`` of an entry whose head ends at ``i``."""
    key, values = None, {}
    if keyed:
        k = _KEY.match(s, i)
        if not k or not k.group(1):
            return None, {}, "no citation key", i
        key, i = k.group(1), k.end()
    while True:
        i = _SEPARATORS.match(s, i).end()
        if i >= len(s):
            return key, {}, "entry not closed", i
        if s[i] == close:
            return key, values, None, i + 1
        name = _NAME.match(s, i)
        if not name:
            return key, {}, "field name expected", i
        try:
            got, i = _value(s, name.end())
        except ValueError as exc:
            return key, {}, str(exc), i
        field_name = name.group(1).lower()
        if field_name in values:
            return key, {}, f"duplicate field {field_name}", i
        values[field_name] = got


def scan_entries(text: str) -> Iterator[tuple[str, str | None, dict | None, list | None, str | None]]:
    """``(entry_type, key, fields, parts, error)`` of every entry and ``@string`` of a text, in order.

    ``fields`` holds the values without names; ``parts`` those with names.
    Comments and preambles give nothing.
    """
    at = 0
    while head := _HEAD.search(text, at):
        kind, close = head.group(1).lower(), "}" if head.group(2) == "{" else ")"
        if kind in ("comment", "preamble"):
            try:
                at = _braced(text, head.end() - 1) + 1 if close == "}" else head.end()
            except ValueError:
                at = head.end()
            continue
        key, values, error, after = _scan_body(text, head.end(), close, kind != "string")
        if error is not None:
            yield kind, key, None, None, error
            more = _RECOVER.search(text, head.end())
            if not more:
                return
            at = more.start()
            continue
        parts = [(f, n, t, named) for f, got in values.items() if any(x for _, x in got) for n, (t, named) in enumerate(got)]
        yield kind, key, {f: "".join(t for t, _ in got) for f, got in values.items() if not any(x for _, x in got)}, parts, None
        at = after


def scan_entry(text: str) -> tuple[str | None, str | None, dict | None, str | None]:
    """``(entry_type, key, fields, error)`` of one entry text (leading ``@`` optional); names stand for themselves."""
    text = text if text.lstrip().startswith("@") else "@" + text
    for kind, key, fields, parts, error in scan_entries(text):
        for name, _, part, _ in parts or []:
            fields[name] = fields.get(name, "") + part
        return kind, key, fields, error
    head = _HEAD.match(text.lstrip())
    return (head.group(1).lower(), None, None, None) if head else (None, None, None, "no entry header")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bool, bool, str]]:
    """``(place, headless, last of its split, text)`` of the groups of all splits of a task."""
    split, row, first, headless, held = None, 0, 0, False, []
    for pdf in batches:
        for f, b, text in zip(pdf["src_file"], pdf["src_block"], pdf["value"]):
            if (f, b) != split:
                if held:
                    yield (*split, first), headless, True, "\n@".join(held)
                split, row, first, held = (f, b), 0, 0, []
                opening = int(b) == 0                 # the file's first piece still has its ``@``
                headless = not opening and not _STARTS.match(text)
                held = [text if opening else "@" + text]
            elif _STARTS.match(text):
                yield (*split, first), headless, False, "\n@".join(held)
                first, headless, held = row, False, ["@" + text]
            else:
                held.append(text)
            row += 1
    if held:
        yield (*split, first), headless, True, "\n@".join(held)


def _scanned(place: tuple, text: str) -> Iterator[tuple]:
    for item, (kind, key, fields, parts, error) in enumerate(scan_entries(text)):
        yield (*place, item, key, kind, fields, error, parts)


def _frame(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names)


ROWS = 1_000           # entries handed on at a time


def _in_rows(rows: Iterator[tuple], schema: StructType) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield _frame(held, schema)
            held = []
    yield _frame(held, schema)


def _scan_inside(batches):
    """Entries of the groups that lie inside one split."""
    def rows():
        split_files: dict = {}

        def noted():
            for pdf in batches:
                split_files.update(zip(pdf["src_file"], pdf["divided"]))
                yield pdf
        for place, headless, last, text in _groups(noted()):
            if not (split_files[place[0]] and (headless or last)):
                yield from _scanned(place, text)
    return _in_rows(rows(), _SCAN_SCHEMA)


def _split_edges(batches):
    """The headless and the last group of every split of a divided file."""
    return _in_rows(((*place, headless, text) for place, headless, last, text in _groups(batches) if headless or last), _EDGE_SCHEMA)


def _scan_stitched(batches):
    return _in_rows((r for pdf in batches for f, b, n, text in zip(pdf["src_file"], pdf["src_block"], pdf["src_row"], pdf["text"])
                     for r in _scanned((f, int(b), int(n)), text)), _SCAN_SCHEMA)


def _stitch(edges: DataFrame) -> DataFrame:
    """Headless groups appended to the group before them; two rows a split take part."""
    order = Window.partitionBy("src_file").orderBy("src_block", "src_row")
    heads = edges.withColumn("_g", F.sum(F.when(F.col("headless"), 0).otherwise(1)).over(order))
    # the piece's own ``@`` was cut off by the separator, ``_groups`` put it back
    whole = heads.groupBy("src_file", "_g").agg(
        F.sort_array(F.collect_list(F.struct("src_block", "src_row", "text"))).alias("pieces"))
    return whole.select("src_file", F.col("pieces")[0]["src_block"].alias("src_block"), F.col("pieces")[0]["src_row"].alias("src_row"),
                        F.array_join(F.col("pieces")["text"], "\n").alias("text"))


def _with_names(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """``uses`` with each named part replaced by the last definition before it; only rows with names take part."""
    place = F.struct(*PLACE[1:])
    part = uses.select(*PLACE, place.alias("_at"), F.explode("parts").alias("p")).select(
        *PLACE, "_at", "p.field", "p.part", "p.text", "p.named")
    # narrow rows only; a name defined once meets all its uses in a join, one defined again in file order
    used = part.filter("named").select(*PLACE, "_at", "field", "part", F.lower("text").alias("_name"))
    defined = definitions.select("src_file", place.alias("_def"), F.explode("fields").alias("_name", "_value"))
    per = defined.groupBy("src_file", "_name").agg(F.count(F.lit(1)).alias("_n"), F.min("_def").alias("_def"), F.min("_value").alias("_value"))
    once = (used.join(per.filter("_n = 1").drop("_n"), ["src_file", "_name"]).filter(F.col("_def") < F.col("_at"))
            .select(*PLACE, "field", "part", "_value"))
    again = per.filter("_n > 1").select("src_file", "_name")
    both = (used.withColumn("_value", F.lit(None).cast("string"))
            .unionByName(defined.withColumnRenamed("_def", "_at"), allowMissingColumns=True).join(again, ["src_file", "_name"], "left_semi"))
    before = Window.partitionBy("src_file", "_name").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    last = (both.withColumn("_value", F.last("_value", ignorenulls=True).over(before))
            .filter("field is not null and _value is not null").select(*PLACE, "field", "part", "_value"))
    found = once.unionByName(last)
    filled = part.join(found, [*PLACE, "field", "part"], "left").withColumn("text", F.coalesce("_value", "text"))
    # an entry's fields and a field's parts lie in one entry's text
    value = filled.groupBy(*PLACE, "field").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("ps"))
    more = value.groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("field"), F.array_join(F.col("ps")["text"], "")))).alias("_more"))
    return uses.join(more, list(PLACE)).withColumn("fields", F.map_concat("fields", "_more")).select(*RAW_SCHEMA.names)


def _definitions(strings: DataFrame) -> DataFrame:
    """``@string`` rows with the names in their own values replaced, a level of names a round."""
    done = strings.filter(F.size("parts") == 0).select(*RAW_SCHEMA.names)
    waiting = strings.filter(F.size("parts") > 0)
    while waiting.limit(1).count():
        names = waiting.select("src_file", F.struct(*PLACE[1:]).alias("_def"), F.explode("parts").alias("p")).select(
            "src_file", "_def", F.col("p.field").alias("_name")).distinct()
        uses = waiting.select(*PLACE, F.struct(*PLACE[1:]).alias("_at"), F.explode("parts").alias("p")).filter("p.named").select(
            *PLACE, "_at", F.lower("p.text").alias("_name"))
        blocked = uses.join(names, ["src_file", "_name"]).filter(F.col("_def") < F.col("_at")).select(*PLACE).distinct()
        ready = waiting.join(blocked, list(PLACE), "left_anti")       # the first one waiting in a file is never blocked
        done = cut(done.unionByName(_with_names(ready, done)), "bib-strings")
        waiting = cut(waiting.join(blocked, list(PLACE), "left_semi"), "bib-strings")
    return done


def scan_bib(spark: SparkSession, paths) -> DataFrame:
    """Raw entries ``RAW_SCHEMA`` of all ``.bib`` files under ``paths``; an absent path gives an empty table.

    ``error`` is NULL for parsed entries, else the reason the entry has no
    fields.  Empty files give no row.  Repeated citation keys stay separate rows.
    """
    try:
        meta = F.col("_metadata")
        raw = (spark.read.option("lineSep", "\n@").option("wholetext", "false").text(paths)
               .select("value", meta["file_path"].alias("src_file"), meta["file_block_start"].alias("src_block"),
                       (meta["file_block_length"] < meta["file_size"]).alias("divided")))
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], RAW_SCHEMA)
        raise
    inside = raw.mapInPandas(_scan_inside, _SCAN_SCHEMA)
    edges = raw.filter("divided").mapInPandas(_split_edges, _EDGE_SCHEMA)
    scanned = cut(inside.unionByName(_stitch(edges).mapInPandas(_scan_stitched, _SCAN_SCHEMA)), "bib-entries")
    entries = scanned.filter(~F.col("entry_type").isin(*NON_ENTRY_TYPES))
    plain = entries.filter("parts is null or size(parts) = 0").select(*RAW_SCHEMA.names)
    named = entries.filter("size(parts) > 0")
    strings = _definitions(scanned.filter("entry_type = 'string' and error is null"))
    return plain.unionByName(_with_names(named, strings))


def field(name: str):
    return F.try_element_at(F.col("fields"), F.lit(name))


def library_entries(raw: DataFrame, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(entries LIBRARY_SCHEMA, rejects)``: parsed entries with a non-empty
    title (and the fields named in ``more``), and everything else with a reason."""
    ok = raw.filter(F.col("error").isNull())
    title = F.coalesce(field("title"), F.lit(""))
    abstract = F.coalesce(field("abstract"), field("annote"), F.lit(""))
    authors = F.when(field("author").isNotNull() & (F.trim(field("author")) != ""),
                     split_authors(field("author"))).otherwise(F.array().cast("array<string>"))
    lib = ok.select("entry_id", title.alias("title"), abstract.alias("abstract"), authors.alias("authors"),
                    field("eprint").alias("arxiv_id"), field("doi").alias("doi"), field("url").alias("url"),
                    field("year").alias("year"), "entry_type", *PLACE, *[field(m).alias(m) for m in more])
    entries = lib.filter(F.col("title") != "")
    rejects = (raw.filter(F.col("error").isNotNull()).select(*PLACE, "entry_id", F.col("error").alias("reason"))
               .unionByName(lib.filter(F.col("title") == "").select(
                   *PLACE, "entry_id", F.lit("empty title").alias("reason"))))
    return entries, rejects


def ingest_counts(raw: DataFrame) -> DataFrame:
    """Raw / processed / skipped counts in one pass (AGG6)."""
    title = F.coalesce(field("title"), F.lit(""))
    ok = F.col("error").isNull() & (title != "")
    return raw.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(ok).alias("n_processed"),
                   F.count_if(~ok).alias("n_skipped"))


def load_library(spark: SparkSession, paths, debug_limit: int | None = None) -> DataFrame:
    """Entries of the bibliography in file order; ``debug_limit`` keeps the first n (LIM1)."""
    entries, _ = library_entries(scan_bib(spark, paths))
    if debug_limit:
        entries = entries.orderBy(*PLACE).limit(debug_limit)
    return entries
