"""Text expressions for paper records, prompts and model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() default set, restricted to ASCII whitespace.  The class
# is spelled out because Java's and RE2's \s differ on \x0B.
WS = r"[ \t\n\r\f\x0B]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim leading and trailing whitespace, including newlines and tabs."""
    return F.regexp_replace(_c(c), rf"\A{WS}+|{WS}+\z", "")


def nonempty(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def authors_line(authors) -> Column:
    joined = F.array_join(F.coalesce(_c(authors), F.array().cast("array<string>")), ", ")
    return F.when(joined != "", F.concat(F.lit("Authors: "), joined))


def paper_text(title="title", abstract="abstract", authors="authors") -> Column:
    """Title, abstract and ``Authors: a, b`` joined by newlines, empties dropped."""
    return strip_ws(F.concat_ws("\n", nonempty(title), nonempty(abstract), authors_line(authors)))


def title_of(text) -> Column:
    """First line of a stored document (stand-in for a title field)."""
    return F.substring_index(F.coalesce(_c(text), F.lit("")), "\n", 1)


def body_of(text) -> Column:
    """Everything after the first newline, NULL when there is none (absent field)."""
    t = F.coalesce(_c(text), F.lit(""))
    pos = F.instr(t, "\n")
    return F.when(pos > 0, F.substring(t, pos + 1, F.length(t)))


def abstract_fallback(abstract, annote) -> Column:
    """``abstract``, else ``annote`` when the abstract field is absent, else ''."""
    return F.coalesce(_c(abstract), _c(annote), F.lit(""))


def flatten(c) -> Column:
    return F.translate(_c(c), "\n", " ")


def split_authors(raw) -> Column:
    """Collapse whitespace, trim, split on `` and ``, trim each name."""
    norm = F.trim(F.regexp_replace(_c(raw), r"\s+", " "))
    return F.transform(F.split(norm, " and "), lambda x: F.trim(x))


def person_name(p) -> Column:
    """Join first, von, last and jr of a name struct, blanks dropped."""
    return F.concat_ws(" ", nonempty(p["first"]), nonempty(p["von"]),
                       nonempty(p["last"]), nonempty(p["jr"]))


def latex_strip(c) -> Column:
    """Drop ``\\footnote{..}``, unwrap ``\\textbf/\\textit/\\texttt{x}``, strip
    outer braces and whitespace; non-strings become ''."""
    s = F.coalesce(_c(c).cast("string"), F.lit(""))
    s = F.regexp_replace(s, r"(?s)\\footnote\{.*?\}", "")
    for cmd in ("textbf", "textit", "texttt"):
        s = F.regexp_replace(s, rf"(?s)\\{cmd}\{{(.*?)\}}", "$1")
    s = F.btrim(s, F.lit("{}"))
    return strip_ws(s)


def label_clean(c) -> Column:
    """First line of a trimmed model reply; empty becomes NULL."""
    return F.nullif(F.split_part(strip_ws(c), F.lit("\n"), F.lit(1)), F.lit(""))


def fence_strip(c) -> Column:
    """Remove an opening markdown fence at the start and a closing one at the end."""
    s = F.regexp_replace(_c(c), r"\A```markdown\n", "")
    return F.regexp_replace(s, r"\n```\z", "")


# ---------------------------------------------------------------- prompts
_TOKEN = re.compile(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}")


def parse_template(template: str, fields: set[str]) -> list[tuple[str, str]] | None:
    """Split a ``str.format`` template into literal and field parts.

    Returns None when the template uses a field outside ``fields`` or has a
    stray brace.  Splitting once means values are never re-expanded.
    """
    parts: list[tuple[str, str]] = []
    pos = 0
    buf = []
    for m in _TOKEN.finditer(template):
        chunk = template[pos:m.start()]
        if "{" in chunk or "}" in chunk:
            return None
        buf.append(chunk)
        tok = m.group(0)
        if tok == "{{":
            buf.append("{")
        elif tok == "}}":
            buf.append("}")
        else:
            name = m.group(1)
            if name not in fields:
                return None
            parts.append(("lit", "".join(buf)))
            buf = []
            parts.append(("field", name))
        pos = m.end()
    tail = template[pos:]
    if "{" in tail or "}" in tail:
        return None
    buf.append(tail)
    parts.append(("lit", "".join(buf)))
    return parts


def fill_template(template, default: str, values: dict, required=None) -> Column:
    """Fill a prompt template from columns.

    ``template`` must contain every ``{name}`` in ``required`` (default: all
    keys of ``values``), otherwise ``default`` is used, as the reference's
    validation does.  Values are plain columns or Python strings.
    """
    required = list(values) if required is None else list(required)
    ok = isinstance(template, str) and all("{" + r + "}" in template for r in required)
    parts = parse_template(template, set(values)) if ok else None
    if parts is None:
        parts = parse_template(default, set(values))
        if parts is None:
            raise ValueError("default template is not valid")
    cols = []
    for kind, v in parts:
        if kind == "lit":
            if v:
                cols.append(F.lit(v))
        else:
            val = values[v]
            cols.append(F.lit(val) if isinstance(val, str) else F.coalesce(_c(val), F.lit("None")))
    return F.concat(*cols) if cols else F.lit("")
