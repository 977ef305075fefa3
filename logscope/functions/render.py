"""Column expressions that render values and rows as text (PRM1, PRM4, PRM5)
and fill text templates without re-expanding placeholders found in data."""

from __future__ import annotations

import re
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = "None"  # how a missing value prints in prompts


def py_str(c: Column, dtype: T.DataType) -> Column:
    """Value as Python's ``str()`` would print it, for the common types.

    Booleans print ``True``/``False`` and timestamps keep six fraction digits
    (or none when zero). Doubles use Spark's cast (``1.0E-5`` where Python shows
    ``1e-05``; identical for ordinary scores).
    """
    if isinstance(dtype, T.StringType):
        s = c
    elif isinstance(dtype, T.BooleanType):
        s = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        frac = F.date_format(c, "SSSSSS")
        s = F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
                     F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit(NONE))


def render_row(df: DataFrame, exclude=(), cols=None) -> Column:
    """``col: value; col: value`` over the columns in order (minus ``exclude``).

    The column list is resolved from the schema before rendering, so pruning
    still reaches the scan for columns that are not rendered.
    """
    exclude = set(exclude)
    names = [c for c in (cols or df.columns) if c not in exclude]
    parts = [F.concat(F.lit(f"{n}: "), py_str(F.col(n), df.schema[n].dataType)) for n in names]
    return F.concat_ws("; ", *parts)


_FIELD = re.compile(r"\{(\w+)\}")


def template_pieces(template: str) -> list[tuple[str, str]]:
    """Split a ``str.format`` template into ('text', s) and ('field', name) pieces."""
    out: list[tuple[str, str]] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            out.append(("text", template[pos:m.start()]))
        out.append(("field", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("text", template[pos:]))
    return [(k, v.replace("{{", "{").replace("}}", "}") if k == "text" else v) for k, v in out]


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Concatenate template pieces with column values. Unlike nested ``replace``,
    a value that itself contains ``{field}`` is never expanded."""
    return F.concat(*[F.lit(v) if k == "text" else values[v] for k, v in template_pieces(template)])


def sql_template(template: str, values: Mapping[str, str]) -> str:
    """The same fill as SQL text (for oracles): ``'text' || expr || ...``."""
    parts = []
    for k, v in template_pieces(template):
        parts.append("'" + v.replace("'", "''") + "'" if k == "text" else f"({values[v]})")
    return " || ".join(parts) if parts else "''"


def snippet(message: Column, score: Column, width: int = 150) -> Column:
    """``(Score: 0.1234) Msg: text``; text trimmed and cut to ``width`` chars plus ``...``."""
    msg = F.trim(F.coalesce(message, F.lit(NONE)))
    cut = F.when(F.char_length(msg) > width, F.concat(F.substring(msg, 1, width), F.lit("..."))).otherwise(msg)
    score_txt = F.when(score.isNull(), F.lit(NONE)).otherwise(F.format_string("%.4f", score.cast("double")))
    return F.concat(F.lit("(Score: "), score_txt, F.lit(") Msg: "), cut)


def filename_hint(path: Column, compat: bool = True) -> Column:
    """Error hint from a log file name.

    With more than three ``_`` parts and a last part ending in ``.log`` or
    ``.parquet``: the parts between the first and the last two, joined by spaces
    (empty -> ``No anomaly in filename``). Otherwise the stem with ``_`` as
    spaces and ``TOKEN`` removed. ``compat=False`` keeps the second-to-last
    part (the reference drops it, losing e.g. ``error``).
    """
    base = F.element_at(F.split(path, "/"), -1)
    parts = F.split(base, "_")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    drop_tail = 2 if compat else 1
    middle = F.array_join(F.slice(parts, 2, F.greatest(n - 1 - drop_tail, F.lit(0))), " ")
    if not compat:
        # keep the error words and drop only the extension of the last part
        stem_last = F.element_at(F.split(last, r"\."), 1)
        middle = F.trim(F.concat_ws(" ", middle, stem_last))
    long_form = F.when(F.trim(middle) == "", F.lit("No anomaly in filename")).otherwise(F.trim(middle))
    stem = F.element_at(F.split(base, r"\."), 1)
    short_form = F.trim(F.replace(F.regexp_replace(stem, "_", " "), F.lit("TOKEN"), F.lit("")))
    return F.when((n > 3) & (last.endswith(".log") | last.endswith(".parquet")), long_form).otherwise(short_form)
