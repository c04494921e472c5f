"""Lines of a syntax tree dump, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the dump draws its tree and prints places and references.
DRAWING, REFERENCE = " |`", "Function 0x"
_TOKEN = r"<built-in>:\d+:\d+|col:\d+|[^,<>]+?:\d+:\d+"
_PLACE = rf"<({_TOKEN})(?:,\s*({_TOKEN}))?>\s*({_TOKEN})?"
_START = r"<([^,>]+)"
FILE_SCOPE = "<file scope>"
CALLEE_WRAPPERS = ("ImplicitCastExpr", "ParenExpr", "UnaryOperator")
IMPLICIT = {"ConstructorAttr": "constructor", "DestructorAttr": "destructor"}


def node(line: str) -> tuple[int, str, str] | None:
    """(depth, kind, rest) of a line: a drawing of two characters a level that ends in a hyphen, a word, and what follows."""
    text = line.lstrip(DRAWING)
    if not text.startswith("-"):
        return None
    kind, gap, rest_ = text[1:].partition(" ")
    if not kind.isidentifier():
        return None
    return (len(line) - len(text)) // 2, kind, gap + rest_


def name_before_type(rest_: str) -> str | None:
    """The word before the first quote, where one stands apart from what is before it."""
    head, quote, _ = rest_.partition("'")
    words = head.split()
    return words[-1] if quote and words and head[-1].isspace() and words[-1].isidentifier() and head[0].isspace() else None


def _behind_drawing(line: Column) -> Column:
    return F.ltrim(line, F.lit(DRAWING))


def kind(line: Column) -> Column:
    return F.split_part(F.substring(_behind_drawing(line), 2, 1 << 30), F.lit(" "), F.lit(1))


def is_node(line: Column) -> Column:
    return _behind_drawing(line).startswith("-") & kind(line).rlike(r"^[A-Za-z_]\w*$")


def depth(line: Column) -> Column:
    """Two characters of drawing a level."""
    return F.floor((F.length(line) - F.length(_behind_drawing(line))) / 2).cast("int")


def rest(line: Column) -> Column:
    return F.substring(_behind_drawing(line), F.length(kind(line)) + 2, F.length(line))


def own_file(rest_: Column) -> Column:
    """File of the first place on a line; null where it is abbreviated, so that the last one before it counts."""
    start = F.nullif(F.regexp_extract(rest_, _START, 1), F.lit(""))
    head = F.split_part(start, F.lit(":"), F.lit(1))
    return F.when(~head.isin("line", "col"), head)


def _line_of(token: Column) -> Column:
    return F.when((token != "") & ~token.startswith("col:"), F.split_part(token, F.lit(":"), F.lit(-2)).try_cast("int"))


def own_line(rest_: Column) -> Column:
    """Line of a node's own place: its point, else the end of its range, else its start; null where all are abbreviated."""
    part = lambda i: _line_of(F.regexp_extract(rest_, _PLACE, i))
    return F.coalesce(part(3), part(2), part(1))


def declared_name(rest_: Column) -> Column:
    """The name before the quoted type; empty for none."""
    head = F.substring_index(rest_, "'", 1)
    last = F.substring_index(F.rtrim(head), " ", -1)
    return F.when(rest_.contains("'") & head.endswith(" ") & last.rlike(r"^[A-Za-z_]\w*$"), last).otherwise("")


def canonical_type(rest_: Column) -> Column:
    """The last quoted type; empty for none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(rest_, F.lit("'([^']*)'"), F.lit(1)), F.lit(-1)), F.lit(""))


def referenced(rest_: Column) -> Column:
    """The function that a line refers to; null for none."""
    name = F.split_part(F.split_part(rest_, F.lit(REFERENCE), F.lit(2)), F.lit("'"), F.lit(2))
    return F.when(name.rlike(r"^[A-Za-z_]\w*$"), name)


def is_static(rest_: Column) -> Column:
    """Whether the words behind the last quote name static storage."""
    return F.array_contains(F.split(F.trim(F.substring_index(rest_, "'", -1)), r"\s+"), "static")


def linker_names(rest_: Column) -> Column:
    return F.regexp_extract_all(rest_, F.lit('"([^"]+)"'), F.lit(1))


def normal_path(path: Column) -> Column:
    """A path without ., doubled slashes and the .. that a named folder before it undoes; empty becomes a dot."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
    kept = F.aggregate(
        parts, empty,
        lambda acc, p: F.when((p == "..") & up(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & path.startswith("/"), acc).otherwise(F.array_append(acc, p)),
    )
    joined = F.array_join(kept, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)
