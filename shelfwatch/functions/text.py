"""Text expressions used by triage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space removed at both ends, the line breaks, and the
# two patterns found in messages.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
FILE_IN_MESSAGE = r"\((models[/\\][^)]+)\)"
NODE_IN_MESSAGE = r"\b(model|test)\.[\w-]+\.[\w-]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    """Part after the last separator of either kind."""
    return F.element_at(F.split(forward_slashes(path), "/"), -1)


def file_in_message(message: Column) -> Column:
    """Model path quoted in brackets, or the empty string."""
    return F.coalesce(F.regexp_extract(message, FILE_IN_MESSAGE, 1), F.lit(""))


def node_in_message(message: Column) -> Column:
    return F.regexp_extract(message, "(?U)" + NODE_IN_MESSAGE, 0)


def id_head(unique_id: Column) -> Column:
    """Part of a dotted id before the first dot: the node type."""
    return F.substring_index(unique_id, ".", 1)


def id_tail(unique_id: Column) -> Column:
    """Part of a dotted id after the last dot: the node name."""
    return F.substring_index(unique_id, ".", -1)
