"""Predicates on pipe tables at the edges of a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let, nonblank_lines, strip


def is_row(line: Column) -> Column:
    return F.contains(line, F.lit("|")) & (F.length(strip(line)) > 1)


def is_separator(line: Column) -> Column:
    """The line under a table's head: cells of two dashes at least, with colons for alignment."""
    inner = strip(F.regexp_replace(strip(line), r"\A\|+|\|+\z", ""))
    cells = F.filter(F.transform(F.split(inner, r"\|"), strip), lambda c: c != "")
    return F.contains(line, F.lit("|")) & F.contains(inner, F.lit("-")) & (F.size(cells) > 0) & F.forall(cells, lambda c: c.rlike(r"\A:?-{2,}:?\z"))


def edges(text: Column) -> Column:
    """struct<ends, starts, first_row>: ends in an open table, starts inside one, first line is a row."""

    def of(lines: Column) -> Column:
        n = F.size(lines)
        first, last = is_row(F.try_element_at(lines, F.lit(1))), is_row(F.try_element_at(lines, F.lit(-1)))
        open_end = last & (F.exists(lines, is_separator) | ((n >= 2) & is_row(F.try_element_at(lines, F.lit(-2)))))
        no = F.lit(False)
        return F.struct(
            F.when(n > 0, F.coalesce(open_end, no)).otherwise(no).alias("ends"),
            F.when(n > 0, F.coalesce(first & ~F.exists(F.slice(lines, 1, 2), is_separator), no)).otherwise(no).alias("starts"),
            F.when(n > 0, F.coalesce(first, no)).otherwise(no).alias("first_row"),
        )

    none = F.struct(*[F.lit(False).alias(k) for k in ("ends", "starts", "first_row")])
    return F.when(F.contains(text, F.lit("|")), let(nonblank_lines(text), of)).otherwise(none)  # no row is without one
