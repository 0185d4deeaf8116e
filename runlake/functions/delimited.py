"""Column functions for delimited text with quoted cells.

A quote opens a quoted cell only where a cell starts; inside, a doubled quote
stands for one, and the cell ends at a single quote.  Quotes elsewhere are
ordinary characters.  A text is cut at its quote characters, and a fold over
those pieces (not over characters) follows four states:

    0  outside, where a cell starts     2  inside quotes
    1  outside, within a cell           3  just behind a closing quote

``trail`` is the string of the states in front of each quote, from which
everything else follows by one more pass over the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 16 * 1024                # fixed value: the part of a file that decides on its dialect
DELIMITERS = (",", "\t")        # fixed value: delimiters that files may use, in order of preference
SHARE = 0.9                     # of the lines that must agree on their number of cells
MARK = "\uffff"                # a noncharacter, which no text holds
QUOTE = '"'


def pieces(text: Column) -> Column:
    return F.split(text, QUOTE, -1)


def _behind(quoted_from: Column) -> Column:
    """State behind a quote, from the state (digit) in front of it."""
    return F.translate(quoted_from, "0123", "2132")


def _starts_cell(piece: Column, seps: tuple[str, ...] | Column) -> Column:
    if isinstance(seps, Column):
        return F.endswith(piece, seps)
    found = F.endswith(piece, F.lit(seps[0]))
    for s in seps[1:]:
        found = found | F.endswith(piece, F.lit(s))
    return found


def _walk(text: Column, seps, opened: Column) -> Column:
    """Struct of the state behind the last piece and the trail; the first digit is where the text starts."""
    start = F.when(opened, F.lit("2")).otherwise(F.lit("0"))

    def step(acc: Column, piece: Column) -> Column:
        # in front of the first piece there is no quote: ``trail`` is empty then
        behind = F.when(acc["trail"] == "", start).otherwise(_behind(acc["state"]))
        after = F.when((piece == "") | (behind == "2"), behind).when(_starts_cell(piece, seps), F.lit("0")).otherwise(F.lit("1"))
        mark = F.when(acc["trail"] == "", start).otherwise(acc["state"])
        return F.struct(after.alias("state"), F.concat(acc["trail"], mark).alias("trail"))

    return F.aggregate(pieces(text), F.struct(F.lit("").alias("state"), F.lit("").alias("trail")), step)


def ends_inside(line: Column, seps, opened: bool | Column = False) -> Column:
    """Whether a quoted cell is open behind the line, if one was (``opened``) in front of it."""
    opened = F.lit(opened) if isinstance(opened, bool) else opened
    return F.when(F.contains(line, F.lit(QUOTE)), _walk(line, seps, opened)["state"] == "2").otherwise(opened)


def split_cells(record: Column, sep: str | Column) -> Column:
    """Cells of a record, which may span lines inside quotes."""
    seps = (sep,) if isinstance(sep, str) else sep
    lit = F.lit(sep) if isinstance(sep, str) else sep

    def rewritten(trail: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            mark = F.substr(trail, i + 1, F.lit(1))
            inside = F.when(i == 0, F.lit(False)).otherwise(_behind(mark) == "2")
            quote = F.when((i > 0) & mark.isin("1", "3"), F.lit(QUOTE)).otherwise(F.lit(""))
            return F.concat(quote, F.when(inside, t).otherwise(F.replace(t, lit, F.lit(MARK))))
        return F.array_join(F.transform(pieces(record), piece), "")

    # a one-element array names the trail, so it is computed once
    quoted = F.split(F.element_at(F.transform(F.array(_walk(record, seps, F.lit(False))["trail"]), rewritten), 1), MARK, -1)
    plain = F.split(F.replace(record, lit, F.lit(MARK)), MARK, -1)
    return F.when(F.contains(record, F.lit(QUOTE)), quoted).otherwise(plain)


def outside_quotes(text: Column, seps: tuple[str, ...]) -> Column:
    """The text without its quoted cells; the quotes of the cells go, too."""
    def kept(trail: Column) -> Column:
        return F.array_join(F.transform(pieces(text), lambda t, i: F.when(
            (i > 0) & (_behind(F.substr(trail, i + 1, F.lit(1))) == "2"), F.lit("")).otherwise(t)), "")

    quoted = F.element_at(F.transform(F.array(_walk(text, (*seps, "\n"), F.lit(False))["trail"]), kept), 1)
    return F.when(F.contains(text, F.lit(QUOTE)), quoted).otherwise(text)


def agreement(counts: Column) -> Column:
    """(lines, cells) of the most frequent positive count, the greater one of equals; null without any."""
    seen = F.array_distinct(F.filter(counts, lambda c: c > 0))
    return F.array_max(F.transform(seen, lambda c: F.struct(
        F.size(F.filter(counts, lambda x: x == c)).alias("lines"), c.alias("cells"))))


def delimiter_of(head: Column, whole: Column) -> Column:
    """Delimiter of a text from its head, null if the text is not delimited.

    The lines of the head (its last, cut line only counts if it is the only
    one, or if the head is the ``whole`` text) are counted for every delimiter
    outside quoted cells.  A delimiter fits if ``SHARE`` of the lines hold it
    equally often; the one that more lines agree on wins, then the one with
    more cells, then the first.
    """
    def choose(plain: Column) -> Column:
        lines = F.transform(F.split(plain, "\n", -1), lambda l: F.rtrim(l, F.lit("\r")))
        lines = F.when(whole | (F.size(lines) == 1), lines).otherwise(F.slice(lines, F.lit(1), F.size(lines) - 1))
        lines = F.filter(lines, lambda l: l != "")

        def fit(lines: Column) -> Column:
            def counts(d: str) -> Column:
                return F.transform(lines, lambda l: F.length(l) - F.length(F.replace(l, F.lit(d), F.lit(""))))

            best = [F.struct(agreement(counts(d)).alias("a"), F.lit(-k).alias("k"), F.lit(d).alias("d"))
                    for k, d in enumerate(DELIMITERS)]
            fits = F.filter(F.array(*best), lambda b: b["a"]["lines"] >= SHARE * F.size(lines))
            return F.array_max(fits)["d"]

        return F.element_at(F.transform(F.array(lines), fit), 1)

    return F.element_at(F.transform(F.array(outside_quotes(head, DELIMITERS)), choose), 1)
