"""Column functions for shell command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the tokenizer says about a command that ends too early.
NO_QUOTE = "No closing quotation"
NO_ESCAPED = "No escaped character"

SPECIAL = "[ \t\r\n'\"\\\\]"
SPACE = (" ", "\t", "\r", "\n")


def let(value: Column, use) -> Column:
    """``use`` on a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shell_tokens(command: Column) -> Column:
    """Struct (tokens, error) of a command line, by POSIX quoting rules.

    The line is cut at white space, quotes and backslashes, and a fold over
    the pieces keeps the tokens so far, the token being read (null between tokens) and
    the mode: outside, in single or double quotes, or behind a backslash.
    Single quotes keep everything, double quotes let a backslash escape a
    double quote or a backslash only, outside a backslash escapes any character."""
    bits = F.filter(F.split(command, f"(?={SPECIAL})|(?<={SPECIAL})", -1), lambda p: p != "")
    none = F.lit(None).cast("string")

    def step(acc: Column, p: Column) -> Column:
        mode, token = acc["mode"], acc["token"]
        grown = F.concat(F.coalesce(token, F.lit("")), p)
        started = F.coalesce(token, F.lit(""))
        kept = lambda m, t: F.struct(acc["tokens"].alias("tokens"), t.alias("token"), m.alias("mode"))
        outside = F.when(p.isin(*SPACE), F.struct(
            F.when(token.isNull(), acc["tokens"]).otherwise(F.concat(acc["tokens"], F.array(token))).alias("tokens"),
            none.alias("token"), F.lit("").alias("mode"))) \
            .when(p.isin("'", '"', "\\"), kept(p, started)).otherwise(kept(mode, grown))
        single = F.when(p == "'", kept(F.lit(""), started)).otherwise(kept(mode, grown))
        double = F.when(p == '"', kept(F.lit(""), started)).when(p == "\\", kept(F.lit('"\\'), started)).otherwise(kept(mode, grown))
        escaped = F.when(p.isin('"', "\\"), grown).otherwise(F.concat(started, F.lit("\\"), p))
        return F.when(mode == "", outside).when(mode == "'", single).when(mode == '"', double) \
            .when(mode == "\\", kept(F.lit(""), grown)).otherwise(kept(F.lit('"'), escaped))

    begin = F.struct(F.array().cast("array<string>").alias("tokens"), none.alias("token"), F.lit("").alias("mode"))

    def finish(acc: Column) -> Column:
        error = F.when(acc["mode"].isin("'", '"'), F.lit(NO_QUOTE)).when(acc["mode"] != "", F.lit(NO_ESCAPED))
        tokens = F.when(acc["token"].isNull(), acc["tokens"]).otherwise(F.concat(acc["tokens"], F.array(acc["token"])))
        return F.struct(F.when(error.isNull(), tokens).alias("tokens"), error.alias("error"))

    return F.aggregate(bits, begin, step, finish)
