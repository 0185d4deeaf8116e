"""Quality rules: how far a document's histograms lie from its language's.

Two histograms describe a document: characters by class (capital, digit, white
space, common punctuation, symbol, the rest) and words by common word (the
words in most of the language's documents, and all others).  A language's reference is
the sum of both over all its documents.  The Jensen-Shannon distance (base 2,
0 to 1) between document and reference must stay within a limit; documents
below a minimum length are too small to judge and pass.

Every language with enough documents has its own common words and reference,
counted from its documents; both tables are bounded and read by the driver.
A document whose language is null, rare or beyond the bound is compared with
every reference and judged by the nearest.  Where no language has enough
documents there is none to compare words with: all documents together are the
one reference, for characters only.  Base counts ride along: words, code points
in words, symbols, repeated lines and words inside repeated 8-word windows
(windows are compared by 64-bit hashes within one document).

Null text counts as empty; every row is judged by itself, so repeated rows and
null ids are no special case; extra columns are kept apart under a prefix.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import WHITE, apart, once, stage, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
TOP_WORDS = 16                        # fixed value: common words of each language
MIN_DOCS, MAX_LANGUAGES = 10, 64      # fixed values: documents that make a language known, and known languages at most
MIN_CHARS, MIN_WORDS = 300, 80
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.26
P = "_q_"                             # prefix of helper columns


def common_words(docs: DataFrame) -> dict[str | None, list[str]]:
    """Words in most documents of each known language (a text that repeats a line counts once); only None, without words, where no language is known."""
    known = [r["lang"] for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").count()
             .where(F.col("count") >= MIN_DOCS).orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    if not known:
        return {None: []}
    counts = docs.where(F.col("lang").isin(known)).select("lang", F.explode(F.array_distinct(words(F.col("text")))).alias("word")) \
        .groupBy("lang", "word").count()
    w = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TOP_WORDS)
    out = {k: [] for k in sorted(known)}
    for r in sorted(top.collect(), key=lambda r: r["place"]):      # at most MAX_LANGUAGES * TOP_WORDS rows
        out[r["lang"]].append(r["word"])
    return out


def _histograms(df: DataFrame, common: dict[str | None, list[str]]) -> DataFrame:
    """Adds _q_words, _q_ref (place of the known language or null), _q_chars (counts), _q_near (places of the
    languages to compare with) and _q_common (counts, for each of these)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = once(df, P + "words", words(F.col("text")))
    place = F.lit(0) if None in common else F.array_position(F.lit(list(common)), F.col("lang")).cast("int") - 1
    df = once(df, P + "ref", F.when(place >= 0, place))
    word_chars = F.length(F.array_join(P + "words", ""))
    counted = [F.regexp_count(text, F.lit(c)) for c in ("\\p{Lu}", "[0-9]", "[.,;:!?'\"-]", SYMBOLS)]
    df = once(df, P + "counted", F.array(F.length(text), word_chars, *counted))
    n, inside, *rest = [F.col(P + "counted")[i] for i in range(6)]
    upper, digit, punct, symbol = rest
    df = once(df, P + "chars", F.array(upper, digit, n - inside, punct, symbol,
                                       inside - upper - digit - punct - symbol).cast("array<double>"))
    df = once(df, P + "near", F.when(F.col(P + "ref").isNotNull(), F.array(P + "ref"))
              .otherwise(F.sequence(F.lit(0), F.lit(len(common) - 1))))
    every = sorted({w for listed in common.values() for w in listed})
    df = once(df, P + "listed", F.filter(P + "words", lambda w: w.isin(every)))
    lists = F.lit([[*listed, *[None] * (TOP_WORDS - len(listed))] for listed in common.values()]).cast("array<array<string>>")
    df = once(df, P + "places", F.transform(P + "near", lambda j: F.array_remove(
        F.transform(P + "listed", lambda w: F.array_position(F.get(lists, j), w)), 0)))
    return once(df, P + "common", F.transform(P + "places", lambda p: F.array(
        *[F.size(p) - F.size(F.array_remove(p, F.lit(i + 1).cast("long"))) for i in range(TOP_WORDS)],
        F.size(P + "words") - F.size(p)).cast("array<double>")))


def references(measured: DataFrame, n: int) -> tuple[Column, Column]:
    """Summed character and word histograms of the ``n`` known languages, in their order."""
    k = TOP_WORDS + 1
    sums = measured.where(F.col(P + "ref").isNotNull()).groupBy(P + "ref").agg(
        *[F.sum(F.col(P + "chars")[i]).alias(f"c{i}") for i in range(6)],
        *[F.sum(F.col(P + "common")[0][i]).alias(f"w{i}") for i in range(k)])
    found = {r[P + "ref"]: r for r in sums.collect()}              # at most MAX_LANGUAGES rows

    def part(name: str, size: int) -> Column:
        return F.lit([[found[j][f"{name}{i}"] if j in found else 0.0 for i in range(size)] for j in range(n)])
    return part("c", 6), part("w", k)


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms; null where one is empty."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def terms(p: Column, q: Column) -> Column:
        return half(p, (p + q) / 2) + half(q, (p + q) / 2)

    ta, tb = total(a), total(b)
    d = total(F.zip_with(F.transform(a, lambda v: v / ta), F.transform(b, lambda v: v / tb), terms)) / 2
    return F.when((ta > 0) & (tb > 0), F.sqrt(F.greatest(F.lit(0.0), d)))


def _base(df: DataFrame) -> DataFrame:
    """Adds _q_base: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    df = once(df, P + "lines", lines)
    n = F.size(P + "words")
    df = once(df, P + "hashes", F.when(n >= WINDOW, F.transform(P + "words", lambda w: F.xxhash64(w)))
              .otherwise(F.array().cast("array<bigint>")))
    df = once(df, P + "windows", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
        lambda i: F.xxhash64(F.slice(P + "hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    # where some window repeats: sort (window, place), keep places next to an equal window
    df = once(df, P + "sorted", F.when(
        F.size(P + "windows") > F.size(F.array_distinct(P + "windows")),
        F.sort_array(F.transform(P + "windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    twice = F.filter(P + "sorted", lambda x, i: F.coalesce(F.get(P + "sorted", i - 1)["w"] == x["w"], F.lit(False))
                     | F.coalesce(F.get(P + "sorted", i + 1)["w"] == x["w"], F.lit(False)))
    df = once(df, P + "places2", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a window covers its words up to the next repeated window
    covered = F.aggregate(F.transform(P + "places2", lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get(P + "places2", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, v: s + v)
    return once(df, P + "base", F.struct(
        n.cast("long").alias("n_words"), F.col(P + "counted")[1].cast("long").alias("word_chars"),
        F.col(P + "counted")[5].cast("long").alias("n_symbols"),
        (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")))


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with one struct column ``_q_result``.

    Each text is split once for the common words and measured once; its counts
    are staged beside ``keep``, and both the references and the distances are
    made from them."""
    keep = keep or docs.columns
    common = common_words(docs)
    measured = stage(_base(_histograms(docs, common)).select(
        *keep, P + "ref", P + "near", P + "chars", P + "common", P + "base", F.col(P + "counted")[0].alias(P + "length")),
        "quality")
    ref_chars, ref_common = references(measured, len(common))
    away = F.transform(P + "near", lambda j, i: F.struct(
        js_distance(F.get(F.col(P + "common"), i), F.get(ref_common, j)).alias("words"),
        js_distance(F.col(P + "chars"), F.get(ref_chars, j)).alias("chars")))
    df = once(measured, P + "nearest", F.array_min(away))          # by words, then by characters
    df = once(df, P + "far", F.struct(
        F.when(F.col(P + "length") >= MIN_CHARS, F.col(P + "nearest")["chars"]).alias("chars"),
        F.when((F.col(P + "base")["n_words"] >= MIN_WORDS) & F.lit(None not in common),
               F.col(P + "nearest")["words"]).alias("words")))
    b, far = F.col(P + "base"), F.col(P + "far")
    failed = (b["n_words"] < 20) | (100 * b["n_repeat_words"] > 30 * b["n_words"])
    near = F.coalesce(far["chars"] <= MAX_CHAR_DISTANCE, F.lit(True)) & F.coalesce(far["words"] <= MAX_WORD_DISTANCE, F.lit(True))
    return once(df, P + "result", F.struct(
        *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & near).alias("kept"),
        far["chars"].alias("char_distance"), far["words"].alias("word_distance"))).select(*keep, P + "result")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept, char_distance, word_distance."""
    return judged(docs.select("doc_id", "text", "lang"), ["doc_id"]).select("doc_id", P + "result.*")


def kept_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass, unchanged."""
    return apart(docs, P, ["doc_id", "text", "lang"],
                 lambda d: judged(d).where(F.col(P + "result")["kept"]).select(*d.columns))
