"""Text, key and hash column functions (all native Spark expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize_name(c) -> Column:
    """Spaces and hyphens become underscores."""
    return F.translate(_c(c), " -", "__")


def sanitize_string(c) -> Column:
    """Escape double quotes with a backslash."""
    return F.replace(_c(c), F.lit('"'), F.lit('\\"'))


# Fixed value: a term is a quoted phrase or a run of non-space characters.
SEARCH_TERM_PATTERN = r'"([^"]+)"|(\S+)'


def search_terms(c) -> Column:
    """Split a query into terms: quoted phrases stay whole, inner whitespace runs
    of two or more collapse to one space, the phrase is trimmed."""
    q = _c(c)
    phrases = F.regexp_extract_all(q, F.lit(SEARCH_TERM_PATTERN), 1)
    words = F.regexp_extract_all(q, F.lit(SEARCH_TERM_PATTERN), 2)
    picked = F.zip_with(phrases, words, lambda p, w: F.when(p != "", p).otherwise(w))
    return F.transform(picked, lambda t: F.regexp_replace(F.trim(t), r"\s{2,}", " "))


# Fixed value: key="value" pairs, quotes preceded by a backslash do not count.
ATTRIBUTE_PATTERN = r'(?Ud)(\w+)=(?<!\\)"(.+?)(?<!\\)"'


def attribute_pairs(c) -> Column:
    """Array of (key, value) structs in text order."""
    # one regex pass for whole matches ``key="value"``; the key has no '='
    # (word characters), so plain string functions split each match
    matches = F.regexp_extract_all(_c(c), F.lit(ATTRIBUTE_PATTERN), 0)

    def pair(m):
        k = F.substring_index(m, "=", 1)
        return F.struct(k.alias("key"), F.substring(m, F.length(k) + 3, F.length(m) - F.length(k) - 3).alias("value"))

    return F.transform(matches, pair)


def last_wins_map(entries: Column) -> Column:
    """Map from an array of (key, value) structs keeping the last value per key.

    Sorted by (key, position descending), the first entry of each key run is
    the last occurrence: O(n log n) per row and independent of
    ``spark.sql.mapKeyDedupPolicy``.
    """
    indexed = F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), (-i).alias("o"),
                                                         e["value"].alias("v")))

    def dedup(s):
        # ``s`` is a lambda variable: the sorted array is built once, not
        # once per element of the filter below
        firsts = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["k"] != x["k"], F.lit(True)))
        return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["k"].alias("key"),
                                                                         x["v"].alias("value"))))

    return F.element_at(F.transform(F.array(F.array_sort(indexed)), dedup), 1)


def attribute_map(c) -> Column:
    """``key="value"`` pairs to a map; the last occurrence of a key wins."""
    return last_wins_map(attribute_pairs(c))


def merge_attributes(properties, attributes, css_class) -> Column:
    """Widget attribute map: each space-separated property is ``'true'``, then
    ``key="value"`` pairs, then ``class``; later entries win."""
    t = "array<struct<key:string,value:string>>"
    props = F.coalesce(F.split(_c(properties), " "), F.array().cast("array<string>"))
    prop_entries = F.transform(props, lambda p: F.struct(p.alias("key"), F.lit("true").alias("value")))
    attr_entries = F.coalesce(attribute_pairs(attributes), F.array().cast(t))
    cls = F.when(F.coalesce(_c(css_class), F.lit("")) != "",
                 F.array(F.struct(F.lit("class").alias("key"), _c(css_class).alias("value")))
                 ).otherwise(F.array().cast(t))
    return last_wins_map(F.concat(prop_entries.cast(t), attr_entries.cast(t), cls.cast(t)))


def form_slug(parser_id, slug) -> Column:
    return F.concat_ws("-", _c(parser_id).cast("string"), _c(slug))


def strip_form_prefix(c) -> Column:
    """Part after the first ``-`` (the parameter slug of a form slug)."""
    s = _c(c)
    return F.when(F.locate("-", s) > 0, F.substring(s, F.locate("-", s) + 1, F.lit(1 << 30))).otherwise(s)


def ends_with(c, suffix) -> Column:
    return F.endswith(_c(c).cast("string"), F.lit(suffix) if isinstance(suffix, str) else suffix)


def concat_text(a, b) -> Column:
    return F.concat(_c(a).cast("string"), _c(b).cast("string"))


def divide(a, b) -> Column:
    """Float division, NULL when dividing by zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def object_key(app, model, oid) -> Column:
    return F.concat_ws("-", F.lit(app), F.lit(model), _c(oid).cast("string"))


def email_hash(c) -> Column:
    """md5 of the lower-cased e-mail address (avatar key)."""
    return F.md5(F.lower(_c(c)))


def key_hash(c) -> Column:
    return F.sha2(_c(c), 256)


def content_checksum(content, *prefix) -> Column:
    """sha1 of optional text parts (UTF-8) followed by the content bytes."""
    parts = [_c(p).cast("string") for p in prefix] + [_c(content)]
    return F.sha1(F.concat(*[F.coalesce(p, F.lit("")) if i < len(prefix) else p
                             for i, p in enumerate(parts)]).cast("binary"))


def bearer_token(header) -> Column:
    """Token of an ``Authorization`` header of exactly two space-separated parts
    whose first part is ``Bearer``; NULL otherwise."""
    parts = F.split(_c(header), " ")
    return F.when((F.size(parts) == 2) & (F.element_at(parts, 1) == "Bearer"), F.element_at(parts, 2))


# The parts of a version text (epoch, release, pre-release, post-release, development release, local
# version), each with the spellings it may have; case and surrounding white space do not matter.
VERSION_PATTERN = (
    r"(?i)^\s*v?([0-9]+!)?[0-9]+(\.[0-9]+)*"
    r"([-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?[0-9]*)?"
    r"(-[0-9]+|[-_.]?(post|rev|r)[-_.]?[0-9]*)?"
    r"([-_.]?dev[-_.]?[0-9]*)?"
    r"(\+[a-z0-9]+([-_.][a-z0-9]+)*)?\s*$")


def version_or_default(c) -> Column:
    """The version text if it is valid, else "1"."""
    v = _c(c)
    return F.when(v.isNotNull() & v.rlike(VERSION_PATTERN), v).otherwise(F.lit("1"))


def default_group(c, default: str = "Scripts") -> Column:
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def audit_stamp(created_by, user) -> Column:
    """created_by is filled once; modified_by is always the acting user."""
    return F.coalesce(_c(created_by), _c(user))
