"""Path layout column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_DIR = "job_files"     # default storage folder of job files


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path) -> Column:
    return F.element_at(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path) -> Column:
    """Text after the last dot of the basename ('' when none)."""
    return F.regexp_extract(basename(path), r"\.([^.]*)$", 1)


def stem(path) -> Column:
    b = basename(path)
    return F.when(F.regexp_extract(b, r"\.([^.]*)$", 0) != "",
                  F.regexp_extract(b, r"^(.*)\.[^.]*$", 1)).otherwise(b)


def upload_path(checksum, filename, root: str = FILE_DIR) -> Column:
    """``root/ck[:2]/ck[-2:]/ck/name`` content-addressed layout."""
    ck = _c(checksum)
    return F.concat_ws("/", F.lit(root), F.substring(ck, 1, 2), F.substring(ck, -2, 2), ck, basename(filename))


def output_path(username, slug, save_path, uuid, root: str = FILE_DIR) -> Column:
    """``root/<user or anonymous>/<save_path or slug>/<uuid>``; empty parts are skipped."""
    user = F.coalesce(F.nullif(_c(username), F.lit("")), F.lit("anonymous"))
    folder = F.coalesce(F.nullif(_c(save_path), F.lit("")), _c(slug))
    return F.concat_ws("/", F.lit(root), valid_filename(user), F.nullif(valid_filename(folder), F.lit("")),
                       _c(uuid).cast("string"))


def valid_filename(c) -> Column:
    """Trimmed, spaces to underscores, only word characters, '-', '.'."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(c)), " ", "_"), r"(?U)[^-\w.]", "")


def relative_path(path, base) -> Column:
    """Part of ``path`` from the first occurrence of ``base``, leading '/' removed."""
    p, b = _c(path), _c(base)
    pos = F.instr(p, b)
    tail = F.when(pos > 0, F.substring(p, pos, F.lit(1 << 30))).otherwise(F.substring(p, -1, 1))
    return F.regexp_replace(tail, "^/+", "")


def normalize_ref(ref) -> Column:
    """Strip, backslash to slash, collapse ``.``/empty parts and resolve ``..``.

    Returns NULL for empty references and for references escaping their root.
    """
    raw = F.trim(_c(ref))
    p = F.replace(raw, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    # fold: stack of kept parts; -1 depth marks an escape above the root
    init = F.struct(F.array().cast("array<string>").alias("st"), F.lit(False).alias("bad"))
    folded = F.aggregate(
        parts, init,
        lambda acc, x: F.when(x == "..", F.struct(
            F.when(F.size(acc["st"]) > 0, F.slice(acc["st"], 1, F.size(acc["st"]) - 1))
             .otherwise(acc["st"]).alias("st"),
            (acc["bad"] | (F.size(acc["st"]) == 0)).alias("bad")))
        .otherwise(F.struct(F.concat(acc["st"], F.array(x)).alias("st"), acc["bad"].alias("bad"))))
    out = F.array_join(folded["st"], "/")
    return F.when((raw == "") | raw.isNull() | folded["bad"] | F.startswith(p, F.lit("/")), F.lit(None)).otherwise(out)


def ref_matches(ref, stored) -> Column:
    """Raw or slash-normalized equality of a reference with a stored name."""
    r = F.trim(_c(ref))
    return (r != "") & ((r == _c(stored)) | (F.replace(r, F.lit("\\"), F.lit("/")) == _c(stored)))
