"""File inventory operators: type detection, previews, dedup, purge, sync.

Files: (file_id, job_id, filename, path, content, size_bytes, checksum,
is_output, param).  References (user files): (file_id, job_id, is_output,
param).  Content is only read where a rule needs it; every other operator
works on the narrow key columns, so Catalyst prunes ``content`` from the
scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.functions.delimited import HEAD, delimiter_of
from runlake.functions.paths import basename, normalize_ref
from runlake.operators.joins import shuffled
from runlake.operators.ranking import free_numbers, row_number_by

FASTA_PREVIEW_LINES = 30         # fixed value: fasta preview window
PREVIEW_HEAD = 5                 # fixed value: rows kept at each end of a long table
PREVIEW_LIMIT = 10               # fixed value: tables up to this many rows are shown whole
ARCHIVE_SUFFIXES = (".tar.gz", ".zip")

# Leading bytes (hex) of image formats recognised as images.
IMAGE_MAGIC = {
    "jpg": "FFD8FF",
    "png": "89504E470D0A1A0A",
    "gif": "47494638",
    "webp": "52494646",          # RIFF; bytes 9-12 must be WEBP
    "bmp": "424D",
    "tif_le": "49492A00",
    "tif_be": "4D4D002A",
    "ico": "00000100",
    "psd": "38425053",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------- detection
def is_image(head: Column) -> Column:
    """Magic-byte test on the first bytes (binary column)."""
    hx = F.hex(F.substring(head, 1, 16))
    conds = [F.startswith(hx, F.lit(m)) for k, m in IMAGE_MAGIC.items() if k != "webp"]
    webp = F.startswith(hx, F.lit(IMAGE_MAGIC["webp"])) & (F.substring(hx, 17, 8) == F.lit("57454250"))
    out = webp
    for c in conds:
        out = out | c
    return out


def head_lines(text: Column, n: int = FASTA_PREVIEW_LINES) -> Column:
    """First ``n`` physical lines (without reading past them)."""
    return F.slice(F.split(F.substring_index(text, "\n", n), "\n"), 1, n)


def is_fasta(text: Column) -> Column:
    """Within the first 30 lines: blank lines skipped, ``;`` comments allowed
    before the first ``>`` header, any other line before it means not fasta;
    at least one sequence line must follow a header."""
    lines = head_lines(text)
    nonblank = F.filter(lines, lambda l: l.rlike(r"\S"))
    sig = F.filter(nonblank, lambda l: ~F.startswith(l, F.lit(";")))
    first_ok = F.startswith(F.element_at(sig, 1), F.lit(">"))
    caret = F.array_position(F.transform(nonblank, lambda l: F.startswith(l, F.lit(">"))), True)
    after = F.slice(nonblank, F.greatest(caret.cast("int"), F.lit(1)), FASTA_PREVIEW_LINES)
    has_seq = F.exists(after, lambda l: ~F.startswith(l, F.lit(">")))
    return F.coalesce(first_ok & (caret > 0) & has_seq, F.lit(False))


def classify_files(files: DataFrame, sniff: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Type per file, tested in the order image, fasta, tabular, else NULL.

    Only a bounded head of each file (16 KiB) decides on its delimiter, and
    only for files that are neither images nor fasta.  ``sniff=False`` applies
    the byte and line rules only (no delimiter).  ``keep`` names columns of the
    files to go along, so that the type need not be joined to them.
    """
    text = F.col("content").cast("string")
    head = F.substring(F.col("content").cast("binary"), 1, 16)
    img = is_image(head)
    fa = is_fasta(text)
    typed = files.select("file_id", "path", "size_bytes", *keep, img.alias("_img"), fa.alias("_fa"),
                         F.when(~img & ~fa, F.substring(text, 1, HEAD)).alias("_head"),
                         (F.length(text) <= HEAD).alias("_whole"))
    delim = delimiter_of(F.col("_head"), F.col("_whole")) if sniff else F.lit(None).cast("string")
    return typed.select("file_id", "path", "size_bytes", *keep,
                        F.when(F.col("_img"), "image").when(F.col("_fa"), "fasta")
                         .when(delim.isNotNull(), "tabular").alias("filetype"),
                        F.when(~F.col("_img") & ~F.col("_fa"), delim).alias("delimiter"))


def is_archive(path: Column) -> Column:
    out = F.lit(False)
    for s in ARCHIVE_SUFFIXES:
        out = out | F.endswith(path, F.lit(s))
    return out


def catalog_group(filetype: Column, path: Column) -> Column:
    """Group a walked file is stored under: archives by suffix, otherwise
    its detected type, otherwise ``all``."""
    return F.when(is_archive(path), "archives").otherwise(F.coalesce(filetype, F.lit("all")))


def group_files(typed: DataFrame) -> DataFrame:
    """Display groups: every file is in ``all`` and also in its own group."""
    g = catalog_group(F.col("filetype"), F.col("path"))
    fan = F.when(g == "all", F.array(F.lit("all"))).otherwise(F.array(g, F.lit("all")))
    return typed.select("file_id", "size_bytes", F.explode(fan).alias("group"))


def group_summary(typed: DataFrame) -> DataFrame:
    return group_files(typed).groupBy("group").agg(F.count("*").alias("n_files"),
                                                   F.sum("size_bytes").alias("total_bytes"))


def ungrouped_files(typed: DataFrame) -> DataFrame:
    """Files of group ``all`` not placed in any specific group."""
    return typed.filter(catalog_group(F.col("filetype"), F.col("path")) == "all").select("file_id", "path")


# ---------------------------------------------------------------- previews
def preview(cells: DataFrame) -> DataFrame:
    """Tabular preview: all rows when a file has at most 10, otherwise rows
    1-5, one gap row (row_no NULL) and the last 5.

    Row counts come from a partially aggregated group-by joined back, so a
    file with a huge number of rows is counted in parallel.
    """
    n = cells.groupBy("file_id").agg(F.max("row_no").alias("_n"))
    c = cells.join(n, "file_id")
    long_ = F.col("_n") > PREVIEW_LIMIT
    keep = ~long_ | (F.col("row_no") <= PREVIEW_HEAD) | (F.col("row_no") > F.col("_n") - PREVIEW_HEAD)
    body = c.filter(keep).select(
        "file_id", F.when(long_ & (F.col("row_no") > PREVIEW_HEAD), F.col("row_no") - F.col("_n") + 11)
                    .otherwise(F.col("row_no")).cast("bigint").alias("slot"),
        F.col("row_no").cast("bigint").alias("row_no"), "cells")
    gaps = n.filter(F.col("_n") > PREVIEW_LIMIT).select(
        "file_id", F.lit(PREVIEW_HEAD + 1).cast("bigint").alias("slot"),
        F.lit(None).cast("bigint").alias("row_no"), F.lit(None).cast("array<string>").alias("cells"))
    return body.unionByName(gaps)


def preview_fasta(lines: DataFrame) -> DataFrame:
    """Fasta preview of the first 30 physical lines of each file.

    Files whose first significant line is not a header are not fasta.  A
    repeated header keeps its first position and its last sequence; a
    header without sequence lines is not shown.
    Returns (file_id, rec_order, header, seq).
    """
    head = lines.filter(F.col("line_no") <= FASTA_PREVIEW_LINES).filter(F.col("line").rlike(r"\S"))
    # one group per file holding at most 30 lines; everything else is array work
    per_file = head.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_ls"))
    ls = F.col("_ls")
    hdr = lambda x: F.startswith(x["line"], F.lit(">"))
    caret = F.array_position(F.transform(ls, hdr), True)
    bad = F.array_position(F.transform(ls, lambda x: ~hdr(x) & ~F.startswith(x["line"], F.lit(";"))), True)
    ok = (caret > 0) & ((bad == 0) | (bad > caret))
    body = F.slice(ls, F.greatest(caret, F.lit(1)).cast("int"), FASTA_PREVIEW_LINES)
    per_file = per_file.filter(ok).select("file_id", body.alias("_b"))
    # each step is its own column, so the lambdas below read arrays that are
    # built once per file (an expression used inside a lambda is rebuilt for
    # every element)
    b = F.col("_b")
    per_file = per_file.withColumn(
        "_hp", F.filter(F.transform(b, lambda x, i: F.when(hdr(x), i)), lambda i: i.isNotNull()))
    hp = F.col("_hp")
    per_file = per_file.select("file_id", F.filter(F.transform(hp, lambda p, k: F.struct(
        F.element_at(b, p + 1)["line"].alias("header"),
        F.array_join(F.transform(F.slice(b, p + 2, F.coalesce(F.get(hp, k + 1), F.size(b)) - p - 1),
                                 lambda x: x["line"]), "").alias("seq"))), lambda r: r["seq"] != "").alias("_recs"))
    recs = F.col("_recs")
    # a repeated header keeps its first position and its last sequence
    headers = F.array_distinct(F.transform(recs, lambda r: r["header"]))
    out = F.transform(headers, lambda h, i: F.struct(
        h.alias("header"), F.element_at(F.filter(recs, lambda r: r["header"] == h), -1)["seq"].alias("seq"),
        (i + 1).cast("bigint").alias("rec_order")))
    return per_file.select("file_id", F.inline(out))


def number_records(lines: DataFrame) -> DataFrame:
    """Record id of each fasta line = running count of header lines.

    Header flags are counted per file with a partial aggregate over line
    blocks, then a running sum inside the block: no window spans a whole
    file, so a huge file is numbered in parallel.
    """
    block = F.floor(F.col("line_no") / F.lit(4096)).cast("bigint")
    is_hdr = F.startswith(F.col("line"), F.lit(">")).cast("int")
    l2 = lines.withColumn("_blk", block).withColumn("_h", is_hdr)
    per_blk = l2.groupBy("file_id", "_blk").agg(F.sum("_h").alias("_bh"))
    before = Window.partitionBy("file_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_blk.select("file_id", "_blk", F.coalesce(F.sum("_bh").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("file_id", "_blk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (l2.join(offs, ["file_id", "_blk"])
              .select("file_id", "line_no", "line",
                      (F.col("_off") + F.sum("_h").over(inner)).cast("bigint").alias("rec_no")))


# ---------------------------------------------------------- dedup and ids
def dedup_uploads(files: DataFrame) -> DataFrame:
    """Uploads (not outputs) sharing a checksum keep the first (lowest id);
    later rows point at it and are listed for deletion.  Outputs are never
    merged."""
    up = files.filter(~F.col("is_output"))
    keeper = up.groupBy("checksum").agg(F.min("file_id").alias("keeper_id"))
    return up.join(keeper, "checksum").select(
        "file_id", "checksum", "keeper_id", (F.col("file_id") != F.col("keeper_id")).alias("to_delete"))


def repoint_favorites(favorites: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("file_id").alias("object_id"), "keeper_id")
    return (favorites.join(m, "object_id", "left")
                     .select("user_id", "content_type",
                             F.coalesce("keeper_id", "object_id").alias("object_id")).distinct())


def match_files(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Get-or-create by checksum: reuse the lowest stored id, otherwise a new
    id numbered after the largest stored id in checksum order (one id per
    distinct new checksum)."""
    ex = stored.groupBy("checksum").agg(F.min("file_id").alias("existing_id"))
    top = stored.select(F.max("file_id")).scalar()
    fresh = (new.select("checksum").distinct().join(ex, "checksum", "left_anti"))
    fresh = row_number_by(fresh, [], ["checksum"], name="_k").select(
        "checksum", (F.coalesce(top, F.lit(0)) + F.col("_k")).alias("new_id"))
    j = new.join(ex, "checksum", "left").join(fresh, "checksum", "left")
    return j.select(F.col("file_id").alias("upload_id"), "checksum",
                    F.coalesce("existing_id", "new_id").alias("stored_id"),
                    F.col("existing_id").isNull().alias("created"))


def purge_plan(refs: DataFrame, purged_jobs: DataFrame) -> DataFrame:
    """On purging jobs: their output or unattached references are dropped;
    a stored file is dropped when no job outside the purged ones references
    it, however many purged jobs do."""
    gone = purged_jobs.select("job_id").distinct().withColumn("_purged", F.lit(True))
    flagged = refs.join(gone, "job_id", "left")
    # one partial aggregate per file: references are never paired
    held = flagged.groupBy("file_id").agg(F.count_if(F.col("_purged").isNull()).alias("_held"))
    p = flagged.filter(F.col("_purged") & (F.col("param").isNull() | F.col("is_output")))
    return p.join(held, "file_id").select("file_id", "job_id", F.lit(True).alias("drop_ref"),
                                          (F.col("_held") == 0).alias("drop_file"))


# ---------------------------------------------------------- storage plans
def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Mirror local files to remote storage: upload when missing, replace an
    empty remote copy, upload a variant when sizes differ, else skip.

    A path listed more than once counts with its newest entry (highest id),
    so there is exactly one action per local file."""
    r = remote.groupBy("path").agg(F.max_by("size_bytes", "file_id").alias("remote_size"))
    j = local.join(r, "path", "left")
    action = (F.when(F.col("remote_size").isNull(), "upload")
               .when(F.col("remote_size") == 0, "replace")
               .when(F.col("remote_size") != F.col("size_bytes"), "upload_variant")
               .otherwise("skip"))
    return j.select("file_id", "path", action.alias("action"))


def _newest_per_path(files: DataFrame, name: str) -> DataFrame:
    """Checksum of the newest entry (highest id) of each path."""
    top = files.groupBy("path").agg(F.max("file_id").alias("file_id"))
    return files.join(top, ["path", "file_id"]).select("path", F.col("checksum").alias(name))


def stale_copies(catalog: DataFrame, local: DataFrame) -> DataFrame:
    """Stored checksum vs local copy, one row per stored path: fetch when
    absent, report when stale.  Both sides are (path, file_id, checksum); the
    newest entry of a path counts."""
    c, l2 = _newest_per_path(catalog, "checksum"), _newest_per_path(local, "local_checksum")
    j = c.join(l2, "path", "left")
    return j.select("path", F.when(F.col("local_checksum").isNull(), "fetch")
                    .when(F.col("local_checksum") != F.col("checksum"), "stale").otherwise("ok").alias("action"))


def write_addressed_paths(files: DataFrame, root: str = "job_files") -> DataFrame:
    """One stored copy per checksum under root/ck[:2]/ck[-2:]/ck/name."""
    from runlake.functions.paths import upload_path
    first = files.groupBy("checksum").agg(F.min_by("filename", "file_id").alias("filename"))
    return first.select("checksum", upload_path("checksum", "filename", root).alias("stored_path"),
                        F.substring("checksum", 1, 2).alias("prefix"), F.substring("checksum", -2, 2).alias("suffix"))


def bundle_manifest(refs: DataFrame, files: DataFrame, job_names: DataFrame) -> DataFrame:
    """Archive entries per job: the folder entry plus every output file,
    except the archives being written (``<name>.tar.gz`` / ``<name>.zip``)."""
    f = (refs.filter(F.col("is_output")).join(files.select("file_id", "filename", "size_bytes"), "file_id")
             .join(job_names, "job_id"))
    f = f.filter(~F.col("filename").isin(F.concat(F.col("job_name"), F.lit(".tar.gz")),
                                         F.concat(F.col("job_name"), F.lit(".zip"))))
    entries = f.select("job_id", F.concat_ws("/", "job_name", "filename").alias("entry"), "size_bytes")
    base = job_names.join(f.select("job_id").distinct(), "job_id", "left_semi").select(
        "job_id", F.concat(F.col("job_name"), F.lit("/")).alias("entry"), F.lit(0).cast("bigint").alias("size_bytes"))
    return base.unionByName(entries)


def unlisted_outputs(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """Walked files whose relative path is not a suffix of a path already
    named by a parameter.  Every suffix of the known paths is generated
    (exact ``endswith``) and matched with one equi-join."""
    suff = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("known_path")),
                                              lambda i: F.substring(F.col("known_path"), i, 1 << 30)))
                        .alias("rel_path")).distinct()
    return inventory.join(shuffled(suff), inventory["path"] == suff["rel_path"], "left_anti")


def first_by_name(files: DataFrame) -> DataFrame:
    """Per job, the first file (lowest id) of each name."""
    return files.groupBy("job_id", "filename").agg(F.min("file_id").alias("file_id"))


def available_names(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """First free ``name.ext``, ``name_1.ext``, ``name_2.ext`` .. per folder.

    An existing file name is split at each of its dots, so an extension may
    hold dots itself (``tar.gz``); a split counts as ``name.ext`` and, when
    the part before the dot ends in ``_<number>`` as this operator writes it
    (no leading zero), as that numbered name too.  Repeated requests of one
    name get the first, second, .. free number.
    """
    key = ["folder", "name", "ext"]
    splits = existing.filter(F.col("filename").contains(".")).select("folder", "filename", F.explode(
        F.sequence(F.lit(1), F.size(F.split("filename", r"\.")) - 1)).alias("_d"))
    splits = splits.withColumn("_stem", F.expr("substring_index(filename, '.', _d)"))
    splits = splits.select("folder", "_stem", F.expr("substring(filename, length(_stem) + 2)").alias("ext"))
    numbered = F.regexp_extract("_stem", r"^(?s)(.*)_([1-9][0-9]*)$", 2).try_cast("bigint")
    taken = splits.select("folder", "ext", F.explode(F.array(
        F.struct(F.col("_stem").alias("name"), F.lit(0).cast("bigint").alias("idx")),
        F.struct(F.regexp_extract("_stem", r"^(?s)(.*)_([1-9][0-9]*)$", 1).alias("name"), numbered.alias("idx")))
        ).alias("_p")).select("folder", "_p.name", "ext", "_p.idx").filter(F.col("idx").isNotNull())
    taken = taken.join(requests.select(*key).distinct(), key, "left_semi")
    asked = row_number_by(requests, key, ["ext"], name="_rank")
    r = free_numbers(asked, taken, key, "idx", "_rank", "_k")
    k = F.col("_k")
    return r.select(*key, F.when(k == 0, F.concat_ws(".", "name", "ext"))
                    .otherwise(F.concat(F.col("name"), F.lit("_"), k.cast("string"), F.lit("."), F.col("ext")))
                    .alias("available"))


def resolve_refs(refs: DataFrame, user_files: DataFrame, files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Resolve file references (ref_id, viewer_id, ref) to stored paths.

    A reference matches a stored file whose path equals the normalized
    reference; if none does, the raw (or slash-converted) reference.  Each
    rule is an equi-join on the path, so a common base name never fans out.
    Outcome: found / not found / not permitted.

    The references of a path are summarised before matching: one row per
    (path, file name) with "has an unowned job", and the distinct
    (path, owner) pairs; a request then joins one summary row and at most
    one pair, so a file referenced by very many jobs does not multiply the
    requests that name it.
    """
    uf = (user_files.join(shuffled(files.select("file_id", "filename", "path")), "file_id")
                    .join(shuffled(jobs.select("job_id", F.col("user_id").alias("owner_id"))), "job_id", "left"))
    stats = uf.groupBy("path", "filename").agg(F.bool_or(F.col("owner_id").isNull()).alias("_pub"))
    pairs = (uf.filter(F.col("owner_id").isNotNull())
               .select(F.col("path").alias("_pp"), F.col("owner_id").alias("_po")).distinct())
    raw = F.trim(F.col("ref"))
    r = refs.withColumn("_norm", normalize_ref(F.col("ref"))).withColumn("_raw", raw) \
            .withColumn("_slash", F.replace(raw, F.lit("\\"), F.lit("/"))).withColumn("_base", basename(raw))

    def matches(key, rule):
        c = stats.withColumnRenamed("path", key)
        return r.join(shuffled(c), key).filter(F.col("filename") == F.col("_base")).select(
            "ref_id", "viewer_id", F.col(key).alias("path"), "_pub", F.lit(rule).alias("rule"))

    allm = matches("_norm", 0).unionByName(matches("_raw", 1)).unionByName(matches("_slash", 1))
    best = allm.groupBy("ref_id").agg(F.min("rule").alias("_best"))
    m = allm.join(shuffled(best), "ref_id").filter(F.col("rule") == F.col("_best"))
    m = m.join(shuffled(pairs), (F.col("path") == F.col("_pp")) & (F.col("viewer_id") == F.col("_po")), "left")
    vis = F.coalesce(F.col("_pub"), F.lit(False)) | F.col("_po").isNotNull()
    agg = m.groupBy("ref_id").agg(F.bool_or(vis).alias("_any_vis"), F.min("path").alias("path"))
    out = refs.select("ref_id").join(shuffled(agg), "ref_id", "left")
    return out.select("ref_id",
                      F.when(F.col("_any_vis").isNull(), "not found").when(~F.col("_any_vis"), "not permitted")
                       .otherwise("found").alias("outcome"),
                      F.when(F.col("_any_vis"), F.col("path")).alias("path"))
