"""Script / version catalog operators.

Versions: (version_id, script_id, script_version, iteration, is_active,
default_version, checksum, created_date).  Scripts: (script_id,
script_name, group_name, description, script_order, is_active, ...).

Every per-script question is one ``groupBy`` with partial aggregation, or
an equi-join against a table pre-aggregated to one row per key, so a script
with very many versions or requests never becomes a single task's load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.operators.joins import shuffled
from runlake.operators.ranking import free_numbers, row_number_by

# Script issue texts in the order they are checked.
ISSUE_NO_VERSIONS = "This script does not have any script versions."
ISSUE_NO_ACTIVE = "This script does not have any active script versions."
ISSUE_NO_DEFAULT = "This script does not have a default version."
ISSUE_MANY_DEFAULTS = "This script has multiple default versions."

# Fixed value: the parts of a lower-cased version text: epoch, release, pre-release and its number, post-release in either
# spelling and its number, development release and its number, local version.
VERSION_PARTS = (
    r"^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?"
    r"(?:[-_.]?(dev)[-_.]?([0-9]*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$")


def _active_default() -> Column:
    return F.col("is_active") & F.col("default_version")


def _text_order() -> Column:
    """Version text order (text, not numeric) with iteration and id tie-breaks."""
    return F.struct("script_version", "iteration", "version_id")


# ---------------------------------------------------------------- joins
def with_parents(versions: DataFrame, scripts: DataFrame) -> DataFrame:
    """Inner join of versions to their script (foreign key)."""
    return versions.join(scripts, "script_id", "inner")


def with_optional(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Optional owner: left join, missing name becomes ''."""
    u = users.select("user_id", "username")
    return jobs.join(u, "user_id", "left").withColumn("username", F.coalesce("username", F.lit("")))


def version_params(versions: DataFrame, bridge: DataFrame, params: DataFrame) -> DataFrame:
    """Many-to-many: versions x parameters through a bridge (two equi-joins)."""
    return (bridge.select("version_id", "param_id")
                  .join(versions.select("version_id", "script_version", "iteration"), "version_id")
                  .join(params, "param_id"))


def has_default(scripts: DataFrame, versions: DataFrame) -> DataFrame:
    """Scripts having an active default version (semi join)."""
    return scripts.join(versions.filter(_active_default()).select("script_id"), "script_id", "left_semi")


def without_default(versions: DataFrame) -> DataFrame:
    """Active versions whose script has no active default (anti join)."""
    d = versions.filter(_active_default()).select("script_id")
    return versions.filter(F.col("is_active")).join(d, "script_id", "left_anti")


def current_scripts(scripts: DataFrame, versions: DataFrame) -> DataFrame:
    """Scripts with an active default, plus scripts whose active versions
    have none; each script once."""
    a = has_default(scripts, versions)
    b = scripts.join(without_default(versions).select("script_id"), "script_id", "left_semi")
    return a.unionByName(b).dropDuplicates(["script_id"])


# ------------------------------------------------------------ selection
def select_version(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve (request_id, script_id, version?, iteration?) to a version id.

    Neither given: the first active default by (version text, iteration).
    Otherwise active versions matching the given fields, the last by
    (version text, iteration).  Each case is answered by an equi-join with a
    table pre-aggregated to one row per lookup key.
    """
    act = versions.filter(F.col("is_active"))
    # every active version answers four kinds of lookup key; one aggregation
    # over the keyed rows builds all lookup tables at once (the version table
    # is computed once), and each request then needs a single join
    null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    variants = F.array(
        F.struct(F.lit("both").alias("kind"), F.col("script_version").alias("v"), F.col("iteration").alias("i")),
        F.struct(F.lit("version").alias("kind"), F.col("script_version").alias("v"), null_i.alias("i")),
        F.struct(F.lit("iter").alias("kind"), null_s.alias("v"), F.col("iteration").alias("i")),
        F.when(F.col("default_version"), F.struct(F.lit("default").alias("kind"), null_s.alias("v"),
                                                  null_i.alias("i"))))
    keyed = act.select("script_id", "version_id", _text_order().alias("_o"),
                       F.explode(F.filter(variants, lambda x: x.isNotNull())).alias("k"))
    lookup = keyed.groupBy("script_id", F.col("k.kind").alias("_kind"), F.col("k.v").alias("_v"),
                           F.col("k.i").alias("_i")).agg(
        F.max_by("version_id", "_o").alias("_last"), F.min_by("version_id", "_o").alias("_first"))
    has_v, has_i = F.col("version").isNotNull(), F.col("iteration").isNotNull()
    kind = F.when(has_v & has_i, "both").when(has_v, "version").when(has_i, "iter").otherwise("default")
    r = requests.select("request_id", F.col("script_id").cast("bigint").alias("_sid"), kind.alias("_rk"),
                        F.col("version").alias("_rv"), F.col("iteration").alias("_ri"))
    cond = ((F.col("_sid") == F.col("script_id")) & (F.col("_rk") == F.col("_kind"))
            & F.col("_rv").eqNullSafe(F.col("_v")) & F.col("_ri").eqNullSafe(F.col("_i")))
    j = r.join(shuffled(lookup), cond, "left")
    chosen = F.when(F.col("_rk") == "default", F.col("_first")).otherwise(F.col("_last"))
    return j.select("request_id", chosen.alias("version_id"))


def latest_version(versions: DataFrame) -> DataFrame:
    """Per script: last version by (version text, iteration) and the first
    active default by (created desc, id desc)."""
    d = F.struct(F.col("created_date"), F.col("version_id"))
    return versions.groupBy("script_id").agg(
        F.max_by("version_id", _text_order()).alias("last_version_id"),
        F.max_by("version_id", F.when(_active_default(), d)).alias("default_version_id"),
    )


def flip_default(versions: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Making versions default clears every other default of their script.

    With several new defaults in one script the newest (created, id) wins.
    Returns (version_id, default_version) for all versions.
    """
    n = versions.join(new_ids, "version_id", "left_semi")
    winner = n.groupBy("script_id").agg(
        F.max_by("version_id", F.struct("created_date", "version_id")).alias("_win"))
    out = versions.join(winner, "script_id", "left")
    return out.select("version_id", "script_id", F.when(F.col("_win").isNull(), F.col("default_version"))
                      .otherwise(F.col("version_id") == F.col("_win")).alias("default_version"))


def next_iteration(versions: DataFrame, new: DataFrame, mode: str = "max") -> DataFrame:
    """Iteration numbers for a batch of new versions (new_id, script_id,
    script_version).  ``max``: max existing iteration + rank in batch;
    ``count``: number of existing rows + rank in batch."""
    agg = F.max("iteration") if mode == "max" else F.count("*")
    base = versions.groupBy("script_id", "script_version").agg(agg.cast("bigint").alias("_base"))
    ranked = row_number_by(new, ["script_id", "script_version"], ["new_id"], name="_k")
    return ranked.join(shuffled(base), ["script_id", "script_version"], "left").select(
        "new_id", "script_id", "script_version",
        (F.coalesce("_base", F.lit(0)) + F.col("_k")).cast("bigint").alias("iteration"))


def find_duplicates(versions: DataFrame, scripts: DataFrame) -> DataFrame:
    """(script_name, checksum) pairs held by more than one version, with the
    version reported as existing: the last by (version text, iteration)."""
    v = versions.join(shuffled(scripts.select("script_id", "script_name")), "script_id")
    return (v.groupBy("script_name", "checksum")
             .agg(F.count("*").alias("n_versions"), F.max_by("version_id", _text_order()).alias("existing_id"))
             .filter(F.col("n_versions") > 1))


# --------------------------------------------------------------- reports
def script_issues(n_versions: Column, n_active: Column, n_defaults: Column) -> Column:
    """Issue list, in the reference's branch order, from the three counts."""
    arr = F.array(
        F.when(n_versions == 0, F.lit(ISSUE_NO_VERSIONS))
         .when(n_active == 0, F.lit(ISSUE_NO_ACTIVE)),
        F.when((n_versions > 0) & (n_defaults == 0), F.lit(ISSUE_NO_DEFAULT))
         .when(n_defaults > 1, F.lit(ISSUE_MANY_DEFAULTS)))
    return F.filter(arr, lambda x: x.isNotNull())


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("script_id").agg(
        F.count("*").alias("n_versions"),
        F.count_if(F.col("is_active")).alias("n_active"),
        F.count_if(_active_default()).alias("n_defaults"),
        F.max_by("version_id", F.when(_active_default(), F.struct("created_date", "version_id")))
         .alias("default_version_id"))


def script_report(scripts: DataFrame, versions: DataFrame) -> DataFrame:
    """Per script: version count, issue list, default version id (one pass)."""
    c = version_counts(versions)
    s = scripts.join(c, "script_id", "left")
    z = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint")
    return s.select(
        "script_id", "script_name",
        F.coalesce(F.col("group_name"), F.lit("")).alias("group"),
        F.coalesce(F.col("description"), F.lit("")).alias("script_description"),
        "script_order", z("n_versions").alias("versions_count"),
        script_issues(z("n_versions"), z("n_active"), z("n_defaults")).alias("issues"),
        "default_version_id")


LIST_BLOCK = 1000   # items per text block of a per-key list


def blocked_lists(df: DataFrame, by: list[str], item: str, order: list, sep: str,
                  block: int = LIST_BLOCK) -> DataFrame:
    """Sorted per-key item lists as text blocks of at most ``block`` items:
    (by..., block, text, n).  Items are numbered with ``row_number_by``
    (hot keys are split), so no group ever holds more than ``block`` items;
    the full list of a key is its blocks in ``block`` order."""
    r = row_number_by(df, by, order, name="_i")
    r = r.withColumn("block", F.floor((F.col("_i") - 1) / F.lit(block)).cast("bigint"))
    return r.groupBy(*by, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", item))), lambda x: x[item]), sep)
         .alias("text"),
        F.count("*").alias("n"))


def version_history(versions: DataFrame) -> DataFrame:
    """Per (script, version text): the iterations in ascending order, as
    blocks of at most 1000 (``text`` comma-joined)."""
    v = versions.withColumn("_it", F.col("iteration").cast("string"))
    return blocked_lists(v, ["script_id", "script_version"], "_it", ["iteration", "version_id"], ",")


def version_labels(versions: DataFrame, scripts: DataFrame) -> DataFrame:
    """Per checksum (shared script file): ``script: iteration`` labels in
    text order, comma-joined in blocks of at most 1000."""
    v = versions.join(scripts.select("script_id", "script_name"), "script_id")
    v = v.withColumn("_lab", F.concat(F.col("script_name"), F.lit(": "), F.col("iteration").cast("string")))
    return blocked_lists(v, ["checksum"], "_lab", ["_lab", "version_id"], ", ")


# ----------------------------------------------------------------- sorts
def version_key(v) -> Column:
    """Sort key of a version text: epoch, release numbers without trailing
    zeros (``1``, ``1.0`` and ``1.0.0`` are equal), then phase (dev < a < b <
    rc < release) with its number, post-release, development release and local version.  All
    spellings of a part are equal (``1.0-beta`` and ``1.0b0``, ``1.0-1`` and
    ``1.0.post1``).  One regular expression takes the text apart, once."""
    col = F.col(v) if isinstance(v, str) else v
    spread = F.split(F.regexp_replace(F.lower(col), VERSION_PARTS, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"), r"\|")
    wide = lambda c: c.try_cast("decimal(38,0)")

    def key(p: Column) -> Column:
        # a text that is no version keeps its place by its text alone, below all versions
        at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
        number = lambda i: F.coalesce(wide(at(i)), F.lit(0).cast("decimal(38,0)"))
        release = F.regexp_replace(at(1), r"(\.0+)+$", "")
        pre, post, dev = at(2), (at(4) != "") | (at(5) != ""), at(7) != ""
        phase = (F.when(pre.isin("a", "alpha"), -3).when(pre.isin("b", "beta"), -2).when(pre != "", -1)
                  .when(dev & ~post, -4).otherwise(0))
        local = F.transform(F.split(at(9), "[-_.]"), lambda x: F.struct(wide(x).isNotNull().alias("numeric"), wide(x).alias("n"), x.alias("t")))
        return F.struct(
            number(0).alias("epoch"), F.transform(F.split(release, r"\."), wide).alias("release"), phase.alias("phase"),
            number(3).alias("pre"), F.when(at(4) != "", number(4)).when(post, number(6)).otherwise(F.lit(-1).cast("decimal(38,0)")).alias("post"),
            F.when(dev, number(8)).otherwise(F.lit("9" * 38).cast("decimal(38,0)")).alias("dev"),
            F.when(at(9) != "", local).alias("local"))

    return F.element_at(F.transform(F.array(spread), key), 1)


def order_versions(versions: DataFrame, mode: str = "parsed") -> DataFrame:
    """Rank of each version inside its script, newest first: by parsed
    release numbers (``parsed``) or by text (``text``), then iteration."""
    k = version_key("script_version") if mode == "parsed" else F.col("script_version")
    # epoch and first release number as one number lead the order: it is what long histories are cut by
    lead = k["epoch"].cast("double") * 1e31 + F.least(k["release"][0].cast("double"), F.lit(1e30)) if mode == "parsed" else k
    return row_number_by(versions.withColumn("_k", k).withColumn("_lead", lead), ["script_id"],
                         ["-_lead", "-_k", "-iteration", "-version_id"], name="version_rank").drop("_k", "_lead")


def catalog_order(scripts: DataFrame) -> DataFrame:
    """Listing order (script_order, id); rank per group."""
    return row_number_by(scripts, ["group_name"], ["script_order", "script_id"], name="position")


def build_versions(scripts: DataFrame) -> DataFrame:
    """Scripts sharing a name become versions of one script: numbered by id,
    the newest is default, all point to the last id of the name."""
    r = row_number_by(scripts, ["script_name"], ["script_id"], name="version_no")
    last = scripts.groupBy("script_name").agg(F.max("script_id").alias("target_id"))
    return r.join(last, "script_name").select(
        "script_id", "script_name", "version_no", "target_id",
        (F.col("script_id") == F.col("target_id")).alias("default_version"))


def unique_slugs(df: DataFrame, col: str, key: str) -> DataFrame:
    """Slug from a name, numbered ``-2``, ``-3`` .. on collision (by key).

    The first row of a slug keeps it plain; later rows take the next numbers
    whose text is not itself the plain slug of another name, so no slug
    appears twice.  A numbered text has one reading (its last hyphen), so
    rows of different slugs cannot meet either.
    """
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(col))), r"[^a-z0-9\s_-]", ""), r"[\s_-]+", "-")
    r = row_number_by(df.select(key, col, base.alias("_slug")), ["_slug"], [key], name="_n")
    first = r.filter(F.col("_n") == 1)
    numbered = r"^(.*)-([1-9][0-9]*)$"
    taken = first.select(F.regexp_extract("_slug", numbered, 1).alias("_stem"),
                         F.regexp_extract("_slug", numbered, 2).try_cast("bigint").alias("_idx"))
    taken = taken.filter(F.col("_idx") >= 2).withColumnRenamed("_stem", "_slug")
    later = r.filter(F.col("_n") > 1).withColumn("_rank", F.col("_n") - 1)
    later = free_numbers(later, taken, ["_slug"], "_idx", "_rank", "_no", start=2)
    return first.select(key, col, F.col("_slug").alias("slug")).unionByName(
        later.select(key, col, F.concat(F.col("_slug"), F.lit("-"), F.col("_no").cast("string")).alias("slug")))
