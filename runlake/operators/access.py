"""Access rules, API keys and favorites.

Permission questions are answered per request row (user, object): the
request is joined to its user and to its object by key and the group rule
is evaluated on the two group arrays, so the work is linear in requests and
never enumerates users x objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.text import bearer_token, key_hash
from runlake.operators.ranking import row_number_by


def common_groups(a, b) -> Column:
    return F.array_intersect(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def group_rule(obj_groups: Column, obj_active: Column, user_groups: Column, authenticated: Column,
               allow_anonymous: bool) -> Column:
    """Object permission: anonymous users may use objects without groups
    (when allowed; this ignores ``is_active``); objects without groups are
    open when active; active objects are open to members of any of their
    groups."""
    no_groups = F.size(obj_groups) == 0
    gate = authenticated | F.lit(allow_anonymous)
    anon_ok = ~authenticated & F.lit(allow_anonymous) & no_groups
    open_ok = no_groups & obj_active
    member_ok = obj_active & F.arrays_overlap(user_groups, obj_groups)
    return gate & (anon_ok | open_ok | F.coalesce(member_ok, F.lit(False)))


def _groups(c: Column) -> Column:
    """'' (unrestricted) -> [], otherwise a one-element list."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(c))


# Fixed value: what a user without access to a restricted object is told.
FORBIDDEN = "You are not permitted to use this script"


def rule_error(obj_groups: Column, authenticated: Column, allow_anonymous: bool) -> Column:
    """What is said where the rule fails: only restricted objects explain it, and only to users who may come in."""
    told = (authenticated | F.lit(allow_anonymous)) & (F.size(obj_groups) > 0)
    return F.when(told, F.lit(FORBIDDEN)).otherwise(F.lit(""))


def _with_groups(requests: DataFrame, users: DataFrame, scripts: DataFrame, how: str) -> DataFrame:
    u = users.select("user_id", F.array("user_group").alias("ugroups"))
    s = scripts.select("script_id", "is_active", "group_active", _groups(F.col("script_group")).alias("own"),
                       _groups(F.col("parent_group")).alias("parent"))
    r = requests.join(u, "user_id", "left").join(s, "script_id", how)
    return r.withColumn("ugroups", F.coalesce("ugroups", F.array().cast("array<string>")))


def script_rule(requests: DataFrame, users: DataFrame, scripts: DataFrame, allow_anonymous: bool = True) -> DataFrame:
    """Every request (with user_id, script_id) with ``permitted`` and ``refusal``, by the rule of the script alone.

    An unknown script is not permitted, without a reason."""
    r = _with_groups(requests, users, scripts, "left")
    auth, groups = F.col("user_id").isNotNull(), F.array_union("own", "parent")
    ok = F.coalesce(group_rule(groups, F.col("is_active"), F.col("ugroups"), auth, allow_anonymous), F.lit(False))
    told = F.coalesce(rule_error(groups, auth, allow_anonymous), F.lit(""))
    return r.select(*requests.columns, ok.alias("permitted"), F.when(~ok, told).alias("refusal"))


def access_check(requests: DataFrame, users: DataFrame, scripts: DataFrame,
                 allow_anonymous: bool = True, show_locked: bool = True) -> DataFrame:
    """Per request (request_id, user_id, script_id): the script rule AND the
    rule of its script group must both pass.  A script's groups are its own
    plus its group's; the group has its own groups and its own activity.
    ``error`` is the reason of the first rule that fails ('' if it gives none)."""
    r = _with_groups(requests, users, scripts, "inner")
    auth, ug = F.col("user_id").isNotNull(), F.col("ugroups")
    every = F.array_union("own", "parent")
    script_ok = group_rule(every, F.col("is_active"), ug, auth, allow_anonymous)
    group_ok = group_rule(F.col("parent"), F.col("group_active"), ug, auth, allow_anonymous)
    error = F.when(~script_ok, rule_error(every, auth, allow_anonymous)).when(
        ~group_ok, rule_error(F.col("parent"), auth, allow_anonymous))
    return r.select("request_id", "user_id", "script_id", (script_ok & group_ok).alias("valid"), error.alias("error"),
                    F.lit("disabled" if show_locked else "hide").alias("display"))


def group_access(requests: DataFrame, users: DataFrame, scripts: DataFrame) -> DataFrame:
    """Groups a user shares with a script (array intersection), per request."""
    u = users.select("user_id", F.array("user_group").alias("ugroups"))
    s = scripts.select("script_id", F.array_union(_groups(F.col("script_group")),
                                                  _groups(F.col("parent_group"))).alias("ogroups"))
    r = requests.join(u, "user_id", "inner").join(s, "script_id", "inner")
    return r.select("request_id", F.array_join(F.array_sort(common_groups("ugroups", "ogroups")), ",")
                    .alias("common"), F.arrays_overlap("ugroups", "ogroups").alias("overlap"))


def resolve_keys(requests: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """Bearer tokens to users: sha256 of the token matched to an active key
    of an active user.  Returns per key the number of uses and last use."""
    tok = requests.select("request_id", "ts", key_hash(bearer_token(F.col("auth_header"))).alias("key_hash"))
    k = keys.filter("active").select("key_id", "user_id", "key_hash")
    act = users.filter("is_active").select("user_id")
    hits = tok.filter(F.col("key_hash").isNotNull()).join(k, "key_hash").join(act, "user_id", "left_semi")
    return hits.groupBy("key_id", "user_id").agg(F.count("*").alias("n_requests"),
                                                 F.max("ts").alias("last_used"))


def toggle_favorites(favorites: DataFrame, toggles: DataFrame) -> DataFrame:
    """Favorites after a toggle log: present iff initially present XOR an odd
    number of toggles."""
    keys = ["user_id", "content_type", "object_id"]
    # one struct join key: a content type that is a constant on both sides
    # must not fold into a constant join condition (nested-loop join)
    init = favorites.select(F.struct(*keys).alias("_k")).distinct().withColumn("_init", F.lit(True))
    odd = toggles.groupBy(F.struct(*keys).alias("_k")).agg((F.count("*") % 2 == 1).alias("_odd"))
    j = init.join(odd, "_k", "full_outer")
    present = F.coalesce(F.col("_init"), F.lit(False)) != F.coalesce(F.col("_odd"), F.lit(False))
    return j.filter(present).select(*[F.col("_k")[k].alias(k) for k in keys])


def favorite_count(favorites: DataFrame) -> DataFrame:
    return favorites.groupBy("user_id", "content_type").agg(F.count("*").alias("n_favorites"))


def favorites_of(favorites: DataFrame, kind: str, target: DataFrame, target_key: str) -> DataFrame:
    """Polymorphic reference: favorites of one content type joined to its table."""
    f = favorites.filter(F.col("content_type") == kind)
    return f.join(target, f["object_id"] == target[target_key], "inner")


def favorites_first(scripts: DataFrame, favorites: DataFrame) -> DataFrame:
    """Per user listing order with favorites first, then by name.

    Returned as two blocks: each user's favorite scripts ranked by name
    (``block='favorite'``), and one shared block of all scripts ranked by
    name (``user_id`` NULL); a user's list is the first block followed by the
    shared block without the user's favorites.  No user x script product.
    """
    f = (favorites.filter(F.col("content_type") == "script")
                  .select("user_id", F.col("object_id").alias("script_id")).distinct()
                  .join(scripts.select("script_id", "script_name"), "script_id"))
    # a user with very many favorites is numbered in slices (row_number_by)
    fav = row_number_by(f, ["user_id"], ["script_name", "script_id"], name="position").select(
        "user_id", "script_id", F.lit("favorite").alias("block"), "position")
    shared = row_number_by(scripts.select("script_id", "script_name"), [], ["script_name", "script_id"],
                           name="position")
    return fav.unionByName(shared.select(F.lit(None).cast("bigint").alias("user_id"), "script_id",
                                         F.lit("all").alias("block"), "position"))
