"""Access control over documents and points: ceilings, subtree and grant rules, and the joins that apply them to many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import And, In, IsNull, Match, Or, PrefixMatch, Range, VectorFilter, ancestor_paths

# The highest visibility level that a role reads in a mode; other pairs are denied.
CEILINGS = (
    ("guest", "customer", 0),
    ("customer", "customer", 1),
    ("internal_employee", "customer", 1),
    ("manager", "customer", 1),
    ("admin", "customer", 1),
    ("internal_employee", "internal", 2),
    ("manager", "internal", 3),
    ("admin", "internal", 4),
)
LEVELS = ("public", "customer", "internal", "confidential", "restricted")
INTERNAL, CONFIDENTIAL, RESTRICTED = 2, 3, 4
MOST_GRANTS = 5000
#: Documents of a pack, about, and of a slice of it; principals of a key, about, and keys over which those of equal rules
#: are dealt, at most.
PACK, SLICE, SHARE, DEALT = 4096, 256, 32, 64


def ceilings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CEILINGS, "role string, mode string, ceiling int")


def resolve_ceiling(principals: DataFrame) -> DataFrame:
    """principals with their ceiling (null: denied). The table of ceilings has eight rows."""
    return principals.join(F.broadcast(ceilings(principals.sparkSession)), ["role", "mode"], "left").withColumn("denied", F.col("ceiling").isNull())


def acl_filter(mode: str, ceiling: int, path: str | None, granted: tuple[int, ...] = (), now: float = 0.0, collections: tuple[int, ...] = ()) -> VectorFilter:
    """What one principal may read, as a filter. Grants never lift the ceiling; no path, no confidential document."""
    must = [Match("mode", mode), Match("is_active", True), Range("visibility_level", lte=ceiling), Or((IsNull("expires_epoch"), Range("expires_epoch", gt=now)))]
    if collections:
        must.append(In("collection_id", collections))
    ways = [Range("visibility_level", lte=min(ceiling, INTERNAL))]
    if path and ceiling >= CONFIDENTIAL:
        ways.append(And((Match("visibility_level", CONFIDENTIAL), PrefixMatch("department_path", path))))
    if ceiling >= RESTRICTED:
        ways.append(Match("visibility_level", RESTRICTED))
    if granted:
        ways.append(In("document_id", granted))
    return VectorFilter(must=tuple(must), should=tuple(ways))


def in_subtree(path: Column, root: Column) -> Column:
    return F.coalesce((path == root) | path.startswith(F.concat(root, F.lit("."))), F.lit(False))


def reach_keys(mode: Column, level: Column, path: Column) -> Column:
    """The keys under which a document can be reached, one per way in: its own (mode, level), and for a confidential one
    (mode, level, ancestor) for every ancestor of its path. struct(mode, level, ancestor); the last is empty otherwise."""
    key = lambda p: F.struct(mode.alias("mode"), level.cast("int").alias("level"), p.alias("ancestor"))
    within = F.transform(F.coalesce(ancestor_paths(path), F.array().cast("array<string>")), key)
    return F.when(level == CONFIDENTIAL, within).otherwise(F.array(key(F.lit(""))))


def _group(mode: Column, ceiling: Column, path: Column) -> Column:
    """The name of a rule group: text, not a hash, since two groups that shared a name would share their documents."""
    return F.concat(mode, F.lit("|"), ceiling.cast("string"), F.coalesce(F.concat(F.lit("|"), path), F.lit("")))


def rule_groups(principals: DataFrame) -> DataFrame:
    """(group_id, mode, ceiling, path): the distinct rules that principals fall under; denied ones fall under none."""
    who = resolve_ceiling(principals).filter(~F.col("denied"))
    return who.select("mode", "ceiling", F.col("department_path").alias("path")).distinct().withColumn("group_id", _group(F.col("mode"), F.col("ceiling"), F.col("path")))


def group_keys(groups: DataFrame) -> DataFrame:
    """groups with the keys they open, one row each: every level up to their ceiling, confidential ones at their path.

    A group without a path opens no confidential document.
    """
    level = F.explode(F.sequence(F.lit(0), F.col("ceiling")))
    rows = groups.select("*", level.alias("level"))
    ancestor = F.when(F.col("level") == CONFIDENTIAL, F.col("path")).otherwise(F.lit(""))
    return rows.withColumn("ancestor", ancestor).filter("ancestor IS NOT NULL")


def readable_by_group(points: DataFrame, groups: DataFrame, now: float = 0.0) -> DataFrame:
    """points with the group_id of every rule group that may read them.

    An equi-join on (mode, level, ancestor), with nothing left to test afterwards. Points of one key may be many; the
    groups of a key are few, since they are distinct rules, so a large key's points can be split and none is repeated for
    a principal.
    """
    live = points.filter(F.col("is_active") & (F.col("expires_epoch").isNull() | (F.col("expires_epoch") > now)))
    keyed = live.withColumn("_key", F.explode(reach_keys(F.col("mode"), F.col("visibility_level"), F.col("department_path"))))
    keyed = keyed.withColumns({"_mode": F.col("_key.mode"), "_level": F.col("_key.level"), "_ancestor": F.col("_key.ancestor")}).drop("_key")
    doors = group_keys(groups).select(F.col("mode").alias("_mode"), F.col("level").alias("_level"), F.col("ancestor").alias("_ancestor"), "group_id")
    return keyed.join(doors, ["_mode", "_level", "_ancestor"]).drop("_mode", "_level", "_ancestor")


def acl_join(points: DataFrame, principals: DataFrame, now: float = 0.0) -> DataFrame:
    """Every (principal, point) that may be read: points meet rule groups, and these their principals.

    principals: principal_id, role, mode, department_path. What comes out has a row per principal and point by nature;
    readable_by_group() is the form to store.
    """
    who = resolve_ceiling(principals).filter(~F.col("denied"))
    members = who.select("principal_id", "ceiling", _group(F.col("mode"), F.col("ceiling"), F.col("department_path")).alias("group_id"))
    return readable_by_group(points, rule_groups(principals), now).join(members, "group_id").drop("group_id")


def in_subtree_of_any(points: DataFrame, roots: DataFrame) -> DataFrame:
    """points with root, once for every one of roots(root) in whose subtree their path lies: an equi-join on ancestors."""
    each = points.withColumn("_root", F.explode(ancestor_paths(F.col("department_path"))))
    return each.join(roots.select(F.col("root").alias("_root"), "root").distinct(), "_root").drop("_root")


def matrix_difference(points: DataFrame, principals: DataFrame, oracle: DataFrame, grants: DataFrame | None = None, now: float = 0.0) -> DataFrame:
    """(principal_id, side, visibility_level, n, witness): where the rules and an oracle(principal_id, document_id) differ.

    side is `missing` for what the oracle allows and the rules don't, `extra` for the reverse; n documents of a level, of
    which witness is the least. grants(principal_id, document_id) add what lies within the principal's mode and ceiling.
    Empty if both sets are equal.
    """
    got = acl_join(points, principals, now).select("principal_id", "document_id")
    if grants is not None:
        who = resolve_ceiling(principals).filter(~F.col("denied")).select("principal_id", F.col("mode").alias("_mode"), F.col("ceiling").alias("_ceiling"))
        live = points.filter(F.col("is_active") & (F.col("expires_epoch").isNull() | (F.col("expires_epoch") > now)))
        held = grants.join(live, "document_id").join(who, "principal_id").filter("mode = _mode AND visibility_level <= _ceiling")
        got = got.unionByName(held.select("principal_id", "document_id"))
    side = lambda df, name: df.distinct().select("principal_id", "document_id", F.lit(name).alias("_side"))
    both = side(got, "extra").unionByName(side(oracle.select("principal_id", "document_id"), "missing"))
    alone = both.groupBy("principal_id", "document_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_side").alias("side")).filter("_n = 1")
    levels = points.select("document_id", "visibility_level").distinct()
    return alone.join(levels, "document_id", "left").groupBy("principal_id", "side", "visibility_level").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("witness"))


def verify_readable(hits: DataFrame, docs: DataFrame, ceiling: int, path: str | None, mode: str, today: str) -> DataFrame:
    """Hits whose document passes the second check, on the document table itself: archived and not yet effective ones go."""
    day = F.unix_seconds(F.lit(today).cast("timestamp")).cast("double")
    level = F.col("visibility_level")
    ways = (level <= min(ceiling, INTERNAL)) | ((level == CONFIDENTIAL) & in_subtree(F.col("department_path"), F.lit(path))) | ((level == RESTRICTED) & F.lit(ceiling >= RESTRICTED))
    fine = docs.filter((level <= ceiling) & ~F.col("is_archived") & (F.col("mode") == mode) & (F.col("expires_epoch").isNull() | (F.col("expires_epoch") > day)) & (F.col("created_on") <= F.lit(today).cast("date")) & ways)
    return hits.join(fine.select("document_id"), "document_id", "left_semi")


def can_read_document(docs: DataFrame, ceiling: int, path: str | None, mode: str, granted: Column) -> DataFrame:
    """docs with can_read; here a grant wins over the ceiling, unlike in acl_filter."""
    level = F.col("visibility_level")
    rule = F.when(F.col("mode") != mode, False).when(granted, True).when(level > ceiling, False).when(level == CONFIDENTIAL, in_subtree(F.col("department_path"), F.lit(path))).when(level == RESTRICTED, F.lit(ceiling >= RESTRICTED)).otherwise(True)
    return docs.withColumn("can_read", F.coalesce(rule, F.lit(False)))


def retrievable(docs: DataFrame, today: str) -> DataFrame:
    day = F.unix_seconds(F.lit(today).cast("timestamp")).cast("double")
    return docs.filter(~F.col("is_archived") & F.col("is_active") & (F.col("created_on") <= F.lit(today).cast("date")) & (F.col("expires_epoch").isNull() | (F.col("expires_epoch") > day)))


def granted_documents(grants: DataFrame, principals: DataFrame, inherit: bool = False) -> DataFrame:
    """(principal_id, document_id, over): documents granted by role, by user or by department path, once each.

    over marks principals with more than MOST_GRANTS grants: an error for the caller, not a cut. With inherit, grants
    of a path reach its whole subtree.

    The result has a row per principal and document by nature. What principals of equal roles and paths share is therefore
    made distinct and counted once for them all, and dealt as slices of documents; the pairs themselves are only written.
    A slice is the outer side of the merge: it meets one principal after the other before the next slice comes, so in the
    rows a principal is a run and its documents come again after SLICE rows, of which a columnar file keeps little.
    """
    g = grants.select("document_id", "subject_kind", F.col("subject").cast("string").alias("subject"))
    subject = lambda kind, c: F.struct(F.lit(kind).alias("subject_kind"), c.cast("string").alias("subject"))
    path = F.explode(ancestor_paths(F.col("department_path"))) if inherit else F.col("department_path")
    shared = principals.select("principal_id", subject("role", F.col("role")).alias("_s")).union(principals.select("principal_id", path.alias("p")).select("principal_id", subject("path", F.col("p")).alias("_s")))
    who = shared.groupBy("principal_id").agg(F.array_sort(F.collect_set("_s")).alias("_rules"))
    rules = who.groupBy("_rules").agg(F.least(F.ceil(F.count(F.lit(1)) / SHARE), F.lit(DEALT)).alias("_deals"))
    common = rules.select("_rules", "_deals", F.inline("_rules")).join(g, ["subject_kind", "subject"]).select("_rules", "_deals", "document_id").distinct()
    sizes = common.groupBy("_rules", "_deals").agg(F.count(F.lit(1)).alias("_n"))
    users = principals.select("principal_id", F.lit("user").alias("subject_kind"), F.col("user_id").cast("string").alias("subject"))
    own = users.join(g, ["subject_kind", "subject"]).select("principal_id", "document_id").distinct().join(who, "principal_id").join(common, ["_rules", "document_id"], "left_anti")
    counts = own.groupBy("principal_id").agg(F.count(F.lit(1)).alias("_m"))
    held = who.join(sizes, "_rules", "left").join(counts, "principal_id", "left").withColumn("over", F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0)) > MOST_GRANTS)
    pack = F.pmod(F.xxhash64("document_id"), F.ceil(F.col("_n") / PACK))
    packs = common.join(sizes, ["_rules", "_deals"]).groupBy("_rules", "_deals", pack.alias("_pack")).agg(F.sort_array(F.collect_list("document_id")).alias("_all"))
    slices = packs.select("_rules", "_deals", F.explode(F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(SLICE)), lambda i: F.slice("_all", i, SLICE))).alias("_documents"))
    # few rules have many principals: these are dealt over several keys, to which the slices are copied
    n = int(grants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = slices.select("_rules", "_documents", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)).alias("_deal")).repartition(n, "_rules", "_deal")
    dealt = held.filter("_n > 0").select("principal_id", "over", "_rules", F.pmod(F.xxhash64("principal_id"), F.col("_deals")).alias("_deal")).repartition(n, "_rules", "_deal")
    pairs = slices.join(dealt.hint("merge"), ["_rules", "_deal"]).select("principal_id", F.explode("_documents").alias("document_id"), "over")
    return pairs.unionByName(own.join(held.select("principal_id", "over"), "principal_id").select("principal_id", "document_id", "over"))


def effective_reader_count(docs: DataFrame, users: DataFrame) -> DataFrame:
    """How many users may read each document: users are first counted per rule group, and groups per key that they open;
    a document adds up the counts of its keys, which no group opens twice."""
    members = resolve_ceiling(users).filter(~F.col("denied")).groupBy("mode", "ceiling", F.col("department_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    doors = group_keys(members).groupBy(F.col("mode").alias("_mode"), F.col("level").alias("_level"), F.col("ancestor").alias("_ancestor")).agg(F.sum("n").alias("n"))
    keyed = docs.select("document_id", F.explode_outer(reach_keys(F.col("mode"), F.col("visibility_level"), F.col("department_path"))).alias("k"))
    keyed = keyed.select("document_id", F.col("k.mode").alias("_mode"), F.col("k.level").alias("_level"), F.col("k.ancestor").alias("_ancestor"))
    return keyed.join(doors, ["_mode", "_level", "_ancestor"], "left").groupBy("document_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("readers"))


def visibility_level(label: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(label)) - 1).cast("int")


def visibility_label(level: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LEVELS]), level.cast("int"))


def resolve_permissions(grants: DataFrame, overrides: DataFrame) -> DataFrame:
    """Role grants and allowed overrides, without denied ones: a denial wins."""
    allowed = grants.select("user_id", "permission").union(overrides.filter("effect = 'allow'").select("user_id", "permission")).distinct()
    return allowed.join(overrides.filter("effect = 'deny'").select("user_id", "permission"), ["user_id", "permission"], "left_anti")


def propagate_acl(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks with the level and path of their document; changed marks those that differed (null-safe)."""
    d = docs.select("document_id", F.col("visibility_level").alias("new_level"), F.col("department_path").alias("new_path"))
    changed = ~(F.col("visibility_level").eqNullSafe(F.col("new_level")) & F.col("department_path").eqNullSafe(F.col("new_path")))
    joined = chunks.join(d, "document_id", "left").withColumn("changed", F.col("new_level").isNotNull() & changed)
    return joined.withColumns({"visibility_level": F.coalesce("new_level", "visibility_level"), "department_path": F.when(F.col("new_level").isNotNull(), F.col("new_path")).otherwise(F.col("department_path"))}).drop("new_level", "new_path")


def subtree(departments: DataFrame, root: str) -> DataFrame:
    return departments.filter(in_subtree(F.col("path"), F.lit(root)))
