"""Graph operators over node and edge tables: hops, existence, first matches, bounded paths, and what a user may see.

Edge tables have ``src`` and ``dst``. Joins are left to Spark, which broadcasts a side only by its measured size and splits skewed
ones; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outbound(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges with the node that each leads to."""
    return edges.join(nodes, edges.dst == nodes[key])


def inbound(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges with the node that each comes from."""
    return edges.join(nodes, edges.src == nodes[key])


def both_ends(edges: DataFrame, nodes: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Edges whose two ends agree on the ``same`` columns; an end that is missing drops the edge."""
    a = nodes.select(F.col(key).alias("src"), *[F.col(c).alias(f"src_{c}") for c in same])
    b = nodes.select(F.col(key).alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in same])
    got = edges.join(a, "src").join(b, "dst")
    for c in same:
        got = got.where(F.col(f"src_{c}") == F.col(f"dst_{c}"))
    return got


def first_match(left: DataFrame, right: DataFrame, on: str, order: str, columns: list[str]) -> DataFrame:
    """Left rows with at most one right row: the one of the smallest ``order``."""
    best = right.groupBy(on).agg(F.min_by(F.struct(*columns), order).alias("_best"))
    return left.join(best, on, "left").select(*[left[c] for c in left.columns], *[F.col(f"_best.{c}").alias(c) for c in columns])


def all_matches(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Left rows with each of their right rows, or one row of nulls: the uncapped form of ``first_match``."""
    return left.join(right.select(on, *columns), on, "left")


def first_inner(left: DataFrame, right: DataFrame, on: str, order: str, columns: list[str]) -> DataFrame:
    """Left rows that have a right row, with the one of the smallest ``order``."""
    best = right.groupBy(on).agg(F.min_by(F.struct(*columns), order).alias("_best"))
    return left.join(best, on).select(*[left[c] for c in left.columns], *[F.col(f"_best.{c}").alias(c) for c in columns])


def with_flag(left: DataFrame, right: DataFrame, on: str, name: str) -> DataFrame:
    """Left rows and whether any right row has their key."""
    keys = right.select(on).distinct().withColumn(name, F.lit(True))
    return left.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def having(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_semi")


def lacking(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "left_anti")


def ancestors(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """``node, at, hops``: each start node and what lies 0 to ``depth`` hops behind its outgoing edges. A node that is on
    the way already isn't entered again, so cycles end."""
    step = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    level = start.select(F.col(start.columns[0]).alias("node")).distinct().select("node", F.col("node").alias("at"), F.lit(0).alias("hops"), F.array("node").alias("way"))
    out = level
    for n in range(1, depth + 1):
        level = level.join(step, level["at"] == F.col("_src")).where(~F.array_contains("way", F.col("_dst")))
        level = level.select("node", F.col("_dst").alias("at"), F.lit(n).alias("hops"), F.concat("way", F.array("_dst")).alias("way"))
        out = out.union(level)
    return out.select("node", "at", "hops")


def paths(edges: DataFrame, nodes: DataFrame, key: str, name: str, depth: int = 5, separator: str = "/") -> DataFrame:
    """``node, path``: the names from the farthest ancestor down to the node; null and empty names are left out."""
    way = ancestors(edges, nodes.select(key), depth).join(nodes.select(F.col(key).alias("at"), F.col(name).alias("_name")), "at")
    way = way.where("_name is not null and _name <> ''")
    return way.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hops", "_name")), asc=False), lambda x: x["_name"]), separator).alias("path"))


def descendants(edges: DataFrame, roots: DataFrame, depth: int = -1, most: int = 100) -> DataFrame:
    """``node, hops``: the roots and all below them, each at its smallest depth; edges lead from child to parent. A depth of -1 means
    as deep as it goes, at most ``most``.

    Each level is one join of the last level's nodes; the driver only asks whether any is left.
    """
    limit = most if depth < 0 else min(depth, most)
    step = edges.select(F.col("src").alias("_child"), F.col("dst").alias("_parent"))
    seen = roots.select(F.col(roots.columns[0]).alias("node")).distinct().withColumn("hops", F.lit(0))
    level, held = seen, []
    for n in range(1, limit + 1):
        found = step.join(level, step["_parent"] == level["node"]).select(F.col("_child").alias("node")).distinct()
        level = found.join(seen, "node", "left_anti").withColumn("hops", F.lit(n)).persist()
        held.append(level)
        if level.isEmpty():
            break
        seen = seen.union(level)
    if depth >= 0:
        # a bounded walk is planned as a whole; only the emptiness tests needed the levels
        for x in held:
            x.unpersist()
    return seen


def within(records: DataFrame, group: str, edges: DataFrame, roots: DataFrame, depth: int = -1) -> DataFrame:
    """Records of the root groups and of all groups below them."""
    below = descendants(edges, roots, depth).select(F.col("node").alias("_group"))
    return records.join(below, records[group] == F.col("_group"), "left_semi")


def principals(user: Column | str, members: DataFrame, depth: int = 3) -> DataFrame:
    """``principal``: the user, and what they belong to over at most ``depth`` memberships (group, team, role, organisation)."""
    step = members.select(F.col("member").alias("_m"), "principal")
    level = members.where(F.col("member") == user).select("principal").distinct()
    out = level.union(members.sparkSession.range(1).select(F.lit(user).alias("principal").cast(dict(members.dtypes)["principal"])))
    for _ in range(1, depth):
        level = level.select(F.col("principal").alias("_p")).join(step, F.col("_p") == F.col("_m")).select("principal").distinct()
        out = out.union(level)
    return out.distinct()


def accessible(user: Column | str, grants: DataFrame, members: DataFrame, inherits: DataFrame, records: DataFrame, nested: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """``virtual_id, record_id``: the smallest record of each virtual id that a user may see.

    ``grants`` (principal, target): rights of users, groups, teams, roles, organisations or apps on records or record groups.
    ``members`` (member, principal): what users, and groups in turn, belong to. ``inherits`` (record, target): records that take over their group's rights.
    ``nested`` (src, dst): record groups below others, to which rights on the upper one go down. Ways: own or membership grants, on the record,
    on its group or on a group above it.
    """
    who = principals(user, members, depth)
    targets = grants.join(who, "principal", "left_semi").select("target").distinct()
    if nested is not None:
        targets = descendants(nested, targets, depth).select(F.col("node").alias("target"))
    direct = targets.select(F.col("target").alias("record_key"))
    inherited = inherits.join(targets, "target", "left_semi").select(F.col("record").alias("record_key"))
    seen = direct.union(inherited).distinct()
    return records.join(seen, records["record_key"] == seen["record_key"], "left_semi").groupBy("virtual_id").agg(F.min("record_id").alias("record_id"))


def resolve_principals(permissions: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Permission rows with the node they stand for: users by ``email``, groups by ``external_id`` within a connector; rows without a
    match are left out."""
    base = permissions.columns
    u = permissions.where("kind = 'USER'").join(users.select(F.lower("email").alias("_m"), F.col("user_id").alias("principal")), F.lower("email") == F.col("_m")).select(*base, "principal")
    g = groups.select(F.col("external_id").alias("_x"), F.col("connector_id").alias("_c"), F.col("group_id").alias("principal"))
    p = permissions.where("kind = 'GROUP'")
    got = p.join(g, (p.external_id == F.col("_x")) & (p.connector_id == F.col("_c"))).select(*base, "principal")
    return u.unionByName(got)


def edges_by_external_ids(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst`` from pairs of external ids (``child, parent``); both ends must exist."""
    a = nodes.select(F.col("external_id").alias("child"), F.col("node_id").alias("src"))
    b = nodes.select(F.col("external_id").alias("parent"), F.col("node_id").alias("dst"))
    return pairs.join(a, "child").join(b, "parent").select("src", "dst").distinct()


def expand_ranges(groups: DataFrame, ranges: str) -> DataFrame:
    """Rows for each index in inclusive ranges ``array<struct<start,end>>``; a range that ends before it starts has none."""
    one = groups.withColumn("_r", F.explode(ranges)).where("_r.end >= _r.start")
    return one.withColumn("index", F.explode(F.sequence(F.col("_r.start"), F.col("_r.end")))).drop("_r", ranges)


def overlapping(left: DataFrame, right: DataFrame, on: str, width: int | None = None) -> DataFrame:
    """Pairs within one key whose half-open spans ``start``, ``end`` and ``s_start``, ``s_end`` overlap. With ``width`` spans are dealt over buckets of
    time, so that a key of many spans is many groups and only neighbours meet; a pair comes from the bucket where the later of both starts."""
    if not width:
        return left.join(right, on).where("start < s_end and end > s_start")

    def dealt(df, a, z):
        spans = df.where(F.col(a) < F.col(z))
        return spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(z) - 1) / width))))

    got = dealt(left, "start", "end").join(dealt(right, "s_start", "s_end"), [on, "_bucket"]).where("start < s_end and end > s_start")
    return got.where(F.floor(F.greatest("start", "s_start") / width) == F.col("_bucket")).drop("_bucket")


def fetched(wanted: DataFrame, hits: DataFrame, records: DataFrame, blobs: DataFrame) -> DataFrame:
    """``record_id, source, content`` for each wanted record: of the hits at hand, else of the stored content (``virtual_id, content``) of a completed record, else
    none, which ``source`` calls unavailable."""
    h = hits.select(F.col("record_id").alias("_h"), F.col("content").alias("_hc"))
    r = records.where("status = 'COMPLETED'").select(F.col("record_id").alias("_r"), "virtual_id")
    b = blobs.select("virtual_id", F.col("content").alias("_bc"))
    got = wanted.select("record_id").distinct().join(h, F.col("record_id") == F.col("_h"), "left").join(r.join(b, "virtual_id"), F.col("record_id") == F.col("_r"), "left")
    source = F.when(F.col("_h").isNotNull(), "hit").when(F.col("_r").isNotNull(), "stored").otherwise("unavailable")
    return got.select("record_id", source.alias("source"), F.when(F.col("_h").isNotNull(), F.col("_hc")).otherwise(F.col("_bc")).alias("content"))
