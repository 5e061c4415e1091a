"""Grants over nested groups, directory trees, sessions: closures, unions with overrides, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

MAX_DEPTH = 10
ALL, NONE = "*", ""


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent", depth: int = MAX_DEPTH) -> DataFrame:
    """(node, ancestor, depth): every node with itself and those above it; cycles end at the depth bound.

    Only new pairs go on, so a cycle adds nothing after one round; the loop stops as soon as a round adds none. Each round is
    checkpointed, so that none computes those before it again.
    """
    e = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).filter("c IS NOT NULL AND p IS NOT NULL").distinct()
    e = cut(e)
    nodes = e.select("c").union(e.select("p")).distinct()
    found = nodes.select(F.col("c").alias("node"), F.col("c").alias("ancestor"), F.lit(0).alias("depth"))
    fresh = found
    for level in range(1, depth + 1):
        step = fresh.join(e, fresh.ancestor == e.c).select("node", F.col("p").alias("ancestor"), F.lit(level).alias("depth")).distinct()
        fresh = cut(step.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            break
        found = found.union(fresh)
    return found


def user_subjects(users: DataFrame, members: DataFrame, above: DataFrame) -> DataFrame:
    """(user_id, subject_type, subject_key): the user, its groups and all groups above them."""
    own = users.select(F.col("id").alias("user_id"), F.lit("user").alias("subject_type"), F.col("id").cast("string").alias("subject_key"))
    groups = members.join(above, members.group_id == above.node).select("user_id", F.lit("group").alias("subject_type"), F.col("ancestor").cast("string").alias("subject_key"))
    return own.union(groups).distinct()


def effective_tools(subjects: DataFrame, subject_roles: DataFrame, role_perms: DataFrame, subject_perms: DataFrame) -> DataFrame:
    """(user_id, tools): auditors none, administrators all, others the union of role and direct grants."""
    key = ["subject_type", "subject_key"]
    roles = subjects.join(subject_roles, key).select("user_id", "role_id").distinct()
    flags = roles.groupBy("user_id").agg(F.bool_or(F.col("role_id") == "auditor").alias("auditor"), F.bool_or(F.col("role_id") == "admin").alias("admin"))
    grants = roles.join(role_perms, "role_id").select("user_id", "tool_id").union(subjects.join(subject_perms, key).select("user_id", "tool_id")).distinct()
    tools = grants.groupBy("user_id").agg(F.array_sort(F.collect_set("tool_id")).alias("tools"))
    everyone = subjects.select("user_id").distinct().join(flags, "user_id", "left").join(tools, "user_id", "left")
    empty = F.array().cast("array<string>")
    return everyone.select("user_id", F.when(F.coalesce("auditor", F.lit(False)), empty).when(F.coalesce("admin", F.lit(False)), F.array(F.lit(ALL))).otherwise(F.coalesce("tools", empty)).alias("tools"))


def provenance(subjects: DataFrame, subject_roles: DataFrame, role_perms: DataFrame, subject_perms: DataFrame) -> DataFrame:
    """(user_id, tool_id, reasons): why a user has a tool."""
    key = ["subject_type", "subject_key"]
    by_role = subjects.join(subject_roles, key).join(role_perms, "role_id").select("user_id", "tool_id", F.concat(F.lit("role:"), "role_id", F.lit(" via "), "subject_type").alias("reason"))
    direct = subjects.join(subject_perms, key).select("user_id", "tool_id", F.concat(F.lit("direct via "), "subject_type").alias("reason"))
    return by_role.union(direct).groupBy("user_id", "tool_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def members_and_roles(groups: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """Groups with sorted members and roles, empty arrays where there are none."""
    empty = F.array().cast("array<string>")
    m = members.groupBy("group_id").agg(F.array_sort(F.collect_list(F.col("user_id").cast("string"))).alias("members"))
    r = roles.filter("subject_type = 'group'").groupBy(F.col("subject_key").alias("_key")).agg(F.array_sort(F.collect_list("role_id")).alias("roles"))
    joined = groups.join(m, groups.id == m.group_id, "left").join(r, groups.id.cast("string") == r["_key"], "left")
    return joined.select(groups["*"], F.coalesce("members", empty).alias("members"), F.coalesce("roles", empty).alias("roles"))


def tree_order(nodes: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name", depth: int = MAX_DEPTH) -> DataFrame:
    """Nodes with depth and a path that sorts parents before their children; a cycle's nodes count as roots. Each level is
    checkpointed."""
    n = cut(nodes.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(name).alias("label")))
    known = n.select(F.col("k").alias("known"))
    roots = n.join(known, n.p == F.col("known"), "left_anti")
    level = roots.select("k", F.lit(0).alias("depth"), F.array("label").alias("path"))
    out = level
    for d in range(1, depth + 1):
        level = cut(n.join(level.select(F.col("k").alias("up"), "path"), F.col("p") == F.col("up")).select("k", F.lit(d).alias("depth"), F.concat("path", F.array("label")).alias("path")))
        if level.isEmpty():
            break
        out = out.union(level)
    lost = n.join(out.select(F.col("k").alias("seen")), n.k == F.col("seen"), "left_anti").select("k", F.lit(0).alias("depth"), F.array("label").alias("path"))
    return out.union(lost).withColumnRenamed("k", key)


# ---- directory names


def dn_parts(dn: Column) -> Column:
    """Parts of a distinguished name, cut at commas that aren't escaped."""
    return F.transform(F.split(dn, r"(?<!\\),"), lambda p: F.trim(p))


def dn_parent(dn: Column) -> Column:
    parts = dn_parts(dn)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts) - 1), ","))


def dn_normal(dn: Column) -> Column:
    return F.lower(F.array_join(F.transform(dn_parts(dn), lambda p: F.regexp_replace(p, r"\s*=\s*", "=")), ","))


def dn_value(dn: Column) -> Column:
    return F.regexp_extract(F.get(dn_parts(dn), F.lit(0)), "^[^=]*=(.*)$", 1)


def matched_tree(matches: DataFrame, dn: str = "dn") -> DataFrame:
    """(dn, parent_dn, depth, matched): matches and all above them, one node for each name; domain parts alone aren't nodes."""
    parts = dn_parts(F.lower(dn))
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts) - k + 1), ",").alias("dn"), (k == 1).alias("matched"), (F.size(parts) - k + 1).alias("depth")))
    nodes = matches.select(F.explode(chain).alias("x")).select("x.*").filter(~F.col("dn").rlike("^(dc=[^,]*)(,dc=[^,]*)*$"))
    return nodes.groupBy("dn").agg(F.bool_or("matched").alias("matched"), F.max("depth").cast("int").alias("depth")).withColumn("parent_dn", dn_parent(F.col("dn")))


# ---- sessions and accounts


def online(sessions: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Sessions that are valid and were seen lately."""
    return sessions.filter((F.col("expires_at") > now) & (F.coalesce("last_seen_at", "created_at") > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))


def online_users(sessions: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    return online(sessions, now, minutes).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("sessions"))


def expiring_days(expires: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(expires) - F.unix_timestamp(now)) / 86400)


def cleanup_allowed(candidates: int, enabled: int, share: float = 0.2) -> bool:
    """A clean-up stops if it would touch more than a share of the enabled accounts."""
    return candidates <= int(enabled * share)


def user_view(users: DataFrame, view: str, scanned: bool, now: Column, days: int = 14) -> DataFrame:
    """active, directory, missing, dir_disabled, pwd_expiring; nobody is missing before a full scan has run."""
    views = {
        "active": F.col("enabled"),
        "directory": F.col("source") == "directory",
        "missing": (F.col("source") == "directory") & F.col("missing_since").isNotNull() & F.lit(scanned),
        "dir_disabled": F.coalesce(F.col("dir_disabled"), F.lit(False)),
        "pwd_expiring": expiring_days(F.col("pwd_expires"), now).between(0, days),
    }
    return users.filter(F.coalesce(views[view], F.lit(False)))


def visible_cases(cases: DataFrame, user: str, is_admin: bool, deleted: bool = False, limit: int = 200) -> DataFrame:
    """The newest cases a user may see: own ones, or all for administrators; deleted ones only if asked for."""
    seen = cases if is_admin else cases.filter(F.col("owner") == user)
    if not deleted:
        seen = seen.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
    return seen.orderBy(F.desc("created_at"), "case_id").limit(limit)


def orphans(files: DataFrame, owners: DataFrame, key: str = "upload_id") -> DataFrame:
    """Files without an owner's record."""
    return files.join(owners.select(key).distinct(), key, "left_anti")


def session_owners(sessions: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Sessions with their users' columns; those of users that are gone are left out."""
    return sessions.join(users, key)


#: Roles that an import may not hand out.
BARRED_ROLES = ("admin", "auditor")


def import_role_perms(own: DataFrame, roles: DataFrame, perms: DataFrame) -> DataFrame:
    """(role_id, tool_id) after an import: the imported roles' grants are replaced, those of other roles stay. Imported grants
    of roles that the import doesn't define are left out; so are roles without an id."""
    named = roles.filter("role_id <> ''").select("role_id").distinct()
    stay, come = own.join(named, "role_id", "left_anti"), perms.join(named, "role_id", "left_semi")
    return stay.select("role_id", "tool_id").union(come.select("role_id", "tool_id")).distinct()


def import_unit_roles(own: DataFrame, imported: DataFrame) -> DataFrame:
    """(unit, role_id): own grants to units and the imported ones, but for roles that an import may not hand out."""
    return own.select("unit", "role_id").union(imported.filter(~F.col("role_id").isin(*BARRED_ROLES)).select("unit", "role_id")).distinct()


def find_accounts(users: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Accounts whose name or display name holds the text, whatever its case; the first ones by name."""
    held = F.lower(F.concat_ws(" ", "username", "display_name")).contains(text.strip().lower())
    return users.filter(held).orderBy("username").limit(limit)


def marks_of(marks: DataFrame, kinds: list[str] = (), authors: list[str] = (), unsigned: str = "(未署名)") -> DataFrame:
    """Marks of the given kinds and authors; blank authors go by a name of their own."""
    named = marks.withColumn("author", F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit(unsigned)))
    if kinds:
        named = named.filter(F.col("kind").isin(list(kinds)))
    return named.filter(F.col("author").isin(list(authors))) if authors else named


def into_groups(rows: DataFrame, by: str, order: str, key: str, width: int = 10_000) -> DataFrame:
    """(by, first, place, key): groups with the place at which they first appear, and their rows' keys numbered in order.

    ``order`` is a number; rows are numbered within stretches of ``width`` of it, and stretches by the counts before them, so
    that a group of all rows spreads over many tasks.
    """
    dealt = rows.select(by, order, key, F.floor(F.col(order) / width).alias("_part"))
    counts = dealt.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    w = Window.partitionBy(by).orderBy("_part")
    before = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.min("_first").over(w).alias("first"))
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order, key))
    placed = dealt.withColumn("_k", within).join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_of")))
    return placed.select(by, "first", (F.col("_k") + F.col("_before")).cast("long").alias("place"), key)


def oldest_days(rows: DataFrame, ts: str, now: Column) -> DataFrame:
    """Age in days of the oldest row."""
    return rows.agg(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.min(ts))) / 86400).alias("oldest_days"))
