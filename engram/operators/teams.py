"""Teams: create (TM1), update (TM2), delete (TM3) with cascade (M8), add
members (TM4), change roles (TM5), remove members (TM6), invite (TM7),
accept invitations (TM8), team detail (J5), validation (C3).

Batch rule: commands see memberships and roles as of the batch start;
within a batch, commands of one kind apply in ``cmd_id`` order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import scalars as S
from engram.operators.ingest import prior_count, running_last, running_sum
from engram.operators.retrieval import team_access

ROLES = ("admin", "member", "read_only")   # fixed: the role enum
SLUG_PATTERN = r"^[a-z0-9-]+\z"
INVITE_DAYS = 7


def _len_between(c: Column, lo: int, hi: int) -> Column:
    return c.isNotNull() & (F.length(c) >= lo) & (F.length(c) <= hi)


def valid_name(c) -> Column:
    return _len_between(S.col_(c), 1, 100)


def valid_slug(c) -> Column:
    c = S.col_(c)
    return _len_between(c, 1, 100) & c.rlike(SLUG_PATTERN)


def valid_role(c) -> Column:
    return S.col_(c).isNull() | S.col_(c).isin(*ROLES)


def validate_team(cmds: DataFrame) -> DataFrame:
    """Name 1..100; slug 1..100 and ^[a-z0-9-]+$; user_id >= 1; role enum."""
    reason = (F.when(~valid_name("name"), F.lit("invalid name"))
              .when(~valid_slug("slug"), F.lit("invalid slug"))
              .when(~_len_between(F.col("user_id"), 1, 1 << 30), F.lit("invalid user_id"))
              .when(~valid_role("role"), F.lit("invalid role")))
    return cmds.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def _capped_inserts(df: DataFrame, part: str, key_cols: list[str], eligible: Column, exists: Column,
                    cap: Column) -> DataFrame:
    """Closed form of 'insert in order until the cap; duplicates -> 409'.

    A row is first-seen-new when it is eligible, its key does not exist yet
    and no earlier eligible row has the same key.  Inserts before a row =
    least(cap, first-seen-new rows before it).  Status: cap reached -> 402,
    not first-seen-new -> 409, else 201."""
    d = df.withColumn("_elig", eligible)
    d = prior_count(d, [part, *key_cols], ["cmd_id"], F.col("_elig"), "_elig_before")
    d = d.withColumn("_first_new", F.col("_elig") & ~exists & (F.col("_elig_before") == 0)).drop("_elig_before")
    d = running_sum(d, part, ["cmd_id"], F.col("_first_new").cast("int"), "_new_before")
    d = d.withColumn("_cap", F.greatest(cap, F.lit(0)))
    done = F.least(F.col("_new_before"), F.col("_cap"))
    return (d.withColumn("inserts_before", done.cast("bigint"))
            .withColumn("status", F.when(done >= F.col("_cap"), F.lit(402))
                        .when(~F.col("_first_new"), F.lit(409)).otherwise(F.lit(201)))
            .drop("_elig", "_first_new", "_new_before", "_cap"))


def create_teams(cmds: DataFrame, teams: DataFrame, tenants: DataFrame) -> DataFrame:
    """TM1: cmds(cmd_id, tenant_id, name, slug, user_id[, email]).

    400 invalid; 402 when the tenant's team count reaches team_limit; 409
    duplicate slug in the tenant; else 201 (team + creator as admin)."""
    v = validate_team(cmds.withColumn("role", F.lit(None).cast("string")))
    existing = teams.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_have"))
    slugs = teams.select("tenant_id", "slug", F.lit(True).alias("_slug_taken")).dropDuplicates(
        ["tenant_id", "slug"])
    lim = tenants.select(F.col("id").alias("tenant_id"), "team_limit")
    d = (v.join(existing, "tenant_id", "left").join(lim, "tenant_id", "left")
         .join(slugs, ["tenant_id", "slug"], "left"))
    cap = F.coalesce("team_limit", F.lit(1)) - F.coalesce("_have", F.lit(0))
    out = _capped_inserts(d, "tenant_id", ["slug"], F.col("valid"), F.col("_slug_taken").isNotNull(), cap)
    status = F.when(~F.col("valid"), F.lit(400)).otherwise(F.col("status"))
    return out.select("cmd_id", "tenant_id", "slug", status.alias("status"),
                      F.when(status == 201, F.concat(F.lit("team_"), F.col("cmd_id"))).alias("team_id"))


def add_members(cmds: DataFrame, members: DataFrame, teams: DataFrame, tenants: DataFrame) -> DataFrame:
    """TM4: cmds(cmd_id, tenant_id, team_id, user_id, role, added_by[, email]).

    400 invalid; 403 unless added_by is an admin of the tenant's team; 402
    when the team's member count reaches members_per_team_limit; 409 when
    (team, user) exists; else 201 (default role member)."""
    valid = (_len_between(F.col("user_id"), 1, 1 << 30) & _len_between(F.col("added_by"), 1, 1 << 30)
             & valid_role("role"))
    a = team_access(cmds, members, teams, user="added_by", out="_by_role")
    have = members.groupBy("team_id").agg(F.count(F.lit(1)).alias("_have"))
    pairs = members.select("team_id", "user_id", F.lit(True).alias("_member")).dropDuplicates(
        ["team_id", "user_id"])
    lim = tenants.select(F.col("id").alias("tenant_id"), "members_per_team_limit")
    d = (a.withColumn("valid", valid).join(have, "team_id", "left").join(lim, "tenant_id", "left")
         .join(pairs, ["team_id", "user_id"], "left"))
    admin = F.col("_by_role") == "admin"
    cap = F.coalesce("members_per_team_limit", F.lit(3)) - F.coalesce("_have", F.lit(0))
    out = _capped_inserts(d, "team_id", ["user_id"], F.col("valid") & F.coalesce(admin, F.lit(False)),
                          F.col("_member").isNotNull(), cap)
    status = (F.when(~F.col("valid"), F.lit(400)).when(~F.coalesce(admin, F.lit(False)), F.lit(403))
              .otherwise(F.col("status")))
    return out.select("cmd_id", "team_id", "user_id", status.alias("status"),
                      F.when(status == 201, F.coalesce("role", F.lit("member"))).alias("role"))


def _admin_gate(cmds: DataFrame, members: DataFrame, teams: DataFrame, actor: str) -> DataFrame:
    return team_access(cmds, members, teams, user=actor, out="_actor_role").withColumn(
        "_is_admin", F.coalesce(F.col("_actor_role") == "admin", F.lit(False)))


def update_teams(cmds: DataFrame, members: DataFrame, teams: DataFrame) -> DataFrame:
    """TM2: cmds(cmd_id, tenant_id, team_id, user_id, name?, slug?).

    Schema errors (a given but invalid name/slug) -> 400; non-admin -> 403;
    nothing to update -> 400; team gone -> 404; a slug that another team of
    the tenant holds at that moment -> 409 (a rename frees the old slug for
    later commands); else 200 with the team as it is after this command (last
    non-empty value per field so far)."""
    from engram.operators.unique import claim_keys

    bad_field = ((F.col("name").isNotNull() & ~valid_name("name"))
                 | (F.col("slug").isNotNull() & ~valid_slug("slug")))
    g = _admin_gate(cmds, members, teams, "user_id")
    nothing = ~(F.coalesce(F.length("name") > 0, F.lit(False)) | F.coalesce(F.length("slug") > 0, F.lit(False)))
    t = teams.select(F.col("id").alias("team_id"), F.col("tenant_id").alias("_t_tenant"),
                     F.col("name").alias("_name0"), F.col("slug").alias("_slug0"))
    d = g.join(t, "team_id", "left")
    status = (F.when(bad_field, F.lit(400)).when(~F.col("_is_admin"), F.lit(403))
              .when(nothing, F.lit(400))
              .when(F.col("_t_tenant").isNull() | (F.col("_t_tenant") != F.col("tenant_id")), F.lit(404))
              .otherwise(F.lit(200)))
    d = d.withColumn("status", status)
    claims = d.filter((F.col("status") == 200) & (F.length("slug") > 0)).select(
        "cmd_id", F.col("tenant_id").alias("scope"), F.col("team_id").alias("owner"), F.col("slug").alias("key"))
    holders = teams.select(F.col("tenant_id").alias("scope"), F.col("id").alias("owner"), F.col("slug").alias("key"))
    d = d.join(claim_keys(claims, holders), "cmd_id", "left").withColumn(
        "status", F.when(~F.coalesce("granted", F.lit(True)), F.lit(409)).otherwise(F.col("status"))).drop("granted")
    ok = F.col("status") == 200
    d = running_last(d, ["team_id"], ["cmd_id"], {
        "_new_name": F.when(ok & (F.length("name") > 0), F.col("name")),
        "_new_slug": F.when(ok & (F.length("slug") > 0), F.col("slug"))})
    return d.select("cmd_id", "team_id", "status",
                    F.when(ok, F.coalesce(F.col("_new_name"), F.col("_name0"))).alias("name"),
                    F.when(ok, F.coalesce(F.col("_new_slug"), F.col("_slug0"))).alias("slug"))


def delete_teams(cmds: DataFrame, members: DataFrame, teams: DataFrame) -> DataFrame:
    """TM3: cmds(cmd_id, tenant_id, team_id, user_id): non-admin -> 403;
    the first admin delete of a team -> 204; later ones -> 404."""
    g = _admin_gate(cmds, members, teams, "user_id")
    g = prior_count(g, ["team_id"], ["cmd_id"], F.col("_is_admin"), "_earlier")
    earlier = F.col("_earlier")
    status = F.when(~F.col("_is_admin"), F.lit(403)).when(earlier > 0, F.lit(404)).otherwise(F.lit(204))
    return g.select("cmd_id", "team_id", status.alias("status"))


def cascade_team_delete(deleted: DataFrame, members: DataFrame, invitations: DataFrame,
                        memories: DataFrame) -> dict[str, DataFrame]:
    """M8 for teams: members and invitations of deleted teams go; memories
    keep their rows with team_id set to null and visibility left as is."""
    gone = deleted.select(F.col("team_id")).distinct()
    mem = (memories.join(gone.withColumn("_gone", F.lit(True)), "team_id", "left")
           .withColumn("team_id", F.when(F.col("_gone").isNull(), F.col("team_id"))).drop("_gone"))
    return {"team_members": members.join(gone, "team_id", "left_anti"),
            "team_invitations": invitations.join(gone, "team_id", "left_anti"),
            "memories": mem.select(*memories.columns)}


def change_roles(cmds: DataFrame, members: DataFrame, teams: DataFrame) -> DataFrame:
    """TM5: cmds(cmd_id, tenant_id, team_id, user_id, role, changed_by).
    400 bad role; 403 non-admin; 404 not a member; else 200 and the member's
    role after this command (the last successful change wins)."""
    g = _admin_gate(cmds, members, teams, "changed_by")
    m = members.select("team_id", "user_id", F.col("role").alias("_old_role"))
    d = g.join(m, ["team_id", "user_id"], "left")
    bad = F.col("role").isNull() | ~F.col("role").isin(*ROLES)
    status = (F.when(bad, F.lit(400)).when(~F.col("_is_admin"), F.lit(403))
              .when(F.col("_old_role").isNull(), F.lit(404)).otherwise(F.lit(200)))
    return d.select("cmd_id", "team_id", "user_id", status.alias("status"),
                    F.when(status == 200, F.col("role")).alias("role"))


def remove_members(cmds: DataFrame, members: DataFrame, teams: DataFrame) -> DataFrame:
    """TM6: cmds(cmd_id, tenant_id, team_id, user_id, removed_by).  Self
    removal skips the admin check (and the tenant check); others need an
    admin.  The first successful removal -> 204; missing -> 404."""
    g = _admin_gate(cmds, members, teams, "removed_by")
    m = members.select("team_id", "user_id", F.lit(True).alias("_is_member"))
    d = g.join(m, ["team_id", "user_id"], "left")
    allowed = (F.col("removed_by") == F.col("user_id")) | F.col("_is_admin")
    hit = allowed & F.col("_is_member").isNotNull()
    d = prior_count(d, ["team_id", "user_id"], ["cmd_id"], hit, "_earlier")
    earlier = F.col("_earlier")
    status = (F.when(~allowed, F.lit(403)).when(~hit | (earlier > 0), F.lit(404)).otherwise(F.lit(204)))
    return d.select("cmd_id", "team_id", "user_id", status.alias("status"))


def invite(cmds: DataFrame, members: DataFrame, teams: DataFrame, as_of: Column) -> DataFrame:
    """TM7: cmds(cmd_id, tenant_id, team_id, email, role, invited_by).
    400 bad email/role; 403 non-admin; else an invitation row (normalised
    email, default role member, expires as_of + 7 days).  The token is a
    digest of (team, email, cmd_id) so that a batch is reproducible."""
    from engram.operators.accounts import valid_email

    g = _admin_gate(cmds, members, teams, "invited_by")
    email = S.norm_email("email")
    bad = ~valid_email(F.col("email")) | ~valid_role("role") | ~_len_between(F.col("invited_by"), 1, 1 << 30)
    status = F.when(bad, F.lit(400)).when(~F.col("_is_admin"), F.lit(403)).otherwise(F.lit(201))
    ok = status == 201
    return g.select(
        "cmd_id", "team_id", status.alias("status"),
        F.when(ok, email).alias("email"),
        F.when(ok, F.coalesce("role", F.lit("member"))).alias("role"),
        F.when(ok, F.sha2(F.concat_ws(":", "team_id", email, F.col("cmd_id").cast("string")), 256))
        .alias("token"),
        F.when(ok, F.timestamp_add("DAY", F.lit(INVITE_DAYS), as_of)).alias("expires_at"),
        F.when(ok, as_of).alias("created_at"))


def accept_invites(accepts: DataFrame, invitations: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """TM8: accepts(cmd_id, token, user_id, email?).  404 unknown token;
    410 already accepted (before the batch or by an earlier accept); 410
    expired when as_of > expires_at; else 200 -- the invitation is marked
    and the member inserted unless (team, user) exists (still 200)."""
    inv = invitations.select("token", "team_id", F.col("email").alias("_inv_email"), "role",
                             "expires_at", "accepted_at")
    d = accepts.join(inv, "token", "left")
    live = F.col("team_id").isNotNull() & F.col("accepted_at").isNull() & ~(as_of > F.col("expires_at"))
    d = prior_count(d, ["token"], ["cmd_id"], live, "_earlier")
    earlier = F.col("_earlier")
    status = (F.when(F.col("team_id").isNull(), F.lit(404))
              .when(F.col("accepted_at").isNotNull() | (earlier > 0), F.lit(410))
              .when(as_of > F.col("expires_at"), F.lit(410)).otherwise(F.lit(200)))
    reason = (F.when(status == 404, F.lit("invitation not found"))
              .when(F.col("accepted_at").isNotNull() | (earlier > 0), F.lit("invitation already accepted"))
              .when(status == 410, F.lit("invitation expired")))
    d = d.withColumn("status", status).withColumn("reason", reason)
    existing = members.select("team_id", "user_id", F.lit(True).alias("_was_member"))
    d = d.join(existing, ["team_id", "user_id"], "left")
    # within the batch, (team, user) is inserted by its first successful accept
    d = prior_count(d, ["team_id", "user_id"], ["cmd_id"], F.col("status") == 200, "_prior")
    prior = F.col("_prior")
    inserted = (F.col("status") == 200) & F.col("_was_member").isNull() & (prior == 0)
    return d.select("cmd_id", "token", "status", "reason",
                    F.when(F.col("status") == 200, F.col("team_id")).alias("team_id"),
                    F.when(F.col("status") == 200, F.col("role")).alias("role"),
                    inserted.alias("member_inserted"),
                    F.when(inserted, F.coalesce(F.col("email"), F.col("_inv_email"))).alias("member_email"),
                    F.when(inserted, F.col("_inv_email")).alias("invited_by"))


def team_detail(requests: DataFrame, teams: DataFrame, members: DataFrame) -> DataFrame:
    """requests(request_id, tenant_id, team_id) -> the team (404 when it
    is not the tenant's) with its members ordered by joined_at."""
    t = teams.select(F.col("id").alias("team_id"), F.col("tenant_id").alias("_t_tenant"), "name", "slug")
    m = (members.groupBy("team_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("joined_at"), F.col("user_id"), F.col("role")))).alias("_m")))
    d = requests.join(t, "team_id", "left").join(m, "team_id", "left")
    found = F.col("_t_tenant").isNotNull() & (F.col("_t_tenant") == F.col("tenant_id"))
    return d.select("request_id", "team_id", F.when(found, F.lit(200)).otherwise(F.lit(404)).alias("status"),
                    F.when(found, F.col("name")).alias("name"), F.when(found, F.col("slug")).alias("slug"),
                    F.when(found, F.array_join(F.transform(F.coalesce(F.col("_m"), F.array()),
                                                           lambda x: F.concat_ws(":", x["user_id"], x["role"])),
                                               ",")).alias("members"))
