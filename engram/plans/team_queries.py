"""Registered team queries (TM1-TM8, J5, C3, A7, M8) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import teams as T
from engram.plans.oracle_fixtures import AS_OF_SQL, with_fixtures
from engram.plans.registry import register
from engram.sources import fixtures as FX

_SLUG_OK = "(length(slug) BETWEEN 1 AND 100 AND regexp_full_match(slug, '[a-z0-9-]+'))"
_NAME_OK = "(length(name) BETWEEN 1 AND 100)"
_ADMIN_JOIN = """LEFT JOIN team_access_fx a
      ON a.team_id = c.team_id AND a.user_id = c.{actor} AND a.tenant_id = c.tenant_id"""


def _cmds(spark, sf_dir):
    return FX.team_cmds_fx(spark, sf_dir)


def _tables(spark, sf_dir):
    return FX.team_members_fx(spark, sf_dir), FX.teams_fx(spark, sf_dir)


_FIX = ("team_cmds_fx", "team_access_fx", "teams_fx", "team_members_fx", "tenants_fx")


@register("validate_team", with_fixtures(f"""
    SELECT cmd_id,
           CASE WHEN NOT coalesce({_NAME_OK}, false) THEN 'invalid name'
                WHEN NOT coalesce({_SLUG_OK}, false) THEN 'invalid slug'
                WHEN NOT (length(actor) >= 1) THEN 'invalid user_id'
                WHEN NOT (role IS NULL OR role IN ('admin', 'member', 'read_only')) THEN 'invalid role'
           END AS reason
    FROM team_cmds_fx""", "team_cmds_fx"))
def q_validate_team(spark, sf_dir):
    c = _cmds(spark, sf_dir).withColumnRenamed("actor", "user_id")
    return T.validate_team(c).select("cmd_id", "reason")


@register("create_teams", with_fixtures(f"""
    SELECT cmd_id, tenant_id, slug, status, CASE WHEN status = 201 THEN 'team_' || cmd_id END AS team_id
    FROM (
        SELECT *, CASE WHEN NOT valid THEN 400 WHEN least(nb, cap) >= cap THEN 402
                       WHEN NOT first_new THEN 409 ELSE 201 END AS status
        FROM (
            SELECT *, coalesce(sum(CASE WHEN first_new THEN 1 ELSE 0 END) OVER (
                        PARTITION BY tenant_id ORDER BY cmd_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
            FROM (
                SELECT *, valid AND NOT taken AND coalesce(sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (
                            PARTITION BY tenant_id, slug ORDER BY cmd_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first_new
                FROM (
                    SELECT c.cmd_id, c.tenant_id, c.slug,
                           coalesce({_NAME_OK.replace("name", "c.name")} AND {_SLUG_OK.replace("slug", "c.slug")}
                                    AND length(c.actor) >= 1, false) AS valid,
                           EXISTS (SELECT 1 FROM teams_fx t WHERE t.tenant_id = c.tenant_id AND t.slug = c.slug)
                               AS taken,
                           greatest(coalesce(tn.team_limit, 1)
                                    - (SELECT count(*) FROM teams_fx t WHERE t.tenant_id = c.tenant_id), 0) AS cap
                    FROM team_cmds_fx c LEFT JOIN tenants_fx tn ON tn.id = c.tenant_id))))""", *_FIX))
def q_create_teams(spark, sf_dir):
    c = _cmds(spark, sf_dir).withColumnRenamed("actor", "user_id")
    return T.create_teams(c, FX.teams_fx(spark, sf_dir), FX.tenants_fx(spark, sf_dir))


@register("add_members", with_fixtures(f"""
    SELECT cmd_id, team_id, user_id, status,
           CASE WHEN status = 201 THEN coalesce(role, 'member') END AS role
    FROM (
        SELECT *, CASE WHEN NOT valid THEN 400 WHEN NOT is_admin THEN 403
                       WHEN least(nb, cap) >= cap THEN 402 WHEN NOT first_new THEN 409 ELSE 201 END AS status
        FROM (
            SELECT *, coalesce(sum(CASE WHEN first_new THEN 1 ELSE 0 END) OVER (
                        PARTITION BY team_id ORDER BY cmd_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
            FROM (
                SELECT *, elig AND NOT member AND coalesce(sum(CASE WHEN elig THEN 1 ELSE 0 END) OVER (
                            PARTITION BY team_id, user_id ORDER BY cmd_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first_new
                FROM (
                    SELECT c.cmd_id, c.team_id, c.target AS user_id, c.role,
                           (length(c.target) >= 1 AND length(c.actor) >= 1
                            AND (c.role IS NULL OR c.role IN ('admin', 'member', 'read_only'))) AS valid,
                           coalesce(a.role = 'admin', false) AS is_admin,
                           (length(c.target) >= 1 AND length(c.actor) >= 1
                            AND (c.role IS NULL OR c.role IN ('admin', 'member', 'read_only'))
                            AND coalesce(a.role = 'admin', false)) AS elig,
                           EXISTS (SELECT 1 FROM team_members_fx m
                                   WHERE m.team_id = c.team_id AND m.user_id = c.target) AS member,
                           greatest(coalesce(tn.members_per_team_limit, 3)
                                    - (SELECT count(*) FROM team_members_fx m WHERE m.team_id = c.team_id), 0)
                               AS cap
                    FROM team_cmds_fx c {_ADMIN_JOIN.format(actor='actor')}
                    LEFT JOIN tenants_fx tn ON tn.id = c.tenant_id))))""", *_FIX))
def q_add_members(spark, sf_dir):
    members, teams = _tables(spark, sf_dir)
    c = _cmds(spark, sf_dir).select("cmd_id", "tenant_id", "team_id", F.col("target").alias("user_id"),
                                    "role", F.col("actor").alias("added_by"))
    return T.add_members(c, members, teams, FX.tenants_fx(spark, sf_dir))


_UPD_CMDS = """
    SELECT cmd_id, tenant_id, team_id, actor,
           CASE WHEN cmd_id % 3 = 0 THEN name END AS name,
           CASE WHEN cmd_id % 3 = 1 THEN slug END AS slug
    FROM team_cmds_fx"""


@register("update_teams", with_fixtures(f"""
    SELECT cmd_id, team_id, status,
           CASE WHEN status = 200 THEN coalesce(last_value(CASE WHEN status = 200 AND length(name) > 0 THEN name END
                   IGNORE NULLS) OVER (PARTITION BY team_id ORDER BY cmd_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), name0) END AS name,
           CASE WHEN status = 200 THEN coalesce(last_value(CASE WHEN status = 200 AND length(slug) > 0 THEN slug END
                   IGNORE NULLS) OVER (PARTITION BY team_id ORDER BY cmd_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), slug0) END AS slug
    FROM (
        SELECT c.*, t.name AS name0, t.slug AS slug0,
               CASE WHEN (c.name IS NOT NULL AND NOT (length(c.name) BETWEEN 1 AND 100))
                      OR (c.slug IS NOT NULL AND NOT (length(c.slug) BETWEEN 1 AND 100
                                                      AND regexp_full_match(c.slug, '[a-z0-9-]+'))) THEN 400
                    WHEN NOT coalesce(a.role = 'admin', false) THEN 403
                    WHEN NOT (coalesce(length(c.name) > 0, false) OR coalesce(length(c.slug) > 0, false)) THEN 400
                    WHEN t.tenant_id IS NULL OR t.tenant_id <> c.tenant_id THEN 404
                    ELSE 200 END AS status
        FROM upd c {_ADMIN_JOIN.format(actor='actor')}
        LEFT JOIN teams_fx t ON t.id = c.team_id)""", *_FIX, extra={"upd": _UPD_CMDS}))
def q_update_teams(spark, sf_dir):
    members, teams = _tables(spark, sf_dir)
    c = _cmds(spark, sf_dir).select(
        "cmd_id", "tenant_id", "team_id", F.col("actor").alias("user_id"),
        F.when(F.col("cmd_id") % 3 == 0, F.col("name")).alias("name"),
        F.when(F.col("cmd_id") % 3 == 1, F.col("slug")).alias("slug"))
    return T.update_teams(c, members, teams)


_RENAME = {
    "teams": """
        SELECT 'tm' || c_custkey AS id, 'w' || (c_custkey // 12) AS tenant_id, 'Team ' || c_custkey AS name,
               's' || (c_custkey % 12) AS slug FROM customer""",
    "cmds": """
        SELECT o_orderkey AS cmd_id, 'w' || (o_custkey // 12) AS tenant_id, 'tm' || o_custkey AS team_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Name ' || o_orderkey END AS name,
               CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'own-' || o_custkey
                    ELSE 's' || ((o_orderkey // 4) % 16) END END AS slug,
               o_orderkey % 19 > 0 AS is_admin FROM orders""",
    # all tenants step by step at once: the k-th slug command of each
    "steps": """
        SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY cmd_id) AS k FROM cmds WHERE is_admin AND slug IS NOT NULL""",
    "walk": """
        SELECT 0::BIGINT AS k, tenant_id, map_from_entries(list({'k': id, 'v': slug})) AS held, NULL::BIGINT AS cmd_id, true AS granted
        FROM teams GROUP BY tenant_id
        UNION ALL
        SELECT k, tenant_id, CASE WHEN free THEN map_concat(held, map([team_id], [slug])) ELSE held END, cmd_id, free
        FROM (SELECT s.k, s.tenant_id, w.held, s.cmd_id, s.team_id, s.slug,
                     w.held[s.team_id] = s.slug OR NOT list_contains(map_values(w.held), s.slug) AS free
              FROM walk w JOIN steps s ON s.tenant_id = w.tenant_id AND s.k = w.k + 1)""",
    "judged": """
        SELECT c.*, CASE WHEN NOT c.is_admin THEN 403 WHEN c.name IS NULL AND c.slug IS NULL THEN 400
                         WHEN NOT coalesce(w.granted, true) THEN 409 ELSE 200 END AS status
        FROM cmds c LEFT JOIN walk w ON w.cmd_id = c.cmd_id""",
}


@register("rename_teams", ("WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in _RENAME.items()) + """
    SELECT j.cmd_id, j.team_id, status,
           CASE WHEN status = 200 THEN coalesce(last_value(CASE WHEN status = 200 THEN j.name END IGNORE NULLS) OVER w, t.name) END AS name,
           CASE WHEN status = 200 THEN coalesce(last_value(CASE WHEN status = 200 THEN j.slug END IGNORE NULLS) OVER w, t.slug) END AS slug
    FROM judged j JOIN teams t ON t.id = j.team_id
    WINDOW w AS (PARTITION BY j.team_id ORDER BY j.cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_rename_teams(spark, sf_dir):
    """TM2 where teams of a tenant claim each other's slugs: 409 while another
    holds it, granted once a rename has freed it."""
    teams = FX.rename_teams_fx(spark, sf_dir)
    return T.update_teams(FX.rename_cmds_fx(spark, sf_dir), FX.rename_admins_fx(spark, sf_dir), teams)


@register("delete_teams", with_fixtures(f"""
    SELECT cmd_id, team_id,
           CASE WHEN NOT is_admin THEN 403
                WHEN coalesce(sum(CASE WHEN is_admin THEN 1 ELSE 0 END) OVER (
                     PARTITION BY team_id ORDER BY cmd_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 404
                ELSE 204 END AS status
    FROM (SELECT c.cmd_id, c.team_id, coalesce(a.role = 'admin', false) AS is_admin
          FROM team_cmds_fx c {_ADMIN_JOIN.format(actor='actor')})""", *_FIX))
def q_delete_teams(spark, sf_dir):
    members, teams = _tables(spark, sf_dir)
    c = _cmds(spark, sf_dir).select("cmd_id", "tenant_id", "team_id", F.col("actor").alias("user_id"))
    return T.delete_teams(c, members, teams)


@register("cascade_team", with_fixtures(f"""
    WITH_DELETED
    SELECT 'member' AS kind, m.id AS row_id, NULL AS team_id FROM team_members_fx m
    WHERE m.team_id NOT IN (SELECT team_id FROM gone)
    UNION ALL
    SELECT 'invitation', i.id, i.team_id FROM invitations_fx i WHERE i.team_id NOT IN (SELECT team_id FROM gone)
    UNION ALL
    SELECT 'memory', mm.id, CASE WHEN mm.team_id IN (SELECT team_id FROM gone) THEN NULL ELSE mm.team_id END
    FROM memories_fx mm""".replace("WITH_DELETED", ""),
    *_FIX, "invitations_fx", "memories_fx", extra={"gone": f"""
        SELECT DISTINCT c.team_id FROM team_cmds_fx c {_ADMIN_JOIN.format(actor='actor')}
        WHERE c.cmd_id % 97 = 0 AND coalesce(a.role = 'admin', false)"""}))
def q_cascade_team(spark, sf_dir):
    """M8: delete the teams that an admin's delete command (one in 97
    commands) names, then cascade to members, invitations and memories."""
    members, teams = _tables(spark, sf_dir)
    c = (_cmds(spark, sf_dir).filter(F.col("cmd_id") % 97 == 0)
         .select("cmd_id", "tenant_id", "team_id", F.col("actor").alias("user_id")))
    deleted = T.delete_teams(c, members, teams).filter(F.col("status") == 204)
    out = T.cascade_team_delete(deleted, members, FX.invitations_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir))
    return (out["team_members"].select(F.lit("member").alias("kind"), F.col("id").alias("row_id"),
                                       F.lit(None).cast("string").alias("team_id"))
            .unionByName(out["team_invitations"].select(F.lit("invitation").alias("kind"),
                                                        F.col("id").alias("row_id"), "team_id"))
            .unionByName(out["memories"].select(F.lit("memory").alias("kind"), F.col("id").alias("row_id"),
                                                "team_id")))


@register("change_roles", with_fixtures(f"""
    SELECT c.cmd_id, c.team_id, c.target AS user_id,
           CASE WHEN c.role IS NULL OR c.role NOT IN ('admin', 'member', 'read_only') THEN 400
                WHEN NOT coalesce(a.role = 'admin', false) THEN 403
                WHEN m.user_id IS NULL THEN 404 ELSE 200 END AS status,
           CASE WHEN c.role IN ('admin', 'member', 'read_only') AND coalesce(a.role = 'admin', false)
                     AND m.user_id IS NOT NULL THEN c.role END AS role
    FROM team_cmds_fx c {_ADMIN_JOIN.format(actor='actor')}
    LEFT JOIN team_members_fx m ON m.team_id = c.team_id AND m.user_id = c.target""", *_FIX))
def q_change_roles(spark, sf_dir):
    members, teams = _tables(spark, sf_dir)
    c = _cmds(spark, sf_dir).select("cmd_id", "tenant_id", "team_id", F.col("target").alias("user_id"),
                                    "role", F.col("actor").alias("changed_by"))
    return T.change_roles(c, members, teams)


@register("remove_members", with_fixtures(f"""
    SELECT cmd_id, team_id, user_id,
           CASE WHEN NOT allowed THEN 403
                WHEN NOT hit OR coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (
                     PARTITION BY team_id, user_id ORDER BY cmd_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 404
                ELSE 204 END AS status
    FROM (
        SELECT c.cmd_id, c.team_id, c.target AS user_id,
               (c.removed_by = c.target OR coalesce(a.role = 'admin', false)) AS allowed,
               (c.removed_by = c.target OR coalesce(a.role = 'admin', false)) AND m.user_id IS NOT NULL AS hit
        FROM (SELECT *, CASE WHEN cmd_id % 4 = 0 THEN target ELSE actor END AS removed_by FROM team_cmds_fx) c
        {_ADMIN_JOIN.format(actor='removed_by')}
        LEFT JOIN team_members_fx m ON m.team_id = c.team_id AND m.user_id = c.target)""", *_FIX))
def q_remove_members(spark, sf_dir):
    members, teams = _tables(spark, sf_dir)
    c = _cmds(spark, sf_dir).select(
        "cmd_id", "tenant_id", "team_id", F.col("target").alias("user_id"),
        F.when(F.col("cmd_id") % 4 == 0, F.col("target")).otherwise(F.col("actor")).alias("removed_by"))
    return T.remove_members(c, members, teams)


@register("invitations", with_fixtures(f"""
    SELECT cmd_id, team_id, status, CASE WHEN status = 201 THEN em END AS email,
           CASE WHEN status = 201 THEN coalesce(role, 'member') END AS role,
           CASE WHEN status = 201 THEN sha256(team_id || ':' || em || ':' || cmd_id) END AS token,
           CASE WHEN status = 201 THEN strftime({AS_OF_SQL} + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') END
               AS expires_at
    FROM (
        SELECT c.*, lower(trim(c.email)) AS em,
               CASE WHEN NOT (length(c.email) > 0 AND contains(c.email, '@') AND contains(c.email, '.'))
                      OR NOT (c.role IS NULL OR c.role IN ('admin', 'member', 'read_only'))
                      OR NOT length(c.actor) >= 1 THEN 400
                    WHEN NOT coalesce(a.role = 'admin', false) THEN 403 ELSE 201 END AS status
        FROM team_cmds_fx c {_ADMIN_JOIN.format(actor='actor')})""", *_FIX))
def q_invitations(spark, sf_dir):
    members, teams = _tables(spark, sf_dir)
    c = _cmds(spark, sf_dir).select("cmd_id", "tenant_id", "team_id", "email", "role",
                                    F.col("actor").alias("invited_by"))
    out = T.invite(c, members, teams, FX.as_of_col())
    return out.select("cmd_id", "team_id", "status", "email", "role", "token",
                      F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@register("accept_invites", with_fixtures(f"""
    SELECT cmd_id, token, status, reason,
           CASE WHEN status = 200 THEN team_id END AS team_id, CASE WHEN status = 200 THEN role END AS role,
           ins AS member_inserted, CASE WHEN ins THEN coalesce(email, inv_email) END AS member_email,
           CASE WHEN ins THEN inv_email END AS invited_by
    FROM (
        SELECT *, status = 200 AND NOT was_member AND coalesce(sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (
                    PARTITION BY team_id, user_id ORDER BY cmd_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ins
        FROM (
            SELECT *, CASE WHEN team_id IS NULL THEN 404
                           WHEN accepted_at IS NOT NULL OR earlier > 0 THEN 410
                           WHEN {AS_OF_SQL} > expires_at THEN 410 ELSE 200 END AS status,
                      CASE WHEN team_id IS NULL THEN 'invitation not found'
                           WHEN accepted_at IS NOT NULL OR earlier > 0 THEN 'invitation already accepted'
                           WHEN {AS_OF_SQL} > expires_at THEN 'invitation expired' END AS reason
            FROM (
                SELECT x.cmd_id, x.token, x.user_id, x.email, i.team_id, i.email AS inv_email, i.role,
                       i.expires_at, i.accepted_at,
                       EXISTS (SELECT 1 FROM team_members_fx m
                               WHERE m.team_id = i.team_id AND m.user_id = x.user_id) AS was_member,
                       coalesce(sum(CASE WHEN i.team_id IS NOT NULL AND i.accepted_at IS NULL
                                          AND NOT ({AS_OF_SQL} > i.expires_at) THEN 1 ELSE 0 END) OVER (
                           PARTITION BY x.token ORDER BY x.cmd_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
                FROM accepts_fx x LEFT JOIN invitations_fx i ON i.token = x.token)))""",
    "accepts_fx", "invitations_fx", "team_members_fx"))
def q_accept_invites(spark, sf_dir):
    return T.accept_invites(FX.accepts_fx(spark, sf_dir), FX.invitations_fx(spark, sf_dir),
                            FX.team_members_fx(spark, sf_dir), FX.as_of_col())


@register("team_detail", with_fixtures("""
    SELECT c.cmd_id AS request_id, c.team_id,
           CASE WHEN t.tenant_id = c.tenant_id THEN 200 ELSE 404 END AS status,
           CASE WHEN t.tenant_id = c.tenant_id THEN t.name END AS name,
           CASE WHEN t.tenant_id = c.tenant_id THEN t.slug END AS slug,
           CASE WHEN t.tenant_id = c.tenant_id THEN coalesce(
               (SELECT string_agg(m.user_id || ':' || m.role, ',' ORDER BY m.joined_at, m.user_id, m.role)
                FROM team_members_fx m WHERE m.team_id = c.team_id), '') END AS members
    FROM team_cmds_fx c LEFT JOIN teams_fx t ON t.id = c.team_id""", *_FIX))
def q_team_detail(spark, sf_dir):
    members, teams = _tables(spark, sf_dir)
    r = _cmds(spark, sf_dir).select(F.col("cmd_id").alias("request_id"), "tenant_id", "team_id")
    return T.team_detail(r, teams, members)


@register("team_quota", with_fixtures("""
    SELECT tn.id AS tenant_id, tn.team_limit, coalesce(t.n, 0) AS teams_used,
           greatest(tn.team_limit - coalesce(t.n, 0), 0) AS teams_remaining,
           tn.members_per_team_limit, coalesce(m.max_members, 0) AS largest_team
    FROM tenants_fx tn
    LEFT JOIN (SELECT tenant_id, count(*) AS n FROM teams_fx GROUP BY tenant_id) t ON t.tenant_id = tn.id
    LEFT JOIN (SELECT tt.tenant_id, max(c) AS max_members
               FROM teams_fx tt JOIN (SELECT team_id, count(*) AS c FROM team_members_fx GROUP BY team_id) x
                 ON x.team_id = tt.id GROUP BY tt.tenant_id) m ON m.tenant_id = tn.id""", *_FIX))
def q_team_quota(spark, sf_dir):
    """Team and member quota headroom per tenant."""
    members, teams = _tables(spark, sf_dir)
    tenants = FX.tenants_fx(spark, sf_dir)
    n = teams.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    per_team = members.groupBy("team_id").agg(F.count(F.lit(1)).alias("c"))
    biggest = (teams.join(per_team, teams["id"] == per_team["team_id"])
               .groupBy("tenant_id").agg(F.max("c").alias("max_members")))
    t = tenants.select(F.col("id").alias("tenant_id"), "team_limit", "members_per_team_limit")
    used = F.coalesce("n", F.lit(0)).cast("bigint")
    return (t.join(n, "tenant_id", "left").join(biggest, "tenant_id", "left")
            .select("tenant_id", "team_limit", used.alias("teams_used"),
                    F.greatest(F.col("team_limit") - used, F.lit(0)).alias("teams_remaining"),
                    "members_per_team_limit",
                    F.coalesce("max_members", F.lit(0)).cast("bigint").alias("largest_team")))
