"""Retrieval: scoped vector search re-ranked by decay (R1), recency (R2),
prompt context (R3), listing (R4), plus the pieces they are made of.

Plan shape (R1): queries -> team gate (J2) -> scope-key join with the active
memories (one equi-join on tenant, namespace, scope kind, scope key) ->
cosine per pair -> per-query top-2L window (WindowGroupLimit, partial limit
before the shuffle) -> decay/blend -> second window over the same
partitioning -> top L.

Scope keys: every memory row emits ('u', user_id) and, when shared with its
team, ('t', team_id).  A query emits ('u', user) and, when it includes its
team, ('t', team).  A user-key match of an include-team query keeps only
rows without a team (F3); the two branches are disjoint, so the union of
the OR predicate becomes one equi-join and no key is as coarse as
(tenant, namespace).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import scalars as S
from engram.functions.vectors import cosine, norm
from engram.operators import near
from engram.session import stored

RESULT_COLUMNS = ["id", "fact", "importance", "decay_score", "similarity", "score",
                  "source", "namespace", "created_at"]
# Fixed value: the service's text for an empty context (``context_line`` has its line format).
NO_MEMORIES = "No relevant memories found."
DEFAULT_BROADCAST_ROWS = 20_000


# --------------------------------------------------------------------------- helpers

def active(memories: DataFrame) -> DataFrame:
    """rows not soft-deleted (valid_until IS NULL; never compared with now)."""
    return memories.filter(F.col("valid_until").isNull())


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it is proven to have at most ``max_rows``
    rows; otherwise leave the choice to AQE's runtime statistics.  (The
    query tables passed here are persisted by the caller, so the check does
    not recompute them.)"""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def team_access(df: DataFrame, members: DataFrame, teams: DataFrame, *, tenant="tenant_id",
                user="user_id", team="team_id", out="role") -> DataFrame:
    """Role of (team, user) when the team belongs to the tenant, else null."""
    access = (members.select(F.col("team_id").alias("_ta_team"), F.col("user_id").alias("_ta_user"),
                             F.col("role").alias("_ta_role"))
              .join(teams.select(F.col("id").alias("_ta_team"), F.col("tenant_id").alias("_ta_tenant")),
                    "_ta_team"))
    cond = ((F.col(team) == F.col("_ta_team")) & (F.col(user) == F.col("_ta_user"))
            & (F.col(tenant) == F.col("_ta_tenant")))
    return (df.join(access, cond, "left")
            .withColumnRenamed("_ta_role", out)
            .drop("_ta_team", "_ta_user", "_ta_tenant"))


def memory_scope_keys(memories: DataFrame, purpose: str = "read") -> DataFrame:
    """Attach (scope_kind, scope_key) rows: ('u', user_id) always and
    ('t', team_id) for team rows.  ``read`` requires visibility 'team' for
    the team key (F3); ``dedup`` does not (M1)."""
    team_ok = F.col("team_id").isNotNull()
    if purpose == "read":
        team_ok = team_ok & (F.col("visibility") == "team")
    keys = F.array_compact(F.array(
        F.struct(F.lit("u").alias("k"), F.col("user_id").alias("v")),
        F.when(team_ok, F.struct(F.lit("t").alias("k"), F.col("team_id").alias("v"))),
    ))
    return (memories.withColumn("_sk", F.explode(keys))
            .withColumn("scope_kind", F.col("_sk.k")).withColumn("scope_key", F.col("_sk.v"))
            .drop("_sk"))


def query_scope_keys(queries: DataFrame, include: Column) -> DataFrame:
    keys = F.array_compact(F.array(
        F.struct(F.lit("u").alias("k"), F.col("q_user_id").alias("v")),
        F.when(include, F.struct(F.lit("t").alias("k"), F.col("q_team_id").alias("v"))),
    ))
    return (queries.withColumn("_sk", F.explode(keys))
            .withColumn("q_scope_kind", F.col("_sk.k")).withColumn("q_scope_key", F.col("_sk.v"))
            .drop("_sk"))


def _prefixed(queries: DataFrame, cols: list[str]) -> DataFrame:
    return queries.select(*[F.col(c).alias(f"q_{c}") for c in cols if c in queries.columns],
                          *[c for c in queries.columns if c not in cols])


def gate_queries(queries: DataFrame, members: DataFrame | None, teams: DataFrame | None,
                 endpoint: str = "search") -> DataFrame:
    """Clamp the limit (P11), evaluate include_team (P12 semantics already
    boolean here) and the team gate (J2 -> 403).  Adds ``include``,
    ``lim`` and ``status`` (200 / 400 / 403)."""
    include = F.coalesce(F.col("include_team"), F.lit(False)) & F.col("team_id").isNotNull()
    q = queries.withColumn("include", include).withColumn("lim", S.clamp_limit(F.col("q_limit"), endpoint))
    if members is not None and teams is not None:
        q = team_access(q, members, teams, out="_role")
        denied = F.col("include") & F.col("_role").isNull()
    else:
        q = q.withColumn("_role", F.lit(None).cast("string"))
        denied = F.col("include")
    return (q.withColumn("status", F.when(F.col("lim").isNull(), F.lit(400))
                         .when(denied, F.lit(403)).otherwise(F.lit(200)))
            .drop("_role"))


def scoped_pairs(queries: DataFrame, memories: DataFrame, *, with_vector: bool,
                 apply_source: bool = True, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                 extra_keys: list[tuple[str, str]] | None = None, versioned: bool = False) -> DataFrame:
    """J3 + F1 + F2/F3 + F4: (query, memory) pairs in each query's read scope.

    ``queries`` must be gated (``include``, ``lim``, ``status``).  Only
    accepted queries take part.  Memory columns keep their names; query
    columns are prefixed ``q_``.  ``versioned`` memories have ``born`` and
    ``died`` (null: never), and a query sees those with born < at < died.
    """
    qcols = ["tenant_id", "user_id", "namespace", "team_id", "source", "vector"]
    q = _prefixed(queries.filter(F.col("status") == 200), qcols)
    if with_vector:
        q = q.withColumn("q_norm", norm("q_vector"))
    q = query_scope_keys(q, F.col("include"))
    mem_cols = ["id", "tenant_id", "user_id", "namespace", "team_id", "visibility",
                "importance", "created_at", "source"]
    if with_vector:
        mem_cols.append("embedding")
    mem_cols += [mc for _, mc in (extra_keys or [])] + (["born", "died"] if versioned else [])
    m = active(memories).select(*mem_cols)
    if with_vector:
        m = m.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn(
            "norm", norm("embedding"))
    m = memory_scope_keys(m, "read")
    q = broadcast_if_small(q, broadcast_rows) if broadcast_rows else q
    cond = ((F.col("q_tenant_id") == F.col("tenant_id")) & (F.col("q_namespace") == F.col("namespace"))
            & (F.col("q_scope_kind") == F.col("scope_kind"))
            & (F.col("q_scope_key") == F.col("scope_key")))
    for qc, mc in extra_keys or []:
        cond = cond & (F.col(qc) == F.col(mc))
    if versioned:
        cond = cond & (F.col("born") < F.col("at")) & (F.col("died").isNull() | (F.col("died") > F.col("at")))
    pairs = q.join(m, cond).drop("q_scope_kind", "q_scope_key")
    # through the user key an include-team query sees only rows without a team.
    pairs = pairs.filter(~(F.col("include") & (F.col("scope_kind") == "u") & F.col("team_id").isNotNull()))
    if apply_source:
        pairs = pairs.filter(F.col("q_source").isNull() | (F.col("q_source") == "")
                             | (F.col("source") == F.col("q_source")))
    if with_vector:
        pairs = pairs.withColumn("sim", cosine("q_vector", "embedding", "q_norm", "norm")).drop(
            "embedding", "q_vector")
    return pairs.drop("scope_kind", "scope_key")


def _max_limit(queries: DataFrame, cap: int) -> int:
    """The largest accepted limit of the batch (one scalar to the driver),
    so the ranked windows get a literal bound and become WindowGroupLimit."""
    v = queries.filter(F.col("status") == 200).agg(F.max("lim")).first()[0]
    return int(v) if v is not None else cap


def _rerank(cands: DataFrame, sim: Column, score: Column, limit_col: str = "lim",
            max_limit: int = 50) -> DataFrame:
    """Stable sort by rounded score desc (ties keep candidate order)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("cand_rank").asc())
    out = (cands.withColumn("similarity", sim).withColumn("score", score)
           .withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= F.lit(max_limit)))
    return out.filter(F.col("rank") <= F.col(limit_col))


def _with_facts(ranked: DataFrame, memories: DataFrame) -> DataFrame:
    """The facts of ranked rows: texts join the few kept rows, and never ride
    through the pair join and its windows."""
    return ranked.join(memories.select("id", "fact"), "id")


def _project(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """P5 (+ query id and rank), created_at as ISO-8601 milliseconds."""
    cols = ["query_id", F.col("rank").cast("bigint").alias("rank"), "id", "fact", "importance",
            "decay_score", "similarity", "score", "source", "namespace",
            S.iso_ms("created_at").alias("created_at")]
    return df.select(*cols, *(extra or []))


# --------------------------------------------------------------------------- R1

def topk_candidates(pairs: DataFrame, max_limit: int) -> DataFrame:
    """Top 2L per query by similarity (nulls last, id breaks ties)."""
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc_nulls_last(), F.col("id").asc())
    return (pairs.withColumn("cand_rank", F.row_number().over(w))
            .filter(F.col("cand_rank") <= F.lit(2 * max_limit))
            .filter(F.col("cand_rank") <= 2 * F.col("lim")))


def _scope_side(df: DataFrame, prefix: str, kind: Column, key: Column) -> list[Column]:
    return [F.col(f"{prefix}tenant_id").alias("s1"), F.col(f"{prefix}namespace").alias("s2"), kind.alias("s3"), key.alias("s4")]


def _with_norm(side: DataFrame) -> DataFrame:
    side = side.withColumn("norm", norm("vec"))
    return side.withColumn("_plain", near.plain(F.col("vec"), F.col("norm")))


def _living_sides(queries: DataFrame, memories: DataFrame, apply_source: bool, vectors: bool, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Accepted queries and active ``versioned`` memories keyed by read scope for blocked tiles:
    'u' a user's rows, 'o' those without a team, 't' a team's shared ones; a query that filters
    the source asks for its kind of scope and source.  With vectors both are stored, also with norm and
    ``_plain``, and a row's ``mark`` is its decay."""
    q = queries.filter((F.col("status") == 200) & F.col("lim").isNotNull())
    kinds = F.array_compact(F.array(
        F.struct(F.when(F.col("include"), F.lit("o")).otherwise(F.lit("u")).alias("k"), F.col("user_id").alias("v")),
        F.when(F.col("include"), F.struct(F.lit("t").alias("k"), F.col("team_id").alias("v")))))
    q = q.withColumn("_sk", F.explode(kinds))
    sourced = F.col("source").isNotNull() & (F.col("source") != "") if apply_source else F.lit(False)
    q_kind = F.when(sourced, F.concat(F.col("_sk.k"), F.lit("="), F.col("source"))).otherwise(F.col("_sk.k"))
    q_side = [F.col("query_id").alias("src"), F.col("at").cast("bigint").alias("at"), (2 * F.col("lim")).cast("int").alias("k"),
              *_scope_side(q, "", q_kind, F.col("_sk.v"))]
    asked = q.select(*q_side, *([F.col("vector").cast("array<double>").alias("vec")] if vectors else []))
    if vectors:
        asked = stored(_with_norm(asked))
    m = active(memories)
    kinds = F.array_compact(F.array(
        F.struct(F.lit("u").alias("k"), F.col("user_id").alias("v")),
        F.when(F.col("team_id").isNull(), F.struct(F.lit("o").alias("k"), F.col("user_id").alias("v"))),
        F.when(F.col("team_id").isNotNull() & (F.col("visibility") == "team"), F.struct(F.lit("t").alias("k"), F.col("team_id").alias("v")))))
    m = m.withColumn("_sk", F.explode(kinds))
    forms = F.array(F.col("_sk.k"), F.concat(F.col("_sk.k"), F.lit("="), F.col("source"))) if apply_source else F.array(F.col("_sk.k"))
    m = m.withColumn("_form", F.explode(F.array_compact(forms)))
    wide = ([F.col("embedding").cast("array<double>").alias("vec"), S.decay("created_at", "importance", as_of).alias("mark")] if vectors
            else ["created_at"])
    rows = m.select(F.col("id").alias("dst"), "born", "died", *_scope_side(m, "", F.col("_form"), F.col("_sk.v")), *wide)
    # no row is kept for a kind of scope that no query asks for
    rows = rows.join(stored(asked.select("s3").distinct()), "s3", "left_semi")
    return asked, stored(_with_norm(rows)) if vectors else rows


def _ranked_living(queries: DataFrame, memories: DataFrame, found: DataFrame) -> DataFrame:
    """(query, memory) pairs with what ranking needs of both."""
    m = active(memories).select("id", "importance", "created_at", "source", "namespace")
    return found.join(m, "id").join(queries.select("query_id", "lim"), "query_id")


def _nearest_living(queries: DataFrame, memories: DataFrame, as_of, apply_source: bool) -> tuple[DataFrame, DataFrame]:
    """(src, k, found): the candidates of ``versioned`` memories by similarity, an array of (dst, sim,
    mark) for each query, ranked like W2; mark is the row's decay.  They come from blocked products;
    queries and rows of odd vectors (without a direction, or of extreme norm) meet pair by pair.
    And (id) of the memories in a scope that some query asks for."""
    asked, rows = _living_sides(queries, memories, apply_source, True, as_of)
    plain_q, plain_r = asked.filter("_plain"), rows.filter("_plain")
    odd_q, odd_r = asked.filter("not _plain"), rows.filter("not _plain")
    scope = ["s1", "s2", "s3", "s4"]
    pairs = []  # of queries whose candidates are not all found together
    if not odd_r.isEmpty():
        there = stored(odd_r.select(*scope).distinct())
        pairs += [d for d in near.nearest(plain_q.join(there, scope, "left_semi"), plain_r) if d is not None]
        plain_q = plain_q.join(there, scope, "left_anti")
    whole, cut = near.nearest(plain_q, plain_r)
    pairs = [d.select("src", "k", F.inline("found")) for d in (*pairs, *([] if cut is None else [cut]))]
    for q, r in ((odd_q, rows), (asked.filter("_plain"), odd_r)):
        if not q.isEmpty() and not r.isEmpty():
            met = q.select("src", "at", "k", *scope, F.col("vec").alias("_v"), F.col("norm").alias("_n")).join(r, scope)
            met = met.filter("(born is null or born < at) and (died is null or died > at)")
            pairs.append(met.select("src", "k", "dst", cosine("_v", "vec", "_n", "norm").alias("sim"), "mark"))
    if not pairs:
        return whole, rows.select(F.col("dst").alias("id"))
    every = functools.reduce(DataFrame.unionByName, pairs)
    w = Window.partitionBy("src").orderBy(F.col("sim").desc_nulls_last(), F.col("dst").asc())
    most = 2 * S.LIMITS["search"][1]
    firsts = every.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.lit(most)).filter("place <= k")
    # at most 2L rows a query: a bounded collect
    joined = firsts.groupBy("src").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("place", "dst", "sim", "mark"))).alias("found"))
    joined = joined.withColumn("found", F.transform("found", lambda x: F.struct(x["dst"], x["sim"], x["mark"])))
    return whole.unionByName(joined), rows.select(F.col("dst").alias("id"))


def _search_living(queries: DataFrame, memories: DataFrame, as_of, apply_source: bool) -> DataFrame:
    """R1 over ``versioned`` memories: a query's candidates are ranked where they were found, so
    that no more than its results are shuffled, and those without what the memory itself can tell."""
    found, asked_for = _nearest_living(queries, memories, as_of, apply_source)
    by_score = F.transform("found", lambda x, i: F.struct(
        S.round4(S.blend(x["sim"], x["mark"])).alias("score"), (-i).alias("place"), x["dst"].alias("id"), x["sim"].alias("sim")))
    # Descending, so nulls last and ties in candidate order
    kept = F.slice(F.sort_array(by_score, asc=False), F.lit(1), F.floor(F.col("k") / 2).cast("int"))
    ranked = found.select(F.col("src").alias("query_id"), F.posexplode(kept).alias("pos", "hit"))
    ranked = ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.sim").alias("sim"))
    told = active(memories).select("id", "fact", "importance", "created_at", "source", "namespace").join(asked_for, "id", "left_semi")
    return ranked.join(told, "id")


def _newest_living(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """The candidates of ``versioned`` memories by recency."""
    asked, rows = _living_sides(queries, memories, False, False)
    age = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(created_at as timestamp_ntz))")
    rows = rows.withColumn("newness", F.coalesce(age, F.lit(-(1 << 63)).cast("bigint"))).drop("created_at")
    return near.newest(asked, rows).select(F.col("src").alias("query_id"), F.col("dst").alias("id"))


def search(queries: DataFrame, memories: DataFrame, as_of, members: DataFrame | None = None,
           teams: DataFrame | None = None, *, max_limit: int | None = None,
           apply_source: bool = True, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
           gated: bool = False, keep_raw: bool = False, versioned: bool = False) -> DataFrame:
    """queries(query_id, tenant_id, user_id, namespace, vector, q_limit,
    source, team_id, include_team) -> ranked MemoryResult rows per query.
    ``keep_raw`` adds the unrounded similarity (what M7 stores)."""
    dec = S.decay("created_at", "importance", as_of)
    if versioned:
        q = queries if gated else gate_queries(queries, members, teams, "search")
        ranked = _search_living(q, memories, as_of, apply_source).withColumn("_decay", dec)
        ranked = ranked.select("*", S.round4("_decay").alias("decay_score"), S.round4("sim").alias("similarity"),
                               S.round4(S.blend("sim", "_decay")).alias("score"))
        return _project(ranked, [F.col("sim").alias("raw_similarity")] if keep_raw else None)
    q = queries if gated else gate_queries(queries, members, teams, "search").persist()
    if max_limit is None:
        max_limit = _max_limit(q, 50)
    pairs = scoped_pairs(q, memories, with_vector=True, apply_source=apply_source, broadcast_rows=broadcast_rows)
    cands = topk_candidates(pairs, max_limit)
    cands = cands.withColumn("_decay", dec).withColumn("decay_score", S.round4("_decay"))
    ranked = _rerank(cands, S.round4("sim"), S.round4(S.blend("sim", "_decay")), max_limit=max_limit)
    return _project(_with_facts(ranked, memories), [F.col("sim").alias("raw_similarity")] if keep_raw else None)


# --------------------------------------------------------------------------- R2

def newest_of_scopes(memories: DataFrame, max_limit: int) -> DataFrame:
    """The active rows that a recency query can return: the newest ``2 * max_limit`` of a user,
    of a user's rows without a team, and of a team's shared ones.  Queries of a scope all
    want the same rows, so ranking them once spares a pair for every query and row."""
    keep = F.lit(2 * max_limit)
    cols = ["id", "tenant_id", "user_id", "namespace", "team_id", "visibility", "importance", "created_at", "source"]
    m = active(memories).select(*cols)
    newest = [F.col("created_at").desc(), F.col("id").asc()]

    def first(df: DataFrame, *scope: str) -> DataFrame:
        w = Window.partitionBy("tenant_id", "namespace", *scope).orderBy(*newest)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")

    every = first(m, "user_id").unionByName(first(m.filter("team_id is null"), "user_id")).unionByName(
        first(m.filter("visibility = 'team' and team_id is not null"), "team_id"))
    return every.dropDuplicates(["id"]).withColumn("valid_until", F.lit(None).cast("timestamp_ntz"))


def recent(queries: DataFrame, memories: DataFrame, as_of, members: DataFrame | None = None,
           teams: DataFrame | None = None, *, max_limit: int | None = None,
           endpoint: str = "context", broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
           gated: bool = False, versioned: bool = False) -> DataFrame:
    """R2: newest 2L rows, re-ranked by rounded decay; similarity 1, score =
    decay.  Never reads the embedding column."""
    q = queries if gated else gate_queries(queries, members, teams, endpoint).persist()
    if max_limit is None:
        max_limit = _max_limit(q, 20)
    if versioned:
        pairs = _ranked_living(q, memories, _newest_living(q, memories))
    else:
        pairs = scoped_pairs(q, newest_of_scopes(memories, max_limit), with_vector=False, apply_source=False, broadcast_rows=broadcast_rows)
    w = Window.partitionBy("query_id").orderBy(F.col("created_at").desc(), F.col("id").asc())
    cands = (pairs.withColumn("cand_rank", F.row_number().over(w))
             .filter(F.col("cand_rank") <= F.lit(2 * max_limit))
             .filter(F.col("cand_rank") <= 2 * F.col("lim")))
    cands = cands.withColumn("decay_score", S.round4(S.decay("created_at", "importance", as_of)))
    ranked = _rerank(cands, F.lit(1.0), F.col("decay_score"), max_limit=max_limit)
    return _project(_with_facts(ranked, memories))


# --------------------------------------------------------------------------- R3

def context_line(rank, importance, decay_score, source, fact) -> Column:
    return F.format_string("[%s] (importance: %s, decay: %s, source: %s) %s",
                           rank.cast("string"), S.js_number(importance, 10),
                           S.js_number(decay_score, 4), source, fact)


def context(queries: DataFrame, memories: DataFrame, as_of, members: DataFrame | None = None,
            teams: DataFrame | None = None, *, max_limit: int | None = None,
            broadcast_rows: int = DEFAULT_BROADCAST_ROWS, versioned: bool = False) -> DataFrame:
    """Search when the query has a vector (source filter never applied),
    else recent; results joined into numbered lines (A9).  One row per
    accepted query: query_id, n_memories, context."""
    q = gate_queries(queries, members, teams, "context").persist()
    if max_limit is None:
        max_limit = _max_limit(q, 20)
    with_vec = q.filter(F.col("vector").isNotNull())
    without = q.filter(F.col("vector").isNull())
    res = (search(with_vec, memories, as_of, max_limit=max_limit, apply_source=False,
                  broadcast_rows=broadcast_rows, gated=True, versioned=versioned)
           .unionByName(recent(without, memories, as_of, max_limit=max_limit,
                               broadcast_rows=broadcast_rows, gated=True, versioned=versioned)))
    lines = res.select("query_id", F.struct(
        F.col("rank"), context_line(F.col("rank"), F.col("importance"), F.col("decay_score"),
                                    F.col("source"), F.col("fact")).alias("line")).alias("r"))
    # At most L <= 20 lines per query: a bounded collect.
    agg = lines.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_memories"),
        F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")
        .alias("context"))
    accepted = q.filter(F.col("status") == 200).select("query_id")
    return (accepted.join(agg, "query_id", "left")
            .select("query_id", F.coalesce("n_memories", F.lit(0)).cast("bigint").alias("n_memories"),
                    F.coalesce("context", F.lit(NO_MEMORIES)).alias("context")))


# --------------------------------------------------------------------------- R4

def list_memories(queries: DataFrame, memories: DataFrame, *, max_limit: int | None = None,
                  broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """R4 (F5 + W5): queries(query_id, tenant_id, user_id, namespace,
    team_id, visibility, q_limit, q_offset).  A team_id alone switches to the
    team form -- no flag, no membership check.  created_at desc, id breaks
    ties; LIMIT/OFFSET per query."""
    q = (queries.withColumn("include", F.col("team_id").isNotNull())
         .withColumn("lim", S.clamp_limit(F.col("q_limit"), "list"))
         .withColumn("off", F.coalesce(F.col("q_offset"), F.lit(0)))
         .withColumn("status", F.when(F.col("lim").isNull() | (F.col("off") < 0), F.lit(400))
                     .otherwise(F.lit(200)))
         .withColumnRenamed("visibility", "vis_filter"))
    if max_limit is None:
        max_limit = _max_limit(q, 100)
    pairs = scoped_pairs(q.withColumn("source", F.lit(None).cast("string")), memories,
                         with_vector=False, apply_source=False, broadcast_rows=broadcast_rows)
    pairs = pairs.filter(F.col("vis_filter").isNull() | (F.col("visibility") == F.col("vis_filter")))
    w = Window.partitionBy("query_id").orderBy(F.col("created_at").desc(), F.col("id").asc())
    ranked = pairs.withColumn("pos", F.row_number().over(w))
    ranked = ranked.filter((F.col("pos") > F.col("off")) & (F.col("pos") <= F.col("off") + F.col("lim")))
    ranked = _with_facts(ranked, memories)
    return ranked.select("query_id", (F.col("pos") - F.col("off")).cast("bigint").alias("rank"),
                         "id", "fact", "visibility", "team_id", "importance", "source", "namespace",
                         S.iso_ms("created_at").alias("created_at"))
