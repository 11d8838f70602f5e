"""Grants in SQL files: what roles and users may do through chains of roles, and the order to set them up in.

A chain is searched by doubling: each round joins the known chains with themselves, so the number of rounds grows with the
logarithm of the longest chain. Every round is a table in the shared folder, keeps the shortest chain of a pair only, and
the search ends when a round changes nothing; roles that hold each other need no special care. (Recursive SQL keeps each
path as a row of its own, would follow a cycle on and on, and stops at a number of rows.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.operators.manifest import privilege_targets
from wayfreight.session import drop_dir, shared_dir

COMMENT = r"(?s)--[^\n]*|/\*.*?\*/"
STATEMENT = r"(?i)(?:^|;) ?GRANT [^;]+"
_NAME = r'((?:"[^"]*"|[^\s"]++)++)'
_TO = rf"TO (?:(?:APPLICATION|DATABASE) )?(ROLE|USER) {_NAME}"
ROLE_GRANT = rf"(?i)^;? ?GRANT (?:(?:APPLICATION|DATABASE) )?ROLE {_NAME} {_TO} ?$"
PRIVILEGE_GRANT = rf"(?i)^;? ?GRANT (.+?) ON (.+) {_TO}(?: WITH GRANT OPTION)? ?$"
#: What is granted on: words, then a name that may have parts in quotes and arguments.
OBJECT = r'^((?:[A-Za-z_]++ )*)((?:"[^"]*"|[^\s"(]++)++(?: ?\(.*\))?)$'
COMMA = r",(?![^(]*\))"

PAIR = ["app_id", "grantee_kind", "grantee", "role"]


def _folded(name: Column) -> Column:
    """A name as the warehouse keeps it: upper-cased, unless a part of it is quoted."""
    return F.when(F.contains(name, F.lit('"')), name).otherwise(F.upper(name))


def grant_statements(files: DataFrame) -> DataFrame:
    """One row for each privilege, or role, that a GRANT in a readable SQL file gives to a role or a user.

    Comments do not count. A statement starts a file or follows a semicolon; one of another form (to a share, inside
    a block) gives no row. A role that is granted is in ``role``, a privilege in ``privilege`` with its object.
    """
    sql = files.filter((F.col("kind") == "sql") & F.col("readable") & F.contains(F.upper("content"), F.lit("GRANT")))
    flat = F.trim(F.regexp_replace(F.regexp_replace("content", COMMENT, " "), r"\s+", " "))
    found = sql.select("app_id", "path", F.posexplode(F.regexp_extract_all(flat, F.lit(STATEMENT), F.lit(0))).alias("at", "statement"))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract("statement", pattern, group)

    is_role = F.col("statement").rlike(ROLE_GRANT)
    listed = F.transform(F.split(part(PRIVILEGE_GRANT, 1), COMMA), lambda p: F.regexp_replace(F.upper(F.trim(p)), "^ALL PRIVILEGES$", "ALL"))
    rows = found.filter(is_role | F.col("statement").rlike(PRIVILEGE_GRANT)).select(
        "app_id",
        "path",
        (F.col("at") + 1).alias("statement_no"),
        F.when(is_role, _folded(part(ROLE_GRANT, 1))).alias("role"),
        F.explode(F.when(is_role, F.array(F.lit(None).cast("string"))).otherwise(listed)).alias("privilege"),
        F.when(~is_role, part(PRIVILEGE_GRANT, 2)).alias("clause"),
        F.upper(F.when(is_role, part(ROLE_GRANT, 2)).otherwise(part(PRIVILEGE_GRANT, 3))).alias("grantee_kind"),
        _folded(F.when(is_role, part(ROLE_GRANT, 3)).otherwise(part(PRIVILEGE_GRANT, 4))).alias("grantee"),
    )
    words = F.trim(F.regexp_extract("clause", OBJECT, 1))
    return rows.select(
        "app_id", "path", "statement_no", "grantee_kind", "grantee", "role", "privilege",
        F.upper(F.when(words == "", F.col("clause")).otherwise(words)).alias("object_type"),
        F.when(words != "", _folded(F.regexp_extract("clause", OBJECT, 2))).alias("object"),
    )


def _round(chains: DataFrame) -> tuple[DataFrame, str, tuple]:
    at = shared_dir(chains.sparkSession, "role-chains")
    chains.write.parquet(at)
    kept = chains.sparkSession.read.schema(chains.schema).parquet(at)
    return kept, at, tuple(kept.agg(F.count(F.lit(1)), F.sum("hops")).first())


def role_chains(grants: DataFrame) -> DataFrame:
    """Every role that a role or user holds, itself or through others, with the length of the shortest chain.

    A role that holds itself stands in a cycle.
    """
    direct = grants.filter(F.col("role").isNotNull()).select(*PAIR, F.lit(1).cast("bigint").alias("hops")).distinct()
    known, at, state = _round(direct)
    while True:
        onward = known.filter(F.col("grantee_kind") == "ROLE").select(
            F.col("app_id").alias("via_app"), F.col("grantee").alias("via"), F.col("role").alias("further"), F.col("hops").alias("more")
        )
        longer = known.join(onward, (F.col("app_id") == F.col("via_app")) & (F.col("role") == F.col("via"))).select(
            "app_id", "grantee_kind", "grantee", F.col("further").alias("role"), (F.col("hops") + F.col("more")).alias("hops")
        )
        new, new_at, new_state = _round(known.unionByName(longer).groupBy(*PAIR).agg(F.min("hops").alias("hops")))
        drop_dir(grants.sparkSession, at)
        if new_state == state:
            return new
        known, at, state = new, new_at, new_state


def _with_target(privileges: DataFrame) -> DataFrame:
    lookup = F.broadcast(privilege_targets(privileges.sparkSession))  # four fixed rows
    named = privileges.join(lookup, F.col("privilege") == F.col("verb"), "left").drop("verb")
    return named.withColumn("target", F.coalesce("target", F.lit(rules.NEEDS_REVIEW)))


def effective_grants(grants: DataFrame, chains: DataFrame) -> DataFrame:
    """Privileges of every role and user; ``hops`` is the length of the shortest chain of roles, 0 where granted directly."""
    on = ["privilege", "object_type", "object"]
    direct = grants.filter(F.col("privilege").isNotNull()).select("app_id", "grantee_kind", "grantee", *on).distinct()
    of_roles = direct.filter(F.col("grantee_kind") == "ROLE").select(F.col("app_id").alias("of_app"), F.col("grantee").alias("of_role"), *on)
    through = chains.join(of_roles, (F.col("app_id") == F.col("of_app")) & (F.col("role") == F.col("of_role")))
    both = direct.withColumn("hops", F.lit(0).cast("bigint")).unionByName(through.select(*direct.columns, "hops"))
    return _with_target(both.groupBy(*direct.columns).agg(F.min("hops").alias("hops")))


def role_plan(grants: DataFrame, chains: DataFrame) -> DataFrame:
    """Steps that set roles up, to be done by ``phase`` and ``level``; steps that agree in both need no order.

    The level of a role is the number of roles it holds, itself included. Whoever holds a role holds all that it
    holds, so a role is granted only after those it holds were granted to it, and no window has to number the steps.
    A role that holds one of its own level stands in a cycle with it: the step between them is marked for review.
    """
    held = (
        chains.filter((F.col("grantee_kind") == "ROLE") & (F.col("grantee") != F.col("role")))
        .groupBy("app_id", F.col("grantee").alias("name"))
        .agg(F.count(F.lit(1)).alias("held"))
    )
    receivers = grants.filter(F.col("grantee_kind") == "ROLE").select("app_id", F.col("grantee").alias("name"))
    names = receivers.unionByName(grants.filter(F.col("role").isNotNull()).select("app_id", F.col("role").alias("name"))).distinct()
    levels = names.join(held, ["app_id", "name"], "left").select("app_id", "name", (F.coalesce("held", F.lit(0)) + 1).cast("int").alias("level"))

    create = levels.select("app_id", F.lit(1).alias("phase"), "level", F.lit("create_role").alias("action"), F.col("name").alias("detail"))

    def level_of(rows: DataFrame, column: str, into: str) -> DataFrame:
        of = levels.select(F.col("app_id").alias("of_app"), F.col("name").alias("of_name"), F.col("level").alias(into))
        return rows.join(of, (F.col("app_id") == F.col("of_app")) & (F.col(column) == F.col("of_name")), "left").drop("of_app", "of_name")

    is_role = F.col("grantee_kind") == "ROLE"
    to = F.concat_ws(" ", F.lit("to"), "grantee_kind", "grantee")
    given = grants.filter(F.col("privilege").isNotNull()).select("app_id", "grantee_kind", "grantee", "privilege", "object_type", "object").distinct()
    given = level_of(_with_target(given).withColumn("receiver", F.when(is_role, F.col("grantee"))), "receiver", "level")
    review = F.col("target") == rules.NEEDS_REVIEW
    grant = given.select(
        "app_id",
        F.lit(2).alias("phase"),
        F.coalesce("level", F.lit(0)).alias("level"),
        F.when(review, rules.NEEDS_REVIEW).otherwise("grant").alias("action"),
        F.concat_ws(" ", F.when(review, F.col("privilege")).otherwise(F.col("target")), F.lit("on"), "object_type", "object", to).alias("detail"),
    )
    edges = grants.filter(F.col("role").isNotNull()).select("app_id", "grantee_kind", "grantee", "role").distinct()
    edges = edges.withColumn("receiver", F.when(is_role, F.col("grantee")))
    edges = level_of(level_of(edges, "role", "level"), "receiver", "receiver_level")
    member = edges.select(
        "app_id",
        F.lit(3).alias("phase"),
        "level",
        F.when(F.col("level") == F.col("receiver_level"), rules.NEEDS_REVIEW).otherwise("grant_role").alias("action"),
        F.concat_ws(" ", "role", to).alias("detail"),
    )
    return create.unionByName(grant).unionByName(member)
