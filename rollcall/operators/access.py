"""Role and permission joins.

The permission catalog is a small table of routes; it is the only side
broadcast explicitly, and only after a row-count check.  Grants (the bridge)
and users grow with the deployment and are joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.joins import checked_broadcast

# The route catalog is broadcast after a row-count check; a larger catalog
# falls back to a shuffled join.
CATALOG_BOUND = 10_000
ALL_ROUTES = "*"


def effective_permissions(grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """User -> granted permissions (inner join via the bridge), for all
    users, ordered by user, category, display name."""
    cat = checked_broadcast(permissions, CATALOG_BOUND)
    return (grants.select("user_id", "permission_id").join(cat, "permission_id", "inner")
            .orderBy("user_id", F.col("category").asc_nulls_first(), "display_name"))


def effective_routes(users: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """Routes a user may open.  Non-admins: their granted routes.  Admins:
    one rule row with route ``*`` (every route) instead of a row per route, so
    the output grows with grants, not with admins x catalog."""
    cat = checked_broadcast(permissions.select("permission_id", "route_name"), CATALOG_BOUND)
    admins = users.filter(F.col("is_admin")).select("user_id", F.lit(ALL_ROUTES).alias("route_name"),
                                                    F.lit(True).alias("all_routes"))
    granted = (grants.select("user_id", "permission_id").join(cat, "permission_id")
               .join(users.filter(~F.coalesce(F.col("is_admin"), F.lit(False))).select("user_id"),
                     "user_id", "left_semi")
               .select("user_id", "route_name", F.lit(False).alias("all_routes"))
               .distinct())
    return admins.unionByName(granted)


def access_check(requests: DataFrame, users: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """For a batch of (user_id, route_name) requests, ``allowed`` when the
    user is an admin or holds a grant for a permission with that route.

    Asked routes become (user, permission) pairs first and grants are only
    looked up in these, two ids wide, so neither route text nor a distinct of
    all grants is shuffled; how the catalog is joined is left to its size."""
    routes = permissions.select("permission_id", "route_name")
    granted = (requests.select("user_id", "route_name").join(routes, "route_name")
               .join(grants.select("user_id", "permission_id"), ["user_id", "permission_id"], "left_semi")
               .select("user_id", "route_name").distinct().withColumn("granted", F.lit(True)))
    flags = users.select("user_id", "is_admin")
    return (requests.join(flags, "user_id", "left")
            .join(granted, ["user_id", "route_name"], "left")
            .select("user_id", "route_name",
                    (F.coalesce(F.col("is_admin"), F.lit(False))
                     | F.coalesce(F.col("granted"), F.lit(False))).alias("allowed")))


def grants_by_category(user_id: int, grants: DataFrame, permissions: DataFrame,
                       null_category: str = "Other") -> DataFrame:
    """Every permission of the catalog with a ``granted`` flag for one
    user, grouped by category (null -> ``Other``).  Flat rows; group with
    ``groupBy('category')`` for a nested view (bounded by the catalog)."""
    mine = grants.filter(F.col("user_id") == user_id).select("permission_id").distinct() \
        .withColumn("granted", F.lit(True))
    return (permissions.join(mine, "permission_id", "left")
            .select(F.coalesce(F.col("category"), F.lit(null_category)).alias("category"),
                    "permission_id", "route_name", "display_name",
                    F.coalesce(F.col("granted"), F.lit(False)).alias("granted"))
            .orderBy("category", "display_name", "permission_id"))
