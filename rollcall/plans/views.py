"""Driver tables bound to the programme data model.

The driver ships TPC-H-like tables; these functions derive the programme
tables (participants, bookings, submissions, weekly entries, lab proofs, the
change log, access tables, linked pages, repository listings and raw import
rows) from them with plain DataFrame code.  The derivation rules are fixed
fixture definitions (documented in FIXTURES.md section C); the oracle side
uses the same rules written as SQL.

Scale notes
* ``region``/``nation`` are fixed 5/25-row dimensions in every scale factor,
  so broadcasting them is size-safe.
* The "first row per key" dedupes use ``min_by``/``max_by`` aggregates, not a
  ``row_number`` window: the aggregate is combined map-side, so a key that
  holds a third of all rows is reduced before the shuffle instead of being
  sorted inside one task.  Where the order is a unique key (orders) the
  carried columns are separate primitive ``min_by`` (hash aggregate); line
  items and events need a multi-column order, so a struct is compared
  (sort aggregate, still partial before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import Tables


def _user_email(col: str) -> Column:
    return F.concat(F.lit("user"), F.col(col).cast("string"), F.lit("@example.com"))


def participants(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(t.region.select("r_regionkey", "r_name"))
    k = F.col("c_custkey")
    return (
        c.filter(k % 13 != 5)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _user_email("c_custkey").alias("email"),
            F.col("c_name").alias("name"),
            F.date_add(F.lit("2024-01-01").cast("date"), (k % 120).cast("int"))
            .cast("timestamp_ntz").alias("registration_date_time"),
            F.when(k % 6 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("98"), (F.lit(10000000) + k).cast("string")))
            .alias("phone_number"),
            F.when(k % 5 == 0, "Female").when(k % 5 == 1, "Male").when(k % 5 == 2, "Other")
            .when(k % 5 == 3, "").alias("gender"),
            F.col("r_name").alias("country"),
            F.col("n_name").alias("state"),
            F.concat(F.lit("City_"), (k % 37).cast("string")).alias("city"),
            F.when(k % 11 == 0, F.lit(None).cast("date"))
            .otherwise(F.date_add(F.lit("1960-01-01").cast("date"), ((k * 37) % 21000).cast("int")))
            .alias("date_of_birth"),
            F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("Grade "), (k % 17).cast("string"))).alias("designation"),
            F.when(k % 9 == 0, "").when(k % 10 == 3, F.lit(None).cast("string"))
            .otherwise(F.col("c_mktsegment")).alias("occupation"),
            (k % 3 == 0).alias("prior_cohort"),
        )
    )


def _first_order_per_customer_priority(t: Tables, newest: bool) -> DataFrame:
    """One order per (customer, priority): the lowest (or highest) order key.

    Order keys are unique, so each carried column is a separate primitive
    ``min_by``/``max_by`` - fixed-width aggregation buffers, hence a hash
    aggregate with map-side combining (a struct payload would force a sort
    aggregate)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
                        .otherwise(F.lit(None).cast("boolean")).alias("o_valid"))
    key = F.max("o_orderkey") if newest else F.min("o_orderkey")
    pick = F.max_by if newest else F.min_by
    return (o.groupBy("o_custkey", "o_orderpriority")
            .agg(key.alias("o_orderkey"), pick("o_orderdate", "o_orderkey").alias("o_orderdate"),
                 pick("o_valid", "o_orderkey").alias("o_valid")))


def bookings(t: Tables) -> DataFrame:
    o = _first_order_per_customer_priority(t, newest=False)
    ok = F.col("o_orderkey")
    return o.select(
        _user_email("o_custkey").alias("email"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 29 == 0), "Feedback Form")
        .otherwise(F.concat(F.lit("Workshop "), F.substring("o_orderpriority", 1, 1))).alias("form_name"),
        F.concat(F.lit("Member "), F.col("o_custkey").cast("string")).alias("name"),
        F.when(ok % 7 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.date_add(F.lit("2024-11-20").cast("date"), (ok % 5).cast("int")).cast("timestamp_ntz"))
        .alias("time_slot"),
        F.when(ok % 3 == 0, F.concat((F.lit(20) + ok % 5).cast("string"), F.lit(" Nov, 4:00 - 7:00 PM")))
        .when(ok % 3 == 1, "").otherwise(F.lit(None).cast("string")).alias("time_slot_range"),
        F.col("o_orderdate").alias("created_at"),
    )


def submissions(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    # min over a struct = first row in the lexicographic order of its fields
    first = F.min(F.struct("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
                           "l_tax", "l_shipdate", "l_returnflag"))
    d = li.groupBy("l_linenumber", "l_partkey").agg(first.alias("f")).select("l_linenumber", "l_partkey", "f.*")
    pk = F.col("l_partkey")
    return d.select(
        F.concat(F.lit("Workshop "), F.col("l_linenumber").cast("string")).alias("workshop_name"),
        _user_email("l_partkey").alias("email"),
        F.concat(F.lit("Member "), pk.cast("string")).alias("name"),
        F.when(pk % 5 == 0, F.lit(None).cast("string")).when(pk % 5 == 1, "")
        .when(pk % 5 == 2, F.concat(F.lit("https://elsewhere.example.net/p/"), pk.cast("string")))
        .otherwise(F.concat(F.lit("https://blog.example.org/p/"), pk.cast("string"))).alias("project_link"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
        .otherwise(F.lit(None).cast("boolean")).alias("valid"),
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("team_id"),
        F.floor("l_quantity").cast("int").alias("likes"),
        F.round(F.col("l_discount") * 100).cast("int").alias("comments"),
        F.col("l_shipdate").alias("created_at"),
    )


def weekly(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    wk = F.floor((F.dayofmonth("ts") - 1) / 7)
    last = F.max(F.struct("ts", "event_id", "event_type", "value", "props"))
    d = e.groupBy(wk.alias("wk"), "user_id").agg(last.alias("l")).select("wk", "user_id", "l.*")
    et, eid, uid = F.col("event_type"), F.col("event_id"), F.col("user_id")
    return d.select(
        (F.col("wk").cast("int") + 1).alias("week_number"),
        _user_email("user_id").alias("email"),
        F.when(et == "error", F.lit(None).cast("string")).when(et == "view", "")
        .otherwise(F.concat(F.lit("https://github.com/user"), uid.cast("string"), F.lit("/repo"),
                            (eid % 50).cast("string"))).alias("github_link"),
        F.when(et == "signup", F.lit(None).cast("string")).when(et == "click", "")
        .otherwise(F.concat(F.lit("https://blog.example.org/w/"), eid.cast("string"))).alias("blog_link"),
        F.when(et == "purchase", True).when(et == "error", F.lit(None).cast("boolean"))
        .otherwise(False).alias("valid"),
        F.when(eid % 6 == 0, F.lit(None).cast("int")).otherwise(F.floor("value").cast("int")).alias("likes"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("comments"),
        F.when(et == "error", F.lit(None).cast("boolean")).when(et == "view", False)
        .otherwise(True).alias("github_valid"),
        F.col("ts").alias("created_at"),
    )


def labs(t: Tables) -> DataFrame:
    o = _first_order_per_customer_priority(t, newest=True)
    ok = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("Workshop "), F.substring("o_orderpriority", 1, 1)).alias("workshop_name"),
        _user_email("o_custkey").alias("email"),
        F.concat(F.lit("Member "), F.col("o_custkey").cast("string")).alias("name"),
        F.concat(F.lit("Problem "), (ok % 12).cast("string")).alias("problem_statement"),
        F.when(ok % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://proof.example.org/"), ok.cast("string"))).alias("proof_link"),
        F.col("o_valid").alias("valid"),
        F.concat(F.lit("Reviewer "), (ok % 6).cast("string")).alias("assigned_to"),
        F.col("o_orderdate").alias("assigned_at"),
        F.when(ok % 5 == 0, "Needs rework").otherwise(F.lit(None).cast("string")).alias("remarks"),
        F.col("o_orderdate").alias("created_at"),
    )


def change_log(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "props")
    u, eid = F.col("user_id"), F.col("event_id")
    return e.select(
        eid.alias("log_id"),
        F.when(u % 4 == 0, "participants").when(u % 4 == 1, "bookings").when(u % 4 == 2, "submissions")
        .otherwise("weekly").alias("table_name"),
        F.when(eid % 5 == 0, "INSERT").when(eid % 5 == 4, "DELETE").otherwise("UPDATE").alias("operation_type"),
        _user_email("user_id").alias("record_identifier"),
        F.col("props").alias("new_values"),
        F.col("ts").alias("log_ts"),
    )


def access_users(t: Tables) -> DataFrame:
    s = t.supplier
    return s.select(
        F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("username"),
        (F.col("s_suppkey") % 25 == 0).alias("is_admin"), (F.col("s_acctbal") > 0).alias("is_active"),
    )


def access_permissions(t: Tables) -> DataFrame:
    """One entry per part: the catalog grows with the data."""
    return t.part.select(
        F.col("p_partkey").alias("permission_id"),
        F.concat(F.lit("route_"), F.col("p_partkey").cast("string")).alias("route_name"),
        F.col("p_name").alias("display_name"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("category"),
    )


def access_grants(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_suppkey", "l_partkey")
    return li.select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("permission_id")).distinct()


def linked_pages(t: Tables) -> DataFrame:
    pid = F.col("page_id")
    counters = F.concat(
        F.lit('<button aria-label="Like this article"><span class="_card-action-text_a1">'),
        (pid % 40).cast("string"),
        F.lit('</span></button><button aria-label="Comment on this article"><span>'),
        (pid % 9).cast("string"),
        F.lit("</span></button>"),
    )
    return t.pages.select(
        pid, "url",
        F.concat(F.when(pid % 17 == 0, F.lit("<title>404 Not Found</title>")).otherwise(F.lit("")),
                 F.col("html"),
                 F.when(pid % 4 == 0, F.lit("")).otherwise(counters)).alias("html"),
    )


def repo_entries(t: Tables) -> DataFrame:
    eid = F.col("event_id")
    return t.events.select(
        F.concat(F.lit("https://github.com/user"), F.col("user_id").cast("string"), F.lit("/repo"),
                 (eid % 50).cast("string")).alias("repo_url"),
        F.when(eid % 4 == 0, ".marker").when(eid % 4 == 1, "src").when(eid % 4 == 2, "README.md")
        .otherwise("docs").alias("entry_name"),
        F.when(eid % 4 == 2, "file").otherwise("dir").alias("entry_type"),
    )


def raw_rows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    ks = k.cast("string")
    return t.customer.select(
        k.alias("row_number_in_file"),
        F.when(k % 7 == 0, F.concat(F.lit("  USER"), ks, F.lit("@Example.com ")))
        .when(k % 7 == 1, F.concat(F.lit("user"), ks)).when(k % 7 == 2, "")
        .when(k % 7 == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("user"), (k % 400).cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 8 == 0, "   ").otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("+91 98765-"), (F.lit(10000) + k).cast("string")))
        .when(k % 3 == 1, "12345").otherwise(F.lit(None).cast("string")).alias("phone"),
        F.when(k % 5 == 0, "2025-09-12T11:52:26.894Z").when(k % 5 == 1, "01/02/2024")
        .when(k % 5 == 2, "25 Nov 2024 14:00").when(k % 5 == 3, "soon").otherwise("2024-01-05 10:00")
        .alias("created_text"),
        F.when(k % 4 == 0, "25 Nov, 4:00 - 7:00 PM").when(k % 4 == 1, "26 Nov, 10:00 AM - 1:00 PM")
        .when(k % 4 == 2, "").otherwise("tbd").alias("slot_text"),
        F.when(k % 6 == 0, "TRUE").when(k % 6 == 1, "yes").when(k % 6 == 2, "0").when(k % 6 == 3, "on")
        .when(k % 6 == 4, F.lit(None).cast("string")).otherwise("No").alias("flag_text"),
        F.when(k % 4 == 0, "B.Tech 2024").when(k % 4 == 1, "2023").when(k % 4 == 2, "N/A")
        .otherwise(F.lit(None).cast("string")).alias("degree_text"),
    )


VIEW_BUILDERS = {
    "participants": participants,
    "bookings": bookings,
    "submissions": submissions,
    "weekly": weekly,
    "labs": labs,
    "change_log": change_log,
    "access_users": access_users,
    "access_permissions": access_permissions,
    "access_grants": access_grants,
    "linked_pages": linked_pages,
    "repo_entries": repo_entries,
    "raw_rows": raw_rows,
}


class Programme:
    """The programme tables of one driver folder, built lazily per access."""

    def __init__(self, spark, sf_dir: str):
        self.tables = Tables(spark, sf_dir)
        self.spark = spark

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_BUILDERS:
            return VIEW_BUILDERS[name](self.tables)
        raise AttributeError(name)
