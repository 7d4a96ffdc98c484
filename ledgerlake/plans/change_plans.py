"""Queries over changes: differences, line numbers, fingerprints, journal, undo, limits, permissions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.operators import changes as ch
from ledgerlake.plans.query_plans import LINES
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import entity
from ledgerlake.streaming import pending


def before_after(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and the same with every seventh gone, every fifth with another balance, and one more."""
    s = entity(spark, sf, "supplier")
    after = s.where("s_suppkey % 7 <> 3").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return s, after.unionByName(s.where("s_suppkey = 1").withColumn("s_suppkey", F.lit(-1).cast("long")))


@query(
    "row_diff",
    """SELECT s_suppkey, 'changed' AS change, 's_acctbal' AS field FROM supplier WHERE s_suppkey % 7 <> 3 AND s_suppkey % 5 = 0
    UNION ALL SELECT s_suppkey, 'removed', NULL FROM supplier WHERE s_suppkey % 7 = 3 UNION ALL SELECT -1, 'added', NULL""",
)
def row_diff(spark: SparkSession, sf: str) -> DataFrame:
    before, after = before_after(spark, sf)
    return ch.row_diff(before, after, ["s_suppkey"], ["s_name", "s_nationkey", "s_acctbal"]).select("s_suppkey", "change", "field")


@query("write_check", "SELECT s_suppkey, f AS field FROM supplier, (VALUES ('s_acctbal'), ('s_name')) AS v(f) WHERE s_suppkey % 7 = 3 OR (s_suppkey % 5 = 0 AND f = 's_acctbal')")
def write_check(spark: SparkSession, sf: str) -> DataFrame:
    before, after = before_after(spark, sf)
    return ch.mismatches(before, after, ["s_suppkey"], ["s_name", "s_acctbal"])


@query("write_check_types", "SELECT s_suppkey, 's_acctbal' AS field FROM supplier WHERE s_suppkey % 5 = 0")
def write_check_types(spark: SparkSession, sf: str) -> DataFrame:
    """Doubles against decimals and text with zeros after them: what differs is the value alone."""
    before, after = before_after(spark, sf)
    stored = before.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).cast("decimal(20,4)").cast("string").alias("s_acctbal"))
    return ch.mismatches(before, stored, ["s_suppkey"], ["s_name", "s_acctbal"])


@query("line_numbering", "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS line FROM lineitem")
def line_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return ch.number_lines(entity(spark, sf, "lineitem"), "l_orderkey", LINES).select("l_orderkey", "l_partkey", "l_suppkey", "line")


@query("line_numbers_ok", "SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS ok FROM lineitem GROUP BY l_orderkey")
def line_numbers_ok(spark: SparkSession, sf: str) -> DataFrame:
    return ch.line_numbers_ok(entity(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("fingerprint", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS fingerprint FROM nation""")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "nation").select("n_nationkey", ch.fingerprint(["n_nationkey", "n_name", "n_regionkey"]).alias("fingerprint"))


#: Events as a log: an event's user is the record, five of a user's make a commit.
_LOG = "(SELECT event_id AS seq, user_id AS record_id, event_id // 5 AS commit_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'view' THEN 'action' ELSE 'mark_for_deletion' END AS operation, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status FROM events)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "view", "action").otherwise("mark_for_deletion")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    return entity(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("record_id"), F.expr("event_id div 5").alias("commit_id"), kind.alias("operation"), status.alias("status"))


@query("journal_state", f"SELECT commit_id, max(seq) AS seq, arg_max(record_id, seq) AS record_id, arg_max(operation, seq) AS operation, arg_max(status, seq) AS status FROM {_LOG} GROUP BY commit_id")
def journal_state(spark: SparkSession, sf: str) -> DataFrame:
    return ch.journal_state(log(spark, sf))


@query("journal_page", f"SELECT commit_id, seq, status FROM {_LOG} WHERE record_id <> 3 ORDER BY seq DESC LIMIT 100")
def journal_page(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).where("record_id <> 3").orderBy(F.desc("seq")).limit(100).select("commit_id", "seq", "status")


@query(
    "undo_plan",
    f"""WITH j AS (SELECT seq AS commit_id, record_id, seq, operation, status FROM {_LOG}),
    i AS (SELECT *, CASE operation WHEN 'create' THEN 'mark_for_deletion' WHEN 'update' THEN 'update' WHEN 'mark_for_deletion' THEN 'unmark' END AS inverse, seq = max(seq) OVER (PARTITION BY record_id) AS newest FROM j)
    SELECT commit_id, inverse, inverse IS NOT NULL AND status = 'done' AND newest AS possible FROM i""",
)
def undo_plan(spark: SparkSession, sf: str) -> DataFrame:
    return ch.undo_plan(log(spark, sf).withColumn("commit_id", F.col("seq")))


@query("attempts_in_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS attempts FROM events")
def attempts_in_window(spark: SparkSession, sf: str) -> DataFrame:
    return ch.attempts_in_window(entity(spark, sf, "events"), "user_id", "ts").select("event_id", "attempts")


@query("rate_limit")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Admission depends on what was admitted before, which SQL windows can't say; the tests hold it against a loop."""
    return ch.admitted(entity(spark, sf, "events"), "user_id", "ts", "event_id", limit=2, seconds=86_400)


@query("pending_alive", "SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-02') - epoch_us(ts) < 600000000")
def pending_alive(spark: SparkSession, sf: str) -> DataFrame:
    return ch.alive(entity(spark, sf, "events"), "ts", F.lit(datetime(2024, 1, 2))).select("event_id")


RIGHTS = ch.Rights(hidden=frozenset({"region"}), virtual=frozenset({"balance"}), denied=frozenset({"nation"}), denied_fields=frozenset({"customer.c_name"}))
_WRITES = (("region", "r_name", "entity_hidden"), ("balance", "x", "permission_denied"), ("nation", "n_name", "permission_denied"), ("customer", "c_name", "field_write_denied"), ("customer", "c_acctbal", None))


@query("permission_ladder", "SELECT event_id, (['entity_hidden', 'permission_denied', 'permission_denied', 'field_write_denied', NULL])[event_id % 5 + 1] AS code FROM events")
def permission_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as an attempt to write a field."""
    part = lambda k: F.get(F.array(*(F.lit(w[k]) for w in _WRITES)), (F.col("event_id") % len(_WRITES)).cast("int"))
    return entity(spark, sf, "events").select("event_id", ch.refusal(part(0), part(1), RIGHTS).alias("code"))


#: Events as the journal of commits: a click opens one that never closes, an error fails, a purchase takes back the event before it.
_JOURNAL = "SELECT event_id, CASE event_type WHEN 'click' THEN 'open' WHEN 'error' THEN 'failed' ELSE 'done' END AS event, CASE WHEN event_type IN ('purchase', 'view') THEN event_id - 1 END AS undoes FROM events"


@query(
    "journal_effective",
    f"""WITH RECURSIVE j AS ({_JOURNAL}), l AS (SELECT undoes AS c, event_id AS u FROM j WHERE event = 'done' AND undoes IS NOT NULL),
    r(c, e, hops) AS (SELECT c, u, 1 FROM l UNION ALL SELECT r.c, l.u, hops + 1 FROM r JOIN l ON l.c = r.e), h AS (SELECT c, max(hops) AS hops FROM r GROUP BY c)
    SELECT event_id AS commit_id, CASE WHEN event = 'open' THEN 'pending' WHEN event = 'failed' THEN 'failed' WHEN coalesce(hops, 0) % 2 = 1 THEN 'undone' ELSE 'done' END AS state FROM j LEFT JOIN h ON c = event_id""",
)
def journal_effective(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of each commit, where commits take others back in chains."""
    kind = F.col("event_type")
    event = F.when(kind == "click", "open").when(kind == "error", "failed").otherwise("done")
    opened = entity(spark, sf, "events").select(F.col("event_id").alias("commit_id"), (F.col("event_id") * 2).alias("seq"), F.lit("open").alias("event"), F.when(kind.isin("purchase", "view"), F.col("event_id") - 1).alias("undoes"))
    closed = entity(spark, sf, "events").where(kind != "click").select(F.col("event_id").alias("commit_id"), (F.col("event_id") * 2 + 1).alias("seq"), event.alias("event"), F.lit(None).cast("long").alias("undoes"))
    return ch.effective(opened.unionByName(closed))


@query(
    "pending_outcomes",
    """WITH e AS (SELECT event_id // 3 AS p, event_id % 3 AS n, (user_id % 2)::VARCHAR AS s, epoch_us(ts) AS t FROM events),
    a AS (SELECT p, max(CASE WHEN n = 0 THEN s END) AS s0, max(CASE WHEN n = 0 THEN t END) AS t0, max(CASE WHEN n = 1 THEN s END) AS s1, max(CASE WHEN n = 1 THEN t END) AS t1, max(CASE WHEN n = 2 THEN s END) AS s2, max(CASE WHEN n = 2 THEN t END) AS t2 FROM e GROUP BY p),
    o AS (SELECT *, CASE WHEN s1 <> s0 THEN 'wrong_session' WHEN t1 >= t0 + 300000000 THEN 'expired' ELSE 'confirmed' END AS o1 FROM a)
    SELECT p AS pending_id, 0 AS n, 'proposed' AS outcome FROM o UNION ALL SELECT p, 1, o1 FROM o WHERE t1 IS NOT NULL
    UNION ALL SELECT p, 2, CASE WHEN o1 <> 'wrong_session' THEN 'unknown' WHEN s2 <> s0 THEN 'wrong_session' WHEN t2 >= t0 + 300000000 THEN 'expired' ELSE 'confirmed' END FROM o WHERE t2 IS NOT NULL""",
)
def pending_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Events in threes as one proposal and two confirmations; a session is checked before the time."""
    rows = entity(spark, sf, "events").select(F.expr("event_id div 3").alias("pending_id"), (F.col("user_id") % 2).cast("string").alias("session"), F.when(F.col("event_id") % 3 == 0, "propose").otherwise("confirm").alias("action"), F.col("ts").alias("at"))
    found = pending.pending_outcomes(rows, 300)
    order = Window.partitionBy("pending_id").orderBy("at", F.desc("action"))
    return found.select("pending_id", (F.row_number().over(order) - 1).alias("n"), "outcome")
