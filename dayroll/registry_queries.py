"""The registry's verbs and the push's counts on stand-ins from the test tables, each with its SQL; they join the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import cadence_note, subject
from .operators import diagnostics as D
from .operators import state as S
from .operators.intervals import nights
from .plans import push
from .plans import registry as G
from .queries import _FATES, _STAGED, READ, _islands, fate_payloads, query, readings, segments, table

TODAY = "2026-08-01"


def none(kind: str):  # noqa: ANN201
    return F.lit(None).cast(kind)


def judged(accepted: DataFrame, rejected: DataFrame, *keys: str) -> DataFrame:
    """Both with their reason, null for what was accepted."""
    return accepted.select(*keys, none("string").alias("reason")).unionByName(rejected.select(*keys, "reason"))


@query(f"""WITH c AS (SELECT c_custkey AS id, c_name, c_mktsegment AS s, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS n FROM customer)
SELECT id, CASE s WHEN 'AUTOMOBILE' THEN 'resolved' WHEN 'BUILDING' THEN 'monitoring' ELSE 'active' END AS status,
  CASE WHEN s = 'AUTOMOBILE' THEN concat_ws(chr(10), nullif(n, ''), '[{TODAY}] ' || c_name) ELSE n END AS narrative,
  CASE WHEN s = 'AUTOMOBILE' THEN DATE '{TODAY}' END AS resolved_on FROM c""")
def concern_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    concerns = c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("active").alias("status"),
        F.when(F.col("c_acctbal") > 0, segment).otherwise("").alias("narrative"), none("date").alias("resolved_on"),
    )
    status = F.when(segment == "AUTOMOBILE", "resolved").when(segment == "BUILDING", "monitoring")
    note = F.when(segment == "AUTOMOBILE", F.col("c_name"))
    changes = c.select(F.col("c_custkey").alias("id"), status.alias("new_status"), note.alias("note")).where("new_status is not null")
    return G.update_concern_status(concerns, changes, TODAY).select("id", "status", "narrative", "resolved_on")


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, floor(l_quantity / 4)::INT AS severity, l_tax = 0 AS is_blank, l_suppkey * 2 AS ref,
  CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS reviewed, CASE WHEN l_discount > 0 THEN l_shipdate::DATE ELSE DATE '{TODAY}' END AS day FROM lineitem),
v AS (SELECT *, CASE WHEN ref NOT IN (SELECT s_suppkey FROM supplier) THEN 'no such concern' WHEN is_blank THEN 'body is blank'
  WHEN NOT severity BETWEEN 1 AND 10 THEN 'severity out of range' END AS reason FROM o)
SELECT l_orderkey, l_linenumber, reason, CASE WHEN reason IS NULL THEN reviewed END AS reviewed, CASE WHEN reason IS NULL THEN day END AS day FROM v""")
def observation_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    rows = li.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "self_reported").when(F.col("l_returnflag") == "A", "ai").otherwise("rules").alias("origin"),
        F.when(F.col("l_tax") == 0, "  ").otherwise("x").alias("body"), F.floor(F.col("l_quantity") / 4).cast("int").alias("severity"), (F.col("l_suppkey") * 2).alias("concern_id"),
        none("string").alias("kind"), F.when(F.col("l_discount") > 0, F.col("l_shipdate").cast("timestamp")).alias("occurred_at"),
    )
    ok, bad = G.check_observations(rows, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), f"{TODAY} 12:00:00")
    keys = ["l_orderkey", "l_linenumber"]
    good = ok.select(*keys, none("string").alias("reason"), "reviewed", F.to_date("occurred_at").alias("day"))
    return good.unionByName(bad.select(*keys, "reason", none("int").alias("reviewed"), none("date").alias("day")))


@query("""WITH g AS (SELECT o_orderkey, o_custkey * 2 AS ref, CASE o_orderstatus WHEN 'F' THEN 'at-most' WHEN 'O' THEN 'range' END AS c,
  CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END AS t, CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice / 2 WHEN o_orderpriority LIKE '3%' THEN o_totalprice * 2 END AS h FROM orders)
SELECT o_orderkey, CASE WHEN ref NOT IN (SELECT c_custkey FROM customer) THEN 'no such concern' WHEN c IS NOT NULL AND t IS NULL THEN 'target is missing'
  WHEN c IS NULL AND coalesce(t, h) IS NOT NULL THEN 'comparison is missing' WHEN c = 'range' AND h IS NULL THEN 'range needs a higher end'
  WHEN c = 'range' AND h <= t THEN 'range is inverted' WHEN c <> 'range' AND h IS NOT NULL THEN 'only a range has a higher end' END AS reason FROM g""")
def goal_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    level, price = F.substring("o_orderpriority", 1, 1), F.col("o_totalprice")
    rows = o.select(
        "o_orderkey", F.lit("t").alias("title"), (F.col("o_custkey") * 2).alias("concern_id"), F.when(F.col("o_orderstatus") == "F", "at-most").when(F.col("o_orderstatus") == "O", "range").alias("comparison"),
        F.when(level != "1", price).alias("target_value"), F.when(level == "2", price / 2).when(level == "3", price * 2).alias("target_high"),
    )
    return judged(*G.check_goals(rows, table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))), "o_orderkey")


@query("""SELECT 'whole' AS batch, count(*) AS accepted, 0::BIGINT AS rejected FROM documents
UNION ALL SELECT 'with blanks', CASE WHEN count_if(lang = 'de') = 0 THEN count(*) ELSE 0 END, count_if(lang = 'de')::BIGINT FROM documents""")
def claim_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A batch in which any claim is rejected stores none."""
    d = table(spark, sf, "documents")
    concerns = G.empty(spark, "concerns")
    out = None
    for name, statement in (("whole", F.lit("x")), ("with blanks", F.when(F.col("lang") == "de", " ").otherwise("x"))):
        rows = d.select(F.lit("general").alias("category"), statement.alias("statement"), F.lit("recalled").alias("confidence"), F.col("source").alias("subject"), none("int").alias("concern_id"))
        ok, bad = G.record_claims(rows, concerns)
        n = F.count(F.lit(1))
        one = ok.agg(n.alias("accepted")).crossJoin(bad.agg(n.alias("rejected"))).select(F.lit(name).alias("batch"), "accepted", "rejected")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH k AS (SELECT conv_id, count_if(role = 'assistant') > 2 AS closed FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN closed THEN 'checkin is closed' WHEN trim(coalesce(CASE WHEN role = 'user' THEN text ELSE ' ' END, '')) = '' THEN 'answer is blank' END AS reason
FROM conversations JOIN k USING (conv_id)""")
def response_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    closed = F.when(F.count_if(F.col("role") == "assistant") > 2, F.lit(f"{TODAY} 12:00:00").cast("timestamp"))
    checkins = c.groupBy(F.col("conv_id").alias("id")).agg(closed.alias("completed_at"))
    rows = c.select("conv_id", "turn", F.col("conv_id").alias("checkin_id"), F.when(F.col("role") == "user", F.col("text")).otherwise(" ").alias("answer"), none("int").alias("concern_id"))
    return judged(*G.check_responses(rows, checkins, G.empty(spark, "concerns")), "conv_id", "turn")


@query("SELECT (7 + row_number() OVER (ORDER BY c_custkey))::INT AS id, c_name AS name FROM customer UNION ALL SELECT 7, 'before'")
def appended_ids(spark: SparkSession, sf: str) -> DataFrame:
    old = G.empty(spark, "concerns").unionByName(spark.range(1).select(F.lit(7).alias("id"), F.lit("before").alias("name")), allowMissingColumns=True)
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return G.appended(old, rows, f"{TODAY} 12:00:00", "c_custkey").select("id", "name")


@query("""WITH t AS (SELECT c_custkey, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['BUILDING', 'x'] ELSE [c_mktsegment, 'x', 'BUILDING'] END) AS tag FROM customer) SELECT c_custkey AS concern_id, tag FROM t""")
def concern_tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), none("date").alias("opened_on"), F.array(segment, F.lit("x"), segment, F.lit("BUILDING")).alias("tags"))
    return G.tag_rows(G.new_concerns(rows, TODAY)[0]).drop("pos")


@query("""SELECT 'goals' AS what, o_orderkey AS id, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS concern_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'concerns', c_custkey, NULL FROM customer WHERE c_acctbal >= 0""")
def concern_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in debt go as concerns; their orders, as goals, lose the reference."""
    c = table(spark, sf, "customer")
    t = {n: G.empty(spark, n) for n in G.SCHEMAS}
    t["concerns"] = c.select(F.col("c_custkey").alias("id"))
    t["goals"] = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("concern_id"))
    out = G.delete_concerns(t, c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    return out["goals"].select(F.lit("goals").alias("what"), "id", "concern_id").unionByName(out["concerns"].select(F.lit("concerns").alias("what"), "id", none("long").alias("concern_id")))


@query("""WITH s AS (SELECT doc_id, trim(CASE lang WHEN 'en' THEN ' SELF ' WHEN 'de' THEN '  ' ELSE ' ' || source || ' ' END) AS t, (n_chars // 100)::INT AS d FROM documents)
SELECT doc_id, CASE WHEN lower(t) NOT IN ('', 'self') THEN t END AS subject, CASE WHEN d > 10 THEN 'It has been ' || d || ' days since the last completed check-in.' END AS note FROM s""")
def subjects_and_cadence(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("lang") == "en", " SELF ").when(F.col("lang") == "de", "  ").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    days = F.floor(F.col("n_chars") / 100).cast("int")
    return table(spark, sf, "documents").select("doc_id", subject(raw).alias("subject"), cadence_note(days).alias("note"))


@query("""WITH i AS (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'A' AND l_quantity > 45) AS blanks FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o_orderkey AS key, n, CASE WHEN n IS NULL THEN 'no items' WHEN blanks > 0 THEN 'item title is blank' WHEN o_custkey * 2 NOT IN (SELECT c_custkey FROM customer) THEN 'no such checkin' END AS reason
  FROM orders LEFT JOIN i ON l_orderkey = o_orderkey)
SELECT key, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END AS items FROM v""")
def plan_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as plans, with their lines as items: a plan is taken with all its items or not at all."""
    plans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") * 2).alias("checkin_id"), none("date").alias("starts_on"), none("int").alias("horizon_days"))
    title = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45), " ").otherwise("run")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_key"), F.lit("workout").alias("kind"), title.alias("title"))
    ok, kept, bad = G.commit_plan(plans, items, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), TODAY)
    n = kept.groupBy(F.col("plan_key").alias("key")).agg(F.count(F.lit(1)).alias("items"))
    return judged(ok, bad, "key").join(n, "key", "left").select("key", "reason", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


@query(f"""SELECT c_custkey AS id, CASE WHEN s = 'AUTOMOBILE' THEN 'mixed' WHEN s = 'BUILDING' THEN NULL ELSE 'worked' END AS verdict,
  CASE WHEN s IN ('AUTOMOBILE', 'BUILDING') THEN NULL ELSE DATE '{TODAY}' END AS ended_on FROM (SELECT c_custkey, c_mktsegment AS s FROM customer)""")
def verdicts_given_once(spark: SparkSession, sf: str) -> DataFrame:
    """One segment has its verdict already, another's rationale is blank."""
    c = table(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    protocols = c.select(F.col("c_custkey").alias("id"), F.when(segment == "AUTOMOBILE", "mixed").alias("verdict"), none("string").alias("verdict_rationale"), none("date").alias("ended_on"))
    changes = c.select(F.col("c_custkey").alias("id"), F.lit("worked").alias("new_verdict"), F.when(segment == "BUILDING", "").otherwise("why").alias("rationale"), none("date").alias("new_ended_on"))
    return G.record_verdicts(protocols, changes, TODAY)[0].select("id", "verdict", "ended_on")


@query(f"""WITH {READ}, t AS (SELECT kind, count(*) AS n, min((day, value)) AS s FROM r GROUP BY kind)
SELECT kind, CASE WHEN kind IN ('view', 'click') THEN n ELSE 0 END AS records, CASE WHEN kind IN ('click', 'purchase') THEN n ELSE 0 END AS n_rows, CASE WHEN kind IN ('click', 'signup') THEN n ELSE 0 END AS bounds_cleared,
  CASE WHEN kind <> 'signup' THEN (s[2])::DOUBLE END AS sample_value FROM t WHERE kind <> 'error'""")
def refusal_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Refused readings, refused roll-ups and cleared bounds meet by kind, whichever of them a kind has."""
    r = readings(spark, sf)
    of = lambda *kinds: r.where(F.col("kind").isin(*kinds))
    got = D.refusals(of("view", "click"), of("click", "purchase"), of("click", "signup"))
    return got.select("kind", "records", F.col("rows").alias("n_rows"), "bounds_cleared", F.col("sample_value").cast("double").alias("sample_value"))


@query(f"""WITH {READ}, q AS (SELECT DISTINCT kind || '/' || user_id AS name, day, 'old' AS point FROM r), i AS (SELECT kind || '/' || user_id AS name, max(day) AS day, 'new' AS point FROM r WHERE kind IN ('view', 'click') GROUP BY 1)
SELECT * FROM i UNION ALL SELECT * FROM q WHERE name NOT IN (SELECT name FROM i)""")
def quarantine_across_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What a run has to say about a name takes the place of all that was said before."""
    r = readings(spark, sf).withColumn("name", F.concat_ws("/", "kind", "user_id"))
    old = r.select("name", "day").distinct().withColumn("point", F.lit("old"))
    new = r.where(F.col("kind").isin("view", "click")).groupBy("name").agg(F.max("day").alias("day")).withColumn("point", F.lit("new"))
    return S.one_row_per_name(old, new)


@query(f"""{_FATES}, st AS (SELECT kind, FALSE AS cleared FROM n WHERE h <= cap UNION ALL SELECT kind, low_out FROM w)
SELECT (SELECT count(*) FROM st) AS ingested, (SELECT count_if(cleared)::BIGINT FROM st) AS bounds_cleared, 0::BIGINT AS skipped,
  (SELECT count(*) FROM s WHERE kind = 'error') AS unknown_entries, (SELECT min(day) FROM s) AS first_day, (SELECT max(day) FROM s) AS last_day""")
def push_counts(spark: SparkSession, sf: str) -> DataFrame:
    return push.report(push.route(fate_payloads(spark, sf), "value", "event_id")).select("ingested", "bounds_cleared", "skipped", "unknown_entries", "first_day", "last_day")


@query(f"""{_FATES} SELECT DISTINCT name, day, 'implausible-value' AS reason FROM n WHERE h > cap UNION SELECT name, day, 'implausible-value' FROM w WHERE low_out""")
def push_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Complaints about known names; unknown names are no refusals."""
    return push.refused(push.route(fate_payloads(spark, sf), "value", "event_id")).select("name", "day", "reason")


@query(f"""WITH {_STAGED.replace("to_s FROM g", "to_s, instant, source FROM g")}, {_islands("s0", "kind, day")},
l AS (SELECT kind, day, instant, min(source) AS source FROM s0 GROUP BY ALL), cr AS (SELECT kind, day, source FROM l QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY instant DESC) = 1)
SELECT kind, day, hours AS value, NULL::DOUBLE AS min, NULL::DOUBLE AS max, source FROM u JOIN cr USING (kind, day)""")
def night_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Nights as they are stored: hours of a union, no bounds, the latest segment's source."""
    s = segments(spark, sf).withColumns({"stage_kind": F.when(F.col("kind") != "error", F.col("kind")), "asleep": F.col("kind").isin("view", "click")}).drop("kind")
    return nights(s).select("kind", "day", F.col("value").cast("double").alias("value"), "min", "max", "source")
