"""What the store, the stream's keyed state, further verbs and orders give on stand-ins from the test tables, each with its SQL; they join the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.intervals import extended, hours_of, pieces
from .plans import registry as G
from .plans.briefing import briefing, briefing_rows
from .queries import _CLAIMS, _HALVES, _PUSHED, SEG, _claims, _folder, _halves, _islands, payloads, query, segments, table
from .registry_queries import TODAY, none
from .sources.store import Store
from .streaming.keyed import stream_changes

NOON = f"{TODAY} 12:00:00"


@query(_PUSHED)
def stream_keyed_final_state(spark: SparkSession, sf: str) -> DataFrame:
    """Pushes as keyed state of a stream: files one at a time, the last first."""
    root = _folder(spark, "keyed")
    payloads(spark, sf).repartitionByRange(4, "batch").sortWithinPartitions("batch").select("value").write.text(f"{root}/in")
    store = Store(spark, f"{root}/store")
    stream_changes(spark, f"{root}/in", store, f"{root}/checkpoint", NOON, maxFilesPerTrigger="1", latestFirst="true").awaitTermination()
    return store.read("daily_metric").select("kind", "day", "value", "source")


@query(f"WITH {SEG}, {_islands('g', 'kind, day')} SELECT kind, day, hours, pieces FROM u")
def interval_union_extended(spark: SparkSession, sf: str) -> DataFrame:
    """Segments in three parts, by a hash and not by time, each of which extends what the ones before it gave."""
    s = segments(spark, sf).select("event_id", "kind", "day", "from_s", "to_s").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    of = lambda n: s.where(F.col("part") == n)
    keys = ("kind", "day")
    kept = extended(extended(pieces(of(0), keys), of(1), keys), of(2), keys)
    return hours_of(kept, keys).select(*keys, F.col("hours").cast("double").alias("hours"), "pieces")


@query(f"""WITH {_HALVES} SELECT kind, day, CASE WHEN old.kind IS NULL THEN 'inserted' ELSE 'overwritten' END AS change, old.value AS old_value, new.value AS new_value
FROM new LEFT JOIN old USING (kind, day) WHERE old.kind IS NULL OR old.value IS DISTINCT FROM new.value OR old.source IS DISTINCT FROM new.source""")
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The changes between two versions of a store, the second an upsert into the first."""
    from .operators.state import upsert

    store = Store(spark, _folder(spark, "changes") + "/store", {"t": "kind string, day date, value double, source string"})
    old, new = _halves(spark, sf)
    store.commit({"t": old})
    store.commit({"t": upsert(store.read("t"), new, ("kind", "day"))})
    c = store.changes("t", 1, 2, ("kind", "day"))
    return c.select("kind", "day", "change", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


@query("SELECT row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position, event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-28'")
def recent_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Newest first, with each row's position in the result as it comes."""
    o = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"))
    return _positions(G.recent(o, F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")).select("id"))


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'")
def pending_in_order(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("reviewed"))
    return _positions(G.pending(o).select("id"))


@query(f"WITH {_CLAIMS} SELECT row_number() OVER (ORDER BY id DESC) AS position, id FROM c WHERE confidence = 'unknown'")
def unresolved_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(G.unresolved(_claims(spark, sf)).select("id"))


@query("SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_custkey DESC) AS position, c_custkey AS id FROM customer")
def protocol_history_in_order(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("started_on"))
    return _positions(G.protocol_history(p).select("id"))


def _positions(rows: DataFrame) -> DataFrame:
    """rows, sorted, with the position of each: its place in its part, after the rows of the parts before it."""
    at = F.monotonically_increasing_id()
    placed = rows.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33))
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(before.drop("_n"), "_part").select((F.col("_before") + place + 1).alias("position"), *rows.columns)


@query(f"""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN ' ' ELSE 'a clerk' END AS name, o_custkey * 2 AS c, CASE WHEN o_orderstatus = 'F' THEN o_custkey * 3 END AS g,
  CASE WHEN o_orderpriority LIKE '2%' THEN o_orderdate::DATE END AS day FROM orders),
v AS (SELECT *, CASE WHEN trim(name) = '' THEN 'name is blank' WHEN c NOT IN (SELECT c_custkey FROM customer) THEN 'no such concern'
  WHEN g IS NOT NULL AND g NOT IN (SELECT p_partkey FROM part) THEN 'no such goal' END AS reason FROM p)
SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN coalesce(day, DATE '{TODAY}') END AS started_on FROM v""")
def protocol_starts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    level = F.substring("o_orderpriority", 1, 1)
    rows = o.select(
        "o_orderkey", F.when(level == "1", " ").otherwise(F.lit("a clerk")).alias("name"), (F.col("o_custkey") * 2).alias("concern_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") * 3).alias("goal_id"), F.when(level == "2", F.to_date("o_orderdate")).alias("started_on"),
    )
    ids = lambda t, c: table(spark, sf, t).select(F.col(c).alias("id"))
    ok, bad = G.start_protocols(rows, ids("customer", "c_custkey"), ids("part", "p_partkey"), TODAY)
    return ok.select("o_orderkey", none("string").alias("reason"), "started_on").unionByName(bad.select("o_orderkey", "reason", none("date").alias("started_on")))


@query(f"""WITH k AS (SELECT conv_id AS id, count_if(role = 'assistant') > 2 AS closed, count(*) AS n FROM conversations GROUP BY conv_id), m AS (SELECT max(id) AS top FROM k),
c AS (SELECT id, closed FROM k UNION ALL SELECT top + 1 + id, NULL FROM k, m)
SELECT id, CASE WHEN closed IS NULL THEN 'no such checkin' WHEN closed THEN 'checkin is closed' END AS reason, CASE WHEN NOT closed THEN 'told ' || id END AS summary,
  CASE WHEN closed = FALSE THEN TIMESTAMP '{NOON}' END::VARCHAR AS completed_at FROM c""")
def checkins_completed(spark: SparkSession, sf: str) -> DataFrame:
    """Every check-in is to be completed, and as many that are not there: some are closed already."""
    k = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg((F.count_if(F.col("role") == "assistant") > 2).alias("closed"))
    checkins = k.select("id", F.when(F.col("closed"), F.lit("2024-01-01").cast("timestamp")).alias("completed_at"), none("string").alias("summary"))
    top = k.agg((F.max("id") + 1).alias("top"))
    changes = k.select("id").unionByName(k.crossJoin(top).select((F.col("id") + F.col("top")).alias("id")))  # one row
    changes = changes.withColumn("new_summary", F.concat(F.lit("told "), F.col("id").cast("string")))
    done, bad = G.complete_checkins(checkins, changes, NOON)
    good = done.join(bad.select("id"), "id", "left_anti").select("id", none("string").alias("reason"), "summary", F.col("completed_at").cast("string").alias("completed_at"))
    return good.unionByName(bad.select("id", "reason", none("string").alias("summary"), none("string").alias("completed_at")))


@query(f"""WITH k AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), c AS (SELECT conv_id AS id, TIMESTAMP '{TODAY}' - INTERVAL 1 SECOND - to_days(n::INT) AS began FROM k)
SELECT 'new' AS case_, id, began::VARCHAR AS started_at FROM c UNION ALL SELECT 'new', (SELECT max(id) + 1 FROM c), '{NOON}' UNION ALL SELECT 'open', id, began::VARCHAR FROM c UNION ALL SELECT 'open', (SELECT max(id) + 1 FROM c), '{TODAY} 08:00:00'""")
def checkin_started_or_taken_up(spark: SparkSession, sf: str) -> DataFrame:
    """With open check-ins of earlier days alone a new one is started; with one of today none is."""
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    at = F.timestamp_micros(F.unix_micros(F.lit(TODAY).cast("timestamp")) - (1 + F.col("n").cast("long") * 86400) * 1_000_000)
    old = n.select(F.col("conv_id").cast("int").alias("id"), at.alias("started_at"), none("timestamp").alias("completed_at"), none("string").alias("summary"), none("timestamp").alias("created_at"), none("timestamp").alias("updated_at"))
    today = G.appended(old, spark.range(1).select(F.lit(f"{TODAY} 08:00:00").cast("timestamp").alias("started_at")), NOON, "started_at")
    out = None
    for name, before in (("new", old), ("open", today)):
        rows = G.start_checkin(before, NOON)[0].select(F.lit(name).alias("case_"), F.col("id").cast("long").alias("id"), F.col("started_at").cast("string").alias("started_at"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH i AS (SELECT l_orderkey * 8 + l_linenumber AS item, min(l_returnflag) AS f FROM lineitem GROUP BY item)
SELECT item, CASE WHEN f = 'R' THEN 'skipped' ELSE 'done' END AS status, f <> 'A' AND f <> 'R' AS kept FROM i WHERE f <> 'A' UNION ALL SELECT item, 'skipped', FALSE FROM i WHERE f = 'A'""")
def plan_outcomes_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Every item has an outcome but those flagged A; those flagged A or R get one, which takes the place of what there was."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("plan_item_id"), "l_returnflag")
    i = G.dealt(rows, "plan_item_id").groupBy("plan_item_id").agg(F.min("l_returnflag").alias("f"))  # all joins by item keep this dealing
    old = i.where("f <> 'A'").select(F.col("plan_item_id").alias("id"), "plan_item_id", F.lit("done").alias("status"), none("string").alias("note"), none("timestamp").alias("recorded_at"), none("timestamp").alias("created_at"), none("timestamp").alias("updated_at"))
    new = i.where("f IN ('A', 'R')").select("plan_item_id", F.lit("skipped").alias("status"))
    got, _ = G.record_outcomes(old, new, i.select(F.col("plan_item_id").alias("id")), NOON)
    return got.select(F.col("plan_item_id").cast("long").alias("item"), "status", F.col("recorded_at").isNull().alias("kept"))


@query("""WITH d AS (SELECT doc_id AS id, text AS statement, source, lang FROM documents), v AS (SELECT *, CASE WHEN lang = 'de' THEN 'subject is blank' WHEN lang = 'fr' THEN 'statement is blank' END AS reason FROM d)
SELECT id, CASE WHEN reason IS NULL AND lang = 'es' THEN 'other' ELSE 'first' END AS statement, CASE WHEN reason IS NULL AND lang = 'en' THEN NULL WHEN reason IS NULL AND lang = 'es' THEN source ELSE 'mum' END AS subject FROM v""")
def claims_changed_sparsely(spark: SparkSession, sf: str) -> DataFrame:
    """By language: the subject becomes the person themselves, or the source with another statement; a blank subject or statement is refused."""
    d = table(spark, sf, "documents")
    claims = d.select(F.col("doc_id").alias("id"), F.lit("first").alias("statement"), F.lit("recalled").alias("confidence"), F.lit("mum").alias("subject"), none("string").alias("topic"), none("date").alias("occurred_on"))
    is_ = lambda *langs: F.col("lang").isin(*langs)
    changes = d.select(
        F.col("doc_id").alias("id"), F.when(is_("en"), " Self ").when(is_("de"), "  ").when(is_("es"), F.col("source")).alias("subject"), is_("en", "de", "es").alias("subject_set"), F.when(is_("fr"), "").when(is_("es"), "other").alias("statement"),
        is_("fr", "es").alias("statement_set"), *[x for c, k in (("confidence", "string"), ("topic", "string"), ("occurred_on", "date")) for x in (none(k).alias(c), F.lit(False).alias(f"{c}_set"))],
    )
    return G.update_claims(claims, changes)[0].select("id", "statement", "subject")


@query(f"""WITH c AS (SELECT max(c_acctbal) AS m, count(*) AS n FROM customer)
SELECT 1 AS id, CASE WHEN n > 0 THEN 'female' END AS sex, (m / 100)::INT AS height_cm, NULL::VARCHAR AS notes FROM c""")
def profile_changed_sparsely(spark: SparkSession, sf: str) -> DataFrame:
    """Two changes of the one row, which the first one makes; only given columns change, a null given clears."""
    most = table(spark, sf, "customer").agg(F.max("c_acctbal")).first()[0]
    p = G.update_profile(G.empty(spark, "profile"), {"sex": "female", "notes": "first"}, NOON)
    return G.update_profile(p, {"height_cm": round(most / 100), "notes": None}, NOON).select("id", "sex", "height_cm", "notes")


_BRIEFED = f"""WITH {_CLAIMS}, ck AS (SELECT max(conv_id) AS id FROM conversations WHERE turn = 1),
s AS (SELECT 'unknowns' AS section, id, category AS detail, -id AS place, NULL::TIMESTAMP AS stamp FROM c WHERE confidence = 'unknown'
  UNION ALL SELECT 'pending', o_orderkey, o_orderpriority, o_orderkey, o_orderdate::TIMESTAMP FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'concerns', r_regionkey, r_name, r_regionkey, NULL FROM region
  UNION ALL SELECT * FROM (SELECT 'plan', o_orderkey, o_orderpriority, 0, NULL FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
  UNION ALL SELECT 'last_checkin', id, NULL, 0, NULL FROM ck)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY stamp, place) - 1 AS position, id, detail FROM s"""


def _registry(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    t = {n: G.empty(spark, n) for n in G.SCHEMAS}
    o = table(spark, sf, "orders")
    at = F.to_timestamp("o_orderdate")
    t["checkins"] = table(spark, sf, "conversations").where("turn = 1").select(F.col("conv_id").alias("id"), F.timestamp_seconds(F.col("conv_id") + F.lit(1_700_000_000)).alias("completed_at")).distinct()
    t["plans"] = o.select(F.col("o_orderkey").alias("id"), at.alias("starts_on"), F.col("o_orderpriority").alias("guidance"))
    t["observations"] = o.select(F.col("o_orderkey").alias("id"), at.alias("occurred_at"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("reviewed"), F.col("o_orderpriority").alias("body"))
    t["concerns"] = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit("active").alias("status"), F.col("r_name").alias("name"))
    t["claims"] = _claims(spark, sf)
    return t


DETAIL = {"unknowns": "category", "pending": "body", "concerns": "name", "plan": "guidance", "last_checkin": "summary"}


@query(_BRIEFED)
def briefing_records(spark: SparkSession, sf: str) -> DataFrame:
    """The sections' rows in order, with what their records say."""
    rows = briefing_rows(_registry(spark, sf), "2024-01-01").where(F.col("section") != "recent")
    said = F.coalesce(*[F.when(F.col("section") == n, F.get_json_object("record", f"$.{f}")) for n, f in DETAIL.items()])
    at = F.row_number().over(Window.partitionBy("section").orderBy("place")) - 1
    return rows.select("section", at.cast("long").alias("position"), "id", said.alias("detail"))


@query(_BRIEFED)
def briefing_document(spark: SparkSession, sf: str) -> DataFrame:
    """The same out of the one nested document."""
    doc = briefing(_registry(spark, sf), "2024-01-01")
    out = None
    for n, f in DETAIL.items():
        own = doc.select(F.posexplode(n if n in ("unknowns", "pending", "concerns") else F.array(n)).alias("position", "r"))
        detail = F.col(f"r.{f}") if f in own.schema["r"].dataType.names else none("string")
        own = own.select(F.lit(n).alias("section"), F.col("position").cast("long").alias("position"), F.col("r.id").cast("long").alias("id"), detail.alias("detail"))
        out = own if out is None else out.unionByName(own)
    return out

