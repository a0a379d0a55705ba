"""Audit and custody queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocklens.operators import ledger, slices
from blocklens.plans import domain as d
from blocklens.plans.catalog import query, table
from blocklens.session import cut_lineage

CH = ["case_id"]
CUT = lambda: slices.by_width("event_id", 4096)


def audit_events(spark, sf):
    return audit_of(table(spark, sf, "events"))


def audit_of(events):
    k = d.k_of()
    return events.select(
        "event_id", F.concat(F.lit("case-"), F.col("user_id").cast("string")).alias("case_id"),
        F.concat(F.date_format("ts", d.TS), F.lit("+00:00")).alias("timestamp_utc"), F.concat(F.lit("op-"), (k % 5).cast("string")).alias("operator_id"),
        F.col("event_type").alias("operation"), F.concat(F.lit("disk \""), (k % 9).cast("string"), F.lit("\"")).alias("target_descriptor"),
        F.when(k % 10 == 0, "FAILED: read").otherwise("SUCCESS").alias("result"))


BODY = """'{"seq":' || seq || ',"timestamp_utc":"' || ts_text || '","operator_id":"' || operator_id || '","case_id":"' || case_id || '","operation":"' || operation
 || '","target_descriptor":"disk \\"' || disk || '\\"","result":"' || result || '"}'"""
AUDIT = f"""ev AS (SELECT event_id, 'case-' || user_id AS case_id, strftime(ts, {d.TS_SQL}) || '+00:00' AS ts_text, 'op-' || (k % 5) AS operator_id, event_type AS operation, k % 9 AS disk,
  CASE WHEN k % 10 = 0 THEN 'FAILED: read' ELSE 'SUCCESS' END AS result, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM (SELECT *, {d.K_SQL} AS k FROM events)),
 bo AS MATERIALIZED (SELECT *, {BODY} AS body FROM ev),
 ch(case_id, seq, prev_hash, entry_hash) AS (SELECT case_id, seq, repeat('0', 64), sha256(body || '||' || repeat('0', 64)) FROM bo WHERE seq = 1
  UNION ALL SELECT b.case_id, b.seq, c.entry_hash, sha256(b.body || '||' || c.entry_hash) FROM ch c JOIN bo b ON b.case_id = c.case_id AND b.seq = c.seq + 1)"""


def chained(spark, sf):
    return ledger.append_chain(audit_events(spark, sf), CH, ["event_id"], CUT())


@query("aud1_entry_hash", f"WITH RECURSIVE {AUDIT} SELECT case_id, seq, sha256(body || '||' || repeat('0', 64)) AS entry_hash FROM bo")
def entry_hash(spark, sf):
    rows = slices.row_numbers(audit_events(spark, sf), CH, ["event_id"], CUT(), "seq")
    return rows.select("case_id", "seq", ledger.entry_hash(F.lit(ledger.GENESIS)).alias("entry_hash"))


@query("aud4_append_chain", f"WITH RECURSIVE {AUDIT} SELECT case_id, seq, prev_hash, entry_hash FROM ch")
def append_chain(spark, sf):
    return chained(spark, sf).select("case_id", "seq", "prev_hash", "entry_hash")


def tampered(spark, sf):
    """Edited results, dropped rows and rewritten links in the stored ledger."""
    c = chained(spark, sf).where("event_id % 301 <> 7")
    return (c.withColumn("result", F.when(F.col("event_id") % 211 == 5, "EDITED").otherwise(F.col("result")))
            .withColumn("prev_hash", F.when(F.col("event_id") % 257 == 9, F.lit("f" * 64)).otherwise(F.col("prev_hash"))))


TAMPER = f"""{AUDIT}, st AS (SELECT b.*, CASE WHEN b.event_id % 257 = 9 THEN repeat('f', 64) ELSE c.prev_hash END AS prev_hash, c.entry_hash, replace(b.body, '"result":"' || b.result, '"result":"' ||
  CASE WHEN b.event_id % 211 = 5 THEN 'EDITED' ELSE b.result END) AS body2 FROM bo b JOIN ch c USING (case_id, seq) WHERE b.event_id % 301 <> 7),
 po AS (SELECT *, row_number() OVER w AS pos, lag(entry_hash) OVER w AS ph FROM st WINDOW w AS (PARTITION BY case_id ORDER BY seq)),
 fl AS (SELECT *, CASE WHEN seq <> pos THEN 'gap' WHEN prev_hash <> coalesce(ph, repeat('0', 64)) THEN 'broken' WHEN entry_hash <> sha256(body2 || '||' || prev_hash) THEN 'mismatch' END AS failure FROM po)"""


@query("aud2_verify_chain", f"""WITH RECURSIVE {TAMPER} SELECT case_id, count(*) AS entries, min(seq) AS first_seq, max(seq) AS latest_seq, arg_max(entry_hash, pos) AS latest_hash,
 count(failure) = 0 AS is_valid, arg_min(failure, pos) FILTER (failure IS NOT NULL) AS failure, min(seq) FILTER (failure IS NOT NULL) AS failed_seq FROM fl GROUP BY case_id""")
def verify_chain(spark, sf):
    return ledger.verify_chain(tampered(spark, sf), CH, 16)


@query("aud3_verify_segment", f"""WITH RECURSIVE {TAMPER}, sg AS (SELECT *, seq > 3 AS inside FROM st), p2 AS (SELECT *, row_number() OVER w - 1 AS i, lag(entry_hash) OVER w AS ph, lag(seq) OVER w AS ps FROM sg WHERE inside
  WINDOW w AS (PARTITION BY case_id ORDER BY seq)),
 f2 AS (SELECT *, CASE WHEN i > 0 AND seq <> i + 1 AND seq <> ps + 1 THEN 'gap' WHEN i > 0 AND prev_hash <> ph THEN 'broken' WHEN entry_hash <> sha256(body2 || '||' || prev_hash) THEN 'mismatch' END AS failure FROM p2)
SELECT s.case_id AS report_id, count(f2.i) > 0 AND count(failure) = 0 AS is_valid, CASE WHEN count(f2.i) = 0 THEN 'empty' ELSE arg_min(failure, f2.i) FILTER (failure IS NOT NULL) END AS failure,
 min(f2.seq) FILTER (failure IS NOT NULL) AS failed_seq FROM (SELECT DISTINCT case_id FROM sg) s LEFT JOIN f2 USING (case_id) GROUP BY s.case_id""")
def verify_segment(spark, sf):
    cols = [*ledger.HASHED, "prev_hash", "entry_hash"]
    seg = F.array_sort(F.collect_list(F.when(F.col("seq") > 3, F.struct(*cols))))
    reports = tampered(spark, sf).groupBy(F.col("case_id").alias("report_id")).agg(seg.alias("audit_chain_segment"))
    return ledger.verify_segment(reports)


@query("aud5_chain_head", f"WITH RECURSIVE {AUDIT} SELECT case_id, count(*) AS entries, min(seq) AS first_seq, max(seq) AS latest_seq, arg_max(entry_hash, seq) AS latest_hash FROM ch GROUP BY 1")
def chain_head(spark, sf):
    return ledger.chain_head(chained(spark, sf), CH)


@query("aud6_audit_trail", f"WITH RECURSIVE {AUDIT} SELECT case_id, seq, operation, operator_id, result FROM bo")
def audit_trail(spark, sf):
    rows = slices.row_numbers(audit_events(spark, sf), CH, ["event_id"], CUT(), "seq")
    return ledger.audit_trail(rows).select("case_id", "seq", "operation", "operator_id", "result")


@query("jn10_anchor_check", f"""WITH RECURSIVE {AUDIT}, an AS (SELECT case_id, seq, CASE WHEN seq % 11 = 0 THEN repeat('a', 64) ELSE entry_hash END AS head_hash FROM ch WHERE seq % 5 = 0
  UNION ALL SELECT case_id, max(seq) + 10, repeat('b', 64) FROM ch GROUP BY 1)
SELECT an.case_id, an.seq, CASE WHEN ch.entry_hash IS NULL THEN 'deleted' WHEN ch.entry_hash <> head_hash THEN 'rewritten' ELSE 'consistent' END AS status FROM an LEFT JOIN ch USING (case_id, seq)""")
def anchor_check(spark, sf):
    c = cut_lineage(chained(spark, sf).select("case_id", "seq", "entry_hash"))
    head = F.when(F.col("seq") % 11 == 0, F.lit("a" * 64)).otherwise(F.col("entry_hash"))
    an = c.where("seq % 5 = 0").select("case_id", "seq", head.alias("head_hash")).unionByName(
        c.groupBy("case_id").agg((F.max("seq") + 10).alias("seq")).withColumn("head_hash", F.lit("b" * 64)))
    return ledger.anchor_check(an, c, CH).select("case_id", "seq", "status")


# ---- custody -----------------------------------------------------------------------
@query("cus1_custody_history", f"WITH {d.CUSTODY} SELECT evidence_id, event_id, event_type, row_number() OVER (PARTITION BY evidence_id ORDER BY ts, event_id) AS position FROM custody")
def history(spark, sf):
    return ledger.custody_history(d.custody(spark, sf)).select("evidence_id", "event_id", "event_type", "position")


SHAKY = d.CUSTODY + ", shaky AS (SELECT * REPLACE (CASE WHEN event_id % 10 = 3 THEN ts - INTERVAL 3 DAY ELSE ts END AS ts) FROM custody)"


def shaky(spark, sf):
    """Recorded order is the event id; some clocks ran three days late."""
    return d.custody(spark, sf).withColumn("ts", F.when(F.col("event_id") % 10 == 3, F.col("ts") - F.expr("INTERVAL 3 DAYS")).otherwise(F.col("ts")))


@query("cus2_custody_violations", f"""WITH {SHAKY}, p AS (SELECT *, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts FROM shaky WINDOW w AS (PARTITION BY evidence_id ORDER BY event_id))
SELECT evidence_id, event_id, CASE WHEN pt IS NULL THEN CASE WHEN event_type NOT IN ('Seized','Received') THEN 'invalid_initial' END WHEN pt IN ('Returned','Disposed') THEN 'after_terminal'
 WHEN event_type = 'Transferred' AND (from_party IS NULL OR to_party IS NULL) THEN 'missing_parties' WHEN ts < pts THEN 'time_backwards' END AS violation FROM p""")
def violations(spark, sf):
    return ledger.custody_violations(shaky(spark, sf)).select("evidence_id", "event_id", "violation")


@query("cus3_custody_admit", f"""WITH RECURSIVE {SHAKY}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY event_id) AS rn FROM shaky),
 w(evidence_id, event_id, rn, reason, lt, lts) AS (
  SELECT evidence_id, event_id, rn, CASE WHEN event_type NOT IN ('Seized','Received') THEN 'invalid_initial' END, CASE WHEN event_type IN ('Seized','Received') THEN event_type END,
   CASE WHEN event_type IN ('Seized','Received') THEN ts END FROM n WHERE rn = 1
  UNION ALL SELECT s.evidence_id, s.event_id, s.rn, s.reason, CASE WHEN s.reason IS NULL THEN s.event_type ELSE s.lt END, CASE WHEN s.reason IS NULL THEN s.ts ELSE s.lts END FROM (
   SELECT n.evidence_id, n.event_id, n.rn, n.event_type, n.ts, w.lt, w.lts, CASE WHEN w.lt IS NULL THEN CASE WHEN n.event_type NOT IN ('Seized','Received') THEN 'invalid_initial' END
    WHEN w.lt IN ('Returned','Disposed') THEN 'after_terminal' WHEN n.event_type = 'Transferred' AND (n.from_party IS NULL OR n.to_party IS NULL) THEN 'missing_parties'
    WHEN n.ts < w.lts THEN 'time_backwards' END AS reason FROM w JOIN n ON n.evidence_id = w.evidence_id AND n.rn = w.rn + 1) s)
SELECT evidence_id, event_id, reason, reason IS NULL AS accepted FROM w""")
def admit(spark, sf):
    return ledger.custody_admit(shaky(spark, sf)).select("evidence_id", "event_id", "reason", "accepted")


@query("cus4_custody_current", f"""WITH {d.CUSTODY} SELECT evidence_id, arg_max(coalesce(to_party, from_party), event_id) FILTER (coalesce(to_party, from_party) IS NOT NULL) AS current_owner,
 arg_max(location, event_id) FILTER (location IS NOT NULL) AS current_location FROM custody GROUP BY 1""")
def current(spark, sf):
    return ledger.custody_current(d.custody(spark, sf))


@query("cus5_custody_ledger_text", f"""WITH {d.CUSTODY} SELECT evidence_id, event_id, '  ' || rpad(strftime(ts, '%H:%M UTC (%Y-%m-%d)'), 25, ' ') || ' ' || event_type ||
 CASE WHEN from_party IS NOT NULL AND to_party IS NOT NULL THEN ' from ' || from_party || ' to ' || to_party WHEN coalesce(to_party, from_party) IS NOT NULL THEN ' by ' || coalesce(to_party, from_party) ELSE '' END
 || coalesce(' [Loc: ' || location || ']', '') AS line FROM custody""")
def ledger_text(spark, sf):
    return ledger.custody_ledger_text(d.custody(spark, sf)).select("evidence_id", "event_id", "line")


@query("cus6_case_transitions", """WITH c AS (SELECT o_custkey AS case_id, o_orderkey AS change_id, CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Active' END AS status,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'delete' ELSE 'update' END AS action FROM orders), p AS (SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY change_id) AS was FROM c)
SELECT case_id, change_id, CASE WHEN action = 'delete' THEN 'deleted' ELSE 'reopened' END AS offence FROM p WHERE action = 'delete' OR (was = 'Closed' AND status <> 'Closed')""")
def transitions(spark, sf):
    c = table(spark, sf, "orders").selectExpr("o_custkey AS case_id", "o_orderkey AS change_id", "IF(o_orderstatus = 'F', 'Closed', 'Active') AS status",
                                              "IF(o_orderpriority = '5-LOW', 'delete', 'update') AS action")
    return ledger.case_transitions(c).select("case_id", "change_id", "offence")
