"""Registered queries that go through files: sources, the store, snapshots, polls, filings and the factor engine.

Each lays the driver's tables down as the files that a source would give, in the session's shared folder, and reads them back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark import queries as Q
from pitspark import schema
from pitspark.functions import scalar as S
from pitspark.operators import guard, store
from pitspark.plans import factors
from pitspark.sources import edgar, market, reference
from pitspark.streaming.poll import Poller

_DAY = Q.DAY


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, on a local master only, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='pitspark-')}"
    return f"{at}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, name: str) -> str:
    at = _folder(df.sparkSession, name)
    df.write.option("header", True).option("emptyValue", "").csv(at)
    return at


def _market(spark: SparkSession, sf_dir: str) -> market.MarketCsv:
    e = Q._read(spark, sf_dir, "events")
    day, ticker = F.to_date("ts").cast("string"), F.concat(F.lit(" t"), F.col("user_id").cast("string"), F.lit(" "))
    stamp = F.when(F.col("event_id") % 5 == 0, F.concat(day, F.lit("T22:30:00+01:00"))).otherwise("")
    bars = e.select(ticker.alias("Ticker"), day.alias("Date"), *(F.col("value").alias(c) for c in ("Open", "High", "Low", "Close")), F.col("event_id").alias("Volume"), stamp.alias("knowledge_time"))
    c = Q._read(spark, sf_dir, "customer")
    ex = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("c_custkey") % 20).cast("int"))
    actions = c.select(F.col("c_custkey").alias("security"), F.lit("dividend").alias("action_type"), ex.alias("ex_date"), F.date_sub(ex, 9).alias("announced_on"), F.round("c_acctbal", 2).alias("amount"))
    gone = c.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("symbol"), F.lit("merger").alias("reason"), ex.alias("last_trade_date"), F.date_sub(ex, 4).alias("announced_on"))
    return market.MarketCsv(spark, _csv(bars, "bars"), _csv(actions, "actions"), _csv(gone, "delistings"))


@Q._query(f"""SELECT 't' || user_id AS native_entity, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * {_DAY} AS event_time_ns,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * {_DAY} + CAST(CASE WHEN event_id % 5 = 0 THEN 77400 ELSE 75600 END AS BIGINT) * 1000000000 AS knowledge_time_ns, value AS close, CAST(event_id AS DOUBLE) AS volume FROM events""")
def market_bars(spark, sf_dir):
    rows = _market(spark, sf_dir).bars()
    return rows.select("native_entity", "event_time_ns", "knowledge_time_ns", S.payload_number("close").alias("close"), S.payload_number("volume").alias("volume"))


_EX = "DATE '2024-01-10' + CAST(c_custkey % 20 AS INTEGER)"
_CLOSE = 75_600 * 10**9


@Q._query(f"""SELECT CAST(c_custkey AS VARCHAR) AS native_entity, 'market.corporate_action' AS signal_type, 'dividend' AS series_id, date_diff('day', DATE '1970-01-01', {_EX}) * {_DAY} AS event_time_ns, (date_diff('day', DATE '1970-01-01', {_EX}) - 9) * {_DAY} + {_CLOSE} AS knowledge_time_ns, round(c_acctbal, 2) AS amount FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'market.delisting', '', date_diff('day', DATE '1970-01-01', {_EX}) * {_DAY}, (date_diff('day', DATE '1970-01-01', {_EX}) - 4) * {_DAY} + {_CLOSE}, NULL FROM customer WHERE c_custkey % 9 = 0""")
def market_actions(spark, sf_dir):
    m = _market(spark, sf_dir)
    rows = m.corporate_actions().unionByName(m.delistings())
    return rows.select("native_entity", "signal_type", "series_id", "event_time_ns", "knowledge_time_ns", S.payload_number("amount").alias("amount"))


@Q._query(f"""WITH rows AS (SELECT 'market.bar' AS signal_type, CAST(ts AS DATE) AS day FROM events UNION ALL SELECT 'market.corporate_action', {_EX} FROM customer UNION ALL SELECT 'market.delisting', {_EX} FROM customer WHERE c_custkey % 9 = 0)
  SELECT signal_type, count(*) AS n FROM rows WHERE day >= DATE '2024-01-12' AND day < DATE '2024-01-20' GROUP BY signal_type""")
def market_backfill(spark, sf_dir):
    """All three files of a source, events of a window."""
    rows = _market(spark, sf_dir).backfill((19_734 * _DAY, 19_742 * _DAY))
    return rows.groupBy("signal_type").agg(F.count("*").alias("n"))


@Q._query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT 'market_csv|market.bar|t' || user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|') AS BIGINT) AS n_ids, 26 AS shortest, 26 AS longest FROM events")
def observation_ids(spark, sf_dir):
    """Ids follow from source, signal, entity and day."""
    rows = _market(spark, sf_dir).bars()
    size = F.length("observation_id")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("observation_id").alias("n_ids"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


@Q._query(f"""WITH {Q._INTERVAL_SQL}, edges AS (SELECT entity, 'added' AS edge, added_on AS d, announced_on AS a FROM intervals UNION ALL SELECT entity, 'removed', removed_on, removed_announced_on FROM intervals WHERE removed_announced_on IS NOT NULL)
  SELECT entity AS native_entity, 'meta.coverage' AS signal_type, 'top' AS series_id, date_diff('day', DATE '1970-01-01', d) * {_DAY} AS event_time_ns, date_diff('day', DATE '1970-01-01', a) * {_DAY} AS knowledge_time_ns, CAST(a AS VARCHAR) AS vintage_id, 'top:' || edge AS note FROM edges""")
def membership_csv(spark, sf_dir):
    announced = F.col("removed_announced_on").isNotNull()
    at = _csv(Q._intervals(spark, sf_dir).withColumn("removed_on", F.when(announced, F.col("removed_on"))).withColumnRenamed("entity", "security"), "members")
    rows = reference.membership_observations(reference.memberships(spark, at), universe="top")
    return rows.select("native_entity", "signal_type", "series_id", "event_time_ns", "knowledge_time_ns", "vintage_id", S.payload_text("note").alias("note"))


@Q._query(f"WITH {Q._MAPPING_SQL} SELECT 'ticker' AS kind, value, security_id, valid_from, valid_to, known_from, confidence FROM mapping")
def mapping_csv(spark, sf_dir):
    return reference.mapping(spark, _csv(Q._mapping(spark, sf_dir), "mapping"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"schema_version": F.lit(schema.SCHEMA_VERSION), "source_id": F.lit("events"), "adapter_id": F.lit("events"), "data_class": F.lit(0), "license_tag": F.lit("public"), "derived_by": F.lit(None), "raw": F.lit(None)}
    return schema.conform(Q.observations(spark, sf_dir).withColumns(made))


def _written(spark: SparkSession, sf_dir: str) -> store.SignalStore:
    """The events in a store, as two batches of which the second repeats some rows of the first."""
    out, rows = store.SignalStore(spark, _folder(spark, "store")), _stored(spark, sf_dir)
    for name, part in (("first", rows.where(F.col("observation_id").cast("long") % 3 < 2)), ("second", rows.where(F.col("observation_id").cast("long") % 3 > 0))):
        validated, _ = guard.Guard().split(part, manifest=guard.Manifest(), mode="backfill", now_ns=Q.END_NS + 400 * _DAY)
        out.write(validated, run_id=name)
    return out


@Q._query(f"WITH {Q.OBS}, picked AS (SELECT * FROM obs WHERE knowledge_time_ns <= {Q.MID_NS} AND signal_type = 'evt.click' {Q.PICK.format(more='')}) SELECT observation_id, CASE WHEN event_id % 3 < 2 THEN 'first' ELSE 'second' END AS run_id, series_id, security_id, native_entity, event_time_ns, knowledge_time_ns, value FROM picked")
def store_write_read(spark, sf_dir):
    rows = _written(spark, sf_dir).read(signal_type="evt.click", as_of_ns=Q.MID_NS)
    return rows.select("observation_id", "run_id", "series_id", "security_id", "native_entity", "event_time_ns", "knowledge_time_ns", S.payload_number("value").alias("value"))


@Q._query(f"WITH {Q.OBS} SELECT observation_id, signal_type, vintage_id, value FROM obs WHERE knowledge_time_ns <= {Q.MID_NS}")
def snapshot_write_read(spark, sf_dir):
    ref = _written(spark, sf_dir).snapshot(as_of_ns=Q.MID_NS, target_dir=_folder(spark, "snapshot"))
    rows = store.SnapshotStore(spark, ref.path, expected_content_hash=ref.content_hash).vintages(as_of_ns=Q.MID_NS)
    return rows.select("observation_id", "signal_type", "vintage_id", S.payload_number("value").alias("value"))


@Q._query(f"{Q._FACTOR_SQL}, r AS ({Q._RANK_SQL.format('pct')}) {Q._OUT_SQL}")
def factor_engine(spark, sf_dir):
    """A definition built on a snapshot."""
    rule = {"factor": {"id": "change", "version": 1, "family": "test"}, "inputs": [{"signal": "evt.purchase", "series_id": "a", "field": "value", "window": f"{Q.BASE_WINDOW}d"}], "pit": {"embargo": "1d"}, "transform": [{"op": "pct_change", "zero_base": "ieee"}, {"op": "cross_sectional_rank"}]}
    ref = _written(spark, sf_dir).snapshot(as_of_ns=Q.END_NS, target_dir=_folder(spark, "snapshot"))
    panel = factors.Engine(store.SnapshotStore(spark, ref.path), content_hash=ref.content_hash).build(factors.Definition.parse(rule), Q.DATES)
    return Q._rounded(panel.exposures)


@Q._query(f"WITH {Q.OBS}, g AS ({Q._GUARDED}) SELECT observation_id, CASE WHEN known > {Q.MID_NS} + 300000000000 THEN 'future-knowledge' WHEN vint = '' THEN 'missing-provider-vintage' END AS reject_rule FROM g")
def guard_provider_vintage(spark, sf_dir):
    rule = guard.reject_rule(now_ns=Q.MID_NS, mode="live", manifest=guard.Manifest(knowledge_time_basis="provider_vintage"))
    return Q._guarded(spark, sf_dir).withColumn("reject_rule", rule).select("observation_id", "reject_rule")


@Q._query(f"""WITH {Q.OBS}, floor AS (SELECT max(knowledge_time_ns) AS f FROM obs WHERE knowledge_time_ns <= {Q.MID_NS - 5 * _DAY})
  SELECT observation_id, CASE WHEN knowledge_time_ns <= f THEN 1 ELSE 2 END AS poll FROM obs, floor WHERE knowledge_time_ns <= {Q.MID_NS}""")
def polls_with_floor(spark, sf_dir):
    """Two polls of one source; the floor between them is read from its file."""
    at = _folder(spark, "polls")
    for k, now in enumerate((Q.MID_NS - 5 * _DAY, Q.MID_NS), 1):
        sink = lambda rows, k=k: rows.select("observation_id", F.lit(k).alias("poll")).write.parquet(f"{at}/rows/{k}")
        Poller(lambda: Q.observations(spark, sf_dir), sink, f"{at}/floor.json").poll(now_ns=now)
    return spark.read.parquet(*(f"{at}/rows/{k}" for k in (1, 2)))


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings, through JSON."""
    o = Q._read(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit("/A"))).otherwise(F.col("o_orderpriority"))
    day = F.to_date("o_orderdate").cast("string")
    fields = {"accessionNumber": F.col("o_orderkey").cast("string"), "filingDate": day, "reportDate": F.lit(""), "acceptanceDateTime": F.concat(day, F.lit("T10:00:00Z")), "form": form, "items": F.lit("1.01, 2.02,")}
    fields["reportDate"] = F.when(F.col("o_orderkey") % 2 == 0, F.lit("2023-12-31")).otherwise("")
    packed = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(*(v.alias(k) for k, v in fields.items())))).alias("r"))
    recent = F.struct(*(F.col(f"r.{k}").alias(k) for k in fields))
    at = _folder(spark, "submissions")
    packed.select(F.concat(F.lit("CIK"), F.col("o_custkey").cast("string")).alias("cik"), F.struct(recent.alias("recent")).alias("filings")).write.json(at)
    return edgar.filings(spark.read.schema(f"cik string, {edgar.SUBMISSIONS}").json(at), forms=["1-URGENT", "2-HIGH"])


_FILED_SQL = """f AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession, o_orderpriority AS base_form, o_orderkey % 3 = 0 AS amended,
    CASE WHEN o_orderkey % 2 = 0 THEN DATE '2023-12-31' ELSE CAST(o_orderdate AS DATE) END AS period_end, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) * 1000 + 36000000000000 AS accepted_ns, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"""


@Q._query(f"""WITH {_FILED_SQL} SELECT cik, accession, base_form || CASE WHEN amended THEN '/A' ELSE '' END AS form_type, period_end, accepted_ns, 2 AS n_items,
  CASE WHEN amended THEN last_value(CASE WHEN NOT amended THEN accession END IGNORE NULLS) OVER (PARTITION BY cik, period_end, base_form ORDER BY accepted_ns, accession ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS amends_ref FROM f""")
def filings_json(spark, sf_dir):
    return _filed(spark, sf_dir).select("cik", "accession", "form_type", "period_end", "accepted_ns", F.size("items").alias("n_items"), "amends_ref")


@Q._query(f"WITH {_FILED_SQL} SELECT cik, accession, 'Assets' AS concept, 'USD' AS unit, 'instant' AS period_type, o_totalprice AS value, accepted_ns FROM f")
def facts_json(spark, sf_dir):
    """Facts of all orders; those of filings that aren't known are left out, although they contradict themselves."""
    o = Q._read(spark, sf_dir, "orders").crossJoin(spark.range(2).withColumnRenamed("id", "twice"))
    wanted = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    value = F.when(wanted, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + F.col("twice"))
    item = F.struct(F.col("o_orderkey").cast("string").alias("accn"), F.to_date("o_orderdate").cast("string").alias("end"), value.alias("val"))
    packed = o.groupBy("o_custkey").agg(F.collect_list(item).alias("items"))
    body = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Assets"), F.struct(F.create_map(F.lit("USD"), F.col("items")).alias("units"))))
    at = _folder(spark, "facts")
    packed.select(F.col("o_custkey").cast("string").alias("cik"), body.alias("facts")).write.json(at)
    found = edgar.facts(spark.read.schema(f"cik string, {edgar.FACTS}").json(at), _filed(spark, sf_dir), concepts=["Assets"])
    return found.select("cik", "accession", "concept", "unit", "period_type", "value", "accepted_ns")


@Q._query(r"SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, epoch_us(TIMESTAMP '2024-01-01' + to_seconds(c_custkey)) * 1000 AS moment_ns, (19723 + c_custkey % 20) * 86400000000000 + 59430000000000 AS close_ns FROM customer")
def stamps_and_filers(spark, sf_dir):
    """Filer numbers, moments with a zone or of 14 digits, and session closes."""
    key = F.col("c_custkey")
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + key)
    east = F.concat(F.date_format(moment + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    text = F.when(key % 2 == 0, F.date_format(moment, "yyyyMMddHHmmss")).otherwise(east)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 20).cast("int"))
    rows = Q._read(spark, sf_dir, "customer")
    return rows.select("c_custkey", S.filer_cik(F.concat(F.lit(" cik"), key.cast("string"))).alias("cik"), S.iso_moment_ns(text).alias("moment_ns"), S.session_close(day, "16:30:30").alias("close_ns"))
