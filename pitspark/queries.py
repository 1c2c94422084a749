"""Registered queries over the driver's tables, and the equivalent SQL.

Events become observations: the day of the event is the event time, the moment of the event the knowledge time,
the event's id its vintage. Customers give sectors, mappings and memberships by fixed date arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.functions import scalar as S
from pitspark.operators import entities, guard, inspect, pit, store, transforms
from pitspark.sources import edgar

Query = Callable[[SparkSession, str], DataFrame]
#: 2024-01-15 12:00 UTC, and the end of January 2024.
MID_NS, END_NS, DAY = 1_705_320_000 * 10**9, 1_706_659_200 * 10**9, S.DAY_NS
DATES = (date(2024, 1, 10), date(2024, 1, 17), date(2024, 1, 24))
BASE_WINDOW = 7


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("observation_id"), F.concat(F.lit("evt."), "event_type").alias("signal_type"), F.when(F.col("event_id") % 10 == 0, "b").otherwise("a").alias("series_id"),
        F.concat(F.lit("run-"), (F.col("event_id") % 4).cast("string")).alias("run_id"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("SEC-"), user)).alias("security_id"), user.alias("native_entity"),
        S.ns_of_date(F.to_date("ts")).alias("event_time_ns"), S.ns_of_local(F.col("ts")).alias("knowledge_time_ns"), (S.ns_of_local(F.col("ts")) + 3_600 * 10**9).alias("ingest_time_ns"),
        F.col("event_id").cast("string").alias("vintage_id"), "value", F.get_json_object("props", "$.k").cast("long").alias("sample_size"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("sample_size"), "value")).alias("payload"),
    )


OBS = """obs AS (SELECT CAST(event_id AS VARCHAR) AS observation_id, 'evt.' || event_type AS signal_type,
  CASE WHEN event_id % 10 = 0 THEN 'b' ELSE 'a' END AS series_id, 'run-' || (event_id % 4) AS run_id,
  CASE WHEN user_id % 7 <> 0 THEN 'SEC-' || user_id END AS security_id, CAST(user_id AS VARCHAR) AS native_entity,
  epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) * 1000 AS event_time_ns, epoch_us(ts) * 1000 AS knowledge_time_ns,
  epoch_us(ts) * 1000 + 3600000000000 AS ingest_time_ns, CAST(event_id AS VARCHAR) AS vintage_id, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS sample_size, ts, event_id, user_id FROM events)"""
PICK = "QUALIFY row_number() OVER (PARTITION BY event_time_ns, series_id, signal_type, coalesce(security_id, native_entity){more} ORDER BY (knowledge_time_ns, vintage_id, observation_id) DESC) = 1"
_KEPT = ("observation_id", "signal_type", "series_id", "security_id", "native_entity", "event_time_ns", "knowledge_time_ns", "value", "sample_size")
_COLS = ", ".join(_KEPT)

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _pit_sql(where: str = "") -> str:
    return f"WITH {OBS} SELECT {_COLS} FROM obs WHERE knowledge_time_ns <= {MID_NS} {where} {PICK.format(more='')}"


@_query(_pit_sql("AND signal_type = 'evt.click'"))
def pit_read(spark, sf_dir):
    return pit.pit_read(observations(spark, sf_dir), as_of_ns=MID_NS, signal_type="evt.click").select(*_KEPT)


@_query(_pit_sql(f"AND signal_type = 'evt.click' AND event_time_ns >= {MID_NS - 10 * DAY} AND event_time_ns < {MID_NS - 3 * DAY}"))
def pit_read_event_range(spark, sf_dir):
    return pit.pit_read(observations(spark, sf_dir), as_of_ns=MID_NS, signal_type="evt.click", event_start_ns=MID_NS - 10 * DAY, event_end_ns=MID_NS - 3 * DAY).select(*_KEPT)


@_query(_pit_sql("AND security_id IN ('SEC-1', 'SEC-2', 'SEC-7', 'SEC-15')"))
def pit_read_securities(spark, sf_dir):
    return pit.pit_read(observations(spark, sf_dir), as_of_ns=MID_NS, security_ids=["SEC-1", "SEC-2", "SEC-7", "SEC-15"]).select(*_KEPT)


@_query(_pit_sql())
def pit_all_types(spark, sf_dir):
    return pit.pit_read(observations(spark, sf_dir), as_of_ns=MID_NS).select(*_KEPT)


@_query(_pit_sql("AND series_id = 'b'"))
def pit_read_series(spark, sf_dir):
    return pit.pit_read(observations(spark, sf_dir), as_of_ns=MID_NS, series_id="b").select(*_KEPT)


@_query(f"WITH {OBS} SELECT signal_type, count(*) AS n, round(sum(value), 4) AS total FROM obs WHERE knowledge_time_ns <= {MID_NS} GROUP BY signal_type")
def knowable_filter(spark, sf_dir):
    return observations(spark, sf_dir).where(pit.knowable(MID_NS)).groupBy("signal_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_query(f"WITH {OBS} SELECT observation_id, knowledge_time_ns - event_time_ns AS lag_ns FROM obs")
def publication_lag(spark, sf_dir):
    return pit.publication_lag(observations(spark, sf_dir)).select("observation_id", "lag_ns")


@_query(f"WITH {OBS} SELECT {_COLS} FROM obs WHERE knowledge_time_ns <= {MID_NS}")
def snapshot_rows(spark, sf_dir):
    return store.snapshot_rows(observations(spark, sf_dir), as_of_ns=MID_NS).select(*_KEPT)


@_query(f"WITH {OBS} SELECT count(*) AS n_rows, count(DISTINCT run_id) AS n_runs, max(ingest_time_ns) AS last_ingest_ns FROM obs")
def store_totals(spark, sf_dir):
    return inspect.totals(observations(spark, sf_dir))


@_query(f"""WITH {OBS} SELECT signal_type, count(*) AS n_rows, count(DISTINCT coalesce(security_id, native_entity)) AS n_entities, count(security_id) AS n_resolved,
  count(DISTINCT vintage_id) AS n_vintages, min(event_time_ns) AS first_event_ns, max(event_time_ns) AS last_event_ns, max(knowledge_time_ns) AS last_knowledge_ns,
  count(security_id) / greatest(count(*), 1) AS coverage FROM obs GROUP BY signal_type""")
def store_summary(spark, sf_dir):
    return inspect.by_signal(observations(spark, sf_dir))


@_query(f"WITH {OBS} SELECT signal_type, min(event_time_ns) AS first_event_ns, CAST(count(DISTINCT native_entity) AS BIGINT) AS n_entities FROM obs GROUP BY signal_type")
def source_coverage(spark, sf_dir):
    return inspect.coverage(observations(spark, sf_dir)).select("signal_type", "first_event_ns", "n_entities")


# several dates at once
_DATES_SQL = "dates AS (SELECT CAST(d AS DATE) AS rebalance_date FROM (VALUES ('2024-01-10'), ('2024-01-17'), ('2024-01-24')) AS t(d))"
_CUTS_SQL = f"{_DATES_SQL}, cuts AS (SELECT rebalance_date, (date_diff('day', DATE '1970-01-01', rebalance_date) - 1) * {DAY} AS as_of_ns, (date_diff('day', DATE '1970-01-01', rebalance_date) - {1 + BASE_WINDOW}) * {DAY} AS base_ns FROM dates)"


def _read_sql(cut: str, where: str = "") -> str:
    return f"SELECT rebalance_date, obs.* FROM obs JOIN cuts ON knowledge_time_ns <= {cut} WHERE signal_type = 'evt.purchase' AND series_id = 'a' {where} {PICK.format(more=', rebalance_date')}"


def _forced_sql(read: str, where: str = "") -> str:
    return f"SELECT rebalance_date, coalesce(nullif(security_id, ''), native_entity) AS entity, arg_max(value, event_time_ns) AS value, max(event_time_ns) AS event_time_ns FROM {read} WHERE value IS NOT NULL {where} GROUP BY ALL"


_NOW_SQL = f"WITH {OBS}, {_CUTS_SQL}, read_now AS ({_read_sql('as_of_ns')}), now AS ({_forced_sql('read_now')})"
_FACTOR_SQL = f"{_NOW_SQL}, read_base AS ({_read_sql('base_ns')}), base AS ({_forced_sql('read_base')}), pct AS (SELECT rebalance_date, entity, (now.value - base.value) / abs(base.value) AS value FROM now JOIN base USING (rebalance_date, entity))"


def _dates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DATES], "rebalance_date date")


def _section(spark: SparkSession, sf_dir: str, back: int = 0) -> DataFrame:
    rows = observations(spark, sf_dir).where("signal_type = 'evt.purchase' AND series_id = 'a'")
    cuts = pit.embargoed_cuts(_dates(spark), 1 + back)
    return pit.latest_in_force(pit.pit_read_dates(rows, cuts), F.col("value"), "rebalance_date")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where("signal_type = 'evt.purchase' AND series_id = 'a'")
    cuts = [pit.embargoed_cuts(_dates(spark), 1 + days).withColumn("back", F.lit(back)) for back, days in ((False, 0), (True, BASE_WINDOW))]
    values = pit.latest_in_force(pit.pit_read_dates(rows, cuts[0].union(cuts[1])), F.col("value"), "rebalance_date", "back")
    return transforms.pct_change(transforms.with_base(values), zero_base="ieee")


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(F.when(key % 7 != 0, F.concat(F.lit("SEC-"), key.cast("string"))).otherwise(key.cast("string")).alias("entity"), F.when(key % 11 != 0, F.col("c_mktsegment")).alias("label"))


_SECTOR_SQL = "sectors AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN 'SEC-' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS entity, c_mktsegment AS label FROM customer WHERE c_custkey % 11 <> 0)"


@_query(f"{_NOW_SQL} SELECT rebalance_date, observation_id, value FROM read_now")
def embargo_asof_multi_date(spark, sf_dir):
    rows = observations(spark, sf_dir).where("signal_type = 'evt.purchase' AND series_id = 'a'")
    return pit.pit_read_dates(rows, pit.embargoed_cuts(_dates(spark), 1)).select("rebalance_date", "observation_id", "value")


@_query(f"{_NOW_SQL} SELECT * FROM now")
def latest_in_force(spark, sf_dir):
    return _section(spark, sf_dir)


@_query(f"WITH {OBS}, {_CUTS_SQL}, read_now AS ({_read_sql('as_of_ns')}), now AS ({_forced_sql('read_now', 'AND sample_size >= 50')}) SELECT * FROM now")
def coverage_floor(spark, sf_dir):
    rows = observations(spark, sf_dir).where("signal_type = 'evt.purchase' AND series_id = 'a'")
    read = pit.pit_read_dates(rows, pit.embargoed_cuts(_dates(spark), 1))
    return pit.latest_in_force(pit.covered(read, 50, F.col("sample_size")), F.col("value"), "rebalance_date")


@_query(f"WITH {OBS}, picked AS (SELECT * FROM obs WHERE knowledge_time_ns <= {MID_NS} {PICK.format(more='')}) SELECT signal_type, coalesce(nullif(security_id, ''), native_entity) AS entity, count(DISTINCT series_id) AS n_series FROM picked GROUP BY ALL HAVING count(DISTINCT series_id) > 1")
def multi_series_check(spark, sf_dir):
    return pit.several_series(pit.pit_read(observations(spark, sf_dir), as_of_ns=MID_NS), "signal_type")


def _rounded(section: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last bits, and so does the sign of a zero."""
    return section.select("rebalance_date", "entity", (F.round("value", 9) + F.lit(0.0)).alias("value"))


@_query(f"{_FACTOR_SQL} SELECT rebalance_date, entity, round(value, 9) + 0.0 AS value FROM pct")
def pct_change(spark, sf_dir):
    return _rounded(_changes(spark, sf_dir))


_WINSOR_SQL = "SELECT rebalance_date, entity, least(greatest(value, quantile_cont(value, 0.05) OVER (PARTITION BY rebalance_date)), quantile_cont(value, 0.95) OVER (PARTITION BY rebalance_date)) AS value FROM {}"
_RANK_SQL = "SELECT rebalance_date, entity, CASE WHEN count(*) OVER (PARTITION BY rebalance_date) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY rebalance_date ORDER BY value) - 1 + (count(*) OVER (PARTITION BY rebalance_date, value) - 1) / 2) / (count(*) OVER (PARTITION BY rebalance_date) - 1) END AS value FROM {}"
_Z_SQL = "SELECT rebalance_date, entity, CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.0 ELSE (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS value FROM {} WINDOW w AS (PARTITION BY rebalance_date)"
_OUT_SQL = "SELECT rebalance_date, entity, round(value, 9) + 0.0 AS value FROM r"


@_query(f"{_NOW_SQL}, r AS ({_WINSOR_SQL.format('now')}) {_OUT_SQL}")
def winsorize(spark, sf_dir):
    return _rounded(transforms.winsorize(_section(spark, sf_dir), limits=(0.05, 0.95)))


@_query(f"{_NOW_SQL}, {_SECTOR_SQL}, r AS (SELECT rebalance_date, entity, value - avg(value) OVER (PARTITION BY rebalance_date, label) AS value FROM now JOIN sectors USING (entity)) {_OUT_SQL}")
def sector_neutralize(spark, sf_dir):
    return _rounded(transforms.sector_neutralize(_section(spark, sf_dir), sectors=_sectors(spark, sf_dir)))


@_query(f"{_NOW_SQL}, c AS (SELECT rebalance_date, entity, round(value / 10) AS value FROM now), r AS ({_RANK_SQL.format('c')}) {_OUT_SQL}")
def cross_sectional_rank(spark, sf_dir):
    coarse = _section(spark, sf_dir).withColumn("value", F.round(F.col("value") / 10))
    return _rounded(transforms.cross_sectional_rank(coarse))


@_query(f"{_NOW_SQL}, r AS ({_Z_SQL.format('now')}) {_OUT_SQL}")
def zscore(spark, sf_dir):
    return _rounded(transforms.zscore(_section(spark, sf_dir)))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.zscore(transforms.cross_sectional_rank(transforms.winsorize(_changes(spark, sf_dir), limits=(0.05, 0.95))))


_CHAIN_SQL = f"{_FACTOR_SQL}, win AS ({_WINSOR_SQL.format('pct')}), ranked AS ({_RANK_SQL.format('win')}), r AS ({_Z_SQL.format('ranked')})"


@_query(f"{_CHAIN_SQL} {_OUT_SQL}")
def factor_pipeline(spark, sf_dir):
    return _rounded(_pipeline(spark, sf_dir))


@_query(f"""{_NOW_SQL}, more AS (SELECT * FROM dates UNION ALL SELECT DATE '2023-01-01')
  SELECT rebalance_date, count(value) AS coverage, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, min(value) AS low, max(value) AS high FROM more LEFT JOIN now USING (rebalance_date) GROUP BY rebalance_date""")
def exposure_diagnostics(spark, sf_dir):
    dates = _dates(spark).union(spark.createDataFrame([(date(2023, 1, 1),)], "rebalance_date date"))
    return transforms.diagnostics(_section(spark, sf_dir), dates).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


# entities
def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    start = F.date_add(F.lit(date(2024, 1, 1)), (F.col("c_custkey") % 20).cast("int"))
    return c.select(
        F.lit("ticker").alias("kind"), (F.col("c_custkey") % 100).cast("string").alias("value"), F.concat(F.lit("SEC-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("security_id"),
        start.alias("valid_from"), F.date_add(start, 12).alias("valid_to"), F.when(F.col("c_custkey") % 3 == 0, F.date_add(start, 2)).alias("known_from"), ((F.col("c_custkey") % 10) / 10).alias("confidence"),
    )


_MAPPING_SQL = """mapping AS (SELECT CAST(c_custkey % 100 AS VARCHAR) AS value, 'SEC-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS security_id,
  DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS valid_from, DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) + 12 AS valid_to,
  CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) + 2 END AS known_from, (c_custkey % 10) / 10 AS confidence FROM customer)"""
_HITS_SQL = f"WITH {OBS}, {_MAPPING_SQL}, hits AS (SELECT observation_id, m.security_id AS sid, m.confidence FROM obs JOIN mapping m ON m.value = obs.native_entity AND coalesce(known_from, valid_from) <= CAST(ts AS DATE) AND valid_from <= CAST(ts AS DATE) AND CAST(ts AS DATE) < valid_to)"
_BEST_SQL = "best AS (SELECT observation_id, max(confidence) AS confidence, arg_min(sid, (-confidence, sid)) AS sid, count(*) AS n FROM hits GROUP BY observation_id)"


@_query(f"{_HITS_SQL}, {_BEST_SQL} SELECT observation_id, CASE WHEN confidence >= 0.5 THEN sid END AS security_id, confidence, coalesce(n, 0) AS n_candidates FROM obs LEFT JOIN best USING (observation_id)")
def resolve_entities(spark, sf_dir):
    return entities.resolve(observations(spark, sf_dir).drop("security_id"), _mapping(spark, sf_dir), floor=0.5).select("observation_id", "security_id", "confidence", "n_candidates")


@_query(f"{_HITS_SQL}, {_BEST_SQL} SELECT observation_id, coalesce(obs.security_id, sid) AS security_id, CASE WHEN obs.security_id IS NULL THEN confidence END AS confidence, CASE WHEN obs.security_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_candidates FROM obs LEFT JOIN best USING (observation_id)")
def resolve_keeps_known(spark, sf_dir):
    """Rows with a security are not asked; kinds differ in case and white space."""
    mapping = _mapping(spark, sf_dir).withColumn("kind", F.when(F.col("value") > "5", "Ticker ").otherwise("\tticker"))
    return entities.resolve(observations(spark, sf_dir), mapping, kind=" TICKER").select("observation_id", "security_id", "confidence", "n_candidates")


@_query(f"{_HITS_SQL}, {_BEST_SQL} SELECT n > 1 AS ambiguous, count(*) AS n FROM best GROUP BY 1")
def resolve_ambiguous(spark, sf_dir):
    out = entities.resolve(observations(spark, sf_dir).drop("security_id"), _mapping(spark, sf_dir)).where("n_candidates > 0")
    return out.groupBy((F.col("n_candidates") > 1).alias("ambiguous")).agg(F.count("*").alias("n"))


@_query(r"""WITH keys AS (SELECT c_custkey, unnest([{'kind': 'cashtag', 'v': ' $$' || lower(c_mktsegment)}, {'kind': 'ticker', 'v': lower(c_name) || ' '}, {'kind': 'cik', 'v': '000' || c_custkey}, {'kind': 'company_name', 'v': '  ' || c_name || '   Inc '}, {'kind': 'other', 'v': ' ' || c_name}]) AS k FROM customer)
  SELECT c_custkey, k.kind AS kind, CASE k.kind WHEN 'cashtag' THEN upper(regexp_replace(trim(k.v), '^\$+', '')) WHEN 'ticker' THEN upper(trim(k.v)) WHEN 'cik' THEN CASE WHEN ltrim(k.v, '0') = '' THEN k.v ELSE lpad(ltrim(k.v, '0'), 10, '0') END WHEN 'company_name' THEN lower(regexp_replace(trim(k.v), '\s+', ' ', 'g')) ELSE trim(k.v) END AS normal FROM keys""")
def normalize_keys(spark, sf_dir):
    c, name, seg = _read(spark, sf_dir, "customer"), F.col("c_name"), F.lower("c_mktsegment")
    pairs = {"cashtag": F.concat(F.lit(" $$"), seg), "ticker": F.concat(F.lower(name), F.lit(" ")), "cik": F.concat(F.lit("000"), F.col("c_custkey").cast("string")), "company_name": F.concat(F.lit("  "), name, F.lit("   Inc ")), "other": F.concat(F.lit(" "), name)}
    rows = c.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in pairs.items()))).alias("k")).select("c_custkey", "k.*")
    return rows.select("c_custkey", "kind", S.normalize(F.col("kind"), F.col("v")).alias("normal"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    added = F.date_add(F.lit(date(2024, 1, 1)), (F.col("c_custkey") % 30).cast("int"))
    gone = F.col("c_custkey") % 3 == 0
    return c.select(F.concat(F.lit("C"), (F.col("c_custkey") % 200).cast("string")).alias("entity"), added.alias("added_on"), F.date_sub(added, 7).alias("announced_on"), F.when(gone, F.date_add(added, 20)).alias("removed_on"), F.when(gone & (F.col("c_custkey") % 2 == 0), F.date_add(added, 15)).alias("removed_announced_on"))


_INTERVAL_SQL = """ci AS (SELECT 'C' || (c_custkey % 200) AS entity, DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS added_on, c_custkey AS k FROM customer),
  intervals AS (SELECT entity, added_on, added_on - 7 AS announced_on, CASE WHEN k % 3 = 0 THEN added_on + 20 END AS removed_on, CASE WHEN k % 6 = 0 THEN added_on + 15 END AS removed_announced_on FROM ci)"""


@_query(f"WITH {_INTERVAL_SQL} SELECT DISTINCT entity FROM intervals WHERE announced_on <= DATE '2024-01-26' AND added_on <= DATE '2024-01-26' AND NOT coalesce(removed_on <= DATE '2024-01-26' AND removed_announced_on <= DATE '2024-01-26', FALSE)")
def members_as_of(spark, sf_dir):
    return entities.members_as_of(_intervals(spark, sf_dir), F.lit(date(2024, 1, 26)))


@_query(f"""WITH {_INTERVAL_SQL}, edges AS (SELECT entity, 'added' AS edge, added_on AS d, announced_on AS a FROM intervals UNION ALL SELECT entity, 'removed', removed_on, removed_announced_on FROM intervals WHERE removed_announced_on IS NOT NULL)
  SELECT entity, edge, 'top' AS series_id, date_diff('day', DATE '1970-01-01', d) * {DAY} AS event_time_ns, date_diff('day', DATE '1970-01-01', a) * {DAY} AS knowledge_time_ns, CAST(a AS VARCHAR) AS vintage_id, 'top:' || edge AS note FROM edges""")
def membership_edges(spark, sf_dir):
    return entities.membership_edges(_intervals(spark, sf_dir), "top")


# write path
_GUARD_NOW = MID_NS
_GUARDED = f"SELECT *, CASE WHEN event_id % 9 = 0 THEN '' ELSE vintage_id END AS vint, CASE WHEN event_id % 13 = 0 THEN {MID_NS} - 3600000000000 ELSE knowledge_time_ns END AS known FROM obs"
_RULE_SQL = f"CASE WHEN known > {MID_NS} + 300000000000 THEN 'future-knowledge' WHEN {MID_NS} - event_time_ns > 7 * {DAY} AND {MID_NS} - known < {DAY} THEN 'backfill-now-stamp' WHEN vint = '' THEN 'missing-vintage' END"


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    n = F.col("observation_id").cast("long")
    o = o.withColumn("vintage_id", F.when(n % 9 == 0, "").otherwise(F.col("vintage_id"))).withColumn("knowledge_time_ns", F.when(n % 13 == 0, F.lit(MID_NS - 3_600 * 10**9)).otherwise(F.col("knowledge_time_ns")))
    manifest = guard.Manifest(knowledge_time_basis="ingestion", supports_restatement=True)
    return o.withColumn("reject_rule", guard.reject_rule(now_ns=_GUARD_NOW, mode="backfill", manifest=manifest))


@_query(f"WITH {OBS}, g AS ({_GUARDED}) SELECT observation_id, {_RULE_SQL} AS reject_rule FROM g")
def guard_rules(spark, sf_dir):
    return _guarded(spark, sf_dir).select("observation_id", "reject_rule")


@_query(f"WITH {OBS}, g AS ({_GUARDED}), r AS (SELECT signal_type, {_RULE_SQL} AS reject_rule FROM g) SELECT signal_type, reject_rule, count(*) AS n FROM r GROUP BY ALL")
def guard_reject_counts(spark, sf_dir):
    return _guarded(spark, sf_dir).groupBy("signal_type", "reject_rule").agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a table of repeated keys."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("observation_id"), F.col("l_partkey").cast("string").alias("payload"), S.ns_of_local(F.col("l_shipdate")).alias("knowledge_time_ns"), S.ns_of_date(F.to_date("l_shipdate")).alias("event_time_ns"))


_LINES_SQL = f"li AS (SELECT l_orderkey || '-' || l_linenumber AS observation_id, CAST(l_partkey AS VARCHAR) AS payload, epoch_us(l_shipdate) * 1000 AS knowledge_time_ns, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * {DAY} AS event_time_ns FROM lineitem)"


@_query(f"WITH {_LINES_SQL} SELECT observation_id, count(*) AS n_rows, count(DISTINCT (payload, event_time_ns, knowledge_time_ns)) AS n_contents FROM li GROUP BY observation_id HAVING count(*) > 1")
def write_dedupe(spark, sf_dir):
    return store.repeated_ids(_lines(spark, sf_dir))


@_query(f"WITH {OBS}, stored AS (SELECT * FROM obs WHERE knowledge_time_ns <= {MID_NS}) SELECT observation_id, signal_type FROM obs ANTI JOIN stored USING (observation_id)")
def write_anti(spark, sf_dir):
    o = observations(spark, sf_dir)
    return store.unstored(o, o.where(pit.knowable(MID_NS))).select("observation_id", "signal_type")


@_query(f"""WITH {OBS}, stored AS (SELECT native_entity, signal_type, series_id, event_time_ns, 'v1' AS vintage_id FROM obs WHERE knowledge_time_ns <= {MID_NS}),
  staged AS (SELECT observation_id, native_entity, signal_type, series_id, event_time_ns, 'v1' AS vintage_id FROM obs WHERE knowledge_time_ns > {MID_NS}) SELECT observation_id FROM staged SEMI JOIN stored USING (native_entity, signal_type, series_id, event_time_ns, vintage_id)""")
def write_conflicts(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("vintage_id", F.lit("v1"))
    return store.conflicts(o.where(~pit.knowable(MID_NS)), o.where(pit.knowable(MID_NS))).select("observation_id")


@_query(f"""WITH {OBS}, changed AS (SELECT observation_id, CASE WHEN event_id % 17 = 0 THEN value + 1 ELSE value END AS v, value FROM obs) SELECT observation_id, v = value AS same FROM changed""")
def write_identity(spark, sf_dir):
    o = observations(spark, sf_dir).select("observation_id", F.col("value").cast("string").alias("payload"), "event_time_ns", "knowledge_time_ns")
    n = F.col("observation_id").cast("long")
    staged = observations(spark, sf_dir).select("observation_id", F.when(n % 17 == 0, F.col("value") + 1).otherwise(F.col("value")).cast("string").alias("payload"), "event_time_ns", "knowledge_time_ns")
    return store.stored_already(staged, o)


# filings
@_query("""WITH f AS (SELECT o_orderkey, o_custkey, o_orderpriority AS base_form, o_orderkey % 3 = 0 AS amended, o_orderdate FROM orders)
  SELECT o_orderkey, last_value(CASE WHEN NOT amended THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey, base_form ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS amends FROM f QUALIFY amended""")
def amendment_asof(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit("/A"))).otherwise(F.col("o_orderpriority"))
    filings = o.select("o_custkey", "o_orderkey", form.alias("form_type"), "o_orderdate")
    out = edgar.with_amendments(filings, key="o_orderkey", accepted=("o_orderdate", "o_orderkey"), period=("o_custkey",))
    return out.where(F.col("form_type").endswith("/A")).select("o_orderkey", F.col("amends_ref").alias("amends"))


@_query("""WITH packed AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS a, list(l_partkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, unnest(a) AS l_linenumber, unnest(b) AS l_partkey FROM packed""")
def array_zip_explode(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    packed = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s")).select("l_orderkey", F.struct(F.col("s.l_linenumber").alias("l_linenumber"), F.col("s.l_partkey").alias("l_partkey")).alias("columns"))
    return edgar.explode_columns(packed, "columns", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS taxonomy, c_mktsegment AS concept, 'USD' AS unit, round(c_acctbal, 2) AS val FROM customer""")
def nested_map_flatten(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    inner = F.create_map(F.lit("units"), F.create_map(F.lit("USD"), F.array(F.struct(F.round("c_acctbal", 2).alias("val")))))
    nested = c.select(F.create_map(F.col("c_custkey").cast("string"), F.create_map(F.col("c_mktsegment"), inner)).alias("facts"))
    return edgar.flatten_facts(nested, "facts").select("taxonomy", "concept", "unit", "item.val")


@_query("""WITH f AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_values FROM lineitem GROUP BY ALL) SELECT * FROM f WHERE n_values > 1""")
def fact_conflicts(spark, sf_dir):
    return edgar.conflicting(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@_query("""SELECT o_orderkey, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def facts_with_filings(spark, sf_dir):
    facts = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("accession"))
    filings = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("accession"), "c_mktsegment")
    return edgar.facts_with_filings(facts, filings).select("o_orderkey", "o_orderstatus", "c_mktsegment")


@_query("""SELECT o_orderkey, o_orderpriority AS form FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey % 3 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def form_filter(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit("/A"))).otherwise(F.col("o_orderpriority"))
    return o.withColumn("form", form).where(edgar.form_wanted(F.col("form"), ["1-URGENT", "2-HIGH"])).select("o_orderkey", edgar.base_form(F.col("form")).alias("form"))


# other
@_query(f"WITH {OBS} SELECT observation_id, knowledge_time_ns FROM obs WHERE knowledge_time_ns > {MID_NS - 5 * DAY} AND knowledge_time_ns <= {MID_NS}")
def poll_increment(spark, sf_dir):
    from pitspark.streaming import poll

    return poll.increment(observations(spark, sf_dir), floor_ns=MID_NS - 5 * DAY, now_ns=MID_NS).select("observation_id", "knowledge_time_ns")


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, round(1.0 + l_tax * 100 + (CASE WHEN p_size > 5 THEN l_discount * sqrt(greatest(l_quantity / (p_size * 10.0), 0)) * 10000 ELSE 0 END), 6) AS total_bps FROM lineitem JOIN part ON l_partkey = p_partkey""")
def cost_bps(spark, sf_dir):
    li, p = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    adv = F.when(F.col("p_size") > 5, F.col("p_size") * 10.0).otherwise(F.lit(0.0))
    cost = S.cost_bps(F.col("l_quantity"), adv, F.col("l_discount"), F.col("l_tax") * 100)
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.round(cost["total_bps"], 6).alias("total_bps"))


@_query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS missing, CAST(NULL AS DOUBLE) AS flag, event_type AS label FROM events""")
def payload_fields(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    rows = e.withColumn("payload", F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "flag": true, "label": "'), F.col("event_type"), F.lit('"}')))
    return rows.select("event_id", S.payload_number("k").alias("k"), S.payload_number("nope").alias("missing"), S.payload_number("flag").alias("flag"), S.payload_text("label").alias("label"))


_B32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _digits_sql(value: str, n: int) -> str:
    return " || ".join(f"substr('{_B32}', CAST((({value}) >> {5 * k}) & 31 AS INTEGER) + 1, 1)" for k in range(n - 1, -1, -1))


_CHUNKS_SQL = " || ".join(_digits_sql(f"CAST('0x' || substr(digest, {1 + 5 * k}, 5) AS BIGINT)", 4) for k in range(4))


@_query(f"WITH {OBS}, d AS (SELECT observation_id, CAST(event_time_ns // 1000000 AS BIGINT) AS ms, sha256(signal_type || '|' || native_entity || '|' || observation_id) AS digest FROM obs) SELECT observation_id, {_digits_sql('ms', 10)} || {_CHUNKS_SQL} AS ulid FROM d")
def ulid_ids(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.select("observation_id", S.ulid_column((F.col("event_time_ns") / 1_000_000).cast("long"), F.concat_ws("|", "signal_type", "native_entity", "observation_id")).alias("ulid"))


@_query(None)
def snapshot_hash(spark, sf_dir):
    return store.content_hash(observations(spark, sf_dir), as_of_ns=MID_NS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_pipeline(spark, sf_dir)



from pitspark import queries_io as _queries_io  # noqa: E402, F401 - registers its queries
