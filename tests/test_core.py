"""Values, expressions and operators on small inputs."""

from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitspark import schema, times
from pitspark.functions import scalar as S
from pitspark.operators import entities, guard, pit, transforms

DAY = S.DAY_NS


def test_clocks_do_not_mix():
    at = datetime(2024, 1, 1, tzinfo=UTC)
    known, cut = times.KnowledgeTime.at(at), times.AsOf.at(at)
    assert known.knowable(cut) and not times.KnowledgeTime(cut.ns + 1).knowable(cut)
    with pytest.raises(TypeError):
        assert known < times.EventTime.at(at)
    with pytest.raises(ValueError):
        times.EventTime.at(datetime(2024, 1, 1))
    assert cut.less_embargo(timedelta(days=1)).ns == cut.ns - DAY
    assert times.publication_lag(times.EventTime(0), times.KnowledgeTime(DAY)) == timedelta(days=1)
    assert times.from_ns(1_999) == datetime(1970, 1, 1, 0, 0, 0, 1, tzinfo=UTC)


def test_ulid_column_equals_python(spark):
    rows = [(k * 37_000_000_123, f"key-{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "ms long, key string").withColumn("u", S.ulid_column(F.col("ms"), F.col("key")))
    assert all(r["u"] == S.ulid(r["ms"], r["key"]) and len(r["u"]) == 26 for r in df.collect())


def test_normalize(spark):
    cases = [("cashtag", " $$aaa", "AAA"), ("ticker", "abc ", "ABC"), ("cik", "4711", "0000004711"), ("cik", "000", "000"), ("company_name", " A  b ", "a b"), ("isin", " x ", "x")]
    df = spark.createDataFrame(cases, "k string, v string, e string").select("e", S.normalize(F.col("k"), F.col("v")).alias("n"))
    assert all(r["n"] == r["e"] for r in df.collect())


def test_payload_fields_are_typed(spark):
    df = spark.createDataFrame([('{"a": 1, "b": true, "c": "x", "d": 2.5, "e": null}',), ("no json",), (None,)], "payload string")
    got = df.select(*(S.payload_number(c).alias(c) for c in "abcde"), S.payload_text("c").alias("t"), S.payload_text("a").alias("u")).collect()
    assert tuple(got[0]) == (1.0, None, None, 2.5, None, "x", None)
    assert set(got[1]) == set(got[2]) == {None}


def test_moments(spark):
    df = spark.createDataFrame([("20240102030405",), ("2024-01-02T03:04:05Z",), ("2024-01-02T04:04:05+01:00",)], "t string")
    want = times.to_ns(datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC))
    assert {r[0] for r in df.select(S.iso_moment_ns(F.col("t"))).collect()} == {want}
    with pytest.raises(PySparkException):
        spark.createDataFrame([("2024-01-02T03:04:05",)], "t string").select(S.iso_moment_ns(F.col("t"))).collect()


def _obs(spark, rows):
    return spark.createDataFrame(rows, "observation_id string, signal_type string, series_id string, security_id string, native_entity string, event_time_ns long, knowledge_time_ns long, vintage_id string, value double, sample long")


def test_revision_is_seen_from_its_day(spark):
    rows = _obs(spark, [("1", "s", "", None, "$AAA", 0, 10, "v1", 0.4, 9), ("2", "s", "", None, "$AAA", 0, 20, "v2", 0.6, 1)])
    seen = lambda at: [r["value"] for r in pit.pit_read(rows, as_of_ns=at).collect()]
    assert (seen(9), seen(10), seen(19), seen(20)) == ([], [0.4], [0.4], [0.6])
    assert pit.pit_read(rows, as_of_ns=30, security_ids=["$AAA"]).count() == 0


def test_thin_newest_vintage_hides_its_event(spark):
    rows = _obs(spark, [("0", "s", "", "S", "a", 0, 5, "v", 1.0, 9), ("1", "s", "", "S", "a", 7, 10, "v1", 0.4, 9), ("2", "s", "", "S", "a", 7, 20, "v2", 0.6, 1)])
    read = pit.covered(pit.pit_read(rows, as_of_ns=30), 5, F.col("sample"))
    assert [(r["entity"], r["value"]) for r in pit.latest_in_force(read, F.col("value")).collect()] == [("S", 1.0)]


def test_many_cuts_equal_single_reads(spark, monkeypatch):
    import random

    r = random.Random(4)
    rows = _obs(spark, [(str(k), "s", r.choice("ab"), None, r.choice("xyz"), r.randrange(3), r.randrange(12), r.choice("vw"), float(k), 1) for k in range(120)]).cache()
    cuts = spark.createDataFrame([(k, k) for k in (0, 3, 3, 7, 11, 15)], "c long, as_of_ns long").distinct()
    many = {(x["c"], x["observation_id"]) for x in pit.pit_read_dates(rows, cuts).collect()}
    assert many == {(c, x["observation_id"]) for c in (0, 3, 7, 11, 15) for x in pit.pit_read(rows, as_of_ns=c).collect()}
    monkeypatch.setattr(pit, "CUT_BUCKET_NS", 4)
    assert many == {(x["c"], x["observation_id"]) for x in pit.pit_read_dates(rows, cuts, max_broadcast=2).collect()}


def _section(spark, values):
    return spark.createDataFrame([(date(2024, 1, 1), f"e{k}", float(v)) for k, v in enumerate(values)], "rebalance_date date, entity string, value double")


def _values(section):
    return [r["value"] for r in section.orderBy("entity").collect()]


def test_transforms(spark):
    assert _values(transforms.cross_sectional_rank(_section(spark, [10, 30, 20]))) == [0.0, 1.0, 0.5]
    assert _values(transforms.cross_sectional_rank(_section(spark, [1, 1, 2]))) == [0.25, 0.25, 1.0]
    assert _values(transforms.cross_sectional_rank(_section(spark, [7]))) == [0.5]
    assert _values(transforms.zscore(_section(spark, [0.1, 0.1, 0.1]))) == [0.0] * 3
    assert _values(transforms.zscore(_section(spark, [1, 2, 3]))) == [-1.0, 0.0, 1.0]
    assert _values(transforms.winsorize(_section(spark, [0, 1, 2, 3, 100]), limits=(0.25, 0.75))) == [1, 1, 2, 3, 3]
    assert _values(transforms.sector_neutralize(_section(spark, [1, 3, 5]), sectors={"e0": "x", "e1": "x"})) == [-1.0, 1.0]
    with pytest.raises(PySparkException):
        transforms.zscore(_section(spark, [1])).collect()
    with pytest.raises(PySparkException):
        transforms.pct_change(_section(spark, [1]), base=_section(spark, [0])).collect()
    assert _values(transforms.pct_change(_section(spark, [2, 3]), base=_section(spark, [-1]))) == [3.0]
    with pytest.raises(transforms.TransformError):
        transforms.get_op("nope")
    with pytest.raises(transforms.TransformError):
        transforms.register_op("zscore")(lambda x: x)
    empty = _section(spark, [])
    for op in ("winsorize", "cross_sectional_rank", "zscore"):
        assert transforms.get_op(op)(empty).count() == 0


def test_a_base_of_0_fails_or_divides_as_doubles(spark):
    section, base = _section(spark, [2, -2, 0, 3]), _section(spark, [0, -0.0, 0, 2])
    assert repr(_values(transforms.pct_change(section, base=base, zero_base="ieee"))) == "[inf, -inf, nan, 0.5]"
    with pytest.raises(PySparkException, match="a base is 0"):
        transforms.pct_change(section, base=base).collect()
    with pytest.raises(transforms.TransformError):
        transforms.pct_change(section, base=base, zero_base="none")


def test_guard_rules_in_order(spark):
    now = 100 * DAY
    df = spark.createDataFrame([("a", now + DAY, now, "v"), ("b", now - 1, now - 30 * DAY, "v"), ("c", now - 30 * DAY, now - 30 * DAY, ""), ("d", now - 30 * DAY, now - 30 * DAY, "v")], "id string, knowledge_time_ns long, event_time_ns long, vintage_id string")
    m = guard.Manifest(knowledge_time_basis="ingestion", supports_restatement=True)
    got = {r["id"]: r["r"] for r in df.select("id", guard.reject_rule(now_ns=now, mode="backfill", manifest=m).alias("r")).collect()}
    assert got == {"a": "future-knowledge", "b": "backfill-now-stamp", "c": "missing-vintage", "d": None}
    live = {r["id"]: r["r"] for r in df.select("id", guard.reject_rule(now_ns=now, mode="live", manifest=guard.Manifest(knowledge_time_basis="provider_vintage")).alias("r")).collect()}
    assert live == {"a": "future-knowledge", "b": None, "c": "missing-provider-vintage", "d": None}
    with pytest.raises(TypeError):
        guard.ValidatedFrame(df)


def test_reused_ticker_resolves_by_day(spark):
    d = date.fromisoformat
    m = spark.createDataFrame([("ticker", "zzz", "OLD", d("2015-01-01"), d("2024-02-16"), None, 1.0), ("ticker", "ZZZ", "NEW", d("2024-09-02"), None, None, 0.4)], "kind string, value string, security_id string, valid_from date, valid_to date, known_from date, confidence double")
    rows = spark.createDataFrame([("1", "ZZZ", d("2024-01-01")), ("2", "ZZZ", d("2024-05-01")), ("3", "ZZZ", d("2024-10-01"))], "observation_id string, native_entity string, day date")
    got = lambda floor: {r["observation_id"]: r["security_id"] for r in entities.resolve(rows, m, day=F.col("day"), floor=floor).collect()}
    assert got(0.0) == {"1": "OLD", "2": None, "3": "NEW"}
    assert got(0.5) == {"1": "OLD", "2": None, "3": None}
    kept = entities.resolve(rows.withColumn("security_id", F.when(F.col("observation_id") == "2", "SEC-9")), m, kind=" Ticker", day=F.col("day"))
    assert {r["observation_id"]: r["security_id"] for r in kept.collect()} == {"1": "OLD", "2": "SEC-9", "3": "NEW"}


def test_universe_keeps_names_until_their_removal_is_known(spark):
    d = date.fromisoformat
    rows = [("AAA", d("2020-01-02"), d("2019-12-20"), None, None), ("BBB", d("2024-02-01"), d("2024-01-25"), None, None), ("ZZZ", d("2015-01-01"), d("2014-12-01"), d("2024-02-16"), d("2024-02-09"))]
    df = spark.createDataFrame(rows, "entity string, added_on date, announced_on date, removed_on date, removed_announced_on date")
    members = lambda day: [r["entity"] for r in entities.members_as_of(df, F.lit(d(day))).collect()]
    assert members("2024-01-31") == ["AAA", "ZZZ"]
    assert " ".join(members("2024-02-10")) == "AAA BBB ZZZ"
    assert members("2024-02-16") == ["AAA", "BBB"]
    assert entities.membership_edges(df, "u").count() == 4


def test_registry(spark):
    r = schema.SchemaRegistry()
    r.register_extension("x.y", "a bigint")
    with pytest.raises(schema.SchemaError):
        r.register_extension("market.bar", "a bigint")
    df = spark.createDataFrame([("x.y", '{"a": 3}')], "signal_type string, payload string")
    assert r.decode(df, "x.y").select("fields.a").first()[0] == 3
    assert str(schema.ModelRef.parse("m@1@2")) == "m@1@2" and schema.ModelRef.parse("m@1@2").version == "1@2"


def test_cost_model(spark):
    row = spark.range(1).select(S.cost_bps(F.lit(100.0), F.lit(10_000.0), F.lit(0.02), F.lit(2.0)).alias("c"), S.slippage_bps(F.lit(1.0), F.lit(0.0), F.lit(0.02)).alias("none")).first()
    assert row["none"] == 0 and row["c"]["total_bps"] == pytest.approx(1 + 2 + 0.02 * 0.1 * 1e4)
