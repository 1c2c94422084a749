"""Store, snapshots, sources, polls, factors and the command line, on files."""

import json
from datetime import UTC, date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitspark import cli, schema, times
from pitspark.operators import guard, store
from pitspark.plans import adapters, backtest, factors, ingest
from pitspark.sources import csv, edgar, market, ratelimit, reference, settings
from pitspark.streaming.poll import Poller, stream_files

NS = lambda *a: times.to_ns(datetime(*a, tzinfo=UTC))
NOW = NS(2026, 1, 1)


def _bars(path, days=20, names=("AAA", "BBB", "ZZZ")):
    rows = [f"{n},2024-01-{d:02d},1,2,0.5,{100 + k * 10 + (k + 1) * d},1000" for d in range(1, days + 1) for k, n in enumerate(names)]
    path.write_text("﻿Ticker,Date,Open,High,Low,Close,Volume\n" + "\n".join(rows) + "\n,,,,,,\n")


@pytest.fixture
def bundle(tmp_path):
    _bars(tmp_path / "bars.csv")
    (tmp_path / "actions.csv").write_text("security,action_type,ex_date,announced_on,ratio,amount\nAAA,split,2024-01-15,2024-01-08,2.0,\nBBB,dividend,2024-01-12,2024-01-03,,0.34\n")
    (tmp_path / "gone.csv").write_text("symbol,reason,last_trade_date,announced_on\nZZZ,bankruptcy,2024-01-19,2024-01-15\n")
    (tmp_path / "members.csv").write_text("security,added_on,announced_on,removed_on,removed_announced_on\nAAA,2020-01-02,2019-12-20,,\nZZZ,2024-01-05,2024-01-02,2024-01-19,2024-01-16\n")
    (tmp_path / "entities.csv").write_text("kind,value,security_id,valid_from,valid_to,known_from,confidence\nticker,AAA,SEC-1,2015-01-02,,,1.0\nticker,BBB,SEC-2,2015-01-02,,,\n")
    (tmp_path / "run.toml").write_text('[run]\nid = "r1"\n[store]\npath = "store"\n[resolver]\ntables = "entities.csv"\n[backfill]\nstart = "2024-01-01"\nend = "2024-03-01"\n[[adapters]]\nid = "market_csv"\n[adapters.config]\nbars_path = "bars.csv"\ncorporate_actions_path = "actions.csv"\ndelistings_path = "gone.csv"\n[[adapters]]\nid = "universe_csv"\n[adapters.config]\nmembership_path = "members.csv"\nuniverse_id = "top"\n')
    (tmp_path / "factor.yaml").write_text("factor: {id: mom, version: 1, family: momentum}\ninputs:\n  - {market: market.bar, field: close, window: 5d}\npit: {as_of_rule: knowledge_time, embargo: 1d}\ntransform:\n  - {op: pct_change}\n  - {op: winsorize, limits: [0.01, 0.99]}\n  - {op: cross_sectional_rank}\n  - {op: zscore}\n")
    return tmp_path


def test_bundle_from_csv_to_factor(spark, bundle, capsys):
    run = ["--config", str(bundle / "run.toml")]
    assert cli.main(["ingest", *run, "--backfill"], spark) == 0
    first = capsys.readouterr().out
    assert "market_csv: 63 written, 0 skipped, 42 resolved, 21 unresolved" in first and "universe_csv: 2 written" in first
    assert cli.main(["ingest", *run, "--backfill"], spark) == 0
    assert "market_csv: 0 written, 63 skipped" in capsys.readouterr().out
    assert cli.main(["store", *run], spark) == 0 and "65 rows from 1 runs" in capsys.readouterr().out
    snap = str(bundle / "snap")
    assert cli.main(["snapshot", *run, "--as-of", "2024-02-01", "--out", snap], spark) == 0
    assert cli.main(["factor", str(bundle / "factor.yaml"), "--snapshot", snap, "--dates", "2024-01-15,2024-01-18", "--out", str(bundle / "out.json")], spark) == 0
    out = json.loads((bundle / "out.json").read_text())
    assert out["diagnostics"]["2024-01-15"]["coverage"] == 3
    # closes known at the midnight before: bars up to the 12th; base five days earlier
    assert out["exposures"]["2024-01-15"]["ZZZ"] == pytest.approx(1.0) and out["exposures"]["2024-01-15"]["SEC-1"] == pytest.approx(-1.0)
    capsys.readouterr()
    assert cli.main(["universe", *run, "--as-of", "2024-01-10", "--universe", "top"], spark) == 0
    assert capsys.readouterr().out.split() == ["AAA", "ZZZ"]
    assert cli.main(["universe", *run, "--as-of", "2024-01-10", "--universe", "no"], spark) == 2
    assert cli.main(["backtest", "--factor", "x"], spark) == 2 and cli.main(["adapters"], spark) == 0
    assert cli.main(["factor", str(bundle / "factor.yaml"), "--validate-only"], spark) == 0


def _frame(spark, rows, now=NOW, manifest=None):
    cols = "signal_type string, native_entity string, event_time_ns long, knowledge_time_ns long, vintage_id string, payload string, series_id string"
    obs = market.envelope(spark.createDataFrame(rows, cols), adapter_id="t", source_id="t", suffix=F.col("vintage_id"))
    return guard.Guard().split(obs, manifest=manifest or guard.Manifest(), mode="backfill", now_ns=now)[0]


def test_store_appends_vintages_only(spark, tmp_path):
    s = store.SignalStore(spark, tmp_path / "s")
    one, two = ("x", "$AAA", 0, 10, "v1", '{"v":1}', ""), ("x", "$AAA", 0, 20, "v2", '{"v":2}', "")
    with pytest.raises(TypeError):
        s.write(s.audit(), run_id="r")
    assert s.write(_frame(spark, [one, one]), run_id="r") == store.WriteReceipt(1, 1, "r")
    assert s.write(_frame(spark, [one, two]), run_id="r") == store.WriteReceipt(1, 1, "r")
    with pytest.raises(store.StoreError, match="another content"):
        s.write(_frame(spark, [("x", "$AAA", 0, 10, "v1", '{"v":9}', ""), ("x", "$BBB", 0, 10, "v1", '{"v":9}', "")]), run_id="r")
    with pytest.raises(store.StoreError, match="two contents"):
        s.write(_frame(spark, [("x", "C", 0, 10, "v1", "1", ""), ("x", "C", 0, 10, "v1", "2", "")]), run_id="r")
    assert s.audit().count() == 2 and s.read(signal_type="x", as_of_ns=15).first()["vintage_id"] == "v1"
    ref = s.snapshot(as_of_ns=15, target_dir=tmp_path / "snap")
    snap = store.SnapshotStore(spark, tmp_path / "snap", expected_content_hash=ref.content_hash)
    assert [r["observation_id"] for r in snap.read(signal_type="x", as_of_ns=15).collect()] == [r["observation_id"] for r in s.read(signal_type="x", as_of_ns=15).collect()]
    assert s.snapshot(as_of_ns=15, target_dir=tmp_path / "again").content_hash == ref.content_hash
    with pytest.raises(store.StoreError):
        store.SnapshotStore(spark, tmp_path / "snap", expected_content_hash="0")
    with pytest.raises(store.StoreError):
        snap.write()
    with pytest.raises(store.StoreError):
        snap.vintages(as_of_ns=16)
    file = next((tmp_path / "snap" / "data").glob("*.parquet"))
    file.chmod(0o644)
    file.write_bytes(file.read_bytes() + b"x")
    with pytest.raises(store.StoreError, match="manifest"):
        store.SnapshotStore(spark, tmp_path / "snap")


def test_unpublished_batches_are_invisible(spark, tmp_path):
    s = store.SignalStore(spark, tmp_path / "s")
    s.write(_frame(spark, [("x", "A", 0, 10, "v1", "1", "")]), run_id="r")
    s._publish = lambda commit: (_ for _ in ()).throw(OSError("no space"))
    with pytest.raises(OSError):
        s.write(_frame(spark, [("x", "B", 0, 10, "v1", "1", "")]), run_id="r")
    assert store.SignalStore(spark, tmp_path / "s").audit().count() == 1


def test_poll_holds_future_rows_back_and_keeps_its_floor(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("k\n10\n20\n90\n")
    read = lambda: spark.read.option("header", True).schema("knowledge_time_ns long").csv(str(path))
    got = []
    sink = lambda df: got.append(sorted(r[0] for r in df.collect())) or True
    assert Poller(read, sink, tmp_path / "p.json").poll(now_ns=50)
    path.write_text("k\n10\n20\n15\n40\n90\n")
    assert Poller(read, sink, tmp_path / "p.json").poll(now_ns=60)
    assert Poller(read, sink, tmp_path / "p.json").poll(now_ns=70) is None
    Poller(read, sink, tmp_path / "p.json").poll(now_ns=100)
    assert got == [[10, 20], [40], [90]]


def test_whole_files_stream_into_the_store_once(spark, tmp_path):
    s = store.SignalStore(spark, tmp_path / "s")
    landing = tmp_path / "landing"

    def land(name, entity):
        _frame(spark, [("x", entity, 0, 10, "v1", "1", "")]).rows.write.parquet(str(landing / name))

    def sink(rows, batch):
        s.write(guard.Guard().split(rows, manifest=guard.Manifest(), mode="live", now_ns=NOW)[0], run_id=f"batch-{batch}")

    for name, entity in (("a", "A"), ("b", "B")):
        land(name, entity)
        query = stream_files(spark, str(landing / "*"), schema.OBSERVATION, sink, str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
    assert sorted((r["native_entity"], r["run_id"]) for r in s.audit().collect()) == [("A", "batch-0"), ("B", "batch-1")]


def test_csv_failures_are_loud(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("ticker,date,open,high,low,close\nA,2024-01-01,1,1,1,1\n")
    with pytest.raises(csv.CsvError, match="volume"):
        market.MarketCsv(spark, str(bad)).bars()
    bad.write_text("ticker,date,open,high,low,close,volume\nA,2024-01-01,1,1,1,much,1\n")
    with pytest.raises(PySparkException, match="close is not a double"):
        market.MarketCsv(spark, str(bad)).bars().collect()
    bad.write_text("ticker,date,open,high,low,close,volume,knowledge_time\nA,2024-01-01,1,1,1,1,1,2024-01-01T10:00:00\n")
    with pytest.raises(PySparkException, match="zone"):
        market.MarketCsv(spark, str(bad)).bars().collect()
    bad.write_text("ticker\nAAA\n")
    with pytest.raises(reference.SurvivorshipError):
        reference.memberships(spark, str(bad))
    bad.write_text("ticker,added_on,announced_on,removed_on,removed_announced_on\nA,2024-01-01,2023-12-01,2024-02-01,\n")
    with pytest.raises(ValueError, match="together"):
        reference.memberships(spark, str(bad))


def test_bar_is_known_at_the_close(spark, bundle):
    m = market.MarketCsv(spark, str(bundle / "bars.csv"))
    row = m.bars(["AAA"], (NS(2024, 1, 2), NS(2024, 1, 3))).collect()
    assert len(row) == 1 and row[0]["knowledge_time_ns"] - row[0]["event_time_ns"] == 21 * 3600 * 10**9
    assert m.capabilities()["entities"] == ["AAA", "BBB", "ZZZ"]
    assert json.loads(row[0]["payload"])["close"] == 102


def test_filings_and_facts(spark, tmp_path):
    recent = {"accessionNumber": ["a3", "a2", "a1"], "filingDate": ["2024-03-01", "2024-02-10", "2024-02-01"], "reportDate": ["2023-12-31", "2023-12-31", ""], "acceptanceDateTime": ["2024-03-01T10:00:00Z", "20240210100000", "2024-02-01T10:00:00Z"], "form": ["10-K/A", "10-K", "4"], "items": ["", "1.01, 2.02,", ""]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1", "filings": {"recent": recent, "files": []}}))
    item = lambda accn, val, end="2023-12-31": {"accn": accn, "end": end, "val": val, "form": "10-K"}
    facts = {"us-gaap": {"Assets": {"units": {"USD": [item("a2", 100.0), item("a3", 110.0), item("a2", 100.0), item("zz", 1.0)]}}, "Other": {"units": {"USD": [item("a2", 1.0)]}}}}
    (tmp_path / "f.json").write_text(json.dumps({"cik": "1", "facts": facts}))
    found = edgar.filings(spark.read.schema(f"cik string, {edgar.SUBMISSIONS}").json(str(tmp_path / "s.json")), forms=["10-K"])
    got = {r["accession"]: r for r in found.collect()}
    assert set(got) == {"a2", "a3"} and got["a3"]["amends_ref"] == "a2" and got["a2"]["amends_ref"] is None and got["a2"]["items"] == ["1.01", "2.02"]
    rows = edgar.facts(spark.read.schema(f"cik string, {edgar.FACTS}").json(str(tmp_path / "f.json")), found, concepts=["Assets"])
    assert {(r["accession"], r["value"], r["period_type"]) for r in rows.collect()} == {("a2", 100.0, "instant"), ("a3", 110.0, "instant")}
    config = {"submissions_path": str(tmp_path / "s.json"), "facts_path": str(tmp_path / "f.json"), "forms": ["10-K"], "concepts": ["Assets"]}
    assert adapters.get_adapter("sec_filings").read(spark, config, "r").count() == 4
    facts["us-gaap"]["Assets"]["units"]["USD"].append(item("a2", 101.0))
    (tmp_path / "f.json").write_text(json.dumps({"cik": "1", "facts": facts}))
    with pytest.raises(edgar.FilingError):
        edgar.facts(spark.read.schema(f"cik string, {edgar.FACTS}").json(str(tmp_path / "f.json")), found, concepts=["Assets"])


def test_definitions_are_checked(tmp_path):
    bad = {"factor": {"id": "f", "version": 1, "family": "x"}, "inputs": [{"signal": "a", "market": "b"}]}
    with pytest.raises(factors.FactorError):
        factors.Definition.parse(bad)
    with pytest.raises(factors.FactorError):
        factors.Definition.parse(bad | {"inputs": [{"signal": "a"}], "pit": {"as_of_rule": "event_time"}})
    with pytest.raises(factors.FactorError):
        factors.days("5w")
    with pytest.raises(backtest.BacktestError):
        backtest.BacktestSpec("f", "u", "h", date(2024, 1, 1), date(2024, 2, 1), costs_enabled=False)
    card = backtest.Scorecard(True, True, True, True, False)
    text = backtest.render_markdown(backtest.Report("Momentum", card, {"snapshot": "abc"}, {"coverage": 3}))
    assert "leakage suite passed: FAIL" in text
    with pytest.raises(backtest.BacktestError):
        backtest.render_markdown(backtest.Report("Guaranteed", card, {}))
    assert backtest.content_hash({"b": 1, "a": 2}) == backtest.content_hash({"a": 2, "b": 1})


def test_settings_and_limits(tmp_path):
    with pytest.raises(settings.SettingsError):
        settings.Settings.parse({"run": {"id": "x"}}, base=tmp_path)
    s = settings.Settings.parse({"run": {"id": "x"}, "store": {"path": "s"}, "rate_limits": {"n": {"requests_per_second": 8, "burst": 8}}, "adapters": [{"id": "market_csv", "config": {"bars_path": "b.csv", "close": "21:00"}}]}, base=tmp_path)
    assert s.adapters[0].config == {"bars_path": str(tmp_path / "b.csv"), "close": "21:00"} and s.rate_limits["n"].burst == 8
    with pytest.raises(ingest.IngestError):
        ingest.ingest(None, s, only="nope")
    now = [0.0]
    limiter = ratelimit.RateLimiter(2, 2, clock=lambda: now[0], sleep=lambda t: now.__setitem__(0, now[0] + t))
    for _ in range(4):
        limiter.acquire()
    assert now[0] == pytest.approx(1.0) == limiter.waited_seconds
    with pytest.raises(adapters.AdapterError):
        adapters.get_adapter("nope")
