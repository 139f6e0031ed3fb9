import json

import pytest

from lagwise.sources import series as S
from lagwise.sources import sinks
from lagwise.sources.observations import parse_dates


def test_csv_json_and_universe(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("DATE,abc\n2026-01-01,1\n2026-01-02,.\n2026-01-03,4\n2026-01-04,8\n")
    (tmp_path / "D.csv").write_text("date,D\n" + "".join(f"2026-01-0{i},{i}\n" for i in range(1, 6)))
    got = S.series_csv(spark, f"{tmp_path}/ABC.csv", "ABC", "2026-01-02").orderBy("date").collect()
    assert [r.value for r in got] == [None, 4.0, 8.0]
    with pytest.raises(KeyError):
        S.series_csv(spark, f"{tmp_path}/ABC.csv", "nope")
    client = S.SeriesClient(spark, folder=str(tmp_path))
    nodes = [{"id": "a", "source": "series", "series_id": "ABC", "transform": "difference"}, {"id": "d", "source": "series", "series_id": "D"}, {"id": "z", "source": "other", "series_id": "Z"}]
    panel, meta = S.universe(client, nodes)
    assert [(r.a, r.d) for r in panel.orderBy("date").collect()] == [(4.0, 4.0)] and meta.count() == 2
    with pytest.raises(ValueError):
        S.universe(client, nodes[2:])
    (tmp_path / "o.json").write_text(json.dumps({"observations": [{"date": "2026-01-01", "value": "1.5"}, {"date": "2026-01-02", "value": "."}]}))
    assert [r.value for r in S.series_json(spark, f"{tmp_path}/o.json").orderBy("date").collect()] == [1.5, None]
    api = S.SeriesClient(spark, fetch=lambda url, p: json.dumps({"observations": [{"date": "2026-01-01", "value": p["observation_start"][:4]}]}), key="k")
    assert api.mode == "api" and api.series("X", "2025-01-01").first().value == 2025.0
    with pytest.raises(ValueError):
        S.SeriesClient(spark, mode="api", key_variable="NOT_SET_HERE")


def test_pages_retry_and_end():
    asked, slept = [], []

    def ask(offset, size):
        asked.append(offset)
        if len(asked) == 2:
            raise S.Retry
        return {"features": [{"attributes": {"n": offset + i}} for i in range(2 if offset < 4 else 1)], "exceededTransferLimit": True}

    assert [r["n"] for r in S.pages(ask, 2, sleep=slept.append)] == [0, 1, 2, 3, 4] and slept == [1.5]
    with pytest.raises(RuntimeError):
        list(S.pages(lambda o, n: {"error": "no"}, 2))


def test_download_is_resumable(spark, tmp_path):
    calls = []

    def ask_for(entity, year):
        def ask(offset, size):
            calls.append((entity, year))
            rows = [{"date": 1767225600000 + 86400000 * i, "portid": entity, "portname": entity, "n": v} for i, v in ((0, 1), (1, 2), (1, 3))]
            return {"features": [{"attributes": r} for r in rows], "exceededTransferLimit": False}

        return ask

    for _ in range(2):
        got = S.download(spark, ask_for, ["p1", "p2"], [2026], str(tmp_path / "cache"), ["date", "portid", "portname", "n"])
        assert sorted((r.portid, str(r.date), r.n) for r in got.collect()) == [(p, d, v) for p in ("p1", "p2") for d, v in (("2026-01-01", 1.0), ("2026-01-02", 3.0))]
    assert len(calls) == 2


def test_dates_of_either_kind(spark):
    text = spark.createDataFrame([("2026-01-01", "x"), ("bad", "2")], "date string, m string")
    assert [(str(r.date), r.m) for r in parse_dates(text, ["m"]).collect()] == [("2026-01-01", None)]
    with pytest.raises(ValueError):
        parse_dates(text.filter("date = 'bad'"), ["m"])


def test_sinks_round_trip(spark, tmp_path):
    import datetime as dt

    rows = [(1, "ar", dt.date(2026, 1, 1), "x", 1.0, 2.0), (5, "ar", dt.date(2026, 1, 1), "x", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "horizon int, model string, date date, target string, actual double, prediction double")
    report = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    for form in ("parquet", "csv"):
        sinks.evidence({"forecasts": df}, f"{tmp_path}/{form}", report, form)
        assert sorted(map(tuple, sinks.forecasts(spark, f"{tmp_path}/{form}", form).collect())) == rows
    assert [r.value for r in spark.read.text(f"{tmp_path}/csv/RESULTS").collect()] == ["a", "b"]
    (tmp_path / "f.txt").write_text("abc")
    assert sinks.manifest(spark, [f"{tmp_path}/f.txt"], "2026-01-01", "2026-02-01").first().sha256.startswith("ba7816bf")


def test_cli_demo_and_entry(spark, tmp_path):
    from lagwise import cli

    got = cli.main(["online-demo", "--out", f"{tmp_path}/out"], spark)
    assert {r.model for r in got.collect()} >= {"financial_core", "online_fixed_share"}
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
