"""The change-log stream: windows, repeated ids, restarts."""

import json

from hawthorn.streaming import changelog


def test_hourly(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda i, ts, kind: json.dumps({"event_id": i, "ts": ts, "user_id": 1, "event_type": kind, "value": 1.0, "props": "{}"})
    (source / "a.json").write_text("\n".join([line(1, "2024-01-01T00:10:00Z", "save"), line(1, "2024-01-01T00:10:00Z", "save"), line(2, "2024-01-01T00:50:00Z", "save")]))
    run = lambda: changelog.append(changelog.hourly(changelog.read(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "check"))
    run()
    (source / "b.json").write_text(line(3, "2024-01-01T09:00:00Z", "save"))
    run()
    (source / "c.json").write_text(line(4, "2024-01-01T19:00:00Z", "save"))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.hour.hour, r.n) for r in rows} >= {(0, 2)}
