"""Files read and written on the fly, and the streaming forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.sources import recordings, sessions
from fieldscope.streaming.activity import stream_bin_stats


def test_split_recording_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (1000, 2))
    paths = []
    for i, (a, b) in enumerate(((0, 300), (300, 650), (650, 1000))):
        paths.append(str(tmp_path / f"{'cab'[i]}.wav"))
        (tmp_path / f"{'cab'[i]}.wav").write_bytes(recordings.wav_bytes(x[a:b], 100.0))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    heads = recordings.file_frames(spark, [*paths, str(tmp_path / "bad.wav")]).orderBy("part").collect()
    assert [r.frames for r in heads] == [300, 350, 350, None] and heads[0].rate == 100
    blocks = recordings.read_recording(spark, "r", paths, 128)
    got = sorted(blocks.collect(), key=lambda r: (r.channel, r.block))
    assert [len(r.samples) for r in got][:8] == [128] * 7 + [104]
    for c in (0, 1):
        assert np.allclose(np.concatenate([r.samples for r in got if r.channel == c]), x[:, c], atol=1e-9)
    content = recordings.export_span(blocks, 250, 700, 100.0).first().content
    assert np.allclose(recordings.wav_samples(bytes(content)), x[250:700], atol=1e-8)
    assert recordings.export_span(blocks, 5000, 6000, 100.0).collect() == []
    with pytest.raises(ValueError):
        recordings.read_recording(spark, "r", [*paths, str(tmp_path / "bad.wav")], 128)
    with pytest.raises(ValueError):
        recordings.wav_bytes(x, 44.1)
    loud = recordings.wav_bytes(2 * x, 100.0)
    assert recordings.wav_header(loud)["float"] and np.allclose(recordings.wav_samples(loud), 2 * x, atol=1e-6)


def test_session_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("trial_number,treatment,recording_time_s,recording_ended_s,pulses_emitted,extra\n1,volley,10,20,5,x\n2,baseline,30,,,x\n3,silence,40,50,2,x\n4,,60,70,,x\n5,volley,90,80,1,x\n6,volley,,5,1,x\n7,volley,nan,5,1,x\n")
    rows, problems = sessions.read_session_csv(spark, "trials", str(tmp_path / "t.csv"))
    p = problems.first()
    assert p.unplaced == 2 and "time_s" in p.missing and "extra" not in rows.columns and rows.schema["polarity"].dataType.simpleString() == "tinyint"
    spans, bad = sessions.trial_layers(rows)
    got = {r.trial_number: (r.treatment, r.t0, r.t1, r.open_right) for r in spans.collect()}
    assert got == {1: ("volley", 10.0, 20.0, False), 2: ("baseline", 30.0, 30.0, True), 3: ("silence", 40.0, 50.0, False), 5: ("volley", 90.0, 80.0, False)}
    assert tuple(bad.first()) == (1, 1)
    pulses = spark.createDataFrame([(11.0, "volley"), (25.0, "volley"), (30.0, "baseline"), (45.0, "localization"), (5.0, "localization"), (None, "volley")], "recording_time_s double, pulse_type string")
    broken = {r.rule: r.broken for r in sessions.check_partition(pulses, rows).collect()}
    assert broken == {"volley outside volley": 1, "baseline outside baseline": 0, "localization inside a trial": 1, "pulse in silence": 1, "silence emitted": 1}
    told = pulses.selectExpr("*", "1L as trial_number", "cast(null as string) as match_status", "case when recording_time_s > 20 then 1.0 end as detected_time_s")
    assert {(r.layer, r.observed) for r in sessions.pulse_layers(told).collect()} == {("volley", False), ("volley", True), ("resting", True), ("resting", False)}
    events = spark.createDataFrame([(0, None), (3, None), (None, False), (None, True)], "records_lost long, radio_link_up boolean")
    assert sessions.fault_events(events).count() == 2


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text('category,kind,channel,t_start_s,t_end_s,f_low_hz,f_high_hz,note\npulse,span,0,5,3,900,100,"a, ""b"""\ncall,point,,1,9,,,\n,span,0,1,2,,,\nx,span,0,zzz,2,,,\ny,span,1,2,,,,\n')
    labels, problems = sessions.read_labels(spark, str(tmp_path / "l.csv"))
    got = {r.category: r for r in labels.collect()}
    assert problems.first().dropped == 2 and set(got) == {"pulse", "call", "y"}
    assert (got["pulse"].t0, got["pulse"].t1, got["pulse"].f0, got["pulse"].f1, got["pulse"].note) == (3, 5, 100, 900, 'a, "b"')
    assert got["call"].t1 is None and got["y"].kind == "point"
    text = {r.category: r for r in sessions.label_rows(labels, ["call"]).collect()}
    assert set(text) == {"pulse", "y"} and (text["pulse"].t_start_s, text["pulse"].f_high_hz, text["y"].t_end_s) == ("3.000000", "900.000", None)


def test_review_items(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"kind":"join","confidence":0.4,"ids":[1,2],"new":1}\n{"kind":"track","confidence":2,"ids":[1]}\n{"confidence":0.1,"ids":[1]}\n{"kind":"track","confidence":0.5}\n')
    items, problems = sessions.read_review_items(spark, str(tmp_path / "r.json"))
    assert [r.ids for r in items.collect()] == [[1, 2]] and problems.first().malformed == 3


def test_streaming_bins_equal_the_batch(spark, tmp_path):
    rows = spark.range(500).selectExpr("id % 3 as channel", "timestamp_seconds(id * 37) as ts", "cast(id % 17 as double) as value")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = stream_bin_stats(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["channel"])
    run = stream.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {(r.channel, r.window.start): (r.n, r.total, r.maximum) for r in spark.table("bins").collect()}
    want = rows.groupBy("channel", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("maximum")).collect()
    assert got == {(r.channel, r.window.start): (r.n, r.total, r.maximum) for r in want}
