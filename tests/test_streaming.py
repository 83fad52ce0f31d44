import json
import random
from datetime import datetime, timedelta, timezone

from lexiforge.streaming import watch

SCHEMA = "seq long, ts timestamp, text string, other int"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def line(seq, second, text):
    return {"seq": seq, "ts": (START + timedelta(seconds=second)).isoformat(), "text": text, "other": seq * 3}


def test_stream_of_late_and_repeated_lines_is_the_batch(spark, tmp_path):
    rng = random.Random(9)
    texts = [c * 210 for c in "abcdefgh"] + ["short", "", None]
    rows = [line(i, i, rng.choice(texts) if i % 3 else f"only {i}") for i in range(2400)]
    # Rows come up to 40 seconds late and some twice; the last row closes all windows.
    sent = sorted(rows + rng.sample(rows, 300), key=lambda r: r["seq"] + rng.uniform(0, 40))
    (tmp_path / "in").mkdir()
    batches = [sent[i : i + 270] for i in range(0, len(sent), 270)] + [[line(10**6, 10**6, "end")]]
    for i, b in enumerate(batches):
        (tmp_path / "in" / f"{i:03}.json").write_text("".join(json.dumps(r) + "\n" for r in b))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{tmp_path}/in")
    out = watch.dedup_stream_within(source, "seq", "ts", "60 seconds", "60 seconds")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert query.awaitTermination(240)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["stateOperators"]]
    got = spark.read.parquet(f"{tmp_path}/out").filter("text <> 'end' or text is null")
    batch = watch.dedup_stream_within(spark.read.schema(SCHEMA).json(f"{tmp_path}/in"), "seq", "ts", "60 seconds", "60 seconds").filter("text <> 'end' or text is null")
    assert got.columns == ["seq", "ts", "text", "other"]
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in batch.collect())
    first = {}
    for r in rows:
        k = (r["seq"] // 60, None if r["text"] is None else r["text"][:200])
        first[k] = min(first.get(k, r["seq"]), r["seq"])
    assert sorted(first.values()) == sorted(r.seq for r in got.collect())
    # Windows that are open: those of a batch and of the rows that may still come.
    assert max(sizes) < len(first) / 2
