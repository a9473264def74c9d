"""Streaming: batch parity and late data against the watermark."""
import os

import pandas as pd

from pathweave.streaming import runs as S

SCHEMA = "event_id long, ts timestamp, run_id long, status string, value double"


def _write_days(spark, root, frames):
    for i, rows in enumerate(frames):
        spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "ts", "run_id", "status", "value"]),
                              SCHEMA).coalesce(1).write.parquet(os.path.join(root, f"part{i:02d}"))


def test_late_rows_are_dropped_in_append_mode(spark, scratch):
    d = lambda s: pd.Timestamp(s)
    frames = [
        [(1, d("2024-01-01 10:00"), 1, "complete", 1.0), (2, d("2024-01-01 11:00"), 2, "refused", 2.0)],
        [(3, d("2024-01-05 09:00"), 3, "complete", 3.0)],   # watermark moves to 01-04 09:00
        [(4, d("2024-01-05 10:00"), 4, "complete", 4.0)],   # the 01-01 window is finalised and evicted
        [(5, d("2024-01-01 12:00"), 5, "complete", 5.0),    # late: its window is already closed
         (6, d("2024-01-05 11:00"), 6, "complete", 6.0)],
        [(7, d("2024-01-09 10:00"), 7, "complete", 7.0)],
    ]
    root = os.path.join(scratch, "events")
    _write_days(spark, root, frames)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(root)
    agg = S.windowed_rates(stream, ["status"], watermark="1 day")
    out = S.run_available_now(agg, "late-test", mode="append", base=os.path.join(scratch, "run"))
    got = {(r.window.start.strftime("%m-%d"), r.status): r.n for r in out.collect()}
    # 01-01 window closed with only the two on-time rows; the late row never counted.
    assert got[("01-01", "complete")] == 1 and got[("01-01", "refused")] == 1
    assert got[("01-05", "complete")] == 3
    assert sum(1 for k in got if k[0] == "01-01") == 2  # no second emission of the closed window


def test_idempotent_ingest_drops_duplicates(spark, scratch):
    d = pd.Timestamp("2024-01-01 10:00")
    frames = [[(1, d, 1, "complete", 1.0), (2, d, 2, "complete", 1.0)],
              [(1, d, 1, "complete", 1.0), (3, d, 3, "failed", 1.0)]]
    root = os.path.join(scratch, "dups")
    _write_days(spark, root, frames)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(root)
    out = S.run_available_now(S.idempotent_ingest(stream), "dup-test", base=os.path.join(scratch, "run2"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]


def test_live_status_keeps_latest(spark, scratch):
    t = pd.Timestamp
    frames = [[(1, t("2024-01-01 10:00"), 1, "running", 0.0), (2, t("2024-01-01 10:00"), 2, "running", 0.0)],
              [(3, t("2024-01-01 11:00"), 1, "complete", 0.0)],
              [(4, t("2024-01-01 09:00"), 2, "failed", 0.0), (5, t("2024-01-01 12:00"), 2, "refused", 0.0)]]
    root = os.path.join(scratch, "status")
    _write_days(spark, root, frames)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(root)
    ledger = S.live_status(stream, "live-test")
    assert {r.run_id: r.status for r in ledger.collect()} == {1: "complete", 2: "refused"}


def test_live_status_resumes_from_its_folder(spark, scratch):
    t = pd.Timestamp
    root = os.path.join(scratch, "resume-events")
    ledger_root = os.path.join(scratch, "resume-ledger")

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1) \
            .option("recursiveFileLookup", "true").parquet(root)

    _write_days(spark, root, [[(1, t("2024-01-01 10:00"), 1, "running", 0.0),
                               (2, t("2024-01-01 10:00"), 2, "running", 0.0)]])
    first = S.live_status(stream(), "resume", root=ledger_root, buckets=4)
    assert {r.run_id: r.status for r in first.collect()} == {1: "running", 2: "running"}
    # new files arrive; the job restarts on the same folder and checkpoint
    spark.createDataFrame(pd.DataFrame([(3, t("2024-01-02 10:00"), 2, "complete", 0.0),
                                        (4, t("2024-01-02 11:00"), 3, "failed", 0.0)],
                                       columns=["event_id", "ts", "run_id", "status", "value"]), SCHEMA) \
        .coalesce(1).write.parquet(os.path.join(root, "part99"))
    second = S.live_status(stream(), "resume", root=ledger_root, buckets=4)
    assert {r.run_id: r.status for r in second.collect()} == {1: "running", 2: "complete", 3: "failed"}


def test_a_rerun_without_new_files_returns_the_table(spark, scratch):
    d = pd.Timestamp("2024-01-01 10:00")
    root = os.path.join(scratch, "once")
    _write_days(spark, root, [[(1, d, 1, "complete", 1.0), (2, d, 2, "complete", 1.0)]])

    def again():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(root)
        return S.run_available_now(S.idempotent_ingest(stream), "again", base=os.path.join(scratch, "again"))

    assert [sorted(r.event_id for r in again().collect()) for _ in range(2)] == [[1, 2], [1, 2]]


def _feed(spark, root):
    """40 days of events in arrivals of five days; some rows come two or three arrivals late."""
    start = pd.Timestamp("2024-03-01 00:30")
    rows = [(i, start + pd.Timedelta(hours=i), i % 50, "complete" if i % 4 else "refused", float(i % 7)) for i in range(960)]
    arrival = [i // 120 + (2 if i % 31 == 5 else 3 if i % 31 == 9 else 0) for i in range(960)]
    df = spark.createDataFrame(pd.DataFrame([(*r, a) for r, a in zip(rows, arrival)],
                                            columns=["event_id", "ts", "run_id", "status", "value", "arrival"]), SCHEMA + ", arrival int")
    S.write_arrivals(df, "arrival", root)
    return rows


def test_final_windows_late_rows_and_open_windows_hold_every_row(spark, scratch):
    root = os.path.join(scratch, "feed")
    rows = _feed(spark, root)
    stream = lambda: S.file_stream(spark, root, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    reports = []
    final = S.run_available_now(S.windowed_rates(stream(), ["status"], watermark="4 days"), "final", base=os.path.join(scratch, "final"),
                                progress=reports).collect()
    late = S.late_rows(stream(), "late", watermark="4 days", base=os.path.join(scratch, "late")).collect()
    assert len({(r.window.start, r.status) for r in final}) == len(final)  # each window once
    last = max(r[1] for r in rows) - pd.Timedelta(days=4)
    gone = {r.event_id for r in late}
    assert gone and all(i % 31 in (5, 9) for i in gone)
    want = {}
    for i, ts, _, status, _ in rows:
        if i not in gone and ts.floor("D") + pd.Timedelta(days=1) <= last:
            want[ts.floor("D"), status] = want.get((ts.floor("D"), status), 0) + 1
    assert {(pd.Timestamp(r.window.start), r.status): r.n for r in final} == want
    # The state holds the windows of the delay and of a batch, never the history.
    kept = [op["numRowsTotal"] for p in reports for op in p["stateOperators"]]
    assert max(kept) <= 2 * (5 + 4 + 5 + 2) and kept[-1] <= 2 * 6
    # No batch touched what an earlier one had written.
    folders = sorted(os.listdir(os.path.join(scratch, "final", "out")))
    assert len(folders) > 3 and all(f.startswith("batch=") for f in folders)


def test_a_stream_without_late_rows_gives_an_empty_table(spark, scratch):
    root = os.path.join(scratch, "punctual")
    _write_days(spark, root, [[(1, pd.Timestamp("2024-01-01 10:00"), 1, "complete", 1.0)]])
    stream = S.file_stream(spark, root, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    assert S.late_rows(stream, "none", base=os.path.join(scratch, "none")).count() == 0
