import datetime as dt

from pyspark.sql import functions as F

from treeshift.operators import audit as A, telemetry as T
from treeshift.streaming import telemetry_stream as S

COMMANDS = [
    ("git diff main..HEAD", "advise", "change_manifest"),
    ("git diff a...b -- src", "advise", "change_manifest"),
    ("git diff ..", "silent", None),
    ("git diff", "silent", None),
    ("git log -Sfoo", "advise", "function_context"),
    ("git log -G 'a b' x..y", "advise", "function_context"),
    ("git log a..b | head -3", "advise", "commit_history"),
    ("(cd /tmp; git show HEAD)", "advise", "file_snapshots"),
    ("echo $(git blame x.rs)", "advise", "file_snapshots"),
    ("cd x && gh pr diff 12", "block", "gh_pr_diff"),
    ("git log a..b; gh pr diff", "block", "gh_pr_diff"),
    ("mcp__github__get_commit owner=x", "block", "mcp__github__get_commit"),
    ('echo "git diff a..b"', "silent", None),
    ("echo hi # git diff a..b", "silent", None),
    ("cat <<EOF\ngit diff a..b\nEOF", "silent", None),
    ("cat <<'EOF' > f\ngit diff a..b\nEOF\ngit show x", "advise", "file_snapshots"),
    ("cat <<-EOF\n\tgit diff a..b\n\tEOF\ngit blame x", "advise", "file_snapshots"),
    ("cat <<EOF; git show x\nbody", "silent", None),
    ("echo 'open\ngit show x", "advise", "file_snapshots"),
    ("git push && git status", "silent", None),
    ("", "silent", None),
]


def test_commands(spark):
    df = spark.createDataFrame(
        [(i, "Bash", c) for i, (c, _, _) in enumerate(COMMANDS)], "id int, tool_name string, command string"
    )
    got = {r.id: (r.decision, r.target) for r in A.decide(df).collect()}
    assert got == {i: (d, t) for i, (_, d, t) in enumerate(COMMANDS)}


def test_other_tools_and_echo(spark):
    df = spark.createDataFrame(
        [("mcp__github__list_commits", ""), ("Read", "git diff a..b"), ("Bash", 'git diff "$BASE".."$HEAD"')],
        "tool_name string, command string",
    )
    rows = {r.tool_name: r for r in A.advice_text(A.decide(df)).collect()}
    assert rows["mcp__github__list_commits"].decision == "block"
    assert rows["Read"].decision == "silent" and rows["Read"].advice is None
    assert rows["Bash"].advice.endswith("You ran: git diff $BASE..$HEAD")


def test_long_command(spark):
    command = "echo '" + "x \\\" " * 20_000 + "' && git diff a..b"
    df = spark.createDataFrame([("Bash", command)], "tool_name string, command string")
    assert A.decide(df).first().target == "change_manifest"


def test_bucket_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (30000.0,), (30001.0,)], "v double")
    got = [r[0] for r in df.select(T.bucket_of(F.col("v"), T.DURATION_BUCKETS)).collect()]
    assert got == [1.0, 1.0, 2.0, 30000.0, float("inf")]


def test_redaction_keeps_no_raw_text(spark):
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(ts, "change_manifest", "error", "/home/me/secret", "0123456789abcdef", "HEAD", "could not resolve x", "odd", 1.0, 2)],
        "ts timestamp, tool string, status string, repo_path string, base_ref string, head_ref string, error string, "
        "truncation_reason string, duration_ms double, bytes long",
    )
    row = T.redact_requests(df).first().asDict()
    assert row["ref_pattern"] == "sha" and row["error_kind"] == "ref_not_found" and row["truncation_reason"] == "unknown"
    assert not any("secret" in str(v) or "0123456789abcdef" in str(v) for v in row.values() if v != row["repo_hash"])


def test_stream_drops_late_rows_and_matches_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, tool string, status string, error string, duration_ms double, bytes long"

    def batch(minutes):
        rows = [(start + dt.timedelta(minutes=m), "t", "success", None, 3.0, 10) for m in minutes]
        return spark.createDataFrame(rows, schema).coalesce(1)

    source = tmp_path / "in"
    query = None
    for minutes in ([0, 1, 6], [30, 31], [2, 32], [60, 61]):  # the 2 comes after its window has closed
        batch(minutes).write.mode("append").parquet(str(source))
        requests = S.read_requests(spark, str(source), schema, 1)
        query = S.write_metrics(
            S.request_rates(requests), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True
        )
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("window_start").agg(F.sum("n").alias("n"))
    got = {int((r.window_start - start).total_seconds() // 60): r.n for r in out.collect()}
    assert got == {0: 2, 5: 1, 30: 3}


def test_metrics_of_open_windows_survive_a_restart(spark, tmp_path):
    schema = "ts timestamp, tool string, status string, duration_ms double, bytes long"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    start = dt.datetime(2024, 1, 1)
    batches = [
        [(start + dt.timedelta(minutes=m), "t", "success", 5.0, m) for m in minutes]
        for minutes in (range(0, 12), range(8, 20), (19, 21))
    ]

    def run():
        S.upsert_metrics(S.request_rates(S.read_requests(spark, source, schema, 1)), out, state, available_now=True).awaitTermination()

    def latest():
        return sorted((str(r.window_start), r.n, r.bytes) for r in S.latest_metrics(spark, out).collect())

    seen = []
    for rows in batches:  # each run begins where the one before has ended
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run()
        seen += rows
        want = spark.createDataFrame(seen, schema).groupBy(F.window("ts", "5 minutes").alias("w")).agg(
            F.count("*").alias("n"), F.sum("bytes").alias("bytes")
        )
        assert latest() == sorted((str(r.w.start), r.n, r.bytes) for r in want.collect())
    run()
    before = latest()
    S.compact_metrics(spark, out, str(tmp_path / "compact"))
    assert sorted((str(r.window_start), r.n, r.bytes) for r in S.latest_metrics(spark, str(tmp_path / "compact")).collect()) == before


def test_reasons_of_truncation(spark):
    page = "range_id long, has_next boolean, trimmed boolean"
    manifests = spark.createDataFrame([(1, True, False), (2, False, False), (3, False, True)], page)
    contexts = spark.createDataFrame([(1, False, False), (2, False, False), (3, True, True)], page)
    files = spark.createDataFrame([(1, False), (2, True), (2, False), (4, True)], "range_id long, truncated boolean")
    got = {r.range_id: (r.truncated, r.reasons) for r in T.response_truncated(manifests, contexts, files).collect()}
    assert got == {
        1: (True, ["paginated"]), 2: (True, ["max_file_size"]), 3: (True, ["paginated", "token_budget"]), 4: (True, ["max_file_size"])
    }
