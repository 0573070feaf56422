"""Telemetry (batch and stream) and the command audit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from treeshift import fixtures as fx
from treeshift.catalog.files import ERROR, PATTERN, REASON
from treeshift.catalog.registry import joined, query, sql
from treeshift.operators import audit as A, telemetry as T
from treeshift.session import ensure_checkpoint_dir
from treeshift.streaming import telemetry_stream as S

MODE = f"CASE WHEN head_ref IS NULL THEN 'worktree' ELSE {PATTERN} END"
STAMP = "yyyy-MM-dd HH:mm:ss"


def counted(name: str, fn, oracle: str) -> None:
    @query(name, sql(["requests"], oracle))
    def run(spark, sf):
        return fn(fx.view(spark, sf, "requests"))


def text_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.date_format(column, STAMP))


counted("requests_total", T.requests_total, "SELECT tool, status, count(*) AS requests FROM requests GROUP BY ALL")
counted("sessions_started", T.sessions_started, "SELECT count(DISTINCT session_id) AS sessions FROM requests")
counted(
    "errors_total", T.errors_total,
    f"SELECT tool, {ERROR} AS error_kind, count(*) AS errors FROM requests WHERE error IS NOT NULL GROUP BY ALL",
)
counted("ref_pattern_counts", T.ref_pattern_counts, f"SELECT {MODE} AS ref_pattern, count(*) AS requests FROM requests GROUP BY ALL")
counted(
    "change_scope_counts", T.change_scope_counts,
    "SELECT change_scope, count(*) AS requests FROM requests WHERE change_scope IS NOT NULL GROUP BY ALL",
)
counted(
    "languages_analyzed", T.languages_analyzed,
    "SELECT language, count(*) AS requests FROM requests WHERE language <> 'unknown' GROUP BY ALL",
)
counted(
    "truncated_counts", T.truncated_counts,
    f"SELECT tool, {REASON} AS reason, count(*) AS responses FROM requests WHERE truncation_reason IS NOT NULL GROUP BY ALL",
)
counted("pages_requested", T.pages_requested, "SELECT tool, count(*) AS pages FROM requests WHERE has_cursor GROUP BY ALL")


def _buckets(bounds: list[float], value: str) -> str:
    cases = " ".join(f"WHEN {value} <= {b} THEN {b}" for b in bounds)
    return f"CAST(CASE {cases} ELSE 'Infinity'::DOUBLE END AS DOUBLE)"


def _histogram(name: str, fn, value: str, bounds: list[float], label: str = "tool", where: str = "true") -> None:
    counted(
        name, fn,
        f""", h AS (SELECT {label}, {_buckets(bounds, value)} AS le, count(*) AS n FROM requests WHERE {where} GROUP BY ALL)
        SELECT {label}, le, n, CAST(sum(n) OVER (PARTITION BY {label} ORDER BY le) AS BIGINT) AS cumulative FROM h""",
    )


_histogram("duration_histogram", T.duration_histogram, "duration_ms", T.DURATION_BUCKETS)
_histogram("bytes_histogram", T.bytes_histogram, "bytes", T.SIZE_BUCKETS)
_histogram("tokens_histogram", T.tokens_histogram, "floor(bytes / 4)", T.SIZE_BUCKETS)
_histogram("files_histogram", T.files_histogram, "files", T.COUNT_BUCKETS)
_histogram("functions_histogram", T.functions_histogram, "functions", T.COUNT_BUCKETS)
_histogram(
    "planned_timing_histograms", lambda r: T.timing_histogram(r, "language"), "duration_ms", T.DURATION_BUCKETS,
    "language", "language IS NOT NULL",
)


@query(
    "requests_24h_by_tool",
    sql(["requests"], "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, tool, count(*) AS requests FROM requests GROUP BY ALL"),
)
def requests_24h_by_tool(spark, sf):
    return text_time(T.requests_24h_by_tool(fx.view(spark, sf, "requests")), "day")


def _bucket_quantile(value: str, bounds: list[float], minutes: int, q: float, name: str) -> str:
    lowers = " ".join(f"WHEN {high} THEN {low}" for low, high in zip([0.0, *bounds], bounds))
    return f""", h AS (SELECT time_bucket(INTERVAL {minutes} MINUTE, ts) AS w, tool, {_buckets(bounds, value)} AS le,
      count(*) AS n FROM requests GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY w, tool ORDER BY le) AS upto,
      CAST({q} AS DOUBLE) * sum(n) OVER (PARTITION BY w, tool) AS rank FROM h)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, tool,
      round(CASE WHEN le = 'Infinity'::DOUBLE THEN {bounds[-1]} ELSE
        (CASE le {lowers} END) + (le - (CASE le {lowers} END)) * (rank - (upto - n)) / n END, 6) AS {name}
    FROM c WHERE upto >= rank AND upto - n < rank"""


@query("p95_duration_5m", sql(["requests"], _bucket_quantile("duration_ms", T.DURATION_BUCKETS, 5, 0.95, "p95")))
def p95_duration_5m(spark, sf):
    found = T.p95_duration_5m(fx.view(spark, sf, "requests"))
    return text_time(found, "window_start").withColumn("p95", F.round("p95", 6))


@query("median_tokens_1h", sql(["requests"], _bucket_quantile("floor(bytes / 4)", T.SIZE_BUCKETS, 60, 0.5, "median_tokens")))
def median_tokens_1h(spark, sf):
    found = T.median_tokens_1h(fx.view(spark, sf, "requests"))
    return text_time(found, "window_start").withColumn("median_tokens", F.round("median_tokens", 6))


@query(
    "p95_duration_exact",
    sql(["requests"], """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, tool,
      round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM requests GROUP BY ALL"""),
)
def p95_duration_exact(spark, sf):
    found = T.exact_quantile(fx.view(spark, sf, "requests"), "duration_ms", "5 minutes", 0.95, "p95")
    return text_time(found, "window_start").withColumn("p95", F.round("p95", 6))


@query(
    "redact_requests",
    sql(["requests"], f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, tool, status, sha256(repo_path) AS repo_hash,
      {MODE} AS ref_pattern, {ERROR} AS error_kind, {REASON} AS truncation_reason, duration_ms, bytes FROM requests"""),
)
def redact_requests(spark, sf):
    return text_time(T.redact_requests(fx.view(spark, sf, "requests")), "ts")


@query(
    "response_truncated",
    sql(["requests"], """SELECT event_id AS range_id, event_id % 4 = 0 OR event_id % 6 = 1 OR event_id % 9 = 0
      OR event_id % 5 = 2 AS truncated, concat_ws('|', CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN 'paginated' END,
        CASE WHEN event_id % 6 = 1 THEN 'token_budget' END, CASE WHEN event_id % 5 = 2 THEN 'max_file_size' END) AS reasons FROM requests"""),
)
def response_truncated(spark, sf):
    requests = fx.view(spark, sf, "requests")
    key = F.col("event_id").alias("range_id")
    manifests = requests.select(
        key, (F.col("event_id") % 4 == 0).alias("has_next"), (F.col("event_id") % 6 == 1).alias("trimmed")
    )
    contexts = requests.select(key, F.col("has_cursor").alias("has_next"), F.lit(False).alias("trimmed"))
    snapshots = requests.select(key, (F.col("event_id") % 5 == 2).alias("truncated"))
    found = T.response_truncated(manifests, contexts, snapshots)
    return found.withColumn("reasons", joined("reasons"))


@query(
    "telemetry_stream",
    sql(["requests"], f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, tool, status,
      {_buckets(T.DURATION_BUCKETS, 'duration_ms')} AS le, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes
      FROM requests GROUP BY ALL"""),
)
def telemetry_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events.createOrReplaceTempView("treeshift_event_stream")
    requests = spark.sql(fx.VIEWS["requests"](fx.spark_dialect()).replace("@events@", "treeshift_event_stream"))
    requests = requests.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = S.upsert_metrics(S.request_rates(requests), f"{folder}/out", f"{folder}/state", available_now=True)
    stream.awaitTermination()
    return text_time(S.latest_metrics(spark, f"{folder}/out"), "window_start")


# --- command audit ----------------------------------------------------------------------

KIND = "id % 11"
DECISION = f"""CASE {KIND} WHEN 0 THEN 'advise' WHEN 1 THEN 'advise' WHEN 2 THEN 'advise' WHEN 4 THEN 'advise'
  WHEN 5 THEN 'block' WHEN 6 THEN 'advise' WHEN 9 THEN 'block' ELSE 'silent' END"""
TARGET = f"""CASE {KIND} WHEN 0 THEN 'change_manifest' WHEN 1 THEN 'function_context' WHEN 2 THEN 'commit_history'
  WHEN 4 THEN 'file_snapshots' WHEN 5 THEN 'gh_pr_diff' WHEN 6 THEN 'file_snapshots' WHEN 9 THEN 'mcp__github__get_commit' END"""
# the simple commands in each text, tokens apart by a blank
PIECES = f"""CASE {KIND} WHEN 0 THEN ['git diff main..HEAD'] WHEN 1 THEN ['git log -S term']
  WHEN 2 THEN ['cd /tmp', 'git log a..b', 'head'] WHEN 3 THEN ['git status'] WHEN 4 THEN ['git blame src/a.rs']
  WHEN 5 THEN ['cd /tmp', 'gh pr diff 12'] WHEN 6 THEN ['git show abc'] WHEN 7 THEN ['git diff ..']
  WHEN 8 THEN ['echo git diff x..y'] WHEN 9 THEN [] ELSE ['cat', 'git status'] END"""
SPLIT = f", p AS (SELECT id, unnest({PIECES}) AS command FROM commands)\n"


def simple_commands(spark, sf) -> DataFrame:
    split = A.split_commands(F.col("command"))
    return fx.view(spark, sf, "commands").select("id", F.explode(split).alias("tokens"))


def _spoken(tokens="tokens"):
    return F.array_join(tokens, " ")


@query("split_commands", sql(["commands"], SPLIT + "SELECT id, command FROM p"))
def split_commands(spark, sf):
    return simple_commands(spark, sf).select("id", _spoken().alias("command"))


@query(
    "drop_heredocs",
    sql(["commands"], f"""SELECT id, CASE {KIND} WHEN 10 THEN 'cat|git status' WHEN 2 THEN 'cd /tmp && git log a..b | head'
      WHEN 5 THEN 'cd /tmp && gh pr diff 12' WHEN 6 THEN '( git show abc )' ELSE array_to_string({PIECES}, '|') END AS code FROM commands"""),
)
def drop_heredocs(spark, sf):
    lines = F.transform(A.drop_heredocs(F.col("command")), lambda ts: F.array_join(ts, " "))
    return fx.view(spark, sf, "commands").select("id", joined(lines).alias("code"))


def over_pieces(name: str, expr, oracle: str) -> None:
    @query(name, sql(["commands"], SPLIT + f"SELECT id, command, {oracle} AS v FROM p"))
    def run(spark, sf):
        return simple_commands(spark, sf).select("id", _spoken().alias("command"), expr("tokens").alias("v"))


over_pieces("has_ref_range", A.has_ref_range, "regexp_matches(command, '[^ .]\\.\\.[^ .]')")
over_pieces("has_pickaxe", A.has_pickaxe, "contains(command, ' -S')")
over_pieces(
    "classify_command", A.classify_command,
    """CASE WHEN starts_with(command, 'git log -S') THEN 'function_context'
    WHEN starts_with(command, 'git diff') AND contains(command, 'n..H') THEN 'change_manifest'
    WHEN starts_with(command, 'git log a..b') THEN 'commit_history'
    WHEN starts_with(command, 'git blame') OR starts_with(command, 'git show') THEN 'file_snapshots' END""",
)


@query("decide", sql(["commands"], f"SELECT id, {DECISION} AS decision, {TARGET} AS target FROM commands"))
def decide(spark, sf):
    return A.decide(fx.view(spark, sf, "commands")).select("id", "decision", "target")


def _advice_sql() -> str:
    words = {k: v.replace("'", "''") for k, v in A.ADVICE.items()}
    ran = "chr(10) || chr(10) || 'You ran: '"
    rows = {
        0: ("change_manifest", "git diff main..HEAD"), 1: ("function_context", "git log -S term"),
        2: ("commit_history", "git log a..b"), 4: ("file_snapshots_blame", "git blame src/a.rs"),
        6: ("file_snapshots_show", "git show abc"),
    }
    cases = " ".join(f"WHEN {i} THEN '{words[k]}' || {ran} || '{c}'" for i, (k, c) in rows.items())
    cases += f" WHEN 5 THEN '{words['gh_pr_diff']}' WHEN 9 THEN '{words['mcp__github__get_commit']}'"
    return f"SELECT id, CASE {KIND} {cases} END AS advice FROM commands"


@query("advice_text", sql(["commands"], _advice_sql()))
def advice_text(spark, sf):
    return A.advice_text(A.decide(fx.view(spark, sf, "commands"))).select("id", "advice")


@query(
    "audit_rollup",
    sql(["commands"], f"""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, {DECISION} AS decision, {TARGET} AS target,
      count(*) AS commands FROM commands GROUP BY ROLLUP (day, decision, target)"""),
)
def audit_rollup(spark, sf):
    rolled = A.audit_rollup(A.decide(fx.view(spark, sf, "commands")))
    return rolled.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "decision", "target", "commands")
