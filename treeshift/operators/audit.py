"""Which shell commands ask for what a structured query would answer better.

Tokens, heredocs and classification are expressions over one row, so a batch
or a stream of commands is a projection without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values
BLOCKED_TOOLS = ["mcp__github__get_commit", "mcp__github__list_commits"]

_TICK = "\x01"  # between tokens
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|' + r"'[^']*+'"
_WORD = rf"(?:[^\s\"'\\();<>|&#]++|\\.|{_QUOTED})++"
_TOKEN = rf"{_WORD}|[();<>|&]++|#.*"
_SEPARATOR = r"(?:&&|\|\||\||;|\(|\))"

ADVICE = {
    "change_manifest": "A diff between two versions is raw text. Query the change manifest of the range: "
    "files, functions, imports and dependencies as rows.",
    "commit_history": "A log between two versions is raw text. Query the commit history of the range: "
    "one manifest per commit.",
    "function_context": "A content search in the log is raw text. Query the function context: callers, "
    "callees and tests of every changed function.",
    "file_snapshots_blame": "Blame is line-by-line text. Query file snapshots with a line range.",
    "file_snapshots_show": "Showing a commit is raw text. Query file snapshots of the commit and its parent.",
    "gh_pr_diff": "The diff of a pull request is raw text. Query the change manifest of its base and head.",
    "mcp__github__get_commit": "A fetched commit is raw text. Query file snapshots of the commit and its parent.",
    "mcp__github__list_commits": "A list of commits has no content. Query the commit history of the range.",
}


def _line_tokens(line: Column) -> Column:
    """Shell words and operators of a line; empty where quotes do not close."""
    rest = F.regexp_replace(line, _TOKEN, "")
    raw = F.filter(
        F.regexp_extract_all(line, F.lit(f"({_TOKEN})"), F.lit(1)), lambda t: ~t.startswith("#")
    )

    def unquoted(token: Column) -> Column:
        # quotes go, a backslash keeps the character after it; within double
        # quotes it does so for a quote or a backslash only
        marked = F.regexp_replace(token, r"""'([^']*+)'""", "\x02$1\x02")
        inner = F.regexp_replace(marked, r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"', "$1")
        mixed = F.regexp_replace(F.regexp_replace(inner, r"\\([\"\\ $;&|()<>'#])", "$1"), "\x02", "")
        return F.when(token.rlike("[\"']"), mixed).otherwise(F.regexp_replace(token, r"\\(.)", "$1"))

    return F.when(rest.rlike(r"[\"'\\]"), F.array().cast("array<string>")).otherwise(
        F.transform(raw, unquoted)
    )


def _without_heredocs(lines: Column) -> Column:
    """Lines of tokens up to a heredoc, without its body and closing line."""
    kind = "array<array<string>>"
    start = F.struct(
        F.lit(None).cast("string").alias("tag"), F.array().cast(kind).alias("kept")
    )

    def step(state: Column, tokens: Column) -> Column:
        at = F.array_position(tokens, "<<").cast("int")
        tag = F.regexp_replace(
            F.regexp_replace(F.coalesce(F.get(tokens, at), F.lit("")), "^-", ""), r"^[\"'](.*)[\"']$", "$1"
        )
        # an operator without a tag swallows what follows
        opened = F.when(tag == "", F.lit("\n")).otherwise(tag)
        closes = (F.size(tokens) == 1) & (F.get(tokens, F.lit(0)) == state["tag"])
        return (
            F.when(
                state["tag"].isNotNull(),
                F.struct(
                    F.when(closes, F.lit(None).cast("string")).otherwise(state["tag"]).alias("tag"),
                    state["kept"].alias("kept"),
                ),
            )
            .when(
                at > 0,
                F.struct(
                    opened.alias("tag"),
                    F.array_append(state["kept"], F.slice(tokens, F.lit(1), at - 1)).alias("kept"),
                ),
            )
            .otherwise(
                F.struct(
                    F.lit(None).cast("string").alias("tag"),
                    F.array_append(state["kept"], tokens).alias("kept"),
                )
            )
        )

    return F.aggregate(lines, start, step)["kept"]


def drop_heredocs(command: Column) -> Column:
    """Tokens of each line that is code; one array per line."""
    lines = F.transform(F.split(F.replace(command, F.lit("`"), F.lit(" ")), "\n"), _line_tokens)
    return F.when(F.contains(command, F.lit("<<")), _without_heredocs(lines)).otherwise(lines)


def split_commands(command: Column) -> Column:
    """Simple commands in order, each an array of tokens."""
    # every token gets a mark in front; splitting at marked separators leaves
    # the tokens of one simple command
    joined = F.transform(
        drop_heredocs(command),
        lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(F.lit(_TICK), t)), ""),
    )
    pieces = F.flatten(
        F.transform(joined, lambda line: F.split(line, rf"{_TICK}{_SEPARATOR}(?={_TICK}|$)"))
    )
    return F.transform(
        F.filter(pieces, lambda p: p != ""), lambda p: F.split(F.substr(p, F.lit(2)), _TICK)
    )


def has_ref_range(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(t, F.lit("..")) & ~t.isin("..", "..."))


def has_pickaxe(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.startswith("-S") | t.startswith("-G"))


def classify_command(tokens: Column) -> Column:
    """The structured query a ``git`` command stands for, or NULL."""
    program, sub = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    rest = F.slice(tokens, F.lit(3), F.greatest(F.size(tokens), F.lit(1)))
    return F.when(
        program == "git",
        F.when((sub == "log") & has_pickaxe(rest), "function_context")
        .when((sub == "diff") & has_ref_range(rest), "change_manifest")
        .when((sub == "log") & has_ref_range(rest), "commit_history")
        .when(sub.isin("blame", "show"), "file_snapshots"),
    )


def decide(commands: DataFrame) -> DataFrame:
    """``decision`` (block, advise or silent), ``target`` and the tokens at fault."""
    tool, found = F.col("tool_name"), F.col("candidates")
    decided = commands.withColumn(
        "candidates",
        F.when(tool == "Bash", split_commands(F.coalesce("command", F.lit("")))).otherwise(
            F.array().cast("array<array<string>>")
        ),
    )
    judged = F.transform(
        found,
        lambda ts: F.struct(
            F.when(F.get(ts, F.lit(0)).isin(BLOCKED_TOOLS), F.get(ts, F.lit(0)))
            .otherwise(classify_command(ts))
            .alias("target"),
            F.get(ts, F.lit(0)).isin(BLOCKED_TOOLS).alias("blocked"),
            ts.alias("tokens"),
        ),
    )
    pull_request = F.exists(
        found, lambda ts: F.array_join(F.slice(ts, F.lit(1), F.lit(3)), _TICK) == f"gh{_TICK}pr{_TICK}diff"
    )
    decided = decided.withColumn(
        "first", F.get(F.filter(judged, lambda j: j["target"].isNotNull()), F.lit(0))
    ).withColumn("pull_request", pull_request)
    blocked = tool.isin(BLOCKED_TOOLS) | F.col("pull_request") | F.coalesce(F.col("first.blocked"), F.lit(False))
    target = (
        F.when(tool.isin(BLOCKED_TOOLS), tool)
        .when(F.col("pull_request"), "gh_pr_diff")
        .otherwise(F.col("first.target"))
    )
    return decided.select(
        *commands.columns,
        F.when(blocked, "block").when(target.isNotNull(), "advise").otherwise("silent").alias("decision"),
        target.alias("target"),
        F.when(~blocked, F.col("first.tokens")).alias("tokens"),
    )


def advice_text(decisions: DataFrame) -> DataFrame:
    """The text for each decision; advice ends with the command as it was typed."""
    key = F.when(
        F.col("target") == "file_snapshots", F.concat(F.lit("file_snapshots_"), F.get("tokens", F.lit(1)))
    ).otherwise(F.col("target"))
    text = None
    for name, words in ADVICE.items():
        text = F.when(key == name, words) if text is None else text.when(key == name, words)
    echo = F.concat(F.lit("\n\nYou ran: "), F.array_join("tokens", " "))
    return decisions.withColumn(
        "advice", F.when(F.col("decision") == "advise", F.concat(text, echo)).otherwise(text)
    )


def audit_rollup(decisions: DataFrame) -> DataFrame:
    """Commands by day, decision and target, with subtotals."""
    return (
        decisions.withColumn("day", F.to_date("ts"))
        .rollup("day", "decision", "target")
        .agg(F.count("*").alias("commands"), F.grouping_id().alias("level"))
    )
