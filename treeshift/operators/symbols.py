"""Functions, imports and calls of source files, read from masked lines.

``extract_symbols`` turns distinct blobs into one row each. The rows of a blob
are its lines, a line with more than one header cut into pieces that hold one
brace or semicolon each (``at`` numbers them), and everything a parser would keep on a stack is a running
window over them: block depth is a running sum, the enclosing blocks are the
last openers of each lower level, a function ends at the next line that closes
its level. All windows are keyed by ``blob_id``, so the content is shuffled once
and no group is larger than a file.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.functions.code_rules import NOT_CALLED, PARENS, RULES, TURBOFISH, Rules
from treeshift.functions.text import leaf_name, strip
from treeshift.session import cut

LEVELS = 8  # enclosing blocks that are looked at; functions nested deeper are not found

STR, END, NOTE = "\x01", "\x02", "\x03"  # marks around literals and comments
CUT = "\x1e"  # between the pieces of a line
# from one piece to the next in a line whose literals and comments are marked
PIECE = rf"\G([^{{}};{STR}]*+(?:{STR}[^{END}]*+{END}[^{{}};{STR}]*+)*+)([{{;}}])"
#: Text that one task works on.
PART_BYTES = 8 << 20
#: A row's place in its blob: line times this, plus the piece of the line.
PIECES = 1 << 20

ROW = "blob_id", "language", "line", "at"


def _by_language(langs: list[str], build: Callable[[Rules], Column]) -> Column:
    """One expression per language; languages with equal rules share a branch."""
    language = F.col("language")
    groups: dict[str, tuple[Column, list[str]]] = {}
    for lang in langs:
        expr = build(RULES[lang])
        key = re.sub(r"(namedlambdavariable\(\)|\b[a-z]_\d+\b)", "v", str(expr))
        groups.setdefault(key, (expr, []))[1].append(lang)
    branches = list(groups.values())
    if len(branches) == 1:
        return branches[0][0]
    chain = None
    for expr, members in branches:
        hit = language.isin(members)
        chain = F.when(hit, expr) if chain is None else chain.when(hit, expr)
    return chain


def _tokens(rules: Rules) -> str:
    """Regular expression of all literals and comments of a language."""
    starts = "".join(sorted({c for m in rules.mask for c in _first_chars(m)}))
    return f"(?=[{starts}])(?:" + "|".join(rules.mask) + ")"


def _pieces(code: Column, raw: Column, rules: Rules) -> Column:
    """``array<struct<piece,code,chars>>`` of a line: one for most, several if a header is behind another piece.

    ``chars`` is the length of a piece in the raw text, 0 for lines that stay whole
    and where a literal over several lines hides the pieces.
    """
    whole = F.array(F.struct(F.lit(0).alias("piece"), code.alias("code"), F.lit(0).alias("chars")))
    if rules.family != "brace":
        return whole
    heads = [rule[0] for rule in [*rules.functions, *rules.members]] + [regex for _, regex in rules.containers]
    later = r"[{};][ \t]*(?:" + "|".join(h.removeprefix("^") for h in heads) + ")"
    codes = F.split(F.regexp_replace(code, "([{;}])", "$1" + CUT), CUT)
    marked = F.regexp_replace(F.regexp_replace(raw, f"[{STR}{END}]", " "), _tokens(rules), f"{STR}$0{END}")
    raws = F.split(F.regexp_replace(marked, PIECE, "$1$2" + CUT), CUT)
    sizes = F.transform(raws, lambda r: F.length(F.regexp_replace(r, f"[{STR}{END}]", "")))
    cut = F.transform(
        codes,
        lambda c, i: F.struct(
            i.alias("piece"),
            F.when(i > 0, F.regexp_replace(c, r"^[ \t]+", "")).otherwise(c).alias("code"),
            F.when(F.size(sizes) == F.size(codes), F.get(sizes, i)).otherwise(0).alias("chars"),
        ),
    )
    return F.when(F.rlike(code, F.lit(later)), cut).otherwise(whole)


def _holds(text: Column, chars: str) -> Column:
    """Is any of the characters in the text? A plain search, far cheaper than an expression over all of it."""
    found = [F.contains(text, F.lit(c)) for c in sorted(set(chars))]
    return functools.reduce(Column.__or__, found)


def mark_tokens(content: Column, rules: Rules) -> Column:
    """Content with marks around its literals and comments.

    They are marked by one left-to-right pass, so quotes in comments and slashes
    in strings do not matter. A token that may begin with a letter has a quote.
    """
    starts = {c if not c.isalpha() else '"' for m in rules.mask for c in _first_chars(m)}
    plain = F.when(_holds(content, STR + END + NOTE), F.regexp_replace(content, f"[{STR}{END}{NOTE}]", " ")).otherwise(content)
    return F.when(_holds(content, "".join(starts)), F.regexp_replace(plain, _tokens(rules), f"{STR}$0{END}")).otherwise(plain)


def mask_short(marked: Column, rules: Rules) -> Column:
    """Marked content without comments and the inside of literals, where one line holds them."""
    noted = F.regexp_replace(marked, f"{STR}(?={rules.comment})", NOTE)
    short = F.regexp_replace(noted, f"{NOTE}[^\n{END}]*{END}", "")
    return F.when(_holds(marked, STR), F.regexp_replace(short, f"{STR}[^\n{END}]*{END}", STR + END)).otherwise(marked)


def mask_long(short: Column) -> Column:
    """The same for those that span lines, newlines kept.

    Anchored to its previous match, the pattern walks from a mark to its end.
    """
    long = F.regexp_replace(short, rf"([{STR}{NOTE}]|(?!\A)\G)[^\n{END}]*(\n)?", "$1$2")
    emptied = F.when(short.rlike(f"[{STR}{NOTE}][^{END}]*\n"), long).otherwise(short)
    return F.when(_holds(short, STR + NOTE), F.regexp_replace(emptied, f"{NOTE}{END}?", "")).otherwise(short)


def _first_chars(token: str) -> str:
    """Characters a masked token can begin with."""
    for lead, chars in {
        r"\bb?r": "br",
        r"\bR": "R",
        "(?m:^=": "=",
        "<<": "<",
        "@": "@",
        "//": "/",
        "/": "/",
        r"/\*": "/",
    }.items():
        if token.startswith(lead):
            return chars
    return token[0]


def _candidates(rules: Rules, code: Column) -> Column:
    """Headers a line may be, each with the container path it is valid in."""

    def one(rule: tuple[str, int, int, str], needs_body: bool, whole: bool, untyped: bool = False) -> Column:
        regex, name, receiver, path = rule
        own = F.regexp_extract(code, regex, name)
        if receiver:
            to = strip(F.regexp_extract(code, regex, receiver))
            own = F.when(to != "", F.concat(to, F.lit("."), own)).otherwise(own)
        return F.when(
            code.rlike(regex),
            F.struct(
                own.alias("name"),
                F.lit(path).alias("path"),
                F.lit(needs_body).alias("needs_body"),
                F.lit(whole).alias("whole"),
                F.lit(untyped).alias("untyped"),
            ),
        )

    found = [one(r, False, False) for r in rules.functions]
    found += [
        one(r, rules.member_needs_body, rules.arrow and i == 0) for i, r in enumerate(rules.members)
    ]
    found += [one(r, rules.member_needs_body, False, True) for r in rules.untyped]
    return F.array_compact(F.array(*found))


def _container(rules: Rules, code: Column) -> Column:
    empty = F.lit(None).cast("struct<kind:string,name:string>")
    if not rules.containers:
        return empty
    chain = None
    for kind, regex in rules.containers:
        name = F.lit("Companion") if kind == "P" else F.regexp_extract(code, regex, 1)
        value = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
        hit = code.rlike(regex)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(empty)


def _calls(rules: Rules, code: Column) -> Column:
    text = code
    if rules.call_strip:
        mark, regex = rules.call_strip
        text = F.when(F.contains(code, F.lit(mark)), F.regexp_replace(code, regex, "")).otherwise(code)
    word = r"[A-Za-z_$][\w$]*+"
    regex = rules.call_regex or rf"(\.?\b{word}(?:(?:{rules.call_glue}){word})*+)(?=\s*\()"
    # a definition is consumed without giving a group
    regex = rf"\b(?:{rules.defines})\s+[\w$.]+|{regex}"
    found = F.filter(
        F.regexp_extract_all(text, F.lit(regex), F.lit(1)), lambda c: ~c.isin(["", *NOT_CALLED])
    )
    if rules.family == "end":  # calls need no parentheses
        return found
    return F.when(F.contains(code, F.lit("(")) | F.contains(code, F.lit("!")), found).otherwise(
        F.array().cast("array<string>")
    )


def _line_features(blobs: DataFrame, langs: list[str]) -> DataFrame:
    lines = (
        blobs.filter(F.col("language").isin(langs))
        .withColumn("marked", _by_language(langs, lambda r: mark_tokens(F.col("content"), r)))
        .withColumn("masked", _by_language(langs, lambda r: mask_short(F.col("marked"), r)))
        .select(
            "blob_id",
            "language",
            F.split("content", "\n").alias("raw"),
            F.split(mask_long(F.col("masked")), "\n").alias("code"),
        )
    )
    total = F.size("raw") - F.when(F.element_at("raw", -1) == "", 1).otherwise(0)
    lines = lines.select(
        "blob_id",
        "language",
        total.alias("lines"),
        F.posexplode(F.arrays_zip("raw", "code")).alias("pos", "l"),
    ).select(
        "blob_id",
        "language",
        "lines",
        (F.col("pos") + 1).alias("line"),
        F.col("l.raw").alias("raw"),
        F.col("l.code").rlike(rf"^\s*{END}").alias("cont"),
        F.regexp_replace(F.replace("l.code", F.lit(STR), F.lit('""')), f"[{END}\r]", "").alias("code"),
    )
    if any(RULES[lang].family == "brace" for lang in langs):
        cut = _by_language(langs, lambda r: _pieces(F.col("code"), F.col("raw"), r))
        lines = lines.withColumn("p", F.explode(cut)).select(
            *[c for c in lines.columns if c not in ("cont", "code")],
            (F.col("cont") & (F.col("p.piece") == 0)).alias("cont"),
            F.col("p.code").alias("code"),
            (F.col("line").cast("bigint") * PIECES + F.col("p.piece")).alias("at"),
            F.col("p.chars").alias("chars"),
        )
    else:
        lines = lines.select("*", (F.col("line").cast("bigint") * PIECES).alias("at"), F.lit(0).alias("chars"))
    code, raw = F.col("code"), F.col("raw")
    bare = strip(code)

    def count(char: str) -> Column:
        return F.length(code) - F.length(F.replace(code, F.lit(char), F.lit("")))

    def import_head(r: Rules) -> Column:
        return code.rlike(r.imports) & ~F.col("cont")

    def import_stop(r: Rules) -> Column:
        if not r.import_end:
            return F.lit(True)
        return (code if r.family == "indent" else raw).rlike(r.import_end)

    def import_alone(r: Rules) -> Column:
        if r.family == "indent":  # only an open parenthesis continues a statement
            return import_stop(r) | ~F.contains(code, F.lit("("))
        return import_stop(r)

    def block_mark(r: Rules) -> Column:
        if r.import_block is None:
            return F.lit(None).cast("boolean")
        opens, closes, _ = r.import_block
        return F.when(code.rlike(opens), True).when(code.rlike(closes), False)

    def quiet_mark(r: Rules) -> Column:
        if r.quiet is None:
            return F.lit(None).cast("boolean")
        return F.when(code.rlike(r.quiet[0]), True).when(code.rlike(r.quiet[1]), False)

    def flag(regex: str) -> Column:
        return code.rlike(regex) if regex else F.lit(False)

    def alone(r: Rules) -> Column:
        """A function header that is also the function's last line."""
        if r.family == "indent":
            return F.length(code) < 0  # never; the next line that starts decides
        if r.family == "end":
            return code.rlike(r"\bend\s*$|^\s*def\s+[^\s(]+(?:\s*\(.*\))?\s*=\s")
        in_line = (count("{") == count("}")) & (F.contains(code, F.lit("{")) | bare.endswith(";"))
        if r.expression_body:
            in_line = in_line | (~F.contains(code, F.lit("{")) & code.rlike(r"\)[^=]*="))
        return in_line

    indent = F.regexp_replace(F.regexp_extract(code, r"^([ \t]*)", 1), "\t", "    ")
    # lines that hold nothing but comments or the inside of a literal leave here
    return lines.filter(F.col("cont") | code.rlike(r"\S")).select(
        *ROW,
        "lines",
        "cont",
        "chars",
        F.length("raw").alias("line_chars"),
        _by_language(langs, alone).alias("alone"),
        code.rlike(r"^\s*[)\]}]").alias("closing"),
        _by_language(langs, lambda r: F.lit(r.family)).alias("family"),
        _by_language(langs, lambda r: _container(r, code)).alias("container"),
        _by_language(langs, lambda r: _candidates(r, code)).alias("heads"),
        _by_language(langs, lambda r: _calls(r, code)).alias("calls"),
        count("{").alias("opens"),
        (count("{") - count("}")).alias("delta"),
        F.length(indent).alias("indent"),
        bare.endswith(";").alias("semi"),
        bare.rlike(r"[;{}]$").alias("terminated"),
        bare.endswith(":").alias("colon"),
        code.rlike(r"^\s*end\b").alias("end_word"),
        _by_language(langs, lambda r: flag(r.annotation)).alias("anno"),
        _by_language(langs, lambda r: flag(r.spoiler)).alias("spoiler"),
        _by_language(langs, import_head).alias("import_head"),
        _by_language(langs, import_stop).alias("import_stop"),
        _by_language(langs, import_alone).alias("import_alone"),
        _by_language(langs, block_mark).alias("block_mark"),
        _by_language(langs, quiet_mark).alias("quiet_mark"),
    )


def _with_levels(lines: DataFrame, langs: list[str]) -> DataFrame:
    """Block level of every line, and what the lines before it leave open."""
    blob = Window.partitionBy("blob_id")
    upto = blob.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = blob.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    brace = F.col("family") == "brace"
    header = F.col("container").isNotNull() | (F.size("heads") > 0)
    counted = ~F.col("cont")
    event = header | (F.col("opens") > 0) | (F.col("delta") != 0) | F.col("semi")
    pending = header & (F.col("opens") == 0) & (F.col("delta") == 0) & ~F.col("semi")
    first_of_block = (F.col("indent") > 0) & counted & (F.col("prev.colon") | (F.col("family") == "end"))
    lines = lines.select(
        "*",
        header.alias("header"),
        F.sum("delta").over(upto).alias("depth"),
        F.last_value(
            F.when(counted, F.struct("line", "terminated", "colon", "spoiler", "anno")), True
        ).over(before).alias("prev"),
        F.last_value(
            F.when(event, F.struct(pending.alias("pending"), F.col("container").alias("container"))), True
        ).over(before).alias("prev_event"),
        F.last_value("line").over(before).alias("prev_line"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.last_value(F.when(~F.col("anno"), F.col("line")), True)
        .over(before)
        .alias("prev_plain"),
        F.coalesce(
            F.sum(F.when(F.col("anno"), 0).otherwise(1)).over(before), F.lit(0)
        ).alias("run"),
        F.last_value("block_mark", True).over(before).alias("in_block"),
        F.coalesce(F.last_value("quiet_mark", True).over(before), F.lit(False)).alias("quiet"),
        F.last_value(
            F.when(F.col("import_head") & ~F.col("import_alone"), True).when(F.col("import_stop"), False), True
        ).over(before).alias("in_import"),
    )
    if any(RULES[lang].family != "brace" for lang in langs):
        lines = lines.select(
            "*",
            F.min(F.when(first_of_block, F.col("indent"))).over(blob).alias("unit"),
            F.max("line").over(blob).alias("last_line"),
        )
    else:
        lines = lines.withColumn("unit", F.lit(4)).withColumn("last_line", F.col("lines"))
    level = F.when(brace, F.col("depth") - F.col("delta")).otherwise(
        F.ceil(F.col("indent") / F.coalesce("unit", F.lit(4)))
    )
    kind = F.coalesce(
        F.col("container.kind"),
        F.when(F.size("heads") > 0, "F"),
        F.when(
            brace & F.col("prev_event.pending"), F.coalesce(F.col("prev_event.container.kind"), F.lit("F"))
        ),
        F.lit("X"),
    )
    name = F.coalesce(
        F.col("container.name"),
        F.when(brace & ~F.col("header") & F.col("prev_event.pending"), F.col("prev_event.container.name")),
    )
    # a line like `):` ends a header above it and opens nothing itself
    opener = F.when(brace, F.col("delta") > 0).otherwise(counted & ~F.col("closing"))
    return lines.select(
        "*",
        level.cast("int").alias("level"),
        F.when(opener, F.struct("at", kind.alias("kind"), name.alias("name"))).alias("opener"),
        (counted & ~F.col("closing")).alias("starts"),
    )


def _with_functions(lines: DataFrame, langs: list[str]) -> DataFrame:
    """Decide which headers are functions, and name them."""
    before = Window.partitionBy("blob_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("blob_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    scopes = [
        F.last_value(F.when(F.col("level") == k, F.col("opener")), True).over(before) for k in range(LEVELS)
    ]
    lines = lines.select(
        "*",
        F.when(F.col("header"), F.array(*scopes)).alias("scopes"),
        F.last_value(
            F.when(F.col("starts"), F.struct(F.col("level"), F.col("header"))), True
        ).over(before).alias("prev_start"),
        F.last_value(
            F.when(F.col("anno") & ~F.coalesce(F.col("prev.anno"), F.lit(False)), F.col("line")), True
        ).over(before).alias("anno_line"),
        F.last_value(F.when(F.col("at") % PIECES == 0, F.col("chars_before")), True).over(upto).alias("line_base"),
    )
    # raw characters of the line before and behind a piece
    front = F.col("chars_before") - F.coalesce("line_base", "chars_before")
    rear = F.when(F.col("chars") > 0, F.greatest(F.col("line_chars") - front - F.col("chars"), F.lit(0))).otherwise(0)
    lines = lines.withColumns({"front": front, "rear": rear})
    # the openers around a header, outermost first; one that began before the
    # block it should be in is a left-over of an earlier block
    inside = F.filter(
        F.slice("scopes", 1, F.least(F.greatest(F.col("level"), F.lit(0)), F.lit(LEVELS))),
        lambda s: s.isNotNull(),
    )
    nested = F.filter(
        inside,
        lambda s, i: (i == 0) | (s["at"] > F.get(inside["at"], i - 1)),
    )
    path = F.when(F.col("level") > LEVELS, F.lit("?")).otherwise(
        F.array_join(F.transform("around", lambda s: s["kind"]), "")
    )
    lines = lines.withColumn("around", F.when(F.col("header"), nested)).withColumn(
        "path", F.when(F.col("header"), path)
    )
    bodiless = F.col("semi") & (F.col("opens") == 0)
    needs_body_in = _by_language(langs, lambda r: F.lit(r.function_needs_body_in or "^!$"))
    row_path = _by_language(langs, lambda r: F.lit(r.container_rows or "^!$"))
    below = F.coalesce(F.col("prev.anno"), F.lit(False))
    fits = F.filter(
        "heads",
        lambda h: F.rlike(F.col("path"), h["path"])
        & (below | ~h["untyped"])
        & ~(bodiless & (h["needs_body"] | ((h["path"] != "^[NEC]*C$") & F.rlike(F.col("path"), needs_body_in)))),
    )
    usable = ~F.col("cont") & ~F.coalesce(F.col("prev.spoiler"), F.lit(False))
    own_row = (F.col("container.kind") == "C") & F.rlike(F.col("path"), row_path)
    lines = lines.withColumn(
        "head",
        F.when(
            F.col("header") & usable,
            F.coalesce(
                F.when(
                    own_row,
                    F.struct(
                        F.col("container.name").alias("name"),
                        F.lit("").alias("path"),
                        F.lit(False).alias("needs_body"),
                        F.lit(False).alias("whole"),
                        F.lit(False).alias("untyped"),
                    ),
                ),
                F.get(fits, F.lit(0)),
            ),
        ),
    )
    names = F.filter(F.transform("around", lambda s: s["name"]), lambda n: n != "")
    short = F.regexp_replace("head.name", r"^self\.", "")
    # containers that are rows keep their own name; members take the last
    # container's name, or all of them
    qualified = _by_language(
        langs,
        lambda r: F.when(own_row, F.col("container.name"))
        .when(F.size(names) == 0, F.col("head.name"))
        .otherwise(
            F.concat(
                F.array_join(names, r.separator) if r.qualify == "join" else F.element_at(names, -1),
                F.lit(r.separator),
                short,
            )
        ),
    )
    return lines.withColumn(
        "fn",
        F.when(
            F.col("head").isNotNull(),
            F.struct(
                F.col("line").alias("line"),
                F.col("at").alias("at"),
                F.col("front").alias("front"),
                F.col("rear").alias("rear"),
                F.when(F.size("around") >= 0, qualified).alias("name"),
                F.col("level").alias("level"),
                F.col("head.whole").alias("whole"),
                F.coalesce(own_row, F.lit(False)).alias("container"),
                F.col("alone").alias("alone"),
                F.greatest(
                    F.when(
                        (F.col("anno_line") > F.coalesce("prev_plain", F.lit(0))) & (F.col("at") % PIECES == 0),
                        F.col("anno_line"),
                    ),
                    F.lit(0),
                ).alias("anno_line"),
            ),
        ),
    )


def _with_ends(lines: DataFrame) -> DataFrame:
    """End line of every function: the next line that closes its level.

    A line takes part once for itself and once for each level it closes, so one
    window per (blob, level) finds all ends in a single pass.
    """
    none = F.array().cast("array<int>")
    goes_on = ~F.coalesce(F.col("prev.terminated"), F.lit(True))
    brace = F.when(
        F.col("delta") < 0, F.sequence(F.col("depth").cast("int"), F.col("level") - 1)
    ).when(
        (F.col("delta") == 0) & ((F.col("opens") > 0) | F.col("semi")) & goes_on, F.array("level")
    )
    deepest = F.col("prev_start.level") - F.when(F.col("prev_start.header"), 0).otherwise(1)
    indent = F.when(
        F.col("starts") & (deepest >= F.col("level")), F.sequence(F.col("level"), deepest)
    )
    closed = F.coalesce(
        F.when(F.col("family") == "brace", brace)
        .when(F.col("family") == "indent", indent)
        .otherwise(F.when(F.col("end_word"), F.array("level"))),
        none,
    )
    indented = F.col("family") == "indent"
    # a function in a family of indented blocks ends with the row before
    ends_at = F.struct(
        F.when(indented, F.col("prev_line")).otherwise(F.col("line")).cast("int").alias("line"),
        (F.col("at") - indented.cast("bigint")).alias("at"),
        F.when(indented, 0).otherwise(F.col("rear")).cast("int").alias("rear"),
    )
    itself = F.struct(F.col("fn.level").alias("lv"), F.lit(None).cast("struct<line:int,at:bigint,rear:int>").alias("close"))
    import_row = (
        (F.col("import_head") & (F.col("level") == 0))
        | F.coalesce(F.col("in_block"), F.lit(False))
        | (F.coalesce(F.col("in_import"), F.lit(False)) & F.col("import_stop"))
    )
    # other lines have done their part as openers; they go on as closers only
    kept = F.col("fn").isNotNull() | (F.size("calls") > 0) | import_row
    rows = F.concat(
        F.filter(F.array(itself), lambda _: kept),
        F.transform(closed, lambda k: F.struct(k.alias("lv"), ends_at.alias("close"))),
    )
    below = (
        Window.partitionBy("blob_id", "lv")
        .orderBy(F.desc("at"), F.col("close").isNotNull())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        lines.withColumn("import_row", import_row)
        .withColumn("events", rows)
        .select("*", F.explode("events").alias("r"))
        .select(
            *ROW,
            "anno",
            "run",
            "last_line",
            F.when(F.col("r.close").isNull(), F.col("fn")).alias("fn"),
            F.when(F.col("r.close").isNull() & ~F.col("quiet"), F.col("calls")).alias("calls"),
            "import_row",
            "import_head",
            "import_alone",
            F.coalesce("in_block", F.lit(False)).alias("in_block"),
            F.col("r.lv").alias("lv"),
            F.col("r.close").alias("close"),
        )
        .withColumn("next_close", F.last_value("close", True).over(below))
        .filter("close IS NULL")
        .withColumn(
            "end",
            F.when(
                F.col("fn.alone"),
                F.struct(F.col("line").cast("int").alias("line"), "at", F.col("fn.rear").cast("int").alias("rear")),
            ).otherwise(
                F.coalesce(
                    "next_close",
                    F.struct(F.col("last_line").cast("int").alias("line"), F.lit((1 << 63) - 1).alias("at"), F.lit(0).alias("rear")),
                )
            ),
        )
    )


def _with_enclosing(lines: DataFrame) -> DataFrame:
    """The functions around every line that calls something, outermost first."""
    # a function's annotations follow its header here, so they are inside it
    upto = (
        Window.partitionBy("blob_id")
        .orderBy("run", "anno", "at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    entry = F.struct(
        F.col("fn.at").alias("start"), F.col("end.at").alias("end"), F.col("fn.name").alias("name")
    )
    at = [
        F.last_value(F.when(F.col("fn.level") == k, entry), True).over(upto) for k in range(LEVELS)
    ]
    lines = lines.select("*", F.array(*at).alias("open"))
    around = F.filter("open", lambda e: e.isNotNull() & (e["end"] >= F.col("at")))
    return lines.withColumn("enclosing", F.when(F.size("calls") > 0, around)).drop("open")


def _signature(r: Rules, text: Column) -> Column:
    if r.family == "indent":
        return F.regexp_extract(text, rf"^([^(:]*+(?:{PARENS}[^(:]*+)*+:?)", 1)
    if r.family == "end":
        return F.regexp_extract(text, rf"^([^(;\n]*+(?:{PARENS})?)", 1)
    stop = "(" + r.body_stop
    typed = r"(?<=\binterface|\bstruct)\{[^{}]*\}"
    return F.regexp_extract(text, rf"^([^{stop}]*+(?:(?:{PARENS}|{typed})[^{stop}]*+)*+)", 1)


def _import_texts(r: Rules, found: Column) -> Column:
    def tidy(i: Column) -> Column:
        if r.import_text != "statement":
            first = F.regexp_extract(i["text"], r.import_text, 1)
            if r.import_block is None:
                return first
            return F.when(i["in_block"], F.regexp_extract(i["text"], r.import_block[2], 1)).otherwise(first)
        if r.family == "indent":
            return F.regexp_replace(i["text"], r"[ \t]+#[^\n]*", "")
        if r.import_end:
            stop = ";" if r.import_end == ";" else r"""["'][^"'\n]*["']\s*;?"""
            cut = F.regexp_extract(i["text"], rf"^((?s:.*?){stop})", 1)
            return F.when(cut == "", i["text"]).otherwise(cut)
        return F.regexp_replace(i["text"], r"\s+(?://|/\*|#\s)[^\n]*", "")

    return F.filter(F.transform(found, lambda i: strip(tidy(i))), lambda t: t != "")


def _partitions(blobs: DataFrame) -> int:
    """In how many parts blobs are worked on, so that a part is no larger when there are more.

    Not left to Spark's sizes, as work per shuffled byte is high here and source text
    compresses well: partitions coalesced by size would idle most cores.
    """
    least = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = blobs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return max(least, -(-size // PART_BYTES))


def _work(blobs: DataFrame, langs: list[str]) -> tuple[int, list[str]]:
    """The parts blobs are worked on in, and the languages they have; others would only lengthen the plan and its code."""
    present = blobs.agg(F.collect_set("language")).first()[0]
    return _partitions(blobs), [lang for lang in langs if lang in present] or langs[:1]


def extract_symbols(blobs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """``(blob_id, language, functions, imports, calls)``, a row per blob.

    ``blobs(blob_id, language, content)`` must be distinct by ``blob_id``. A
    call names the functions it is made in, outermost first.
    """
    langs = sorted(languages or RULES)
    blobs = cut(blobs.filter(F.col("content").isNotNull()).select("blob_id", "language", "content"))
    parts, langs = _work(blobs, langs)
    distributed = blobs.repartition(parts, "blob_id")
    lines = _with_enclosing(
        _with_ends(_with_functions(_with_levels(_line_features(distributed, langs), langs), langs))
    )
    # a bodiless or method-like header reads as a call of its own name
    own = leaf_name(F.col("fn.name"))
    at = F.array_position("calls", F.regexp_replace(own, r"\s*\(.*", ""))
    calls = F.when(
        F.col("fn").isNotNull() & (at > 0),
        F.concat(
            F.slice("calls", F.lit(1), (at - 1).cast("int")),
            F.slice("calls", (at + 1).cast("int"), F.size("calls")),
        ),
    ).otherwise(F.col("calls"))
    found = (
        lines.withColumn("calls", calls)
        .groupBy("blob_id")
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("fn").isNotNull(), F.struct("at", "line", "fn", "end")))
            ).alias("fns"),
            F.sort_array(
                F.collect_list(F.when(F.size("calls") > 0, F.struct("at", "line", "calls", "enclosing")))
            ).alias("call_lines"),
            F.sort_array(
                F.collect_list(
                    F.when(F.col("import_row"), F.struct("line", "at", "import_head", "import_alone", "in_block"))
                )
            ).alias("import_lines"),
        )
    )
    # back to the text, which is partitioned by blob already
    per_blob = distributed.filter(F.col("language").isin(langs)).join(found, "blob_id", "left").select(
        "blob_id",
        "language",
        F.split("content", "\n").alias("raws"),
        *[F.coalesce(c, F.array()).alias(c) for c in ("fns", "call_lines", "import_lines")],
    )

    def text_of(first: Column, last: Column) -> Column:
        # a slice copies the array, so single lines are taken by place
        many = F.array_join(F.slice("raws", first.cast("int"), (last - first + 1).cast("int")), "\n")
        return F.when(first == last, F.get("raws", (first - 1).cast("int"))).otherwise(many)

    def start_of(f: Column) -> Column:
        return F.when(f["fn"]["anno_line"] > 0, f["fn"]["anno_line"]).otherwise(f["line"])

    # lambdas are not compiled and share nothing, so what is used again is a step of its own
    def spread(f: Column) -> Column:
        return F.struct(f.alias("f"), text_of(start_of(f), f["end"]["line"]).alias("text"))

    def piece_of(f: Column, text: Column) -> Column:
        """A function's lines without what stands before and behind it on them."""
        front, rear = f["fn"]["front"], f["end"]["rear"]
        own = F.substr(text, (front + 1).cast("int"), F.greatest(F.length(text) - front - rear, F.lit(0)).cast("int"))
        return F.when(front + rear > 0, own).otherwise(text)

    def import_text(i: Column, n: Column) -> Column:
        end = F.get(F.col("import_lines"), n + 1)["line"]
        last = F.when(i["import_alone"] | i["in_block"], i["line"]).otherwise(F.coalesce(end, i["line"]))
        return F.struct(
            i["in_block"],
            (i["import_head"] | i["in_block"]).alias("begins"),
            text_of(i["line"], last).alias("text"),
        )

    with_text = per_blob.select(
        "blob_id",
        "language",
        "call_lines",
        F.transform(
            F.transform("fns", spread),
            lambda x: F.struct(
                x["f"]["fn"]["name"].alias("name"),
                start_of(x["f"]).cast("bigint").alias("start_line"),
                x["f"]["at"].alias("head"),
                x["f"]["end"]["line"].cast("bigint").alias("end_line"),
                x["f"]["fn"]["container"].alias("container"),
                x["f"]["fn"]["whole"].alias("whole"),
                piece_of(x["f"], x["text"]).alias("text"),
            ),
        ).alias("fns"),
        F.filter(F.transform("import_lines", import_text), lambda i: i["begins"]).alias("import_lines"),
    )

    def shaped(r: Rules) -> Column:
        lead = r"^\s*(?:export\s+)?(?:default\s+)?" if r.arrow else r"^\s+"

        def tidied(f: Column) -> Column:
            text = F.regexp_replace(F.regexp_replace(f["text"], lead, ""), r"\s+\z", "")
            return F.struct(f.alias("f"), text.alias("text"))

        def signed(x: Column) -> Column:
            raw_sig = _signature(r, x["text"])
            if r.arrow:
                arrow = F.regexp_extract(x["text"], r"^((?s:.*?)=>)", 1)
                raw_sig = F.when(x["f"]["whole"], arrow).otherwise(raw_sig)
            return F.struct(x["f"].alias("f"), x["text"].alias("text"), raw_sig.alias("raw_sig"))

        def bodied(x: Column) -> Column:
            body = strip(F.substr(x["text"], F.length(x["raw_sig"]) + 1))
            if r.family == "brace":
                body = F.regexp_replace(body, r"\}[^}]*\z", "}")
            if r.family == "end":
                body = F.regexp_replace(body, r"^\s*end\z", "")
            return F.struct(
                x["f"].alias("f"), x["text"].alias("text"), x["raw_sig"].alias("raw_sig"), body.alias("body"), (strip(body) == "").alias("empty")
            )

        def one(x: Column, i: Column) -> Column:
            f, text = x["f"], x["text"]
            signature = F.regexp_replace(
                F.when(x["empty"] | f["whole"], text).otherwise(x["raw_sig"]), r"^\s+|\s+\z", ""
            )
            return F.struct(
                i.cast("bigint").alias("ordinal"),
                f["name"].alias("name"),
                signature.alias("signature"),
                f["start_line"].alias("start_line"),
                f["end_line"].alias("end_line"),
                F.sha2(F.when(x["empty"], text).otherwise(x["body"]), 256).alias("body_hash"),
                f["container"].alias("container"),
                f["head"].alias("head"),
            )

        return F.transform(F.transform(F.transform(F.transform("fns", tidied), signed), bodied), one)

    php = F.col("language") == "php"

    def call(row: Column, c: Column, i: Column) -> Column:
        chained = c.startswith(".")
        text = F.when(chained, F.substr(c, F.lit(2))).otherwise(c)
        if "php" in langs:
            member = F.regexp_extract(text, r"^(.*)->\$?(\w+)$", 1)
            text = F.when(
                php & (member != ""), F.concat(member, F.lit("."), F.regexp_extract(text, r"->\$?(\w+)$", 1))
            ).otherwise(text)
        turbofish = (F.col("language") == "rust") & F.contains(text, F.lit("::<"))
        plain = F.when(turbofish, F.regexp_replace(text, TURBOFISH, "")).otherwise(text)
        before = F.when(F.contains(text, F.lit(".")), F.regexp_extract(text, r"^(.*)\.[^.]*$", 1))
        if "cpp" in langs:
            before = F.when(
                F.col("language") == "cpp", F.regexp_extract(text, r"^(.*)(?:->|\.)[^.>]*$", 1)
            ).otherwise(before)
        receiver = F.nullif(before, F.lit(""))
        # a call with type arguments is reported by its whole text, without receiver
        method = (chained | receiver.isNotNull()) & (F.col("language") != "c") & ~(turbofish & text.endswith(">"))
        return F.struct(
            row["line"].cast("bigint").alias("line"),
            (row["at"] % PIECES * PIECES + i).alias("ordinal"),
            text.alias("callee"),
            leaf_name(plain).alias("leaf"),
            method.alias("is_method_call"),
            F.when(method, receiver).alias("receiver"),
            F.coalesce(F.get(row["enclosing"], F.lit(0))["name"], F.lit("")).alias("caller"),
            F.transform(row["enclosing"], lambda e: e["start"]).alias("inside"),
        )

    def counted(c: Column) -> Column:  # static calls in PHP are not reported
        return ~(php & F.contains(c, F.lit("::")))

    return with_text.select(
        "blob_id",
        "language",
        _by_language(langs, shaped).alias("functions"),
        _by_language(langs, lambda r: _import_texts(r, F.col("import_lines"))).alias("imports"),
        F.flatten(
            F.transform(
                "call_lines",
                lambda row: F.transform(F.filter(row["calls"], counted), lambda c, i: call(row, c, i)),
            )
        ).alias("calls"),
    )


def functions_of(symbols: DataFrame) -> DataFrame:
    return symbols.select("blob_id", "language", F.explode("functions").alias("f")).select(
        "blob_id", "language", "f.*"
    )


def imports_of(symbols: DataFrame) -> DataFrame:
    return symbols.select("blob_id", "language", F.posexplode("imports").alias("ordinal", "import_text"))


def calls_of(symbols: DataFrame) -> DataFrame:
    return symbols.select("blob_id", "language", F.explode("calls").alias("c")).select(
        "blob_id", "language", "c.*"
    )
