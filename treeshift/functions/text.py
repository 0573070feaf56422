"""Column expressions over file content and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's ``trim`` alone takes blanks only."""
    return F.btrim(text, F.lit(" \t\r\n"))


def newline_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def count_lines(text: Column) -> Column:
    """Newlines, plus one for a last line that lacks its newline; 0 when empty."""
    tail = F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return newline_count(text) + tail


def is_binary(text: Column) -> Column:
    return F.contains(text, F.lit("\x00"))


def size_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def text_lines(text: Column) -> Column:
    """Number of lines as counted for statistics: 0 for binary content."""
    return F.when(is_binary(text), F.lit(0).cast("bigint")).otherwise(count_lines(text))


def decode_utf8(raw: Column) -> Column:
    """The text of valid UTF-8 bytes, else NULL."""
    return F.try_validate_utf8(raw.cast("string"))


def line_tokens(text: Column) -> Column:
    """Lines with their newline kept, as a line diff compares them."""
    parts = F.split(text, "\n")
    n = F.size(parts)
    whole = F.transform(F.slice(parts, F.lit(1), n - 1), lambda s: F.concat(s, F.lit("\n")))
    last = F.element_at(parts, -1)
    return F.when(last == "", whole).otherwise(F.concat(whole, F.array(last)))


def leaf_name(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("::")), F.substring_index(name, "::", -1)).otherwise(
        F.substring_index(name, ".", -1)
    )


def packed(name: Column) -> Column:
    """A name as bytes: lower-case hex in half its length, any other text as it is.

    Hex digits of digests do not compress, so half of a shuffled row would be air.
    The last byte tells the two apart; ``unpacked`` gives the name back.
    """
    digits = name.rlike("^(?:[0-9a-f]{2})+$")
    return F.when(digits, F.concat(F.unhex(name), F.unhex(F.lit("01")))).otherwise(
        F.concat(name.cast("binary"), F.unhex(F.lit("00")))
    )


def unpacked(name: Column) -> Column:
    length = F.octet_length(name) - 1
    bytes_ = F.substring(name, F.lit(1), length)
    digits = F.substring(name, length + 1, F.lit(1)) == F.unhex(F.lit("01"))
    return F.when(digits, F.lower(F.hex(bytes_))).otherwise(bytes_.cast("string"))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def tokens_of_bytes(n_bytes: Column) -> Column:
    return F.floor(n_bytes / 4).cast("bigint")


def json_bytes(value: Column) -> Column:
    return F.octet_length(F.to_json(value, {"ignoreNullFields": "false"})).cast("bigint")


def estimate_tokens(value: Column) -> Column:
    """A quarter of the bytes of the value's compact JSON, rounded down."""
    return tokens_of_bytes(json_bytes(value))


def cut_at_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, max(limit - back, 0)).cast("string"))
        for back in range(4)
    ]
    return F.coalesce(*cuts)


def pick_lines(text: Column, first: int, last: int) -> Column:
    """Lines ``first``..``last`` (1-based, inclusive), each ended by a newline."""
    start = max(first - 1, 0)
    bare = F.regexp_replace(text, r"\r?\n\z", "")
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\r?\n"))
    chosen = F.slice(lines, start + 1, max(last - start, 0))
    return F.when(F.size(chosen) == 0, F.lit("")).otherwise(
        F.when(
            (F.size(chosen) == 1) & (F.element_at(chosen, 1) == ""), F.lit("")
        ).otherwise(F.concat(F.array_join(chosen, "\n"), F.lit("\n")))
    )


def file_content(
    text: Column, max_bytes: int | None = None, line_range: tuple[int, int] | None = None
) -> Column:
    """``struct(content, line_count, size_bytes, truncated)``; NULL for NULL text.

    The whole content, unless ``max_bytes`` asks for a cut.
    """
    size = size_bytes(text)
    over, shown = F.lit(False), text
    if max_bytes is not None:
        over = size > max_bytes
        shown = F.when(over, cut_at_bytes(text, max_bytes)).otherwise(text)
    if line_range is not None:
        shown = pick_lines(shown, *line_range)
    binary = is_binary(text)
    content = F.when(binary, F.lit("")).otherwise(shown)
    return F.when(
        text.isNotNull(),
        F.struct(
            content.alias("content"),
            F.when(binary, F.lit(0).cast("bigint")).otherwise(count_lines(shown)).alias("line_count"),
            size.alias("size_bytes"),
            (over & ~binary).alias("truncated"),
        ),
    )
