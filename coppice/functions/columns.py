"""Column expressions over file contents (BINARY) and ids; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_id(ordinal: Column) -> Column:
    """``f`` and at least three digits; wider ordinals keep all theirs."""
    return F.format_string("f%03d", ordinal)


def node_id(file: Column, ordinal: Column) -> Column:
    return F.format_string("%s#%05d", file, ordinal)


def is_file_id(c: Column) -> Column:
    return c.rlike(r"^f[0-9]{3,}$")


def byte_text(content: Column) -> Column:
    """One character a byte, so that string positions are byte offsets."""
    return F.decode(content, "ISO-8859-1")


def byte_lines(content: Column) -> Column:
    """The lines of a file, split at LF only; a closing newline adds an empty last line."""
    return F.split(byte_text(content), "\n", -1)


def last_line(content: Column) -> Column:
    return F.octet_length(content) - F.octet_length(F.replace(content.cast("string"), F.lit("\n"), F.lit(""))) + 1


def end_col(content: Column) -> Column:
    """Bytes after the last newline."""
    return F.octet_length(F.substring_index(content.cast("string"), "\n", -1))


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    return F.substring(content, start + 1, end - start)


def line_start(starts: Column, line: Column) -> Column:
    """The offset of a 1-based line, 0 where there is no such line."""
    return F.coalesce(F.get(starts, line - 1), F.lit(0))


def wrapped_base64(content: Column) -> Column:
    """Text where the bytes are UTF-8, else null; and base64 where they are not."""
    valid = F.is_valid_utf8(content)
    return F.struct(F.when(valid, content.cast("string")).alias("text"), F.when(~valid, F.base64(content)).alias("__b64"))


def top_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Case counts in the extensions, not in the name."""
    low = F.lower(path)
    out = F.lit(False)
    for e in extensions:
        out = out | low.endswith(e)
    return out


def positive_or_null(line: Column) -> Column:
    return F.when(line > 0, line)


def json_string(s: Column) -> Column:
    """A string as canonical JSON: short escapes, lower-case \\u00xx for other controls, the rest as it is.

    ``to_json`` writes the same but for upper-case hex digits, so only those are touched.
    """
    body = F.to_json(F.struct(s.alias("s")))
    quoted = F.substring(body, F.lit(6), F.length(body) - 6)
    for upper in "ABCDEF":
        for high in "01":
            quoted = F.replace(quoted, F.lit(f"\\u00{high}{upper}"), F.lit(f"\\u00{high}{upper.lower()}"))
    return quoted


def json_bytes(content: Column) -> Column:
    """Bytes as a JSON value: a string where they are UTF-8, else their base64 in an object."""
    encoded = F.concat(F.lit('{"__b64":"'), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")), F.lit('"}'))
    return F.when(F.is_valid_utf8(content), json_string(content.cast("string"))).otherwise(encoded)
