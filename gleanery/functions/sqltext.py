"""DuckDB spellings of the text functions, for the SQL twins."""

from __future__ import annotations

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def han_count(c: str) -> str:
    return f"length(regexp_replace({c}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"


def mixed_tokens(c: str) -> str:
    t = f"lower({strip(c)})"
    return (
        f"list_distinct(list_concat(list_filter(regexp_extract_all({t}, '[a-z0-9_]+'), lambda w: length(w) > 1), "
        f"flatten(list_transform(regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]+'), "
        "lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_append(list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS INTEGER), 2)), r) END))))"
    )


def bag_tokens(c: str) -> str:
    t = f"lower({c})"
    return (
        f"list_concat(list_filter(regexp_extract_all({t}, '[a-z0-9_]+'), lambda w: length(w) > 1), "
        f"flatten(list_transform(regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS INTEGER), 2)))))"
    )


def char_pairs(c: str) -> str:
    t = f"regexp_replace({c}, '{SPACE}+', '', 'g')"
    return f"list_distinct(list_transform(range(1, length({t})), lambda i: substr({t}, CAST(i AS INTEGER), 2)))"


def coverage(q: str, d: str) -> str:
    return f"(CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {d})) / len({q}) ELSE 0.0 END)"


def sentences(c: str, separators: str, longer_than: int) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '[{separators}]'), lambda s: {strip('s')}), lambda s: length(s) > {longer_than})"


def slot(term: str, slots: int = 10_000) -> str:
    return f"(CAST('0x' || substr(md5({term}), 1, 8) AS BIGINT) % {slots})"


def values(items) -> str:
    """A list literal of strings."""
    quoted = ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)
    return f"[{quoted}]"
