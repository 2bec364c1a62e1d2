"""Text functions as Spark column expressions (whole-stage JVM code, no Python in the rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[一-鿿]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c, digits: int) -> Column:
    """Rounded in decimal arithmetic, where a tie is a tie."""
    return F.round(_col(c).cast("decimal(28,9)"), digits).cast("double")


def strip(c) -> Column:
    """Trim every kind of white space, as opposed to spaces only."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def han_count(c) -> Column:
    return F.length(F.regexp_replace(_col(c), r"[^一-鿿]", ""))


def _grams(run: Column, n: int = 2) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))


def mixed_tokens(c) -> Column:
    """Set of Latin words over one letter, Han pairs, single-character Han runs and whole Han runs."""
    t = F.lower(strip(c))
    latin = F.filter(F.regexp_extract_all(t, F.lit(r"([a-z0-9_]+)"), 1), lambda w: F.length(w) > 1)
    runs = F.regexp_extract_all(t, F.lit(rf"({HAN}+)"), 1)
    han = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(_grams(r), F.array(r)))))
    return F.array_distinct(F.concat(latin, han))


def bag_tokens(c) -> Column:
    """Bag for ranking: Latin words over one letter and Han pairs, repeats kept."""
    t = F.lower(_col(c))
    latin = F.filter(F.regexp_extract_all(t, F.lit(r"([a-z0-9_]+)"), 1), lambda w: F.length(w) > 1)
    runs = F.filter(F.regexp_extract_all(t, F.lit(rf"({HAN}+)"), 1), lambda r: F.length(r) > 1)
    return F.concat(latin, F.flatten(F.transform(runs, lambda r: _grams(r))))


#: Stop words of the white-space keyword extractor.
KEYWORD_STOPS = ("的", "了", "是", "在", "有", "和", "与", "或", "等", "the", "a", "an", "is", "are", "was", "were")


def keywords(c) -> Column:
    """White-space words, lower case, without stop words and single characters; order and repeats kept."""
    return F.filter(F.split(strip(F.lower(_col(c))), r"(?U)\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*KEYWORD_STOPS))


def clean_query(c) -> Column:
    """One space for each run of white space, then a space for every character that is no word character."""
    one = strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))
    return F.regexp_replace(one, r"(?U)[^\w\s一-鿿]", " ")


def char_pairs(c) -> Column:
    """Set of character pairs after taking out white space."""
    # Bound to a lambda's variable, the text is squeezed once and not for every pair.
    squeezed = F.array(F.regexp_replace(_col(c), r"(?U)\s+", ""))
    return F.array_distinct(F.flatten(F.transform(squeezed, lambda t: F.when(F.length(t) > 1, _grams(t)).otherwise(F.array().cast("array<string>")))))


def coverage(query: Column, document: Column) -> Column:
    """Share of the query's items found in the document; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, document)) / F.size(query)).otherwise(F.lit(0.0))


def sentences(c, separators: str, longer_than: int) -> Column:
    """Parts between ``separators`` (a character class), trimmed, of more than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(_col(c), f"[{separators}]"), strip), lambda s: F.length(s) > longer_than)


def token_estimate_rounded(c) -> Column:
    """int(1.5 * Han characters + 0.25 * others)."""
    han = han_count(c)
    return F.floor(1.5 * han + 0.25 * (F.length(_col(c)) - han)).cast("long")


def token_estimate_length(c) -> Column:
    """int(1.3 * characters)."""
    return F.floor(F.length(_col(c)) * 1.3 + 1e-9).cast("long")


def stable_slot(term: Column, slots: int = 10_000) -> Column:
    """Reproducible hash slot of a term: the first 8 hex digits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(slots))


def short_id(*parts, length: int = 12) -> Column:
    """Prefix of the MD5 of the parts joined with colons."""
    return F.substring(F.md5(F.concat_ws(":", *[_col(p).cast("string") for p in parts])), 1, length)


def numeric_id(c) -> Column:
    """The first 15 hex digits of the MD5 as a number (60 bits)."""
    return F.conv(F.substring(F.md5(_col(c)), 1, 15), 16, 10).cast("long")


def parse_when(c) -> Column:
    """Timestamp from ISO, slash and RFC-822 forms, else a date found inside the text."""
    t = strip(c)
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd")
    tries = [F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))]
    tries += [F.try_to_timestamp(t, F.lit(f)) for f in formats]
    pattern = r"(20\d{2})[-/年](\d{1,2})[-/月](\d{1,2})"
    part = lambda i: F.regexp_extract(t, pattern, i)
    inside = F.when(part(1) != "", F.try_to_timestamp(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), F.lit("yyyy-MM-dd")))
    return F.coalesce(*tries, inside)


#: The entities that are unescaped without a lookup table.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(c) -> Column:
    """Tags become spaces, common entities characters, white space one space."""
    t = F.regexp_replace(_col(c), r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))
