"""Text cleaning and byte-exact scalar functions, all native Columns.

Sizes are UTF-8 bytes. Patterns are spelt for Java's dialect where it differs from RE2's:
ASCII word boundaries, white space without the vertical tab, and the Unicode White_Space
set for trimming.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: Unicode White_Space
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: the same set for Python's strip
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: fixed values: what is stripped, in order, and what stands in its place
STRIP = [
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?iu)(?<![0-9A-Za-z_])(?:https?|ftp|mailto):[^ \t\n\f\r)>\]]+", ""),
    (r"<[^>]+>", ""),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def strip_nonsemantic(c: Column) -> Column:
    """Images and links to their texts; URLs and tags away; runs of blanks and of blank lines shortened; trimmed."""
    for pattern, replacement in STRIP:
        c = F.regexp_replace(c, pattern, replacement)
    return trim_space(c)


def normalize_query(c: Column) -> Column:
    """Lower case (letter by letter) with single spaces between words."""
    return trim_space(F.regexp_replace(F.lower(F.translate(c, "İΣ", "iσ")), rf"{SPACE}+", " "))


def cache_key(model: Column, dim: Column, query: Column) -> Column:
    """Null for a null query (or model, or dim)."""
    return F.concat(model, F.lit("\0"), dim.cast("string"), F.lit("\0"), normalize_query(query))


def truncate_bytes(c: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between code points."""
    if n <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    raw = F.encode(c, "UTF-8")

    def inside(place: int) -> Column:
        """Whether the byte there (from 1) continues a code point."""
        if place < 1:
            return F.lit(False)
        return F.conv(F.hex(F.substring(raw, place, 1)), 16, 10).cast("int").between(128, 191)

    back = F.when(~inside(n + 1), 0).when(~inside(n), 1).when(~inside(n - 1), 2).otherwise(3)
    return F.when(F.octet_length(c) <= n, c).otherwise(raw.substr(F.lit(1), F.greatest(F.lit(n) - back, F.lit(0))).cast("string"))


def shrink_size(c: Column) -> Column:
    """Bytes to keep of a text that was too long: four fifths, 256 at least."""
    return F.greatest(F.floor(F.octet_length(c) * 4 / 5), F.lit(256)).cast("int")
