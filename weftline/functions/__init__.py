"""Column functions: alignment texts, columns of alignments, component look-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of alignment columns and the characters that stand for no base.
BASES = "ACGT"
ALPHABET = "ACGT-"
WILDCARD = "*"
GAP_LIKE = ["-", "#", "*", "=", "X", "@"]
RAW_CHARACTERS, PLAIN_CHARACTERS = "#=X@", "-***"


def species_of(src: Column) -> Column:
    """The part of a source name before its first dot."""
    return F.split_part(src, F.lit("."), F.lit(1))


def chrom_of(src: Column) -> Column:
    """The part of a source name after its first dot."""
    return F.split_part(src, F.lit("."), F.lit(2))


def forward_start(c: Column) -> Column:
    """Where a component starts on the forward strand."""
    return F.when(c["strand"] == "-", c["src_size"] - (c["start"] + c["size"])).otherwise(c["start"])


def forward_end(c: Column) -> Column:
    """Where a component ends on the forward strand."""
    return forward_start(c) + c["size"]


def places(n: Column) -> Column:
    """1 to ``n``; an empty array for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def chars(text: Column) -> Column:
    """The characters of a text; an empty array for an empty one."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def zipped(texts: list[Column]) -> Column:
    """The columns of texts laid above each other, as far as the first goes. Each text is cut into
    characters once, so the cost is linear in its length."""
    out = chars(texts[0])
    for t in texts[1:]:
        out = F.zip_with(out, chars(t), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.filter(out, lambda c: c.isNotNull())


def text_columns(components: Column) -> Column:
    """The columns of a block as strings: a character of each component, as far as the shortest text.
    One pass over the components, linear in the length of their texts."""
    texts = F.transform(components, lambda c: c["text"])
    lay = lambda done, t: F.when(done.isNull(), chars(t)).otherwise(F.zip_with(done, chars(t), lambda a, b: F.concat(a, b)))
    columns = F.aggregate(texts, F.lit(None).cast("array<string>"), lay)
    return F.coalesce(F.filter(columns, lambda c: c.isNotNull()), F.array().cast("array<string>"))


def count_of(text: Column, char: str) -> Column:
    """How often a character stands in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def real_share(text: Column) -> Column:
    """The share of real bases in a text; null for an empty one."""
    return F.try_divide(F.length(F.regexp_replace(F.upper(text), "[^ACGT]", "")).cast("double"), F.length(text))


def density(text: Column, pattern: str, length: Column | None = None) -> Column:
    """Matches of a pattern in an upper-cased text over its length; null where that is 0."""
    return F.try_divide(F.regexp_count(F.upper(text), F.lit(pattern)).cast("double"), F.length(text) if length is None else length)


def component(components: Column, prefix: str) -> Column:
    """The first component whose source starts with ``prefix``; null if there is none."""
    return F.get(F.filter(components, lambda c: F.startswith(c["src"], F.lit(prefix))), F.lit(0))


def entropy_term(p: Column) -> Column:
    """``-p ln p``; 0 for 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))
