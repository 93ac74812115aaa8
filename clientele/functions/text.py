"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def squash(text: Column) -> Column:
    """Lower case without blanks, as used inside URIs."""
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def one_line(text: Column) -> Column:
    """Line feeds become blanks, runs of blanks become one."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), " +", " ")


def strip_fences(text: Column) -> Column:
    """Remove the words and the code fences a model wraps around its reply,
    wherever they occur."""
    # The strings that are removed, in this order.
    for junk in ("sql", "```", "json", "```"):
        text = F.replace(text, F.lit(junk), F.lit(""))
    return text


def unquote(text: Column) -> Column:
    """Strip double quotes from both ends."""
    return F.btrim(text, F.lit('"'))


def distinct_list(value: Column, sep: str = ",") -> Column:
    """Aggregate: the distinct values in order, joined; NULL without a value.

    `collect_set` drops repeats already on the map side."""
    values = F.collect_set(value)
    return F.when(F.size(values) > 0, F.array_join(F.sort_array(values), sep))


def content_id(*parts: Column) -> Column:
    """md5 over the dot-joined parts. A missing part counts as the word None."""
    return F.md5(F.concat_ws(".", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First capture of a pattern, NULL (not '') when it does not occur."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))
