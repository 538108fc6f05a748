"""Scalar functions on strings, sizes and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_words(text: Column, most: int) -> Column:
    """Cut at the last space if that is beyond three fifths of the limit, else hard, with an ellipsis."""
    cut = F.left(text, F.lit(most))
    space = most + 1 - F.locate(" ", F.reverse(cut))
    return F.when(F.length(text) <= most, text).when(space > most * 0.6, F.concat(F.left(text, (space - 1).cast("int")), F.lit("…"))).otherwise(F.concat(cut, F.lit("…")))


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - len(suffix))), F.lit(suffix))).otherwise(text)


def short_url(url: Column, most: int = 42) -> Column:
    bare = F.regexp_replace(url, r"^https?://(www\.)?", "")
    return F.when(F.length(bare) > most, F.concat(F.left(bare, F.lit(most - 1)), F.lit("…"))).otherwise(bare)


def display_clean(text: Column) -> Column:
    """Without URLs, percent-encoded, query-string and very long tokens."""
    for pattern in (r"https?://\S+", r"\S*%[0-9A-Fa-f]{2}\S*", r"\S+=\S+&\S*", r"\S{40,}"):
        text = F.regexp_replace(text, pattern, " ")
    return squeezed(text)


def file_size(n: Column, largest: str = "GB") -> Column:
    """B, KB, MB or GB, or the largest of them that is wanted; one decimal below ten."""
    found = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for unit, size in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        x = n / size
        text = F.concat(F.when(x < 10, F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)).otherwise(F.floor(x + 0.5).cast("string")), F.lit(f" {unit}"))
        found = found.when(n < size * 1024, text) if unit != largest else found.otherwise(text)
        if unit == largest:
            break
    return found


def relative_time(seconds: Column, at: Column) -> Column:
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit("m ago"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit("h ago")))
        .when(seconds < 604800, F.concat(F.floor(seconds / 86400), F.lit("d ago"))).otherwise(F.date_format(at, "MMM d"))
    )


def safe_key(name: Column) -> Column:
    return F.right(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_"), F.lit(80))


#: What stands in fields of owners without being a person.
NOT_PEOPLE = ("not stated", "unknown", "unassigned", "none", "n/a", "-", "you", "ai")
#: Names of the assistant that writes into the same fields.
ASSISTANTS = ("assistant", "assistant ai")


def tidy_name(name: Column) -> Column:
    """Without quotes around it, with single spaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"""^["']|["']$""", ""), r"\s+", " ")


def is_person(name: Column, assistants: tuple[str, ...] = ASSISTANTS) -> Column:
    """Whether a field names a person: at most four words with a capital, or a handle; no mailbox, identifier, sentence or stand-in. null: no."""
    v = F.regexp_replace(name, r"^\s+|\s+$", "")
    refused = [
        v == "", F.length(v) > 60, F.lower(v).isin(*NOT_PEOPLE, *assistants), v.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), v.contains("@"), F.size(F.split(v, r"\s+")) > 4,
        ~v.rlike("[A-Z]") & ~(v.rlike(r"^\S+$") & v.rlike("[-_.]")), v.rlike(r"[a-z]{2,}\.$"),
    ]
    found = refused[0]
    for more in refused[1:]:
        found = found | more
    return F.coalesce(~found, F.lit(False))


def owner_names(text: Column) -> Column:
    """Names of people on lines such as ``Owner: A, B and C``."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?i)^\s*(owner|owners|assignee|assigned to|lead|author|responsible|maintainer)\s*:"))
    names = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^[^:]*:", ""), r"(?i),| and ")))
    return F.transform(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: is_person(n)), tidy_name)
