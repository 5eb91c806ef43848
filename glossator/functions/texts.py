"""Text expressions: normalisation, excerpts, identifiers, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's Unicode white space, and the byte-order mark, which scripts in browsers count too.
SPACE = r"(?U)[\s\x{FEFF}]"


def _broken(mark: str) -> str:
    """A word that goes on in lower case after a mark at its line's end, the letters beside the break in two groups."""
    gap = r"\s*"
    return rf"(?U)(\p{{L}}){mark}{gap}\n{gap}(\p{{Ll}})"


def normalize_page(text: Column) -> Column:
    """Joins words hyphenated (or soft-hyphenated) over a line's end, makes runs of controls and spaces one space, trims."""
    joined = F.regexp_replace(text, _broken(r"[-\x{AD}]"), "$1$2")
    return F.trim(F.regexp_replace(joined, r"(?U)[\s\x{FEFF}\p{Cc}\p{Cf}]+", " "))


def clean(text: Column) -> Column:
    """For display: joins hyphenated words, collapses white space, trims."""
    joined = F.regexp_replace(text, _broken("-"), "$1$2")
    return F.trim(F.regexp_replace(joined, SPACE + "+", " "))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def excerpt(text: Column, n: int) -> Column:
    """At most n characters, without the word that the cut goes through, and an ellipsis."""
    flat = collapsed(text)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, n), r"(?U)\s+\S*$", ""), F.lit("…")))


def truncated(text: Column, n: int = 2500) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def sentence_end(word: Column) -> Column:
    return F.rlike(word, F.lit("[.!?;:…»”)\\]]$"))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", "")


def n_visible(text: Column) -> Column:
    """Characters other than white space; what has fewer than 100 counts as having no text."""
    return F.length(F.regexp_replace(text, SPACE + "+", ""))


def too_short(text: Column, least: int = 100) -> Column:
    return F.coalesce(n_visible(text), F.lit(0)) < least


def hyphens_restored(text: Column) -> Column:
    """Extractors leave U+0002 for a hyphen at a line's end."""
    return F.replace(text, F.lit("\x02"), F.lit("-\n"))


def pages_of(text: Column) -> Column:
    """Pages of a text, form feeds between them."""
    return F.split(text, F.lit("\f"))


def spread(text: Column, n: Column) -> Column:
    """n pages of equal length, when only their number is known."""
    per = F.greatest(F.ceil(F.length(text) / n).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(text, i * per + 1, per))


def with_starts(pages: Column) -> Column:
    """struct(text, starts): pages joined by newlines, and each one's offset."""
    ends = F.aggregate(pages, F.array().cast("array<int>"), lambda s, p: F.array_append(s, F.coalesce(F.element_at(F.when(F.size(s) > 0, s), -1), F.lit(0)) + F.length(p) + 1))
    starts = F.when(F.size(pages) > 0, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(pages) - 1, F.lit(0))))).otherwise(F.array().cast("array<int>"))
    return F.struct(F.array_join(pages, "\n").alias("text"), starts.alias("starts"))


def page_at(starts: Column, offset: Column) -> Column:
    """The last page that begins at or before offset, from 0."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= offset)) - 1, F.lit(0))


def identifier(text: Column) -> Column:
    """A DOI or ISBN in its bare form."""
    bare = F.regexp_replace(F.lower(text), r"https?://(dx\.)?doi\.org/", "")
    return F.regexp_replace(bare, r"[^0-9a-z./]", "")


def isbns(text: Column) -> Column:
    """Bare numbers of at least ten characters from a list of them."""
    return F.filter(F.transform(F.split(text, r"[\s,;]+"), identifier), lambda x: F.length(x) >= 10)


def page_label(page: Column, approximate: Column) -> Column:
    return F.concat(F.when(approximate, F.lit("≈")).otherwise(F.lit("")), (page + 1).cast("string"))


def prompt(template: Column, query: Column, text: Column) -> Column:
    return F.replace(F.replace(template, F.lit("[QUERY]"), query), F.lit("[TEXT]"), text)


def citation(creators: Column, year: Column, title: Column, page: Column) -> Column:
    """creators, year, title, p. N; what is missing is left out."""
    parts = F.concat_ws(", ", *(F.nullif(c, F.lit("")) for c in (creators, year, title)))
    return F.concat(parts, F.when(page.isNotNull(), F.concat(F.lit(", p. "), (page + 1).cast("string"))).otherwise(F.lit("")))


def query_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def history_id(query: Column, model: Column, source: Column) -> Column:
    """The name under which a search is saved: the first model's by the query alone, others' by model and query; searches of
    assistants apart from the reader's."""
    mine = F.when(model == "lealla", query).otherwise(F.concat_ws("\n", model, query))
    return F.sha2(F.when(source == "mcp", F.concat(F.lit("mcp\n"), mine)).otherwise(mine), 256)


def since_utc(day: Column, zone: str = "UTC") -> Column:
    """Midnight of a day YYYY-MM-DD in zone, as UTC; null for what is no such day."""
    fits = F.when(F.rlike(day, F.lit(r"^\d{4}(-\d\d){2}$")), day)
    return F.to_utc_timestamp(F.try_to_timestamp(fits, F.lit("yyyy-MM-dd")), zone)


def strength(similarity: Column) -> Column:
    return F.greatest(F.lit(0.15), F.least(F.lit(1.0), (similarity - 0.4) / 0.4))


def legacy_passage(text: Column, section: Column, sections: Column, chars: int = 1200) -> Column:
    """A passage guessed from its number alone: its share of the text, moved back to a space up to 40 characters before and on
    to one up to 40 after."""
    n = F.length(text)
    raw = F.floor(section / sections * n).cast("int")
    back = F.instr(F.reverse(F.substring(text, F.greatest(raw - 39, F.lit(1)), F.least(raw, F.lit(40)))), " ")
    start = F.when((raw > 0) & (back > 0), raw - back + 1).otherwise(raw)
    end = start + chars
    ahead = F.instr(F.substring(text, end + 1, F.lit(40)), " ")
    stop = F.when(ahead > 0, end + ahead - 1).otherwise(end)
    return F.trim(F.substring(text, start + 1, stop - start))


def today(zone: str = "UTC", now: Column | None = None) -> Column:
    """The day in a zone, YYYY-MM-DD; now: a UTC instant to be tested with."""
    return F.date_format(F.from_utc_timestamp(now if now is not None else F.current_timestamp(), zone), "yyyy-MM-dd")


def months_ago(day: Column, months: int) -> Column:
    """The same day of the month so many months before; days that it lacks run on into the next month."""
    first = F.add_months(F.trunc(day, "month"), -months)
    return F.date_add(first, F.dayofmonth(day) - 1)


def shown_date(text: Column, pattern: str = "d MMM yyyy") -> Column:
    """A day in the reader's form; what is none, as it is; nothing for nothing."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.when(F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d$")), text), F.lit("yyyy-MM-dd")), pattern), text, F.lit(""))
