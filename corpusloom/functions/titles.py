"""Titles of papers and sections: keys, tokens, venues, tasks and teams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import first_match, strip

#: Words of titles that don't tell one task from another.
TITLE_STOPWORDS = (
    "a an the of in on at for to and or with "
    "overview task tasks lab labs extended abstract clef "
    "detection classification identification prediction recognition "
    "analysis approach using based model models system systems "
    "method methods challenge evaluation text"
).split()
#: Fixed patterns of the titles that organisers give their papers.
OVERVIEW = r"(?iU)\boverview\b|\bextended abstract\b"
ORGANISER = r"(?iU)^\S+\s+20\d\d\s*[—–-]\s*.*\btask\b\s*$"
BEST_OF_LABS = r"(?iU)\bbest of (the )?labs?\b"
SEVERAL_TASKS = r"(?iU)\btasks\b"
_NUMBER = r"(?iU)\btask\s*(\d+)\b"
_HANDLE = r"(?iU)^\s*(?:team\s+)?([\w.\-]{2,30}@[\w.\-]{2,30})\s*[:,]"
_AT = r"(?iU)^\s*(?:team\s+)?([^:]{2,40}?)\s+at\s+\S"
_POSSESSIVE = r"(?iU)[’']s\s+(participation|submission|approach|system|contribution)$"


def normalize_title(title: Column) -> Column:
    """Join key: letters a-z and digits of the lower-case title, all else one space."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_tokens(title: Column) -> Column:
    """Distinct telling words of a title; compounds such as CamelCase count as their parts."""
    spaced = F.regexp_replace(title, "(?<=[a-z0-9])(?=[A-Z])", " ")
    found = F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.char_length(w) > 1) & ~w.isin(TITLE_STOPWORDS)))


def venue(section: Column) -> Column:
    """Short name of a lab from its section heading."""
    before_colon = strip(F.regexp_extract(section, r"^([^:]+):", 1))
    before_dash = strip(F.regexp_extract(section, r"^([^-]+)-", 1))
    return (
        F.when(section.rlike(r"(?U)\(([^()]+)\)\s*$"), strip(F.regexp_extract(section, r"(?U)\(([^()]+)\)\s*$", 1)))
        .when(section.rlike(r"^[^:]+:"), F.regexp_replace(before_colon, r"(?iU)\s+lab$", ""))
        .when(section.rlike(r"^[^-]+-") & (before_dash != "") & ~F.regexp_replace(before_dash, "^@+|@+$", "").contains(" "), before_dash)
        .otherwise(F.coalesce(first_match(section, r"(?U)^(\S+)\s+Lab\b"), section))
    )


def task_name(title: Column) -> Column:
    """The task an overview is about, from its title; never empty for a title that isn't."""
    whole = F.regexp_replace(title, r"\.+$", "")
    topic = F.coalesce(first_match(whole, r"(?isU)^.*?(?:overview|abstract) of (?:the )?(.*)$"), whole)
    after_number = strip(F.coalesce(first_match(topic, r"(?isU)^.*?\bTask\s+\d+\s*[:\-]?\s*(?:on|of)?\s*(.*)$"), F.lit("")))
    named = F.when(after_number != "", after_number).otherwise(topic)
    short = F.regexp_replace(named, r"(?iU)\s+(Task\s+)?(at|in)\s+.+$", "")
    short = strip(F.regexp_replace(strip(short), ":+$", ""))
    return F.when(short != "", short).otherwise(whole)


def task_number(title: Column) -> Column:
    """The number in "Task 2", as text; null if none."""
    return first_match(title, _NUMBER)


def team_name(title: Column) -> Column:
    """Who wrote a working note, where its title says so plainly; null otherwise."""
    before_at = F.regexp_replace(strip(F.regexp_extract(title, _AT, 1)), "^,+|,+$", "")
    team = strip(F.regexp_replace(before_at, _POSSESSIVE, ""))
    plain = (F.size(F.filter(F.split(team, r"(?U)\s+"), lambda w: w != "")) <= 4) & ~F.lower(team).rlike("^(a|an|the) ")
    return F.when(title.rlike(_HANDLE), strip(F.regexp_extract(title, _HANDLE, 1))).when(title.rlike(_AT) & plain, team)


def task_id(parent: Column, year: Column, venue_name: Column, name: Column) -> Column:
    return F.concat(F.lower(parent), year.cast("string"), F.lit("-"), slugify(venue_name), F.lit("-"), slugify(name))
