"""Text expressions: one-line forms, note lines, ages.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Runs of the characters that Unicode calls white space; a list is faster than a property.
_WHITE = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def flatten(text: str | Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), _WHITE, " "))


def clip(text: str | Column, n: int | Column) -> Column:
    """At most ``n`` characters, cut at a space if one stands in the last third."""
    text, n = _c(text), F.lit(n) if isinstance(n, int) else n
    head = F.substring(text, F.lit(1), n - 1)
    space = F.length(head) - F.instr(F.reverse(head), " ") + 1
    before = F.substring(head, F.lit(1), space - 1)
    at_space = F.contains(head, F.lit(" ")) & (F.octet_length(before) > F.floor(2 * n / 3))
    return F.when(F.length(text) <= n, text).when(at_space, F.concat(before, F.lit("…"))).otherwise(F.concat(head, F.lit("…")))


def preview(text: str | Column) -> Column:
    """Prose without its markdown marks and link targets."""
    return F.translate(F.regexp_replace(_c(text), r"\]\([^)]*(\)|$)", ""), "`*_#>[]", "")


def between(text: str | Column, start: str, end: str) -> Column:
    """What stands between two tags, empty if they don't."""
    return F.regexp_extract(_c(text), rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1)


def slash_command(text: str | Column) -> Column:
    """``/command args`` from its envelope; null if there is none."""
    name = F.trim(between(text, "<command-name>", "</command-name>"))
    args = F.trim(between(text, "<command-args>", "</command-args>"))
    return F.when(name != "", F.trim(F.concat_ws(" ", name, args)))


def base(path: str | Column) -> Column:
    """A path's last part."""
    return F.element_at(F.split(F.regexp_replace(_c(path), "/+$", ""), "/"), -1)


def tilde(path: str | Column, home: str | Column) -> Column:
    """A path below the user's home directory with ``~`` for it; ``home`` is a column, as rows come
    from many users."""
    path, home = _c(path), F.coalesce(_c(home), F.lit(""))
    return F.when((home != "") & F.startswith(path, home), F.concat(F.lit("~"), F.substring(path, F.length(home) + 1, F.length(path)))).otherwise(path)


def unslug(slug: str | Column) -> Column:
    """A folder's name as the path it stands for, where nothing else tells it."""
    return F.replace(_c(slug), F.lit("-"), F.lit("/"))


def line_count(text: str | Column) -> Column:
    """Lines; a line end at the very end adds none."""
    text = _c(text)
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))


def pinch(text: str | Column, budget: int) -> Column:
    """Both halves of a text over ``budget`` characters, with a note of what is left out."""
    text = _c(text)
    half = budget // 2
    note = F.concat(F.lit("\n\n[… "), (F.length(text) - budget).cast("string"), F.lit(" characters elided …]\n\n"))
    short = F.concat(F.substring(text, 1, half), note, F.right(text, F.lit(half)))
    return F.when(F.length(text) <= budget, text).otherwise(short)


def prompt_body(label: str | Column, text: str | Column, budget: int = 6000) -> Column:
    return F.concat(F.lit("["), _c(label), F.lit("]\n"), pinch(text, budget))


#: The marks of note lines and their aliases, by rank.
MARKS = ("!", "·", "→")
_ALIASES = ("[!⚠]", "[·*•-]", "[→>]")


def note_rank(line: str | Column) -> Column:
    """0 alert, 1 info, 2 link; an unmarked line is info."""
    line = F.trim(_c(line))
    return F.when(line.rlike(f"^{_ALIASES[0]}"), 0).when(line.rlike(f"^{_ALIASES[2]}"), 2).otherwise(1)


def note_text(line: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(_c(line)), "^[!⚠·*•→>-]", ""))


def note_lines(gist: str | Column) -> Column:
    """The lines below a gist's headline as (note, rank, text)."""
    split = F.split(_c(gist), "\n")
    lines = F.slice(split, F.lit(2), F.size(split))
    mark = lambda r: F.when(r == 0, "alert").when(r == 2, "link").otherwise("info")
    return F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.struct(mark(note_rank(x)).alias("note"), note_rank(x).alias("rank"), note_text(x).alias("text")))


#: Quotes at both ends; a run is tried from its first character only, so that long ones take linear time.
_QUOTES = "^[\"'`]+|(?<![\"'`])[\"'`]+$"


def _clean(line: Column) -> Column:
    line = F.trim(F.regexp_replace(line, "^[-*•#]+", ""))
    line = F.trim(F.regexp_replace(line, _QUOTES, ""))
    return F.regexp_replace(line, r"\.$", "")


def tidy(answer: str | Column) -> Column:
    """An answer as headline and at most three marked lines, alerts first.  Lines end at the first
    unmarked one below the headline.  Only the first four lines with something in them count, so the
    others aren't looked into."""
    more = lambda got, x: F.when((F.size(got) >= 4) | (_clean(note_text(x)) == ""), got).otherwise(F.concat(got, F.array(F.trim(x))))
    first = F.aggregate(F.split(F.trim(_c(answer)), "\n"), F.array().cast("array<string>"), more)
    # an element of its own, as each mention of an expression would be computed again
    return F.element_at(F.transform(F.array(first), _headed), 1)


def _headed(lines: Column) -> Column:
    head = clip(_clean(note_text(F.element_at(lines, 1))), 140)
    below = F.slice(lines, F.lit(2), F.size(lines))
    marked = lambda x: x.rlike("^[!⚠·*•→>-]")
    stop = F.array_position(F.transform(below, marked), False)
    below = F.slice(below, 1, F.least(F.lit(3), F.when(stop > 0, stop - 1).otherwise(F.size(below))).cast("int"))
    mark = lambda r: F.when(r == 0, MARKS[0]).when(r == 2, MARKS[2]).otherwise(MARKS[1])
    notes = F.transform(below, lambda x, i: F.struct(note_rank(x).alias("r"), i.alias("i"), F.concat(mark(note_rank(x)), F.lit(" "), clip(_clean(note_text(x)), 120)).alias("t")))
    return F.when(F.size(lines) < 1, "").otherwise(F.array_join(F.concat(F.array(head), F.transform(F.array_sort(notes), lambda x: x.t)), "\n"))


#: Phrases by which a model speaks to us instead of condensing.
TELLS = (
    "i need to see",
    "please share",
    "please provide",
    "could you provide",
    "i don't have",
    "i do not have",
    "no conversation",
    "as an ai",
    "i'm unable",
    "i am unable",
    "i cannot",
)


def deflected(answer: str | Column) -> Column:
    return F.lower(_c(answer)).rlike("|".join(TELLS))


def message_height(gist: str | Column) -> Column:
    """Lines that a message takes: its headline, and each note with something in it."""
    return F.lit(1) + F.size(F.filter(note_lines(gist), lambda n: n.text != ""))


def short_model(name: str | Column) -> Column:
    """A model's name without provider, vendor and date."""
    tail = F.regexp_replace(F.element_at(F.split(_c(name), "/"), -1), "^claude-", "")
    return F.regexp_replace(tail, r"-\d{8}$", "")


def tag(branch: str | Column, title: str | Column, session: str | Column) -> Column:
    """Branch, else the title's last part, else the id's first six characters."""
    last = F.element_at(F.split(_c(title), "/"), -1)
    return F.coalesce(_c(branch), F.when(last != "", last), F.substring(_c(session).cast("string"), 1, 6))


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def _age(as_of: Column, ts: Column, names: tuple[str, str, str, str], now: int, hours: int) -> Column:
    s = F.greatest(seconds_between(as_of, ts), F.lit(0))
    n = lambda d, half, unit: F.concat(F.floor((s + half) / d).cast("string"), F.lit(unit))
    return F.when(s <= now, names[0]).when(s <= 5400, n(60, 30, names[1])).when(s <= hours, n(3600, 1800, names[2])).otherwise(n(86400, 0, names[3]))


def ago(as_of: Column, ts: str | Column) -> Column:
    """Age in words, by the limits 45 s, 90 min and 1 day; minutes and hours are rounded."""
    return _age(as_of, _c(ts), ("just now", "m ago", "h ago", "d ago"), 45, 86400)


def short_ago(as_of: Column, ts: str | Column) -> Column:
    """Age in a column's width, by the limits 90 s, 90 min and 2 days."""
    return _age(as_of, _c(ts), ("now", "m", "h", "d"), 90, 172800)


def clock(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "HH:mm")


def byte_size(n: str | Column) -> Column:
    n = _c(n)
    part = lambda d, u: F.concat(F.bround(n / d, 0).cast("long").cast("string"), F.lit(u))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, part(1 << 10, "K")).when(n < 1 << 30, part(1 << 20, "M")).otherwise(part(1 << 30, "G"))


def freshness(as_of: Column, ts: str | Column) -> Column:
    """Stage 0, 1 or 2 up to 20, 60 and 180 s of age, null beyond; the future is 0."""
    s = seconds_between(as_of, _c(ts))
    return F.when(s < 20, 0).when(s < 60, 1).when(s < 180, 2)
