"""One-line forms of tool calls and results, from a VARIANT column with the call's input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglathe.functions.text import base, clip, flatten, line_count


def string_at(v: Column, key: str) -> Column:
    """The string at ``key``, empty for any other type (a number or list isn't text)."""
    at = F.try_variant_get(v, f"$.{key}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, f"$.{key}", "string")), F.lit(""))


def shell_line(command: Column) -> Column:
    """A command without its here-document, whose lines are counted."""
    at = F.instr(command, "<<")
    head = flatten(F.substring(command, F.lit(1), at - 1))
    inner = F.greatest(line_count(F.substring(command, at, F.length(command))) - 2, F.lit(0))
    return F.when(at > 0, F.concat(head, F.lit(" ‹"), inner.cast("string"), F.lit(" lines›"))).otherwise(command)


def shell_gist(command: Column) -> Column:
    return clip(flatten(shell_line(command)), 110)


def longest_string(v: Column) -> Column:
    """The longest string value of an object, by bytes; of equals the last key's."""
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string, variant>"))
    strings = F.filter(pairs, lambda e: F.schema_of_variant(e.value) == "STRING")
    ranked = F.transform(strings, lambda e: F.struct(F.octet_length(F.try_variant_get(e.value, "$", "string")).alias("n"), e.key.alias("k"), F.try_variant_get(e.value, "$", "string").alias("s")))
    return F.array_max(ranked)["s"]


def todo_gist(v: Column) -> Column:
    todos = F.coalesce(F.try_variant_get(v, "$.todos", "array<struct<status: string, activeForm: string, content: string>>"), F.array().cast("array<struct<status: string, activeForm: string, content: string>>"))
    done = F.concat_ws("/", F.size(F.filter(todos, lambda t: t.status == "completed")).cast("string"), F.size(todos).cast("string"))
    active = F.try_element_at(F.filter(todos, lambda t: t.status == "in_progress"), F.lit(1))
    text = F.coalesce(active["activeForm"], active["content"], F.lit(""))
    return F.when(text == "", F.concat(done, F.lit(" done"))).otherwise(F.concat(done, F.lit(" · "), text))


def tool_gist(name: Column, v: Column) -> Column:
    return clip(flatten(tool_line(name, v)), 110)


def tool_line(name: Column, v: Column) -> Column:
    """What a call shows, by the tool's name."""
    s = lambda k: string_at(v, k)
    number = lambda k: F.try_variant_get(v, f"$.{k}", "bigint")
    file = base(s("file_path"))
    some = lambda x: F.when(F.trim(x) != "", x)
    part = F.coalesce(F.concat(file, F.lit(":"), number("offset").cast("string"), F.lit("–"), (number("offset") + number("limit")).cast("string")), file)
    where = F.when(s("path") == "", s("pattern")).otherwise(F.concat(s("pattern"), F.lit("  in "), base(s("path"))))
    asked = F.coalesce(F.try_variant_get(v, "$.questions", "array<struct<question: string>>"), F.array().cast("array<struct<question: string>>"))
    first = F.coalesce(F.try_element_at(asked, F.lit(1))["question"], F.lit("asked a question"))
    cases = {
        ("Read",): part,
        ("Write",): F.concat(file, F.lit(" ("), line_count(s("content")).cast("string"), F.lit(" lines)")),
        ("Edit", "NotebookEdit"): F.concat(file, F.lit(" +"), line_count(s("new_string")).cast("string"), F.lit("/−"), line_count(s("old_string")).cast("string")),
        ("Grep",): where,
        ("Glob",): s("pattern"),
        ("WebFetch",): s("url"),
        ("WebSearch",): s("query"),
        ("Task", "Agent"): F.when(s("subagent_type") == "", s("description")).otherwise(F.concat_ws(": ", s("subagent_type"), s("description"))),
        ("Skill",): F.trim(F.concat(F.lit("/"), s("skill"), F.lit(" "), s("args"))),
        ("TodoWrite",): todo_gist(v),
        ("AskUserQuestion",): F.when(F.size(asked) > 1, F.concat(first, F.lit("  (+"), (F.size(asked) - 1).cast("string"), F.lit(" more)"))).otherwise(first),
    }
    out = F.when(name.isin("Bash", "BashOutput"), shell_line(s("command")))
    for names, text in cases.items():
        out = out.when(name.isin(*names), text)
    return out.otherwise(F.coalesce(some(s("description")), some(longest_string(v)), name))


def tool_body(name: Column, v: Column) -> Column:
    """A call in full."""
    s = lambda k: string_at(v, k)
    edit = F.concat(s("file_path"), F.lit("\n\n─ before ─\n"), s("old_string"), F.lit("\n\n─ after ─\n"), s("new_string"))
    return (
        F.when(name.isin("Bash", "BashOutput"), s("command"))
        .when(name == "Write", F.concat(s("file_path"), F.lit("\n\n"), s("content")))
        .when(name == "Edit", edit)
        .when(name.isin("Task", "Agent"), s("prompt"))
        .otherwise(F.coalesce(F.to_json(v), F.lit("")))
    )


def result_hint(body: Column, is_error: Column | None = None) -> Column:
    """How a call turned out, in a few words; without ``is_error`` failures look like other results."""
    text = F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))
    n = line_count(text)
    short = F.when((n <= 1) & (F.length(text) <= 48), flatten(text)).otherwise(F.concat(n.cast("string"), F.when(n == 1, " line").otherwise(" lines")))
    if is_error is None:
        return F.when(text == "", "ok").otherwise(short)
    return F.when((text == "") & is_error, "failed").when(text == "", "ok").when(is_error, clip(flatten(text), 60)).otherwise(short)


def rollout_gist(name: Column, body: Column) -> Column:
    return clip(flatten(rollout_line(name, body)), 110)


def rollout_line(name: Column, body: Column) -> Column:
    """What a rollout's call shows: the command inside its wrapper code, else the longest string of
    its arguments, else name and arguments."""
    command = F.regexp_extract(body, r'(?s)"cmd":"(.*?)"', 1)
    plain = F.replace(F.replace(F.replace(command, F.lit("\\n"), F.lit(" ")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    longest = longest_string(F.try_parse_json(body))
    return F.when(F.contains(body, F.lit('"cmd":"')) & (command != ""), plain).otherwise(F.coalesce(longest, F.concat_ws(" ", name, body)))


def part_gist(name: Column, v: Column) -> Column:
    return clip(flatten(part_line(name, v)), 110)


def part_line(name: Column, v: Column) -> Column:
    """What a part's call shows, by the tool's lower-case name."""
    s = lambda k: string_at(v, k)
    text = (
        F.when(name == "bash", s("command"))
        .when(name.isin("read", "write", "edit"), base(s("filePath")))
        .when(name.isin("grep", "glob"), s("pattern"))
        .when(name == "webfetch", s("url"))
        .otherwise(F.coalesce(longest_string(v), F.lit("")))
    )
    return F.when(F.trim(text) == "", name).otherwise(text)
