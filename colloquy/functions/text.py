"""Scalar expressions on messages, keys and documents; all are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_time(at: Column) -> Column:
    """Microseconds only where there are some, as ISO writers do."""
    return F.when(F.date_format(at, "SSSSSS") == "000000", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    """False where either is null or the part is empty."""
    return F.coalesce((part != "") & F.contains(F.lower(text), F.lower(part)), F.lit(False))


def search_tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more, in order (Latin text; other scripts need a segmenter)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def estimated_tokens(content: Column) -> Column:
    return F.coalesce(F.floor(F.length(content) / 4), F.lit(0)).cast("long")


def truncated(text: Column, limit: int = 4000, marker: str = "[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n" + marker))).otherwise(text)


def parsed_range(start: Column, end: Column) -> tuple[Column, Column]:
    """ISO bounds; a bad start drops both, a bad end only itself."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    good = start.isNull() | a.isNotNull()
    return F.when(good, a), F.when(good, b)


def tool_arguments(text: Column) -> Column:
    """JSON text of the arguments; {} where it is empty, null or not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(F.nullif(text, F.lit("")))), F.lit("{}"))


def decoded(code: Column, names: dict[int, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for k, v in names.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(default))


def identity(code: Column) -> Column:
    """Kind of a user; null for an unknown code."""
    return decoded(code, {1: "STUDENT", 2: "TEACHER", 3: "ADMIN"})


def group_role(roles_json: Column, group_id: Column) -> Column:
    """Role of a group in a JSON map of group to code; bad JSON and missing groups are no members."""
    code = F.element_at(F.from_json(roles_json, "map<string,int>"), group_id)
    return decoded(code, {0: "OWNER", 1: "ADMIN", 2: "MEMBER", -1: "NOT_MEMBER"}, "NOT_MEMBER")


def object_key(skill: Column, version: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit("skills"), skill, version, path)


def parsed_key(key: Column) -> Column:
    """struct(skill_id, version, path) of an object key, null where it is none."""
    part = lambda n: F.regexp_extract(key, r"^skills/([^/]+)/([^/]+)/(.+)$", n)
    return F.when(part(1) != "", F.struct(part(1).alias("skill_id"), part(2).alias("version"), part(3).alias("path")))


def asset_kind(path: Column) -> Column:
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return F.when(first == "references", "reference").when(first == "templates", "template").when(first == "scripts", "script").when(first == "examples", "example").otherwise("other")


def safe_path(path: Column) -> Column:
    """Relative, not empty, without backslashes and parent folders."""
    return F.coalesce((path != "") & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & ~F.exists(F.split(path, "/"), lambda p: p == ".."), F.lit(False))


def cache_name(key: Column) -> Column:
    return F.concat(F.sha1(key), F.lit(".asset"))


def model_name(name: Column, provider: str = "openai") -> Column:
    return F.when(F.contains(name, F.lit("/")), name).otherwise(F.concat(F.lit(provider + "/"), name))


def clean_title(raw: Column, old: Column) -> Column:
    """Trimmed and without quotes around it; the old title where nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim(raw), "^[\"']+|[\"']+$", "")), F.lit("")), old)


def or_default(value: Column, default: str) -> Column:
    """The default for null and empty values."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def http_status(code: Column) -> Column:
    return F.when(code >= 50000, 500).otherwise(200)


def rpc_outcome(status: Column, body: Column) -> Column:
    """retry on 5xx; fail without a JSON body of code 200; else ok."""
    code = F.try_variant_get(F.try_parse_json(body), "$.code", "int")
    return F.when(status >= 500, "retry").when(code == 200, "ok").otherwise("fail")


def decoded_utf8(data: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(data), F.format_string("[binary content, %d bytes]", F.octet_length(data)))


def front_matter(text: Column) -> Column:
    """struct(head, body): the block between a first line `---` and the next one; an unclosed block is body."""
    pattern = r"(?s)^---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n(.*))?$"
    closed = F.rlike(text, F.lit(pattern))
    return F.struct(F.when(closed, F.regexp_extract(text, pattern, 1)).otherwise("").alias("head"), F.when(closed, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


#: A scalar in double or single quotes, or plain up to a comment; in lists, plain up to a comma or bracket.
QUOTED = r"""\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'"""
PLAIN, PLAIN_ITEM = r"(?:[^\s#\r\n]|(?<=\S)#|[ \t]+(?=[^\s#]))*", r"[^,\[\]\r\n]*"


def _scalar(text: Column) -> Column:
    """A YAML scalar without its quotes: '' is a quote inside single ones, a backslash keeps a quote or backslash inside double ones."""
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    double = F.regexp_replace(inner, r'\\(["\\])', "$1")
    single = F.regexp_replace(inner, "''", "'")
    long = F.length(text) > 1
    return F.when(long & F.startswith(text, F.lit('"')), double).when(long & F.startswith(text, F.lit("'")), single).otherwise(F.trim(text))


def front_value(head: Column, name: str) -> Column:
    """A scalar entry of a front matter head, quoted or plain, without comments; null where it is absent or empty.

    Only entries at the margin count; of repeated ones the first.
    """
    return F.nullif(_scalar(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*({QUOTED}|{PLAIN})[ \t]*(?:#.*)?\r?$", 1)), F.lit(""))


def front_list(head: Column, name: str) -> Column:
    """The entries of a list `name:` of a front matter head, in block form or in brackets; empty where there is none.

    Entries are scalars as in `front_value`; empty ones go.
    """
    block = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(?:#.*)?((?:\r?\n[ \t]*(?:-[ \t][^\r\n]*|#[^\r\n]*|(?=\r?\n)))+)", 1)
    dashed = F.regexp_extract_all(block, F.lit(rf"(?m)^[ \t]*-[ \t]+({QUOTED}|{PLAIN})"), F.lit(1))
    inside = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\[((?:{QUOTED}|[^\]])*)\]", 1)
    bracketed = F.regexp_extract_all(inside, F.lit(rf"\s*({QUOTED}|{PLAIN_ITEM})\s*(?:,|$)"), F.lit(1))
    return F.filter(F.transform(F.concat(dashed, bracketed), _scalar), lambda t: t != "")


def skill_document() -> Column:
    """A skill (skill_id, version, display_name, skill_md, assets) as text: head, body, and a line for each asset if it has any."""
    line = lambda a: F.format_string("* %s (%s, %d bytes): %s", a["path"], a["kind"], a["size_bytes"], F.coalesce(a["description"], F.lit("")))
    assets = F.when(F.size("assets") > 0, F.concat(F.lit("\nassets:\n"), F.array_join(F.transform("assets", line), "\n")))
    head = F.format_string("skill %s, version %s\nname: %s\n", F.col("skill_id"), F.col("version"), F.col("display_name"))
    return F.concat_ws("\n", head, F.lit("--- body ---"), F.rtrim("skill_md"), F.lit("--- end ---"), assets)


def listed(names: Column) -> Column:
    """Names in order, or `none`."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(names), ", "), F.lit("")), F.lit("none"))


def skill_metadata(skill_id: Column, version: Column, head: Column) -> Column:
    """Metadata of a bundle from its front matter: names fall back on the id, switches on true; the folder's version stands."""
    enabled = F.lower(F.coalesce(front_value(head, "enabled"), F.lit("true")))
    return F.struct(
        skill_id.alias("skill_id"), F.coalesce(front_value(head, "display_name"), front_value(head, "name"), skill_id).alias("display_name"), F.coalesce(front_value(head, "description"), F.lit("")).alias("description"),
        front_list(head, "triggers").alias("triggers"), (~enabled.isin("false", "no", "off", "0")).alias("enabled"), version.alias("version"), F.coalesce(front_value(head, "version"), version).alias("declared_version"),
    )


def message_json(role: Column, content: Column, tool_calls: Column, tool_call_id: Column, name: Column) -> Column:
    """A message as a model's interface takes it: role and content always, the others where they hold something."""
    some = lambda c: F.nullif(c, F.lit(""))
    rest = F.to_json(F.struct(F.when(F.size(tool_calls) > 0, tool_calls).alias("tool_calls"), some(tool_call_id).alias("tool_call_id"), some(name).alias("name")))
    both = F.to_json(F.struct(role.alias("role"), content.alias("content")), {"ignoreNullFields": "false"})
    return F.when(rest == "{}", both).otherwise(F.concat(F.regexp_replace(both, r"\}$", ","), F.substr(rest, F.lit(2))))


def summary_request(lines: Column, summary: Column) -> Column:
    """The text that asks for a summary: the old one where there is one, the new lines, and the task, with blank lines between."""
    old = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Summary so far:\n"), summary))
    return F.concat_ws("\n\n", old, F.concat(F.lit("New messages:\n"), lines), F.lit("Write one summary of all of this."))


def expired(modified: Column, now: Column, seconds: int) -> Column:
    """Whether a cached file is older than its time to live."""
    return modified < now - F.make_dt_interval(secs=F.lit(seconds))


def asset_document(path: Column, data: Column, limit: int = 4000) -> Column:
    """An asset's text under its path, cut at `limit` characters."""
    return F.format_string("asset %s\n---\n%s\n---", path, truncated(decoded_utf8(data), limit))
