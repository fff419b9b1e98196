"""Column functions for urls, sizes, dates and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_final_slash(c: Column) -> Column:
    return F.regexp_replace(c, r"/\s*$", "")


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(strip_final_slash(c), "/"), -1)


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def size_bytes(c: Column) -> Column:
    """'12.5 MB' as bytes; null if it isn't a size."""
    n = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)\s*([KMG]?)B", 1).try_cast("double")
    unit = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)\s*([KMG]?)B", 2)
    scale = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1)
    return F.floor(n * scale).cast("long")


def version_parts(c: Column) -> Column:
    """Leading numbers of a version as an array that sorts in order of version; ':' counts as '.', final zeros drop."""
    parts = F.transform(F.split(F.replace(c, F.lit(":"), F.lit(".")), r"\."), lambda x: F.coalesce(F.regexp_extract(x, "^([0-9]+)", 1).try_cast("long"), F.lit(0).cast("long")))
    kept = F.aggregate(F.reverse(parts), F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) & (x == 0), acc).otherwise(F.concat(acc, F.array(x))))
    return F.reverse(kept)


def category(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose text the value contains; null if none does."""
    out = F.when(F.lit(False), "")
    for needle, name in rules:
        out = out.when(F.contains(c, F.lit(needle)), name)
    return out


def categories(c: Column, first: list[tuple[str, str]], second: list[tuple[str, str]]) -> Column:
    """(first, second, reject_reason): a name by each of two ordered lists of rules, in any case of letters.

    A value that one list has no rule for is rejected: unknown_first or unknown_second, both names then null. Null is
    unknown_first.
    """
    lower = F.lower(c)
    a, b = (category(lower, [(needle.lower(), name) for needle, name in rules]) for rules in (first, second))
    reason = F.when(a.isNull(), "unknown_first").when(b.isNull(), "unknown_second")
    return F.struct(F.when(reason.isNull(), a).alias("first"), F.when(reason.isNull(), b).alias("second"), reason.alias("reject_reason"))


def split_group(c: Column) -> tuple[Column, Column]:
    """(group, artifact) of a dotted name: all before the last dot, and the rest; no dot gives an empty group."""
    return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1), F.element_at(F.split(c, r"\."), -1)


def coordinates(path_col: Column) -> Column:
    """group, artifact and version of a repository path group/parts/artifact/version/file; null if it is too short."""
    s = F.filter(F.split(path_col, "/"), lambda x: x != "")
    made = F.struct(F.array_join(F.slice(s, F.lit(1), F.size(s) - 3), ".").alias("group"), F.element_at(s, -3).alias("artifact"), F.element_at(s, -2).alias("version"))
    return F.when(F.size(s) >= 4, made)


def version_key(c: Column, parts: int | None = None) -> Column:
    """An array that sorts as versions do, of the first so many dotted parts if given.

    ':' counts as '.', parts split at '-', numbers come before text, and missing parts count as zero, so that 1.0 = 1 and
    1.0 < 1.0-rc < 1.2 < 1.10.
    """
    dotted = F.split(F.replace(c, F.lit(":"), F.lit(".")), r"\.")
    if parts is not None:
        dotted = F.slice(dotted, 1, parts)

    def piece(x: Column) -> Column:
        number = x.rlike("^[0-9]{1,38}$")
        return F.struct(F.when(number, 0).otherwise(1).alias("is_text"), F.when(number, x.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"), F.when(number, "").otherwise(x).alias("text"))

    def trimmed(items: Column, keep) -> Column:
        def cut(found: Column) -> Column:
            at = F.filter(F.transform(found, lambda x, i: F.when(keep(x), i + 1)), lambda i: i.isNotNull())
            return F.slice(found, F.lit(1), F.coalesce(F.array_max(at), F.lit(0)))

        return F.transform(F.array(items), cut)[0]  # bound to a name, as items would else be made once for each mention

    inner = F.transform(dotted, lambda p: trimmed(F.transform(F.split(p, "-"), piece), lambda x: (x["is_text"] == 1) | (x["num"] != 0)))
    return trimmed(inner, lambda p: F.size(p) > 0)


def version_length(c: Column) -> Column:
    return F.size(F.split(F.replace(c, F.lit(":"), F.lit(".")), r"\."))


def app_name(title: Column, version: Column) -> Column:
    """A title up to its version, or else up to its first number; the whole title if it starts there or has none."""
    at = F.instr(title, version)
    number = F.regexp_instr(title, F.lit(r"[0-9]+\b"))
    return F.when(at > 1, F.trim(F.substring(title, F.lit(1), at - 1))).when(number > 1, F.trim(F.substring(title, F.lit(1), number - 1))).otherwise(title)


#: Words of a title and the type that they mean; the first that occurs counts.
VERSION_WORDS = (("beta", "beta"), ("alpha", "alpha"), ("alfa", "alpha"), ("test", "alpha"), ("rc", "rc"), ("free", "free"), ("pro", "pro"))


def version_type(title: Column) -> Column:
    out = F.when(F.lit(False), "")
    for word, kind in VERSION_WORDS:
        out = out.when(F.lower(title).rlike(rf"\b{word}\b"), kind)
    return out


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def digits(c: Column) -> Column:
    """The digits of a text as a number; null if it has none."""
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("long")


def experiment_name(file: Column) -> Column:
    """A file's base name without extensions and without the random part before the port."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\..*$", ""), "^[a-zA-Z0-9]+-(443-)", "$1")


def date_part(c: Column) -> Column:
    return F.substring_index(c, "T", 1)


def tolerant_epoch(c: Column) -> Column:
    """Seconds since 1970 of an ISO time; null if it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "Z$", ""), "T", " ")))


def link_last(c: Column) -> Column:
    """The url that an HTTP Link header names as the last page."""
    return F.regexp_extract(c, r'<([^<>]*)>; rel="last"', 1)


def should_follow(url: Column, deny: list[str]) -> Column:
    """Is the path's extension none of those denied."""
    return ~F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)).isin(deny)


def is_version_folder(c: Column) -> Column:
    """Does the last segment start with a number or v and a number."""
    return last_segment(c).rlike(r"^v?[0-9]+([.-].*)?$")


def host_allowed(url: Column, domains: list[str], words: list[str]) -> Column:
    """Is the host one of the domains, below one, or does it contain a word."""
    out = F.lit(False)
    for d in domains:
        out = out | (host(url) == d) | F.endswith(host(url), F.lit("." + d))
    for w in words:
        out = out | F.contains(host(url), F.lit(w))
    return out


def blocks(c: Column) -> Column:
    """The BEGIN blocks of armored text, as an array of (label, body): body is the base64 between headers and checksum.

    A block goes to its END, or without one to the next BEGIN or the text's end. Headers may go on in indented lines.
    """
    found = F.filter(F.split(c, "(?=-----BEGIN )"), lambda x: x.rlike("^-----BEGIN [A-Z0-9 ]+-----"))
    inner = lambda x: F.regexp_replace(x, r"(?s)^-----BEGIN [A-Z0-9 ]+-----|-----END.*$", "")
    body = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(inner(x), r"(?m)^[A-Za-z][A-Za-z0-9-]*:.*$(?:\r?\n[ \t]+\S.*$)*", ""), r"\n=[A-Za-z0-9+/]{4}\s*$", ""), r"\s+", "")
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^-----BEGIN ([A-Z0-9 ]+)-----", 1).alias("label"), body(x).alias("body")))


def first_known(*cs: Column) -> Column:
    """The first that is not null."""
    return F.coalesce(*cs)


def first_of(values: Column, default=None) -> Column:
    """The first item of a list, or the default if there is none or it is null."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(default))


def last_of(values: Column, default=None) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(default))


def without_nulls(values: Column) -> Column:
    return F.array_compact(values)


def stripped(c: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def lowered(c: Column) -> Column:
    return F.lower(F.trim(c))


def tolerant_long(c: Column, default: int | None = None) -> Column:
    """A text as a whole number, or the default."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("long"), F.lit(default).cast("long"))


def tolerant_double(c: Column, default: float | None = None) -> Column:
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(default).cast("double"))


def typed_json(df: DataFrame, **columns: Column) -> Column:
    """JSON of columns of df, nulls left out: times as seconds since 1970, dates and decimals as text, sets as sorted lists."""
    types = df.select(*[c.alias(name) for name, c in columns.items()]).schema

    def encoded(name: str, c: Column) -> Column:
        kind = types[name].dataType.simpleString()
        if kind.startswith("timestamp"):
            c = F.unix_timestamp(c.cast("timestamp"))
        elif kind == "date" or kind.startswith("decimal"):
            c = c.cast("string")
        elif kind.startswith("array"):
            c = F.array_sort(F.array_distinct(c))
        return c.alias(name)

    return F.to_json(F.struct(*[encoded(name, c) for name, c in columns.items()]))
