"""Scalar functions over columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of derived ids.
NAMESPACES = {
    "claude-code/session": "b4a0f5e1-7c23-4d8a-9e12-3f4b5c6d7e8f",
    "pi/session": "c5b1f6e2-8d34-4e9b-af23-405c6d7e8f90",
    "codex/session": "d7e3a8f4-9f56-4abd-c045-627e8f9a0b12",
    "claude-code/synthesized": "d6c2f7e3-9e45-4fac-bf34-516d7e8f9a01",
    "codex/entry": "e8f4b9a5-af67-4bcd-d156-738f9a0b1c23",
    "pi/entry": "f9a5cab6-b078-4cde-e267-849a0b1c2d34",
    "claude-code/entry": "0a16dbc7-c189-4def-f378-95ab1c2d3e45",
}
# Names that sources use for token counts, in order of preference.
USAGE_NAMES = {
    "input_tokens": ("input_tokens", "inputTokens"),
    "output_tokens": ("output_tokens", "outputTokens"),
    "input_tokens_cumulative": ("input_tokens_cumulative", "inputTokensCumulative", "cumulativeInputTokens"),
    "output_tokens_cumulative": ("output_tokens_cumulative", "outputTokensCumulative", "cumulativeOutputTokens"),
    "cache_read_tokens": ("cache_read_input_tokens", "cache_read_tokens", "cacheReadInputTokens", "cacheReadTokens"),
    "cache_creation_tokens": ("cache_creation_input_tokens", "cache_creation_tokens", "cacheCreationInputTokens", "cacheCreationTokens"),
    "reasoning_tokens": ("reasoning_tokens", "reasoningTokens"),
}
SEED_SEPARATOR = "\x1f"
EXCERPT_CHARS = 2048
NOTICE = "\n…[truncated]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uuid5(namespace: str, name) -> Column:
    """RFC 4122 version 5 id of a name; null for a null name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_col(name), "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
                    F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def entry_id(namespace: str, *parts) -> Column:
    """Id of an entry from its seed parts, which the unit separator keeps apart."""
    return uuid5(namespace, F.concat_ws(SEED_SEPARATOR, *[_col(p).cast("string") for p in parts]))


def shell_quote(value) -> Column:
    """A token for a POSIX shell: bare if safe, else in single quotes."""
    v = _col(value)
    return F.when(v.rlike(r"^[A-Za-z0-9_\-./@:+=]+$"), v).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def shell_command(command, cmd, argv) -> Column:
    """The command text: a string, else another string, else an argument array without nulls, quoted."""
    args = _col(argv)
    quoted = F.array_join(F.transform(args, shell_quote), " ")
    return F.coalesce(_col(command), _col(cmd), F.when(F.forall(args, lambda a: a.isNotNull()) & (F.size(args) > 0), quoted))


def usage(json_text) -> Column:
    """Token counts of a source's usage object; null if it has none. Only non-negative integers count."""
    v = _col(json_text)

    def pick(names) -> Column:
        found = [F.get_json_object(v, f"$.{n}") for n in names]
        return F.coalesce(*[F.when(x.rlike(r"^[0-9]{1,18}$"), x.cast("long")) for x in found])

    fields = {k: pick(names) for k, names in USAGE_NAMES.items()}
    some = F.coalesce(*fields.values()).isNotNull()
    return F.when(some, F.struct(*[c.alias(k) for k, c in fields.items()]))


def has_embedded_credentials(url) -> Column:
    return _col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/@\s]*:[^/@\s]+@")


def normalize_remote_url(url) -> Column:
    """One form of a repository's address: https, no user, no trailing .git; null if it is no address."""
    u = F.trim(_col(url))
    scp = r"^[A-Za-z0-9_.-]+@([A-Za-z0-9_.-]+):(.+)$"
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""))
    tail = F.regexp_replace(rest, r"^[^/?#]*", "")
    path = F.regexp_extract(tail, r"^([^?#]*)", 1)
    query = F.regexp_replace(tail, r"^[^?#]*", "")
    bare = lambda p: F.regexp_replace(p, r"\.git$", "")
    remote = F.concat(F.lit("https://"), host, F.lit("/"), bare(F.regexp_replace(path, r"^/+", "")))
    plain = F.concat(scheme, F.lit("://"), host, bare(F.when(path == "", F.lit("/")).otherwise(path)), query)
    is_scp = (scheme == "") & u.rlike(scp)
    from_scp = F.concat(F.lit("https://"), F.regexp_extract(u, scp, 1), F.lit("/"), bare(F.regexp_extract(u, scp, 2)))
    return F.when(is_scp, from_scp).when(scheme.isin("ssh", "git", "git+ssh"), remote).when((scheme != "") & (host != ""), plain)


_TRIM = r"[\s·•]{1,8}"


def strip_spinner(text) -> Column:
    """Trim at most eight blanks and spinner glyphs from either end, where the eight hold a glyph."""
    t = _col(text)
    start = F.when(F.left(t, F.lit(8)).rlike("[·•]"), F.regexp_replace(t, "^" + _TRIM, "")).otherwise(t)
    return F.when(F.right(start, F.lit(8)).rlike("[·•]"), F.regexp_replace(start, _TRIM + r"\z", "")).otherwise(start)


def excerpt(text) -> Column:
    t = _col(text)
    return F.when(F.length(t) <= EXCERPT_CHARS, t).otherwise(F.concat(F.left(t, F.lit(EXCERPT_CHARS)), F.lit("…")))


def squeeze(text) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def pointer_escape(part) -> Column:
    """A part of a JSON Pointer."""
    return F.replace(F.replace(_col(part), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _iso(at: Column) -> Column:
    """A time in UTC; years beyond four digits, and before the year 0, have a sign and six digits."""
    year = F.year(at)
    long_year = F.concat(F.when(year < 0, "-").otherwise("+"), F.lpad(F.abs(year).cast("string"), 6, "0"))
    return F.concat(F.when((year >= 0) & (year <= 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(long_year), F.date_format(at, "-MM-dd'T'HH:mm:ss.SSS'Z'"))


def iso_from_millis(millis) -> Column:
    return _iso(F.timestamp_millis(_col(millis)))


def plain_year(iso) -> Column:
    """A time without the sign and the zeros before a year of more than four digits, as SQL prints it."""
    return F.regexp_replace(_col(iso), r"^\+0*([0-9]{5,6}-)", "$1")


#: Milliseconds from 1970 that a time may be away.
MOST_MILLIS = 8_640_000_000_000_000


def iso_timestamp(value) -> Column:
    """A variant as a time: text as it is unless it is empty, a number as milliseconds from 1970 if such a time exists; else null.

    Years beyond four digits, and before the year 0, have a sign and six digits.
    """
    v = _col(value)
    kind, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    millis = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long")
    iso = _iso(F.timestamp_millis(F.when(F.abs(number) <= MOST_MILLIS, millis)))
    return F.when(text != "", text).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), iso)


def duration_ms(millis, secs, nanos) -> Column:
    return F.coalesce(F.floor(_col(millis)).cast("long"), F.coalesce(_col(secs), F.lit(0)) * 1000 + F.round(F.coalesce(_col(nanos), F.lit(0)) / 1_000_000).cast("long"))


def mangled_cwd(path, wrapped: bool = False) -> Column:
    """The folder name that a working directory gets: separators and colons become dashes; the wrapped form drops the first slash and stands between double dashes."""
    plain = F.regexp_replace(_col(path), r"\\", "/")
    inner = F.regexp_replace(F.regexp_replace(plain, "^/", "") if wrapped else plain, "[/:]", "-")
    return F.concat(F.lit("--"), inner, F.lit("--")) if wrapped else inner


def mask(text) -> Column:
    """A sample that does not show the secret: its length if short, else four characters from either end."""
    t = _col(text)
    return F.when(F.length(t) < 9, F.concat(F.lit("<"), F.length(t), F.lit(" chars>"))).otherwise(F.concat(F.left(t, F.lit(4)), F.lit("…"), F.right(t, F.lit(4))))


def truncate_bytes(text, most: int) -> Column:
    """At most `most` UTF-8 bytes, notice included, cut between characters."""
    t = _col(text)
    budget = max(0, most - len(NOTICE.encode()))
    # Drop the bytes of a character that the cut has split: at most three continuation bytes and their lead.
    raw = F.hex(F.substring(F.encode(t, "UTF-8"), 1, budget))
    nxt = F.hex(F.substring(F.encode(t, "UTF-8"), budget + 1, 1))
    split = nxt.rlike("^[89AB]")
    whole = F.when(split, F.regexp_replace(raw, "[C-F][0-9A-F]([89AB][0-9A-F]){0,3}$", "")).otherwise(raw)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(F.decode(F.unhex(whole), "UTF-8"), F.lit(NOTICE)))


def unified_diff(old, new) -> Column:
    """One hunk that replaces all old lines with all new lines."""
    side = lambda c, sign: F.transform(F.split(_col(c), "\n"), lambda x: F.concat(F.lit(sign), x))
    return F.array_join(F.concat(F.array(F.lit("@@")), side(old, "-"), side(new, "+")), "\n")


def semver_key(version) -> Column:
    """Order of released versions as one number; null if it is no version."""
    v = F.regexp_extract(_col(version), r"([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?", 0)
    part = lambda i: F.coalesce(F.try_element_at(F.split(v, r"\."), F.lit(i)).cast("long"), F.lit(0))
    return F.when(v != "", part(1) * 1_000_000_000_000 + part(2) * 1_000_000 + part(3))


def canonical_tool_name(name) -> Column:
    """A custom tool's name without its namespace."""
    return F.regexp_replace(_col(name), r"^tools\.", "")


def patch_path(patch) -> Column:
    """The one file that a patch touches; null if it touches none or several."""
    found = F.array_distinct(F.regexp_extract_all(_col(patch), F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"), F.lit(1)))
    return F.when(F.size(found) == 1, F.trim(found[0]))


def text_of_blocks(content) -> Column:
    """Text of a message's content (JSON text): a string as it is, the text blocks of an array joined by line feeds, else its JSON."""
    c = _col(content)
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    texts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.text", "string"))
    some = F.filter(texts, lambda t: t.isNotNull())
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY") & (F.size(some) > 0), F.array_join(some, "\n")).otherwise(c)


def in_version_range(version, low: str, high: str) -> Column:
    """Whether a version lies in [low, high); false if it is no version."""
    return F.coalesce((semver_key(version) >= semver_key(F.lit(low))) & (semver_key(version) < semver_key(F.lit(high))), F.lit(False))


def override_ratio(overridden, pure) -> Column:
    """Share of overridden records; 0 where there are none."""
    total = _col(overridden) + _col(pure)
    return F.when(total == 0, F.lit(0.0)).otherwise(_col(overridden) / total)
