"""Scalar functions of the history engine, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def object_id(kind: str, content: Column, algorithm: str = "sha1") -> Column:
    """Hash of the header "<kind> <length>\\0" and the content (BINARY)."""
    head = F.concat(F.encode(F.concat(F.lit(kind + " "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\x00"))
    whole = F.concat(head, content)
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def subject(message: Column) -> Column:
    """The first paragraph on one line."""
    first = F.regexp_extract(F.regexp_replace(message, r"^(?:[ \t]*\n)+", ""), r"(?s)^(.*?)(?:\n[ \t]*(?:\n.*)?)?$", 1)
    return F.rtrim(F.regexp_replace(first, r"[ \t]*\n", " "))


def body(message: Column) -> Column:
    """What follows the first paragraph and the blank lines after it."""
    return F.regexp_extract(F.regexp_replace(message, r"^(?:[ \t]*\n)+", ""), r"(?s)^.*?\n(?:[ \t]*\n)+(.*)$", 1)


def sanitized_subject(text: Column) -> Column:
    """A file name from a subject: runs of other characters become one dash, runs of dots one dot."""
    x = F.regexp_replace(text, r"[^A-Za-z0-9._]+", "-")
    x = F.regexp_replace(x, r"\.+", ".")
    return F.regexp_replace(F.regexp_replace(x, r"^[-]+", ""), r"[-.]+$", "")


def parse_bool(x: Column) -> Column:
    """true, yes, on and integers but 0; false, no, off, 0 and the empty text; null for anything else."""
    y = ascii_lower(x)
    number = parse_int(x)
    return F.when(y.isin("true", "yes", "on"), True).when(y.isin("false", "no", "off", ""), False).otherwise(number != 0)


def parse_int(x: Column) -> Column:
    """Decimal, 0x or octal digits with a k, m or g suffix; null where it isn't a number or overflows 64 bits."""
    y = ascii_lower(F.trim(x))
    digits = F.regexp_extract(y, r"^([-+]?)(0x[0-9a-f]+|[0-9]+)([kmg]?)$", 2)
    sign = F.regexp_extract(y, r"^([-+]?)(0x[0-9a-f]+|[0-9]+)([kmg]?)$", 1)
    unit = F.regexp_extract(y, r"^([-+]?)(0x[0-9a-f]+|[0-9]+)([kmg]?)$", 3)
    scale = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1).cast("decimal(20,0)")
    hexa, octal = F.substring(digits, 3, 40), F.substring(digits, 2, 40)
    value = (
        F.when(digits.startswith("0x"), F.conv(hexa, 16, 10))
        .when(digits.rlike("^0[0-7]+$"), F.conv(octal, 8, 10))
        .when(digits.rlike("^(0|[1-9][0-9]*)$"), digits)
        .try_cast("decimal(20,0)")
    )
    value = value * scale * F.when(sign == "-", -1).otherwise(1)
    return F.when((value >= F.lit("-9223372036854775808").cast("decimal(20,0)")) & (value <= F.lit("9223372036854775807").cast("decimal(20,0)")), value).try_cast("bigint")


def offset_minutes(text: Column) -> Column:
    """+hhmm or -hhmm to minutes."""
    n = text.cast("int")
    return F.when(text.rlike(r"^[+-]\d{4}$"), (F.signum(n) * (F.floor(F.abs(n) / 100) * 60 + F.abs(n) % 100)).cast("int"))


def offset_text(minutes: Column) -> Column:
    m = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))


def relative_date(seconds_ago: Column) -> Column:
    """"3 weeks ago": the unit is chosen by the usual thresholds, each rounded to the nearest."""
    d = seconds_ago.cast("bigint")

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))

    minutes = F.floor((d + 30) / 60)
    hours = F.floor((minutes + 30) / 60)
    days = F.floor((hours + 12) / 24)
    months = F.floor((days * 12 * 2 + 365) / (365 * 2))
    years, rest = F.floor(months / 12), months % 12
    with_months = F.concat(
        years.cast("string"), F.when(years == 1, " year").otherwise(" years"), F.when(rest > 0, F.concat(F.lit(", "), rest.cast("string"), F.when(rest == 1, " month").otherwise(" months"))).otherwise(""), F.lit(" ago")
    )
    return (
        F.when(d < 0, "in the future")
        .when(d < 90, ago(d, "second"))
        .when(minutes < 90, ago(minutes, "minute"))
        .when(hours < 36, ago(hours, "hour"))
        .when(days < 14, ago(days, "day"))
        .when(days < 70, ago(F.floor((days + 3) / 7), "week"))
        .when(days < 365, ago(F.floor((days + 15) / 30), "month"))
        .when(days < 1825, with_months)
        .otherwise(ago(F.floor((days + 183) / 365), "year"))
    )


def shell_quote(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("!"), F.lit("'\\!'")), F.lit("'"))


def percent_decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def is_binary(content: Column) -> Column:
    """For a diff: a NUL in the first 8000 bytes."""
    return F.contains(F.substring(content, 1, 8000), F.lit(b"\x00"))


def text_stats(text: Column) -> dict[str, Column]:
    """Counts of NUL, CR LF pairs, lone CR, lone LF and other control characters."""

    def n(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    crlf = F.floor(n("\r\n") / 2)
    return {"nul": n("\x00"), "crlf": crlf, "lone_cr": n("\r") - crlf, "lone_lf": n("\n") - crlf, "nonprintable": F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x07\x0e-\x1a\x1c-\x1f\x7f]", ""))}


def to_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def to_crlf(text: Column) -> Column:
    return F.replace(to_lf(text), F.lit("\n"), F.lit("\r\n"))


def ident_expanded(text: Column, oid: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\$Id(?::[^$\n]*)?\$"), F.concat(F.lit(r"\$Id: "), oid, F.lit(r" \$")))


def ident_collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\$Id:[^$\n]*\$", r"\$Id\$")


def cleaned_message(text: Column, comments: bool = True) -> Column:
    """Comment lines and trailing spaces go, blank lines fold to one, and none stand at either end."""
    x = F.regexp_replace(text, r"(?m)^#.*(?:\n|$)", "") if comments else text
    x = F.regexp_replace(x, r"(?m)[ \t\r]+$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return F.when(x == "", x).otherwise(F.concat(x, F.lit("\n")))


def trailers(message: Column) -> Column:
    """[(key, value)] of the last paragraph, if each of its lines is a trailer or goes on from one."""
    last = F.regexp_extract(F.rtrim(F.regexp_replace(message, r"\s+$", "")), r"(?s)^(?:.*\n[ \t]*\n)?(.*)$", 1)
    folded = F.regexp_replace(last, r"\n[ \t]+", " ")
    lines = F.split(folded, "\n")
    shape = r"^([A-Za-z0-9-]+)[ \t]*:[ \t]*(.*)$"
    good = F.forall(lines, lambda x: x.rlike(shape)) & message.contains("\n")
    parsed = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, shape, 1).alias("key"), F.regexp_extract(x, shape, 2).alias("value")))
    return F.when(good, parsed).otherwise(F.expr("CAST(array() AS array<struct<key:string,value:string>>)"))


def identity(text: Column) -> dict[str, Column]:
    """Name <email> seconds ±hhmm."""
    shape = r"^(.*?)\s*<([^<>]*)>(?:\s+(\d+)\s+([+-]\d{4}))?$"
    return {"name": F.regexp_extract(text, shape, 1), "email": F.regexp_extract(text, shape, 2), "when_secs": F.nullif(F.regexp_extract(text, shape, 3), F.lit("")).cast("bigint"), "offset_minutes": offset_minutes(F.regexp_extract(text, shape, 4))}


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, user, host, port, path of an URL, or of the short form [user@]host:path."""
    full = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^@/]*)@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d+))?([/?#].*)?$"
    short = r"^(?:([^@/:]+)@)?([^/:@]+):(?!//)(.*)$"
    is_full = url.rlike(full)
    null = lambda x: F.nullif(x, F.lit(""))
    return {
        "scheme": F.when(is_full, F.lower(F.regexp_extract(url, full, 1))).when(url.rlike(short), "ssh"),
        "user": null(F.when(is_full, F.regexp_extract(url, full, 2)).otherwise(F.regexp_extract(url, short, 1))),
        "host": null(F.when(is_full, F.regexp_extract(url, full, 3)).otherwise(F.regexp_extract(url, short, 2))),
        "port": F.when(is_full, null(F.regexp_extract(url, full, 4)).cast("int")),
        "path": null(F.when(is_full, F.regexp_extract(url, full, 5)).otherwise(F.regexp_extract(url, short, 3))),
    }


def valid_ref_name(name: Column) -> Column:
    """Component rules of ref names."""
    bad = r"(^|/)\.|\.\.|[\x00-\x20\x7f~^:?*\[\\]|/$|^/|//|\.lock(/|$)|@\{|\.$|^@$"
    return (name != "") & ~name.rlike(bad) & name.contains("/")


def safe_path(path: Column) -> Column:
    """No empty, dot or .git component in any case or short spelling, no device name, no backslash or colon."""
    bad = r"(?i)(^|/)(\.|\.\.|)(/|$)|(^|/)(\.git|git~1)[ .]*(:[^/]*)?(/|$)|(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])[ ]*([.:][^/]*)?(/|$)|[\\:\x00-\x1f]"
    return ~path.rlike(bad)


def large_pointer(text: Column) -> dict[str, Column]:
    """oid and size of a large-file pointer, null where the text isn't one (1024 bytes at most)."""
    shape = r"(?s)^version (?:https?://[^\n]+)\n(?:ext-[^\n]+\n)*oid sha256:([0-9a-f]{64})\nsize (\d+)\n?$"
    good = (F.octet_length(text) < 1024) & text.rlike(shape)
    return {"oid": F.when(good, F.regexp_extract(text, shape, 1)), "size": F.when(good, F.regexp_extract(text, shape, 2).cast("bigint"))}


def media_type(content: Column) -> Column:
    """By the first bytes."""
    out = F.lit("application/octet-stream")
    for magic, kind in ((b"\x1f\x8b\x08", "application/x-gzip"), (b"PK\x03\x04", "application/zip"), (b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF8", "image/gif"), (b"\xff\xd8\xff", "image/jpeg")):
        out = F.when(F.startswith(content, F.lit(magic)), kind).otherwise(out)
    start = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    html = start.rlike(r"^(<!doctype html|<html|<head|<script|<body|<title|<p|<div|<h1|<table|<!--)[ >]?")
    plain = ~F.decode(F.substring(content, 1, 512), "ISO-8859-1").rlike(r"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")
    return F.when(html, "text/html; charset=utf-8").when(out != "application/octet-stream", out).when(plain, "text/plain; charset=utf-8").otherwise(out)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def version_key(name: Column) -> Column:
    """Digit runs padded to 20 places, so that names sort by version."""
    padded = F.regexp_replace(name, r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def whitespace_errors(line: Column) -> Column:
    return F.concat_ws(
        ",",
        F.when(line.rlike(r"[ \t\r]+$"), "blank-at-eol"),
        F.when(line.rlike(r"^[ \t]* \t"), "space-before-tab"),
        F.when(line.rlike(r"^\t* {8,}"), "indent-with-non-tab"),
    )
