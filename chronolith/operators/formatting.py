"""Commit and log templates compiled to Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def iso_date(secs: Column, minutes: Column) -> Column:
    local = F.timestamp_seconds(secs + minutes * 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss "), text.offset_text(minutes))


def format_commits(commits: DataFrame, template: str, abbrev: int = 7, now: Column | None = None) -> DataFrame:
    """oid and entry. commits: oid, tree, parents array, author and committer structs (name, email, when_secs,
    offset_minutes), message. Placeholders: %H %h %T %t %P %p, %a? and %c? with ? of n e l t i I s r, %s %f %b %B %n %% %x00."""
    short = lambda x: F.substring(x, 1, abbrev)

    def person(who: str, letter: str) -> Column:
        p = F.col(who)
        secs, minutes = p["when_secs"], p["offset_minutes"]
        return {
            "n": lambda: p["name"],
            "e": lambda: p["email"],
            "l": lambda: F.substring_index(p["email"], "@", 1),
            "t": lambda: secs.cast("string"),
            "i": lambda: iso_date(secs, minutes),
            "I": lambda: F.concat(F.date_format(F.timestamp_seconds(secs + minutes * 60), "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes == 0, "Z").otherwise(F.regexp_replace(text.offset_text(minutes), r"(\d\d)$", ":$1"))),
            "s": lambda: F.date_format(F.timestamp_seconds(secs + minutes * 60), "yyyy-MM-dd"),
            "r": lambda: text.relative_date((F.unix_timestamp() if now is None else now) - secs),
        }[letter]()

    plain = {
        "H": lambda: F.col("oid"),
        "h": lambda: short(F.col("oid")),
        "T": lambda: F.col("tree"),
        "t": lambda: short(F.col("tree")),
        "P": lambda: F.array_join("parents", " "),
        "p": lambda: F.array_join(F.transform("parents", short), " "),
        "s": lambda: text.subject(F.col("message")),
        "f": lambda: text.sanitized_subject(text.subject(F.col("message"))),
        "b": lambda: text.body(F.col("message")),
        "B": lambda: F.col("message"),
        "n": lambda: F.lit("\n"),
        "%": lambda: F.lit("%"),
    }
    out = []
    for piece in re.findall(r"%x[0-9a-fA-F]{2}|%[ac].|%.|[^%]+|%", template):
        if re.fullmatch(r"%x..", piece):
            out.append(F.lit(chr(int(piece[2:], 16))))
        elif re.fullmatch(r"%[ac][neltiIsr]", piece):
            out.append(person("author" if piece[1] == "a" else "committer", piece[2]))
        elif len(piece) == 2 and piece[0] == "%" and piece[1] in plain:
            out.append(plain[piece[1]]())
        else:
            out.append(F.lit(piece))
    return commits.select("oid", F.concat(*[F.coalesce(c, F.lit("")) for c in out]).alias("entry"))


LAYOUTS = {
    "oneline": "%H %s",
    "short": "commit %H%nAuthor: %an <%ae>%n%n    %s%n",
    "full": "commit %H%nAuthor: %an <%ae>%nCommit: %cn <%ce>%n%n    %s%n",
    "reference": "%h (%s, %as)",
}
