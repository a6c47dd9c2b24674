"""Pattern languages compiled to regular expressions and Columns: globs, pathspecs, refspecs, last-match rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("alnum", "alpha", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper", "xdigit")


def glob_regex(pattern: str, pathname: bool = True) -> str:
    """A regular expression for the whole of a path. Under `pathname` a `*` or `?` stops at a slash and `**`
    between slashes spans any number of folders."""
    out, i, n = [], 0, len(pattern)
    one = "[^/]" if pathname else "."
    while i < n:
        c = pattern[i]
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            alone = (i == 0 or pattern[i - 1] == "/") and (j == n or pattern[j] == "/")
            if not pathname or (j - i == 2 and alone and j == n):
                out.append(".*")
            elif j - i == 2 and alone:
                out.append("(?:.*/)?")
                j += 1
            else:
                out.append("[^/]*")
            i = j
            continue
        if c == "?":
            out.append(one)
        elif c == "[":
            j = i + 1
            negated = j < n and pattern[j] in "!^"
            j += negated
            body, first = [], True
            while j < n and (pattern[j] != "]" or first):
                first = False
                if pattern.startswith("[:", j) and pattern[j + 2 :].split(":]")[0] in CLASSES:
                    name = pattern[j + 2 :].split(":]")[0]
                    body.append(r"\p{" + {"xdigit": "XDigit"}.get(name, name.capitalize()) + "}")
                    j += len(name) + 4
                    continue
                if pattern[j] == "\\" and j + 1 < n:
                    j += 1
                body.append(pattern[j] if pattern[j] == "-" else re.escape(pattern[j]))
                j += 1
            if j >= n:
                return r"[^\s\S]"  # an open bracket matches nothing
            out.append(("(?!/)" if pathname else "") + "[" + "^" * negated + "".join(body) + "]")
            i = j
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def is_glob(pattern: str) -> bool:
    return bool(re.search(r"[*?\[\\]", pattern))


def glob_match(column: Column, pattern: str, pathname: bool = True, icase: bool = False) -> Column:
    return column.rlike(("(?s)" if not icase else "(?is)") + glob_regex(pattern, pathname))


def ref_match(name: Column, pattern: str) -> Column:
    """A ref pattern is a glob, or a name that is the ref or a folder above it."""
    if is_glob(pattern):
        return glob_match(name, pattern)
    folder = pattern.rstrip("/")
    return (name == folder) | name.startswith(folder + "/")


def any_of(tests: Sequence[Column], none: bool) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return F.lit(none) if out is None else out


def pathspec(path: Column, items: Sequence[str]) -> Column:
    """Positive items are OR-ed, then excluded ones removed. Magic: `:(exclude,icase,literal,glob,top)`, `:!`, `:/`."""
    yes, no = [], []
    for item in items:
        magic: set[str] = set()
        text = item
        if item.startswith(":("):
            words, _, text = item[2:].partition(")")
            magic = set(filter(None, words.split(",")))
        elif item.startswith(":"):
            short = re.match(r":([!^/]*)", item)[1]
            text = item[1 + len(short) :]
            magic |= {"exclude" for c in short if c in "!^"} | {"top" for c in short if c == "/"}
        icase = "icase" in magic
        subject, low = (F.lower(path), text.lower()) if icase else (path, text)
        if "literal" in magic or not is_glob(low):
            folder = low.rstrip("/")
            test = F.lit(True) if not folder else (subject == folder) | subject.startswith(folder + "/")
        else:
            # Without the glob magic a star also matches slashes, and what matches a folder matches all below it.
            expression = glob_regex(low, pathname="glob" in magic)
            test = subject.rlike("(?s)" + expression[:-1] + "(?:/.*)?$")
        (no if "exclude" in magic else yes).append(test)
    return any_of(yes, True) & ~any_of(no, False)


def last_rule(path: Column, rules: Sequence[str]) -> Column:
    """Ignore rules: the last one that matches decides, `!` takes back. A rule with a slash other than at its end
    is anchored; what lies under an ignored folder is ignored."""
    out = F.lit(False)
    for rule in rules:
        text = rule.rstrip()
        if not text or text.startswith("#"):
            continue
        ignored = not text.startswith("!")
        text = text[not ignored :]
        folder = text.endswith("/")
        body = text.strip("/")
        anchored = "/" in text.rstrip("/")
        expression = glob_regex(body)[1:-1]
        full = "^" + ("" if anchored else "(?:.*/)?") + expression + ("/.*$" if folder else "(?:/.*)?$")
        out = F.when(path.rlike(full), F.lit(ignored)).otherwise(out)
    return out


def hidden(name: Column, rules: Sequence[str]) -> Column:
    """Hidden refs: a rule is a prefix that ends at a slash or the name's end; `!` shows; the last match decides."""
    out = F.lit(False)
    for rule in rules:
        hides = not rule.startswith("!")
        prefix = rule.lstrip("!^").rstrip("/")
        out = F.when((name == prefix) | name.startswith(prefix + "/"), F.lit(hides)).otherwise(out)
    return out


def refspec_target(name: Column, spec: str) -> Column:
    """The local name that a refspec `[+]source:target` maps a remote name to, null where it doesn't apply."""
    source, _, target = spec.lstrip("+").partition(":")
    if "*" not in source:
        return F.when(name == source, F.lit(target))
    before, after = source.split("*", 1)
    left, right = target.split("*", 1)
    star = F.substring(name, F.lit(len(before) + 1), F.length(name) - len(before) - len(after))
    fits = name.startswith(before) & name.endswith(after) & (F.length(name) >= len(before) + len(after))
    return F.when(fits, F.concat(F.lit(left), star, F.lit(right)))
