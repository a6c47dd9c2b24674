"""References: listing, filtering, sorting, formatting, shadowing, mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import globs, text


def kind_of(name: Column) -> Column:
    return F.when(name.startswith("refs/heads/"), "branch").when(name.startswith("refs/tags/"), "tag").when(name.startswith("refs/remotes/"), "remote").otherwise("other")


def select_refs(refs: DataFrame, patterns: Sequence[str] = (), exclude: Sequence[str] = (), kinds: Sequence[str] = (), points_at: DataFrame | None = None, hide: Sequence[str] = (), start_after: str | None = None) -> DataFrame:
    """The refs that a pattern takes (all, if there are none) and no exclusion does."""
    name = F.col("name")
    test = globs.any_of([globs.ref_match(name, p) for p in patterns], True) & ~globs.any_of([globs.ref_match(name, p) for p in exclude], False)
    if kinds:
        test &= kind_of(name).isin(*kinds)
    if hide:
        test &= ~globs.hidden(name, hide)
    if start_after is not None:
        test &= name > start_after
    out = refs.where(test)
    return out if points_at is None else out.join(points_at.select("oid").distinct(), "oid", "left_semi")


def sort_refs(refs: DataFrame, keys: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Sorts by the last key first; `-` reverses a key; `version:name` compares digit runs as numbers. The final
    tie is the name, ascending."""
    order = []
    for key in reversed(keys):
        down, field = key.startswith("-"), key.lstrip("-")
        col = text.version_key(F.col(field.split(":", 1)[1])) if field.startswith(("version:", "v:")) else F.col(field)
        if ignore_case and dict(refs.dtypes).get(field) == "string":
            col = text.ascii_lower(col)
        order.append(col.desc() if down else col.asc())
    return refs.orderBy(*order, "name")


def short_name(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/(heads/|tags/|remotes/)?", "")


def format_refs(refs: DataFrame, template: str) -> DataFrame:
    """name and line: `%(refname)`, `%(refname:short)`, `%(refname:lstrip=N)`, `%(objectname)`, `%(objectname:short)`,
    `%(objecttype)`, `%%`, and `%(if)`cond`%(then)`a`%(else)`b`%(end)`."""
    import re

    atoms = {
        "refname": F.col("name"),
        "refname:short": short_name(F.col("name")),
        "objectname": F.col("oid"),
        "objectname:short": F.substring("oid", 1, 7),
        "objecttype": F.col("kind") if "kind" in refs.columns else kind_of(F.col("name")),
    }
    pieces = re.findall(r"%\([^)]*\)|%%|[^%]+|%", template)

    def atom(word: str) -> Column:
        if word in atoms:
            return atoms[word]
        if m := re.fullmatch(r"refname:lstrip=(-?\d+)", word):
            n = int(m[1])
            parts = F.split("name", "/")
            return F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))) if n >= 0 else F.slice(parts, F.greatest(F.size(parts) + n + 1, F.lit(1)), F.lit(-n)), "/")
        if word in refs.columns:
            return F.coalesce(F.col(word).cast("string"), F.lit(""))
        raise ValueError(f"unknown field {word}")

    def build(stop: set[str]) -> tuple[Column, str]:
        parts = []
        while pieces:
            p = pieces.pop(0)
            word = p[2:-1] if p.startswith("%(") else None
            if word in stop:
                return F.concat(*parts) if parts else F.lit(""), word
            if word == "if" or (word or "").startswith("if:"):
                cond, _ = build({"then"})
                yes, end = build({"else", "end"})
                no = build({"end"})[0] if end == "else" else F.lit("")
                equals = re.fullmatch(r"if:(not)?equals=(.*)", word)
                test = F.trim(cond) != "" if equals is None else (cond == equals[2]) if not equals[1] else (cond != equals[2])
                parts.append(F.when(test, yes).otherwise(no))
            elif word is not None:
                parts.append(atom(word))
            else:
                parts.append(F.lit("%" if p == "%%" else p))
        return F.concat(*parts) if parts else F.lit(""), ""

    return refs.select("name", build(set())[0].alias("line"))


def shadowed(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """Loose refs shadow packed ones of the same name."""
    rest = packed.join(loose.select("name"), "name", "left_anti")
    return loose.withColumn("loose", F.lit(True)).unionByName(rest.withColumn("loose", F.lit(False)))


def newest_of_tables(records: DataFrame) -> DataFrame:
    """Ref records of a log-structured stack (name, oid, update_index): the newest wins, null oids are deletions."""
    newest = records.groupBy("name").agg(F.max_by("oid", "update_index").alias("oid"), F.max("update_index").alias("update_index"))
    return newest.where(F.col("oid").isNotNull())


def resolve_symbolic(refs: DataFrame, depth: int = 5) -> DataFrame:
    """refs: (name, oid, symbolic). Follows symbolic refs; a chain that is longer or dangles has a null oid."""
    out = refs.select("name", "oid", "symbolic")
    for _ in range(depth):
        step = refs.select(F.col("name").alias("symbolic"), F.col("oid").alias("next_oid"), F.col("symbolic").alias("next"))
        out = out.join(step, "symbolic", "left").select("name", F.coalesce("oid", "next_oid").alias("oid"), F.when(F.coalesce("oid", "next_oid").isNull(), F.col("next")).alias("symbolic"))
    return out.select("name", "oid")


def apply_transaction(refs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits: (name, new_oid, expected_oid): compare-and-swap; a null new_oid deletes, a null expected_oid means the
    ref must not exist. Returns (refs after, rejected edits with a reason); if any edit is rejected, none is made."""
    judged = edits.join(refs.select("name", F.col("oid").alias("now")), "name", "left")
    twice = edits.groupBy("name").agg(F.count("*").alias("n"))
    judged = judged.join(twice, "name").withColumn(
        "reason", F.when(F.col("n") > 1, "duplicate").when(~F.col("now").eqNullSafe(F.col("expected_oid")), "expected another value").when(~text.valid_ref_name(F.col("name")), "bad name")
    )
    rejected = judged.where("reason IS NOT NULL").select("name", "reason")
    any_bad = rejected.agg((F.count("*") > 0).alias("bad"))
    good = judged.join(F.broadcast(any_bad)).where("NOT bad").select("name", "new_oid", F.lit(True).alias("edited"))
    after = refs.select("name", "oid").join(good, "name", "full_outer").select("name", F.when(F.col("edited"), F.col("new_oid")).otherwise(F.col("oid")).alias("oid")).where("oid IS NOT NULL")
    return after, rejected


def fetch_map(remote: DataFrame, local: DataFrame, spec: str) -> DataFrame:
    """What a fetch would do to each local ref that the refspec maps: new, update, same or prune."""
    theirs = remote.select("name", "oid").withColumn("local_name", globs.refspec_target(F.col("name"), spec)).where("local_name IS NOT NULL").select("local_name", F.col("oid").alias("remote_oid"))
    prefix = spec.split(":", 1)[1].split("*", 1)[0]
    ours = local.where(F.col("name").startswith(prefix)).select(F.col("name").alias("local_name"), F.col("oid").alias("local_oid"))
    both = theirs.join(ours, "local_name", "full_outer")
    return both.withColumn("action", F.when(F.col("remote_oid").isNull(), "prune").when(F.col("local_oid").isNull(), "new").when(F.col("remote_oid") == F.col("local_oid"), "same").otherwise("update"))


def abbreviations(oids: DataFrame, least: int = 4) -> DataFrame:
    """oid, abbrev: the shortest prefix of at least `least` digits that no other oid has: one more digit than the
    longest prefix shared with a neighbour in sorted order. Sorted by range in buckets of the first digits; the
    neighbours across bucket borders share fewer digits than `least`."""
    one = oids.select("oid").distinct()
    near = Window.partitionBy(F.substring("oid", 1, least)).orderBy("oid")

    def common(a: Column, b: Column) -> Column:
        return F.coalesce(F.length(F.regexp_extract(F.concat(a, F.lit("|"), b), r"^([0-9a-f]*)[0-9a-f]*\|\1", 1)), F.lit(0))

    shared = F.greatest(common(F.col("oid"), F.lag("oid").over(near)), common(F.col("oid"), F.lead("oid").over(near)))
    return one.select("oid", shared.alias("shared")).select("oid", F.expr(f"substring(oid, 1, greatest({least}, shared + 1))").alias("abbrev"))


def decorations(refs: DataFrame) -> DataFrame:
    """oid and the names that point at it, in byte order."""
    return refs.groupBy("oid").agg(F.sort_array(F.collect_list("name")).alias("names"))


def verify_refs(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Problems of a ref table: bad names, malformed oids, targets that don't exist."""
    known = objects.select("oid", F.lit(True).alias("known")).distinct()
    return (
        refs.join(known, "oid", "left")
        .withColumn("problem", F.when(~text.valid_ref_name(F.col("name")), "bad name").when(~F.col("oid").rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), "bad oid").when(F.col("known").isNull(), "missing object"))
        .where("problem IS NOT NULL")
        .select("name", "oid", "problem")
    )
