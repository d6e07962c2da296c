"""URL filter by a path-template tree.

Each host has a tree of path segments.  Digits of a segment stand for any number.  Level by level from the host down, a segment that holds less than one
``KEEP``-th of its parent's urls, or fewer than ``LEAST`` urls, becomes the wildcard ``*``; so a node has at most KEEP named children
and one wildcard.  Siblings that look alike are one branch: neither what follows them nor their share of bad labels differs
significantly (chi-square on PROFILE groups of remaining paths, two shares).  The next level is built below the merged branches.  Segments
below ``DEPTH`` levels are one ``**``.

A template's purity is its share of bad labels, smoothed towards its parent's by ``PRIOR`` labels, and so on up to the share of all.  A template of purity
``REJECT`` or more is rejected.  Rules of a host and path go before the templates.

Urls are counted by (host, generalised path) before anything else is shuffled; the tree works on these counts.  A node's children
meet in one row of at most KEEP + 1 entries.  Joins carry the number of rows behind each key, so a heavy host, path or
segment is broadcast (at most keyed.SHARE of them) and never fills a task.

Cases: a null url, or one without ``://``, has an empty host and path; an empty path is the host itself; empty segments (also by
repeated or closing slashes) don't count; null labels and labels of other pages are not used; each row gives a row, also repeated ones;
long paths are whole in ``path`` and end in ``**`` in a template; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .keyed import join_unique

DEPTH = 4
KEEP = 32
LEAST = 8
PROFILE = 8
PRIOR = 4.0
REJECT = 0.5
#: Chi-square at 1 % by degrees of freedom from 1, and the same bound for the difference of two shares.
CRITICAL = [6.635, 9.210, 11.345, 13.277, 15.086, 16.812, 18.475, 20.090]

#: Rules by host and beginning of the path; the longest fitting one decides.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    plain = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    host = F.translate(F.regexp_extract(plain, r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(plain, r"(?s)^[^/]*(.*)$", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (longest host and path together), null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, outcome in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, outcome).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The parts of a path with numbers generalised; those below DEPTH are one ``**``."""
    parts = F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)


def _alike(a: list[float], b: list[float]) -> bool:
    """Whether two branches differ significantly in nothing: counts of PROFILE groups, then labelled and bad."""
    for x, y in ((a[:PROFILE], b[:PROFILE]), ([a[-1], a[-2] - a[-1]], [b[-1], b[-2] - b[-1]])):
        n, m = sum(x), sum(y)
        if not n or not m:
            continue
        total, used = 0.0, 0
        for p, q in zip(x, y, strict=True):
            if p + q:
                used += 1
                share = (p + q) / (n + m)
                total += (p - n * share) ** 2 / (n * share) + (q - m * share) ** 2 / (m * share)
        if used > 1 and total > CRITICAL[used - 2]:
            return False
    return True


def branches(children: list[tuple[str, list[float]]]) -> list[tuple[str, str]]:
    """(child, name of its branch): a child joins the first larger branch that it looks like, the wildcard stays alone."""
    made: list[tuple[list[str], list[float]]] = []
    for name, counts in sorted(children, key=lambda c: (-sum(c[1][:PROFILE]), c[0])):
        into = next((m for m in made if _alike(m[1], counts)), None) if name != "*" else None
        if into:
            into[0].append(name)
            into[1][:] = [x + y for x, y in zip(into[1], counts, strict=True)]
        elif name != "*":
            made.append(([name], list(counts)))
    out = [(name, "|".join(sorted(names))) for names, _ in made for name in names]
    return out + [(name, name) for name, _ in children if name == "*"]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(node, name, branch) for node, children in zip(batch.column("node").to_pylist(), batch.column("children").to_pylist(), strict=True)
               for name, branch in branches([(c["name"], c["counts"]) for c in children])]
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.string()), strict=True)], ["node", "name", "branch"])


def _key(*parts: Column | str) -> Column:
    """Sixteen bytes that stand for a node, or for a name below a node."""
    return F.unhex(F.md5(F.concat(*[F.coalesce(p, F.lit("")).cast("binary") if isinstance(p, Column) else F.col(p).cast("binary") for p in parts])))


def _smoothed(bad: Column, labelled: Column, towards: Column) -> Column:
    return (bad + PRIOR * towards) / (labelled + PRIOR)


SUMS = ["n", "labelled", "bad"]


def template_tree(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths: key, node, purity, n; nodes: node, parent, branch, level, n, labelled, bad, purity) of counted paths (key, host, segs, n, labelled, bad)."""
    total = paths.agg(F.sum("labelled"), F.sum("bad"), F.max(F.size("segs"))).first()
    overall = (total[1] or 0) / total[0] if total[0] else 0.0
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in SUMS], F.count(F.lit(1)).alias("rows"))
    hosts = stage(hosts.select(_key(F.col("host")).alias("node"), F.lit(None).cast("binary").alias("parent"), F.col("host").alias("branch"), F.lit(0).alias("level"), *SUMS,
                               _smoothed(F.col("bad"), F.col("labelled"), F.lit(overall)).alias("purity"), "rows"), "hosts")
    nodes, done = [hosts.drop("rows")], []
    known = hosts.select("node", F.col("n").alias("node_n"), "purity", "rows")
    open_paths = stage(join_unique(paths.withColumn("node", _key(F.col("host"))).drop("host"), known, ["node"], "rows"), "level_0")
    for level in range(1, (total[2] or 0) + 1):
        done.append(open_paths.where(F.size("segs") < level).select("key", "node", "purity", "n"))
        here = open_paths.where(F.size("segs") >= level).withColumn("seg", F.col("segs")[level - 1]).withColumn("child", _key("node", F.col("seg")))
        group = F.pmod(F.xxhash64(F.array_join(F.slice("segs", level + 1, DEPTH + 1), "/")), F.lit(PROFILE))
        profile = [F.sum(F.when(group == i, F.col("n")).otherwise(0)).alias(f"g{i}") for i in range(PROFILE)]
        children = stage(here.groupBy("node", "child", "seg").agg(
            F.first("node_n").alias("node_n"), F.first("purity").alias("above"), F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in SUMS], *profile), f"children_{level}")
        named = (F.col("n") >= LEAST) & (F.col("n") * KEEP >= F.col("node_n"))
        children = children.withColumn("name", F.when(named, F.col("seg")).otherwise(F.lit("*")))
        counts = [*[f"g{i}" for i in range(PROFILE)], "labelled", "bad"]
        entries = stage(children.groupBy("node", "name").agg(F.first("above").alias("above"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"),
                                                             *[F.sum(c).alias(c) for c in counts]), f"entries_{level}")
        listed = entries.groupBy("node").agg(F.collect_list(F.struct("name", F.array(*[F.col(c).cast("double") for c in counts]).alias("counts"))).alias("children"))
        entries = entries.join(listed.mapInArrow(_merged, "node binary, name string, branch string"), ["node", "name"])
        below = entries.groupBy("node", "branch").agg(F.first("above").alias("above"), *[F.sum(c).alias(c) for c in SUMS])
        below = stage(below.select(_key("node", F.col("branch")).alias("node"), F.col("node").alias("parent"), "branch", F.lit(level).alias("level"), *SUMS,
                                   _smoothed(F.col("bad"), F.col("labelled"), F.col("above")).alias("purity")), f"nodes_{level}")
        nodes.append(below)
        new = below.select(F.col("parent").alias("node"), "branch", F.col("node").alias("next"), F.col("n").alias("node_n"), "purity")
        to = entries.select("node", "name", "branch", "rows").join(new, ["node", "branch"]).select(
            _key("node", F.col("name")).alias("entry"), "next", "node_n", "purity", F.col("rows").alias("entry_rows"))
        mapped = join_unique(children.select("child", "rows", _key("node", F.col("name")).alias("entry")), to, ["entry"], "entry_rows").drop("entry")
        here = here.drop("node", "node_n", "purity", "seg")
        open_paths = stage(join_unique(here, stage(mapped, f"mapped_{level}"), ["child"], "rows").withColumnRenamed("next", "node").drop("child"), f"level_{level}")
    done.append(open_paths.select("key", "node", "purity", "n"))
    out, tree = done[0], nodes[0]
    for more in done[1:]:
        out = out.unionByName(more)
    for more in nodes[1:]:
        tree = tree.unionByName(more)
    return out, tree


def _counted(pages: DataFrame, labels: DataFrame, id_col: str, url_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, host, path and key; paths: counts of each generalised path of a host)."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segs", segments(F.col("path"))).withColumn("key", _key(F.col("host"), F.lit("/"), F.array_join("segs", "/")))
    marks = labels.where(F.col(id_col).isNotNull() & F.col("bad").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    marked = rows.select("id", "host", "segs", "key").join(marks, "id", "left")
    return rows, stage(marked.groupBy("key", "host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"),
                                                                 F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "paths")


def url_verdicts(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict, purity (of the template). ``labels`` has the id and ``bad`` (0, 1) of some pages."""
    rows, paths = _counted(pages, labels, id_col, url_col)
    found, _ = template_tree(paths)
    purity = found.select("key", "purity", F.col("n").alias("rows"))
    judged = join_unique(rows.select("id", "host", "path", "key"), purity, ["key"], "rows")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "purity")


def url_templates(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The tree: level, template (host and branches), n, labelled, bad, purity, rejected."""
    _, tree = template_tree(_counted(pages, labels, id_col, url_col)[1])
    tree = stage(tree, "tree")
    named = tree.where("level = 0").select("node", F.col("branch").alias("template"))
    out = named
    for level in range(1, DEPTH + 2):
        step = tree.where(F.col("level") == level).select("node", "parent", "branch")
        named = step.join(named.withColumnRenamed("node", "parent"), "parent").select("node", F.concat_ws("/", "template", "branch").alias("template"))
        out = out.unionByName(named)
    return tree.join(out, "node").select("level", "template", *SUMS, "purity", (F.col("purity") >= REJECT).alias("rejected"))
