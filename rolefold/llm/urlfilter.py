"""URL filtering by a tree of path templates, in SQL only.

Every url is host and path; explicit rules judge what they fit, the longest
first.  What they judge labels the tree that judges the rest.  The tree of a host
grows segment by segment until every path has ended, however deep: digits in a
segment become ``<n>``; a segment with a small share among many siblings becomes
``*``; siblings, in the order of their shares of blocked pages, are one branch with
the one before them if a two-proportion test can't tell the two apart, and such
branches pool their labels.  A node's smoothed share falls back on its branch's,
that on the parent's.  A template is blocked if its share, smoothed by the mean of
its branch's share and that of the same template on all hosts, is above one half.

The pages are aggregated to distinct (host, masked path) before anything is joined
per host, so a host with a third of all pages is one group of partial sums; a node
keeps at most ``siblings`` + ``share`` + 1 branches, so no window is larger.

Defined cases: a null url, or one without ``://``, has empty host and path; null
ids and repeated rows are judged like any others; other columns are ignored; an
empty table has no rows; long urls cost a level per segment; with no labels at all
everything that no rule judges has a share of one half and is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: The rules: (host and path, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_cases(rules: tuple[tuple[str, str], ...]) -> str:
    """The longest fitting rule's text; of equally long ones the first by text."""
    out = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = f"(host = {_quoted(host)} OR right(host, {len(host) + 1}) = {_quoted('.' + host)})"
        out.append(f"WHEN {fits} AND left(path, {len(slash + path)}) = {_quoted(slash + path)} THEN {_quoted(rule)}")
    return "CASE " + " ".join(out) + " END" if out else "CAST(NULL AS STRING)"


def _verdict_cases(rules: tuple[tuple[str, str], ...]) -> str:
    return "CASE rule " + " ".join(f"WHEN {_quoted(r)} THEN {_quoted(v)}" for r, v in rules) + " END" if rules else "CAST(NULL AS STRING)"


def parsed_sql(rules: tuple[tuple[str, str], ...], every: str = "") -> dict[str, str]:
    """Rows of ``{source}`` (page_id, url) with host, path, rule, label and masked path; every: the dialect's flag for all matches."""
    return {
        "cut": """SELECT page_id, CASE WHEN instr(url, '://') > 0
            THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {source}""",
        "parts": f"""SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM {{cut}}""",
        "ruled": f"SELECT page_id, host, path, {_rule_cases(rules)} AS rule FROM {{parts}}",
        "base": f"""SELECT page_id, host, path, rule, {_verdict_cases(rules)} AS label,
            regexp_replace(path, '[0-9]+', '<n>'{every}) AS shape FROM {{ruled}}""",
    }


def level_sql(depth: int, siblings: int, share: int, strength: int, critical: float) -> dict[str, str]:
    """One level down from ``{tree}``: the last statement is the tree of the paths that go on."""
    return {
        "going": f"SELECT *, element_at(segs, {depth + 1}) AS seg FROM {{tree}} WHERE size(segs) > {depth}",
        "kids": """SELECT host, node, seg, sum(pages) AS pages, sum(labelled) AS labelled, sum(bad) AS bad, max(p) AS p
            FROM {going} GROUP BY host, node, seg""",
        "whole": "SELECT host, node, sum(pages) AS pages, count(*) AS kids FROM {kids} GROUP BY host, node",
        "named": f"""SELECT k.*, CASE WHEN w.kids > {siblings} AND k.pages * {share} < w.pages THEN '*' ELSE k.seg END AS t
            FROM {{kids}} k JOIN {{whole}} w ON k.host = w.host AND k.node = w.node""",
        "branches": """SELECT host, node, t, sum(labelled) AS n, sum(bad) AS x, max(p) AS above
            FROM {named} GROUP BY host, node, t""",
        "beside": """SELECT *, lag(n) OVER (PARTITION BY host, node ORDER BY x / n, t) AS n0, lag(x) OVER (PARTITION BY host, node ORDER BY x / n, t) AS x0
            FROM {branches} WHERE n > 0""",
        "parted": f"""SELECT *, sum(CASE WHEN power(CAST(x * n0 - x0 * n AS DOUBLE), 2) * (n + n0)
                > {critical}e0 * n * n0 * CAST((x + x0) * (n + n0 - x - x0) AS DOUBLE) THEN 1 ELSE 0 END)
            OVER (PARTITION BY host, node ORDER BY x / n, t ROWS UNBOUNDED PRECEDING) AS part FROM {{beside}}""",
        "merged": f"""SELECT host, node, t, n, x,
            (sum(x) OVER (PARTITION BY host, node, part) + {strength} * above) / (sum(n) OVER (PARTITION BY host, node, part) + {strength}e0) AS q
            FROM {{parted}}""",
        "judged": f"""SELECT b.host, b.node, b.t, coalesce(m.q, b.above) AS q,
            (b.x + {strength} * coalesce(m.q, b.above)) / (b.n + {strength}e0) AS p
            FROM {{branches}} b LEFT JOIN {{merged}} m ON b.host = m.host AND b.node = m.node AND b.t = m.t""",
        "names": """SELECT k.host, k.node, k.seg, k.t, j.q, j.p
            FROM {named} k JOIN {judged} j ON k.host = j.host AND k.node = j.node AND k.t = j.t""",
        "next": """SELECT g.host, g.shape, g.segs, concat(g.node, '/', x.t) AS node, x.q, x.p, g.pages, g.labelled, g.bad
            FROM {going} g JOIN {names} x ON g.host = x.host AND g.node = x.node AND g.seg = x.seg""",
    }


def _run(spark: SparkSession, statements: dict[str, str], frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    frames = dict(frames)
    for name, query in statements.items():
        frames[name] = spark.sql(query, **{n: f for n, f in frames.items() if f"{{{n}}}" in query})
    return frames


def filter_urls(
    df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url",
    siblings: int = 16, share: int = 100, strength: int = 4, critical: float = 3.84,
) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row.

    siblings, share: a segment is generalised if it has more siblings than that
    and fewer than 1/share of their pages; strength: pseudo-count of each prior;
    critical: chi-square above which neighbouring branches differ.
    """
    spark = df.sparkSession
    source = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"))
    base = _run(spark, parsed_sql(rules), {"source": source})["base"]
    leaves = spark.sql("""SELECT host, shape, count(*) AS pages, count(label) AS labelled,
        count(CASE WHEN label = 'block' THEN 1 END) AS bad FROM {base} GROUP BY host, shape""", base=base)  # fmt: skip
    leaves = saved(leaves, "paths")
    start = {
        "world": "SELECT (coalesce(sum(bad), 0) + 1.0e0) / (coalesce(sum(labelled), 0) + 2.0e0) AS p0 FROM {leaves}",
        "hosts": f"""SELECT host, max(p0) AS q, (sum(bad) + {strength} * max(p0)) / (sum(labelled) + {strength}e0) AS p
            FROM {{leaves}}, {{world}} GROUP BY host""",
        "tree": """SELECT l.host, l.shape, split(l.shape, '/', -1) AS segs, '' AS node, h.q, h.p, l.pages, l.labelled, l.bad
            FROM {leaves} l JOIN {hosts} h ON l.host = h.host""",
    }
    frames = _run(spark, start, {"leaves": leaves})
    tree, done, depth = saved(frames["tree"], "tree"), [], 1
    while True:
        done.append(tree.where(F.size("segs") == depth).drop("segs"))
        if tree.where(F.size("segs") > depth).isEmpty():
            break
        tree = saved(_run(spark, level_sql(depth, siblings, share, strength, critical), {"tree": tree})["next"], "tree")
        depth += 1
    ended = reduce(DataFrame.union, done)
    finish = {
        "shapes": f"""SELECT node, (sum(bad) + {strength} * max(p0)) / (sum(labelled) + {strength}e0) AS s
            FROM {{ended}}, {{world}} GROUP BY node""",
        "templates": "SELECT host, node, sum(bad) AS bad, sum(labelled) AS labelled, max(q) AS q FROM {ended} GROUP BY host, node",
        "verdicts": f"""SELECT t.host, t.node, CASE WHEN (t.bad + {strength} * (t.q + s.s) / 2) / (t.labelled + {strength}e0) > 0.5e0
            THEN 'block' ELSE 'allow' END AS verdict FROM {{templates}} t JOIN {{shapes}} s ON t.node = s.node""",
        "shaped": """SELECT e.host, e.shape, concat(e.host, e.node) AS template, v.verdict
            FROM {ended} e JOIN {verdicts} v ON e.host = v.host AND e.node = v.node""",
    }
    shaped = saved(_run(spark, finish, {"ended": ended, "world": frames["world"]})["shaped"], "verdicts")
    return spark.sql("""SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.label, v.verdict) AS verdict, v.template
        FROM {base} b JOIN {shaped} v ON b.host = v.host AND b.shape = v.shape""", base=base, shaped=shaped)  # fmt: skip
