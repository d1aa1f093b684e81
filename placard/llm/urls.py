"""URL verdicts: rules first, else trust and distrust propagated over the graph of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path: after the first ``://``.
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Links that name a host of their own; relative ones stay on the page's host.
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
ROUNDS = 8
#: Mass of one page, in integer units, and the percentage of it that moves on in each round.
UNIT, DAMPING = 1_000_000, 85
#: A host is blocked whose distrust passes its trust and is at least this percentage of the most its pages could have.
THRESHOLD = 50


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one; of equally long ones a blocking one."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict == "allow", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """Host, path, longest rule and verdict of every row of ``pages(page_id, url, html)``.

    Hosts are nodes; links between different hosts are weighted edges. Pages that an allow rule fits give their
    host trust seeds, pages that a block rule fits give it distrust seeds, one unit each. Trust walks forward along
    links, distrust backward (who links to a bad host is suspect): personalised PageRank on integers,
    ``rounds`` rounds, so results do not depend on the order of sums. What reaches a host that has no link to pass it on goes
    back to the seeds, in proportion. A url without a rule takes its host's verdict:
    block if distrust exceeds trust and is at least ``threshold`` percent of what the host's pages could carry (if all were
    seeds; without links to pass it on they keep it all), else allow. All of it is DataFrame operations; edges, seeds and scores are sums for each host or pair of hosts.

    Rows: a null url, or one without ``://``, has an empty host and path and no rule, and is allowed; null html has
    no links; repeated rows and null ids pass through; an empty table gives no rows; other columns are ignored.

    Returns page_id, host, path, rule, verdict.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "ruled": verdict})
    seeds = seen.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        (F.count(F.when(F.col("ruled") == "allow", 1)) * UNIT).alias("trusted"),
        (F.count(F.when(F.col("ruled") == "block", 1)) * UNIT).alias("blocked"),
    )
    bad = _blocked_hosts(seeds, _edges(pages), rounds, threshold)
    return seen.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
    )


def _edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, links."""
    links = pages.filter("html IS NOT NULL").select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(full).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def _blocked_hosts(seeds: DataFrame, edges: DataFrame, rounds: int, threshold: int) -> DataFrame:
    """Hosts to block, as host and bad = true."""
    edges, seeds = written(edges, "host-edges"), written(seeds, "host-seeds")
    start = seeds.selectExpr("host", "stack(2, 'trust', trusted, 'distrust', blocked) AS (kind, seed)").filter("seed > 0")
    score, linked = start.withColumnRenamed("seed", "mass"), None
    if edges.take(1):
        moves = edges.selectExpr("stack(2, 'trust', src, dst, 'distrust', dst, src) AS (kind, giver, taker)", "links")
        out = moves.groupBy("kind", "giver").agg(F.sum("links").alias("all_links"))
        moves = written(moves.join(out, ["kind", "giver"]), "host-moves")
        givers = moves.select("kind", F.col("giver").alias("host")).distinct()
        linked = givers.filter("kind = 'distrust'").select("host", F.lit(True).alias("linked"))
        total = F.broadcast(written(start.groupBy("kind").agg(F.sum("seed").alias("total")), "host-totals"))  # two rows
        for r in range(rounds):
            gained = moves.join(score.withColumnRenamed("host", "giver"), ["kind", "giver"]).select(
                "kind", F.col("taker").alias("host"), F.expr(f"CAST(mass * {DAMPING} DIV 100 AS DECIMAL(20,0)) * CAST(links AS DECIMAL(18,0)) DIV CAST(all_links AS DECIMAL(18,0))").alias("mass")
            )
            kept = start.select("kind", "host", F.expr(f"seed * {100 - DAMPING} DIV 100").alias("mass"))
            loose = score.join(givers, ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("mass").alias("loose"))  # two rows
            back = start.join(F.broadcast(loose), "kind").join(total, "kind").select(
                "kind", "host", F.expr(f"CAST(loose * {DAMPING} DIV 100 AS DECIMAL(20,0)) * CAST(seed AS DECIMAL(18,0)) DIV CAST(total AS DECIMAL(18,0))").alias("mass")
            )
            score = gained.unionByName(kept).unionByName(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
            if r % 4 == 3 and r + 1 < rounds:
                score = written(score, "host-scores")
    both = score.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0)).alias("distrust"),
    )
    both = both.join(seeds.select("host", "pages"), "host")
    both = both.join(linked, "host", "left") if linked is not None else both.withColumn("linked", F.lit(False))  # without links nothing moves
    most = F.expr(f"pages * {UNIT} * IF(linked, {100 - DAMPING}, 100) DIV 100")
    return (
        both
        .filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") * 100 >= most * threshold))
        .select("host", F.lit(True).alias("bad"))
    )


def sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> str:
    """The same in DuckDB SQL."""
    when = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
        for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict == "allow", r.text))
    ]
    case = lambda what: "CASE " + " ".join(f"WHEN {c} THEN '{getattr(r, what)}'" for c, r in when) + " END"
    address = lambda url, group: f"coalesce(regexp_extract({url}, '{ADDRESS}', {group}), '')"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    steps = []
    for r in range(rounds):
        before = f"score{r}"
        steps.append(f"""score{r + 1} AS MATERIALIZED (
  SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
    SELECT m.kind, m.taker AS host, CAST((CAST(s.mass * {DAMPING} // 100 AS HUGEINT) * m.links) // m.all_links AS BIGINT) AS mass
    FROM moves m JOIN {before} s ON m.kind = s.kind AND m.giver = s.host
    UNION ALL SELECT kind, host, seed * {100 - DAMPING} // 100 FROM start
    UNION ALL SELECT t.kind, t.host, CAST((CAST(l.loose * {DAMPING} // 100 AS HUGEINT) * t.seed) // a.total AS BIGINT)
    FROM start t JOIN all_seeds a ON a.kind = t.kind JOIN (
      SELECT kind, CAST(sum(mass) AS BIGINT) AS loose FROM {before} s
      WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE m.kind = s.kind AND m.giver = s.host) GROUP BY kind) l ON l.kind = t.kind
  ) GROUP BY kind, host)""")
    final = f"score{rounds}"
    chain = "".join(s + ",\n" for s in steps)
    return f"""
WITH seen0 AS (
  SELECT page_id, {lower(address("url", 1))} AS host, {address("url", 2)} AS path FROM pages
), seen AS (
  SELECT *, {case("text")} AS rule, {case("verdict")} AS ruled FROM seen0
), seeds AS (
  SELECT host, count(*) AS pages, count(CASE WHEN ruled = 'allow' THEN 1 END) * {UNIT} AS trusted,
         count(CASE WHEN ruled = 'block' THEN 1 END) * {UNIT} AS blocked
  FROM seen WHERE host <> '' GROUP BY host
), links AS (
  SELECT {lower(address("url", 1))} AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS link
  FROM pages WHERE html IS NOT NULL
), ends AS (
  SELECT src, {lower(address("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END", 1))} AS dst FROM links
), edges AS (
  SELECT src, dst, count(*) AS links FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), moves0 AS (
  SELECT 'trust' AS kind, src AS giver, dst AS taker, links FROM edges
  UNION ALL SELECT 'distrust', dst, src, links FROM edges
), moves AS MATERIALIZED (
  SELECT *, CAST(sum(links) OVER (PARTITION BY kind, giver) AS BIGINT) AS all_links FROM moves0
), start AS MATERIALIZED (
  SELECT * FROM (SELECT host, 'trust' AS kind, trusted AS seed FROM seeds
                 UNION ALL SELECT host, 'distrust', blocked FROM seeds) WHERE seed > 0
), all_seeds AS (SELECT kind, CAST(sum(seed) AS BIGINT) AS total FROM start GROUP BY kind),
score0 AS (SELECT kind, host, seed AS mass FROM start),
{chain}totals AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS trust,
         sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS distrust FROM {final} GROUP BY host
), bad AS (
  SELECT host FROM totals JOIN seeds USING (host)
  WHERE distrust > trust AND distrust * 100 >= pages * {UNIT} * CASE WHEN host IN (SELECT giver FROM moves WHERE kind = 'distrust') THEN {100 - DAMPING} ELSE 100 END // 100 * {threshold}
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM seen
"""
