"""Secret scans with multipart credential linking.

DataFrame functions only. Base spans (kinds assign, access, hex) are found in every whole text by fixed patterns. The
method adds weak parts, none of which means much alone: account names (``account``), long tokens of letters and digits
(``token``) and hosts (``endpoint``). Parts of a row are joined by interval: an identifier and a secret are linked when
the gap between them is at most ``scope`` code points, and an endpoint when it is that near to both. Weak parts are
reported only in such company; base spans count as parts and are always reported.

The interval join is an equi-join on (row, cell of ``scope`` code points) with neighbouring cells; how many parts one
cell holds is bounded by its length, so no row makes pairs that grow with its square. Weak parts that overlap a base
span are found by a running maximum of the base spans' ends along the row, without pairs.

Offsets are code points, the end exclusive. Defined cases: null text counts as empty; rows are independent, so ties
and repeated rows each get their result; an empty table gives an empty result; extra columns are ignored; texts of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table, text_or_empty


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_ACCOUNTS = "|".join(map(_either_case, ("username", "user", "login", "account", "client_id", "access_key_id", "access_key")))
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""

#: Kind: (pattern, group that holds the value, its least length). A run that is shorter fails as a whole.
BASE = {
    "assign": (f"({_NAMES}){_VALUE}([A-Za-z0-9+/_.=-]+)", 2, 8),
    # runs of these two are maximal, so the least length can stand in the pattern
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
WEAK = {
    "account": (f"({_ACCOUNTS}){_VALUE}([A-Za-z0-9@._-]+)", 2, 3),
    "token": ("[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    "endpoint": (r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._:/?&=%~#@-]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}", 0, 8),
}
KINDS = [*BASE, *WEAK]
ROLES = {"assign": "secret", "hex": "secret", "token": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
SCOPE = 300


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, k>> of the matches of ``pattern`` in column ``text``, from the lengths of matches and gaps."""
    found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    # running sums by doubling: in log(n) rounds even where a text has very many matches
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: (F.length(m) + F.length(g)).cast("bigint"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found).cast("double"))).cast("int"))
    ends = F.aggregate(rounds, steps, lambda a, k: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))))
    pairs = F.arrays_zip(found.alias("m"), ends.alias("e"))
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m
    keep = lambda p: F.length(value(p["m"])) >= least
    if kind == "token":
        keep = lambda p: p["m"].rlike("[0-9]") & p["m"].rlike("[A-Za-z]")
    spans = F.transform(F.filter(pairs, keep), lambda p: F.struct((p["e"] - F.length(p["m"])).alias("start"), p["e"].alias("end"), F.lit(KINDS.index(kind)).alias("k")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,k:int>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["k"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Pairs of parts of a row whose gap is at most ``scope``: left's columns l_*, right's r_*."""
    # parts may be longer than a cell: each stands in every cell that it touches, the left one in those around it too
    cells = lambda reach: F.explode(F.sequence(F.floor((F.col("start") - reach) / scope), F.floor((F.col("end") + reach) / scope)))
    a = left.select("row", cells(scope).alias("cell"), *(F.col(c).alias(f"l_{c}") for c in ("start", "end", "k")))
    b = right.select("row", cells(0).alias("cell"), *(F.col(c).alias(f"r_{c}") for c in ("start", "end", "k")))
    gap = F.greatest(F.col("l_start") - F.col("r_end"), F.col("r_start") - F.col("l_end"))
    return a.join(b, ["row", "cell"]).filter(gap <= scope)


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, parts (array of start, end, k; k indexes KINDS)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", *(_spans(k, *v).alias(k) for k, v in (BASE | WEAK).items()))
    rows = stored(rows, "secret-rows")
    every = rows.select("row", F.explode(F.concat(*KINDS)).alias("s")).select("row", "s.*")
    # weak parts that overlap a base span say nothing new: of the base spans that start before a part's end, one ends after its start
    strong = F.col("k") < len(BASE)
    before = Window.partitionBy("row").orderBy(F.when(strong, F.col("start")).otherwise(F.col("end") - 1)).rangeBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("covered", F.max(F.when(strong, F.col("end"))).over(before))
    every = every.filter(strong | F.col("covered").isNull() | (F.col("covered") <= F.col("start"))).drop("covered")
    role = lambda name: every.filter(F.col("k").isin([KINDS.index(k) for k, r in ROLES.items() if r == name]))
    linked = _near(role("identifier"), role("secret"), scope)
    pair = linked.select("row", F.least("l_start", "r_start").alias("start"), F.greatest("l_end", "r_end").alias("end"), F.lit(-1).alias("k")).distinct()
    ends = _near(role("endpoint"), pair, scope).select("row", F.col("l_start").alias("start"), F.col("l_end").alias("end"), F.col("l_k").alias("k"))
    weak = linked.select("row", F.explode(F.array(*(F.struct(*(F.col(f"{x}_{c}").alias(c) for c in ("start", "end", "k"))) for x in "lr"))).alias("s")).select("row", "s.*")
    weak = weak.unionByName(ends).filter(F.col("k") >= len(BASE)).distinct()
    weak = weak.groupBy("row").agg(F.collect_list(F.struct("start", "end", "k")).alias("weak"))
    out = rows.join(weak, "row", "left").withColumn("base", F.concat(*BASE)).withColumn("parts", F.concat("base", F.coalesce("weak", F.array().cast("array<struct<start:bigint,end:bigint,k:int>>"))))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("parts")).alias("spans"), "parts")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("parts")


def _oracle() -> str:
    """The same result with every identifier compared with every secret of its row."""
    quoted = lambda p: p.replace("'", "''")
    found = []
    for k, (kind, (pattern, group, least)) in enumerate((BASE | WEAK).items()):
        keep = f"length(regexp_extract(m, '{quoted(pattern)}', {group})) >= {least}"
        if kind == "token":
            keep = "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"
        found.append(rf"""
SELECT row, {k} AS k, '{kind}' AS kind, e - length(m) AS s, e FROM (
  SELECT row, m, sum(length(m) + length(g)) OVER (PARTITION BY row ORDER BY i) AS e FROM (
    SELECT row, unnest(regexp_extract_all(text, '{quoted(pattern)}')) AS m, unnest(regexp_split_to_array(text, '{quoted(pattern)}')) AS g,
           generate_subscripts(regexp_extract_all(text, '{quoted(pattern)}'), 1) AS i
    FROM t WHERE regexp_matches(text, '{quoted(pattern)}')) WHERE m IS NOT NULL)
WHERE {keep}""")
    roles = ", ".join(f"('{k}', '{r}')" for k, r in ROLES.items())
    near = f"greatest(a.s - b.e, b.s - a.e) <= {SCOPE}"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}),
r(kind, role) AS (VALUES {roles}),
p AS (
  SELECT f.*, role FROM f JOIN r USING (kind)
  WHERE k < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM f b WHERE b.k < {len(BASE)} AND b.row = f.row AND f.s < b.e AND b.s < f.e)
), l AS (
  SELECT a.row, a.k AS ak, a.s AS a_s, a.e AS a_e, b.k AS bk, b.s AS b_s, b.e AS b_e
  FROM p a JOIN p b ON a.row = b.row AND a.role = 'identifier' AND b.role = 'secret' AND {near}
), w AS (
  SELECT row, ak AS k, a_s AS s, a_e AS e FROM l UNION SELECT row, bk, b_s, b_e FROM l
  UNION SELECT a.row, a.k, a.s, a.e FROM p a JOIN (SELECT row, least(a_s, b_s) AS s, greatest(a_e, b_e) AS e FROM l) b
    ON a.row = b.row AND a.role = 'endpoint' AND {near}
), every AS (
  SELECT row, k, s, e FROM p WHERE k < {len(BASE)} UNION ALL SELECT row, k, s, e FROM w WHERE k >= {len(BASE)}
), g AS (
  SELECT row, string_agg(n || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans,
         coalesce(string_agg(n || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < {len(BASE)}), '') AS base,
         {", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(BASE))}
  FROM (SELECT row, k, s::BIGINT AS s, e::BIGINT AS e, {KINDS}[k + 1] AS n FROM every) GROUP BY row
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (row)
"""


ORACLE = _oracle()
