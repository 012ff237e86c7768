"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans come from patterns over whole texts. Weak parts - bare 40-character keys and endpoints - mean nothing alone, so
they are looked up only in texts with an access identifier and reported only where an interval join finds the complementary
parts within one scope of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.functions import let
from framewright.llm.common import fresh, stored

# The kinds of strong spans in their order, and the patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
SECRET = r"[A-Za-z0-9+/]{40,}+"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")

#: Code points on either side of an access identifier in which its other parts are looked for.
SCOPE = 400

#: Matches or spans of one text that are folded together. Appending to an array copies it, so folds are short and many.
BLOCK = 256

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _blocks(items: Column) -> Column:
    """An array that isn't empty as an array of arrays of ``BLOCK`` items."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK)), lambda i: F.slice(x, (i * BLOCK + 1).cast("int"), BLOCK)))


def _running(blocks: Column, add) -> Column:
    """What ``add(sum, item)`` gives, from 0 on, before each block and after the last."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["at"], add).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    return F.aggregate(blocks, start, step, lambda acc: F.concat(acc["out"], F.array(acc["at"])))


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Leftmost matches that don't overlap, as spans in code points.

    Splitting by the pattern gives the gaps between matches, so running lengths of gaps and matches give positions.
    ``keep``: by match, whether it counts.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kept = keep if keep is not None else F.transform(matches, lambda m: F.lit(True))
    zipped = F.arrays_zip(F.transform(matches, lambda m: F.length(m)).alias("m"), F.transform(F.slice(gaps, 1, F.size(matches)), lambda g: F.length(g)).alias("g"), kept.alias("k"))
    nothing = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["m"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["k"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def of(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])

    def placed(blocks: Column) -> Column:
        return let(_running(blocks, lambda a, x: a + x["g"] + x["m"]), lambda at: F.flatten(F.transform(blocks, lambda b, i: of(b, F.element_at(at, i + 1)))))

    return F.when(F.rlike(text, F.lit(pattern)), let(_blocks(zipped), placed)).otherwise(nothing)


def _strong(text: Column) -> Column:
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    return F.concat(_spans(text, ASSIGN, 0, long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans (kinds 3 and 4) of ``_row, start, kind, end`` rows that are linked to an access identifier (kind 1).

    A bare key is linked if an access identifier is within ``scope`` of it; an endpoint, if one is that has a secret (kind 0 or 3)
    within its scope too. Intervals meet in buckets of the scope's width, so a part is compared with identifiers nearby only. Both
    sides are in every bucket that they reach; a pair counts in the first bucket that it shares.
    """
    near = lambda p: F.floor(p / F.lit(scope))
    ids = parts.where("kind = 1").select("_row", F.col("start").alias("_id"), F.col("end").alias("_end"), F.explode(F.sequence(near(F.col("start") - scope), near(F.col("end") + scope))).alias("_b"))
    others = parts.where("kind IN (0, 3, 4)").withColumn("_b", F.explode(F.sequence(near(F.col("start")), near(F.col("end")))))
    first = F.col("_b") == near(F.greatest("start", F.col("_id") - scope))
    met = others.join(ids, ["_row", "_b"]).where(first & (F.col("start") <= F.col("_end") + scope) & (F.col("end") >= F.col("_id") - scope))
    has_secret = F.max((F.col("kind") != 4).cast("int")).over(W.partitionBy("_row", "_id"))
    return met.withColumn("_s", has_secret).where("kind = 3 OR kind = 4 AND _s = 1").select("_row", "start", "kind", "end").distinct()


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base_spans`` (kinds 0 to 2) and ``all_spans``, arrays of ``start, kind, end`` in order.

    Positions are code points, the end is exclusive; ``kind`` indexes ``KINDS``. A null text counts as empty and has no spans. Repeated
    rows are scanned by themselves; a text of any length is scanned whole; an empty table gives an empty table. A linked span may overlap
    others, but doesn't lie within one of ``base_spans``. Without ``keep_text`` the texts are left out and only spans are stored. Other
    columns are kept; ``base_spans`` and ``all_spans`` are replaced.
    """
    docs = docs.drop("base_spans", "all_spans")
    row, weak_, linked_ = fresh("_row", docs), fresh("_weak", docs), fresh("_linked", docs)
    whole = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast(SPANS)
    scanned = docs.withColumn("base_spans", F.array_sort(_strong(whole)))
    has_id = F.exists("base_spans", lambda s: s["kind"] == 1)
    bare = F.filter(_spans(whole, SECRET, 3), lambda s: s["end"] - s["start"] == 40)
    weak = F.concat(bare, _spans(whole, ENDPOINT, 4))
    scanned = scanned.withColumn(weak_, F.when(has_id, weak).otherwise(nothing)).withColumn(row, F.monotonically_increasing_id())
    kept = stored(scanned if keep_text else scanned.drop(text))  # row numbers are fixed from here on
    parts = kept.where(F.size(weak_) > 0).select(F.col(row).alias("_row"), F.inline(F.concat("base_spans", weak_)))
    reach = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(W.partitionBy("_row").orderBy("start"))  # of base spans that begin here or before
    apart = parts.withColumn("_reach", reach).where((F.col("kind") < 3) | F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).drop("_reach")
    linked = link_parts(apart, scope)
    linked = stored(linked.groupBy(F.col("_row").alias(row)).agg(F.collect_list(F.struct("start", "kind", "end")).alias(linked_)))
    every = F.array_sort(F.concat("base_spans", F.coalesce(linked_, nothing)))
    return kept.join(linked, row, "left").select(*[c for c in docs.columns if keep_text or c != text], "base_spans", every.alias("all_spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with each run of overlapping spans (in order of their starts) replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(acc["text"], acc["at"] - acc["first"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(acc["first"].alias("first"), acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def of(block: Column, first: Column, last: Column) -> Column:
        part = F.substring(text, first + 1, last - first)
        start = F.struct(first.alias("first"), part.alias("text"), first.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(block, start, step, lambda acc: F.array_join(acc["out"], ""))

    def marked(blocks: Column) -> Column:
        def joined(at: Column) -> Column:
            parts = F.transform(blocks, lambda b, i: of(b, F.element_at(at, i + 1), F.element_at(at, i + 2)))
            return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))

        return let(_running(blocks, lambda a, s: F.greatest(a, s["end"])), joined)

    return F.when(F.size(spans) > 0, let(_blocks(spans), marked)).otherwise(text)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("all_spans")).alias("spans"))


OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, name, least, most, pattern) AS (VALUES
  (0, 'assign', 8, NULL, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 16, NULL, 'AKIA[A-Z0-9]+'),
  (2, 'hex', 32, NULL, '[0-9a-f]+'),
  (3, 'secret', 40, 40, '[A-Za-z0-9+/]+'),
  (4, 'endpoint', 1, NULL, 'https?://[^\x20\x09-\x0D"''<>]+')),
m AS (SELECT d.r, k.*, regexp_extract_all(d.t, k.pattern) AS ms, string_split_regex(d.t, k.pattern) AS gs FROM d, k),
u AS (SELECT r, kind, name, least, most, pattern, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM m),
x AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
z AS (SELECT *, CASE WHEN kind = 0 THEN length(regexp_extract(m, pattern, 2)) ELSE length(m) END AS size FROM x),
s AS MATERIALIZED (SELECT r, kind, name, e - length(m) AS b, e FROM z WHERE size >= least AND (most IS NULL OR size <= most)),
p AS (SELECT * FROM s WHERE kind = 0 UNION ALL
      SELECT * FROM s w WHERE kind > 2 AND NOT EXISTS (SELECT 1 FROM s v WHERE v.r = w.r AND v.kind < 3 AND v.b <= w.b AND w.e <= v.e)),
n AS (SELECT p.*, max(CASE WHEN p.kind <> 4 THEN 1 ELSE 0 END) OVER (PARTITION BY i.r, i.b) AS has_secret
      FROM s i JOIN p ON i.r = p.r AND i.kind = 1 AND p.b <= i.e + 400 AND p.e >= i.b - 400),
a AS (SELECT * FROM s WHERE kind < 3 UNION ALL SELECT DISTINCT r, kind, name, b, e FROM n WHERE kind = 3 OR kind = 4 AND has_secret = 1),
o AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind, e) FILTER (kind < 3) AS base,
             string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind, e) AS spans FROM a GROUP BY 1)
SELECT d.doc_id, coalesce(o.n_assign, 0) AS n_assign, coalesce(o.n_access, 0) AS n_access, coalesce(o.n_hex, 0) AS n_hex,
       sha256(coalesce(o.base, '')) AS base_sha256, coalesce(o.spans, '') AS spans
FROM d LEFT JOIN o ON d.r = o.r
"""
