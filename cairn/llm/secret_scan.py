"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by its SHA-256. A ledger kept under a path
lists which (blob, rule, rule version) triples were scanned before; a run scans only the
others, each blob once however many documents hold it, appends what it found, and
joins all findings of the present rule versions back to every document with that blob.

Positions come from marking: the matches of a rule are wrapped in marks, the text
is split there, and running lengths of the pieces give code-point offsets.

Defined cases: a null text is empty and has no findings; equal texts share one
scan; rows that repeat a doc_id each get a row; characters used as marks are
replaced, for matching only, by one that no rule can match; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import cut, scratch_path


@dataclass(frozen=True)
class Rule:
    """kind, version, pattern; least code points of the part (group) that counts."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    base: bool = False


#: Base kinds in their order, then what this scan adds.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32, 0, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 1),
)
OPEN, CLOSE, PART, OTHER = "\ue000", "\ue001", "\ue002", "\ufffd"
FINDINGS = "blob string, kind string, version int, span_start long, span_end long"


def blobs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, blob: the content address of every row's text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob"))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of rules in (blob, text) rows that carry `todo`, an array of rule kinds."""
    clean = F.translate("text", OPEN + CLOSE + PART, OTHER * 3)
    marked = []
    for r in rules:
        wanted = F.array_contains("todo", r.kind) & F.col("text").rlike(r.pattern)
        cut_at = F.split(F.regexp_replace(clean, r.pattern, f"{OPEN}$0{PART}${r.group}{CLOSE}"), OPEN)
        marked.append(F.when(wanted, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), cut_at.alias("pieces"))))
    rows = texts.select("blob", F.explode(F.filter(F.array(*marked), lambda m: m.isNotNull())).alias("m"))
    rows = rows.select("blob", "m.kind", "m.version", "m.least", F.posexplode("m.pieces").alias("n", "piece"))
    found = F.substring_index("piece", PART, 1)
    part = F.substring_index(F.substring_index("piece", PART, -1), CLOSE, 1)
    rest = F.when(F.col("n") == 0, F.length("piece")).otherwise(F.length(F.substring_index("piece", CLOSE, -1)))
    rows = rows.select("blob", "kind", "version", "least", "n", F.when(F.col("n") > 0, F.length(found)).otherwise(0).alias("len"), F.when(F.col("n") > 0, F.length(part)).otherwise(-1).alias("part"), rest.alias("rest"))
    ahead = Window.partitionBy("blob", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.col("len") + F.col("rest")).over(ahead), F.lit(0)).cast("long"))
    rows = rows.where((F.col("n") > 0) & (F.col("part") >= F.col("least")))
    return rows.select("blob", "kind", "version", F.col("at").alias("span_start"), (F.col("at") + F.col("len")).alias("span_end"))


@dataclass
class Ledger:
    """scanned(blob, kind, version) and findings; both may be absent at first."""

    scanned: DataFrame | None = None
    findings: DataFrame | None = None


def read_ledger(spark: SparkSession, path: str) -> Ledger:
    """The ledger kept under path; an empty one where none is yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scanned")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return Ledger()
    return Ledger(spark.read.parquet(f"{path}/scanned"), spark.read.schema(FINDINGS).parquet(f"{path}/findings"))


def append_ledger(path: str, new: Ledger) -> None:
    """Add a run's blobs and findings to the ledger under path; findings first, so
    that a run that is lost between the two is scanned again, not forgotten."""
    new.findings.write.mode("append").parquet(f"{path}/findings")
    new.scanned.write.mode("append").parquet(f"{path}/scanned")


def update(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Ledger]:
    """All documents' (doc_id, blob) and what this run adds to the ledger.

    `todo` holds, for each blob, the rules whose present version has not seen it.
    """
    held = cut(blobs(docs, text, doc_id), "blobs")
    first = held.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    todo = F.array(*(F.lit(r.kind) for r in rules))
    if ledger.scanned is None:
        first = first.withColumn("todo", todo)
    else:
        versions = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
        seen = ledger.scanned.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        unseen = F.array_except(versions, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>")))
        first = first.join(seen, "blob", "left").withColumn("todo", unseen["kind"]).where(F.size("todo") > 0).drop("seen")
    first = cut(first, "unseen")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    t, f = texts.alias("t"), first.alias("f")
    texts = t.join(f, F.col("t.doc_id").eqNullSafe(F.col("f.doc_id"))).select("f.blob", "f.todo", "t.text")
    texts = texts.where(F.col("blob") == F.sha2(F.col("text").cast("binary"), 256))  # a doc_id may repeat with another text
    findings = cut(scan(texts, rules).distinct(), "findings")
    kinds = {r.kind: r.version for r in rules}
    version = F.element_at(F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), F.lit(v)))), F.col("kind"))
    scanned = first.select("blob", F.explode("todo").alias("kind")).withColumn("version", version)
    return held, Ledger(scanned, findings)


def joined(kind: str, start: str, end: str):
    """kind:start:end of a span."""
    return F.concat_ws(":", F.col(kind), F.col(start).cast("string"), F.col(end).cast("string"))


def document_findings(held: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and all spans, for every document."""
    order = F.element_at(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i)))), F.col("kind"))
    span = F.struct(F.col("span_start"), order.alias("rank"), F.col("kind"), F.col("span_end"))
    base = [r.kind for r in rules if r.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["span_start"].cast("string"), s["span_end"].cast("string"))), ",")
    by_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base))
    by_blob = by_blob.select("blob", *(f"n_{k}" for k in base), F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
    out = held.join(cut(by_blob, "by_blob"), "blob", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base), F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def secret_scan(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scan what the ledger under path has not seen, append that to it, and report every document.

    Without a path the ledger is a new one in the shared folder.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ledger")
    held, new = update(docs, read_ledger(spark, path), rules, text, doc_id)
    append_ledger(path, new)
    now = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    known = read_ledger(spark, path).findings.join(F.broadcast(now), ["kind", "version"], "left_semi")  # a row a rule
    return document_findings(held, known.distinct(), rules)


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The report in DuckDB, from the same marking of matches."""
    quote = lambda p: p.replace("'", "''")
    marks = [f"chr({ord(c)})" for c in (OPEN, CLOSE, PART)]
    marked = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least,
            string_split(regexp_replace(t, '{quote(r.pattern)}', {marks[0]} || '\\0' || {marks[2]} || '\\{r.group}' || {marks[1]}, 'g'), {marks[0]}) AS pieces
            FROM d WHERE regexp_matches(t, '{quote(r.pattern)}')"""
        for i, r in enumerate(rules)
    )
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
    counted = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {marks[0]} || {marks[1]} || {marks[2]}, repeat(chr({ord(OTHER)}), 3)) AS t FROM documents),
m AS ({marked}),
e AS (SELECT doc_id, rank, kind, least, unnest(pieces) AS piece, unnest(range(len(pieces))) AS n FROM m),
l AS (SELECT doc_id, rank, kind, least, n,
             CASE WHEN n = 0 THEN 0 ELSE length(split_part(piece, {marks[2]}, 1)) END AS len,
             CASE WHEN n = 0 THEN -1 ELSE length(split_part(split_part(piece, {marks[2]}, 2), {marks[1]}, 1)) END AS part,
             CASE WHEN n = 0 THEN length(piece) ELSE length(split_part(piece, {marks[1]}, 2)) END AS rest FROM e),
s AS (SELECT *, coalesce(sum(len + rest) OVER (PARTITION BY doc_id, rank ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l),
f AS (SELECT doc_id, rank, kind, place, kind || ':' || CAST(place AS BIGINT) || ':' || CAST(place + len AS BIGINT) AS span FROM s WHERE n > 0 AND part >= least),
g AS (SELECT doc_id, {counted}, string_agg(span, ',' ORDER BY place, rank) AS spans,
             coalesce(string_agg(span, ',' ORDER BY place, rank) FILTER (kind IN ({base})), '') AS base FROM f GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
