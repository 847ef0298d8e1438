"""Secret scans over a ledger of text versions.

Every version of every text is named by the SHA-256 of its content. The ledger
holds the (blob, rule, rule version) triples that have been scanned; a scan
reads only the triples that it lacks, adds their findings, and joins findings
back to all paths that carry the blob. Copies are scanned once, and a second
run scans only what is new.

Positions count code points, ends are exclusive. A null text is an empty blob,
which has no findings; an empty table has none either; texts are scanned whole,
however long. Repeated rows stay repeated. Helper columns take names that the
documents do not use. Only built-in functions are used.

Findings are written before the triples are marked as scanned. A scan that dies
in between is made good by the next one: it scans the same triples again, and
findings that are in the ledger twice are read once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .names import spare


class Rule(NamedTuple):
    """``least`` characters are needed in ``group`` of a match."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The rules and their order. A run of characters that is too short
# to pass cannot hide a longer one in the last two, so these ask for it at once.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
LEDGER_SCHEMA = "blob string, kind string, version int"
FINDING_SCHEMA = "blob string, kind string, version int, start long, end long"


def with_blob(versions: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return versions.withColumn("blob", F.sha2(body.cast("binary"), 256))


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob, text, todo) rows; ``todo`` lists the rules to run.

    Splitting a text at a pattern leaves the gaps between the matches, so
    lengths of gaps and matches, summed up, are the positions.
    """
    def of_rule(i: int, rule: Rule) -> Column:
        pattern = F.lit(rule.pattern)
        hits = F.when(F.array_contains("todo", i) & F.col("text").rlike(rule.pattern), F.arrays_zip(
            F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length).alias("long"),
            F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length).alias("core")))
        return F.transform(hits, lambda x: F.struct(
            F.lit(i).alias("rule"), x["gap"].alias("gap"), x["long"].alias("long"), x["core"].alias("core")))

    found = [of_rule(i, rule) for i, rule in enumerate(rules)]
    listed = F.flatten(F.array_compact(F.array(*found)))
    # A row of its own for each version that was chosen, should a path repeat.
    rows = blobs.withColumn("row", F.monotonically_increasing_id()).select("blob", "row", F.posexplode(listed).alias("at", "hit")) \
        .select("blob", "row", "at", "hit.*").filter("long is not null")
    upto = Window.partitionBy("blob", "row", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array(*[F.lit(r.kind) for r in rules])
    versions = F.array(*[F.lit(r.version) for r in rules])
    least = F.array(*[F.lit(r.least) for r in rules])
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(upto).cast("long"))
    return placed.filter(F.col("core") >= F.get(least, F.col("rule"))).select(
        "blob", F.get(names, F.col("rule")).alias("kind"), F.get(versions, F.col("rule")).alias("version"),
        (F.col("end") - F.col("long")).alias("start"), "end")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """Scan what the ledger folder lacks, extend it, and return all findings in
    the ledger under these rules: (blob, kind, version, start, end).

    ``versions`` has one row for each historical version: a path column, which
    need not be unique, and its text.
    """
    spark = versions.sparkSession
    named = with_blob(versions.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    named = named.withColumn("path_hash", F.xxhash64("path", "blob"))
    done = _read(spark, f"{ledger}/scanned", LEDGER_SCHEMA)
    wanted = named.groupBy("blob").agg(F.min("path_hash").alias("path_hash"))
    have = done.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("have"))
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"{r.kind}:{r.version}").alias("name")) for i, r in enumerate(rules)])
    unseen = wanted.join(have, "blob", "left").select("blob", "path_hash", F.filter(
        F.transform(every, lambda r: F.when(~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), r["name"]), r["i"])),
        lambda x: x.isNotNull()).alias("todo")).filter(F.size("todo") > 0)
    # One version stands for the blob; the pair (blob, path) deals hot blobs out.
    # A path that repeats a blob is folded after the scan, which costs no text.
    chosen = named.hint("shuffle_hash").join(unseen.hint("shuffle_hash"), ["blob", "path_hash"])
    _scan(chosen, rules).distinct().write.mode("append").parquet(f"{ledger}/findings")
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    unseen.select("blob", F.explode(F.transform("todo", lambda i: F.get(kinds, i))).alias("r")).select("blob", "r.*") \
        .write.mode("append").parquet(f"{ledger}/scanned")
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    return _read(spark, f"{ledger}/findings", FINDING_SCHEMA).join(F.broadcast(current), ["kind", "version"], "left_semi").distinct()


def fresh_ledger(spark: SparkSession) -> str:
    return scratch_path(spark, "secret-ledger")


def findings_of_paths(versions: DataFrame, findings: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: (path, blob, spans), spans sorted by start, then by
    the order of the rules."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    per_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.element_at(rank, F.col("kind")).alias("rank"), "kind", "end"))).alias("spans"))
    named = with_blob(versions.select(F.col(path), F.col(text).cast("string").alias("text"))).select(path, "blob")
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return named.join(per_blob, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def redact(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> Column:
    """The text with its secrets replaced, rule after rule, each on what the
    rule before has left."""
    def replaced(rule: Rule, text: Column) -> Column:
        if not rule.group:
            return F.regexp_replace(text, rule.pattern, mark)
        pattern = F.lit(rule.pattern)
        parts = F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
            F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("core"))
        pieces = F.transform(parts, lambda x: F.concat(
            F.coalesce(x["gap"], F.lit("")),
            F.when(x["all"].isNull(), F.lit("")).when(F.length(x["core"]) >= rule.least, F.lit(mark)).otherwise(x["all"])))
        return F.when(text.rlike(rule.pattern), F.array_join(pieces, "")).otherwise(text)

    for rule in rules:
        text = replaced(rule, text)
    return text


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", ledger: str | None = None) -> DataFrame:
    """Documents with the secrets of their blobs redacted. Columns stay as they
    are; a column ``length`` is brought up to date."""
    key_found, blob_found = spare(docs.columns, "key_found", "blob_found")
    findings = scan_versions(docs, ledger or fresh_ledger(docs.sparkSession), path=key, text=text)
    # The id deals the copies of one blob out.
    marked = findings_of_paths(docs, findings, path=key, text=text).filter(F.size("spans") > 0) \
        .select(F.col(key).alias(key_found), F.col("blob").alias(blob_found)).distinct()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = F.col(key).eqNullSafe(F.col(key_found)) & (F.sha2(body.cast("binary"), 256) == F.col(blob_found))
    joined = docs.join(marked.hint("shuffle_hash"), same, "left")
    clean = F.when(F.col(blob_found).isNotNull(), redact(F.col(text))).otherwise(F.col(text))
    if length in docs.columns:
        joined = joined.withColumn(length, F.when(F.col(blob_found).isNotNull(), F.length(clean).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return joined.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
