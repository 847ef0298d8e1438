"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare
from . import ball_codes, bpe, decontaminate, filter_audit, language, licences, multi_index, near_dup, passages, secret_scan, set_join, shards, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


@query("op1_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


@query("op2_secret_scan")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    findings = secret_scan.scan_versions(docs, secret_scan.fresh_ledger(spark), path="doc_id")
    found = secret_scan.findings_of_paths(docs, findings, path="doc_id")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), sha256(listed).alias("base_sha256"), listed.alias("spans"))


@query("op3_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        sha256(F.array_join("items", ",")).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query("op4_language")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "offending")


@query("op6_licence_scan")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, *licences.train(docs))


@query("op7_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_records(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op10_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query("op11_set_join", rf"""
with recursive worded as (select doc_id, {_WORDS} as w from documents),
sets as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                           when len(w) > 0 then [array_to_string(w, ' ')] else cast([] as varchar[]) end) as s from worded),
members as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (select a.doc_id as a, b.doc_id as b from members a join members b on a.shingle = b.shingle and a.doc_id <> b.doc_id
          group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
least as (select a, min(b) as b from reached group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id from sets left join least on a = doc_id""")
def set_join_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query("op12_filter_audit", r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as least from documents),
counted as (select *, regexp_extract_all(t, '[^ 	-
]+') as w from texts),
marks as (select doc_id as marked, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
failing as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 100 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when doc_id > least then 'E' else '' end as fails
    from counted left join marks on marked = doc_id),
masks as (select part, fails, good, toxic, count(*) as n from failing group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letter a, letter b, letter c, letter d, letter e
           where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
steps as (select *, substr(filter_order, step, 1) as l, translate(substr(filter_order, 1, step - 1), fails, '') <> substr(filter_order, 1, step - 1) as gone
          from masks, orders, (select unnest([1, 2, 3, 4, 5]) as step)),
judged as (select *, contains(fails, l) as failing from steps)
select part, filter_order, cast(step as integer) as step,
    cast(sum(case when not gone and not failing then n else 0 end) as bigint) as kept, cast(sum(case when failing and not gone then n else 0 end) as bigint) as removed,
    cast(sum(case when failing and gone then n else 0 end) as bigint) as redundant, cast(sum(case when fails = l then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when failing and not gone and good then n else 0 end) as bigint) as good_lost, cast(sum(case when failing and not gone and toxic then n else 0 end) as bigint) as toxic_lost,
    cast(sum(case when failing then n * 120 // length(fails) else 0 end) as bigint) as shapley
from judged group by part, filter_order, step""")
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _codebook_round(k: int) -> str:
    """CTEs of one round: assignment to the entries of round ``k``, new entries."""
    return f"""
gaps{k} as (select v.rid, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) as d from parts v join books{k} b on b.part = v.part and b.pos = v.pos group by v.rid, v.part, b.entry),
best{k} as (select rid, part, arg_min(entry, d * 64 + entry) as entry, min(d) as d from gaps{k} group by rid, part),
means{k} as (select v.part, n.entry, v.pos, cast(floor(sum(v.x) / count(*)) as bigint) as x from parts v join best{k} n on n.rid = v.rid and n.part = v.part group by v.part, n.entry, v.pos),
books{k + 1} as (select b.part, b.entry, b.pos, coalesce(m.x, b.x) as x from books{k} b left join means{k} m on m.part = b.part and m.entry = b.entry and m.pos = b.pos),"""


@query("op13_ball_codes", f"""
with kept as (select row_number() over (order by vec_id, embedding) as rid, vec_id, label, embedding from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as (select rid, cast((i - 1) // (len(embedding) // 16) as integer) as part, cast((i - 1) % (len(embedding) // 16) as integer) as pos, cast(floor(256 * cast(embedding[i] as double)) as bigint) as x
    from (select rid, embedding, unnest(range(1, len(embedding) + 1)) as i from kept)),
books0 as (select part, rid - 1 as entry, pos, x from parts where rid <= 64),
{_codebook_round(0)}
{_codebook_round(1)}
gaps2 as (select v.rid, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) as d from parts v join books2 b on b.part = v.part and b.pos = v.pos group by v.rid, v.part, b.entry),
best2 as (select rid, part, arg_min(entry, d * 64 + entry) as entry, min(d) as d from gaps2 group by rid, part),
coded as (select rid, string_agg(lower(printf('%02x', cast(entry as integer))), '' order by part) as code, cast(sum(d) as bigint) as error from best2 group by rid),
digest as (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from books2)
select k.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, codebooks_sha256
from kept k join coded c on c.rid = k.rid, digest""")
def codes_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = ball_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return ball_codes.with_label_error(coded).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(ball_codes.codebooks_digest(books)).alias("codebooks_sha256"))
