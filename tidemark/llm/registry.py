"""The thin queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, langid, licenses, mixing, ngram_join, quality, search, secrets, sharding, simhash, substrings, warc, whitening

MIX_WEIGHTS = [5.0, 2.0, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes, equal texts together."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document."""
    mixed = mixing.mixed(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without windows of 20 words that start earlier too."""
    left = substrings.without_repeats(table(spark, sf_dir, "documents"), 20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back in byte ranges."""
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that links at two or fewer bits make."""
    found = simhash.linked(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the outlier verdict of all documents."""
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those of folds 1 to 4; a null doc_id is in no fold, neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.trained(docs.where(langid.fold() != 0))
    found = langid.identified(docs, model)
    return found.select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, each a path with one version.

    A first scan knows the base rules alone and starts a ledger; the second has all rules, scans the pairs
    of blob and rule version that the ledger lacks, and joins the findings of both back to all paths.
    """
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secrets.scan(versions, rules=secrets.BASE)
    found, _ = secrets.scan(versions, ledger)
    base = len(secrets.BASE)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{rule.name}") for i, rule in enumerate(secrets.BASE)),
        F.sha2(named(F.filter("spans", lambda s: s["rank"] < base)), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents, with the passage that holds each best."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    sorted_ = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.col(labels))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        sorted_("base.label").alias("base_labels"),
        sorted_("labels").alias("labels"),
        "score",
    )


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all documents' sets of five-word shingles, and the components that a similarity of 0.8 or more makes."""
    return ngram_join.linked(table(spark, sf_dir, "documents"), 5)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors along the first 32 components, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), 32)


QUERIES = (op1_sharding, op2_substring_dedup, op3_warc, op4_mixing, op5_simhash, op6_quality, op7_secrets, op8_language, op9_decontamination, op10_licenses, op11_ngram_join, op12_search, op13_whitening)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


OP4 = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), per_source as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from sized group by source
), weighed as (
  select *, [5.0::double, 2.0::double, 1.0::double][(k % 3 + 1)::int] as weight, 2.0::double * source_size as ceiling,
         1.5::double * (sum(source_size) over ())::double as budget from per_source
), levels as (
  select *, coalesce(sum(ceiling) over (order by ceiling / weight, k rows between unbounded preceding and 1 preceding), 0) as before,
         sum(weight) over (order by ceiling / weight, k rows between current row and unbounded following) as rest from weighed
), found as (
  select max((budget - before) / rest) as level from levels
), targets as (
  select source, source_size, least(ceiling, weight * level) as target from weighed, found
), rated as (
  select s.doc_id, s.size, t.source_size, t.target, case when t.source_size = 0 then 0 else t.target / t.source_size end as rate,
         ('0x' || substr(md5('17:' || coalesce(s.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0 as u
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::int))::bigint as taken from rated
"""


OP2 = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
windows as (select doc_id, s, array_to_string(words[s:s + 19], ' ') as window20 from (select doc_id, words, unnest(range(1, len(words) - 18)) as s from w where len(words) >= 20)),
ranked as (select doc_id, s, row_number() over (partition by window20 order by doc_id, s) as k from windows),
gone as (select doc_id, list_distinct(flatten(list(range(s, s + 20)))) as places from ranked where k > 1 group by doc_id),
kept as (select w.doc_id, words, coalesce(len(places), 0) as removed, case when places is null then words else list_filter(words, lambda x, i: not list_contains(places, i)) end as rest from w left join gone using (doc_id))
select doc_id, len(words)::bigint as n_words, removed::bigint as n_removed, sha256(array_to_string(rest, ' ')) as kept_sha256 from kept
"""
OP3 = """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select *, sha1(body) as hex, min(page_id) over (partition by body) as first from p),
d as (select *, list_transform(range(8), lambda g: ('0x' || hex[5 * g + 1:5 * g + 5])::int) as parts from h)
select page_id, strlen(body)::bigint as payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> k) & 31) + 1]), '')), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d
"""
OP12 = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), lengths as (select doc_id, len(terms)::bigint as n from words where len(terms) > 0),
corpus as (select count(*) as documents, sum(n)::hugeint as terms from lengths),
norms as (select doc_id, 25 + (75 * n::hugeint * documents) // corpus.terms as m from lengths, corpus),
postings as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from words) group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, corpus group by term, documents),
asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
  ) group by item_id, term
), scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (term) join postings using (term) join norms using (doc_id) group by item_id, doc_id
), ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


def oracle_sql() -> dict:
    return {"op2_substring_dedup": OP2, "op3_warc": OP3, "op4_mixing": OP4, "op12_search": OP12}
