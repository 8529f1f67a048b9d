"""One query per text operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwatch.llm import (
    alignment, bpe, exact_dedup, fertility, importance, lexical, mixing, pii, simhash, suffix_dedup, toxicity, warc,
    winnowing,
)
from stmtwatch.llm.common import checkpointed, table, whole_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def tokenizer(name: str) -> str:
    """Where the file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = checkpointed(docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "source",
        mixing.word_count(whole_text()).alias("size"),
    ))
    mixed = mixing.mix(sized, size="size")
    return mixed.groupBy("row.row_id").agg(
        *[F.first(c).alias(c) for c in ("row", "size", "source_size", "target")],
        F.sum("words").alias("taken"), F.array_sort(F.array_compact(F.collect_list("shard"))).alias("shards"),
    ).select("row.doc_id", "size", "source_size", "target", "taken", "shards")


@query
def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer("word_bpe_49k.json"), decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = lambda key: F.crc32(F.col(key).cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, labels, usable=remainder("_key") != 0)
    return toxicity.with_score(docs, model).select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query
def op6_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    back = warc.read_archive(spark, warc.write_archive(pages))
    kind = pages.schema["page_id"].dataType
    return back.select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)
    )


@query
def op7_fertility(spark, sf_dir):
    rules = fertility.quality_rules(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return rules.withColumn("left_bands", F.array_join("left_bands", ","))


@query
def op8_importance(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return importance.importance_sample(docs, labels)


@query
def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.with_spans(docs, model=pii.fit(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return spans.select(
        "doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op11_winnowing(spark, sf_dir):
    found = winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.as_text("fingerprint").alias("fingerprint"),
        winnowing.as_text("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op12_lexical(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_alignment(spark, sf_dir):
    import public_tokenizers

    files = {
        "a": tokenizer("byte_bpe_50k.json"), "ranks": tokenizer("byte_bpe_50k.tiktoken"), "b": tokenizer("piece_bpe_32k.model")
    }
    docs = table(spark, sf_dir, "documents")
    found = alignment.align(docs, files, public_tokenizers.PATTERN, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op12_lexical": f"""
        with d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') as terms from documents),
        sized as (select doc_id, len(terms) as n, terms from d where len(terms) > 0),
        total as (select count(*) as docs, sum(n)::bigint as all_terms from sized),
        counted as (
            select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(terms) as term from sized) group by all),
        weights as (
            select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from counted, total group by term),
        q as (
            select item_id, term, count(*) as times from (
                select item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERM}')) as term from benchmark)
            group by all),
        scored as (
            select item_id, doc_id,
                sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms))))::bigint as score
            from q join counted using (term) join weights using (term), total group by all),
        ranked as (
            select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
        select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10""",
    "op6_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
        g as (select payload_digest, payload_bytes, max(page_id) as first from d group by all)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 1000 and page_id < first then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id < first then first end as refers_to
        from d join g using (payload_digest, payload_bytes)""",
    "op4_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
        from d join g using (text_sha256)""",
}
