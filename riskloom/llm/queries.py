"""The registered query of every operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import ann, chat, decontaminate, language, ngram_join, packing, pair_alignment, prefix_bpe, prefix_trie, quality, secret_scan, suffix_dedup, url_filter
from riskloom.llm.common import remainder

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(function: Query) -> Query:
    _ALL[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_ALL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables have neither fetch days nor a list: days are spread by page id, and
    every page's own URL is at some day entered on, or taken off, a category's list."""
    pages = table(spark, sf_dir, "pages")
    day = lambda step: F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("page_id") * step) % 1461).cast("int"))
    url, n = F.col("url"), F.col("page_id")
    captures = pages.select("page_id", "url", day(7919).alias("fetched_on"))
    host = url_filter.host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(url, url_filter.PATH, 1)
    pattern = F.when(n % 3 == 0, host).when(n % 3 == 1, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.size(labels)), ".")).otherwise(
        F.concat(host, F.regexp_extract(path, r"^(/[^/]*/?)", 1)))
    entries = pages.select(
        F.element_at(F.array(F.lit("host"), F.lit("domain"), F.lit("prefix")), (n % 3 + 1).cast("int")).alias("kind"), pattern.alias("pattern"),
        F.concat(F.lit("c"), F.floor(n / 3) % 4).alias("category"),
        F.when(F.floor(n / 7) % 3 == 0, "remove").otherwise("add").alias("action"), day(104729).alias("effective"))
    return url_filter.url_filter(captures, entries).drop("url")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secret_scan.scan(documents, secret_scan.train(secret_scan.samples_of(documents)))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    marks = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    every = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_chats(chat.records_of(every)))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_labels(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, model, keep_text=False).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.identify(documents.select("doc_id", "text"), language.fit(documents), keep_text=False)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with the first turns, 0 to 5, of its family's first one."""
    own = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 100)
    leads = own.filter("conv_id = family").select("family", F.slice("turns", 1, 5).alias("leads"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    lead = F.when(F.col("leads").isNotNull(), F.slice("leads", F.lit(1), h)).otherwise(F.slice("turns", 1, 0))
    return prefix_trie.trie(own.join(leads, "family", "left").select("conv_id", F.concat(lead, rest).alias("turns")))


@query
def op11_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pair_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
