"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes every stage as
Parquet and reads it again for the next one.

Rows are told apart by doc_id and text. Rows equal in both are copies of one document: the
near-duplicate stage leaves one of them, the other stages treat each by itself. Null texts
count as empty, a null doc_id is a value like any other, an empty table stays empty, and
further columns of any name and type are carried along. Only a column that has the name of a
result of the last stage (ids, n_tokens) goes on as input_<name>.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlift.llm import bpe, mixing, near, pii, quality
from armlift.llm.tables import documents
from armlift.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

# the stages learn a model and compare sets of shingles, which SQL does not express
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RESULTS = ("ids", "n_tokens")
NAMED = ("coalesce(cast(doc_id as string), 'null') as _doc", "xxhash64(text) as _text")


def carrying(stage: Stage) -> Stage:
    """The stage with further columns under neutral names, so that none meets a name the stage uses."""

    @functools.wraps(stage)
    def carried(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        neutral = docs.toDF(*[c if c in COLUMNS else f"_c{i}" for i, c in enumerate(docs.columns)])
        known = {f"_c{i}": c for i, c in enumerate(docs.columns)}
        result = stage(spark, neutral, sf_dir)
        added = {c for c in result.columns if c not in neutral.columns}
        back = [known.get(c, c) if c not in added else c for c in result.columns]
        return result.toDF(*[f"input_{n}" if c not in added and n in added else n for c, n in zip(result.columns, back)])

    return carried


def named(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("*", *NAMED)


def listed(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def in_order(docs: DataFrame) -> str:
    """SQL order of rows that share doc_id and text; types without an order follow their JSON text."""
    unordered = ("map<", "variant")
    keys = [
        f"to_json(struct(`{f.name}`))" if any(u in f.dataType.simpleString() for u in unordered) else f"`{f.name}`"
        for f in docs.schema.fields
        if f.name != "text"
    ]
    return ", ".join(keys)


@carrying
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"not {quality.held_out()}")
    model = quality.fit(docs, labels)
    return quality.with_quality(docs, model).where("predicted = 1").select(*listed(docs))


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id, then text hash, then other columns."""
    groups = near.near_duplicates(docs).where("kept")
    alone = groups.where("group_no is null").selectExpr("doc_id", "text_key")
    first = groups.where("group_no is not null").groupBy("group_no").agg(F.min(F.struct("doc_id", "text_key")).alias("f"))
    winners = alone.unionByName(first.select("f.*")).selectExpr(
        "coalesce(cast(doc_id as string), 'null') as _doc", "text_key as _text"
    )
    kept = named(docs).join(winners.distinct(), ["_doc", "_text"])
    place = f"row_number() over (partition by _doc, _text order by {in_order(docs)}) as _place"
    return kept.selectExpr("*", place).where("_place = 1").select(*listed(docs))


@carrying
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all words by source weight: a document comes as often as the mix takes it, or not at all."""
    key = "concat(coalesce(cast(doc_id as string), 'null'), ' ', xxhash64(text))"
    sizes = mixing.word_counts(docs.selectExpr(f"{key} as doc_id", "source", "text"))
    taken = mixing.mix(sizes).groupBy(F.col("doc_id").alias("_key")).agg(F.expr("sort_array(collect_list(copies), false) as _copies"))
    placed = docs.selectExpr("*", f"{key} as _key").join(taken, "_key").selectExpr(
        "*", f"row_number() over (partition by _key order by {in_order(docs)}) as _place"
    )
    repeated = placed.selectExpr("*", "element_at(_copies, _place) as _times").where("_times > 0")
    return repeated.selectExpr(*listed(docs), "explode(sequence(1L, _times)) as _copy").drop("_copy")


@carrying
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the text decoded from them again."""
    encoded = bpe.encode(docs, VOCABULARY, PATTERN)
    decoded = bpe.decode(encoded.selectExpr("*", "ids as kept_ids"), VOCABULARY, PATTERN)
    return decoded.withColumnRenamed("kept_ids", "ids").selectExpr("*", "size(ids) as n_tokens")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
