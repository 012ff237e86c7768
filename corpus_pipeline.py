"""From ``documents`` to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import discard, fresh, small, stored, word_count
from framewright.llm.langid import identify, train
from framewright.llm.mixing import mix_sources
from framewright.llm.ngram_join import similar_documents
from framewright.llm.packing import pack, token_pieces
from framewright.llm.secrets import redact, scan_secrets

#: Documents go only if even their best language needs more bits for a byte than this, or if they have no letters.
MAX_BITS_PER_BYTE = 7.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without language: null and empty texts, texts without letters, texts that no language's model can predict.

    Rows are judged by their text alone, so repeated rows stay or go together, and very long texts are judged whole. Without any
    labelled row, or in an empty table, nothing stays. Columns stay as they are, whatever their names.
    """
    found = identify(docs.select(F.struct("*").alias("doc"), "text"), train(docs.select("doc_id", "lang", "text")))
    return found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MAX_BITS_PER_BYTE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest id.

    Shingles of five words, similarity of 0.8 or more. Rows are told apart by id and text, so an id that repeats with different
    texts loses only those that are near duplicates; of equal rows one stays, and of rows that agree in id and text but not in other
    columns the smallest. A row without id stays if its group has no ids and it is the one; rows without words (or a null text)
    stay. An empty table stays empty.
    """
    own, first = fresh("_row", docs), fresh("_first", docs)
    row = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    groups = similar_documents(docs.select(row.alias("doc_id"), "text"), words=5, percent=80).where("n_shingles > 0")
    marks = groups.groupBy(F.col("doc_id").alias(own), (F.col("doc_id") != F.col("component_id")).alias("_gone")).agg(F.count("*").alias("_n"))
    marks = stored(marks.where("_gone OR _n > 1"))
    again, whole = small(stored(marks.where("NOT _gone").select(own))), docs.withColumn(own, row)
    once = whole.join(again, own, "left_semi").groupBy(own).agg(F.min(F.struct(*docs.columns)).alias(first)).select(f"{first}.*")
    return whole.join(small(stored(marks.select(own))), own, "left_anti").select(*docs.columns).unionByName(once)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret, alone or linked, and counts ``n_chars`` anew (null for a null text); documents all stay,
    repeated rows too, and other columns are left as they are, whatever their names."""
    found = scan_secrets(docs.select(F.struct("*").alias("doc"), "text"))
    clean = redact(F.col("text"), F.col("all_spans"))
    changed = found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("bigint"))
    return changed.select(*[F.col(c) if c in ("text", "n_chars") else F.col(f"doc.`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them; a document at a source's cut is taken whole.

    Repeated rows are documents of their own. Documents without words (null or empty texts) have nothing to give and go. Null sources are
    one source. Columns stay as they are, whatever their names; an empty table stays empty.
    """
    slim = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(slim)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.where("taken > 0").select("doc", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is an empty one, which is one piece of one token; repeated rows are packed each; only texts beyond a sequence are cut.
    An empty table gives an empty table.
    """
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces), ["doc_id", "piece"])


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("packing", packing)]

#: Statistical models and tokenizers are beyond SQL; near_duplicates is tested against a plain version, the others by what they must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            if i:
                discard(before)
    return docs
