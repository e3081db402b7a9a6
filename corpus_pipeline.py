"""The training-data pipeline: quality rules, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet and read again as
the next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.llm import bpe, decontam, pii, quality, simhash
from chartmill.llm.queries import BPE_FILE, table
from chartmill.plans.lineage import cut, shared_folder


class Plain:
    """docs with its columns named d0, d1, ...: no operator's result has such a name, so none replaces a column of docs."""

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.docs = docs.toDF(*[f"d{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """What a column is named now."""
        return f"d{self.names.index(name)}"

    def back(self, rows: DataFrame) -> DataFrame:
        """The columns of docs from rows, under their own names."""
        return rows.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(self.names)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts fail the base rule and go; very long ones are judged whole.  Rows with a null lang are
    judged, but shape no reference.  Repeated rows stay or go alike, an empty table stays empty.  Columns may have any name.
    """
    plain = Plain(docs)
    return plain.back(quality.quality(plain.docs, plain["text"], plain["lang"]).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id, then the least hash of its text, then the
    least hash of its other columns.

    doc_id may have any type; null ones come last, repeated rows leave one.  Null and empty texts are near each other;
    very long ones are fingerprinted whole.  Texts move once, to the keys of the documents that stay.  An empty table stays
    empty.  Columns may have any name.
    """
    plain = Plain(docs)
    key, text = plain["doc_id"], plain["text"]
    rest = F.to_json(F.struct(*[c for c in plain.docs.columns if c != text]))
    order = F.struct(F.col(key).alias("key"), F.xxhash64(text, F.col(text).isNull()).alias("hash"), F.xxhash64(rest).alias("rest"))
    keyed = plain.docs.withColumn("near", order)
    prints = simhash.with_fingerprint(keyed.select("near", F.col(key).alias("key"), F.col(text).alias("text")))
    rows = cut(prints.select("near", "key", "fingerprint"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "near")).alias("first")
    stay = rows.join(simhash.classes(docs, prints=rows), "fingerprint").groupBy("root").agg(first).select(F.col("first.near").alias("near"))
    return plain.back(keyed.join(stay, "near", "left_semi").dropDuplicates(["near"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated.

    Null and empty texts have no words and stay; very long ones are searched whole.  Repeated rows stay or go alike.
    Items with a null id or text are left out, and without items all documents stay; an empty table stays empty.
    Columns may have any name.
    """
    plain = Plain(docs)
    return plain.back(decontam.contamination(plain.docs, table(spark, sf_dir, "benchmark"), plain["text"]).where(~F.col("contaminated")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars, if there is one, follows the text.

    Null and empty texts stay as they are, very long ones are masked whole; repeated rows are masked alike.  An empty
    table stays empty.  Columns may have any name.
    """
    plain = Plain(docs)
    text = plain["text"]
    found = pii.find(plain.docs, text)
    clean = F.col("spans") == ""
    new = {text: F.when(clean, F.col(text)).otherwise(F.col("redacted"))}
    if "n_chars" in docs.columns:
        new[plain["n_chars"]] = F.when(clean, F.col(plain["n_chars"])).otherwise(F.length("redacted").cast(docs.schema["n_chars"].dataType))
    return plain.back(found.withColumns(new))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document, and the digest of what its ids decode to.

    Null and empty texts have no ids, very long ones are encoded whole; repeated rows are encoded each.  An empty table
    gives no rows; other columns of docs, whatever their names, are left out.
    """
    plain = Plain(docs)
    kept = [F.col(plain[c]).alias(c) for c in ("doc_id", "lang", "source")]
    return bpe.encode(plain.docs, public_tokenizers.path(BPE_FILE), plain["text"]).select(*kept, "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: SQL can't express the fingerprints, the taggers' spans or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result written to the shared folder and read from it.

    Nulls, empty, very long and repeated texts and extra columns go through the stages as each states; an empty table
    gives no rows.  The stages' tables stay in the folder until it is cleaned, as the result reads the last one.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(docs)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
