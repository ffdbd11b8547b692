"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages take (spark, docs, sf_dir); all but the last return the columns of ``documents``. Ids may repeat or be null:
every row counts as a document of its own. Null texts count as empty, which the quality stage rejects. Extra columns pass
through, whatever their names: columns that the stages add for themselves start with two underscores. Without rows every
stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontam, ngram_join, pieces, quality, secrets
from stratalog.llm.common import setting, table
from stratalog.shared import materialize

#: Near duplicates: words of an n-gram, and the similarity in percent.
WORDS, SIMILARITY = 5, 80


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay, those at the threshold too; equal texts fare alike. Empty, blank and null texts score as wholly bad ones."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, field, score="__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked rows the one with the smallest id stays, a null id last, and of equal ids the first row.

    Rows are told apart by keys of their own, so rows that repeat an id stay unless their texts are linked.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed-rows")
    source = rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = ngram_join.components_of(source, n=WORDS, percent=SIMILARITY)
    first = found.groupBy("component_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("__row"))
    return rows.join(first.hint("merge"), "__row", "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item stay: of a document at both bounds the item counts as contained. Empty and null texts contain none."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), leaks="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, overlapping ones by one, and n_chars follows. Null texts stay null."""
    found = secrets.find_secrets(docs, secrets.infer_grammar(docs), secrets="__secrets")
    return secrets.redact(found, secrets="__secrets").withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, the piece ids, and the digest of the text decoded from them; a row for every document. No text has no ids."""
    model = pieces.PieceModel.load(setting(spark, "pieces.model", pieces.MODEL))
    coded = pieces.encode(docs, model, decoded="__decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("__decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", reject_bad),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Models and automata are fitted on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
