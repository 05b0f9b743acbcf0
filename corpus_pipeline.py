"""The corpus pipeline: five stages over documents, each one operator of leadloom.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.

Cases: a null text is an empty text: it isn't toxic, is a copy of other empty texts, links with nothing, has size 0
and so isn't taken by the mix. A null doc_id is an id too; it stays where nothing with an id is equal to it. Texts are whole,
however long. Of equal texts the smallest doc_id stays; rows that repeat a doc_id with its text stay or go together.
An empty table gives an empty result. Columns other than doc_id, text and source are passed on as they are, whatever
their names, and the last stage returns doc_id, lang and source (those that are there), ids and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import exact_dedup, jaccard_join, mixing, sentencepiece_viterbi, toxicity
from leadloom.llm.common import documents, new_path, written
from leadloom.llm.queries import PIECE_BPE

#: Near copies: documents whose sets of five-word shingles have at least this Jaccard similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: Tables of kept ids up to this many rows (16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def _kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in kept (doc_id, copies), once for each copy; a null id is an id too.

    kept holds an id once. Repeated rows of docs stay repeated.
    """
    table, _ = written(kept, "kept")
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    table = table.withColumnRenamed("doc_id", "kept_id")
    # A row travels as one struct, so that its columns may have any name.
    rows = _packed(docs)
    joined = rows.join(F.broadcast(table) if few else table.hint("merge"), rows["row_id"].eqNullSafe(table["kept_id"]))
    if "copies" in table.columns:
        joined = joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return joined.select("row.*")


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """row_id, the given columns, and row, a struct of all columns."""
    return docs.select(F.col("doc_id").alias("row_id"), *columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.sample_of(docs, labels))
    scored = toxicity.score(_packed(docs, "text"), model)
    return scored.where(toxicity.predicted() == 0).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    found = exact_dedup.deduplicate(docs, exact_dedup.fresh_index(spark))
    return _kept(docs, found.where("kept").select("doc_id").distinct())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays."""
    found = jaccard_join.join(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    return _kept(docs, found.where("doc_id <=> component_id").select("doc_id").distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken; one that isn't taken goes."""
    found = mixing.mix(docs).where("copies > 0")
    return _kept(docs, found.groupBy("doc_id").agg(F.max("copies").alias("copies")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and whether decoding them gives the text again."""
    return sentencepiece_viterbi.encode(docs, PIECE_BPE, keep=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: The toxicity and SentencePiece stages can't be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
