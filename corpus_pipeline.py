"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet
and rereads it as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paretoflow.llm import hyperminhash, mixing, packing, paragraphs, quality
from paretoflow.llm.common import WORD, materialize, read

#: Stages on word shingles link at a similarity of 0.8.
PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rules or the line labels reject go."""
    model = quality.fit_on_labels(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).filter("quality.kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """HyperMinHash near-dedup: one document of each group stays."""
    return hyperminhash.keep_one(docs, PERCENT)


def cut_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: later copies of a paragraph or passage are cut; a document that loses all words goes.

    ``n_chars``, where there is one, is counted again.
    """
    found = paragraphs.cut(docs, PERCENT)
    row = F.col("row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("row.text").cast(docs.schema["n_chars"].dataType))
    emptied = ((F.size("removed") > 0) | (F.col("n_words_cut") > 0)) & ~F.col("row.text").rlike(WORD)
    return found.select(row.alias("row"), F.coalesce(emptied, F.lit(False)).alias("emptied")).filter("NOT emptied").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document comes as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: sequences of at most 2048 ids, each with its documents and its ids.

    Copies that the mix made are packed one by one.
    """
    cut = materialize(packing.pieces(docs), "pipeline-pieces")
    return packing.sequences(packing.pack(cut, cut.count()))


STAGES = [
    ("quality rules", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_paragraphs),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: line labelling and near duplicates have none that ends on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
