"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every document that its
predecessor kept and returns a DataFrame; ``run`` writes it as Parquet into
the shared folder and reads it again as the next stage's documents. All but
the last return the columns of documents, whatever further ones there are.

Nulls may stand in any column. A null text counts as empty, but language ID
rejects it with all others that have no letter. Rows without identifier are
documents like others. Repeated rows, and rows of one identifier and text,
are one document from exact dedup on. Texts are read whole, however long. An
empty table of documents gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import bpe, ecoc_langid, exact_dedup, set_join, simhash, soft_mixing
from graphloom.llm.queries import MIX_WEIGHTS, TOKENIZER, label_domains, table
from graphloom.llm.staging import Staged

#: A document's rate if it is surely of the domain ``clean``: over 1, so that mixing keeps it.
CLEAN_RATE = 1.2
#: Bits in which near duplicates' SimHash fingerprints may differ to be a pair that is verified.
MAX_DISTANCE = 3
#: Pieces of text that a worker remembers: twice as many at most in each of three tables, some 20 MB.
CACHED = 40_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or whose two best languages are nearly level.

    Repeated rows stay or go together. Without any labelled language all go.
    """
    model = ecoc_langid.fit(docs)
    return ecoc_langid.identify(docs, model).filter((F.col("lang_pred") != ecoc_langid.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier stays; a null one sorts first."""
    return exact_dedup.drop_exact_duplicates(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays.

    SimHash with pigeonring filtering names pairs first; each is verified, and an
    exact check finds what fingerprints cannot. The row of the smallest
    identifier stays, one with an identifier before those without. Texts of under five words are one shingle, so they only equal one
    another.
    """
    return simhash.keep_one(docs, set_join.members(docs, shingle=5, similarity=0.8, max_distance=MAX_DISTANCE))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says; the domains' tokens then have the shares of MIX_WEIGHTS.

    That is mixing by repetition: junk and toxic documents are thinned out, and
    clean ones are repeated CLEAN_RATE times on average, so that none is lost.
    Without clean labels the budget is what there is.
    """
    labels = label_domains(table(spark, sf_dir, "labels"))

    def budget(totals):
        return CLEAN_RATE * totals["clean"] / MIX_WEIGHTS["clean"] if totals.get("clean") else sum(totals.values())

    return soft_mixing.mix(docs, labels, MIX_WEIGHTS, budget=budget)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids (packed as little-endian 32-bit integers), their number, and whether they decode to the text.

    One row for each row of ``docs``, copies that mixing made included.
    """
    found = bpe.encode_documents(docs, TOKENIZER, keep=["doc_id", "lang", "source"], check=True, cached=CACHED)
    return found.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]

# the first stage's model and the fingerprints' hash are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        written = Staged(stage(spark, docs, sf_dir), f"stage-{name}")
        docs = written.df
        if before is not None:
            before.drop()
        before = written
    return docs
