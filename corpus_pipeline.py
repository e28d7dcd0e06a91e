"""From documents to token digests: quality, near copies, personal data, mix, encoding.

Each stage takes what the one before kept, written as Parquet and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import read_table
from tallyloom.llm.mixing import mixed_documents
from tallyloom.llm.pieces import token_digests
from tallyloom.llm.pii import mask_personal_data
from tallyloom.llm.quality import keep_good
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.simjoin import one_of_each
from tallyloom.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew."""
    return mask_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document in the mix."""
    return token_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]

# The quality scorer and the tagger are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    *earlier, (_, last) = STAGES
    for name, stage in earlier:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
