"""A corpus pipeline of five stages, each reading what the one before wrote.

Quality rules drop the documents that fail; of each group of near duplicates
one stays; personal data is masked; sources are mixed to their targets; the
rest is packed into sequences.
"""

from __future__ import annotations

from docketlens.llm import jaccard, mixing, packing, pii, quality
from docketlens.llm.common import scratch, table
from docketlens.llm.tokenizing import vocabulary


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the policy."""
    return quality.kept_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """The smallest id of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def personal_data(spark, docs, sf_dir):
    """Documents with personal data and what reveals it masked."""
    return pii.sanitised_documents(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents and their place in sequences."""
    return packing.packed_digests(docs, vocabulary("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisation and hashed rounding have no SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
