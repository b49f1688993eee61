"""Corpus pipeline: from raw documents to the tokens of a mixed corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and gives back the columns of docs; the
last one gives back tokens. Rows that a stage drops do not come back; the mix may list a row twice.
"""

from __future__ import annotations

import public_tokenizers

from stabilis.llm import bpe, exactdedup, mixing, simhash, toxicity
from stabilis.llm.common import checkpointed, table


def without_toxic(spark, docs, sf_dir):
    """Rows whose text the PU classifier, trained on the confirmed labels, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark, docs, sf_dir):
    """The row with the smallest doc_id of each normalised text."""
    return exactdedup.drop_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    """The row with the smallest doc_id of each group of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def mixed(spark, docs, sf_dir):
    """Rows as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokenised(spark, docs, sf_dir):
    """Per row: doc_id, n_tokens, digests of ids and decoded bytes, whether decoding gave the text back, and ids."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing to target weights", mixed),
    ("byte-level BPE", tokenised),
]

#: Trained classifiers, knapsack choices and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole documents table. Intermediate rows are kept in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
