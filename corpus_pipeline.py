"""A corpus pipeline of the training-data operators: each stage works on what the stage before kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of ``documents``, and further ones that ``docs`` has. No stage changes the order or number
of equal rows but by its decisions; an empty table stays empty; very long texts are worked on whole.
"""

from __future__ import annotations

from graphloom.llm import decontam, jaccard, linededup, nbest, ranker
from graphloom.llm.common import discard, documents, materialise


def quality(spark, docs, sf_dir):
    """Documents that the pairwise ranker predicts to be bad go; empty and null texts are judged like any other."""
    return ranker.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark, docs, sf_dir):
    """Lines that an earlier document holds are dropped; a document that loses all of them stays, with an empty text.
    Rows without a doc_id keep their lines."""
    return linededup.drop_repeats(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of similar ones stays, that of the smallest doc_id with all its rows. Texts without
    words are similar to nothing, and stay; so do rows without a doc_id that nothing stands for."""
    return jaccard.keep_first(docs)


def benchmark(spark, docs, sf_dir):
    """Passages of the benchmark are cut out; documents that are mostly such passages go. An empty benchmark cuts nothing."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark, docs, sf_dir):
    """Each text as piece ids, with the costs of the N best segmentations; a null text has no ids."""
    return nbest.encode(docs, nbest.N_BEST).select("doc_id", "lang", "source", "ids", "costs")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("pieces", pieces),
]
#: A learnt classifier and the piece lattice have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:  # what a stage has read is not read again
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
