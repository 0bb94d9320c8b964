"""Training-corpus pipeline: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
to the shared checkpoint folder and hands what it reads back to the next one.
All stages but the last return the columns of documents, whatever further columns
these have; a column named size, shard or slot is replaced by the last.  Null and empty
texts, repeated rows, ties and empty tables fare as the operators' docstrings say:
no rows give no rows, rows without doc_id are never taken for copies.
"""

from tracefold.llm.decontaminate import drop_leaks
from tracefold.llm.minhash import keep_one_of_each
from tracefold.llm.mixing import mix_sources
from tracefold.llm.quality import fit_grades, ratings_from_labels, select_documents
from tracefold.llm.registry import read
from tracefold.llm.sharding import assign_shards
from tracefold.sources.scratch import materialize

SHARDS = 8
#: The quality model and hashed draws have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents whose chance of the best grade is at least even; rejects poor and toxic ones."""
    return select_documents(docs, fit_grades(docs, ratings_from_labels(read(spark, sf_dir, "labels"))))


def near_duplicates(spark, docs, sf_dir):
    """The first document of each group linked by five-word shingles, 80 % alike or more."""
    return keep_one_of_each(docs, width=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark, docs, sf_dir):
    """Documents repeated so that sources near the square roots of their sizes, in random order."""
    return mix_sources(docs, added=False)


def shards(spark, docs, sf_dir):
    """Documents with size, shard and slot."""
    return assign_shards(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
