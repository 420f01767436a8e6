"""Corpus pipeline: language, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of ``documents``, whatever else they are called.

In every stage rows with one text fare alike but for copies and passages, of which the earliest
stays (by doc_id, null first); a null doc_id is allowed, very long texts are
read whole, and an empty table gives an empty table. Null and empty texts, and those without a letter, go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphaudit.llm import jaccard, language, packing, suffixes, toxicity
from glyphaudit.llm.common import Scratch
from glyphaudit.llm.queries import table, vocabulary

#: A document goes if no language has at least this share of its bytes' probability.
LEAST_LANGUAGE = 0.35
#: A document goes from this score on.
TOXIC = 0.5

#: The stages learn and compare by hashes and trained models, which SQL can't express.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (f"_{name}{k}" for k in range(len(taken) + 1)) if n not in taken)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those in no learned language."""
    found, score = _free(docs, "language"), _free(docs, "share")
    out = language.predicted(docs, language.train(docs), (found, score))
    return out.where((F.col(found) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).drop(found, score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "toxicity")
    return toxicity.scored(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that occur earlier; n_chars follows the text."""
    out = suffixes.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.digest(packing.pack(docs, vocabulary()))


STAGES = [("language", language_stage), ("toxicity", toxicity_stage), ("near_copies", near_copy_stage), ("passages", passage_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
