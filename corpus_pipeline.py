"""The corpus pipeline: documents in, token ids' digests out. Counted as part of the subpackage llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents (and any others that came with them). Line
dedup returns one more, the text as it was: near duplicates decides on it first, as copies have little text left, and drops it;
then it decides on what line dedup has left, so texts that are alike but for repeated passages are found too.
A document is known by its id and its text, so null and repeated ids decide nothing about other texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayroll.llm.common import forget, free_names, release_shuffles, table, written
from dayroll.llm.decontaminate import decontaminate
from dayroll.llm.line_dedup import remove_repeated_lines
from dayroll.llm.pieces import encode_pieces
from dayroll.llm.similarity import one_of_each
from dayroll.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (10) rejects go; null and empty texts are scored like others."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def whole_column(docs: DataFrame) -> str | None:
    """The column in which line dedup keeps whole texts: of those named so that with most underscores, as it is named beside all others."""
    return max((c for c in docs.columns if c.lower().lstrip("_") == "whole_text" and c.startswith("_")), key=len, default=None)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first (2); no document goes. n_chars follows the text."""
    cleaned = remove_repeated_lines(docs, whole=free_names(docs, "whole_text")[0]).drop("n_lines", "removed_lines")
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays (1): that of the least id. Where line dedup came before, texts as they were
    before it decide, and among what stays the texts that it has left. Of those without words all stay; those that line dedup has left without words go."""
    whole = whole_column(docs)
    if whole is None:
        return one_of_each(docs)
    has_words = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    by_whole = written(one_of_each(docs, text_col=whole).where(has_words("text") | ~has_words(whole)).drop(whole), "by-whole-texts")
    release_shuffles(spark)
    return one_of_each(by_whole)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go (9)."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text (5)."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("pieces", pieces)]

#: SQL cannot express the trained network, the chunks or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote is deleted once the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
