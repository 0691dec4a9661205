"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents with the rows, or the lines of text, that the stage keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, langid, line_dedup, mix_sources, near_dedup
from tessera.llm.shared import written
from tessera.session import table

#: A document stays if its language is told with at least this score; texts of no learned language's n-grams have 0.
LEAST_SCORE = 0.05
#: Words of a shingle and percent of similarity for near duplicates, percent for lines.
SHINGLE, SIMILAR, SIMILAR_LINES = 5, 80, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rank-order profiles: documents without a letter or without a known language go."""
    return langid.keep_known(spark, docs, langid.train(spark, docs), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set-similarity join of lines: later matches are taken out of text; documents that lose all their lines go."""
    return line_dedup.without_repeated_lines(spark, docs, SIMILAR_LINES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chosen-path join: of each group of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.one_of_each(spark, docs, SHINGLE, SIMILAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix arrays: documents with a verbatim benchmark passage go."""
    return decontaminate.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hierarchical budgets: doc_id, domain, lang, source, n_tokens, epoch and taken of the mixture."""
    return mix_sources.mix_report(spark, docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture)]
#: The chosen-path and suffix-array stages have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
