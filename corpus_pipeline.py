"""The corpus pipeline: toxicity, near documents, benchmark leaks, personal data, source mix.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run()
writes each stage's result to the shared folder and reads it for the next one. All stages but the
last return the columns of documents, whatever further columns they have and however those are
called. Null and empty texts are kept by every stage, rows with a null doc_id too; repeated rows are
judged alike, and become one among the near documents. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import decontaminate, jaccard, mixing, pii, toxicity
from quotelens.llm.common import cut, drop, fresh, quoted, scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold."""
    net, name = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    scored = toxicity.score(docs, net, docs.columns, name)
    return scored.filter(F.col(name) < toxicity.AT).select(*map(quoted, docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near documents: of those with its least doc_id, the one of the shortest
    text. Rows with a null doc_id stay. Rows that share a doc_id but are not near each other are
    told apart by their texts."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window occurs."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in brackets and n_chars counted anew."""
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(counted))
    return clean.select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of copies of each row, and the words that they are."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near documents", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
]

#: Learned models and iterative steps have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage has written for itself, and the result
    that it has read, is deleted once its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scope():
            made = stage(spark, before, sf_dir)
            path = cut(made, stays=True)
        drop(before)
        docs = path
    return STAGES[-1][1](spark, docs, sf_dir)
