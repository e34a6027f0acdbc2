"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents; all but the last keep the columns of documents.
run() applies them in order, each over what the one before kept, written as Parquet in the shared checkpoint
folder and read again.

1. toxicity: documents whose score reaches their language's threshold go.
2. near_copies: of each group of similar documents (five-word shingles, 0.8 or more) the least id stays.
3. repeated_strings: passages of over 50 words, or of 400 bytes, go where they stand again (the first stays); texts that
   lose all go.
4. benchmark: documents that hold a passage of the benchmark go.
5. mix: sources are brought to their weights; a document stands as often as it is taken.

Cases: columns of any name are kept as they are, also those named like ones used inside (the last stage adds `copy`, or
`copy_` where there is one); null texts, ids and sources, repeated rows and empty tables are treated as each
operator's docstring says; no documents, labels or benchmark items give what the other stages leave.

SQL can't express the first three (a trained model, components, suffix arrays), so there is no ORACLE_SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksieve.llm import bytedup, decontam, mixing, simhash, toxicity
from sparksieve.llm.common import ensure_checkpoint_dir, fresh, remove, table, word_count


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled rows but those whose id's crc32 is 2 modulo 4, which stay for measuring."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.remainder(F.col("label_id"), 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.rows.filter(~F.col(scored.rejected)).select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def repeated_strings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """51 words have 101 bytes at least, with a byte between them."""
    return bytedup.without_repeats(docs, 101, 50)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, once for each time (copy: 1, 2, ...).  Texts without words add nothing and go."""
    size, times, copy = fresh(docs, "size", "times", "copy")
    sized = docs.withColumn(size, word_count(F.col("text"))).filter(F.col(size) > 0)
    taken = mixing.with_times(sized, size, times).filter(F.col(times) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(copy))


STAGES = [("toxicity", toxicity_stage), ("near_copies", near_copies_stage), ("repeated_strings", repeated_strings_stage), ("benchmark", benchmark_stage), ("mix", mix_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix made of the documents in sf_dir.  The last stage's files stay, for the result reads them."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # nothing reads it any more
        before = path
    return docs
