"""Corpus pipeline: documents -> packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that ``run`` writes as Parquet in the
shared checkpoint folder and reads again as the next stage's ``docs``; a lost executor costs at most
the running stage.  All but the last return the columns of ``documents``.

1. ``language_id``: documents without a letter (``und``) go, and those whose text is like none of the learned
   languages (out-of-place distance over three quarters of the greatest possible).
2. ``line_dedup``: lines that at least 3 documents share go, but for the largest id; documents that are
   left without any text go.
3. ``minhash_near_dedup``: of each group of near duplicates (5-word shingles, similarity 0.8) the
   document of the smallest id stays.
4. ``benchmark_decontamination``: documents that hold a benchmark passage go.
5. ``packing``: token sequences of 4096.

``n_chars`` is kept in step with ``text``.  Rows that repeat an id stay or go together.  A row with a
null id passes the filters it cannot take part in (stages 3 and 4 judge by id) and is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.common import materialize
from quayline.llm.decontaminate import contaminated
from quayline.llm.language_id import recognised
from quayline.llm.line_dedup import drop_shared_lines
from quayline.llm.minhash_forest import near_duplicates
from quayline.llm.packing import pack_sequences


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recognised(docs, least=0.25)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = "_".join(["n_dropped", *docs.columns])
    kept = drop_shared_lines(docs, lines_col="n_" + dropped, dropped_col=dropped)
    kept = kept.where((F.col(dropped) == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    kept = docs.join(materialize(gone).hint("shuffle_hash"), "doc_id", "left_anti")
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = materialize(found.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(leaked.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Stages 1, 3, 4 and 5 are not expressible in SQL; tests/llm compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
