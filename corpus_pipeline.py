"""From raw documents to token ids, in five stages; each is one operator of ``foretell.llm`` over all that the one before kept.

1. Quality rules: documents that the rules reject go.
2. Near-duplicates (five-word shingles, Jaccard similarity 0.8; SimHash links first, an exact filter for the rest): of each
   group the document with the least id stays.
3. Personal data: validated numbers, dates and addresses become pseudonyms of the same format.
4. Mixing: documents are taken as often as their source's target weight asks, dealt to shards and shuffled.
5. SentencePiece: the ids of each row that the mix takes.

Each stage's rows are written as Parquet in the shared folder and read again for the next, so a lost executor costs work
of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.llm._common import kept, remove, scope
from foretell.llm.mixing import mix_documents
from foretell.llm.near_copies import keep_one
from foretell.llm.pii import pseudonymise
from foretell.llm.quality import keep_good
from foretell.llm.queries import tokenizer_path
from foretell.llm.unigram import encoded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a pseudonym can be a little shorter or longer than its value (addresses, dates without leading zeros)
    return pseudonymise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: SQL can express neither the compression bands nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark):  # what a stage is read from goes when its rows are written
            out = kept(stage(spark, docs, sf_dir), f"stage-{k}")
        remove(spark, docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
