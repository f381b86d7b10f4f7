"""From raw documents to token ids in training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of `documents`, and each one's decisions take effect in what it returns:

1. language_id drops documents without an identifiable language;
2. near_duplicates keeps one document of each class of near copies;
3. secret_scan replaces secrets in the texts by a mask;
4. source_mix repeats, keeps or leaves out documents by their source's target, cuts
   the one on which a target falls, and puts all in training order;
5. byte_bpe returns the token ids of every text, and training_order: rows sorted by it
   are in training order.

Every stage takes an empty table and gives one, and ignores columns beyond those of
`documents`, whatever their names.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelight.llm import bpe, langid, mixing, neardup, secrets
from duelight.llm.tables import discard, materialise, read, with_file_order

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Below this score no language is identified.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows and bytes that go to a Python worker at once: it holds them several times over, and so does the JVM beside its heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

#: Environment of the Python workers: what they free goes back to the system, as they stay while later stages run in the JVM.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576"}


def by_small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to those of BATCH, lower ones stay; start its later Python workers with WORKERS, unless set otherwise."""
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, most in BATCH.items():
        number, unit = re.match(r"(-?\d+)\s*([kmgt]?)", spark.conf.get(name).strip().lower()).groups()
        if not 0 < int(number) * 1024 ** " kmgt".index(unit or " ") <= most:
            spark.conf.set(name, str(most))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is found.

    Null texts, empty ones and such without a letter go; so do all where no row has a
    label. Texts of any length are scored whole; of languages that fit equally well
    the first counts, and as their probability is then at most one half, more than two
    such languages lose the document. Repeated rows are each kept or dropped alike.
    """
    by_small_batches(spark)
    samples = langid.fit(docs)
    found = docs.select(*COLUMNS, langid.predict(spark, F.col("text"), samples).alias("_found"))
    return found.where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least id, null ids last.

    Null texts are copies of nothing and stay, empty ones are copies of each other; of
    repeated rows (same id and text) one stays; texts of any length are compared whole.
    """
    by_small_batches(spark)
    return neardup.keep_one(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each secret, or run of overlapping ones, replaced by a mask, and n_chars as it is then.

    No document goes. Null texts stay null (n_chars too), empty ones empty; texts of
    any length are scanned whole; repeated rows are each masked alike.
    """
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix takes them, a row per document and pass, sorted by training position.

    Null and wordless texts have no words to take and go; a null source is a source; a
    null id is placed like an empty one. Equal positions are sorted by id. Repeated
    rows count each. A document of any length is placed whole, but for the one on which
    its source's target falls, which keeps its first words.
    """
    size = mixing.word_count(F.col("text")).alias("size")
    rows = mixing.stream(docs.select(*COLUMNS, size), sizes=docs.select("source", size)).select("row.*", "words", "position")
    text = F.when(F.col("words") < F.col("size"), mixing.first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    rows = rows.orderBy("position", "doc_id").withColumn("text", text)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, training_order, n_tokens, token_ids, decoded_sha256 of every row of docs (a table of Parquet files).

    Null and empty texts have no tokens; texts of any length are encoded whole;
    repeated rows get the same ids and an order of their own.
    """
    by_small_batches(spark)
    docs = with_file_order(docs.select(*COLUMNS, "_metadata"), "training_order")
    return bpe.tokenised(spark, docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["training_order"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: SQL expresses neither the learned language model, sketches nor token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
