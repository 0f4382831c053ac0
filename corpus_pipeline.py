"""The training-data pipeline: language ID, quality rules, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. The
decisions of each stage take effect: documents that it rejects go, and the mix repeats rows. The last stage gives ids instead of texts.

Cases are those of the operators: null text has no language and goes in the first stage, as does empty text; very long texts are taken whole; of rows
that repeat doc_id and text one stays in the third stage, and of ties in a group that with the smallest doc_id, then text hash; an empty table passes
through all stages; columns beyond those of documents, clashing names too, are kept by all stages but the last.
"""

from pyspark.sql import DataFrame, SparkSession

from quarrykit.llm.bpe import ENCODE_FILE, encode_texts, vocabulary_path
from quarrykit.llm.common import materialize
from quarrykit.llm.langid import keep_known
from quarrykit.llm.mixing import mixed
from quarrykit.llm.ngram_join import keep_first
from quarrykit.llm.quality import keep_good
from quarrykit.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those far from all centroids and those without a letter go."""
    return keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted of lines that many texts of their host have; copies count once, as the next stage drops them."""
    return keep_good(docs, by_text=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of a likeness of 0.8 or more connect."""
    return keep_first(docs, size=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row."""
    return encode_texts(docs, vocabulary_path(ENCODE_FILE), keep_ids=True, pieces=TOKEN_PIECES)


#: Pieces that a worker's table of the last stage holds at most: the workers keep the memory of the stages before.
TOKEN_PIECES = 1 << 15
#: Bytes that an Arrow batch of a stage holds at most, rather than the default of 64 MB: texts go to Python workers, which keep their memory from stage to stage.
#: A stage is executed when its result is written, so the setting stays as long as the session has no lower one; run() puts the caller's value back.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = spark.conf.get(BATCH_SETTING, "64m").lower().rstrip("b")
        size = int(held.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(held[-1:], 0)
        if not 0 < size <= BATCH_BYTES:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(ship(spark), docs, sf_dir)

    return run


STAGES = [(f.__name__, _shipped(f)) for f in (language, quality, near_duplicates, mixture, tokens)]

#: SQL can express neither centroids nor merges; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = spark.conf.get(BATCH_SETTING, None)
    try:
        for _, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir))
    finally:
        if held is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, held)
    return docs
