"""A corpus pipeline of five stages, each a table of documents in and out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, mixing, packing, secrets
from tidemark.llm.common import materialise, table
from tidemark.llm.entry import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised. The model learns from the labelled rows."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.classify(docs.select(COLUMNS), model, "_").where("_accepted").select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds ``_row``, a number of its own for each row: the id, where no other row has it. Only
    rows of repeated and null ids are written down, so that their numbers hold."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = materialise(ids.where("n > 1 OR doc_id IS NULL").select("doc_id"), "shared-ids")
    top = docs.agg(F.max("doc_id")).first()[0]
    again = docs["doc_id"].eqNullSafe(shared["doc_id"])
    others = docs.join(shared, again, "left_semi").withColumn("_row", F.monotonically_increasing_id() + F.lit((-1 if top is None else top) + 1))
    return docs.join(shared, again, "left_anti").withColumn("_row", F.col("doc_id")).unionByName(materialise(others, "numbered"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents one row: of the smallest id, null after all others.

    Rows are told apart by a number, so rows that share an id or have none are grouped by their
    text as well. Rows without words link with nothing; of those that share an id one stays.
    """
    rows = _numbered(docs.select(COLUMNS))
    groups = jaccard.components(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    bare = F.col("n_shingles") == 0
    named = groups.join(rows.select("_row", "doc_id"), "_row").withColumn("_id", F.when(bare, F.col("doc_id")))
    group = ["_id", F.when(~bare | F.col("_id").isNull(), F.col("component_id"))]
    kept = named.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every finding by a mark; no document goes."""
    return secrets.redact(docs.select(COLUMNS), secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that each source comes to its target."""
    return mixing.apply_mix(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into training sequences; one row per piece."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("ngram_jaccard", drop_near_duplicates), ("secret_scans", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Training a model and tokenising can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
