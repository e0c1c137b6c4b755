"""A corpus pipeline over ``documents``: each stage reads what the one before kept.

quality -> near duplicates -> decontamination -> pseudonyms -> packing. All stages but the last return
the columns of documents; the last returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, ngram_join, packing, pii, quality
from tessera.llm.queries import pseudonym_key, vocabulary
from tessera.storage import discard, load, materialise, stage_tables


MOST_BROADCAST = 2_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the group's smallest id.

    Documents without words link with nothing and stay. Of those that share the smallest id of a group the one
    whose text has the least hash stays, of equal ones any, so what stays depends on neither the order of the
    rows nor their partitions. Null ids come first. A group with most rows is reduced before it is shuffled.
    """
    # as a struct the columns can't clash with the number, which tells rows of one id apart
    numbered = materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("hash")), "pipeline-numbered")
    found = ngram_join.near_duplicates(numbered, id_col="row", text_col="doc.text")
    linked = materialise(found.where(F.col("row") != F.col("component_id")).select("row", F.col("component_id").alias("group")), "pipeline-linked", few=True)
    members = linked.unionByName(linked.select(F.col("group").alias("row"), "group").distinct())
    few = linked.count() <= MOST_BROADCAST  # 16 bytes each; beyond that rows are shuffled
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    known = numbered.select("row", "doc.doc_id", "hash").join(small(members), "row")
    best = known.groupBy("group").agg(F.min(F.struct("doc_id", "hash", "row")).alias("best")).select("best.row")
    gone = materialise(members.select("row").join(best, "row", "left_anti"), "pipeline-gone", few=True)
    return numbered.join(small(gone), "row", "left_anti").select("doc.*")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    index = decontam.build_index(load(spark, sf_dir, "benchmark"))
    return docs.where(~decontam.is_contaminated(docs, index))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the new text."""
    out = pii.pseudonymise(docs, pseudonym_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequences they go to."""
    return packing.pack(docs, vocabulary())


def _cleaning(name, stage):
    """The stage; what stages before it wrote for themselves is deleted once it starts."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(docs, name):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, _cleaning(name, stage))
    for name, stage in (
        ("quality", keep_quality),
        ("near_duplicates", keep_one_of_near_duplicates),
        ("decontamination", keep_uncontaminated),
        ("pii", pseudonyms),
        ("packing", pack),
    )
]

# Word shingles with set joins, latent retrieval and a keyed SHA-256 network have no usable SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs = kept
    name, stage = STAGES[-1]
    pieces = stage(spark, docs, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
