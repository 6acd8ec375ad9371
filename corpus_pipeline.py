"""A training corpus in five stages; counts as part of the corpus subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``. Stages tell rows apart by id and content, so rows that share an id or have
none are documents of their own; further columns pass, whatever their names. A stage
over no rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import bpe_tree, jaccard, langid, mixing, pii
from tarnflow.llm.common import apart, discard, materialize, table, unused, without

#: Mean probability of the predicted language below which a text has no recognisable language.
LEAST_SCORE = 0.4
#: Words of a shingle and similarity in hundredths from which documents are near copies.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def _content(docs: DataFrame) -> Column:
    """A digest of all columns of a row; nulls count."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters (null and empty ones too) and those in which no language is recognised."""
    best, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    found = langid.identify(docs, keep=tuple(docs.columns), pred_col=best, score_col=score)
    return found.where((F.col(best) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id.

    Near copies share 80 % of their shingles of five words. Rows that share an id are told
    apart by a digest of their columns, equal rows stay once. Rows without an id or
    without words stay.
    """
    key, least = unused("_row", docs.columns), unused("_least", docs.columns)
    rows = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", _content(docs).alias("digest"))))
    groups = jaccard.jaccard_components(rows, key, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    ids = materialize(groups.select(F.col("doc_id").alias(key), F.col("component_id").alias(least)), "pipeline-groups")
    gone = materialize(ids.where(F.col(key) != F.col(least)).select(key).distinct(), "pipeline-gone")
    kept, _ = without(rows, key, gone)
    twice = materialize(ids.where(F.col(key) == F.col(least)).groupBy(key).agg(F.count("*").alias(least)).where(F.col(least) > 1).select(key), "pipeline-twice")
    discard(ids)
    if not twice.isEmpty():
        alone, alike = apart(kept, key, twice)
        kept = alone.unionByName(alike.dropDuplicates([key]))
    return kept.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; texts without any, null ones too, stay as they are."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets.

    Each row is taken as often as its own plan says. Equal rows share theirs: they are
    taken once, as often as all of them together. Texts without words have no size and are left out
    only where their source is. The plan is one cut per source, so texts are not shuffled.
    """
    key, draw, cut, nth = (unused(c, docs.columns) for c in ("_row", "_draw", "_cut", "_nth"))
    keyed = docs.withColumn(key, _content(docs))
    cuts = materialize(mixing.cuts_of(mixing.planned(keyed, id_col=key)), "pipeline-cuts").select(F.struct("*").alias(cut))
    drawn = keyed.withColumn(draw, mixing.draw_of(F.col(key), F.col("text"))).join(cuts, F.col("source").eqNullSafe(F.col(f"{cut}.source")))
    place, last = F.struct(F.col(draw).alias("draw"), F.col(key).alias("doc_id")), F.col(f"{cut}.last")
    # Equal rows on both sides of a cut: what they are taken together goes to one of them.
    split = F.coalesce((place == last) & F.col(f"{cut}.split").isNotNull(), F.lit(False))
    times = F.when(place <= last, F.col(f"{cut}.most")).otherwise(F.col(f"{cut}.fewest"))
    taken = drawn.where(~split).withColumn(nth, F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    if not cuts.where(F.col(f"{cut}.split").isNotNull()).isEmpty():
        shared = drawn.where(split).dropDuplicates([key])
        taken = taken.unionByName(shared.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(f"{cut}.split").cast("int")))))
    return taken.select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return bpe_tree.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("pii", personal_data),
    ("mix_sources", mix_sources),
    ("bpe", bpe),
]

#: Training, expectation maximisation and near copies are beyond SQL; tests hold each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
