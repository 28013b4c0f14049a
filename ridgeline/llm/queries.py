"""Queries of the training-data operators (problems 4 to 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.bpe import encode_corpus
from ridgeline.llm.canonical import place_categories
from ridgeline.llm.leaks import leaked_items
from ridgeline.llm.lookalike import confusable_classes, confusable_pairs, named_records, one_form
from ridgeline.llm.neardup import same_rides
from ridgeline.llm.subjects import composition, subjects_of
from ridgeline.plans import Registry
from ridgeline.session import load

registry = Registry()


@registry.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_rides(load(spark, sf_dir, "library_routes"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_records(load(spark, sf_dir, "library_routes"), load(spark, sf_dir, "poi"))


@registry.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable_pairs(_names(spark, sf_dir))


@registry.query("p4_forms")
def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are not written in the form their look-alikes share."""
    return one_form(_names(spark, sf_dir).select("tbl", "text")).where("text <> form")


@registry.query("p4_classes")
def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable_classes(_names(spark, sf_dir))


@registry.query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"))


@registry.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_categories(load(spark, sf_dir, "poi"), load(spark, sf_dir, "poi_categories"))


@registry.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).where("kind = 'quoted'").select("doc_id", "item_id")


@registry.query("p8_reparameterised")
def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the template of a passage and other, consistent, slot values."""
    return leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).where("kind = 'reparameterised'").select("doc_id", "item_id")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of(*(load(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_examples")))


@registry.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


@registry.query("p9_composition")
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition(_subjects(spark, sf_dir))
