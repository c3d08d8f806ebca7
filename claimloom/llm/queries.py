"""Queries of this subpackage over the driver's tables, each with its whole table and production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, knn, langid, licenses, neardup, packing, quality, secrets, urlfilter
from .session import read


def op1_chat_format(spark, sf_dir):
    return chat.formatted(read(spark, sf_dir, "conversations"))


def op2_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_simhash_neardup(spark, sf_dir):
    return neardup.groups(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op7_voronoi_knn(spark, sf_dir):
    return knn.neighbours(read(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % knn.ASKS == 0)


def op8_decontaminate(spark, sf_dir):
    return decontaminate.shared_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark, sf_dir):
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_url_filter(spark, sf_dir):
    return urlfilter.filtered(read(spark, sf_dir, "pages"))


_ALL = (
    op1_chat_format, op2_language_id, op3_license_scan, op4_simhash_neardup, op5_best_fit_packing,
    op6_secret_scan, op7_voronoi_knn, op8_decontaminate, op9_quality_classifier, op10_url_filter,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op7_voronoi_knn": knn.ORACLE, "op8_decontaminate": decontaminate.ORACLE}
