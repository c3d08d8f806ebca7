"""Queries over groups of claims at the reference's default clusterer (normalized, 0.20); their SQL is in folds.py."""

from __future__ import annotations

from ..operators import terrain, views
from ..sources import corpora
from .queries import _grouped, flat

QUERIES: dict = {}


def query(f, segments=corpora.topic_segments):
    def run(spark, sf_dir):
        rows = _grouped(lambda table: corpora.read(spark, sf_dir, table), "normalized", None, segments)
        return flat(f(rows, terrain.claim_groups(rows)))

    QUERIES[f.__name__] = run
    return run


def debate(f):
    return query(f, corpora.debate_segments)


@query
def outliers_normalized(rows, groups):
    return terrain.outliers(groups)


@query
def opinion_groups_normalized(rows, groups):
    return terrain.opinion_groups(groups)


@query
def opinion_warnings_normalized(rows, groups):
    return terrain.opinion_warnings(groups)


@query
def topic_summary_normalized(rows, groups):
    return views.topic_summary(rows, groups)


@query
def group_detail_normalized(rows, groups):
    return views.group_detail(groups, rows).drop("need_gates")


@debate
def disagreements_debated(rows, groups):
    return terrain.disagreements(groups)


@debate
def contradictions_debated(rows, groups):
    return terrain.contradictions(rows, groups)
