"""Queries at the reference's default clusterer, against the plain greedy loop."""

from collections import Counter, defaultdict

import __spark_entry__
from claimloom.operators import terrain
from claimloom.plans import defaults, queries
from claimloom.sources import corpora
from test_operators import SF, blend, greedy


def test_grouped_queries_at_the_default_threshold(spark):
    rows = queries._topics(lambda t: corpora.read(spark, SF, t)).orderBy("topic_id", "topic_ord").collect()
    by, leader = {r.claim_uid: r for r in rows}, {}
    for t in sorted({r.topic_id for r in rows}):
        leader |= greedy([(r.claim_uid, set(r.token_set)) for r in rows if r.topic_id == t], blend, 0.20, False)
    groups = defaultdict(list)
    for r in rows:
        groups[leader[r.claim_uid]].append(r.claim_uid)
    topic = lambda g: by[g].topic_id
    single = {g for g, us in groups.items() if len({by[u].video_id for u in us}) == 1}
    got = {name: f(spark, SF).collect() for name, f in defaults.QUERIES.items()}
    assert set(got) <= set(__spark_entry__.queries())

    assert {(r.topic_id, r.claim_uids) for r in got["outliers_normalized"]} == {(topic(g), "|".join(groups[g])) for g in single}
    sizes, alone = Counter(map(topic, groups)), Counter(map(topic, single))
    assert {r.topic_id: (r.claim_group_count, r.repeated_claim_groups, r.claim_total) for r in got["topic_summary_normalized"]} == {t: (n, n - alone[t], sum(r.topic_id == t for r in rows)) for t, n in sizes.items()}
    parts = defaultdict(set)
    for r in got["group_detail_normalized"]:
        parts[r.topic_id, r.group_id].add(r.claim_uid)
    assert {frozenset(p) for p in parts.values()} == {frozenset(us) for us in groups.values()}

    number = {(r.topic_id, r.claim_uid): r.group_id for r in got["group_detail_normalized"]}
    axes = spark.createDataFrame([(g, sorted({by[u].support_role for u in us})) for g, us in groups.items()], "g string, roles array<string>")
    axis = {r.g: r.axis for r in axes.select("g", terrain.axis(axes["roles"]).alias("axis")).collect()}
    held, member = defaultdict(set), defaultdict(set)
    for g, us in groups.items():
        held[topic(g), axis[g]] |= {by[u].video_id for u in us}
        member[topic(g), axis[g]].add(number[topic(g), g])
    many = {k for k, v in held.items() if len(v) >= 2}
    assert {(r.topic_id, r.axis, r.member_claim_group_ids) for r in got["opinion_groups_normalized"]} == {(*k, "|".join(sorted(member[k]))) for k in many}
    want = {(t, f"opinion_group_skipped_single_source:{a}") for t, a in set(held) - many}
    want |= {(t, "opinion_group_builder_produced_no_groups") for t in sizes if not any(k[0] == t for k in many)}
    assert {(r.topic_id, r.warning) for r in got["opinion_warnings_normalized"]} == want
