"""SQL of what folds in order: greedy clusters at their default thresholds, what follows from them, and sentence assembly.

A recursive query walks along the order of each topic, or of each video's cues, and carries the state of the fold in a row.
"""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import assembly, cluster, similarity, terrain
from ..sources import corpora
from .oracle import _COORD, _LISTED, _PAIRS, LINES, SEEDED, SEG, SPACE, TOPICS, any_, joined, label, lst, squeeze

DEBATES = TOPICS.replace(SEEDED, f"seeded AS (SELECT conv_id, turn, role, ({lst(corpora.DEBATES)})[(conv_id * 5 + turn * 2) % {len(corpora.DEBATES)} + 1] AS text FROM conversations)")
_SCORE = {
    "normalized": "round(shared_n / (an + bn - shared_n) * 0.55::DOUBLE + shared_n / greatest(1, least(an, bn)) * 0.45::DOUBLE, 4)",
    "token_jaccard": "shared_n / (an + bn - shared_n)",
}


def clusters(topics: str, method: str) -> str:
    """`rec` of the topics, `sc` (all scored pairs), and `cl`: topic_id, claim_uid, topic_ord, cluster."""
    leaders = method == "token_jaccard"
    empty = ""
    if leaders:  # claims without tokens are all alike
        empty = " UNION ALL SELECT a.topic_id, a.claim_uid, b.claim_uid, 1.0 FROM rec a JOIN rec b ON a.topic_id = b.topic_id AND a.topic_ord < b.topic_ord WHERE len(a.token_set) = 0 AND len(b.token_set) = 0"
    choice = "list_sort(list_transform(list_filter(n.near, lambda x: {ok}), lambda x: {{'s': -x.s, 'c': w.held[x.i]}}))[1].c".format(ok="w.held[x.i] = x.i" if leaders else "true")
    return f"""{topics}, {_PAIRS},
sc AS MATERIALIZED (SELECT topic_id, a, b, {_SCORE[method]} AS score FROM pr{empty}),
nth AS MATERIALIZED (SELECT topic_id, claim_uid, topic_ord, row_number() OVER (PARTITION BY topic_id ORDER BY topic_ord) AS i FROM rec),
near AS MATERIALIZED (SELECT n.topic_id, n.i, n.claim_uid, list({{'i': m.i, 's': s.score}}) FILTER (m.i IS NOT NULL) AS near FROM nth n
  LEFT JOIN sc s ON s.topic_id = n.topic_id AND s.b = n.claim_uid AND s.score >= {cluster.THRESHOLDS[method]} LEFT JOIN nth m ON m.topic_id = s.topic_id AND m.claim_uid = s.a GROUP BY 1, 2, 3),
walk AS (SELECT DISTINCT topic_id, 0::BIGINT AS i, []::BIGINT[] AS held FROM rec
  UNION ALL SELECT w.topic_id, n.i, list_append(w.held, coalesce({choice}, n.i)) FROM walk w JOIN near n ON n.topic_id = w.topic_id AND n.i = w.i + 1),
last AS (SELECT topic_id, arg_max(held, i) AS held FROM walk GROUP BY 1),
cl AS MATERIALIZED (SELECT n.topic_id, n.claim_uid, n.topic_ord, o.claim_uid AS cluster, o.topic_ord AS opened FROM nth n JOIN last l USING (topic_id) JOIN nth o ON o.topic_id = n.topic_id AND o.i = l.held[n.i])"""


def groups(topics: str) -> str:
    """`grp`, `mem` and `bucket` at the default clusterer."""
    return f"""{clusters(topics, "normalized")},
mem AS MATERIALIZED (SELECT rec.*, cluster, opened FROM rec JOIN cl USING (topic_id, claim_uid)),
tn AS (SELECT topic_id, cluster, t, count(*) AS n FROM (SELECT topic_id, cluster, unnest(token_set) AS t FROM mem) GROUP BY 1, 2, 3),
gk AS (SELECT topic_id, cluster, 'topic_' || array_to_string(list(t ORDER BY n DESC, t)[1:4], '_') AS claim_group_key FROM tn GROUP BY 1, 2),
ms AS (SELECT topic_id, cluster, count(*) AS n FROM mem GROUP BY 1, 2),
st AS (SELECT topic_id, cluster, t, count(DISTINCT claim_uid) AS n FROM (SELECT topic_id, cluster, claim_uid, unnest(tokens) AS t FROM mem) GROUP BY 1, 2, 3),
sh AS (SELECT topic_id, cluster, list(t ORDER BY t) AS toks FROM st JOIN ms USING (topic_id, cluster) WHERE st.n = ms.n GROUP BY 1, 2),
gs AS (SELECT x.topic_id, x.cluster, sum(score) AS total FROM sc JOIN cl x ON x.topic_id = sc.topic_id AND x.claim_uid = sc.a JOIN cl y ON y.topic_id = sc.topic_id AND y.claim_uid = sc.b WHERE x.cluster = y.cluster GROUP BY 1, 2),
g0 AS (SELECT topic_id, cluster, opened, list_sort(list_distinct(list(video_id))) AS video_ids, count(*) AS claim_count, list_sort(list_distinct(list(stance))) AS stances, list_sort(list_distinct(list(support_role))) AS support_roles,
  list(claim_uid ORDER BY topic_ord) AS claim_uids, list_sort(list_distinct(list(evidence_id))) AS evidence_ids, count(DISTINCT coalesce(speaker, 'unknown-speaker')) AS speaker_count, bool_or(external_verification = 'needed') AS external FROM mem GROUP BY 1, 2, 3),
grp AS MATERIALIZED (SELECT g0.*, coalesce(claim_group_key, 'generic_claim') AS claim_group_key, coalesce(toks, []::VARCHAR[]) AS toks, CASE WHEN claim_count < 2 THEN 1.0 ELSE round(coalesce(total, 0) / (claim_count * (claim_count - 1) / 2), 4) END AS grouping_score,
  len(video_ids) AS video_count, len(video_ids) >= 2 AS repeated_claim, len(video_ids) = 1 AS outlier_claim,
  list_contains(stances, '{terrain.PROMOTES}') AND (list_contains(stances, '{terrain.DOUBTS}') OR list_contains(stances, '{terrain.SUPPOSES}')) AS disagreement_point,
  'G' || lpad((row_number() OVER (PARTITION BY topic_id ORDER BY coalesce(claim_group_key, 'generic_claim'), opened))::VARCHAR, 4, '0') AS group_id,
  CASE WHEN list_contains(support_roles, 'supporting_or_promotional') THEN 'supporting' WHEN list_contains(support_roles, 'challenging_or_limiting') THEN 'challenging' WHEN list_contains(support_roles, 'alternative_explanation') THEN 'alternative' ELSE 'reported' END AS axis
  FROM g0 LEFT JOIN gk USING (topic_id, cluster) LEFT JOIN sh USING (topic_id, cluster) LEFT JOIN gs USING (topic_id, cluster)),
bucket AS (SELECT topic_id, axis, list_position({lst(terrain.AXES)}, axis) AS pos, list(group_id ORDER BY group_id) AS ids, list_sort(list_distinct(flatten(list(video_ids)))) AS vids, list(claim_uids[1] ORDER BY group_id) AS reps, bool_or(disagreement_point) AS dis FROM grp GROUP BY 1, 2)"""


def final(t: str) -> str:
    """Whether a cue without white space at its end closes a sentence."""
    word = f"rtrim(regexp_extract({t}, '([^' || '{SPACE[1:-1]}' || ']+)$', 1), {lx.quoted(tx.CLOSERS)})"
    tail = lambda name: f"len(list_filter({lst(lx.markers('ending', name))}, lambda m: ends_with({word}, m))) > 0"
    return f"({t} <> '' AND (contains({lx.quoted(tx.TERMINAL)}, right({t}, 1)) OR {tail('strong')} OR {tail('polite')} OR ends_with({word}, '다') AND NOT {tail('not_final')}))"


def units(cues: str) -> str:
    """`unit` (video_id, unit_ord, text, s, e, cues) from a relation of cues (video_id, cue_ord, text, s, e)."""
    return f"""cue0 AS (SELECT video_id, cue_ord, {squeeze("coalesce(text, '')")} AS text, s, e FROM {cues}),
cue AS MATERIALIZED (SELECT *, {final("text")} AS final, row_number() OVER (PARTITION BY video_id ORDER BY cue_ord) AS k FROM cue0 WHERE text <> ''),
walk AS (SELECT DISTINCT video_id, 0::BIGINT AS k, -1::BIGINT AS unit_ord, '' AS text, NULL::DOUBLE AS s, NULL::DOUBLE AS e, []::BIGINT[] AS cues, 0::BIGINT AS chars, true AS closed FROM cue
  UNION ALL SELECT video_id, k, unit_ord, text, s, e, cues, chars, final OR chars >= {assembly.MAX_CHARS} OR coalesce(cue_e - s >= {assembly.MAX_SPAN}, false) FROM (
    SELECT c.video_id, c.k, CASE WHEN w.closed THEN w.unit_ord + 1 ELSE w.unit_ord END AS unit_ord, CASE WHEN w.closed THEN c.text ELSE w.text || ' ' || c.text END AS text, CASE WHEN w.closed THEN c.s ELSE coalesce(w.s, c.s) END AS s, coalesce(c.e, CASE WHEN NOT w.closed THEN w.e END) AS e,
      CASE WHEN w.closed THEN [c.cue_ord::BIGINT] ELSE list_append(w.cues, c.cue_ord::BIGINT) END AS cues, CASE WHEN w.closed THEN length(c.text) ELSE w.chars + length(c.text) + 1 END AS chars, c.final, c.e AS cue_e
    FROM walk w JOIN cue c ON c.video_id = w.video_id AND c.k = w.k + 1)),
unit AS (SELECT DISTINCT ON (video_id, unit_ord) * FROM walk WHERE k > 0 ORDER BY video_id, unit_ord, k DESC)"""


_DEFAULT, _DEBATE = (f"WITH RECURSIVE {groups(t)}" for t in (TOPICS, DEBATES))
_ASSERTS, _LIMITS = (lambda t, n=n: any_(f"lower({t})", lx.markers(n)) for n in ("assertive", "limit"))
_DOUBTING = lst(("caution_or_counterpoint", "hypothesis_or_alternative"))
_OPPOSED = f"CASE WHEN score < 0.22 THEN 0.0 WHEN ({_ASSERTS('x.text')} AND {_LIMITS('y.text')}) OR ({_ASSERTS('y.text')} AND {_LIMITS('x.text')}) THEN 0.8 WHEN x.stance <> y.stance AND (list_contains({_DOUBTING}, x.stance) OR list_contains({_DOUBTING}, y.stance)) THEN 0.45 ELSE 0.0 END"


ORACLES = {
    "clusters_normalized": f"WITH RECURSIVE {clusters(TOPICS, 'normalized')} SELECT topic_id, claim_uid, topic_ord, cluster FROM cl",
    "clusters_token_jaccard": f"WITH RECURSIVE {clusters(TOPICS, 'token_jaccard')} SELECT topic_id, claim_uid, topic_ord, cluster FROM cl",
    "claim_groups_normalized": f"{_DEFAULT}, l AS (SELECT *, {label('claim_group_key')} AS label FROM grp) SELECT topic_id, {_LISTED('video_ids', 'stances', 'support_roles', 'claim_uids', 'evidence_ids')}, claim_count, claim_uids[1] AS representative_claim_uid, speaker_count, claim_group_key, grouping_score, group_id, label, video_count, repeated_claim, outlier_claim, disagreement_point, CASE WHEN claim_count >= 2 THEN array_to_string(toks[1:8], '|') ELSE '' END AS shared_tokens, label || ': ' || claim_count || ' claim(s) across ' || video_count || ' video(s).' AS summary, CASE WHEN grouping_score >= 0.62 AND repeated_claim THEN 'high' WHEN repeated_claim OR grouping_score >= 0.20 THEN 'medium' ELSE 'low' END AS grouping_confidence, disagreement_point OR outlier_claim AS human_review_required, axis FROM l",
    "outliers_normalized": f"{_DEFAULT} SELECT topic_id, group_id AS claim_group_id, 'single_source_outlier' AS outlier_type, {_LISTED('claim_uids')}, CASE WHEN external THEN 'medium' ELSE 'low' END AS followup_priority FROM grp WHERE outlier_claim",
    "opinion_groups_normalized": f"{_DEFAULT} SELECT topic_id, 'OG' || lpad((row_number() OVER (PARTITION BY topic_id ORDER BY pos))::VARCHAR, 4, '0') AS opinion_group_id, axis, ({lst(terrain.AXIS_LABEL)})[pos] AS label, {joined('ids')} AS member_claim_group_ids, {joined('vids')} AS source_video_ids, {joined('reps')} AS distinguishing_claims, dis AS contains_disagreement_point, 'medium' AS confidence, 'not_evaluated' AS truth_status FROM bucket WHERE len(vids) >= 2",
    "opinion_warnings_normalized": f"{_DEFAULT} SELECT topic_id, 'opinion_group_skipped_single_source:' || axis AS warning FROM bucket WHERE len(vids) < 2 UNION ALL SELECT topic_id, 'opinion_group_builder_produced_no_groups' FROM bucket GROUP BY topic_id HAVING bool_and(len(vids) < 2)",
    "topic_summary_normalized": f"{_DEFAULT}, s AS (SELECT topic_id, count(DISTINCT video_id) AS video_record_count, count(*) AS claim_total FROM rec GROUP BY 1), k AS (SELECT topic_id, count(*) AS claim_group_count, count(*) FILTER (repeated_claim) AS repeated_claim_groups, count(*) FILTER (disagreement_point) AS disagreement_groups, count(*) FILTER (outlier_claim) AS outlier_groups FROM grp GROUP BY 1) SELECT *, 'not_evaluated' AS truth_status, 'not_performed' AS fact_check_status FROM s JOIN k USING (topic_id)",
    "group_detail_normalized": f"{_DEFAULT} SELECT topic_id, group_id, claim_uid, video_id, time_ref, secs AS timestamp_start, speaker, confidence, 'caption' AS modality, evidence_id, {_COORD} AS coordinate, text FROM grp JOIN mem USING (topic_id, cluster)",
    "disagreements": f"{_DEFAULT} SELECT topic_id, 'D' || group_id[2:] AS relation_id, group_id AS claim_group_id, CASE WHEN list_contains(stances, '{terrain.SUPPOSES}') AND NOT list_contains(stances, '{terrain.DOUBTS}') THEN 'alternative_explanation' ELSE 'support_vs_caution' END AS relation_type, {_LISTED('claim_uids')}, CASE WHEN claim_count >= 2 THEN 'medium' ELSE 'low' END AS confidence, true AS human_review_required FROM grp WHERE disagreement_point",
    "contradictions": f"{_DEFAULT}, o AS (SELECT x.topic_id, x.cluster, sc.a AS left_claim_uid, sc.b AS right_claim_uid, {_OPPOSED} AS opposition_score FROM sc JOIN mem x ON x.topic_id = sc.topic_id AND x.claim_uid = sc.a JOIN mem y ON y.topic_id = sc.topic_id AND y.claim_uid = sc.b WHERE x.cluster = y.cluster) SELECT topic_id, group_id AS claim_group_id, left_claim_uid, right_claim_uid, opposition_score::DOUBLE AS opposition_score FROM o JOIN grp USING (topic_id, cluster) WHERE opposition_score >= 0.45",
    "disagreements_debated": f"{_DEBATE} SELECT topic_id, 'D' || group_id[2:] AS relation_id, group_id AS claim_group_id, CASE WHEN list_contains(stances, '{terrain.SUPPOSES}') AND NOT list_contains(stances, '{terrain.DOUBTS}') THEN 'alternative_explanation' ELSE 'support_vs_caution' END AS relation_type, {_LISTED('claim_uids')}, CASE WHEN claim_count >= 2 THEN 'medium' ELSE 'low' END AS confidence, true AS human_review_required FROM grp WHERE disagreement_point",
    "contradictions_debated": f"{_DEBATE}, o AS (SELECT x.topic_id, x.cluster, sc.a AS left_claim_uid, sc.b AS right_claim_uid, {_OPPOSED} AS opposition_score FROM sc JOIN mem x ON x.topic_id = sc.topic_id AND x.claim_uid = sc.a JOIN mem y ON y.topic_id = sc.topic_id AND y.claim_uid = sc.b WHERE x.cluster = y.cluster) SELECT topic_id, group_id AS claim_group_id, left_claim_uid, right_claim_uid, opposition_score::DOUBLE AS opposition_score FROM o JOIN grp USING (topic_id, cluster) WHERE opposition_score >= 0.45",
    "assembled_sentences": f"WITH RECURSIVE {LINES}, tcue AS (SELECT video_id, seg_ord AS cue_ord, text, seg_ord * 4.0::DOUBLE AS s, seg_ord * 4.0::DOUBLE + 3 AS e FROM line), {units('tcue')} SELECT video_id, unit_ord, text, s AS start, e AS \"end\", array_to_string(cues, '|') AS cue_indices, len(cues) AS cue_count, greatest(0.0::DOUBLE, e - s) AS span_seconds, len(cues) > 1 AS is_merged FROM unit",
    "segment_sentences": f"WITH RECURSIVE {SEG}, tcue AS (SELECT video_id, seg_ord AS cue_ord, text, seg_ord * 6.0::DOUBLE AS s, seg_ord * 6.0::DOUBLE AS e FROM seg), {units('tcue')}, of AS (SELECT u.video_id, u.unit_ord, u.text, unnest(cues) AS cue_ord FROM unit u) SELECT of.video_id, unit_ord AS seg_ord, of.text, arg_min(speaker, cue_ord) AS speaker, arg_min(time_ref, cue_ord) AS time_ref, 'transcript' AS source_hint, 'transcript' AS modality_source, string_agg(time_ref, '|' ORDER BY cue_ord) AS source_time_refs FROM of JOIN seg ON seg.video_id = of.video_id AND seg.seg_ord = of.cue_ord GROUP BY 1, 2, 3",
}
