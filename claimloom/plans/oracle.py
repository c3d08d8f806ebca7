"""The queries again as SQL for DuckDB, from the same lexicons and seeds."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import claims as cl
from ..operators import gates, similarity, summary, terrain, worth
from ..sources import corpora

q, lst, hits, any_ = lx.quoted, lx.sql_list, lx.sql_hits, lx.sql_any
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def tokens(t: str) -> str:
    """claim_tokens in SQL."""
    clean = f"regexp_replace(regexp_replace(lower({t}), '\\btwenty percent\\b', '20 percent', 'g'), '\\bper cent\\b', 'percent', 'g')"
    raw = f"list_filter(string_split(regexp_replace({clean}, '[^a-z0-9가-힣%]+', ' ', 'g'), ' '), lambda x: x <> '')"
    same = "CASE x " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in lx.pairs("synonym").items()) + " ELSE x END"
    stem = "CASE WHEN x LIKE '%ies' AND length(x) > 5 THEN x[:-4] || 'y' WHEN x LIKE '%ing' AND length(x) > 6 THEN x[:-4] WHEN x LIKE '%ed' AND length(x) > 5 THEN x[:-3] WHEN x LIKE '%s' AND length(x) > 4 AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END"
    words = raw
    for step in (same, stem, same):
        words = f"list_transform({words}, lambda x: {step})"
    return f"list_filter({words}, lambda x: length(x) >= 3 AND NOT list_contains({lst(lx.markers('stopword'))}, x))"


def group_key(toks: str, kind: str) -> str:
    ranked = f"list_transform(list_distinct({toks}), lambda t: {{'n': -len(list_filter({toks}, lambda y: y = t)), 'at': list_position({toks}, t), 't': t}})"
    return f"CASE WHEN len({toks}) = 0 THEN CASE WHEN {kind} <> 'other' THEN {kind} ELSE 'generic_claim' END ELSE 'topic_' || array_to_string(list_transform(list_sort({ranked})[1:4], lambda z: z.t), '_') END"


def label(key: str) -> str:
    clean = f"(CASE WHEN starts_with({key}, 'topic_') THEN {key}[7:] ELSE {key} END)"
    cases = " ".join(f"WHEN starts_with({clean}, {q(a)}) THEN {q(b)}" for a, b in tx.LABELS)
    return f"CASE {cases} ELSE array_to_string(list_transform(string_split(replace({clean}, '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') END"


def token_set(toks: str, kind: str) -> str:
    more = ", ".join(f"CASE WHEN list_has_any({toks}, {lst(a)}) THEN {lst(b)} ELSE []::VARCHAR[] END" for a, b in tx.EXPANSIONS)
    return f"list_sort(list_distinct(flatten([{toks}, {more}, CASE WHEN {kind} <> 'other' THEN [{kind}] ELSE []::VARCHAR[] END])))"


def sentences(t: str) -> str:
    whole = strip(f"coalesce({t}, '')")
    cut = f"regexp_replace({whole}, '([.!?。！？]){SPACE}+', '\\1' || chr(1), 'g')"
    for _ in range(2):
        cut = f"regexp_replace({cut}, '([다요죠음]){SPACE}+([가-힣A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    parts = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: {strip('x')}), lambda x: length(x) >= {cl.MIN_CHARS})"
    merged = f"string_split(regexp_replace(array_to_string({parts}, chr(1)), '({'|'.join(cl.CONTINUES)})' || chr(1), '\\1 ', 'g'), chr(1))"
    return f"CASE WHEN {whole} = '' THEN []::VARCHAR[] WHEN len({parts}) = 0 THEN [{whole}] ELSE {merged} END"


def clock(n: str, hours: bool = False) -> str:
    long = f"printf('%02d:%02d:%02d', ({n}) // 3600, ({n}) % 3600 // 60, ({n}) % 60)"
    return long if hours else f"CASE WHEN ({n}) >= 3600 THEN {long} ELSE printf('%02d:%02d', ({n}) // 60, ({n}) % 60) END"


SEEDED = f"""seed AS (SELECT unnest(range({len(corpora.SEEDS)})) AS k, unnest({lst(corpora.SEEDS)}) AS s),
seeded AS (SELECT conv_id, turn, role, concat(coalesce(text, ''), ' ', s) AS text FROM conversations JOIN seed ON k = (conv_id * 7 + turn) % {len(corpora.SEEDS)})"""
SEG = SEEDED + f""",
seg AS (SELECT concat('v', conv_id) AS video_id, turn AS seg_ord, text, role AS speaker, {clock("turn * 6")} AS time_ref FROM seeded)"""
LINES = "line AS (SELECT concat('d', doc_id) AS video_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS seg_ord FROM documents)"
BENCH = "bline AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM benchmark)"


def claims_of(source: str) -> str:
    return f"""part AS MATERIALIZED (SELECT * EXCLUDE (text), {sentences("text")} AS parts FROM {source}),
frag AS (SELECT * EXCLUDE (parts), unnest(parts) AS text, generate_subscripts(parts, 1) AS f FROM part),
claim AS MATERIALIZED (SELECT * EXCLUDE (f), row_number() OVER (PARTITION BY video_id ORDER BY seg_ord, f) AS claim_ord, 'C' || lpad((row_number() OVER (PARTITION BY video_id ORDER BY seg_ord, f))::VARCHAR, 4, '0') AS claim_id FROM frag)"""


def typed(source: str) -> str:
    """`typed` from a relation with text: both axes and the aside signal."""
    ev = "CASE"
    for name, conf in (("unclear", "low"), ("inference", "medium"), ("external", "medium"), ("video_internal", "high")):
        ev += f" WHEN len(e_{name}) > 0 THEN {{'e': '{name}', 'c': '{conf}', 'h': e_{name}}}"
    ev += " ELSE {'e': 'video_internal', 'c': 'medium', 'h': []::VARCHAR[]} END"
    found = ", ".join(f"{hits('text', lx.markers('evidence', n))} AS e_{n}" for n in lx.labels("evidence"))
    aside = ", ".join(f"{hits('text', lx.markers('aside', n))} AS a_{n}" for n in ("strong", "weak", "risk_boundary", "hesitation_phrase", "hypothesis", "tangent"))
    fillers = lst(lx.markers("aside", "hesitation_token"))
    toks = f"list_filter(list_transform(string_split_regex(text, '{SPACE}+'), lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+$', '', 'g'))), lambda w: w <> '')"
    return f"""m1 AS MATERIALIZED (SELECT *, {lx.sql_best("text", "content")} AS b, {found}, {aside}, {toks} AS toks FROM {source}),
m2 AS (SELECT *, {ev} AS ev,
  CASE WHEN a_strong = ['현장에서'] AND contains(text, '경제 현장에서의 문제') THEN []::VARCHAR[] ELSE a_strong END AS strong,
  CASE WHEN list_contains(a_weak, '사실은') THEN list_filter(a_weak, lambda x: x <> '실은') ELSE a_weak END AS weak,
  list_concat(a_hypothesis, a_tangent) AS thought,
  list_concat(list_filter({fillers}, lambda x: list_contains(toks, x)), a_hesitation_phrase) AS hes0,
  len(list_filter(toks, lambda x: list_contains({fillers}, x))) >= 3 AS often FROM m1),
m3 AS (SELECT *, (often AND length(text) <= 90) OR (len(hes0) > 0 AND len(thought) > 0) AS counts FROM m2),
m4 AS (SELECT *, CASE WHEN counts THEN hes0 ELSE []::VARCHAR[] END AS hes FROM m3),
m5 AS (SELECT *, len(strong) > 0 OR len(a_risk_boundary) > 0 OR len(weak) >= 2 AS t1, len(thought) > 0 OR counts AS t2 FROM m4),
typed AS MATERIALIZED (SELECT * EXCLUDE (b, ev, t1, t2),
  CASE WHEN b.n > 0 THEN b.label ELSE 'other' END AS content_type, CASE WHEN b.n > 0 THEN b.hits ELSE []::VARCHAR[] END AS content_markers,
  ev.e AS evidence, ev.c AS confidence, ev.h AS evidence_markers,
  CASE WHEN t1 THEN 'type1_hidden_info' WHEN t2 THEN 'type2_unformed_thought' ELSE 'none' END AS aside_type,
  CASE WHEN t1 THEN greatest(len(strong) * 2 + len(a_risk_boundary) * 2 + len(weak) + CASE WHEN len(thought) > 0 THEN 1 ELSE 0 END, 1) WHEN t2 THEN len(thought) * 2 + len(hes) ELSE 0 END AS aside_score,
  CASE WHEN t1 THEN flatten([strong, a_risk_boundary, weak, thought]) WHEN t2 THEN list_concat(thought, hes) ELSE []::VARCHAR[] END AS aside_markers FROM m5)"""


CLAIMS = SEG + ", " + claims_of("seg") + ", " + typed("claim")
GENRES = f"""gtext AS (SELECT video_id, 'Conversation ' || video_id[2:] || chr(10) || string_agg(text, chr(10) ORDER BY seg_ord) AS t FROM seg GROUP BY 1),
genre0 AS (SELECT video_id, {lx.sql_best("t", "genre")} AS b FROM gtext),
genre AS MATERIALIZED (SELECT video_id, CASE WHEN b.n > 0 THEN b.label ELSE 'other' END AS genre, b.n AS n, CASE WHEN b.n > 0 THEN b.hits ELSE []::VARCHAR[] END AS markers FROM genre0)"""


def _case(key: str, lexicon: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in lx.pairs(lexicon).items()) + " END"


_STANCE = f"CASE WHEN {any_('lower(text)', cl.CAUTION)} THEN 'caution_or_counterpoint' WHEN {any_('lower(text)', cl.HYPOTHESIS)} THEN 'hypothesis_or_alternative' WHEN {any_('lower(text)', cl.PROMOTION)} THEN 'claim_or_promotion' WHEN evidence = 'inference' OR confidence = 'low' THEN 'hypothesis_or_alternative' ELSE 'reported_claim' END"
_ROLE = "CASE stance " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in cl.ROLES.items()) + " ELSE 'reported_context' END"
_STAKES, _NAMELESS = any_("lower(text)", cl.HIGH_STAKES), "coalesce(speaker, '') IN ('', 'unknown')"
_GATES = dict(zip(cl.GATES, ("confidence = 'low'", any_("lower(text)", cl.VISUAL), _NAMELESS, _STAKES, f"({_STAKES} OR confidence = 'low')")))
TOPICS = SEEDED + f""",
tseg AS (SELECT concat('t', conv_id) AS topic_id, concat('t', conv_id, '-', coalesce(role, 'unknown')) AS video_id, turn AS seg_ord, {strip("text")} AS text, role AS speaker, {clock("turn * 6")} AS time_ref, turn * 6.0::DOUBLE AS secs FROM seeded),
tclaim AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_ord) AS claim_ord FROM tseg WHERE text <> ''),
{typed("tclaim")},
rec0 AS (SELECT topic_id, video_id, seg_ord AS topic_ord, claim_ord, lpad(claim_ord::VARCHAR, 4, '0') AS num, text, speaker, time_ref, secs, content_type, evidence, confidence, aside_type, {tokens("text")} AS tokens, {_STANCE} AS stance, {", ".join(f"CASE WHEN {c} THEN 'needed' ELSE 'not_needed' END AS {g}" for g, c in _GATES.items())} FROM typed),
rec AS MATERIALIZED (SELECT *, video_id || ':C' || num AS claim_uid, video_id || ':E' || num AS evidence_id, {_ROLE} AS support_role, array_to_string(tokens, ' ') AS canonical_text, {token_set("tokens", "content_type")} AS token_set FROM rec0)"""
_NONE = "[]::VARCHAR[]"


GROUPS = TOPICS + f""",
mem AS (SELECT *, first_value(claim_uid) OVER (PARTITION BY topic_id, token_set ORDER BY topic_ord) AS cluster, min(topic_ord) OVER (PARTITION BY topic_id, token_set) AS opened FROM rec),
gk AS (SELECT topic_id, cluster, 'topic_' || array_to_string(list_sort(any_value(token_set))[1:4], '_') AS claim_group_key FROM mem WHERE len(token_set) > 0 GROUP BY 1, 2),
g0 AS (SELECT topic_id, cluster, opened, list_sort(list_distinct(list(video_id))) AS video_ids, count(*) AS claim_count, list_sort(list_distinct(list(stance))) AS stances, list_sort(list_distinct(list(support_role))) AS support_roles,
  list(claim_uid ORDER BY topic_ord) AS claim_uids, list_sort(list_distinct(list(evidence_id))) AS evidence_ids, count(DISTINCT coalesce(speaker, 'unknown-speaker')) AS speaker_count, bool_or(external_verification = 'needed') AS external,
  list_sort(list_distinct(any_value(tokens))) AS toks FROM mem GROUP BY 1, 2, 3),
grp AS MATERIALIZED (SELECT g0.*, coalesce(claim_group_key, 'generic_claim') AS claim_group_key, len(video_ids) AS video_count, len(video_ids) >= 2 AS repeated_claim, len(video_ids) = 1 AS outlier_claim,
  list_contains(stances, '{terrain.PROMOTES}') AND (list_contains(stances, '{terrain.DOUBTS}') OR list_contains(stances, '{terrain.SUPPOSES}')) AS disagreement_point,
  'G' || lpad((row_number() OVER (PARTITION BY topic_id ORDER BY coalesce(claim_group_key, 'generic_claim'), opened))::VARCHAR, 4, '0') AS group_id,
  CASE WHEN list_contains(support_roles, 'supporting_or_promotional') THEN 'supporting' WHEN list_contains(support_roles, 'challenging_or_limiting') THEN 'challenging' WHEN list_contains(support_roles, 'alternative_explanation') THEN 'alternative' ELSE 'reported' END AS axis
  FROM g0 LEFT JOIN gk USING (topic_id, cluster)),
bucket AS (SELECT topic_id, axis, list_position({lst(terrain.AXES)}, axis) AS pos, list(group_id ORDER BY group_id) AS ids, list_sort(list_distinct(flatten(list(video_ids)))) AS vids, list(claim_uids[1] ORDER BY group_id) AS reps, bool_or(disagreement_point) AS dis FROM grp GROUP BY 1, 2)"""
WORDS = "word AS (SELECT user_id::VARCHAR AS claim_id, event_id AS word_ord, event_type AS word, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value / 100 AS e FROM events)"
PAUSES = WORDS + """, timed AS (SELECT *, row_number() OVER w - 1 AS i, lead(s) OVER w AS ns, coalesce(lead(word) OVER w, '') AS nw FROM word WHERE s IS NOT NULL AND e IS NOT NULL WINDOW w AS (PARTITION BY claim_id ORDER BY s, e, word_ord)),
pause AS (SELECT claim_id, i AS after_word_index, round(ns - e, 3) AS gap_seconds, round(e, 3) AS at_seconds, nw AS next_word FROM timed WHERE ns - e >= 0.7)"""
_RESTART = "coalesce(t <> '' AND nt <> '' AND (t = nt OR (least(length(t), length(nt)) >= 2 AND (starts_with(t, nt) OR starts_with(nt, t)))), false)"
HESITATION = PAUSES + f""", again AS (SELECT claim_id, word, trim(word) AS t, lead(trim(word)) OVER (PARTITION BY claim_id ORDER BY word_ord) AS nt FROM word),
c AS (SELECT claim_id, count(*) AS word_count, count(*) FILTER (list_contains({lst(lx.markers("filler"))}, t)) AS filler_count, count(*) FILTER ({_RESTART}) AS restart_count FROM again GROUP BY 1),
sp AS (SELECT claim_id, round(arg_max(e, {{'a': s, 'b': e, 'c': word_ord}}) - arg_min(s, {{'a': s, 'b': e, 'c': word_ord}}), 3) AS speech_span_s FROM timed GROUP BY 1),
p AS (SELECT claim_id, count(*) AS n FROM pause GROUP BY 1),
hes AS (SELECT c.claim_id, word_count, speech_span_s, coalesce(n, 0) AS pause_count, filler_count, restart_count, NULL::DOUBLE AS hesitation_score,
  CASE WHEN word_count < 4 THEN 'insufficient_words' WHEN coalesce(n, 0) >= 1 OR filler_count >= 2 OR restart_count >= 1 THEN 'hesitation_candidate' ELSE 'no_hesitation_detected' END AS marker FROM c LEFT JOIN sp USING (claim_id) LEFT JOIN p USING (claim_id))"""


def wordset(t: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[0-9a-z가-힣]+'), lambda x: length(x) > 1)))"


def duplicates(source: str) -> str:
    """`dup` of a relation with video_id and text, against the lines of benchmark: pairs counted by shared words."""
    return f"""a0 AS MATERIALIZED (SELECT video_id, text, {wordset("text")} AS w FROM {source} WHERE text <> ''), b0 AS (SELECT DISTINCT {wordset("text")} AS w FROM bline WHERE text <> ''),
a1 AS (SELECT row_number() OVER () AS ia, w FROM (SELECT DISTINCT w FROM a0)), b1 AS (SELECT row_number() OVER () AS ib, w FROM b0),
shared AS (SELECT ia, ib, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared_n FROM (SELECT ia, len(w) AS n, unnest(w) AS x FROM a1) a JOIN (SELECT ib, len(w) AS n, unnest(w) AS x FROM b1) b USING (x) GROUP BY 1, 2),
hit AS (SELECT DISTINCT w FROM a1 JOIN shared USING (ia) WHERE shared_n / (na + nb - shared_n) >= {similarity.DUPLICATE}),
dup AS (SELECT video_id, count(*) AS claim_count, count(hit.w) AS likely_duplicate_claim_count, round(count(hit.w) / count(*), 3) AS duplicate_ratio FROM a0 LEFT JOIN hit ON a0.w = hit.w GROUP BY 1)"""


def scores() -> str:
    """The terms of summary.score, in order."""
    t, low = squeeze("coalesce(text, '')"), "lower(t)"
    kind = "content_type"
    by = lambda lexicon, make, none="0.0": "CASE genre " + " ".join(f"WHEN {q(g)} THEN {make(lx.markers(lexicon, g))}" for g in sorted({r[2] for r in lx.rows() if r[1] == lexicon})) + f" ELSE {none} END"
    inn = lambda m: f"list_contains({lst(m)}, {kind})"
    count = lambda text, items: f"len(list_filter({lst(items)}, lambda m: contains({text}, m)))"
    start = " OR ".join(f"starts_with(t, {q(m)})" for m in lx.markers("summary", "weak_start"))
    end = " OR ".join(f"ends_with(t, {q(m)})" for m in lx.markers("summary", "weak_end"))
    fill = f"len(list_filter(toks, lambda x: list_contains({lst(summary.FILLERS)}, x)))"
    rep = " + ".join(f"len(list_filter(range(1, greatest(len(toks) - {2 * k} + 2, 1)), lambda i: toks[i:i + {k - 1}] = toks[i + {k}:i + {2 * k - 1}]))" for k in (1, 2, 3))
    total = f"""CASE WHEN aside_type <> 'none' THEN -18.0 ELSE 0.0 END::DOUBLE + CASE WHEN {kind} <> 'other' THEN 4.0 ELSE 0.0 END
 + {by("preferred", lambda m: f"CASE WHEN {inn(m)} THEN 5.0 ELSE 0.0 END")} + {by("demoted", lambda m: f"CASE WHEN {inn(m)} THEN -10.0 ELSE 0.0 END")}
 + {by("keyword", lambda m: f"least(10.0, {count(low, [x.lower() for x in m])} * 3.0)")}
 + CASE confidence WHEN 'high' THEN 8.0 WHEN 'medium' THEN 4.0 ELSE 0.0 END + CASE WHEN time_ref <> '' THEN 2.0 ELSE 0.0 END
 + CASE WHEN n >= 45 AND n <= 170 THEN 16.0 WHEN n >= 28 AND n < 45 THEN 7.0 WHEN n > 170 AND n <= 230 THEN 3.0 WHEN n > 230 THEN -(12 + (n - 230)::DOUBLE / 18) ELSE -8.0 END
 + greatest(0.0, 11.0 - (claim_ord - 1) * 0.45::DOUBLE) - ({rep}) * 7.0 - {count(low, lx.markers("summary", "noise"))} * 8.0 - {count("t", lx.markers("summary", "low_signal"))} * 16.0
 + CASE WHEN {start} THEN -6.0 ELSE 0.0 END + CASE WHEN {end} THEN -5.0 ELSE 0.0 END - CASE WHEN {fill} >= 3 THEN {fill} * 2.0 ELSE 0.0 END
 + CASE WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN -25.0 ELSE 0.0 END"""
    return f"""s0 AS MATERIALIZED (SELECT typed.* EXCLUDE (toks), genre, {t} AS t, length({t}) AS n, regexp_extract_all(lower({t}), '[0-9A-Za-z가-힣]+') AS toks FROM typed JOIN genre USING (video_id)),
scored AS (SELECT video_id, claim_ord, text, aside_type, round(CASE WHEN t = '' THEN -1000.0 ELSE {total} END, 6) AS summary_score FROM s0)"""


def clip(t: str) -> str:
    return f"{squeeze(t)}[1:180] || CASE WHEN length({squeeze(t)}) > 180 THEN '…' ELSE '' END"


def _worth() -> str:
    m = lambda label: lx.markers("worth", label)
    found = lambda label: f"list_filter({lst(sorted(m(label)))}, lambda x: contains(blob, x))"
    compact = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for c, r in pairs) + "]::VARCHAR[], lambda x: x IS NOT NULL)"
    holds = ("high_value", "residual", "len(weak_claim_ids) > 0", "risky", any_("blob", m("time_sensitive")), "len(promotional_markers) > 0", "len(low_quality_markers) > 0")
    route = "CASE " + " ".join(f"WHEN recommended_route = {q(k)} THEN {q(v[0])}" for k, v in worth.ROUTES.items()) + " END"
    return f"""w0 AS (SELECT video_id, lower('Conversation ' || video_id[2:] || ' ' || string_agg(text, ' ' ORDER BY claim_ord)) AS blob,
  coalesce(list(claim_id ORDER BY claim_ord) FILTER (evidence IN ('unclear', 'inference') OR confidence = 'low'), {_NONE}) AS weak_claim_ids, bool_or(list_contains({lst(m("high_value_type"))}, content_type)) AS high_value, bool_or(aside_type <> 'none' OR aside_score > 0) AS residual FROM typed GROUP BY 1),
w1 AS (SELECT w0.*, dup.* EXCLUDE (video_id), list_contains({lst(m("high_risk_genre"))}, genre) AS risky, {found("promotional")} AS promotional_markers, {found("low_quality")} AS low_quality_markers FROM w0 JOIN genre USING (video_id) LEFT JOIN dup USING (video_id)),
w2 AS (SELECT *, {compact([(f"{any_('blob', m('entertainment'))} AND NOT high_value", "commodity_entertainment_or_music"), ("coalesce(duplicate_ratio, 0) >= 0.6 AND coalesce(claim_count, 0) >= 2", "local_duplicate_heavy")])} AS skips, {compact(zip(holds, worth.REASONS))} AS why FROM w1),
w3 AS (SELECT *, len(skips) > 0 AS auto_skip_candidate, CASE WHEN len(skips) > 0 THEN 'no' WHEN high_value OR residual OR risky THEN 'yes' ELSE 'maybe' END AS analysis_worth FROM w2),
w4 AS (SELECT *, CASE WHEN auto_skip_candidate THEN 'skip_expensive_analysis' WHEN list_has_any(why, ['time_sensitive_claims', 'high_risk_genre']) THEN 'needs_source_verification' WHEN list_has_any(why, ['promotional_or_hype_noise', 'low_quality_or_uncertain_information']) THEN 'caption_first_with_caution' WHEN analysis_worth = 'yes' THEN 'compact_strong_model_review' ELSE 'caption_first_only' END AS recommended_route FROM w3)
SELECT video_id, 'Conversation ' || video_id[2:] AS title, high_value, residual, {joined("weak_claim_ids")} AS weak_claim_ids, claim_count, likely_duplicate_claim_count, duplicate_ratio, {joined("promotional_markers")} AS promotional_markers, {joined("low_quality_markers")} AS low_quality_markers,
 {joined("skips")} AS skip_or_stop_reasons, {joined("why")} AS why_analyze, analysis_worth, CASE WHEN auto_skip_candidate THEN 'none' WHEN analysis_worth = 'yes' THEN 'medium_need_gated' ELSE 'caption_first_only' END AS max_cost_tier, recommended_route, {route} AS estimated_next_cost, auto_skip_candidate FROM w4"""


def _leaks() -> str:
    rows = [*gates.LEAKS, ("@example", "local_denylist"), ("license", "local_denylist")]
    key = "CASE " + " ".join(f"WHEN contains(text, {q(k)}) THEN {q(k)}" for k in gates.KEYS) + " END"
    found = " UNION ALL ".join(f"SELECT video_id AS path, seg_ord + 1 AS line_no, {q(label)} AS label, {q(p)} AS pattern FROM line WHERE contains(lower(text), {q(p.lower())})" for p, label in rows)
    return f"WITH {LINES} {found} UNION ALL SELECT * FROM (SELECT video_id AS path, seg_ord + 1 AS line_no, 'api_key_assignment' AS label, {key} AS pattern FROM line) WHERE pattern IS NOT NULL"


def _payload() -> str:
    """`issue` and `pay` of corpora.payloads."""
    low = lambda m: [x.lower() for x in m]
    inf, gen, ext = (any_(t, low(lx.markers("gate", n))) for t, n in (("lower(text)", "inference"), ("lower(text)", "generalization"), ("lower(summary)", "external")))
    w = "'warning' AS severity"
    return f"""c AS (SELECT video_id AS payload_id, claim_ord - 1 AS item, claim_ord AS n, text, confidence, CASE WHEN evidence = 'inference' THEN 'fact' WHEN confidence = 'high' THEN 'opinion' ELSE 'fact' END AS type,
  (claim_ord % 5 + 1) >= 4 OR confidence = 'high' AS important, CASE WHEN claim_ord % 3 = 0 THEN NULL ELSE 'E' || (claim_ord % 7)::VARCHAR END AS ref, claim_ord % 2 = 0 AND time_ref <> '' AS anchored, claim_ord % 4 = 0 AS cautious, contains(lower(text), 'screen') AS visual, seg_ord FROM typed),
pay AS (SELECT payload_id, payload_id[2:]::BIGINT AS num, arg_min(text, n) AS summary, max(seg_ord) * 6 AS last, bool_or(visual) AS visual FROM c GROUP BY 1),
pay2 AS (SELECT *, num % 3 = 0 OR num % 5 = 0 AS high_risk FROM pay),
issue AS MATERIALIZED (
 SELECT payload_id, {w}, 'claim_without_evidence' AS code, item, important AS blocking FROM c WHERE ref IS NULL
 UNION ALL SELECT payload_id, {w}, 'unknown_evidence_ref', item, important FROM c WHERE ref = 'E6'
 UNION ALL SELECT payload_id, {w}, 'important_claim_without_time_anchor', item, true FROM c WHERE important AND NOT anchored
 UNION ALL SELECT payload_id, {w}, 'overconfident_inference', item, false FROM c WHERE type = 'opinion' AND confidence = 'high'
 UNION ALL SELECT payload_id, {w}, 'inference_written_as_fact', item, false FROM c WHERE type = 'fact' AND {inf}
 UNION ALL SELECT payload_id, {w}, 'unsupported_generalization', item, false FROM c WHERE {gen}
 UNION ALL SELECT payload_id, {w}, 'task_without_acceptance_criteria', 0, false FROM pay2 WHERE num % 3 <> 0
 UNION ALL SELECT payload_id, {w}, 'underspecified_task', 0, false FROM pay2 WHERE num % 2 <> 0
 UNION ALL SELECT payload_id, {w}, 'external_knowledge_in_video_internal_summary', NULL, true FROM pay2 WHERE {ext}
 UNION ALL SELECT c.payload_id, {w}, 'high_risk_claim_without_caution', item, true FROM c JOIN pay2 USING (payload_id) WHERE high_risk AND NOT cautious
 UNION ALL SELECT payload_id, {w}, 'visual_needed_without_artifact', NULL, false FROM pay2 WHERE visual
 UNION ALL SELECT payload_id, {w}, 'audio_needed_without_artifact', NULL, false FROM pay2 WHERE num % 7 = 0
 UNION ALL SELECT payload_id, {w}, 'front_loaded_long_video_coverage', NULL, false FROM pay2 WHERE num % 2 = 0 AND last < 2400
 UNION ALL SELECT payload_id, 'error', 'final_report_created_with_failed_gate', NULL, true FROM pay2 WHERE num % 4 = 0 AND num % 8 = 0)"""


def _validation() -> str:
    bad = lambda t: f"(contains(coalesce({t}, ''), chr(65533)) OR regexp_matches({strip(f'coalesce({t}, chr(0))')}, '^[? ]+$'))"
    return f"""WITH {LINES}, body AS (SELECT *, CASE WHEN seg_ord % 5 > 0 THEN 'C' || (seg_ord % 50)::VARCHAR END AS claim_id FROM line),
body2 AS (SELECT *, row_number() OVER (PARTITION BY video_id, claim_id ORDER BY seg_ord) AS n FROM body),
head AS (SELECT concat('d', doc_id) AS video_id, source AS title, lang AS language FROM documents),
found AS (SELECT video_id, 'language_empty' AS issue FROM head WHERE coalesce({strip("language")}, '') = '' UNION ALL SELECT video_id, 'title_undecoded' FROM head WHERE {bad("title")} UNION ALL SELECT video_id, 'title_empty' FROM head WHERE coalesce({strip("title")}, '') = ''
 UNION ALL SELECT video_id, 'schema_version_missing' FROM head UNION ALL SELECT video_id, CASE WHEN claim_id IS NULL THEN 'claim_id_missing' ELSE 'claim_id_repeated' END FROM body2 WHERE claim_id IS NULL OR n > 1
 UNION ALL SELECT video_id, 'text_undecoded' FROM body2 WHERE {bad("text")} UNION ALL SELECT video_id, 'evidence_invalid' FROM body2 WHERE length(text) % 2 = 1)
SELECT video_id, issue, count(*) AS n FROM found GROUP BY 1, 2"""


def _overlay() -> str:
    return """r AS (SELECT c_nationkey::BIGINT AS overlay_id, c_mktsegment AS gid, count(*) AS n FROM customer GROUP BY 1, 2),
o AS (SELECT overlay_id, count(*) AS k FROM r GROUP BY 1)"""


def _overlay_issues() -> str:
    flags = " UNION ALL ".join(f"SELECT overlay_id, 'unexpected_policy_flag:{k}=true' FROM o WHERE overlay_id % 6 = {i}" for i, k in enumerate(gates.FLAGS))
    return f"""WITH {_overlay()} SELECT overlay_id, 'missing_top_level_field:schema_version' AS issue FROM o WHERE overlay_id % 2 = 1
 UNION ALL SELECT overlay_id, 'overlay_group_count_mismatch: declared=4 actual=' || k FROM o WHERE k <> 4
 UNION ALL SELECT overlay_id, 'unexpected_truth_status:' || gid || '=true' FROM r WHERE n % 2 = 1
 UNION ALL SELECT overlay_id, {q("missing_limitation:" + gates.LIMITATIONS[3])} FROM o UNION ALL {flags}"""


def _guard() -> str:
    bad = " UNION ALL ".join(f"SELECT answer_id, {q('forbidden_phrase:' + p)} AS issue FROM a WHERE contains(low, {q(p.lower())})" for p in lx.markers("answer", "forbidden"))
    lack = " UNION ALL ".join(f"SELECT answer_id, {q('missing_required:' + p)} FROM a WHERE NOT contains(low, {q(p.lower())})" for p in lx.markers("answer", "required"))
    return f"WITH {SEEDED}, a AS (SELECT concat(conv_id, ':', turn) AS answer_id, lower(text) AS low FROM seeded) {bad} UNION ALL {lack}"


_TEXTS = ", ".join(f"({q(r[1])}, {q(r[2])})" for r in lx.rows())
_LISTED = lambda *cs: ", ".join(f"{joined(c)} AS {c}" for c in cs)
_SECTIONS = "CASE genre " + " ".join(f"WHEN {q(g)} THEN {q('|'.join(lx.markers('section', g)))}" for g in lx.pairs("risk")) + " ELSE '' END"
_COORD = "concat('claim_uid=', claim_uid, ' | video=', video_id, ' | time=', time_ref, ' | speaker=', coalesce(speaker, 'unknown speaker'), ' | confidence=', confidence, ' | modality=caption')"
_PAIRS = """tk AS (SELECT topic_id, claim_uid, topic_ord, len(token_set) AS n, unnest(token_set) AS x FROM rec),
pr AS (SELECT a.topic_id, a.claim_uid AS a, b.claim_uid AS b, a.n AS an, b.n AS bn, count(*) AS shared_n FROM tk a JOIN tk b ON a.topic_id = b.topic_id AND a.x = b.x AND a.topic_ord < b.topic_ord GROUP BY 1, 2, 3, 4, 5)"""

ORACLES = {
    "claim_tokens": f"WITH {LINES}, t AS (SELECT video_id, seg_ord, {tokens('text')} AS tk FROM line WHERE text <> ''), k AS (SELECT *, {group_key('tk', q('other'))} AS claim_group_key FROM t) SELECT video_id, seg_ord, array_to_string(tk, ' ') AS canonical_text, claim_group_key, {label('claim_group_key')} AS claim_group_label FROM k",
    "sentence_split": f"WITH {LINES}, {claims_of('line')} SELECT video_id, seg_ord, claim_ord, claim_id, text FROM claim",
    "token_df_topk": f"WITH {LINES}, t AS (SELECT unnest(list_distinct({tokens('text')})) AS token FROM line) SELECT token, count(*) AS df FROM t GROUP BY 1 ORDER BY df DESC, token LIMIT 100",
    "time_refs": f"SELECT conv_id, turn, {clock('turn * 606')} AS ref, (turn * 606)::DOUBLE AS seconds, (turn * 606)::DOUBLE AS cue_seconds, {clock('turn * 6', True)} AS long_ref FROM conversations",
    "lexicon_sizes": f"SELECT lexicon, label, count(*) AS markers FROM (VALUES {_TEXTS}) AS t(lexicon, label) GROUP BY 1, 2",
    "claim_axes": f"WITH {CLAIMS} SELECT video_id, claim_ord, content_type, evidence, confidence, {_LISTED('content_markers', 'evidence_markers')} FROM typed",
    "aside_signals": f"WITH {CLAIMS} SELECT video_id, claim_ord, aside_type, aside_score, {_LISTED('aside_markers')}, aside_type <> 'none' AS needs_audio_check FROM typed",
    "ranked_asides": f"WITH {CLAIMS} SELECT video_id, claim_id, row_number() OVER (PARTITION BY video_id ORDER BY aside_score DESC, claim_id) AS aside_rank, aside_score FROM typed WHERE aside_type <> 'none'",
    "genre_detect": f"WITH {SEG}, {GENRES} SELECT video_id, genre, {_case('genre', 'risk')} AS risk_domain, n AS score, {_LISTED('markers')}, CASE WHEN n > 0 THEN 'marker_score' ELSE 'default' END AS basis, {_SECTIONS} AS sections FROM genre",
    "claim_records": f"WITH {TOPICS} SELECT claim_uid, evidence_id, stance, support_role, 'caption' AS modality, secs AS timestamp_start, CASE WHEN {_NAMELESS} THEN 'unknown' ELSE 'high' END AS speaker_confidence, canonical_text, {_LISTED('token_set')}, {_COORD} AS coordinate, {', '.join(cl.GATES)} FROM rec",
    "evidence_records": f"WITH {TOPICS} SELECT evidence_id, video_id, secs AS timestamp_start, time_ref, speaker, CASE WHEN {_NAMELESS} THEN 'unknown' ELSE 'high' END AS speaker_confidence, 'caption' AS modality, text, confidence, 'video_internal_claim_not_external_source' AS source_separation FROM rec",
    "need_gate_summary": f"WITH {TOPICS} " + " UNION ALL ".join(f"SELECT video_id, '{g}' AS gate, count(*) AS needed FROM rec WHERE {g} = 'needed' GROUP BY 1" for g in cl.GATES),
    "record_counts": f"WITH {TOPICS} SELECT video_id, count(*) AS claim_total, count(*) AS evidence_total, count(*) FILTER (aside_type = 'none') AS main_total, count(*) FILTER (aside_type <> 'none') AS aside_total FROM rec GROUP BY 1",
    "timeline": f"WITH {CLAIMS}, n AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(time_ref) OVER w IS NOT DISTINCT FROM time_ref AND lag(speaker) OVER w IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS new FROM typed WINDOW w AS (PARTITION BY video_id ORDER BY claim_ord)), e AS (SELECT *, (sum(new) OVER (PARTITION BY video_id ORDER BY claim_ord))::BIGINT AS entry_ord FROM n) SELECT video_id, entry_ord, time_ref, speaker, string_agg(text, ' ' ORDER BY claim_ord) AS text, coalesce(string_agg(claim_id, '|' ORDER BY claim_ord) FILTER (aside_type = 'none'), '') AS main_ids, coalesce(string_agg(claim_id, '|' ORDER BY claim_ord) FILTER (aside_type <> 'none'), '') AS aside_ids FROM e GROUP BY 1, 2, 3, 4",
    "key_information": f"WITH {CLAIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence <> 'high', claim_ord) AS n FROM typed WHERE aside_type = 'none' AND content_type <> 'other' AND confidence IN ('high', 'medium')) SELECT video_id, printf('K%03d', n) AS info_id, content_type AS label, text AS content, time_ref, claim_id AS source_claim_id, confidence FROM k WHERE n <= 12",
    "summary_scores": f"WITH {CLAIMS}, {GENRES}, {scores()} SELECT video_id, claim_ord, summary_score FROM scored",
    "one_line": f"WITH {CLAIMS}, {GENRES}, {scores()}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY aside_type <> 'none', summary_score DESC, claim_ord) AS n FROM scored) SELECT video_id, {clip('max(text) FILTER (n = 1)')} AS one_line, count(*) FILTER (aside_type = 'none') AS main_claim_count, count(*) FILTER (aside_type <> 'none') AS aside_claim_count FROM r GROUP BY 1",
    "pause_events": f"WITH {PAUSES} SELECT * FROM pause",
    "hesitation_markers": f"WITH {HESITATION} SELECT * FROM hes",
    "hesitation_counts": f"WITH {HESITATION} SELECT count(*) AS claim_count, count(*) FILTER (marker = 'hesitation_candidate') AS candidate_count, count(*) FILTER (marker = 'insufficient_words') AS insufficient_count FROM hes",
    "duplicate_report": f"WITH {LINES}, {BENCH}, {duplicates('line')} SELECT * FROM dup",
    "similar_turns": f"WITH d AS (SELECT DISTINCT {wordset('text')} AS w FROM (SELECT text FROM conversations UNION ALL SELECT unnest({lst(corpora.DEBATES)}))), s AS (SELECT array_to_string(w, ' ') AS k, len(w) AS n, unnest(w) AS x FROM d), p AS (SELECT a.k AS l, b.k AS r, a.n AS an, b.n AS bn, count(*) AS shared_n FROM s a JOIN s b USING (x) WHERE a.k < b.k GROUP BY 1, 2, 3, 4) SELECT md5(l) AS left_key, md5(r) AS right_key, round(shared_n / (an + bn - shared_n), 6) AS score FROM p WHERE shared_n / (an + bn - shared_n) >= 0.3",
    "topic_similarity": f"WITH {TOPICS}, {_PAIRS}, sc AS (SELECT topic_id, a, b, round(shared_n / (an + bn - shared_n) * 0.55::DOUBLE + shared_n / greatest(1, least(an, bn)) * 0.45::DOUBLE, 4) AS score FROM pr) SELECT * FROM sc WHERE score >= 0.2",
    "source_trace": f"WITH {CLAIMS} SELECT video_id, claim_ord AS trace_ord, claim_id, time_ref, evidence, confidence, content_type AS claim_type, text[1:500] AS excerpt FROM typed WHERE claim_ord <= 5",
    "worth_decision": f"WITH {CLAIMS}, {GENRES}, {BENCH}, {duplicates('claim')}, {_worth()}",
    "package_validation": _validation(),
    "leak_scan": _leaks(),
    "quality_issues": f"WITH {CLAIMS}, {_payload()} SELECT payload_id, severity, code, item, blocking FROM issue",
    "quality_gate": f"WITH {CLAIMS}, {_payload()}, s AS (SELECT payload_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (blocking) AS b, count(*) AS n FROM issue GROUP BY 1) SELECT payload_id, high_risk, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count, coalesce(b, 0) AS blocker_count, coalesce(n, 0) AS issue_count, coalesce(b, 0) > 0 AS block_final_report, CASE WHEN coalesce(e, 0) > 0 OR coalesce(b, 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM pay2 LEFT JOIN s USING (payload_id)",
    "unknown_evidence_refs": "WITH r AS (SELECT l_orderkey::VARCHAR AS video_id, l_linenumber::VARCHAR AS claim_id, unnest([l_partkey::VARCHAR, 'S' || l_suppkey]) AS ref FROM lineitem) SELECT * FROM r WHERE ref NOT IN (SELECT p_partkey::VARCHAR FROM part) AND EXISTS (SELECT 1 FROM part)",
    "answer_guard": _guard(),
    "tool_policy": "WITH e AS (SELECT event_id AS request_id, ['overlay.summary', 'overlay.write', 'fact_check'][event_id % 3 + 1] AS tool FROM events) SELECT request_id, 'tool_not_allowed:' || tool AS issue FROM e WHERE tool <> 'overlay.summary' UNION ALL SELECT request_id, 'forbidden_capability:fact_check' FROM e WHERE tool = 'fact_check'",
    "overlay_validation": _overlay_issues(),
    "overlay_groups": f"WITH {_overlay()} SELECT overlay_id, row_number() OVER (PARTITION BY overlay_id ORDER BY gid) - 1 AS group_ord, gid AS overlay_group_id, 'G' || n AS source_group_id, 'segment' AS split_axis, n AS claim_count, CASE WHEN n % 2 = 0 THEN 'not_evaluated' ELSE 'true' END AS truth_status, 'not_performed' AS fact_check_status, false AS allowed_for_model_answer FROM r",
    "overlay_summary": f"WITH {_overlay()} SELECT overlay_id, true AS ok, CASE WHEN overlay_id % 2 = 0 THEN '1' ELSE '' END AS schema_version, 'topic' AS topic_id, 'ready' AS overlay_status, 4::BIGINT AS overlay_group_count FROM o",
    "clusters_equal_tokens": f"WITH {GROUPS} SELECT topic_id, claim_uid, topic_ord, cluster FROM mem",
    "claim_groups": f"WITH {GROUPS}, l AS (SELECT *, {label('claim_group_key')} AS label FROM grp) SELECT topic_id, {_LISTED('video_ids', 'stances', 'support_roles', 'claim_uids', 'evidence_ids')}, claim_count, claim_uids[1] AS representative_claim_uid, speaker_count, claim_group_key, 1.0::DOUBLE AS grouping_score, group_id, label, video_count, repeated_claim, outlier_claim, disagreement_point, CASE WHEN claim_count >= 2 THEN array_to_string(toks[1:8], '|') ELSE '' END AS shared_tokens, label || ': ' || claim_count || ' claim(s) across ' || video_count || ' video(s).' AS summary, CASE WHEN repeated_claim THEN 'high' ELSE 'medium' END AS grouping_confidence, disagreement_point OR outlier_claim AS human_review_required, axis FROM l",
    "outliers": f"WITH {GROUPS} SELECT topic_id, group_id AS claim_group_id, 'single_source_outlier' AS outlier_type, {_LISTED('claim_uids')}, CASE WHEN external THEN 'medium' ELSE 'low' END AS followup_priority FROM grp WHERE outlier_claim",
    "opinion_groups": f"WITH {GROUPS} SELECT topic_id, 'OG' || lpad((row_number() OVER (PARTITION BY topic_id ORDER BY pos))::VARCHAR, 4, '0') AS opinion_group_id, axis, ({lst(terrain.AXIS_LABEL)})[pos] AS label, {joined('ids')} AS member_claim_group_ids, {joined('vids')} AS source_video_ids, {joined('reps')} AS distinguishing_claims, dis AS contains_disagreement_point, 'medium' AS confidence, 'not_evaluated' AS truth_status FROM bucket WHERE len(vids) >= 2",
    "opinion_warnings": f"WITH {GROUPS} SELECT topic_id, 'opinion_group_skipped_single_source:' || axis AS warning FROM bucket WHERE len(vids) < 2 UNION ALL SELECT topic_id, 'opinion_group_builder_produced_no_groups' FROM bucket GROUP BY topic_id HAVING bool_and(len(vids) < 2)",
    "stance_groups": f"WITH {TOPICS} SELECT topic_id, stance, string_agg(claim_uid, '|' ORDER BY topic_ord) AS claim_uids FROM rec GROUP BY 1, 2",
    "topic_summary": f"WITH {GROUPS}, s AS (SELECT topic_id, count(DISTINCT video_id) AS video_record_count, count(*) AS claim_total FROM rec GROUP BY 1), k AS (SELECT topic_id, count(*) AS claim_group_count, count(*) FILTER (repeated_claim) AS repeated_claim_groups, count(*) FILTER (disagreement_point) AS disagreement_groups, count(*) FILTER (outlier_claim) AS outlier_groups FROM grp GROUP BY 1) SELECT *, 'not_evaluated' AS truth_status, 'not_performed' AS fact_check_status FROM s JOIN k USING (topic_id)",
    "group_detail": f"WITH {GROUPS} SELECT topic_id, group_id, claim_uid, video_id, time_ref, secs AS timestamp_start, speaker, confidence, 'caption' AS modality, evidence_id, {_COORD} AS coordinate, text FROM grp JOIN mem USING (topic_id, cluster)",
    "pair_checks": "SELECT 'must_link' AS kind, item_id AS pair_ord, 'b:' || item_id AS left_uid, 'b:' || item_id AS right_uid, true AS ok FROM benchmark UNION ALL SELECT 'cannot_link', a.item_id, 'b:' || a.item_id, 'b:' || b.item_id, true FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
    "pair_agreement": "SELECT n AS passed, n AS total, 1.0::DOUBLE AS score, 0.75::DOUBLE AS threshold, 'pass' AS status FROM (SELECT 2 * count(*) - 1 AS n FROM benchmark)",
}
