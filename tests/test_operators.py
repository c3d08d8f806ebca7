"""Operators against brute force and small cases of their own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as tx
from claimloom.operators import assembly, cluster, gates, reports, similarity, speech, terrain, views
from claimloom.plans import queries, service
from claimloom.sources import corpora, files
from claimloom.streaming import cues as stream

SF = "/root/testdata/sf0.001"
CLAIM = "topic_id string, claim_uid string, topic_ord int, token_set array<string>"


def blend(a, b):
    both = len(a & b)
    return round(both / len(a | b) * 0.55 + both / max(1, min(len(a), len(b))) * 0.45, 4) if a and b else 0.0


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0


def greedy(claims, score, threshold, leaders):
    groups = []
    for uid, tokens in claims:
        best, at = 0.0, None
        for g in groups:
            s = max(score(tokens, t) for _, t in (g[:1] if leaders else g))
            if s > best:
                best, at = s, g
        if at is not None and best >= threshold:
            at.append((uid, tokens))
        else:
            groups.append([(uid, tokens)])
    return {uid: g[0][0] for g in groups for uid, _ in g}


@pytest.mark.parametrize("method,threshold,most", [("normalized", None, 10**6), ("normalized", 0.5, 0), ("token_jaccard", None, 0), ("token_jaccard", 1.0, 10**6)])
def test_clusters_are_those_of_the_greedy_loop(spark, method, threshold, most):
    rng = random.Random(5)
    rows, want = [], {}
    for t in range(12):
        claims = [(f"t{t}c{i}", set(rng.sample("abcdefghijklmnop", rng.randint(0, 5)))) for i in range(14)]
        rows += [(f"t{t}", uid, i, sorted(s)) for i, (uid, s) in enumerate(claims)]
        want |= greedy(claims, blend if method == "normalized" else jaccard, threshold or cluster.THRESHOLDS[method], method == "token_jaccard")
    df = spark.createDataFrame(rows, CLAIM)
    got = {r.claim_uid: r.cluster for r in cluster.clusters(df, method, threshold, most).collect()}
    assert got == want


def test_clusters_of_nothing_and_of_unknown_methods(spark):
    assert cluster.clusters(spark.createDataFrame([], CLAIM)).collect() == []
    with pytest.raises(ValueError):
        cluster.clusters(spark.createDataFrame([], CLAIM), "magic")


def members(spark):
    rows = [
        ("t", "a", "A:1", 0, ["probe", "saving", "water"], "claim_or_promotion", "supporting_or_promotional", "x", "The vendor case study claims it can cut water use"),
        ("t", "b", "B:1", 1, ["probe", "saving", "water"], "caution_or_counterpoint", "challenging_or_limiting", None, "However it may drift and omit maintenance"),
        ("t", "a", "A:2", 2, ["policy"], "reported_claim", "reported_context", "x", "Policy stands"),
    ]
    df = spark.createDataFrame(rows, "topic_id string, video_id string, claim_uid string, topic_ord int, token_set array<string>, stance string, support_role string, speaker string, text string")
    df = df.withColumns({"tokens": F.col("token_set"), "canonical_text": F.array_join("token_set", " "), "evidence_id": F.concat(F.lit("e"), "claim_uid"), "need_gates": F.struct(F.lit("needed").alias("external_verification")), "timestamp_start": F.lit(1.0), **{c: F.lit("-") for c in ("time_ref", "confidence", "modality", "coordinate")}})
    return terrain.members(df, cluster.clusters(df))


def test_terrain_of_a_disagreement(spark):
    rows = members(spark)
    groups = terrain.claim_groups(rows)
    got = {r.group_id: r for r in groups.collect()}
    both, alone = got["G0002"], got["G0001"]
    assert (both.video_ids, both.claim_uids, both.disagreement_point, both.repeated_claim, both.grouping_confidence, both.axis, both.shared_tokens) == (["a", "b"], ["A:1", "B:1"], True, True, "high", "supporting", ["probe", "saving", "water"])
    assert (alone.outlier_claim, alone.grouping_score, alone.grouping_confidence) == (True, 1.0, "medium")
    d = terrain.disagreements(groups).collect()
    assert [(x.relation_id, x.relation_type, x.confidence) for x in d] == [("D0002", "support_vs_caution", "medium")]
    c = terrain.contradictions(rows, groups).collect()
    assert [(x.left_claim_uid, x.right_claim_uid, x.opposition_score) for x in c] == [("A:1", "B:1", 0.8)]
    assert [x.axis for x in terrain.opinion_groups(groups).collect()] == ["supporting"]
    assert [x.axis for x in terrain.opinion_groups(groups, True).orderBy("opinion_group_id").collect()] == ["supporting", "reported"]
    assert [x.warning for x in terrain.opinion_warnings(groups).collect()] == ["opinion_group_skipped_single_source:reported"]
    text = reports.terrain_markdown(groups).first().markdown
    assert text.index("G0001") < text.index("G0002")
    tools = service.topic_tools(rows, groups)
    ask = lambda m, **p: service.answer({"id": 1, "method": m, "params": p}, tools)
    assert len(ask("tools/list")["result"]["tools"]) == 4
    detail = json.loads(ask("tools/call", name="topic.claim_group_detail", arguments={"group_id": "G0002"})["result"]["content"][0]["text"])
    assert detail["ok"] and len(detail["rows"]) == 2
    assert ask("tools/call", name="topic.write")["error"]["code"] == -32000
    assert ask("nothing")["error"]["code"] == -32601
    assert ask("notifications/initialized") is None
    out = []
    service.serve(["", "{"], out.append, tools)
    assert json.loads(out[0])["error"]["code"] == -32700


def test_contradictions_and_groups_of_the_tables_agree_with_brute_force(spark):
    read = lambda t: corpora.read(spark, SF, t)
    rows = [r for r in queries._topics(read).orderBy("topic_id", "topic_ord").collect()]
    want = {}
    for t in sorted({r.topic_id for r in rows}):
        want |= greedy([(r.claim_uid, set(r.token_set)) for r in rows if r.topic_id == t], blend, 0.20, False)
    got = queries.QUERIES["claim_groups_normalized"](spark, SF).collect()
    assert {u: r.representative_claim_uid for r in got for u in r.claim_uids.split("|")} == want
    by = {r.claim_uid: r for r in rows}
    for r in got:
        sets = [set(by[u].token_set) for u in r.claim_uids.split("|")]
        pairs = [blend(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
        assert abs(r.grouping_score - (sum(pairs) / len(pairs) if pairs else 1.0)) < 1e-4
    two = {r.topic_id + r.group_id for r in got if "claim_or_promotion" in r.stances and ("caution" in r.stances or "hypothesis" in r.stances)}
    assert len(queries.QUERIES["disagreements"](spark, SF).collect()) == len(two)
    assert queries.QUERIES["contradictions"](spark, SF).count() >= 0


def assemble(cues, final, max_chars=200, max_span=15.0):
    units, buf = [], []
    for i, (text, a, b) in enumerate(cues):
        text = " ".join((text or "").split())
        if not text:
            continue
        buf.append((i, text, a, b))
        whole = " ".join(x[1] for x in buf)
        first = next((x[2] for x in buf if x[2] is not None), None)
        if final(text) or len(whole) >= max_chars or (b is not None and first is not None and b - first >= max_span):
            units.append((whole, [x[0] for x in buf]))
            buf = []
    return units + ([(" ".join(x[1] for x in buf), [x[0] for x in buf])] if buf else [])


def cues(rng):
    words = ["so", "the water", "went on", "it ended.", "Really?", "", None, "합니다", "했고"]
    return [(rng.choice(words), rng.choice([None, float(i)]), rng.choice([None, i + 1.5])) for i in range(25)]


FINAL = lambda t: t[-1] in ".?" or t == "합니다"


def test_assembly_is_the_running_loop(spark):
    rng = random.Random(2)
    videos = {f"v{k}": cues(rng) for k in range(6)}
    rows = [(v, i, *c) for v, cs in videos.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "video_id string, cue_ord int, text string, start double, end double")
    for chars, span in ((200, 15.0), (20, 15.0), (200, 4.0)):
        got = assembly.sentences(df, chars, span).orderBy("video_id", "unit_ord").collect()
        for v, cs in videos.items():
            assert [(r.text, r.cue_indices) for r in got if r.video_id == v] == assemble(cs, FINAL, chars, span)
    assert assembly.sentences(df.limit(0)).collect() == []


def test_assembly_on_a_stream(spark, tmp_path):
    rows = [("v", 0, "the water", 0.0, 1.0), ("v", 1, "ended.", 1.0, 2.0), ("v", 2, "and", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "video_id string, cue_ord int, text string, start double, end double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = stream.sentences(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), idle_ms=3_600_000).writeStream.format("memory").queryName("units").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [(r.text, r.cue_indices) for r in spark.table("units").collect()] == [("the water ended.", [0, 1])]


def test_assembled_queries_lose_no_text(spark):
    got = queries.QUERIES["assembled_sentences"](spark, SF).groupBy("video_id").agg(F.sum("cue_count").alias("n")).collect()
    lines = corpora.line_segments(corpora.read(spark, SF, "documents")).where(tx.squeeze(F.col("text")) != "").groupBy("video_id").count().collect()
    assert {r.video_id: r.n for r in got} == {r.video_id: r["count"] for r in lines}
    assert queries.QUERIES["segment_sentences"](spark, SF).count() > 0


def test_similarity_join_is_the_nested_loop(spark):
    rng = random.Random(9)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randint(0, 7))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "key int, tokens array<string>")
    for t in (0.3, 0.5, 0.55, 1.0):
        got = {(r.left_key, r.right_key) for r in similarity.jaccard_pairs(df, df, t).collect()}
        assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and jaccard(set(a), set(b)) >= t}


def test_components_of_a_long_chain(spark):
    from claimloom.operators.components import components

    edges = spark.createDataFrame([("t", f"{i:03}", f"{i + 1:03}") for i in range(20)] + [("u", "000", "001")], "topic_id string, a string, b string")
    got = {(r.topic_id, r.node): r.component for r in components(edges).collect()}
    assert set(got.values()) == {"000"} and len(got) == 23


def test_hesitation(spark):
    rows = [("a", 0, "어", "0", "0.2"), ("a", 1, "물이", "0.3", "0.5"), ("a", 2, "물이", "1.2", "1.5"), ("a", 3, "갔다", "x", None), ("b", 0, "하나", None, None), ("c", 0, "하나", "0", "1"), ("c", 1, "둘", "1", "2"), ("c", 2, "셋", "2", "3"), ("c", 3, "넷", "3", "4")]
    df = spark.createDataFrame(rows, "claim_id string, word_ord int, word string, start string, end string")
    got = {r.claim_id: (r.word_count, r.speech_span_s, r.pause_count, r.filler_count, r.restart_count, r.marker) for r in speech.hesitation(df).collect()}
    assert got == {"a": (4, 1.5, 1, 1, 1, "hesitation_candidate"), "b": (1, None, 0, 0, 0, "insufficient_words"), "c": (4, 4.0, 0, 0, 0, "no_hesitation_detected")}


CASES = {
    "plain": ({"claims": [{"claim": "x"}]}, {"claim_without_evidence": False}),
    "sure": ({"claims": [{"claim": "x", "confidence": "high"}]}, {"claim_without_evidence": True, "important_claim_without_time_anchor": True}),
    "stray": ({"known_evidence_ids": ["e1"], "claims": [{"claim": "x", "evidence_refs": ["e2"]}]}, {"unknown_evidence_ref": False}),
    "risky": ({"genre": "health_medical", "claims": [{"claim": "x", "evidence_refs": ["e1"]}]}, {"high_risk_claim_without_caution": True}),
    "labelled": ({"risk_domain": "high", "claims": [{"claim": "x", "evidence_refs": ["e1"], "risk_label": "y"}]}, {}),
    "outside": ({"summary": "As of today, an external source says"}, {"external_knowledge_in_video_internal_summary": True}),
    "guess": ({"claims": [{"claim": "It probably works", "type": "fact", "evidence_refs": ["e1"]}]}, {"inference_written_as_fact": False}),
    "unseen": ({"claims": [{"claim": "x", "evidence_refs": ["e1"], "requires_visual": True}]}, {"visual_needed_without_artifact": False}),
    "task": ({"tasks": [{"title": "t", "goal": "g"}]}, {"task_without_acceptance_criteria": False}),
    "front": ({"duration_seconds": 4000.0, "timeline": [{"start": "0", "end": "800"}]}, {"front_loaded_long_video_coverage": False}),
    "failed": ({"final_report_created": True, "quality_gate_status": "fail"}, {"final_report_created_with_failed_gate": True}),
    "empty": ({}, {}),
}


def test_gate_matrix(spark):
    schema = spark.createDataFrame([], gates.PAYLOAD).schema
    lines = spark.createDataFrame([(json.dumps({"payload_id": k} | v[0]),) for k, v in CASES.items()], "j string")
    payloads = lines.select(F.from_json("j", schema).alias("p")).select("p.*")
    issues = gates.payload_issues(payloads)
    got = {k: {} for k in CASES}
    for r in issues.collect():
        got[r.payload_id][r.code] = r.blocking
    assert got == {k: v[1] for k, v in CASES.items()}
    status = {r.payload_id: r.status for r in gates.gate(payloads, issues).collect()}
    assert status == {k: "fail" if any(v[1].values()) else "pass" for k, v in CASES.items()}


def test_files(spark, tmp_path):
    (tmp_path / "video_a.json").write_text(json.dumps({"video": {"video_id": "A", "title": "T"}, "segments": [{"text": "One.", "speaker": "s"}]}))
    (tmp_path / "video_b.json").write_text(json.dumps([{"text": "Two."}, {"text": "Three."}]))
    found, videos = files.topic_folder(spark, str(tmp_path))
    assert sorted((r.video_id, r.seg_ord, r.text) for r in found.collect()) == [("A", 0, "One."), ("video_b", 0, "Two."), ("video_b", 1, "Three.")]
    assert {r.video_id: r.video_ord for r in videos.collect()} == {"A": 1, "video_b": 2}
    (tmp_path / "bad.json").write_text('"x"')
    with pytest.raises(ValueError):
        files.segments(spark, str(tmp_path / "bad.json"))
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").collect() == []
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_jsonl(df, str(tmp_path / "l"))
    files.write_jsonl(df, str(tmp_path / "l"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "l"), "a int, b string").count() == 2
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1,"b":null}'
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/x.md").write_text("ok\napi_key=1 COOKIE\n")
    (tmp_path / "tree/y.md").write_bytes(b"\xff\xfe\xff")
    leaks = gates.leaks(files.text_tree(spark, str(tmp_path / "tree")))
    assert sorted((r.line_no, r.label) for r in leaks.collect()) == [(2, "api_key_assignment"), (2, "cookie_reference")]
    bad = gates.undecodable(spark.read.format("binaryFile").load(str(tmp_path / "tree/*.md")))
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["y.md"]


def test_last_of_equal_keys_wins(spark):
    df = spark.createDataFrame([("v", 1, "old"), ("v", 2, "new"), ("w", 1, "only")], "k string, n int, x string")
    assert {r.k: r.x for r in terrain.last_of(df, "k", "n").collect()} == {"v": "new", "w": "only"}


def test_topics_without_claims(spark):
    rows = members(spark).limit(0)
    groups = terrain.claim_groups(rows)
    assert groups.collect() == [] and terrain.opinion_groups(groups).collect() == [] and views.topic_claim_groups(groups).collect() == []
