"""Rule gates: every rule is a predicate, every failure a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

CONFIDENCE = ("high", "medium", "low")
BLOCKING = ("important_claim_without_time_anchor", "high_risk_claim_without_caution", "external_knowledge_in_video_internal_summary", "final_report_created_with_failed_gate")
LEAKS = tuple(
    (pattern, label)
    for label, patterns in {
        "api_key_reference": ["OPENAI_API_KEY"], "cookie_reference": ["cookie"], "private_email": ["@gmail.com"], "private_pilot_reference": ["pilot_runs"],
        "session_reference": ["browser session"], "token_reference": [f"{x}_token" for x in ("access", "bearer", "refresh")], "windows_user_path": ["C:\\Users\\"],
    }.items()
    for pattern in patterns
)
KEYS = tuple(a + b for a in ("api_key", "API_KEY") for b in ("=", ":")) + ('"api_key"', "'api_key'")
LIMITATIONS = ("synthetic_fixture_only", "caption_fragment_claim_risk", "not fact-checked", "not truth-ranked")
FLAGS = ("truth_ranking_performed", "fact_check_performed", "source_artifact_mutated", "topic_collection_mutated", "vkr_mutated", "canonical_pointer_changed")


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _any(text: Column, lexicon: str, label: str) -> Column:
    return F.coalesce(lx.any_of(F.lower(text), [m.lower() for m in lx.markers(lexicon, label)]), F.lit(False))


def _rows(keys: list, issues: list[Column]):
    return [*keys, F.explode_outer(F.array_compact(F.array(*issues))).alias("issue")]


def package_issues(videos: DataFrame, claims: DataFrame) -> DataFrame:
    """video_id, claim_id, issue: empty or undecoded headers, missing and repeated claim ids, undecoded texts, values outside the enumerations.

    videos: video_id, title, language, schema_version. A later claim of an id is the repeated one.
    """
    blank = lambda c: tx.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    head = videos.select(*_rows(["video_id", F.lit(None).cast("string").alias("claim_id")], [
        F.when(blank("language"), "language_empty"), F.when(tx.undecoded(F.col("title")), "title_undecoded"), F.when(blank("title"), "title_empty"), F.when(_no(F.col("schema_version")), "schema_version_missing"),
    ])).where("issue is not null")
    at = Window.partitionBy("video_id", "claim_id").orderBy("claim_ord")
    known = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    body = claims.withColumn("_n", F.row_number().over(at)).select(*_rows(["video_id", "claim_id"], [
        F.when(_no(F.col("claim_id")), "claim_id_missing").when(F.col("_n") > 1, "claim_id_repeated"), F.when(tx.undecoded(F.col("text")), "text_undecoded"),
        F.when(known("content_type", [*lx.labels("content"), "other"]), "content_type_invalid"), F.when(known("evidence", lx.labels("evidence")), "evidence_invalid"), F.when(known("confidence", CONFIDENCE), "confidence_invalid"),
    ])).where("issue is not null")
    return head.unionByName(body)


def important(c: Column) -> Column:
    """By flag, a number of four or more, a word, or high confidence in what isn't doubtful itself."""
    grade = F.coalesce(c["importance"], F.lit(""))
    sure = (c["confidence"] == "high") & ~F.coalesce(c["type"].isin("uncertainty", "unsupported/needs-review"), F.lit(False))
    return F.coalesce(c["important"], F.lit(False)) | F.coalesce(grade.try_cast("double") >= 4, F.lit(False)) | F.lower(grade).isin("high", "critical") | F.coalesce(sure, F.lit(False))


def anchored(c: Column) -> Column:
    """A time or segment of its own, or a reference that is one (S..., or with a colon)."""
    refs = F.coalesce(F.exists(c["evidence_refs"], lambda r: F.startswith(r, F.lit("S")) | F.contains(r, F.lit(":"))), F.lit(False))
    return ~_no(c["segment_id"]) | ~_no(c["timestamp"]) | refs


def cautious(c: Column) -> Column:
    labels = F.lower(F.coalesce(F.array_join(c["labels"], " "), F.lit("")))
    return ~_no(c["risk_label"]) | lx.any_of(labels, ["caution", "warning", "risk", "주의"])


def depends(c: Column, kind: str) -> Column:
    return F.coalesce(c[f"requires_{kind}"], F.lit(False)) | F.coalesce(F.contains(F.lower(c["dependency"]), F.lit(kind)), F.lit(False))


#: What payload_issues() reads of a claim.
CLAIM = "struct<claim:string,type:string,confidence:string,importance:string,important:boolean,evidence_refs:array<string>,segment_id:string,timestamp:string,risk_label:string,labels:array<string>,requires_visual:boolean,requires_audio:boolean,dependency:string>"
PAYLOAD = f"payload_id string, genre string, risk_domain string, duration_seconds double, final_report_created boolean, quality_gate_status string, summary string, known_evidence_ids array<string>, allowed_evidence_ids array<string>, visual_needed boolean, audio_needed boolean, visual_artifacts array<string>, audio_artifacts array<string>, timeline array<struct<start:string,`end`:string>>, claims array<{CLAIM}>, tasks array<struct<title:string,goal:string,acceptance_criteria:string>>"


def high_risk(genre: Column, risk: Column) -> Column:
    low = lambda c: F.lower(tx.strip(F.coalesce(c, F.lit(""))))
    return low(genre).isin(lx.markers("gate", "high_risk_genre")) | low(risk).isin(lx.markers("gate", "high_risk_domain"))


def payload_issues(payloads: DataFrame) -> DataFrame:
    """payload_id, issue_ord, severity, code, item (position of the claim or task), blocking. payloads: PAYLOAD."""
    issue = lambda code, item=None, severity="warning", blocks=None: F.struct(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(None).cast("int") if item is None else item.cast("int")).alias("item"),
        (F.lit(severity == "error" or code in BLOCKING) if blocks is None else blocks).alias("blocking"),
    )
    none = F.array().cast("array<string>")
    known = F.array_union(F.coalesce("known_evidence_ids", none), F.coalesce("allowed_evidence_ids", none))
    claims, tasks = F.coalesce("claims", F.array().cast(f"array<{CLAIM}>")), F.coalesce("tasks", F.array().cast("array<struct<title:string,goal:string,acceptance_criteria:string>>"))

    def of_claim(c: Column, i: Column) -> Column:
        refs, text = F.coalesce(c["evidence_refs"], none), F.coalesce(c["claim"], F.lit(""))
        strange = F.filter(refs, lambda r: (F.size(known) > 0) & ~F.array_contains(known, r))
        return F.concat(
            F.array_compact(F.array(F.when(F.size(refs) == 0, issue("claim_without_evidence", i, blocks=important(c))))),
            F.transform(strange, lambda r: issue("unknown_evidence_ref", i, blocks=important(c))),
            F.array_compact(F.array(
                F.when(important(c) & ~anchored(c), issue("important_claim_without_time_anchor", i)),
                F.when(c["type"].isin("inference", "opinion") & (c["confidence"] == "high"), issue("overconfident_inference", i)),
                F.when((c["type"] == "fact") & _any(text, "gate", "inference"), issue("inference_written_as_fact", i)),
                F.when(_any(text, "gate", "generalization"), issue("unsupported_generalization", i)),
            )),
        )

    def of_task(t: Column, i: Column) -> Column:
        return F.array_compact(F.array(F.when(_no(t["acceptance_criteria"]), issue("task_without_acceptance_criteria", i)), F.when(_no(t["title"]) | _no(t["goal"]), issue("underspecified_task", i))))

    needs = lambda kind: (F.coalesce(f"{kind}_needed", F.lit(False)) | F.exists(claims, lambda c: depends(c, kind))) & (F.coalesce(F.size(f"{kind}_artifacts"), F.lit(0)) <= 0)
    ends = F.flatten(F.transform("timeline", lambda x: F.array(x["end"].try_cast("double"), x["start"].try_cast("double"))))
    last = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.array_compact(ends)), F.lit(0.0)))
    long = (F.coalesce("duration_seconds", F.lit(0.0)) >= 1800) & (F.coalesce(F.size("timeline"), F.lit(0)) > 0) & (last < F.col("duration_seconds") * 0.6)
    risky = F.when(high_risk(F.col("genre"), F.col("risk_domain")), F.flatten(F.transform(claims, lambda c, i: F.array_compact(F.array(F.when(~cautious(c), issue("high_risk_claim_without_caution", i)))))))
    every = F.concat(
        F.flatten(F.transform(claims, of_claim)), F.flatten(F.transform(tasks, of_task)),
        F.array_compact(F.array(F.when(_any(F.col("summary"), "gate", "external"), issue("external_knowledge_in_video_internal_summary")))),
        F.coalesce(risky, F.array().cast("array<struct<severity:string,code:string,item:int,blocking:boolean>>")),
        F.array_compact(F.array(
            F.when(needs("visual"), issue("visual_needed_without_artifact")), F.when(needs("audio"), issue("audio_needed_without_artifact")),
            F.when(long, issue("front_loaded_long_video_coverage")),
            F.when(F.col("final_report_created") & (F.col("quality_gate_status") == "fail"), issue("final_report_created_with_failed_gate", severity="error")),
        )),
    )
    rows = payloads.select("payload_id", F.posexplode_outer(every).alias("issue_ord", "i")).where("i is not null")
    return rows.select("payload_id", "issue_ord", "i.severity", "i.code", "i.item", "i.blocking")


def gate(payloads: DataFrame, issues: DataFrame) -> DataFrame:
    """A row a payload: counts of issues, block_final_report, status."""
    sums = issues.groupBy("payload_id").agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"), F.count_if("blocking").alias("blocker_count"), F.count("*").alias("issue_count"))
    rows = payloads.select("payload_id", high_risk(F.col("genre"), F.col("risk_domain")).alias("high_risk")).join(sums, "payload_id", "left").na.fill(0)
    block = F.col("blocker_count") > 0
    return rows.withColumn("block_final_report", block).withColumn("status", F.when((F.col("error_count") > 0) | block, "fail").otherwise("pass"))


def unknown_refs(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """video_id, claim_id, ref of references (evidence_refs) to ids that no evidence (evidence_id) has, if there is evidence at all."""
    refs = claims.select("video_id", "claim_id", F.explode("evidence_refs").alias("ref"))
    some = evidence.select(F.lit(1).alias("_some")).limit(1)
    return refs.join(evidence.select(F.col("evidence_id").alias("ref")).distinct(), "ref", "left_anti").crossJoin(F.broadcast(some)).select("video_id", "claim_id", "ref")


def leaks(lines: DataFrame, extra: list[str] = ()) -> DataFrame:
    """path, line_no, label, pattern: what a public text mustn't hold. lines: path, line_no, line.

    The patterns of LEAKS and `extra` match in any case and all are reported; of KEYS, in their case, the first.
    """
    low = F.lower("line")
    patterns = [*LEAKS, *((x, "local_denylist") for x in extra)]
    hit = lambda label, p: F.struct(F.lit(label).alias("label"), F.lit(p).alias("pattern"))
    key = F.lit(None).cast("string")
    for p in reversed(KEYS):
        key = F.when(F.contains("line", F.lit(p)), p).otherwise(key)
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p.lower())), hit(label, p)) for p, label in patterns), F.when(key.isNotNull(), F.struct(F.lit("api_key_assignment").alias("label"), key.alias("pattern")))))
    return lines.select("path", "line_no", F.explode_outer(found).alias("x")).where("x is not null").select("path", "line_no", "x.label", "x.pattern")


def answer_issues(answers: DataFrame) -> DataFrame:
    """answer_id, issue: phrases that an answer (answer_id, text) mustn't hold, and those that it lacks."""
    low = F.lower(F.coalesce("text", F.lit("")))
    bad = [F.when(F.contains(low, F.lit(p.lower())), f"forbidden_phrase:{p}") for p in lx.markers("answer", "forbidden")]
    lacks = [F.when(~F.contains(low, F.lit(p.lower())), f"missing_required:{p}") for p in lx.markers("answer", "required")]
    return answers.select(*_rows(["answer_id"], bad + lacks)).where("issue is not null")


def answer_payload_issues(answers: DataFrame) -> DataFrame:
    """answer_id, issue for structured answers (answer_id, text, limitations array)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    said = F.lower(F.coalesce(F.array_join("limitations", " "), F.lit("")))
    bad = [F.when(F.contains(low, F.lit(p.lower())), f"forbidden_phrase:{p}") for p in lx.markers("answer", "forbidden")]
    lacks = [F.when(~F.contains(said, F.lit(p.lower())), f"missing_limitation:{p}") for p in lx.markers("answer", "limitation")]
    return answers.select(*_rows(["answer_id"], bad + lacks)).where("issue is not null")


def request_issues(requests: DataFrame) -> DataFrame:
    """request_id, issue for requests (request_id, tool, words array: all keys and values): tools not allowed, capabilities that none may ask for."""
    tool = F.when(~F.coalesce(F.col("tool").isin(lx.markers("policy", "tool")), F.lit(False)), F.concat(F.lit("tool_not_allowed:"), F.coalesce("tool", F.lit(""))))
    asks = [F.when(F.array_contains("words", c), f"forbidden_capability:{c}") for c in lx.markers("policy", "capability")]
    return requests.select(*_rows(["request_id"], [tool, *asks])).where("issue is not null")


OVERLAY_FIELDS = "limitations ok overlay_group_count overlay_groups overlay_status policy schema_version topic_id".split()
GROUP_FIELDS = "allowed_for_model_answer claim_count fact_check_status overlay_group_id source_group_id split_axis truth_status".split()


def overlay_issues(overlays: DataFrame, private: list[str] = ()) -> DataFrame:
    """overlay_id, issue of overlays (overlay_id and OVERLAY_FIELDS; groups with GROUP_FIELDS, policy a map of booleans). A null field is a missing one."""
    groups = F.coalesce("overlay_groups", F.expr("array()").cast(overlays.schema["overlay_groups"].dataType))
    gid = lambda g: F.coalesce(g["overlay_group_id"], F.lit(""))
    ids = F.transform(groups, gid)

    def of_group(g: Column, i: Column) -> Column:
        text = lambda c: F.coalesce(g[c].cast("string"), F.lit("None"))
        return F.array_compact(F.array(
            *(F.when(g[c].isNull(), f"missing_group_field:{c}") for c in sorted(GROUP_FIELDS)),
            F.when(gid(g) == "", F.concat(F.lit("empty_overlay_group_id:"), i.cast("string"))).when(F.array_position(ids, gid(g)) <= i, F.concat(F.lit("duplicate_overlay_group_id:"), gid(g))),
            F.when(~g["truth_status"].eqNullSafe("not_evaluated"), F.concat(F.lit("unexpected_truth_status:"), gid(g), F.lit("="), text("truth_status"))),
            F.when(~g["fact_check_status"].eqNullSafe("not_performed"), F.concat(F.lit("unexpected_fact_check_status:"), gid(g), F.lit("="), text("fact_check_status"))),
            F.when(F.contains(F.lower(gid(g)), F.lit("residual")) & F.coalesce(g["allowed_for_model_answer"], F.lit(False)), F.concat(F.lit("residual_group_allowed_for_model_answer:"), gid(g))),
        ))

    n, told = F.size(groups), F.coalesce("overlay_group_count", F.lit(0))
    policy = lambda k: F.element_at("policy", k)
    whole = F.to_json(F.struct(*overlays.columns))
    every = F.concat(
        F.array_compact(F.array(
            *(F.when(F.col(c).isNull(), f"missing_top_level_field:{c}") for c in sorted(OVERLAY_FIELDS)),
            F.when(told != n, F.concat(F.lit("overlay_group_count_mismatch: declared="), told.cast("string"), F.lit(" actual="), n.cast("string"))),
            F.when(told != 4, F.concat(F.lit("overlay_group_count_not_4: got "), told.cast("string"))),
        )),
        F.flatten(F.transform(groups, of_group)),
        F.array_compact(F.array(
            *(F.when(~F.coalesce(F.array_contains("limitations", x), F.lit(False)), f"missing_limitation:{x}") for x in LIMITATIONS),
            *(F.when(~policy(k).eqNullSafe(F.lit(False)), F.concat(F.lit(f"unexpected_policy_flag:{k}="), F.coalesce(policy(k).cast("string"), F.lit("None")))) for k in FLAGS),
            *(F.when(F.contains(whole, F.lit(p)), f"private_marker_in_overlay:{p}") for p in private),
        )),
    )
    return overlays.select("overlay_id", F.explode_outer(every).alias("issue")).where("issue is not null")


def undecodable(files: DataFrame) -> DataFrame:
    """path of files (path, content: bytes) that aren't UTF-8."""
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path")
