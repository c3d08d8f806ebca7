"""From segments of transcripts to typed claims, evidence and claim records.

Segments: video_id, seg_ord, text, speaker, time_ref, source_hint, modality_source. Every function takes and returns
DataFrames (or columns); order is always an explicit column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

STOPS, KOREAN_ENDS, STARTS = "!.?。！？", "다요음죠", "A-Z가-힣"
SPLIT = f"(?U)(?<=[{STOPS}])\\s+|(?<=[{KOREAN_ENDS}])\\s+(?=[{STARTS}])"
MIN_CHARS = 6
CONTINUES = ("그", "바로", "이런", "주요", "이러한", "또 다른")
CAUTION = "but|drift|however|maintenance|omit|누락|충돌|did not mention|not discussed|not guaranteed".split("|")
HYPOTHESIS = "could|hypothesis|may|might|probably|seems|가능성|아마|추정".split("|")
PROMOTION = "benefit|can cut|case study|claims|improve|says it can|vendor says|사례|홍보".split("|")
ROLES = {"claim_or_promotion": "supporting_or_promotional", "caution_or_counterpoint": "challenging_or_limiting", "hypothesis_or_alternative": "alternative_explanation"}
VISUAL = "chart|dashboard|map|on screen|screen|slide|table".split("|")
HIGH_STAKES = "20 percent|deadline|guarantee|policy|subsidy|twenty percent".split("|")
GATES = tuple("asr ocr_vision speaker_diarization external_verification strong_model_review".split())
MODALITIES = {"caption": "caption|captions|subtitle|subtitles|transcript", "asr": "asr|audio", "ocr": "ocr|screen_text", "vision": "vision|visual", "scene": "scene|shot", "speaker": "diarization|speaker|speaker_diarization", "mixed": "mixed|multimodal"}
LEGACY = {"fact": "video_internal", "interpretation": "inference", "uncertainty": "unclear", "memory/context": "external", "unsupported/needs_review": "unclear", "unsupported/needs-review": "unclear"}


def sentences(text: Column) -> Column:
    """Sentences of six characters or more, those after a continuing word appended to the one before; never none of a text."""
    ends = lambda x: F.exists(lx.array(CONTINUES), lambda s: F.endswith(x, s))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), x)))
        return F.when((F.size(done) > 0) & ends(last), joined).otherwise(F.concat(done, F.array(x)))

    def merged(parts: Column) -> Column:
        return F.when(F.exists(parts, ends), F.aggregate(parts, F.array().cast("array<string>"), add)).otherwise(parts)

    def split(whole: Column) -> Column:
        parts = F.filter(F.transform(F.split(whole, SPLIT), tx.strip), lambda x: F.length(x) >= MIN_CHARS)
        return F.when(whole == "", lx.array([])).otherwise(lx.bound(parts, lambda p: F.when(F.size(p) == 0, F.array(whole)).otherwise(merged(p))))

    return lx.bound(tx.strip(F.coalesce(text, F.lit(""))), split)


def split_claims(segments: DataFrame, presplit: bool = True, prefix: str = "C") -> DataFrame:
    """One row a sentence (or a segment, if not presplit), numbered through each video: claim_ord, claim_id, text."""
    whole = tx.strip(F.coalesce("text", F.lit("")))
    found = sentences(F.col("text")) if presplit else F.when(whole == "", lx.array([])).otherwise(F.array(whole))
    rows = segments.select(*(c for c in segments.columns if c != "text"), F.posexplode_outer(found).alias("frag_ord", "text")).where("text is not null")
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("seg_ord", "frag_ord"))
    return rows.withColumn("claim_ord", n).withColumn("claim_id", F.concat(F.lit(prefix), F.lpad(F.col("claim_ord").cast("string"), F.greatest(F.lit(4), F.length(F.col("claim_ord").cast("string"))), F.lit("0")))).drop("frag_ord")


def content_axis(text: Column) -> Column:
    """struct(n, label, hits): the content type with most markers, the first of equal ones; `other` without any."""
    row = lambda b: F.struct(b["n"].alias("n"), F.when(b["n"] > 0, b["label"]).otherwise("other").alias("label"), F.when(b["n"] > 0, b["hits"]).otherwise(lx.array([])).alias("hits"))
    return lx.bound(lx.best(text, "content"), row)


def epistemic_axis(text: Column, hint: Column) -> Column:
    """struct(evidence, confidence, hits): unclear before inference, external and internal wording; else by the hint."""
    confidence = {"unclear": "low", "inference": "medium", "external": "medium", "video_internal": "high"}
    row = lambda e, c, h: F.struct(F.lit(e).alias("evidence"), F.lit(c).alias("confidence"), h.alias("hits"))
    found = lx.hits(text, {label: lx.markers("evidence", label) for label in lx.labels("evidence")})

    def first(h: Column) -> Column:
        out = F.when(F.lit(False), row("", "", lx.array([])))
        for label in lx.labels("evidence"):
            out = out.when(F.size(h[label]) > 0, row(label, confidence[label], h[label]))
        return out.when(hint.isin("external_pack", "external"), row("external", "medium", lx.array([]))).otherwise(row("video_internal", "medium", lx.array([])))

    return lx.bound(found, first)


def spoken_tokens(text: Column) -> Column:
    return F.filter(F.transform(tx.pieces(text), lambda t: F.lower(F.regexp_replace(t, r"(?U)^(?:\W|_)+|(?:\W|_)+$", ""))), lambda t: t != "")


def aside(text: Column) -> Column:
    """struct(type, score, markers): remarks off the record, then unformed thoughts; hesitation only counts with others or often."""
    lists = ("strong", "weak", "risk_boundary", "hesitation_phrase", "hypothesis", "tangent")
    words = lx.markers("aside", "hesitation_token")
    known = lx.hits(text, {label: lx.markers("aside", label) for label in lists} | {"words": words})
    # only a text that holds a filler somewhere is split into words
    spoken = F.when(F.size(known["words"]) > 0, spoken_tokens(text)).otherwise(lx.array([]))
    found = F.struct(*(known[label].alias(label) for label in lists), spoken.alias("tokens"))
    fillers = lx.array(words)
    n = F.size

    def parts(h: Column) -> Column:
        strong = F.when((h["strong"] == lx.array(["현장에서"])) & F.contains(text, F.lit("경제 현장에서의 문제")), lx.array([])).otherwise(h["strong"])
        weak = F.when(F.array_contains(h["weak"], "사실은"), F.array_remove(h["weak"], "실은")).otherwise(h["weak"])
        hesitation = F.concat(lx.bound(h["tokens"], lambda t: F.filter(fillers, lambda m: F.array_contains(t, m))), h["hesitation_phrase"])
        often = (n(F.filter(h["tokens"], lambda t: F.array_contains(fillers, t))) >= 3) & (F.length(text) <= 90)
        thought = F.concat(h["hypothesis"], h["tangent"])
        return F.struct(strong.alias("strong"), h["risk_boundary"].alias("risk"), weak.alias("weak"), thought.alias("thought"), hesitation.alias("hesitation"), often.alias("often"))

    row = lambda t, s, m: F.struct(F.lit(t).alias("type"), s.cast("int").alias("score"), m.alias("markers"))

    def signal(p: Column) -> Column:
        strong, risk, weak, thought = (p[x] for x in ("strong", "risk", "weak", "thought"))
        counts = p["often"] | ((n(p["hesitation"]) > 0) & (n(thought) > 0))
        hes = F.when(counts, p["hesitation"]).otherwise(lx.array([]))
        hidden = n(strong) * 2 + n(risk) * 2 + n(weak) + F.when(n(thought) > 0, 1).otherwise(0)
        return (
            F.when((n(strong) > 0) | (n(risk) > 0) | (n(weak) >= 2), row("type1_hidden_info", F.greatest(hidden, F.lit(1)), F.concat(strong, risk, weak, thought)))
            .when((n(thought) > 0) | counts, row("type2_unformed_thought", n(thought) * 2 + n(hes), F.concat(thought, hes)))
            .otherwise(row("none", F.lit(0), lx.array([])))
        )

    return lx.bound(lx.bound(found, parts), signal)


def classified(claims: DataFrame) -> DataFrame:
    """claims with both axes and the aside signal."""
    hint = F.col("source_hint") if "source_hint" in claims.columns else F.lit("transcript")
    rows = claims.withColumns({"_c": content_axis(F.col("text")), "_e": epistemic_axis(F.col("text"), hint), "_a": aside(F.col("text"))})
    return rows.withColumns({
        "content_type": F.col("_c.label"), "content_markers": F.col("_c.hits"),
        "evidence": F.col("_e.evidence"), "confidence": F.col("_e.confidence"), "evidence_markers": F.col("_e.hits"),
        "aside_type": F.col("_a.type"), "aside_score": F.col("_a.score"), "aside_markers": F.col("_a.markers"),
        "needs_audio_check": F.col("_a.type") != "none",
    }).drop("_c", "_e", "_a")


def content_type_of(value: Column) -> Column:
    """A content type of the enumeration, else `other`."""
    raw = F.replace(F.replace(F.lower(tx.strip(F.coalesce(value, F.lit("")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.when(raw.isin([*lx.labels("content"), "other"]), raw).otherwise("other")


def evidence_of(value: Column) -> Column:
    """A kind of evidence, older names mapped, else `unclear`."""
    raw = F.replace(F.replace(F.lower(tx.strip(F.coalesce(value, F.lit("")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    out = F.when(raw.isin(lx.labels("evidence")), raw)
    for old in ("fact", "interpretation", "uncertainty", "memory/context"):
        out = out.when(raw == old, LEGACY[old])
    return out.otherwise("unclear")


def modality(value: Column) -> Column:
    raw = tx.strip(F.lower(F.coalesce(value, F.lit("caption"))))
    out = F.when(raw == "", "caption")
    for name, forms in MODALITIES.items():
        out = out.when(raw.isin(forms.split("|")), name)
    return out.otherwise(raw)


def stance(text: Column, evidence: Column, confidence: Column) -> Column:
    """Caution before hypothesis before promotion, by words anywhere in the text; then by weak evidence."""
    low = F.lower(text)
    return (
        F.when(lx.any_of(low, CAUTION), "caution_or_counterpoint")
        .when(lx.any_of(low, HYPOTHESIS), "hypothesis_or_alternative")
        .when(lx.any_of(low, PROMOTION), "claim_or_promotion")
        .when((evidence == "inference") | (confidence == "low"), "hypothesis_or_alternative")
        .otherwise("reported_claim")
    )


def role(stance_: Column) -> Column:
    out = F.when(F.lit(False), "")
    for s, r in ROLES.items():
        out = out.when(stance_ == s, r)
    return out.otherwise("reported_context")


def nameless(speaker: Column) -> Column:
    return F.coalesce(speaker, F.lit("")).isin("", "unknown")


def need_gates(text: Column, speaker: Column, modality_: Column, confidence: Column) -> Column:
    """struct of what a claim needs: needed or not_needed."""
    low = F.lower(text)
    stakes, weak = lx.any_of(low, HIGH_STAKES), F.coalesce(confidence == "low", F.lit(False))
    need = (weak, lx.any_of(low, VISUAL) | (modality_ == "mixed"), nameless(speaker), stakes, stakes | weak)
    return F.struct(*(F.when(c, "needed").otherwise("not_needed").alias(g) for g, c in zip(GATES, need)))


def records(claims: DataFrame) -> DataFrame:
    """Claim records, with their evidence's fields: one row a claim, the sources' defaults filled in."""
    text = F.coalesce("text", F.lit(""))
    base = claims.withColumns({
        "text": text,
        "content_type": F.coalesce("content_type", F.lit("other")),
        "evidence": F.coalesce("evidence", F.lit("unclear")),
        "confidence": F.coalesce("confidence", F.lit("low")),
        "aside_type": F.coalesce(F.nullif("aside_type", F.lit("")), F.lit("none")),
        "aside_score": F.coalesce("aside_score", F.lit(0)),
        "modality": modality(F.coalesce(F.nullif("modality_source", F.lit("")), F.lit("caption"))),
        "_terms": tx.terms(text, F.coalesce("content_type", F.lit("other")), "tokens", "canonical", "token_set", "group_key"),
    })
    key = F.col("_terms.group_key")
    return base.withColumns({
        "tokens": F.col("_terms.tokens"),
        "claim_uid": F.concat_ws(":", "video_id", "claim_id"),
        "evidence_id": F.concat("video_id", F.lit(":E"), F.lpad(F.col("claim_ord").cast("string"), F.greatest(F.lit(4), F.length(F.col("claim_ord").cast("string"))), F.lit("0"))),
        "canonical_text": F.col("_terms.canonical"),
        "token_set": F.col("_terms.token_set"),
        "claim_group_key": key,
        "claim_group_label": tx.group_label(key),
        "timestamp_start": tx.clock_seconds(F.col("time_ref")),
        "timestamp_end": F.lit(None).cast("double"),
        "speaker_confidence": F.when(nameless(F.col("speaker")), "unknown").otherwise("high"),
        "stance": stance(text, F.col("evidence"), F.col("confidence")),
        "verification_status": F.lit("video_internal_not_fact_checked"),
        "source_separation": F.lit("video_internal_claim_not_external_source"),
    }).withColumns({
        "support_role": role(F.col("stance")),
        "need_gates": need_gates(text, F.col("speaker"), F.col("modality"), F.col("confidence")),
        "coordinate": F.concat_ws(
            " | ",
            F.concat(F.lit("claim_uid="), F.col("claim_uid")), F.concat(F.lit("video="), F.col("video_id")),
            F.concat(F.lit("time="), F.coalesce("time_ref", F.lit("unknown"))), F.concat(F.lit("speaker="), F.coalesce("speaker", F.lit("unknown speaker"))),
            F.concat(F.lit("confidence="), F.col("confidence")), F.concat(F.lit("modality="), F.col("modality")),
        ),
    }).drop("_terms")


def evidence_records(recs: DataFrame) -> DataFrame:
    return recs.select("video_id", "evidence_id", "time_ref", "timestamp_start", "timestamp_end", "speaker", "speaker_confidence", F.array("modality").alias("modality"), "text", "confidence", "source_separation")


def need_gate_summary(recs: DataFrame) -> DataFrame:
    """video_id, gate, needed: how many claims need what; only what some claim needs."""
    gates = F.explode(F.array(*(F.when(F.col(f"need_gates.{g}") == "needed", g) for g in GATES))).alias("gate")
    return recs.select("video_id", gates).where("gate is not null").groupBy("video_id", "gate").agg(F.count("*").alias("needed"))


def record_counts(recs: DataFrame) -> DataFrame:
    return recs.groupBy("video_id").agg(
        F.count("*").alias("claim_total"), F.count("evidence_id").alias("evidence_total"),
        F.count_if(F.col("aside_type") == "none").alias("main_total"), F.count_if(F.col("aside_type") != "none").alias("aside_total"),
    )


def ranked_asides(claims: DataFrame) -> DataFrame:
    """Asides of each video by falling score, then id: aside_rank."""
    at = Window.partitionBy("video_id").orderBy(F.desc("aside_score"), "claim_id")
    return claims.where("aside_type <> 'none'").withColumn("aside_rank", F.row_number().over(at))


def genre(text: Column, override: Column | None = None) -> Column:
    """struct(genre, risk_domain, score, markers, basis, sections) of a whole video's text, or of a valid override."""
    return lx.bound(lx.best(text, "genre"), lambda b: _genre(b, override))


def _genre(b: Column, override: Column | None) -> Column:
    found = F.when(b["n"] > 0, b["label"]).otherwise("other")
    forced = genre_name(override) if override is not None else F.lit(None).cast("string")
    known = list(lx.pairs("risk"))
    by = forced.isin(known) & forced.isNotNull()
    name = F.when(by, forced).otherwise(found)
    sections = F.when(F.lit(False), lx.array([]))
    for g in known:
        sections = sections.when(name == g, lx.array(lx.markers("section", g)))
    return F.struct(
        name.alias("genre"), lx.by_label(name, "risk").alias("risk_domain"),
        F.when(by, 0).otherwise(b["n"]).cast("int").alias("score"), F.when(by | (b["n"] == 0), lx.array([])).otherwise(b["hits"]).alias("markers"),
        F.when(by, "override").when(b["n"] > 0, "marker_score").otherwise("default").alias("basis"), sections.alias("sections"),
    )


GENRE_WORDS = (("건강|의학", "health_medical"), ("금융|경제|시장", "finance_economy"), ("개발|튜토리얼", "development_tutorial"), ("it/ai|ai 강|인공지능", "it_ai_concept"), ("뉴스|시사|토론", "news_politics"), ("인터뷰|팟캐스트", "interview_podcast"), ("제품|리뷰|후기", "product_review"))


def genre_name(value: Column) -> Column:
    """The genre that a free name means: itself, its compact form, an alias, a word in it; else the compact form."""
    raw = tx.strip(F.coalesce(value, F.lit("")))
    compact = F.replace(F.replace(F.lower(raw), F.lit("/"), F.lit("_")), F.lit(" "), F.lit("_"))
    known = list(lx.pairs("risk"))
    out = F.when(raw == "", None).when(raw.isin(known), raw).when(compact.isin(known), compact).when(lx.by_label(compact, "genre_alias").isNotNull(), lx.by_label(compact, "genre_alias"))
    for words, name in GENRE_WORDS:
        out = out.when(lx.any_of(F.lower(raw), words.split("|")), name)
    return out.otherwise(compact)


def packages(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """videos (video_id, title, language, ...) with their genre; title and segments together are the text that decides."""
    texts = segments.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("_t"))
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("_t", F.lit("")))
    override = F.col("genre_override") if "genre_override" in videos.columns else None
    return videos.join(texts, "video_id", "left").withColumn("genre", genre(whole, override)).drop("_t")
