"""Scalar functions on claim texts and time references, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .terms import EXPANSIONS, terms  # noqa: F401

EDGE = '\t\n\r !"\'(),.:;<>?[]`{}~·‘’“”‥…、。〈〉《》「」『』！，．：；？'
CLOSERS = "\"'”’)]》』」"
WORD = "[0-9a-z가-힣]+"
TERMINAL = ".?!。！？…"
LABELS = (
    ("water_saving", "Water-savings claim"),
    ("sensor_probe_maintenance", "Sensor reliability / maintenance risk"),
    ("maintenance_sensor_probe", "Sensor reliability / maintenance risk"),
    ("yield_software_soil", "Yield explanation / causality claim"),
    ("yield_cause_software", "Yield explanation / causality claim"),
    ("policy_adoption", "Policy or adoption context"),
)


def squeeze(text: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pieces(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def clock_seconds(ref: Column) -> Column:
    """Seconds of `ss`, `mm:ss` or `hh:mm:ss`; every part may be a decimal number. Otherwise null."""
    p = F.transform(F.split(strip(ref), ":"), lambda x: x.try_cast("double"))
    n = F.size(p)
    value = F.when(n == 1, p[0]).when(n == 2, F.get(p, F.lit(0)) * 60 + F.get(p, F.lit(1))).when(n == 3, F.get(p, F.lit(0)) * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2)))
    return F.when(F.exists(p, lambda x: x.isNull()), None).otherwise(value)


def cue_seconds(ref: Column) -> Column:
    """As clock_seconds, but hours and minutes must be whole numbers, and of four parts or more the first alone counts."""
    p = F.split(strip(ref), ":")
    n, part = F.size(p), lambda i: F.get(p, F.lit(i))
    whole = lambda i: F.when(strip(part(i)).rlike("^[+-]?[0-9]+$"), strip(part(i)).try_cast("bigint"))
    real = lambda i: strip(part(i)).try_cast("double")
    return F.when(n == 2, whole(0) * 60 + real(1)).when(n == 3, whole(0) * 3600 + whole(1) * 60 + real(2)).otherwise(real(0)).cast("double")


def clock(seconds: Column, hours: bool = False) -> Column:
    """mm:ss, or hh:mm:ss from an hour on or if asked for."""
    t = F.floor(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("bigint")
    two = lambda x: F.format_string("%02d", x.cast("bigint"))
    short = F.concat(two(F.floor(t / 60)), F.lit(":"), two(t % 60))
    long = F.concat(two(F.floor(t / 3600)), F.lit(":"), two(F.floor(t % 3600 / 60)), F.lit(":"), two(t % 60))
    return long if hours else F.when(t >= 3600, long).otherwise(short)


def claim_tokens(text: Column) -> Column:
    """Normalised words: synonyms, one suffix rule, synonyms again; without stop words and words under three characters."""
    return terms(text, F.lit("other"), "tokens")["tokens"]


def canonical(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def words(text: Column) -> Column:
    """Distinct lower-case words of letters (Latin, Hangul) and digits, of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1), lambda x: F.length(x) > 1))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all members; `empty` if both sets are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(empty)).otherwise(both / F.greatest(all_, F.lit(1)))


def blend(both: Column, a: Column, b: Column) -> Column:
    """0.55 of the Jaccard and 0.45 of the overlap coefficient, from sizes."""
    score = F.round(both / (a + b - both) * 0.55 + both / F.greatest(F.lit(1), F.least(a, b)) * 0.45, 4)
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(score)


def group_label(key: Column) -> Column:
    clean = F.when(F.startswith(key, F.lit("topic_")), F.substring(key, 7, 1 << 20)).otherwise(key)
    out = F.when(F.lit(False), "")
    for prefix, label in LABELS:
        out = out.when(F.startswith(clean, F.lit(prefix)), label)
    return out.otherwise(F.initcap(F.replace(clean, F.lit("_"), F.lit(" "))))


def ends_sentence(text: Column) -> Column:
    """Whether a cue closes a sentence: by its last mark, or by a Korean ending of its last word."""
    last = lambda t: F.rtrim(F.regexp_extract(t, r"(?U)(\S+)$", 1), F.lit(CLOSERS))
    tail = lambda word, label: F.exists(lx.array(lx.markers("ending", label)), lambda m: F.endswith(word, m))
    korean = lambda w: tail(w, "strong") | tail(w, "polite") | (F.endswith(w, F.lit("다")) & ~tail(w, "not_final"))
    closes = lambda t: F.when(t == "", False).when(F.array_contains(lx.array(list(TERMINAL)), F.right(t, F.lit(1))), True).otherwise(lx.bound(last(t), korean))
    return lx.bound(F.regexp_replace(text, r"(?U)\s+$", ""), closes)


def edge_trim(word: Column) -> Column:
    """A spoken word without the marks and white space around it."""
    return F.btrim(F.coalesce(word, F.lit("")), F.lit(EDGE))


def restarts(a: Column, b: Column) -> Column:
    """Whether of two neighbouring words one repeats or continues the other: equal, or two characters or more a prefix."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.coalesce((a != "") & (b != "") & ((a == b) | ((F.length(shorter) >= 2) & F.startswith(longer, shorter))), F.lit(False))


def clip(text: Column, n: int = 180) -> Column:
    """One line of at most n characters, with an ellipsis if cut."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.concat(F.left(t, F.lit(n)), F.when(F.length(t) > n, "…").otherwise(""))


def one_line_override(text: Column) -> Column:
    """The clipped text, or null where it is under 12 characters, says that nothing was found, or holds an address."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when((F.length(t) >= 12) & (t != "(no claims extracted)") & ~F.contains(t, F.lit("http://")) & ~F.contains(t, F.lit("https://")), clip(t))


def claim_number(claim_id: Column) -> Column:
    """The digits at the end of a claim id; 999 without any."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(claim_id, F.lit("")), r"([0-9]+)$", 1), F.lit("")).try_cast("bigint"), F.lit(999))


def repeats(tokens: Column) -> Column:
    """Immediate repetitions of one, two and three tokens."""
    n = F.size(tokens)
    total = F.lit(0)
    for k in (1, 2, 3):
        at = F.when(n >= 2 * k, F.sequence(F.lit(1), n - 2 * k + 1)).otherwise(F.array().cast("array<int>"))
        total = total + F.size(F.filter(at, lambda i: F.slice(tokens, i, F.lit(k)) == F.slice(tokens, i + k, F.lit(k))))
    return total


def slug(text: Column, n: int = 80, default: str = "video") -> Column:
    """A file name: letters, digits, Hangul, dots, underscores and hyphens, white space as hyphens."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^0-9A-Za-z가-힣._\s-]+|[\t\n\r\f\x0B]+", "")
    t = F.btrim(F.regexp_replace(strip(t), r"(?U)\s+", "-"), F.lit(".-_"))
    return F.left(F.coalesce(F.nullif(t, F.lit("")), F.lit(default)), F.lit(n))


def content_hash(*columns: Column) -> Column:
    """sha256 of the canonical JSON of columns, given in order of their names; nulls count."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def undecoded(text: Column) -> Column:
    """Whether a text looks badly decoded: a replacement character, or nothing but question marks and spaces."""
    t = F.coalesce(text, F.lit(""))
    return F.contains(t, F.lit("�")) | F.coalesce(strip(t).rlike(r"^[? ]+$"), F.lit(False))
