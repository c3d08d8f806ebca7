"""Lexicons as data: rows of lexicons.tsv, as a table and as builders of Spark columns and SQL text.

A marker matches a text when it stands anywhere in it, or anywhere in its lower-cased form.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import workers

SCHEMA = "marker string, lexicon string, label string, label_ord int, marker_ord int"


@lru_cache(1)
def rows() -> tuple[tuple[str, str, str, int, int], ...]:
    text = (Path(__file__).parent / "lexicons.tsv").read_text(encoding="utf-8")
    split = (line.split("\t") for line in text.split("\n")[1:] if line)
    return tuple((m, lex, label, int(a), int(b)) for m, lex, label, a, b in split)


def table(spark: SparkSession) -> DataFrame:
    """All lexicons, to be changed and passed on as one likes."""
    return spark.createDataFrame(list(rows()), SCHEMA)


def markers(lexicon: str, label: str = "") -> list[str]:
    """The markers of a label in their order."""
    return [r[0] for r in sorted((r for r in rows() if r[1:3] == (lexicon, label)), key=lambda r: r[4])]


def labels(lexicon: str) -> list[str]:
    """The labels of a lexicon in order of precedence."""
    return [x for _, x in sorted({(r[3], r[2]) for r in rows() if r[1] == lexicon})]


def pairs(lexicon: str) -> dict[str, str]:
    """Marker to label, in the markers' order."""
    return {r[0]: r[2] for r in sorted((r for r in rows() if r[1] == lexicon), key=lambda r: r[4])}


def array(items) -> Column:
    return F.array(*(F.lit(x) for x in items)) if len(items) else F.array().cast("array<string>")


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once, however often f uses it (lambdas would compute it at every call)."""
    return F.transform(F.array(value), f)[0]


def matching(items: list[str]):
    """A function of a text and its lower-cased form: the markers that match, in order."""
    if all(m == m.lower() for m in items):
        return lambda text, low: [m for m in items if m in low]
    return lambda text, low: [m for m in items if m in low or m in text]


def lists_of(rows: list[list[str]]) -> pa.Array:
    """An Arrow array of lists of strings, some of them None."""
    at = [0]
    for r in rows:
        at.append(at[-1] + len(r or ()))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([x for r in rows if r for x in r], pa.string()), mask=pa.array([r is None for r in rows], pa.bool_()))


def hits(text: Column, lists: dict[str, list[str]]) -> Column:
    """struct of the markers of each list that match a text, in order, sought by Python (each search of a lambda costs many times more). Not for use in lambdas."""
    workers(SparkSession.active())
    find = [matching(items) for items in lists.values()]

    @F.arrow_udf(f"struct<{', '.join(f'{name}: array<string>' for name in lists)}>")
    def found(texts: pa.Array, lows: pa.Array) -> pa.Array:
        rows = [(t or "", low or "") for t, low in zip(texts.to_pylist(), lows.to_pylist())]
        return pa.StructArray.from_arrays([lists_of([f(*r) for r in rows]) for f in find], list(lists))

    return found(text, F.lower(text))


def any_of(text: Column, items: list[str]) -> Column:
    """Whether some marker stands in a text. Case must have been folded by the caller where it doesn't count."""
    return bound(text, lambda t: F.exists(array(items), lambda m: F.contains(t, m)))


def best(text: Column, lexicon: str) -> Column:
    """struct(n, label, hits) of the label with the most matches; of equal ones the first. n is 0 if nothing matches. As hits()."""
    workers(SparkSession.active())
    find = {label: matching(markers(lexicon, label)) for label in labels(lexicon)}

    @F.arrow_udf("struct<n: int, label: string, hits: array<string>>")
    def found(texts: pa.Array, lows: pa.Array) -> pa.Array:
        rows = []
        for t, low in zip(texts.to_pylist(), lows.to_pylist()):
            rows.append(max(((label, f(t or "", low or "")) for label, f in find.items()), key=lambda x: len(x[1])))
        return pa.StructArray.from_arrays([pa.array([len(h) for _, h in rows], pa.int32()), pa.array([x for x, _ in rows], pa.string()), lists_of([h for _, h in rows])], ["n", "label", "hits"])

    return found(text, F.lower(text))


def by_label(key: Column, lexicon: str, default: str | None = None) -> Column:
    """The label of a marker that equals the key."""
    held = pairs(lexicon)
    table_ = F.map_from_arrays(array(list(held)), array(list(held.values())))
    return F.coalesce(F.element_at(table_, key), F.lit(default))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]::VARCHAR[]"


def sql_hits(text: str, items) -> str:
    return f"list_filter({sql_list(items)}, lambda m: contains({text}, m) OR contains(lower({text}), m))"


def sql_any(text: str, items) -> str:
    return f"(len(list_filter({sql_list(items)}, lambda m: contains({text}, m))) > 0)"


def sql_best(text: str, lexicon: str) -> str:
    """A struct list of (n, label, hits), best first."""
    found = ", ".join(f"{{'n': len({h}), 'o': {-i}, 'label': {quoted(label)}, 'hits': {h}}}" for i, label in enumerate(labels(lexicon)) for h in [sql_hits(text, markers(lexicon, label))])
    return f"list_max([{found}])"
