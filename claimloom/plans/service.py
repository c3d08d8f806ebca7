"""JSON-RPC over lines: read-only tools on top of DataFrames. A thin adapter; every answer is one small query."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from ..functions import lexicon as lx
from ..operators import views

Tool = Callable[[dict], DataFrame]


def topic_tools(rows: DataFrame, groups: DataFrame) -> dict[str, Tool]:
    """Tools for members() and claim_groups()."""
    return {
        "topic.summary": lambda a: views.topic_summary(rows, groups),
        "topic.claim_groups": lambda a: views.topic_claim_groups(groups),
        "topic.claim_group_detail": lambda a: views.group_detail(groups, rows, str(a["group_id"])),
        "topic.limitations": lambda a: views.topic_limitations(groups),
    }


def overlay_tools(overlays: DataFrame) -> dict[str, Tool]:
    return {
        "overlay.summary": lambda a: views.overlay_summary(overlays),
        "overlay.groups": lambda a: views.overlay_groups(overlays),
        "overlay.group_detail": lambda a: views.overlay_groups(overlays, str(a["overlay_group_id"])),
        "overlay.limitations": lambda a: overlays.select("overlay_id", "limitations", "policy"),
    }


def words_of(request: object) -> set[str]:
    """All keys and all values of a request, however deep."""
    found, todo = set(), [request]
    while todo:
        x = todo.pop()
        if isinstance(x, (dict, list)):
            todo += [*x, *(x.values() if isinstance(x, dict) else ())]
        else:
            found.add(str(x))
    return found


def answer(request: dict, tools: dict[str, Tool]) -> dict | None:
    """The response to a request; None to a notification."""
    method, ident = request.get("method"), request.get("id")
    reply = lambda **x: {"jsonrpc": "2.0", "id": ident} | x
    if method == "notifications/initialized":
        return None
    if method == "initialize":
        return reply(result={"serverInfo": {"name": "claimloom", "version": "0.1"}, "capabilities": {"tools": {}}, "protocolVersion": "2024-11-05"})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "inputSchema": {"type": "object"}, "annotations": {"readOnlyHint": True}} for n in tools]})
    if method != "tools/call":
        return reply(error={"code": -32601, "message": f"unknown method {method}"})
    params = request.get("params") or {}
    name, args = params.get("name"), params.get("arguments") or {}
    asked = words_of(args) & set(lx.markers("policy", "capability"))
    if name not in tools or asked:
        return reply(error={"code": -32000, "message": f"not allowed: {', '.join(sorted(asked)) or name}"})
    try:
        found = [json.loads(x) for x in tools[name](args).toJSON().collect()]
    except KeyError as e:
        return reply(error={"code": -32000, "message": f"missing argument {e}"})
    ok = bool(found) or not name.endswith("detail")
    body = {"ok": ok, "rows": found} if ok else {"ok": False, "error": "group_not_found"} | args
    return reply(result={"isError": not ok, "content": [{"text": json.dumps(body, ensure_ascii=False, sort_keys=True), "type": "text"}]})


def serve(lines: Iterable[str], write: Callable[[str], None], tools: dict[str, Tool]) -> None:
    """Answer a line of JSON each, blank ones passed over."""
    for line in filter(str.strip, lines):
        try:
            response = answer(json.loads(line), tools)
        except json.JSONDecodeError:
            response = {"error": {"message": "not JSON", "code": -32700}, "id": None, "jsonrpc": "2.0"}
        if response is not None:
            write(f"{json.dumps(response, ensure_ascii=False)}\n")
