"""The tool API: validated calls over a library, answered as plain values; and its JSON-RPC envelope."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, query_segments
from ..functions.texts import history_id, since_utc, truncated
from ..models import MAX_RESULTS, MODELS, Model, clamp, positive
from . import items as it
from . import search as s
from . import store

DAY = re.compile(r"\d{4}(-\d\d){2}")
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")


class ToolError(ValueError):
    """A call that its arguments or the library don't allow."""


def _text(args: dict, name: str) -> str:
    v = args.get(name)
    if not isinstance(v, str) or not v.strip():
        raise ToolError(f"{name} must be a non-empty string")
    return v.strip()


def _day(args: dict, name: str) -> str | None:
    v = args.get(name)
    if v is not None and (not isinstance(v, str) or not DAY.fullmatch(v)):
        raise ToolError(f"{name} must be a day YYYY-MM-DD")
    return v


def _strings(args: dict, name: str) -> list[str]:
    v = args.get(name) or []
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise ToolError(f"{name} must be a list of strings")
    return v


class Library:
    """Tables of a library and the calls on them. Results are small: limits are clamped, and only they are collected.

    passages, items, attachments, deleted (item_id), excluded and history are DataFrames (see schemas).
    """

    def __init__(self, passages: DataFrame, items: DataFrame, attachments: DataFrame, deleted: DataFrame, excluded: DataFrame, history: DataFrame, model: Model | str, encoder: Encoder):
        self.model = MODELS[model] if isinstance(model, str) else model
        self.passages = s.usable(passages.where(F.col("model") == self.model.id), self.model.dim)
        self.items, self.attachments, self.deleted, self.excluded, self.history, self.encoder = items, attachments, deleted, excluded, history, encoder
        self.spark = passages.sparkSession

    def state(self) -> str:
        return store.state_key(self.passages).first().state

    def semantic_search(self, args: dict) -> dict:
        query = _text(args, "query")
        limit = clamp(args.get("limit"), 1, 100, 10)
        least = positive(args.get("min_similarity"), self.model.tool_min_similarity)
        types, since = _strings(args, "item_types"), _day(args, "added_after")
        rows, cached = None, False
        if args.get("use_cache"):
            # the reader's own search is looked up, whatever asks
            name = self.spark.range(1).select(history_id(F.lit(query), F.lit(self.model.id), F.lit("manual")).alias("id")).first().id
            old = store.reusable(self.history.where(F.col("id") == name), self.state(), least)
            found = old.select(F.inline("results")).withColumnRenamed("folder_id", "id").select("id", "section_number", "rowid", "similarity")
            if found.limit(1).count():
                rows, cached = found, True
        if rows is None:
            q = self.spark.createDataFrame([(0, i, v) for i, _, v in query_segments(query, self.encoder, self.model)], "qid long, segment int, vec array<double>")
            keys = None
            if since:
                fresh = it.added_since(self.attachments, self.items, since_utc(F.lit(since)))
                keys = fresh.select(F.col("key").alias("id"))
            rows = s.rank(self.passages.select("rowid", "id", "section_number", "embedding"), q, least, MAX_RESULTS, keys)
        rows = rows.select("rowid", "id", "section_number", "similarity")
        about = it.described(self.attachments, self.items).withColumnRenamed("key", "id")
        met = rows.join(about, "id", "left").join(self.passages.select("rowid", "chunk_text", "page"), "rowid", "left")
        if types:  # on cached rows too
            met = met.where(F.col("item_type").isin(types))
        if args.get("group_by_item"):
            met = s.best_per_document(met.withColumn("qid", F.lit(0))).drop("qid")
        total = met.count()
        met = met.where(~F.coalesce("missing", F.lit(False))).withColumn("text", truncated(F.col("chunk_text")))
        best = met.orderBy(F.desc("similarity"), "rowid").limit(limit).collect()
        out = {"query": query, "from_cache": cached, "total_matches": total, "results": [self._row(r) for r in best]}
        return out if best else out | {"note": "Nothing is as similar as that. Try other words or a lower min_similarity."}

    @staticmethod
    def _row(r: Any) -> dict:
        row = {"attachment_key": r.id, "section": r.section_number, "similarity": int(r.similarity * 1e4 + 0.5) / 1e4, "title": r.title, "authors": r.authors, "year": r.year, "item_type": r.item_type}
        row["date_added"] = str(r.date_added)[:10] if r.date_added else None
        row["page"] = None if r.page is None else r.page + 1
        row["text"] = r.text
        return {k: v for k, v in row.items() if v is not None}

    def get_passage(self, args: dict) -> dict:
        key, section = _text(args, "attachment_key"), args.get("section")
        if not isinstance(section, int) or isinstance(section, bool) or section < 0:
            raise ToolError("section must be a whole number from 0")
        wanted = self.spark.createDataFrame([(key, section)], "id string, section_number int")
        got = s.context(self.passages, wanted, clamp(args.get("context"), 0, 5, 1)).first()
        if got is None:
            raise ToolError(f"no passage {section} of {key}")
        return {"attachment_key": key, "section": section, "text": got.text}

    def get_item(self, args: dict) -> dict:
        key = _text(args, "key")
        item = self.items.where(F.col("key") == key).first()
        if item is None:
            raise ToolError(f"no item {key}")
        files = self.attachments.where(F.col("parent_id") == item.item_id).select("key", "content_type").orderBy("key").limit(100).collect()
        creators = [c.name or " ".join(x for x in (c.first_name, c.last_name) if x) for c in item.creators or []]
        fields = dict(item.fields or {})
        cited = ", ".join(x for x in ("; ".join(creators), (fields.get("date") or "")[:4], item.title) if x)
        return {"key": key, "item_type": item.item_type, "title": item.title, "creators": creators, "fields": fields, "tags": list(item.tags or []), "citation": cited, "attachments": [r.asDict() for r in files]}

    def find_similar_items(self, args: dict) -> dict:
        key = _text(args, "key")
        own = s.approximate_centroids(self.passages.where(F.col("id") == key))
        if own.first() is None:
            raise ToolError(f"{key} isn't indexed")
        gone = self.attachments.join(self.deleted.select("item_id").distinct(), "item_id", "left_semi").select(F.col("key").alias("id"))
        got = s.similar_documents(self.passages, own, clamp(args.get("limit"), 1, 50, 10), gone)
        return {"key": key, "results": [{"attachment_key": r.id, "similarity": int(r.best * 1e4 + 0.5) / 1e4} for r in got.orderBy("rank").collect()]}

    def index_status(self, args: dict) -> dict:
        n = self.passages.agg(F.count(F.lit(1)).alias("p"), F.count_distinct("id").alias("d")).first()
        reasons = {r.reason: r.n for r in self.excluded.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"model": self.model.id, "documents": n.d, "passages": n.p, "excluded": reasons, "state": self.state()}

    def list_attachments_without_parent(self, args: dict) -> dict:
        since = _day(args, "added_after")
        df = it.orphans(self.attachments, self.deleted)
        if since:
            df = df.where(F.col("date_added") >= since_utc(F.lit(since)))
        total, page = it.paged(df, [F.desc("date_added"), F.asc("item_id")], clamp(args.get("limit"), 1, 200, 50), clamp(args.get("offset"), 0, 1 << 31, 0))
        return {"total": total.first().total, "attachments": [r.key for r in page.select("key").collect()]}

    def list_saved_searches(self, args: dict) -> dict:
        got = store.latest(self.history).orderBy(F.desc("date"), "id").limit(clamp(args.get("limit"), 1, 200, 20)).collect()
        return {"searches": [{"query": r.query, "date": str(r.date), "source": r.source or "manual", "results": r.n_results} for r in got]}

    def _new(self, args: dict) -> dict:
        fields = args.get("fields") or {}
        if not isinstance(fields, dict):
            raise ToolError("fields must be an object")
        return {"item_type": _text(args, "item_type"), "title": _text(args, "title"), "fields": {str(k): str(v) for k, v in fields.items()}, "tags": _strings(args, "tags"), "creators": self._creators(args)}

    @staticmethod
    def _creators(args: dict) -> list[dict]:
        found = args.get("creators") or []
        if not isinstance(found, list) or not all(isinstance(c, dict) and (c.get("name") or c.get("last_name")) for c in found):
            raise ToolError("creators must be a list of objects with a name")
        names = ("first_name", "last_name", "name", "creator_type")
        return [{k: c.get(k) for k in names} | {"creator_type": c.get("creator_type") or "author"} for c in found]

    def create_item(self, args: dict) -> dict:
        """The edit that appends an item; refused if one with the same identifier exists, unless allowed."""
        new = self._new(args)
        if not args.get("allow_duplicate"):
            row = self.spark.createDataFrame([(-1, new["fields"])], "item_id long, fields map<string,string>")
            same = it.same_identifier(row, self.items).orderBy("item_id").first()
            if same:
                raise ToolError(f"item {same.item_id} has the same identifier")
        return {"append_item": new | {"collections": self._collections(_strings(args, "collections"))}}

    def _collections(self, wanted: list[str]) -> list[str]:
        if not wanted:
            return []
        known = [r.c for r in self.items.select(F.explode("collections").alias("c")).distinct().where(F.lower("c").isin([w.lower() for w in wanted])).limit(1000).collect()]
        out = []
        for w in wanted:
            same = [c for c in known if c == w] or [c for c in known if c.lower() == w.lower()]
            if len(same) != 1:
                raise ToolError(f"{len(same)} collections are called {w}")
            out += same
        return out

    def create_parent_item(self, args: dict) -> dict:
        """The edits that give an attachment a parent, which takes its collections over."""
        key = _text(args, "attachment_key")
        row = self.attachments.where(F.col("key") == key).first()
        if row is None or row.parent_id is not None:
            raise ToolError(f"{key} is no attachment without a parent")
        own = self.items.where(F.col("item_id") == row.item_id).select("collections").first()
        return {"append_item": self._new(args) | {"collections": list(own.collections or []) if own else []}, "set_parent": {"attachment_key": key, "collections": []}}


TOOLS = {
    "semantic_search": ["query"],
    "get_passage": ["attachment_key", "section"],
    "get_item": ["key"],
    "find_similar_items": ["key"],
    "index_status": [],
    "list_attachments_without_parent": [],
    "create_parent_item": ["attachment_key", "item_type", "title"],
    "create_item": ["item_type", "title"],
    "list_saved_searches": [],
}


def respond(message: Any, library: Any) -> Any:
    """The answer to a JSON-RPC message or batch; None to notifications."""
    if isinstance(message, list):
        if not message:
            return _error(None, -32600, "empty batch")
        return [a for a in (respond(m, library) for m in message) if a is not None] or None
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return _error(message.get("id") if isinstance(message, dict) else None, -32600, "not a request")
    if "id" not in message:
        return None
    k, method, params = message["id"], message["method"], message.get("params") or {}
    if method == "initialize":
        asked = params.get("protocolVersion")
        return _result(k, {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "glossator", "version": "1"}})
    if method == "ping":
        return _result(k, {})
    if method == "tools/list":
        return _result(k, {"tools": [{"name": n, "inputSchema": {"type": "object", "required": r}} for n, r in TOOLS.items()]})
    if method in ("resources/list", "prompts/list"):
        return _result(k, {method.partition("/")[0]: []})
    if method != "tools/call":
        return _error(k, -32601, f"no method {method}")
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS or not isinstance(args, dict):
        return _error(k, -32602, f"no tool {name}" if name not in TOOLS else "arguments must be an object")
    try:
        value = getattr(library, name)(args)
    except ToolError as e:
        return _result(k, {"isError": True, "content": [{"type": "text", "text": str(e)}]})
    except Exception as e:  # noqa: BLE001 - the caller gets any failure as an answer
        return _error(k, -32603, f"{type(e).__name__}: {e}")
    return _result(k, {"structuredContent": value, "content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}]})


def _result(k: Any, value: dict) -> dict:
    return {"jsonrpc": "2.0", "id": k, "result": value}


def _error(k: Any, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": k, "error": {"code": code, "message": text}}


def serve(lines: Iterable[str], library: Any, write: Callable[[str], Any]) -> None:
    """Answer messages, one JSON text a line."""
    for answer in answers(lines, library):
        write(json.dumps(answer, ensure_ascii=False) + "\n")


def answers(lines: Iterable[str], library: Any) -> Iterator[Any]:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            yield _error(None, -32700, "not JSON")
            continue
        answer = respond(message, library)
        if answer is not None:
            yield answer
