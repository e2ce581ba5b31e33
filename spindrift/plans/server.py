"""JSON-RPC over lines of text, for clients that search the index: a thin loop on the driver."""

from __future__ import annotations

import json
import sys
from collections import OrderedDict
from collections.abc import Iterable
from pathlib import Path
from typing import TextIO

from .. import __version__
from .index import Index
from .store import IndexProblem

PROTOCOL = "2024-11-05"
TOOLS = (
    ("search", "Search the documents.", {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1, "maximum": 20}, "profile": {"type": "string", "enum": ["hybrid", "vector"]}}, ["query"]),
    ("info", "Generation, manifest and staleness of the index.", {}, []),
    ("list_topics", "Topics of the glossary.", {}, []),
    ("glossary", "Names of one topic or of all.", {"topic": {"type": "string"}}, []),
)


class Problem(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    """Answers messages. Results of searches are remembered for each generation, up to `most`."""

    def __init__(self, index: Index, corpus_dir: str | None = None, most: int = 64, scheme: str = "spindrift"):
        self.index, self.corpus_dir, self.most, self.prefix = index, corpus_dir, most, f"{scheme}://topic/"
        self.seen: OrderedDict[tuple, list[dict]] = OrderedDict()

    def search(self, text: str, top_k: int = 5, profile: str = "hybrid") -> list[dict]:
        key = self.index.store.current().name, text, top_k, profile
        if key not in self.seen:
            self.seen[key] = [r.asDict() for r in self.index.search(text, top_k, profile).collect()]  # at most top_k rows
            while len(self.seen) > self.most:
                self.seen.popitem(last=False)
        self.seen.move_to_end(key)
        return self.seen[key]

    def tool(self, name: str, given: dict):
        topics = [g["topic"] for g in self.index.glossary]
        if name == "search":
            if not isinstance(given.get("query"), str) or not given["query"].strip():
                raise ValueError("query must be a text")
            return self.search(given["query"], int(given.get("top_k", 5)), given.get("profile", "hybrid"))
        if name == "info":
            return self.index.info(self.corpus_dir)
        if name == "list_topics":
            return [{"topic": g["topic"], "canonical": g.get("canonical") or "", "aliases": list(g.get("aliases") or [])} for g in self.index.glossary]
        if name == "glossary":
            topic = given.get("topic")
            if topic and topic not in topics:
                raise ValueError(f"unknown topic: {topic}")
            return [g for g in self.index.glossary if not topic or g["topic"] == topic]
        raise ValueError(f"unknown tool: {name}")

    def resource(self, uri: str) -> str:
        """The main document of a known topic: its file as it is in the corpus."""
        topic = uri.removeprefix(self.prefix) if isinstance(uri, str) else ""
        if topic == uri or topic not in [g["topic"] for g in self.index.glossary]:
            raise Problem(-32602, f"no resource {uri}")
        corpus = self.corpus_dir or self.index.store.manifest(self.index.store.current())["corpus"]["source"]
        try:
            return (Path(corpus) / topic / "SKILL.md").read_text(encoding="utf-8")
        except OSError:
            raise Problem(-32602, f"no resource {uri}") from None

    def result(self, method: str, params: dict):
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "spindrift", "version": __version__}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, d, p, r in TOOLS]}
        if method == "tools/call":
            try:
                found = self.tool(params.get("name", ""), params.get("arguments") or {})
            except Exception as e:  # whatever fails is the tool's answer; the loop goes on
                body = e.as_dict() if isinstance(e, IndexProblem) else {"code": "RUNTIME_ERROR", "message": str(e) or type(e).__name__, "action": "Check the arguments"}
                return {"content": [{"type": "text", "text": json.dumps(body, ensure_ascii=False)}], "isError": True}
            return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "structuredContent": found, "isError": False}
        if method == "resources/list":
            return {"resources": [{"uri": self.prefix + g["topic"], "name": g["canonical"], "mimeType": "text/markdown"} for g in self.index.glossary]}
        if method == "resources/read":
            uri = params.get("uri", "")
            return {"contents": [{"uri": uri, "mimeType": "text/markdown", "text": self.resource(uri)}]}
        raise Problem(-32601, f"no method {method}")

    def answer(self, line: str) -> str | None:
        """The answer to one line; None for notifications and what is no request."""
        try:
            message = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "this is not JSON"}})
        if not isinstance(message, dict) or "id" not in message:
            return None
        out = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            out["result"] = self.result(message.get("method", ""), message.get("params") or {})
        except Problem as e:
            out["error"] = {"code": e.code, "message": str(e)}
        except Exception as e:  # an index that is missing, or a failed job, ends no session
            out["error"] = {"code": -32603, "message": str(e) or type(e).__name__} | ({"data": e.as_dict()} if isinstance(e, IndexProblem) else {})
        return json.dumps(out, ensure_ascii=False)

    def serve(self, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
        for line in lines:
            if line.strip() and (answer := self.answer(line)) is not None:
                out.write(answer + "\n")
                out.flush()


def smoke(index: Index, query: str | None = None) -> dict:
    """Sends a server the messages of a client's start, and a search if a query is given; says whether the answers are right."""
    asked = [("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "info"})]
    if query:
        asked.append(("tools/call", {"name": "search", "arguments": {"query": query}}))
    server = Server(index)
    answers = [json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}))).get("result", {}) for i, (m, p) in enumerate(asked)]
    names = [t["name"] for t in answers[1].get("tools", [])]
    out = {"protocol_version": answers[0].get("protocolVersion"), "tools": names, "info_ready": answers[2].get("isError") is False}
    out["ok"] = out["protocol_version"] == PROTOCOL and names == [t[0] for t in TOOLS] and out["info_ready"]
    if query:
        hits = answers[3].get("structuredContent") or []
        out["query_ok"] = bool(hits) and {"source", "heading", "raw_score", "rank"} <= set(hits[0])
        out["ok"] = out["ok"] and out["query_ok"]
    return out
