import io
import json

import pytest

from spindrift.__main__ import main
from spindrift.plans.index import Index
from spindrift.plans.server import Server, smoke


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("server")
    doc = root / "corpus" / "ue-audio" / "SKILL.md"
    doc.parent.mkdir(parents=True)
    doc.write_text("# Audio\nSound attenuation and music.\n")
    index = Index(spark, str(root / "index"), glossary=[{"topic": "ue-audio", "canonical": "audio", "aliases": ["声音"], "identifiers": ["MetaSound"]}])
    index.build(str(root / "corpus"))
    return root, index


def ask(server, method, params=None, **extra):
    return json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params or {}} | extra)))


def test_methods_and_errors(built):
    server = Server(built[1])
    assert ask(server, "initialize")["result"]["protocolVersion"] and ask(server, "ping")["result"] == {}
    assert [t["name"] for t in ask(server, "tools/list")["result"]["tools"]] == ["search", "info", "list_topics", "glossary"]
    found = ask(server, "tools/call", {"name": "search", "arguments": {"query": "声音"}})["result"]
    assert json.loads(found["content"][0]["text"])[0]["source"] == "ue-audio/SKILL.md" and not found["isError"]
    assert len(server.seen) == 1
    assert ask(server, "tools/call", {"name": "search", "arguments": {"query": "x", "profile": "other"}})["result"]["isError"]
    assert json.loads(ask(server, "tools/call", {"name": "info"})["result"]["content"][0]["text"])["stale"] is False
    assert ask(server, "tools/call", {"name": "glossary", "arguments": {"topic": "no"}})["result"]["isError"]
    assert ask(server, "tools/call", {"name": "other"})["result"]["isError"] and ask(server, "other")["error"]["code"] == -32601
    assert ask(server, "tools/call", {"name": "list_topics"})["result"]["structuredContent"] == [{"topic": "ue-audio", "canonical": "audio", "aliases": ["声音"]}]
    assert ask(server, "resources/list")["result"]["resources"][0]["uri"] == "spindrift://topic/ue-audio"
    assert "attenuation" in ask(server, "resources/read", {"uri": "spindrift://topic/ue-audio"})["result"]["contents"][0]["text"]
    assert ask(server, "resources/read", {"uri": "spindrift://topic/../x"})["error"]["code"] == -32602
    out = io.StringIO()
    server.serve(["not json\n", "\n", "[1]\n", '{"method": "ping"}\n', '{"id": 7, "method": "ping"}\n'], out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert lines[0]["error"]["code"] == -32700 and lines[1]["id"] == 7 and len(lines) == 2


def test_a_missing_index_ends_no_session(spark, tmp_path):
    glossary = [{"topic": "t", "canonical": "t", "aliases": [], "identifiers": []}]
    server = Server(Index(spark, str(tmp_path / "none"), glossary=glossary))
    assert ask(server, "resources/read", {"uri": "spindrift://topic/t"})["error"]["data"]["code"] == "INDEX_NOT_FOUND"
    assert ask(server, "tools/call", {"name": "info"})["result"]["isError"] and ask(server, "ping")["result"] == {}


def test_smoke(built):
    assert smoke(built[1], "music")["ok"] and not smoke(Index(built[1].spark, str(built[0] / "nowhere")))["ok"]


def test_command_line(built, capsys, tmp_path):
    root, _ = built
    assert main(["query", "music", "--index", str(root / "index"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["heading"] == "Audio"
    assert main(["doctor", "--index", str(root / "index"), "--corpus", str(root / "corpus")]) == 0
    capsys.readouterr()
    assert main(["info", "--index", str(tmp_path)]) == 1
    assert json.loads(capsys.readouterr().out)["error"]["code"] == "INDEX_NOT_FOUND"
