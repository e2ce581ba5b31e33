"""Command line: build, query, info, doctor, serve."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("verb", choices=["build", "query", "info", "doctor", "serve"])
    parser.add_argument("text", nargs="?", help="for query")
    parser.add_argument("--index", required=True)
    parser.add_argument("--corpus")
    parser.add_argument("--glossary", help="JSON file")
    parser.add_argument("--phrases", help="JSON file")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--profile", default="hybrid", choices=["hybrid", "vector"])
    parser.add_argument("--demote-frontmatter", action="store_true")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--append", action="store_true")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--smoke", action="store_true", help="for doctor: try the server, with a search for TEXT if given")
    parser.add_argument("--version", action="version", version=__version__)
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from .plans.index import Index, format_results
    from .plans.server import Server, smoke
    from .plans.store import CorpusNotFound, IndexProblem

    def load(path, empty):
        if not path:
            return empty
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    index = Index(SparkSession.builder.appName("spindrift").getOrCreate(), given.index, glossary=load(given.glossary, []), phrases=load(given.phrases, {}).items())
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2))
    try:
        if given.verb == "build":
            if not given.corpus:
                raise CorpusNotFound("no corpus folder is given")
            show(index.build(given.corpus, given.force, given.append))
        elif given.verb == "query":
            hits = [r.asDict() for r in index.search(given.text or "", given.top_k, given.profile, given.demote_frontmatter).collect()]
            show(hits) if given.json else print(format_results(hits, given.text or ""))
        elif given.verb == "info":
            show(index.info(given.corpus))
        elif given.verb == "doctor":
            found = index.doctor(given.corpus)
            if given.smoke:
                found["server"] = smoke(index, given.text)
                found["ok"] = found["ok"] and found["server"]["ok"]
            show(found)
            return 0 if found["ok"] else 1
        else:
            Server(index, given.corpus).serve()
    except IndexProblem as e:
        show({"error": e.as_dict()})
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
