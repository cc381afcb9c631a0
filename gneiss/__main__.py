"""Command line: ``python -m gneiss init|update|status ROOT FOLDER`` and ``python -m gneiss query FOLDER NAME [options]``.

``set-summary FOLDER``, ``set-descriptors FOLDER FILE`` (a JSON object of texts by path) and ``set-embeddings FOLDER FILE``
(a packed vector file) keep what is made elsewhere; ``import-json FOLDER FILE`` takes a map that is one JSON document.
"""

from __future__ import annotations

import argparse
import json

from gneiss.plans import analysis
from gneiss.session import local_session


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gneiss")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "update", "status"):
        p = commands.add_parser(name)
        p.add_argument("root")
        p.add_argument("folder")
        if name == "init":
            p.add_argument("--max-commits", type=int, default=0)
    p = commands.add_parser("set-summary")
    p.add_argument("folder")
    for depth in (1, 3, 10):
        p.add_argument(f"--depth{depth}", required=True)
    for name in ("set-descriptors", "set-embeddings", "import-json"):
        p = commands.add_parser(name)
        p.add_argument("folder")
        p.add_argument("file")
    p = commands.add_parser("query")
    p.add_argument("folder")
    p.add_argument("name", choices=sorted(analysis.QUERIES))
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--path", default="")
    p.add_argument("--text", default="")
    p.add_argument("--files", nargs="*", default=[])
    p.add_argument("--min-changes", type=int, default=2)
    p.add_argument("--depth", type=int, choices=(1, 3, 10))
    p.add_argument("--community", type=int)
    asked = parser.parse_args(args)
    spark = local_session()
    if asked.command == "query":
        options = analysis.Options(top=asked.top, path=asked.path, text=asked.text, files=asked.files, min_changes=asked.min_changes, depth=asked.depth, community=asked.community)
        for line in analysis.query(analysis.load(spark, asked.folder), asked.name, options).toJSON().collect():
            print(line)
    elif asked.command == "init":
        analysis.init(spark, asked.root, asked.folder, asked.max_commits)
    elif asked.command == "set-summary":
        analysis.set_summary(spark, asked.folder, asked.depth1, asked.depth3, asked.depth10)
    elif asked.command == "set-descriptors":
        with open(asked.file, encoding="utf-8") as f:
            print(analysis.set_descriptors(spark, asked.folder, json.load(f)))
    elif asked.command == "set-embeddings":
        print(analysis.set_embeddings(spark, asked.folder, asked.file))
    elif asked.command == "import-json":
        analysis.import_json(spark, asked.file, asked.folder)
    else:
        print(getattr(analysis, asked.command)(spark, asked.root, asked.folder))


if __name__ == "__main__":
    main()
