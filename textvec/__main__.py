"""python -m textvec convert | verify | inspect | tokenize | embed | cache-path"""

from __future__ import annotations

import argparse
import json
import sys

from textvec.errors import Error
from textvec.operators.embed import Tokenizer, capped, pool
from textvec.sources import container


def _limit(text: str) -> int | bool:
    return False if text in ("unlimited", "0") else int(text)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textvec")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("convert")
    p.add_argument("source")
    p.add_argument("--out", required=True)
    p.add_argument("--id")
    p.add_argument("--max-tokens", type=_limit, help="a positive number, or unlimited")
    p.add_argument("--dimensions", type=int)
    p.add_argument("--truncation", type=lambda x: x.replace("-", "_"), choices=("raw_ids", "usable_ids"))
    p.add_argument("--revision", help="of the source; recorded")
    p.add_argument("--trained-mrl-dims", type=lambda x: [int(n) for n in x.split(",")], help="1024,512,...; recorded")
    for name in ("verify", "inspect"):
        commands.add_parser(name).add_argument("path")
    for name in ("tokenize", "embed"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("text")
    commands.add_parser("cache-path")
    a = parser.parse_args(argv)
    try:
        if a.command == "convert":
            container.save(container.convert(a.source, a.dimensions, a.max_tokens, a.truncation, a.id, a.revision, a.trained_mrl_dims), a.out)
            print(json.dumps(container.inspect(a.out)))
        elif a.command == "verify":
            good, stored, computed = container.verify(a.path)
            print(json.dumps({"ok": good, "stored": stored, "computed": computed}))
            return int(not good)
        elif a.command == "inspect":
            print(json.dumps(container.inspect(a.path)))
        elif a.command == "cache-path":
            print(container.cache_dir())
        else:
            model = container.load(a.path)
            m, ids = model.meta, Tokenizer(model).ids(a.text)
            if a.command == "tokenize":
                print(json.dumps({"ids": ids, "count": len(ids), "unk": ids.count(m.unk_id)}))
            else:
                ids, cut = capped(ids, m.max_tokens, m.unk_id, m.truncation == "usable_ids" and m.unk_policy == "drop")
                unk = ids.count(m.unk_id)
                if ids and unk / len(ids) > 0.3:
                    print(f"warning: {unk} of {len(ids)} tokens are unknown", file=sys.stderr)
                if (n := len(a.text.split())) and len(ids) / n > 2.5:
                    print(f"warning: {len(ids)} tokens for {n} words", file=sys.stderr)
                print(json.dumps({"token_count": len(ids), "unk_count": unk, "truncated": cut, "vector": [round(float(x), 6) for x in pool(model, ids)[0]]}))
    except Error as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
