"""python -m kryptonym [--no-ner] [--no-dict] FILE... | --restore FILE... [KEYS.json] | --serve [PORT] (token in KRYPTONYM_TOKEN)"""

from __future__ import annotations

import os
import sys

from kryptonym.operators.masker import Config
from kryptonym.operators.requests import MAX_BODY, build_layers
from kryptonym.service import Service, server
from kryptonym.sources.files import load_dictionary, mask_paths, restore_paths

DICTIONARY = "словарь_клиентов.txt"


def main(args: list[str]) -> int:
    if not args or args == ["--restore"]:
        print(__doc__)
        return 1
    if args[0] == "--serve":
        config, status = build_layers(tuple(load_dictionary(DICTIONARY)))
        service = Service(os.environ.get("KRYPTONYM_TOKEN", ""), config, status, os.environ.get("KRYPTONYM_MAX_BODY", MAX_BODY))
        server(service, port=int(args[1]) if len(args) > 1 else 8000).serve_forever()
    if args[0] == "--restore":
        keys = args[-1] if args[-1].endswith(".json") else None
        made, errors = restore_paths(args[1:-1] if keys else args[1:], keys)
    else:
        paths = [a for a in args if a not in ("--no-ner", "--no-dict")]
        entries = () if "--no-dict" in args else tuple(load_dictionary(DICTIONARY))
        config = Config(dictionary=entries)
        if "--no-ner" not in args:
            config, status = build_layers(entries)
            print(", ".join(f"{k}: {v}" for k, v in status.items()))
        made, errors, counts, key_file = mask_paths(paths, config)
        for label, n in counts.items():
            print(f"{label}: {n}")
        print(f"keys: {key_file.name}" if key_file else "nothing to mask")
    for p in made:
        print(p)
    for e in errors:
        print(f"failed: {e}", file=sys.stderr)
    return int(bool(errors))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
