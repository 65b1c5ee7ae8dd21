"""python -m veilspan redact|scan|policy: one text, on a local session."""

from __future__ import annotations

import argparse
import json

from .plans.pipeline import Config, redact_batch, scan_batch
from .session import build
from .sources.policies import load


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="veilspan")
    args.add_argument("command", choices=("redact", "scan", "policy"))
    args.add_argument("--text", default="")
    args.add_argument("--country", default="US")
    args.add_argument("--style", default="hash")
    a = args.parse_args(argv)
    if a.command == "policy":
        p = load(a.country)
        print(json.dumps({"country": p.country, "default": p.default, "rules": [[r.label, r.pattern, p.action(r.label)] for r in p.rules]}, indent=1))
        return
    spark, config = build(master="local[2]"), Config(country=a.country, masking_style=a.style)
    found = (redact_batch if a.command == "redact" else scan_batch)(spark, [a.text], config)[0]
    print(json.dumps(found, indent=1, default=str))
    spark.stop()


if __name__ == "__main__":
    main()
