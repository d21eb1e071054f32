"""python -m storyloom COMMAND: the stages of a run, all of them, or the ingest of PDF files."""

from __future__ import annotations

import argparse
import json
import sys

STAGES = {"extract": ("extract",), "canonicalize": ("canonicalize",), "traits": ("traits",), "graph": ("build_graph", "viz"), "eval": ("evaluate",)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="storyloom", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in (*STAGES, "all"):
        c = sub.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        c.add_argument("--input", required=name in ("extract", "traits", "all"), default="", help="a file of passages (JSON Lines) or a folder of them")
        c.add_argument("--output", help="the run's folder; a new one below outputs/ if not given")
        c.add_argument("--confidence", type=float, default=0.65)
        c.add_argument("--max-passages", type=int, help="of each book")
        c.add_argument("--model-name", default="templates", help="what the metrics name the model")
    c = sub.add_parser("ingest", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    c.add_argument("--pdf-root", required=True)
    c.add_argument("--out-root", default="data")
    c.add_argument("--ocr", choices=("auto", "text", "ocr"), default="auto")
    c.add_argument("--only-mode", choices=("text", "ocr"))
    c.add_argument("--min-chars", type=int, default=1200)
    c.add_argument("--max-chars", type=int, default=2000)
    c.add_argument("--overlap", type=int, default=200)
    return p


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from storyloom import ingest, run

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("storyloom").getOrCreate()
    try:
        if a.command == "ingest":
            said = ingest.run(spark, a.pdf_root, a.out_root, a.ocr, a.only_mode, least=a.min_chars, most=a.max_chars, overlap=a.overlap)
        else:
            given = {"output": a.output} if a.output else {}
            s = run.Settings(input=a.input, confidence=a.confidence, max_passages=a.max_passages, model_name=a.model_name, **given)
            said = run.run(spark, s, run.STAGES if a.command == "all" else STAGES[a.command])
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    print(json.dumps(said, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
