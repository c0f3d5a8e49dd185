"""Command line: ``python -m tomeweave.cli <job> ...`` or through spark-submit."""

from __future__ import annotations

import argparse
import importlib
import sys

from tomeweave import jobs
from tomeweave.constants import CATEGORIES, EVAL_BATCH, QA_BATCH, QA_OVERLAP
from tomeweave.models.boundary import CATEGORY_RETRY, EMBED_RETRY, EVALUATION_RETRY, HashedEmbedder
from tomeweave.operators.tables import TableStore
from tomeweave.session import build_session


def _load(spec: str | None, default=None):
    """An object named ``module:attribute``; a class is called without arguments."""
    if not spec:
        if default is None:
            raise SystemExit("--model module:object is required")
        return default
    module, _, name = spec.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found() if isinstance(found, type) else found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tomeweave")
    jobs_ = top.add_subparsers(dest="job", required=True)

    def job(name: str, *, store: bool = True) -> argparse.ArgumentParser:
        p = jobs_.add_parser(name)
        p.add_argument("--master")
        p.add_argument("--shuffle-partitions", type=int, help="about one per 200 MB that is shuffled")
        if store:
            p.add_argument("--store", required=True, help="folder of the stored tables")
        return p

    p = job("ingest", store=False)
    p.add_argument("--dir", required=True)
    p.add_argument("--universe", required=True)
    p.add_argument("--store", help="where to store the chunks; without it only the summary is shown")
    p.add_argument("--output")
    p.add_argument("--recursive", action="store_true")
    p = job("sections", store=False)
    p.add_argument("--root", required=True)
    p.add_argument("--series", required=True)
    p.add_argument("--context-window", type=int, required=True)
    p.add_argument("--safety-margin", type=float, default=0.10)
    p.add_argument("--store")
    p.add_argument("--output")
    p = job("embed")
    p.add_argument("--universe", required=True)
    p.add_argument("--path", required=True)
    p.add_argument("--model")
    p = job("load")
    p.add_argument("--path", required=True)
    p = job("qna")
    p.add_argument("--series", required=True)
    p.add_argument("--category", required=True, choices=[c for c, _ in CATEGORIES])
    p.add_argument("--model")
    p.add_argument("--batch-size", type=int, default=QA_BATCH)
    p.add_argument("--batch-overlap", type=int, default=QA_OVERLAP)
    p.add_argument("--no-skip-processed", action="store_true")
    p = job("evaluation")
    p.add_argument("--series", required=True)
    p.add_argument("--model")
    p.add_argument("--batch-size", type=int, default=EVAL_BATCH)
    p.add_argument("--start-batch", type=int, default=0)
    p.add_argument("--max-batches", type=int)
    p.add_argument("--no-skip-processed", action="store_true")
    p = job("ontology")
    p.add_argument("--series", nargs="+", required=True)
    p.add_argument("--model")
    p = job("extract")
    p.add_argument("--series", required=True)
    p.add_argument("--model")
    p = job("stats")
    p.add_argument("--series")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    sizes = {"spark.sql.shuffle.partitions": str(args.shuffle_partitions)} if args.shuffle_partitions else {}
    spark = build_session(f"tomeweave-{args.job}", args.master, **sizes)
    store = TableStore(spark, args.store) if args.store else None
    try:
        if args.job == "ingest":
            jobs.ingest(spark, args.dir, args.universe, store, args.recursive, args.output).show(truncate=False)
        elif args.job == "sections":
            jobs.pack_series(
                spark, args.root, args.series, args.context_window, args.safety_margin, store, args.output
            ).drop("text_content").show(50, truncate=False)
        elif args.job == "embed":
            jobs.embed(store, args.universe, args.path, _load(args.model, HashedEmbedder()), EMBED_RETRY)
        elif args.job == "load":
            print(jobs.load_vectors(store, args.path))
        elif args.job == "qna":
            print(
                jobs.generate_category_pairs(
                    store, args.series, args.category, _load(args.model), CATEGORY_RETRY, args.batch_size,
                    args.batch_overlap, not args.no_skip_processed,
                )
            )
        elif args.job == "evaluation":
            print(
                jobs.generate_evaluation_pairs(
                    store, args.series, _load(args.model), EVALUATION_RETRY, args.batch_size, args.start_batch,
                    args.max_batches, not args.no_skip_processed,
                )
            )
        elif args.job == "ontology":
            print(jobs.generate_ontology(store, args.series, _load(args.model), CATEGORY_RETRY))
        elif args.job == "extract":
            print(jobs.extract_series(store, args.series, _load(args.model), CATEGORY_RETRY))
        elif args.series:
            jobs.qa_report(store, args.series).show(100, truncate=False)
        else:
            store.counts().show()
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
