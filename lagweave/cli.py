"""Commands: preprocess, sort-transactions, sort-dataset, encode, materialize, search, analyze,
report, compare, runs, validate.  Exit codes: 0 passed, 1 a check failed, 2 usage, 130 interrupted."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .functions.windows import FAMILIES
from .operators import encoding, preprocess, validation
from .plans.archive import Archive, Member
from .plans.bundle import Bundle, Lifecycle, open_bundle
from .plans.cache import FeatureCache
from .plans.comparison import comparison_report, run_rows
from .plans.expressions import from_document
from .plans.final import both_reports
from .plans.report import final_tables, write_final, write_report
from .plans.scoring import Evaluator
from .plans.search import CANDIDATES, GENERATIONS, STRATEGIES, UNBOUND, Batch, Search
from .plans.tracking import RunCatalog
from .session import build_session
from .sources import tables


def _pipeline(spark, a) -> None:
    """One lazy chain per table and one write each."""
    raw = tables.read_parquet(spark, a.transactions)
    cards = tables.read_parquet(spark, a.cards) if a.cards else None
    merchants = tables.read_parquet(spark, a.merchants) if a.merchants else None
    dataset = preprocess.dataset_layout(tables.read_parquet(spark, a.dataset))
    tables.write_parquet(dataset, f"{a.output}/dataset.parquet", a.force, [a.dataset])
    enriched = preprocess.enrich(raw, cards, merchants)
    columns = [c for c in encoding.ENCODED if c in enriched.columns]
    mapping = encoding.fit_mapping(enriched, tables.read_parquet(spark, a.dataset), columns)
    tables.write_json(f"{a.output}/mapping.json", mapping, force=True)
    encoded = encoding.encode(enriched, mapping)
    tables.write_parquet(preprocess.transaction_layout(encoded), f"{a.output}/transactions.parquet", a.force, [a.transactions])
    tables.materialize(tables.read_parquet(spark, f"{a.output}/transactions.parquet"), f"{a.output}/columns", a.force)


def _tx_and_events(spark, folder):
    tx = tables.load_columns(spark, f"{folder}/columns")
    named = tx.select(F.col("merchant_id").alias("m"), F.col("created_at").alias("t"), F.monotonically_increasing_id().alias("id"), "amount", *(c for c in FAMILIES if c in tx.columns))
    data = tables.read_parquet(spark, f"{folder}/dataset.parquet")
    events = data.select(F.monotonically_increasing_id().alias("id"), F.col("merchant_id").alias("m"), tables.micros("event_timestamp", data.schema["event_timestamp"].dataType).alias("t"), "label", "split")
    return named.persist(), events.persist()


def _codes(folder):
    mapping = tables.read_json(f"{folder}/mapping.json")
    return mapping, [sorted(set(mapping.get(f, {}).values())) for f in FAMILIES]


def _search(spark, a) -> None:
    """A search in a staging folder that becomes the run's folder when it is done."""
    catalog = RunCatalog(a.catalog)
    run_id = catalog.create(a.strategy, a.seed, a.group, {"seconds": a.seconds, "size": a.size, "depth": a.depth})
    bundle = Bundle(f"{a.output}/{run_id}", run_id, a.strategy)
    try:
        mapping, codes = _codes(a.input)
        lifecycle = Lifecycle(bundle.staging, mapping, CANDIDATES.names, GENERATIONS.names)
        if a.strategy == UNBOUND:
            batch = Batch(codes, a.size, a.depth)
            batch.run(lifecycle)
            batch.save(str(bundle.staging))
        else:
            tx, events = _tx_and_events(spark, a.input)
            search = Search.build(a.strategy, Evaluator(tx, events, codes, cache=FeatureCache(a.cache) if a.cache else None), a.size, a.depth, a.seed)
            search.run(a.seconds, a.generations, lifecycle)
            search.save(spark, str(bundle.staging), mapping, rows=False)
            search.evaluator.close()
        bundle.publish({"mapping": f"{a.input}/mapping.json"}, {"seed": a.seed})
        catalog.move(run_id, "search_complete")
    except BaseException as error:
        bundle.fail(error)
        catalog.move(run_id, *(("interrupted",) if isinstance(error, KeyboardInterrupt) else ("search_failed", str(error))))
        raise
    print(run_id)


def _analyze(spark, a) -> None:
    """Final evaluation of a finished search, or again of one whose analysis failed."""
    catalog = RunCatalog(a.catalog)
    catalog.require(a.run, ("search_complete", "analysis_failed"), "analyze")
    try:
        folder = open_bundle(f"{a.output}/{a.run}")
        tx, events = _tx_and_events(spark, a.input)
        mapping, codes = _codes(a.input)
        if (folder / "expressions.json").exists():
            members = [Member(from_document(d), []) for d in tables.read_json(folder / "expressions.json")]
        else:
            members = list({m.key: m for m in Archive.from_document(tables.read_json(folder / "archive.json"), mapping).members}.values())
        trees = [m.expr for m in members]
        forest, additive = both_reports(tx, events, trees, codes, n_trees=a.trees)
        metrics = {"forest_train_auc": forest["train_auc"], "forest_test_auc": forest["test_auc"], "additive_train_auc": additive["train_auc"], "additive_test_auc": additive["test_auc"]}
        rows = events.filter("split = 'train'").count()
        write_final(folder, final_tables(spark, forest, members, codes, rows), {**metrics, "correlation_training_row_count": rows}, force=True)
        catalog.log_metrics(a.run, metrics)
        catalog.move(a.run, "complete")
        print(f"forest\t{forest['test_auc']:.6f}\nadditive\t{additive['test_auc']:.6f}")
    except Exception as error:
        catalog.move(a.run, "analysis_failed", str(error))
        raise


def _check(spark, a) -> int:
    read = lambda p: tables.read_parquet(spark, p)
    show = lambda v: "NULL" if v is None else v
    if a.check == "transactions-sorted":
        bad = validation.first_sort_violation(validation.stored_positions(read(a.input)), "position").collect()
        if not bad:
            print(f"PASS: {a.input} is sorted by merchant_id, created_at")
            return 0
        b = bad[0]
        print(f"FAIL: {a.input} is not sorted\nFirst violation at row {b.position}:\n  previous: merchant_id={b.previous_merchant}, created_at={b.previous_created}\n"
              f"  current:  merchant_id={b.merchant}, created_at={b.created}")
        return 1
    if a.check == "null-percentages":
        paths = tables.dataset_paths(a.input, a.recursive)
        if not paths:
            print(f"No parquet datasets found in {a.input}", file=sys.stderr)
            return 2
        print("dataset\tcolumn\trows\tnull_count\tnull_percent")
        for path in paths:
            for r in validation.null_report(read(path)).collect():
                print(f"{path.relative_to(a.input)}\t{r.column}\t{r.rows}\t{r.null_count}\t{r.null_percent:.6f}%")
    elif a.check == "nulls-transactions":
        before, after = read(a.transactions), read(a.transformed)
        rows = {r.column: r for r in validation.compare_nulls(before, after).collect()}
        print("column\t" + "\t".join(f"{s}_{c}" for s in ("original", "transformed") for c in ("rows", "null_count", "null_percent")))
        for c in dict.fromkeys([*before.columns, *after.columns]):
            r, cells = rows[c], []
            for s in ("original", "transformed"):
                cells += ["N/A"] * 3 if r[f"{s}_rows"] is None else [str(r[f"{s}_rows"]), str(r[f"{s}_null_count"]), f"{r[f'{s}_null_percent']:.6f}%"]
            print("\t".join([c, *cells]))
    elif a.check == "merchants-code-mismatches":
        df = (validation.code_mismatch_summary if a.summary else validation.code_mismatches)(read(a.transactions), read(a.merchants))
        order = ["merchant_id"] if a.summary else ["merchant_id", F.asc_nulls_first("transaction_merchant_category_code")]
        rows = df.orderBy(*order).collect()
        print("\t".join(df.columns))
        for r in rows:
            print("\t".join(str(show(v)) for v in r))
    elif a.check == "merchants-multiple-codes":
        rows = validation.multiple_codes(read(a.input)).orderBy("merchant_id").collect()
        if not rows:
            print("No merchants have more than one merchant_category_code.")
            return 0
        print("merchant_id\tmerchant_code_count\tmerchant_category_codes")
        for r in rows:
            print("\t".join(str(v) for v in r))
    elif a.check == "column-lengths":
        stated, rows = tables.read_manifest(a.columns)["rows"], read(a.input).count()
        print(f"{'PASS' if stated == rows else 'FAIL'}: manifest {stated}, table {rows}")
        return int(stated != rows)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lagweave", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *arguments, force=False):
        p = sub.add_parser(name)
        for x in arguments:
            p.add_argument(f"--{x.rstrip('?')}", required=not x.endswith("?"))
        if force:
            p.add_argument("--force", action="store_true")
        return p
    command("preprocess", "transactions", "dataset", "output", "cards?", "merchants?", force=True)
    command("sort-transactions", "input", "output", force=True)
    command("sort-dataset", "input", "output", force=True)
    e = command("encode", "transactions", "mapping", "dataset?", "output?", force=True)
    e.add_argument("action", choices=("fit", "encode"))
    command("materialize", "input", "output", force=True)
    s = command("search", "input", "output", "catalog", "group?", "cache?")
    s.add_argument("--strategy", choices=(*STRATEGIES, UNBOUND), default="gp_active")
    for name, kind, value in (("seed", int, 42), ("seconds", float, 600.0), ("size", int, 50), ("depth", int, 4), ("generations", int, None)):
        s.add_argument(f"--{name}", type=kind, default=value)
    command("analyze", "input", "output", "catalog", "run").add_argument("--trees", type=int, default=500)
    command("report", "output", "run", "catalog?")
    command("compare", "input", "output?").add_argument("--metric", default="test_roc_auc")
    command("runs", "catalog").add_argument("--limit", type=int, default=20)
    v = command("validate", "input?", "transactions?", "transformed?", "merchants?", "columns?")
    v.add_argument("check", choices=("merchants-code-mismatches", "merchants-multiple-codes", "column-lengths", "null-percentages", "nulls-transactions", "transactions-sorted"))
    v.add_argument("--summary", action="store_true")
    v.add_argument("--recursive", action="store_true")
    return top


def run(spark, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "preprocess":
        _pipeline(spark, a)
    elif a.command == "sort-transactions":
        tables.write_parquet(preprocess.transaction_layout(tables.read_parquet(spark, a.input)), a.output, a.force, [a.input])
    elif a.command == "sort-dataset":
        tables.write_parquet(preprocess.dataset_layout(tables.read_parquet(spark, a.input)), a.output, a.force, [a.input])
    elif a.command == "encode":
        tx = tables.read_parquet(spark, a.transactions)
        columns = [c for c in encoding.ENCODED if c in tx.columns]
        if a.action == "fit":
            tables.write_json(a.mapping, encoding.fit_mapping(tx, tables.read_parquet(spark, a.dataset), columns), a.force)
        else:
            encoded = encoding.encode(tx, tables.read_json(a.mapping))
            if a.output:
                tables.write_parquet(encoded, a.output, a.force, [a.transactions])
            else:
                tables.rewrite_parquet(encoded, a.transactions)
    elif a.command == "materialize":
        tables.materialize(tables.read_parquet(spark, a.input), a.output, a.force)
    elif a.command == "search":
        _search(spark, a)
    elif a.command == "analyze":
        _analyze(spark, a)
    elif a.command == "compare":
        text = comparison_report(run_rows(spark, a.input, a.metric))
        print(text, end="")
        if a.output:
            Path(a.output).write_text(text, encoding="utf-8")
    elif a.command == "report":
        if a.catalog:
            RunCatalog(a.catalog).require(a.run, ("complete",), "report")
        print(write_report(spark, f"{a.output}/{a.run}"))
    elif a.command == "runs":
        for r in RunCatalog(a.catalog).search(spark, max_results=a.limit).collect():
            print(f"{r.run_id}\t{r.strategy}\t{r.state}\t{'' if r.seed is None else r.seed}")
    elif a.command == "validate":
        return _check(spark, a)
    return 0


def main(argv: list[str] | None = None) -> int:
    spark = build_session(master=os.environ.get("LAGWEAVE_MASTER"))
    try:
        return run(spark, sys.argv[1:] if argv is None else argv)
    except KeyboardInterrupt:
        return 130
    finally:
        spark.stop()


if __name__ == "__main__":
    raise SystemExit(main())
