"""A delivery from its inputs to verified outputs and their evidence.

Records are read, routed and written by Spark; the driver holds the plan's counts, and of each
target its template and its output, whose size the workbook format bounds. Outcomes are kept in a
table of the staging folder, so that nothing is routed twice and what a file shows is compared with
what was decided for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import ambiguity, formula_delivery, manifest, route, state, verify, write
from tabulith.operators.formulas import FormulaError
from tabulith.plans import targets as T
from tabulith.sinks import files
from tabulith.sinks import workbook as W
from tabulith.sources import grids, workbook


@dataclass(frozen=True)
class Failure:
    code: str
    message: str
    destination: str | None = None


@dataclass
class Run:
    status: str  # delivered, no_op, blocked, dry_run, failed
    counts: Mapping[str, int] = field(default_factory=dict)
    plan: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    blockers: tuple[str, ...] = ()
    questions: tuple[str, ...] = ()
    failures: tuple[Failure, ...] = ()
    targets: Mapping[str, str] = field(default_factory=dict)
    manifests: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    outcomes: DataFrame | None = None
    verdict: state.Verdict | None = None


#: Called with the staged file of a target before it is checked, and with the path of one that was delivered.
Hook = Callable[[str], None]


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def output_path(t: T.Target, options: T.Options) -> str:
    suffix = t.template[t.template.rfind(".") :]
    return f"{options.delivery.rstrip('/')}/{t.name or f'{t.key}{suffix}'}"


def cells_of(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame | None:
    """(destination, sheet, row, col, cell, value, formula) of some targets' files; None where none is there."""
    out = None
    for key, path in paths.items():
        if files.exists(spark, path):
            own = workbook.cells(spark, path).select(F.lit(key).alias("destination"), "sheet", "row", "col", "cell", "value", "formula")
            out = own if out is None else out.unionByName(own)
    return out


def existing_ids(spark: SparkSession, chosen: list[T.Target], options: T.Options) -> DataFrame:
    """(destination, record_id) that the delivered files hold already."""
    out = spark.createDataFrame([], "destination string, record_id string")
    for t in chosen:
        path, col = output_path(t, options), t.columns.get(t.record_id_field)
        if col is not None and files.exists(spark, path):
            own = workbook.cells(spark, path).where((F.col("sheet") == t.sheet) & (F.col("col") == col) & (F.col("row") >= t.data_start_row))
            out = out.unionByName(own.select(F.lit(t.key).alias("destination"), F.trim("value").alias("record_id")).where("record_id <> ''"))
    return out.distinct()


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def staged_book(spark: SparkSession, t: T.Target, own: DataFrame, currency: str | None) -> bytes:
    """The template with a target's cells: gathered in one task, since a sheet holds no more rows than the format does."""
    style, codes = t.style_row or t.data_start_row, T.number_formats(t, currency)
    name, sheet = t.template, t.sheet
    content = spark.read.format("binaryFile").load(name).select("content")

    def fill(rows: Iterator[pd.DataFrame], template: bytes) -> bytes:
        writes = []
        shown: dict[str, str] = {}
        for part in rows:
            for r, c, cell, f, v, kind in part.itertuples(index=False):
                number = v is not None and kind == "n"
                writes.append(W.Write(int(r), int(c), (int(v) if v.lstrip("-").isdigit() else float(v)) if number else v, style))
                if f in codes:
                    shown[cell] = codes[f]
        return W.patched(template, {sheet: writes}, formats={sheet: shown} if shown else None)

    def one(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = sent.value
        yield pd.DataFrame({"content": [fill(rows, template)]})

    sent = spark.sparkContext.broadcast(bytes(content.first().content))  # one template
    rows = own.where("skip is null").select("row", "col", "cell", "field", "new_value", "kind").coalesce(1)
    return bytes(rows.mapInPandas(one, "content binary").first().content)


def deliver(
    spark: SparkSession, payload: Mapping[str, Any], base: str = "", *, dry_run: bool = False, state_path: str | None = None, decisions: Mapping[str, state.Decision] | None = None, period: tuple[str, str] | None = None,
    verifiers: tuple[verify.Verifier, ...] = (), post_stage: Hook | None = None, artifact: Hook | None = None, revision: state.RevisionSource | None = None,
    recalculate: formula_delivery.Recalculator | None = None,
) -> Run:
    """Deliver what a configuration names, once: read, route, ask, plan, write beside, read back, put in place.

    A failed input or a blocker stops the run before anything is written. A target with a skipped cell
    or a finding is not delivered, the others are. With a state_path, a run whose inputs, templates,
    mapping, decisions, period, outputs and revision are those of the last successful one does nothing.
    """
    chosen, options = T.load(payload, base)
    recipe = state.load_recipe(spark, options.recipe) if options.recipe else {}
    decisions = dict(decisions or {})
    outputs = {t.key: output_path(t, options) for t in chosen}
    guard = None
    if state_path:
        guard = state.Guard(spark, state_path, state.task_key(outputs.values()), components(spark, chosen, options, recipe, decisions, period), revision)
        intact = all(not files.exists(spark, p) or manifest.recovered(spark, p) for p in outputs.values())
        if guard.verdict.decision == "no_op" and not dry_run and intact:
            return Run("no_op", verdict=guard.verdict)
    staging = options.staging.rstrip("/")
    records, failed = grids.input_records(spark, list(options.inputs))
    failures = tuple(Failure(r.code, r.file.rpartition("/")[2]) for r in failed.collect())  # one for each file that failed
    if failures:
        return _stopped(guard, Run("failed", failures=failures), dry_run)
    records = _table(records, f"{staging}/records")
    destinations = T.destinations(spark, chosen)
    existing = existing_ids(spark, chosen, options)
    asked = _table(route.routed(records, destinations, None, existing, True, options.least_confidence), f"{staging}/asked")
    batch = ambiguity.decided(ambiguity.grouped(ambiguity.from_outcomes(asked)), state.decisions_frame(spark, decisions), state.decisions_frame(spark, recipe))
    batch = _table(batch, f"{staging}/questions")
    told = ambiguity.confirmations(asked, batch, destinations)
    outcomes = asked
    if told.limit(1).count():
        outcomes = route.routed(records, destinations, told, existing, True, options.least_confidence)
    outcomes = _table(ambiguity.blocked(outcomes, batch, asked), f"{staging}/outcomes")
    open_ = tuple(r.key for r in batch.where("state <> 'resolved'").select("key").orderBy("key").collect())  # one for each kind of question
    if options.recipe and decisions and not dry_run:
        state.save_recipe(spark, options.recipe, (recipe | decisions).values())

    mapping = T.mapping(spark, chosen)
    have = {t.key: files.exists(spark, t.template) for t in chosen}
    blockers = [b for t in chosen for b in T.blockers(t, have[t.key])]
    template = cells_of(spark, {t.key: t.template for t in chosen}) if any(have.values()) else None
    template = template if template is not None else _none(spark, "destination string, sheet string, row int, col int, cell string, value string, formula string")
    merges = _none(spark, "destination string, sheet string, row1 int, col1 int, row2 int, col2 int")
    for t in chosen:
        if have[t.key]:
            merges = merges.unionByName(workbook.merges(spark, t.template).select(F.lit(t.key).alias("destination"), "sheet", "row1", "col1", "row2", "col2"))
    placed = route.numbered(outcomes.where("status = 'accepted'"), "destination", "row_index", "target_row")
    starts = spark.createDataFrame([(t.key, t.data_start_row) for t in chosen], "destination string, start int")
    placed = placed.join(F.broadcast(starts), "destination").withColumn("target_row", F.col("target_row") + F.col("start") - 1).drop("start")
    changed = _table(write.changes(placed, mapping, template, merges), f"{staging}/changes")
    plan = {r.destination: {k: v for k, v in r.asDict().items() if k != "destination"} for r in write.planned(outcomes, changed, destinations).collect()}
    for t in chosen:
        n = plan[t.key]["expected_written"] + plan[t.key]["expected_skipped_protected"]
        most = min(t.max_rows if t.max_rows is not None else W.MOST_ROWS, W.MOST_ROWS - t.data_start_row + 1)
        blockers += [f"{t.key}: too_many_rows:{n}"] if n > most else []
        if "amount" in t.kinds.values():
            code = currency_of(outcomes, t)
            blockers += [f"format_policy:{t.key}:{code}"] if code.endswith("_required") else []
    counts = route.status_counts(outcomes).first().asDict()
    run = Run("blocked" if blockers else "dry_run", counts, plan, tuple(blockers), open_, outcomes=outcomes, verdict=guard.verdict if guard else None)
    if blockers or dry_run:
        run.failures = (Failure("plan_blocked", ", ".join(blockers)),) if blockers else ()
        return _stopped(guard, run, dry_run)
    if guard:
        guard.start()
    done, found = [], []
    for t in chosen:
        failure = _target(spark, t, changed, mapping, template, plan[t.key], staging, outputs[t.key], outcomes, verifiers, post_stage, recalculate, run)
        if failure:
            found.append(failure)
        elif run.targets[t.key] == "delivered":
            done.append((t.key,))
    run.outcomes = _table(write.written(outcomes, spark.createDataFrame(done, "destination string")), f"{staging}/final")
    run.counts = route.status_counts(run.outcomes).first().asDict()
    run.failures, run.status = tuple(found), "failed" if found else "delivered"
    version = state.recipe_version((recipe | decisions).values())
    digests = {p: files.digest(spark, p) for p in options.inputs if "." in p.rpartition("/")[2]}
    ids = spark.createDataFrame([(t.key, t.sheet, t.columns[t.record_id_field], t.data_start_row) for t in chosen], "destination string, sheet string, col int, data_start_row int")
    for t in chosen:
        if (t.key,) in done:
            there = manifest.persisted_rows(cells_of(spark, {t.key: outputs[t.key]}), ids)
            wrote = run.outcomes.where((F.col("status") == "written") & (F.col("destination") == t.key)).select("destination", F.lit(t.sheet).alias("sheet"), "input")
            body = manifest.document(spark, t, outputs[t.key], run.outcomes, route.tab_counts(wrote, there), {k: v for k, v in run.manifests[t.key].items() if k != "formulas"}, digests, period, version, guard.fingerprint if guard else None)
            body["formulas"] = run.manifests[t.key]["formulas"]
            manifest.save(spark, body)
            run.manifests = {**run.manifests, t.key: body}
            if artifact:
                artifact(outputs[t.key])
    if guard:
        guard.finish("failed" if found else "succeeded", not found, {"counts": run.counts}, components(spark, chosen, options, state.load_recipe(spark, options.recipe) if options.recipe else {}, decisions, period) | ({"remote_revision": revision()} if revision else {}))
    return run


def _stopped(guard: state.Guard | None, run: Run, dry_run: bool) -> Run:
    if guard and not dry_run:
        guard.finish("failed", False, {"status": run.status})
    return run


def currency_of(outcomes: DataFrame, t: T.Target) -> str:
    """The currency of a target's accepted amounts, or the code of why there is none."""
    from tabulith.plans import formats

    own = outcomes.where((F.col("status") == "accepted") & (F.col("destination") == t.key) & F.col("amount").isNotNull())
    return own.agg(formats.one_currency("currency", t.currency).alias("c")).first().c


def components(spark: SparkSession, chosen: list[T.Target], options: T.Options, recipe: Mapping[str, state.Decision], decisions: Mapping[str, state.Decision], period: tuple[str, str] | None) -> dict[str, Any]:
    """What a run depends on; names of inputs never matter, paths of outputs do."""
    outputs = {t.key: output_path(t, options) for t in chosen}
    return {
        "inputs": [files.digest(spark, p) for p in options.inputs],
        "templates": [files.digest(spark, t.template) for t in chosen],
        "mapping": {t.key: {"sheet": t.sheet, "columns": dict(t.columns), "aliases": list(t.aliases), "rows": [t.header_row, t.data_start_row, t.max_rows], "required": list(t.required), "kinds": dict(t.kinds), "currency": t.currency, "formulas": list(t.formulas)} for t in chosen},
        "recipe": state.decision_payload(recipe.values()),
        "confirmations": state.decision_payload(d for d in decisions.values() if d.scope == "run"),
        "period": list(period) if period else None,
        "connector": state.task_key(outputs.values()),
        "output": [files.digest(spark, p) for p in outputs.values()],
    }


def _target(spark, t, changed, mapping, template, plan, staging, output, outcomes, verifiers, post_stage, recalculate, run) -> Failure | None:
    """Write, check and deliver one target; what went wrong, if anything did."""
    own = changed.where(F.col("destination") == t.key)
    accepted = outcomes.where((F.col("status") == "accepted") & (F.col("destination") == t.key)).count()
    if not accepted:
        last = (manifest.recovered(spark, output) or {}).get("formulas") or {}
        if t.formulas and (last.get("contract"), last.get("status")) != (formula_delivery.contract(t.formulas), "verified"):
            run.targets = {**run.targets, t.key: "formula_delivery_failed"}
            return Failure("formula_delivery_requires_records", "the formulas changed, but there is nothing new to deliver", t.key)
        run.targets = {**run.targets, t.key: "no_new_records"}
        return None
    skipped = sorted(r.skip for r in own.where("skip is not null").select("skip").distinct().collect())
    if skipped:
        run.targets = {**run.targets, t.key: "incomplete_write"}
        return Failure("incomplete_write", f"cells were skipped: {', '.join(skipped)}", t.key)
    staged = f"{staging}/{t.key}{t.template[t.template.rfind('.'):]}"
    if staged == output:
        return Failure("verification_failed", "delivery_not_separate", t.key)
    if not template.where((F.col("destination") == t.key) & (F.col("sheet") == t.sheet)).limit(1).count():
        run.targets = {**run.targets, t.key: "write_failed"}
        return Failure("template_write_failed", f"missing sheet: {t.sheet}", t.key)
    files.replace(spark, staged, staged_book(spark, t, own, currency_of(outcomes, t) if "amount" in t.kinds.values() else None))
    evidence: Mapping[str, Any] = {}
    if t.formulas:
        try:
            evidence = formula_delivery.applied(spark, staged, t.formulas, recalculate)
        except FormulaError as e:
            run.targets = {**run.targets, t.key: "formula_delivery_failed"}
            return Failure("formula_delivery_failed", str(e), t.key)
    if post_stage:
        post_stage(staged)
    contract = verify.Contract(t, accepted + plan["expected_review"], accepted, plan["expected_review"], accepted, None, verifiers)
    codes: dict[str, Any] = {}
    for path in (staged, f"{output}.checked"):
        if path != staged:
            files.write(spark, path, files.read(spark, staged))
        try:
            shown = cells_of(spark, {t.key: path}) if path == staged else _renamed(spark, t.key, path, staged)
        except Exception:  # noqa: BLE001
            shown = None
        found = verify.verified(shown, template.where(F.col("destination") == t.key), own, mapping, contract)
        codes = verify.summary(found).first().asDict()
        if verify.blocking(found).first().blocking:
            if path != staged:
                files.delete(spark, path)
            files.replace(spark, f"{staged}.verification.json", state.canonical(verify.problems(found)).encode())
            run.targets = {**run.targets, t.key: "verification_failed"}
            return Failure("verification_failed", ", ".join(codes["codes"]), t.key)
    files.move(spark, f"{output}.checked", output)
    run.targets, run.manifests = {**run.targets, t.key: "delivered"}, {**run.manifests, t.key: codes | {"formulas": dict(evidence)}}
    return None


def _renamed(spark: SparkSession, key: str, path: str, like: str) -> DataFrame:
    """Cells of a workbook whose name does not say that it is one."""
    content = files.read(spark, path)
    beside = f"{like.rpartition('/')[0]}/checked-{like.rpartition('/')[2]}"
    files.write(spark, beside, content)
    return cells_of(spark, {key: beside})
