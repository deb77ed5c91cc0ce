"""A whole run: collect, health, gate, prefilter, evaluate, validate, rank, persist. Every stage is a table on disk.

The stage tables are the resume points: a run that starts again with the same manifest reads what is there. They also
keep an evaluator from being called twice.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import model_output as M
from gristmill.operators import gate as G
from gristmill.operators import routing, scoring, stores
from gristmill.operators.cache import SignatureCache
from gristmill.operators.providers import Router
from gristmill.operators.rules import RuleSet
from gristmill.sources.payloads import arrival_order
from gristmill.sources.registry import Registry, Result, result_rows


class Cancelled(Exception):
    """Raised by ``run`` when it is cancelled, inside a stage or between two; what is done stays on disk."""


class AlreadyRunning(Exception):
    """A run of the same root has not ended."""


#: Batches that are asked about between two looks at whether to go on.
WAVE = 8


@dataclass
class Run:
    """Where a run lives and how it goes on."""

    spark: SparkSession
    root: str
    rules: RuleSet
    run_ts: str
    today: str
    mode: str = "full"
    sources: list[str] | None = None
    max_days_old: int = G.MAX_DAYS_OLD
    resume: bool = False
    cancelled: Callable[[], bool] = lambda: False
    #: Whether a cancelled run also gives up what it has done.
    discard: bool = False
    listeners: list[Callable[[dict], None]] = field(default_factory=list)
    done: dict[str, dict] = field(default_factory=dict)
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    _stop: threading.Event = field(default_factory=threading.Event, repr=False)
    _tag: str = field(default_factory=lambda: f"gristmill-run-{uuid.uuid4().hex}", repr=False)

    def cancel(self, discard: bool = False) -> None:
        """Ends the run from another thread: the jobs it has under way are cancelled, by the tag that all of them carry."""
        self.discard = self.discard or discard
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def check(self, what: str) -> None:
        if self._stop.is_set() or self.cancelled():
            raise Cancelled(what)

    def tell(self, kind: str, **what) -> None:
        """An event for whoever listens; a listener that fails is not asked to be well."""
        event = {"kind": kind, "run_ts": self.run_ts, **what}
        for listener in self.listeners:
            try:
                listener(event)
            except Exception:  # progress is no part of the result
                continue

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _fs(self, path: str):
        return stores.file_system(self.spark, path)

    @property
    def commit(self) -> str:
        """The name of what this run appends to logs; a run that goes on has the name it had."""
        return "".join(c for c in self.run_ts if c.isalnum()) + f"-{self.run_id}"

    def exists(self, name: str) -> bool:
        p, fs = self._fs(self.path(name))
        return fs.exists(p)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def log(self, name: str) -> DataFrame:
        return stores.read_appends(self.spark, self.path(name), stores.LOG_SCHEMAS[name])

    def put(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A stage table: read if a resumed run has it, else made, written and noted in the manifest."""
        self.check(name)
        if name in self.done:
            return self.read(name)
        self.tell("stage", name=name)
        rows = self.put(make(), name)
        self.note(name, {})
        return rows

    def note(self, name: str, what: dict) -> None:
        self.done[name] = what
        state = {"mode": self.mode, "sources": self.sources, "run_id": self.run_id, "done": self.done}
        stores.write_document(self.spark.createDataFrame([(json.dumps(state),)], "state string"), self.path("manifest"))

    def load(self) -> None:
        """Takes up a manifest, if it is of a run of the same kind."""
        if self.resume and self.exists("manifest"):
            state = json.loads(self.spark.read.schema("state string").json(self.path("manifest")).first()["state"])
            if (state["mode"], state["sources"]) == (self.mode, self.sources):
                self.done, self.run_id = state["done"], state["run_id"]
        elif not self.resume:
            stores_reset(self)

    def clear(self) -> None:
        p, fs = self._fs(self.path("manifest"))
        fs.delete(p, True)


def stores_reset(run: Run, *more: str) -> None:
    for name in ("manifest", "gated", "scored", "prefiltered", "answers", "ranked", *more):
        p, fs = run._fs(run.path(name))
        fs.delete(p, True)


def answered(run: Run, selected: DataFrame, evaluator: Callable[[list[dict]], str] | Router) -> DataFrame:
    """The answers of all batches. Each wave of batches is appended when it is done, so a run that goes on asks only
    about those that have none; batches are as many as the cap allows. What a router's providers spend is logged."""
    known = stores.read_appends(run.spark, run.path("answers"), "batch_id int, answer string")
    if "answers" in run.done:
        return known
    batches = scoring.with_batches(selected)
    if isinstance(evaluator, Router):
        _routed(run, batches, evaluator)
    else:
        number = sorted(r["batch_id"] for r in batches.select("batch_id").distinct().collect())
        done = {r["batch_id"] for r in known.select("batch_id").collect()}
        todo = [b for b in number if b not in done]
        for k in range(0, len(todo), WAVE):
            run.check("answers")
            run.tell("batches", done=len(number) - len(todo) + k, all=len(number))
            wave = todo[k : k + WAVE]
            stores.append_once(scoring.ask(batches.where(F.col("batch_id").isin(wave)), evaluator), run.path("answers"), f"{wave[0]:08d}")
    run.note("answers", {})
    return stores.read_appends(run.spark, run.path("answers"), "batch_id int, answer string")


def _routed(run: Run, batches: DataFrame, router: Router) -> None:
    """Answers by way of a router that goes on from the usage of the day.

    A wave is committed to the answers and its usage to the log, both by their number. Waves of a run that broke off
    between the two get their usage when it goes on, so each request is counted once.
    """
    place = run.path("answers")

    def account(kept: DataFrame, name: str) -> None:
        spent = kept.where("provider IS NOT NULL").groupBy("provider").agg(F.count_if(F.col("outcome") == routing.ANSWERED).alias("requests"), F.max(F.col("outcome") == routing.SPENT).alias("exhausted"))
        rows = spent.select(F.lit(run.run_ts).alias("run_ts"), "provider", F.lit(router.today()).alias("date"), "requests", "exhausted")
        stores.append_once(rows, run.path("usage"), f"{run.commit}-{name}")

    before = sorted(stores.committed(run.spark, place))
    for name in before:
        account(run.spark.read.schema(routing.OUTCOME).parquet(f"{place}/commit={name}"), name)
    router.take_up(run.log("usage"))
    told = stores.read_appends(run.spark, place, routing.OUTCOME).where(F.col("outcome").isin(routing.ANSWERED, routing.NONE))
    known = frozenset(r["batch_id"] for r in told.select("batch_id").collect())  # as many as the cap allows

    def write(rows: DataFrame, k: int) -> DataFrame:
        name = f"{k:08d}"
        stores.append_once(rows, place, name)
        kept = run.spark.read.schema(routing.OUTCOME).parquet(f"{place}/commit={name}")
        account(kept, name)
        return kept

    def go_on(done: int, all_: int) -> None:
        run.check("answers")
        run.tell("batches", done=done, all=all_)

    routing.evaluate_routed(batches, router, write, len(before), known, go_on, WAVE)


def collect(run: Run, registry: Registry, slow: frozenset[str] = frozenset()) -> tuple[DataFrame | None, list[Result]]:
    rows, results = [], []
    for name in registry.choose(run.mode, run.sources, slow):
        run.check(name)
        key = f"raw/{name}"
        if key in run.done:
            result = Result(**run.done[key])
            parts = [run.read(f"{key}/{k:04d}") for k in range(result.parts)]
            found = reduce(DataFrame.unionByName, parts) if parts else None
        else:
            run.tell("source", name=name)
            found, result = registry.run(run.spark, name, lambda df, n: run.put(df, f"raw/{n}"))
            if run._stop.is_set():  # what the source did not yield is no error of the source
                raise Cancelled(name)
            run.note(key, asdict(result))
        results.append(result)
        if found is not None:
            rows.append(found)
    return (arrival_order(reduce(DataFrame.unionByName, rows)) if rows else None), results


def run(run: Run, registry: Registry, evaluator: Callable[[list[dict]], str] | Router) -> dict[str, DataFrame]:
    """The run's tables: health, gated, funnel, ranked. A second run of the same root is refused until this one has ended."""
    mark, fs = run._fs(run.path("running"))
    if not fs.createNewFile(mark):
        raise AlreadyRunning(run.root)
    sc = run.spark.sparkContext
    try:
        status(run, "running")
        sc.addJobTag(run._tag)
        try:
            out = _run(run, registry, evaluator)
        except Exception as error:
            if run._stop.is_set() and not isinstance(error, Cancelled):
                raise Cancelled("jobs") from error
            raise
        finally:
            sc.removeJobTag(run._tag)
    except Cancelled:
        if run.discard:
            stores_reset(run, "raw")
        status(run, "paused")
        run.tell("paused")
        raise
    except Exception as error:
        status(run, "error", error=str(error)[:500])
        run.tell("error", error=str(error)[:500])
        raise
    finally:
        fs.delete(mark, False)
    run.tell("done")
    return out


def status(run: Run, word: str, counts: dict | None = None, error: str | None = None) -> None:
    """The state of the last run, as a document."""
    told = {"run_ts": run.run_ts, "status": word, "error": error, **{name: (counts or {}).get(name) for name in COUNTS}}
    schema = "run_ts string, status string, error string, " + ", ".join(f"{name} bigint" for name in COUNTS)
    stores.write_document(run.spark.createDataFrame([tuple(told.values())], schema), run.path("status"))


#: What a run counts.
COUNTS = ("collected", "gated_kept", "gated_rejected", "prefilter_rejected", "prefilter_selected", "prefilter_deferred", "ai_evaluated", "final")


def counts_of(gated: DataFrame, split: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row with the counters of a run, one pass over each of its tables."""
    of_gate = gated.agg(F.count("*").alias("collected"), F.count_if(F.col("reject_reason").isNull()).alias("gated_kept"), F.count_if(F.col("reject_reason").isNotNull()).alias("gated_rejected"))
    of_split = split.agg(*[F.count_if(F.col("disposition") == d).alias(f"prefilter_{d}") for d in ("rejected", "selected", "deferred")])
    of_rank = ranked.agg(F.count_if("ai_evaluated").alias("ai_evaluated"), F.count("*").alias("final"))
    return of_gate.join(F.broadcast(of_split)).join(F.broadcast(of_rank)).select(*COUNTS)  # one row each


def _run(run: Run, registry: Registry, evaluator: Callable[[list[dict]], str] | Router) -> dict[str, DataFrame]:
    run.load()
    jobs, results = collect(run, registry)
    outcome = result_rows(run.spark, results)
    yields = run.log("yields")
    health = stores.check_sources(outcome, yields)
    # the verdict is taken before this run's own yields join the log
    health = run.put(health, "health")
    if "yields" not in run.done:
        seq = (yields.agg(F.max("seq")).first()[0] or 0) + 1
        new = outcome.select(
            (F.lit(seq).cast("bigint")).alias("seq"), F.lit(run.run_ts).cast("timestamp").alias("run_started_at"), "source", F.col("yielded").cast("int").alias("yielded"), "status", "duration_seconds"
        )
        stores.append_once(new, run.path("yields"), run.commit)
        run.note("yields", {})
    if jobs is None:
        run.clear()
        status(run, "success", dict.fromkeys(COUNTS, 0))
        return {"health": health}
    today = F.lit(run.today).cast("date")
    cache = signature_cache(run)
    gated = run.stage(
        "gated",
        lambda: G.gate(jobs, run.rules, today=today, cache=cache.last_seen() if cache.exists() else None, dismissed=stores.dismissed(run.log("tracking")), max_days_old=run.max_days_old),
    )
    kept = G.kept(gated)
    split = run.stage("prefiltered", lambda: scoring.prefilter(kept, run.rules, run.put))
    selected = split.where("disposition = 'selected'")
    answers = answered(run, selected, evaluator)
    checked = scoring.validate(scoring.assemble(scoring.with_batches(selected), M.results(answers)), run.rules)
    ranked = run.stage("ranked", lambda: stores.mark_new(scoring.rank(checked, scoring.defer(split.where("disposition = 'deferred'"))), run.log("history")))
    persist(run, ranked, gated, split, today)
    run.clear()
    return {"health": health, "gated": gated, "funnel": stores.funnel(gated), "ranked": ranked}


def signature_cache(run: Run) -> SignatureCache:
    return SignatureCache(run.spark, run.path("signatures"))


def current_cache(run: Run) -> DataFrame | None:
    """What earlier runs have shown; what was being written when a run broke off does not count."""
    cache = signature_cache(run)
    return cache.read() if cache.exists() else None


def persist(run: Run, ranked: DataFrame, gated: DataFrame, split: DataFrame, today) -> None:
    """New flags are in ``ranked`` already; then cache, history, inbox, results, in this order, each once."""
    shown = ranked.select("signature", "ord", "final_score", "title", "company", "source")
    if "signatures" not in run.done:
        signature_cache(run).update(shown, today, run.commit)
        run.note("signatures", {})
    now = F.lit(run.run_ts).cast("timestamp")
    for name in ("history", "inbox"):
        if name in run.done:
            continue
        log = run.log(name)
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
        place = (F.col("ord") + F.lit(seq)).cast("bigint").alias("seq")
        if name == "history":
            rows = ranked.select(place, "signature", "source", "title", "company", now.alias("shown_at"), F.lit(run.run_ts).alias("run_ts"))
        else:
            job = F.struct(*[_field(f, ranked.columns) for f in stores.schemas.JOB.fields])
            scored = F.struct(job.alias("job"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in stores.schemas.SCORED.fields[1:]])
            rows = stores.with_first_seen(ranked.select(place, "signature", scored.alias("scored")), log, now).select("seq", "signature", "first_seen_at", "scored")
        stores.append_once(rows, run.path(name), run.commit)
        run.note(name, {})
    counts = counts_of(gated, split, ranked).first().asDict()
    stores.replace_table(ranked.drop("description"), run.path("results"))
    status(run, "success", counts)


def _field(field, columns):
    value = F.col(field.name) if field.name in columns else F.lit(None)
    return value.cast(field.dataType).alias(field.name)
