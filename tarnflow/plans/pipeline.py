"""Pipelines: operators put together by name, checked before they run, executed by Spark.

A pipeline is a DAG of steps. Each step is a function of DataFrames; the DAG says which
results it takes. Compiling asks every step once, so shared inputs share one plan, and
everything that is physical is left to Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tarnflow.functions.types import Watermark, to_interval, to_milliseconds
from tarnflow.operators import aggregate, joins, lookup, pattern, project, ranking, relations, routing
from tarnflow.sources.lakehouse import TableSpec, problems, table_sink

#: Steps by name: kind (source, transform, sink) and function. Plugins add to it.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "filter": project.filter_rows, "map": project.map_columns, "flat_map": project.flat_map, "rename": project.rename, "drop": project.drop,
    "cast": project.cast, "coalesce": project.coalesce, "add_field": project.add_field,
    "join": joins.join, "broadcast_join": joins.broadcast_join, "lookup_join": joins.lookup_join, "interval_join": joins.interval_join,
    "as_of_join": joins.as_of_join, "lateral_join": joins.lateral_join, "lookup_rows": lookup.lookup_rows,
    "aggregate": aggregate.aggregate, "grouping": aggregate.grouping, "tumble": aggregate.tumble, "slide": aggregate.slide, "session": aggregate.session,
    "tumble_windows": aggregate.tumble_windows, "session_windows": aggregate.session_windows, "cumulate": aggregate.cumulate,
    "top_n": ranking.top_n, "deduplicate": ranking.deduplicate, "window_columns": ranking.window_columns, "qualify": ranking.qualify, "sort_limit": ranking.sort_limit,
    "union": relations.union, "query": relations.query, "match_rows": pattern.match_rows,
    "side_main": lambda df, **p: routing.side_output(df, **p)[0], "side_rows": lambda df, **p: routing.side_output(df, **p)[1],
    "valid": lambda df, **p: routing.validate(df, **p)[0], "rejected": lambda df, **p: routing.validate(df, **p)[1],
}


def _top_n_stream(df: DataFrame, ttl: str | None, partition_by: list[str], order_by: dict[str, str], n: int, keep_rank: bool = True) -> DataFrame:
    from tarnflow.streaming.stateful import top_n_stream

    found = top_n_stream(df, partition_by, [(c, d.upper() == "DESC") for c, d in order_by.items()], n, ttl)
    return found if keep_rank else found.drop("rownum")


def _match_stream(df: DataFrame, ttl: str | None, partition_by: list[str], pattern: str, define: dict[str, str], measures: dict, within: str | int, watermark: Watermark, order_by: list[str] | None = None) -> DataFrame:
    from tarnflow.streaming.stateful import match_stream

    return match_stream(df, partition_by, watermark, pattern, define, measures, within, ttl)


#: Steps that need state on a stream, which ``state_ttl`` bounds.
ON_STREAMS = {"top_n": _top_n_stream, "match_rows": _match_stream}
#: What a step does to a stream of changes: keep, make, or reduce it.
KEEPS = frozenset("lookup_rows filter map flat_map rename drop cast coalesce add_field top_n window_columns qualify query sort_limit side_main side_rows valid rejected lookup_join lateral_join as_of_join tumble_windows session_windows branch view".split())
RETRACTING_SINKS = frozenset({"update_batches", "jdbc_upsert", "keyed_table", "paimon", "iceberg", "upsert_topic"})


@dataclass(frozen=True)
class Step:
    """One node of the DAG."""

    id: str
    kind: str
    operator: str
    inputs: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    run: Callable | None = None


@dataclass(frozen=True)
class Changelog:
    """How rows of a result change: append-only, retract or upsert; and by which key."""

    mode: str = "append-only"
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Finding:
    """A diagnosis of the plan."""

    level: str
    step: str
    message: str


class Stream:
    """A handle on one step's result; methods add steps."""

    def __init__(self, pipeline: Pipeline, step_id: str) -> None:
        self.pipeline, self.id = pipeline, step_id

    def apply(self, operator: str, *others: Stream, name: str | None = None, **options) -> Stream:
        """Add a registered operator over this stream (and others)."""
        if operator not in self.pipeline.operators:
            raise ValueError(f"no operator {operator}")
        return self.pipeline._add("transform", operator, (self.id, *(o.id for o in others)), options, name)

    def __getattr__(self, operator: str):
        if operator.startswith("_") or operator not in self.pipeline.operators:
            raise AttributeError(operator)
        return lambda *others, **options: self.apply(operator, *others, **options)

    def branch(self, condition: str = "true", name: str | None = None) -> Stream:
        """Rows of one route; branches are independent of each other."""
        return self.pipeline._add("transform", "branch", (self.id,), {"condition": condition}, name)

    def view(self, name: str) -> Stream:
        """Name this result for SQL."""
        return self.pipeline._add("transform", "view", (self.id,), {"name": name}, name)

    def sink(self, write: Callable[[DataFrame], object], kind: str = "files", name: str | None = None, **options) -> Stream:
        """End in a sink; ``kind`` and ``options`` are what the checks look at."""
        return self.pipeline._add("sink", kind, (self.id,), options, name, write)

    def into(self, spec: TableSpec, mode: str = "append", sequence: list[str] | None = None, checkpoint: str | None = None, name: str | None = None) -> Stream:
        """End in a table of a catalog; streams need a checkpoint folder."""
        return self.sink(table_sink(spec, mode, sequence, checkpoint), spec.kind, name or spec.table, spec=spec)

    def stream_to(self, name: str | None = None, available_now: bool = False, **target) -> Stream:
        """End in a streaming query that the pipeline starts: into ``path``, ``memory``, ``table`` (a keyed table) or ``sinks``.

        Its checkpoint, trigger, output mode, state store and restarts follow the pipeline's options.
        """
        flow = self.pipeline

        def write(df: DataFrame) -> object:
            return flow.start_query(df, sink.id, available_now, target)

        kind = "keyed_table" if target.get("table") else "update_batches" if target.get("sinks") or target.get("memory") else "files"
        sink = self.sink(write, kind, name or kind, **({"key": target["table"].key, "sequence": target["table"].sequence} if target.get("table") else {}))
        return sink

    def dataframe(self) -> DataFrame:
        return self.pipeline.compile(self.id)


#: Required options of sinks, options that need others, and values that are allowed.
SINK_RULES = {
    "jdbc_upsert": {"required": ("url", "table", "key")},
    "jdbc": {"required": ("url", "table")},
    "topic": {"required": ("topic",)},
    "upsert_topic": {"required": ("topic", "key")},
    "files": {"values": {"format": ("parquet", "orc", "csv", "json", "avro")}},
    "keyed_table": {"required": ("key", "sequence"), "values": {"engine": ("deduplicate", "partial-update", "aggregation", "first-row")}},
    "paimon": {"required": ("catalog", "database", "table"), "values": {"merge_engine": ("deduplicate", "partial-update", "aggregation", "first-row"), "changelog_producer": ("none", "input", "lookup", "full-compaction")}, "needs": {"merge_engine": ("primary_key",), "bucket_key": ("bucket",)}},
    "iceberg": {"required": ("catalog", "database", "table"), "values": {"distribution": ("none", "hash", "range"), "format_version": (1, 2, 3)}, "needs": {"upsert": ("equality_columns",)}},
}


class Pipeline:
    """A named DAG with run options.

    ``mode`` is batch or streaming; ``parallelism`` sets shuffle partitions, ``checkpoint`` the
    trigger interval, ``checkpoint_path`` the folder under which each stream keeps its checkpoint,
    ``state_backend`` (``hashmap`` or ``rocksdb``) the state store, ``state_ttl`` how long top-N and patterns
    on streams remember rows, ``restart`` how often a failed query
    starts again, and ``conf`` anything else. Options given here win over ``environment``, those over ``project``.
    """

    DEFAULTS = {"mode": "streaming", "parallelism": None, "checkpoint": None, "checkpoint_path": None, "state_backend": "hashmap", "state_ttl": None, "restart": 0, "conf": {}}

    def __init__(self, name: str, environment: dict | None = None, project: dict | None = None, plugins: list[Plugin] | None = None, **options) -> None:
        unknown = set(options) - set(self.DEFAULTS)
        if unknown:
            raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
        self.name, self.steps = name, {}
        self.options = self.DEFAULTS | (project or {}) | (environment or {}) | options
        self.options["conf"] = {**(project or {}).get("conf", {}), **(environment or {}).get("conf", {}), **options.get("conf", {})}
        if self.options["mode"] not in ("batch", "streaming"):
            raise ValueError(f"no such mode: {self.options['mode']}")
        if self.options["parallelism"] is not None and self.options["parallelism"] < 1:
            raise ValueError("parallelism is at least 1")
        if self.options["state_backend"] not in ("hashmap", "rocksdb"):
            raise ValueError(f"no such state backend: {self.options['state_backend']}")
        for option in ("checkpoint", "state_ttl"):
            if self.options[option] is not None:
                to_milliseconds(self.options[option])
        self.plugins = order_plugins(plugins or [])
        self.operators = OPERATORS | {n: f for p in self.plugins for n, f in p.operators.items()}
        self._made: dict[str, DataFrame] = {}

    def spark_conf(self) -> dict[str, str]:
        """Session options that the run options stand for."""
        conf = {}
        if self.options["parallelism"]:
            conf["spark.sql.shuffle.partitions"] = str(self.options["parallelism"])
        if self.options["state_backend"] == "rocksdb":
            conf["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        return conf | {k: str(v) for k, v in self.options["conf"].items()}

    def trigger(self) -> dict[str, str]:
        """Arguments of ``writeStream.trigger``."""
        return {"processingTime": to_interval(self.options["checkpoint"])} if self.options["checkpoint"] else {"processingTime": "0 seconds"}

    def start_query(self, df: DataFrame, sink: str, available_now: bool, target: dict) -> object:
        """Start a query with the pipeline's options; with ``restart`` it is supervised while it is awaited."""
        from tarnflow.streaming import runner

        if not self.options["checkpoint_path"]:
            raise ValueError("streams need checkpoint_path")
        if available_now and self.options["state_ttl"] and any(self.steps[i].operator == "top_n" for i in self._upstream(sink)):
            raise ValueError("a top-N with state_ttl watches the clock and does not end; start it without available_now")
        folder = f"{self.options['checkpoint_path'].rstrip('/')}/{self.name}/{sink}"
        mode = runner.output_mode(self.changelog(self.steps[sink].inputs[0]), False)
        trigger = {"availableNow": True} if available_now else self.trigger()

        def make() -> object:
            return runner.start(df, folder, mode, trigger=trigger, options=self.spark_conf(), **target)

        return runner.Supervised(make, self.options["restart"]) if self.options["restart"] else make()

    def _add(self, kind: str, operator: str, inputs: tuple[str, ...], options: dict, name: str | None, run: Callable | None = None) -> Stream:
        base = "".join(c if c.isalnum() else "_" for c in (name or operator))
        step_id, n = base, 2
        while step_id in self.steps:
            step_id, n = f"{base}_{n}", n + 1
        self.steps[step_id] = Step(step_id, kind, operator, inputs, options, run)
        return Stream(self, step_id)

    def source(self, read: Callable[[], DataFrame] | DataFrame, name: str = "source", changelog: Changelog | None = None, **options) -> Stream:
        """A source: a DataFrame or a function that makes it when needed."""
        return self._add("source", "source", (), options | {"changelog": changelog or Changelog()}, name, read if callable(read) else lambda: read)

    def compile(self, step_id: str) -> DataFrame:
        """The DataFrame of a step; every step is asked once."""
        if step_id not in self._made:
            step = self.steps[step_id]
            inputs = [self.compile(i) for i in step.inputs]
            for plugin in self.plugins:
                if plugin.before:
                    plugin.before(step, inputs)
            if step.kind == "source":
                made = step.run()
            elif step.operator == "branch":
                made = project.filter_rows(inputs[0], step.options["condition"])
            elif step.operator == "view":
                made = relations.view(inputs[0], step.options["name"])
            elif step.kind == "sink":
                made = inputs[0]
            elif step.operator in ON_STREAMS and inputs[0].isStreaming:
                made = ON_STREAMS[step.operator](inputs[0], self.options["state_ttl"], **step.options)
            else:
                made = self.operators[step.operator](*inputs, **step.options)
            for plugin in self.plugins:
                if plugin.after:
                    made = plugin.after(step, made) or made
            self._made[step_id] = made
        return self._made[step_id]

    def run(self, spark: SparkSession) -> dict[str, object]:
        """Check, then run all sinks. Inputs that several sinks share are kept while they run."""
        problems = [f for f in self.check() if f.level == "error"]
        if problems:
            raise ValueError("; ".join(f"{f.step}: {f.message}" for f in problems))
        for key, value in self.spark_conf().items():
            spark.conf.set(key, value)
        sinks = [s for s in self.steps.values() if s.kind == "sink"]
        readers: dict[str, int] = {}
        for sink in sinks:
            for step_id in self._upstream(sink.id):
                readers[step_id] = readers.get(step_id, 0) + 1
        shared = [i for i, n in readers.items() if n > 1 and not any(readers.get(o.id, 0) >= n for o in self.steps.values() if i in o.inputs)]
        kept = []
        if self.options["mode"] == "batch":
            for step_id in shared:
                if self.steps[step_id].kind == "transform":
                    kept.append(self.compile(step_id).persist())
        try:
            return {s.id: s.run(self.compile(s.id)) for s in sinks}
        finally:
            for df in kept:
                df.unpersist()

    def _upstream(self, step_id: str) -> set[str]:
        found: set[str] = set()
        todo = list(self.steps[step_id].inputs)
        while todo:
            at = todo.pop()
            if at not in found and at in self.steps:
                found.add(at)
                todo += self.steps[at].inputs
        return found

    def changelog(self, step_id: str) -> Changelog:
        """How the rows of a step change, from those of its inputs."""
        step = self.steps[step_id]
        if step.kind == "source":
            return step.options["changelog"]
        ups = [self.changelog(i) for i in step.inputs]
        first = ups[0]
        retract = any(u.mode != "append-only" for u in ups)
        if step.operator == "aggregate":
            return Changelog("retract", tuple(step.options.get("group_by", ())))
        if step.operator in ("tumble", "slide", "cumulate"):
            return Changelog("append-only", (*step.options.get("group_by", ()), "window_start", "window_end"))
        if step.operator == "session":
            return Changelog("retract", (*step.options.get("group_by", ()), "window_start", "window_end"))
        if step.operator == "deduplicate":
            return Changelog("append-only", tuple(step.options.get("key", ())))
        if step.operator == "top_n" and self.options["mode"] == "streaming":
            return Changelog("retract", (*step.options.get("partition_by", ()), "rownum"))
        if step.operator in ("join", "broadcast_join", "interval_join"):
            shared = tuple(joins.shared_keys(step.options.get("on", "")))
            if step.options.get("how") in ("semi", "anti"):
                return Changelog("retract", first.key)
            return Changelog("retract" if retract else "append-only", shared or first.key)
        if step.operator == "union":
            return Changelog("retract" if retract else "append-only", first.key)
        if step.operator == "rename":
            return Changelog(first.mode, tuple(step.options["columns"].get(k, k) for k in first.key))
        if step.operator == "drop" and set(first.key) & set(step.options["columns"]):
            return Changelog(first.mode)
        return first

    def check(self, columns: bool = True) -> list[Finding]:
        """Structure, columns, sink options and changelogs, without running anything."""
        found: list[Finding] = []
        used = {i for s in self.steps.values() for i in s.inputs}
        for step in self.steps.values():
            for i in step.inputs:
                if i not in self.steps:
                    found.append(Finding("error", step.id, f"reads {i}, which does not exist"))
            if step.kind == "source" and step.id not in used:
                found.append(Finding("warning", step.id, "no step reads this source"))
            if step.kind == "sink" and not step.inputs:
                found.append(Finding("error", step.id, "this sink has no input"))
            if step.id in self._upstream(step.id):
                found.append(Finding("error", step.id, "the step depends on itself"))
        if any(f.level == "error" for f in found):
            return found
        for step in self.steps.values():
            if step.kind == "sink":
                found += self._check_sink(step)
            elif step.operator == "deduplicate" and self.changelog(step.inputs[0]).mode != "append-only":
                found.append(Finding("warning", step.id, "deduplicates rows that may be taken back"))
            for plugin in self.plugins:
                if plugin.validate:
                    found += plugin.validate(self, step)
        if columns:
            for step in self.steps.values():
                try:
                    self.compile(step.id)
                except (AnalysisException, ValueError) as error:
                    found.append(Finding("error", step.id, str(error).splitlines()[0]))
                    break
        return found

    def _check_sink(self, step: Step) -> list[Finding]:
        if "spec" in step.options:
            changes = self.changelog(step.inputs[0]).mode if self.options["mode"] == "streaming" else "append-only"
            return [Finding(level, step.id, message) for level, message in problems(step.options["spec"], changes, self.options["parallelism"])]
        rules, options = SINK_RULES.get(step.operator, {}), step.options
        found = [Finding("error", step.id, f"{step.operator} needs {n}") for n in rules.get("required", ()) if not options.get(n)]
        for name, values in rules.get("values", {}).items():
            if options.get(name) is not None and options[name] not in values:
                found.append(Finding("error", step.id, f"{name} is one of {', '.join(map(str, values))}"))
        for name, needs in rules.get("needs", {}).items():
            if options.get(name):
                found += [Finding("error", step.id, f"{name} needs {n}") for n in needs if not options.get(n)]
        mode = self.changelog(step.inputs[0]).mode
        if self.options["mode"] == "streaming" and mode != "append-only" and step.operator not in RETRACTING_SINKS:
            found.append(Finding("error", step.id, f"{step.operator} cannot take back rows, and its input is {mode}"))
        return found

    def describe(self) -> dict:
        """Sources, sinks and steps as plain data."""
        return {
            "name": self.name,
            "mode": self.options["mode"],
            "sources": [s.id for s in self.steps.values() if s.kind == "source"],
            "sinks": [{"id": s.id, "kind": s.operator} for s in self.steps.values() if s.kind == "sink"],
            "steps": [{"id": s.id, "operator": s.operator, "inputs": list(s.inputs)} for s in self.steps.values()],
        }

    def to_dot(self) -> str:
        """The DAG for graphviz."""
        lines = [f'  "{s.id}" [label="{s.id}\\n{s.operator}"];' for s in self.steps.values()]
        lines += [f'  "{i}" -> "{s.id}";' for s in self.steps.values() for i in s.inputs]
        return "\n".join([f'digraph "{self.name}" {{', *lines, "}"])

    def to_text(self) -> str:
        """The DAG as indented text, sinks first."""
        lines: list[str] = []

        def walk(step_id: str, depth: int) -> None:
            step = self.steps[step_id]
            lines.append("  " * depth + f"{step.id} ({step.operator})")
            for i in step.inputs:
                walk(i, depth + 1)

        for step in self.steps.values():
            if step.kind == "sink":
                walk(step.id, 0)
        return "\n".join(lines)


@dataclass
class Plugin:
    """Operators, checks and hooks that extend a pipeline; ``requires`` names plugins that come first."""

    name: str
    operators: dict[str, Callable] = field(default_factory=dict)
    before: Callable | None = None
    after: Callable | None = None
    validate: Callable | None = None
    requires: tuple[str, ...] = ()


def order_plugins(plugins: list[Plugin]) -> list[Plugin]:
    """Plugins after those they require; doubled names, operators and circles are errors."""
    names = [p.name for p in plugins]
    if len(set(names)) != len(names):
        raise ValueError("two plugins have one name")
    operators = [n for p in plugins for n in p.operators]
    if len(set(operators)) != len(operators):
        raise ValueError("two plugins define one operator")
    done: list[Plugin] = []
    left = list(plugins)
    while left:
        ready = [p for p in left if all(r in {d.name for d in done} for r in p.requires)]
        if not ready:
            raise ValueError(f"plugins lack or wait for one another: {', '.join(p.name for p in left)}")
        done += ready
        left = [p for p in left if p not in ready]
    return done


def metrics_plugin(collected: dict[str, object]) -> Plugin:
    """Count rows of every step as they are computed; ``collected`` gets an Observation per step."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    def after(step: Step, df: DataFrame) -> DataFrame | None:
        if df.isStreaming or step.kind == "sink":
            return None
        collected[step.id] = Observation(step.id)
        return df.observe(collected[step.id], F.count(F.lit(1)).alias("rows"))

    return Plugin("metrics", after=after)


def logging_plugin(log: Callable[[str], object]) -> Plugin:
    """Tell of every step that is compiled."""
    return Plugin("logging", before=lambda step, inputs: log(f"{step.operator} {step.id}: {len(inputs)} inputs"))


def tap(df: DataFrame, rows: int = 20, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A few rows of a step for looking at; the step itself is untouched."""
    chosen = df.where(where) if where else df
    return (chosen.select(*columns) if columns else chosen).limit(rows)
