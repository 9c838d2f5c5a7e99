"""Typed pipelines: a JSON plan of named blocks becomes one lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html
from ..operators import documents

#: Semantic types of ports and the columns that a DataFrame of the type has.
TYPES = {
    "FeedRef": {"url"},
    "Document": {"doc_id", "title", "text", "url", "ts", "source"},
    "Passage": {"doc_id", "piece", "passage"},
    "Record": set(),
    "Table": set(),
    "Event": {"kind"},
    "FileRef": {"path"},
    "ImageRef": {"path"},
    "AudioRef": {"path"},
    "Query": {"text"},
    "Digest": {"digest"},
}


@dataclass(frozen=True)
class Block:
    """A DataFrame operation with typed ports. Types are List[T] or Ranked[T]; a ranked one may feed a list.

    takes is the type of its one input, or the types of several by port name;
    run gets the one DataFrame, or one for each port, and the parameters.
    """

    name: str
    version: str
    takes: str | dict[str, str]
    gives: str
    run: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)  # name -> (type, default; ... if required) or (type, default, choices)

    @property
    def ports(self) -> dict[str, str]:
        return self.takes if isinstance(self.takes, dict) else {"input": self.takes}


def _inputs(step: dict) -> dict[str, str]:
    """The step's inputs by port."""
    given = step.get("input", {})
    return dict(given) if isinstance(given, dict) else {"input": given}


class PlanError(ValueError):
    """A plan that can't run; `errors` lists everything found."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


class Registry:
    def __init__(self) -> None:
        self.blocks: dict[str, dict[str, Block]] = {}

    def add(self, block: Block) -> None:
        for kind in (*block.ports.values(), block.gives):
            if _base(kind) not in TYPES:
                raise ValueError(f"unknown type {kind}")
        self.blocks.setdefault(block.name, {})[block.version] = block

    def get(self, name: str) -> Block:
        """`name` for the latest version, `name@1.2.0` for that one."""
        name, _, version = name.partition("@")
        versions = self.blocks[name]
        return versions[version] if version else versions[max(versions, key=lambda v: tuple(map(int, v.split("."))))]


def _base(kind: str) -> str:
    return kind.partition("[")[2].rstrip("]") or kind


def feeds(given: str, wanted: str) -> bool:
    return given == wanted or (given.startswith("Ranked[") and wanted.startswith("List[") and _base(given) == _base(wanted))


def _params(block: Block, given: dict) -> tuple[dict, list[str]]:
    out, errors = {}, [f"{block.name}: unknown parameter {p}" for p in given if p not in block.params]
    for name, (kind, default, *choices) in block.params.items():
        value = given.get(name, default)
        if value is ...:
            errors.append(f"{block.name}: parameter {name} is missing")
        elif not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            errors.append(f"{block.name}: parameter {name} must be {kind.__name__}")
        elif choices and value not in choices[0]:
            errors.append(f"{block.name}: parameter {name} must be one of {', '.join(map(str, choices[0]))}")
        else:
            out[name] = value
    return out, errors


def validate(plan: dict | str, registry: Registry, inputs: dict[str, str]) -> list[dict]:
    """The plan's steps in running order with versions and parameters filled in; inputs names the types of what is given."""
    plan = json.loads(plan) if isinstance(plan, str) else plan
    errors: list[str] = []
    steps = {}
    for step in plan.get("steps", []):
        if step["id"] in steps or step["id"] in inputs:
            errors.append(f"{step['id']}: id used twice")
        steps[step["id"]] = step
    found, types = {}, dict(inputs)
    for ident, step in steps.items():
        try:
            block = registry.get(step["block"])
        except KeyError:
            errors.append(f"{ident}: no block {step['block']}")
            continue
        params, wrong = _params(block, step.get("params", {}))
        errors += [f"{ident}: {w}" for w in wrong]
        found[ident], types[ident] = (block, params), block.gives
    try:
        order = [s for s in TopologicalSorter({i: list(_inputs(s).values()) for i, s in steps.items()}).static_order() if s in steps]
    except CycleError:
        errors.append("the steps form a cycle")
        order = []
    for ident, step in steps.items():
        given = _inputs(step)
        errors += [f"{ident}: no input {name}" for name in given.values() if name not in types]
        if ident not in found:
            continue
        ports = found[ident][0].ports
        errors += [f"{ident}: no port {port}" for port in given if port not in ports]
        errors += [f"{ident}: port {port} is unbound" for port in ports if port not in given]
        wrong = [(types[n], ports[port]) for port, n in given.items() if port in ports and n in types and not feeds(types[n], ports[port])]
        errors += [f"{ident}: takes {wanted}, not {kind}" for kind, wanted in wrong]
    if plan.get("output") not in steps:
        errors.append("output names no step")
    if errors:
        raise PlanError(errors)
    return [{"id": i, "block": f"{found[i][0].name}@{found[i][0].version}", "params": found[i][1], "input": steps[i]["input"]} for i in order]


def _run(step: dict, registry: Registry, made: dict[str, DataFrame]) -> DataFrame:
    block, given = registry.get(step["block"]), _inputs(step)
    df = block.run(*[made[given[port]] for port in block.ports], **step["params"])
    if missing := TYPES[_base(block.gives)] - set(df.columns):
        raise PlanError([f"{step['id']}: gives no {', '.join(sorted(missing))}"])
    return df


def build(plan: dict | str, registry: Registry, inputs: dict[str, tuple[str, DataFrame]], observe: bool = False) -> DataFrame:
    """The plan as one lazy DataFrame. With observe, each step's rows are counted while it runs, under the step's id."""
    plan = json.loads(plan) if isinstance(plan, str) else plan
    steps = validate(plan, registry, {name: kind for name, (kind, _) in inputs.items()})
    made = {name: df for name, (_, df) in inputs.items()}
    for step in steps:
        df = _run(step, registry, made)
        made[step["id"]] = df.observe(step["id"], F.count(F.lit(1)).alias("rows")) if observe else df
    return made[plan["output"]]


def trace(plan: dict | str, registry: Registry, inputs: dict[str, tuple[str, DataFrame]], key: str = "doc_id", sample: int = 3) -> list[dict]:
    """Run the plan step by step and tell of each its rows in and out and a few keys that it dropped; the first failure ends it.

    For finding the step that loses rows: every step is computed for itself.
    """
    plan = json.loads(plan) if isinstance(plan, str) else plan
    made, trail = {name: df for name, (_, df) in inputs.items()}, []
    rows = {name: df.count() for name, df in made.items()}
    for step in validate(plan, registry, {name: kind for name, (kind, _) in inputs.items()}):
        told = {"id": step["id"], "block": step["block"], "ok": False, "in": {port: rows[name] for port, name in _inputs(step).items()}}
        trail.append(told)
        try:
            df = _run(step, registry, made)
            rows[step["id"]] = told["out"] = df.count()
        except Exception as e:  # whatever a block raises is its step's failure
            told["error"] = str(e).split("\n")[0]
            break
        made[step["id"]], told["ok"] = df, True
        first = made[next(iter(_inputs(step).values()))]
        if key in df.columns and key in first.columns and told["out"] < next(iter(told["in"].values())):
            told["dropped"] = [r[0] for r in first.select(key).join(df.select(key), key, "left_anti").orderBy(key).limit(sample).collect()]
    return trail


def standard() -> Registry:
    """The blocks of the library: filter, dedupe, rank, head, parse_html, passages, digest, union_first, without."""
    docs, ranked, r = "List[Document]", "Ranked[Document]", Registry()
    r.add(Block("filter_terms", "1.0.0", docs, docs, lambda df, terms, mode: documents.filter_terms(df, terms, "text", mode), {"terms": (list, ...), "mode": (str, "any", ("any", "all", "none"))}))
    r.add(Block("dedupe", "1.0.0", docs, docs, lambda df, key: documents.dedupe(df, F.col(key), "doc_id"), {"key": (str, "text", ("text", "title", "url"))}))
    r.add(Block("rank_terms", "1.0.0", docs, ranked, lambda df, query, weight: documents.rank_terms(df, query, F.col("title"), F.col("text"), F.col("ts"), weight), {"query": (str, ...), "weight": (float, 0.0)}))
    r.add(Block("head", "1.0.0", ranked, ranked, lambda df, n: documents.head(df, [F.desc("score"), F.asc("doc_id")], n), {"n": (int, 10)}))
    r.add(Block("parse_html", "1.0.0", docs, docs, lambda df: df.withColumn("text", strip_html(F.col("text")))))
    r.add(Block("passages", "1.0.0", docs, "List[Passage]", lambda df, separator, most: documents.chunk(df, "doc_id", "text", separator, most), {"separator": (str, r"\n\s*\n"), "most": (int, 800)}))
    r.add(Block("digest", "1.0.0", docs, "List[Digest]", lambda df, n: documents.digest(df, ["source"], F.col("doc_id"), F.col("title"), F.col("text"), n), {"n": (int, 5)}))
    both = {"first": docs, "second": docs}
    r.add(Block("union_first", "1.0.0", both, docs, lambda a, b, key: documents.dedupe(documents.tagged(a, b), F.col(key), "_order").drop("_order", "_tag"), {"key": (str, "url", ("text", "title", "url"))}))
    r.add(Block("without", "1.0.0", both, docs, lambda a, b: a.join(b.select("doc_id"), "doc_id", "left_anti")))
    return r
