"""The graph of a job, from the tables that its SQL names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..temporal import TemporalVariables
from .model import Job, Task


class DagError(ValueError):
    """A job whose graph does not hold."""


@dataclass
class Node:
    """A task with its SQL rendered and the inputs and tasks that it waits for."""

    index: int
    task: Task
    sql: str
    checks: list[tuple[str, str]]
    directory: str | None
    inputs: set[str] = field(default_factory=set)
    waits: set[int] = field(default_factory=set)


def table_names(spark: SparkSession, sql: str) -> set[str]:
    """Lower-cased tables that a query reads, in sub-queries and common table expressions too; Spark's own parser finds
    them, names of common table expressions are left out."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    tables: set[str] = set()
    ctes: set[str] = set()

    def seq(xs):
        return [xs.apply(i) for i in range(xs.size())]

    def expressions(e) -> None:
        cls = e.getClass().getSimpleName()
        if hasattr(e, "plan") and cls in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            walk(e.plan())
        for child in seq(e.children()):
            expressions(child)

    def walk(p) -> None:
        cls = p.getClass().getSimpleName()
        if cls == "UnresolvedRelation":
            tables.add(p.multipartIdentifier().last().lower())
            return
        if cls == "UnresolvedWith":
            for pair in seq(p.cteRelations()):
                ctes.add(pair._1().lower())
                walk(pair._2().child())
        for e in seq(p.expressions()):
            expressions(e)
        for c in seq(p.children()):
            walk(c)

    walk(plan)
    return tables - ctes


def build(spark: SparkSession, job: Job) -> list[Node]:
    """Nodes of a job; DagError where views collide, refer to themselves or nothing, share outputs or form a cycle."""
    at: TemporalVariables = job.at
    inputs = {i.view.lower() for i in job.inputs}
    if len(inputs) != len(job.inputs):
        raise DagError("Two inputs have the same view name")
    owners: dict[str, int] = {}
    nodes = []
    for i, t in enumerate(job.tasks):
        if t.view:
            v = t.view.lower()
            if v in inputs:
                raise DagError(f"View '{t.view}' is both an input and a task")
            if v in owners:
                raise DagError(f"Two tasks have the view name '{t.view}'")
            owners[v] = i
        directory = at.render(t.output.path) if t.output else None
        nodes.append(Node(i, t, at.render(t.text()), [(c.name, at.render(c.text())) for c in t.validations], directory))
    used: dict[str, str] = {}
    for n in nodes:
        if n.directory:
            key = n.directory.rstrip("/")
            if key in used:
                raise DagError(f"Tasks '{used[key]}' and '{n.task.label}' write to the same path {key}")
            used[key] = n.task.label
        for what, sql, main in [(n.task.label, n.sql, True), *((f"{n.task.label}, validation {c}", s, False) for c, s in n.checks)]:
            for name in table_names(spark, sql):
                if name in inputs:
                    n.inputs.add(name)
                elif name not in owners:
                    raise DagError(f"{what}: unknown view '{name}'. Known views: {', '.join(sorted(inputs | set(owners)))}")
                elif owners[name] != n.index:
                    n.waits.add(owners[name])
                elif main:
                    raise DagError(f"Task '{n.task.label}' reads its own view '{name}'")
    order(nodes)
    return nodes


def order(nodes: list[Node]) -> list[int]:
    """A topological order; DagError prints a cycle's path."""
    done: list[int] = []
    state: dict[int, int] = {}

    def visit(i: int, path: list[int]) -> None:
        if state.get(i) == 2:
            return
        if state.get(i) == 1:
            loop = [*path[path.index(i) :], i]
            raise DagError("The tasks form a cycle: " + " -> ".join(nodes[k].task.label for k in loop))
        state[i] = 1
        for k in sorted(nodes[i].waits):
            visit(k, [*path, i])
        state[i] = 2
        done.append(i)

    for n in nodes:
        visit(n.index, [])
    return done


def layers(nodes: list[Node]) -> list[list[str]]:
    """Task names by the longest chain of tasks before them."""
    depth: dict[int, int] = {}
    for i in order(nodes):
        depth[i] = 1 + max((depth[k] for k in nodes[i].waits), default=-1)
    out: list[list[str]] = [[] for _ in range(1 + max(depth.values(), default=-1))]
    for n in nodes:
        out[depth[n.index]].append(n.task.label)
    return out
