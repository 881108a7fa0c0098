"""Models with agents and queues: each step runs agents, then arrivals and queues, then the stocks.

Runs of a batch go together: agents' properties are arrays of runs by agents, queues are event loops, a run each. What
agents and queues report ({Type}_{property}_{avg,sum,min,max,var}, {Type}_count, {queue}_{length,arrivals,dropped,departed},
{resource}_{utilization,available}) can be read by the model's expressions, as the model's names by agents' rules.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from graphtide.functions import registry
from graphtide.functions.expressions import parse, to_numpy
from graphtide.sources.sysd import Agent, Model, QueueDef, lower

from .agents import _EFFECT, _SEND, _SWITCH
from .dynamics import TRAJECTORY, Worker

_ASSERT = re.compile(r"^\s*KB_ASSERT\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*,\s*(.+?)\)\s*$")


class _Crowd:
    """The agents of a type in all runs."""

    def __init__(self, agent: Agent, runs: int, tables, functions):
        self.agent, shape = agent, (runs, agent.count)
        self.state = {p.name: np.full(shape, p.initial) for p in agent.properties}
        self.bounds = {p.name: (p.low, p.high) for p in agent.properties}
        self.strategy = np.zeros(shape, int)
        self.locked = np.full(shape, -np.inf)
        self.inbox: dict[str, np.ndarray] = {}
        rules = sorted(agent.rules, key=lambda r: (not r.meta, -r.priority))
        build = lambda text: to_numpy(parse(text), tables, functions)
        self.rules = []
        for r in rules:
            effects = []
            for text in r.effects:
                if m := _SEND.match(text):
                    effects.append(("send", m[1], m[2]))
                elif m := _SWITCH.match(text):
                    effects.append(("switch", m[1], float(m[2] or 0)))
                elif m := _ASSERT.match(text):
                    effects.append(("assert", m[1], m[2], build(m[3])))
                elif m := _EFFECT.match(text):
                    effects.append(("set", m[1], m[2], build(m[3])))
            self.rules.append((r, build(r.condition), effects))

    def act(self, env: dict, t: float) -> tuple[list, list]:
        """Runs the rules; gives (type, topic, senders per run) and (subject, predicate, value per run)."""
        sent, said = [], []
        outer = {k: (v[:, None] if isinstance(v, np.ndarray) and v.ndim == 1 else v) for k, v in env.items()}
        for r, condition, effects in self.rules:
            seen = {**outer, **self.state, **{f"inbox_{k}": v[:, None] for k, v in self.inbox.items()}}
            on = np.broadcast_to(np.not_equal(condition(seen), 0), self.strategy.shape)
            if r.strategy is not None and not r.meta:
                on = on & (self.strategy == self.agent.strategies.index(r.strategy))
            for kind, *what in effects:
                if kind == "send":
                    sent.append((what[0], what[1], on.sum(axis=1)))
                elif kind == "switch":
                    free = on & (t >= self.locked) & (what[0] in self.agent.strategies)
                    self.strategy = np.where(free, self.agent.strategies.index(what[0]) if what[0] in self.agent.strategies else 0, self.strategy)
                    self.locked = np.where(free, t + what[1], self.locked)
                elif kind == "assert":
                    value = np.broadcast_to(np.asarray(what[2]({**seen, **self.state}), float), self.strategy.shape)
                    said.append((what[0], what[1], np.where(on.any(axis=1), value[:, -1], np.nan)))
                elif what[0] in self.state:
                    name, op, f = what
                    old, value = self.state[name], f({**seen, **self.state})
                    new = {"+=": lambda a, b: a + b, "-=": lambda a, b: a - b, "*=": lambda a, b: a * b, "/=": lambda a, b: np.where(np.abs(b) > 1e-12, a / b, a), "=": lambda a, b: b + 0 * a}[op](old, np.asarray(value, float))
                    low, high = self.bounds[name]
                    self.state[name] = np.where(on & np.isfinite(new), np.clip(new, low, high), old)
        return sent, said

    def report(self) -> dict:
        out = {f"{self.agent.name}_count": np.full(len(self.strategy), float(self.agent.count))}
        for p, v in self.state.items():
            for n, f in (("avg", np.mean), ("sum", np.sum), ("min", np.min), ("max", np.max), ("var", np.var)):
                out[f"{self.agent.name}_{p}_{n}"] = f(v, axis=1)
        return out


class _Line:
    """A queue of one run."""

    def __init__(self, q: QueueDef):
        self.q, self.waiting, self.busy, self.n = q, [], [], 0
        self.arrivals = self.dropped = self.departed = 0
        self.part = 0.0

    def step(self, t: float, h: float, rate: float, service: float) -> None:
        self.part += max(0.0, rate) * h
        new, self.part = int(self.part), self.part - int(self.part)
        for _ in range(new):
            self.arrivals += 1
            if self.q.capacity is not None and len(self.waiting) + len(self.busy) >= self.q.capacity:
                self.dropped += 1
                continue
            heapq.heappush(self.waiting, (service if self.q.discipline == "SPT" else self.n, self.n, service))
            self.n += 1
        now = t
        while True:
            while len(self.busy) < self.q.servers and self.waiting:
                heapq.heappush(self.busy, now + heapq.heappop(self.waiting)[2])
            if not self.busy or self.busy[0] >= t + h:
                return
            now = heapq.heappop(self.busy)
            self.departed += 1


def simulate_hybrid(model: Model, runs: DataFrame, method: str = "euler", last: bool = False, functions: dict | None = None, seed: int = 42) -> DataFrame:
    """Trajectories of a model with agents and queues; kinds are stock, abm, des and kb (what KB_ASSERT says, by
    subject and predicate)."""
    system = lower(model)
    functions = {**registry.MODEL, **(functions or {})}

    def go(batches):
        worker, tables = Worker(system, functions), system.model.tables
        rate_of = [to_numpy(parse(q.arrival_rate), tables, functions) if q.arrival_rate else None for q in system.model.queues]
        service_of = [to_numpy(parse(q.service_time), tables, functions) for q in system.model.queues]
        for pdf in batches:
            if not len(pdf):
                continue
            ids, n = pdf["run_id"].to_numpy(np.int64), len(pdf)
            params = {c: pdf[c].to_numpy(float) for c in pdf.columns if c != "run_id"}
            crowds = [_Crowd(a, n, tables, functions) for a in system.model.agents]
            lines = [[_Line(q) for _ in range(n)] for q in system.model.queues]
            mail: list = []
            shown: dict = {}

            def hook(k, t, h, env, n=n, crowds=crowds, lines=lines, mail=mail, shown=shown):
                abm, des, kb = {}, {}, {}
                for c in crowds:
                    c.inbox = {}
                    for target, topic, count in mail:
                        if target == c.agent.name:
                            c.inbox[topic] = c.inbox.get(topic, 0) + count
                mail.clear()
                for c in crowds:
                    sent, said = c.act(env, t)
                    mail.extend(sent)
                    kb.update({f"{s} {p}": v for s, p, v in said})
                    abm.update(c.report())
                env = {**env, **abm}
                for q, own, rate, service in zip(system.model.queues, lines, rate_of, service_of, strict=True):
                    r = np.broadcast_to(np.asarray(rate(env) if rate else 0.0, float), (n,))
                    s = np.broadcast_to(np.asarray(service(env), float), (n,))
                    for i, x in enumerate(own):
                        x.step(t, h, float(r[i]), max(float(s[i]), 1e-9))
                    for what, f in (("length", lambda x: len(x.waiting) + len(x.busy)), ("arrivals", lambda x: x.arrivals), ("dropped", lambda x: x.dropped), ("departed", lambda x: x.departed)):
                        des[f"{q.name}_{what}"] = np.array([f(x) for x in own], float)
                for r in system.model.resources:
                    des[f"{r.name}_utilization"], des[f"{r.name}_available"] = np.zeros(n), np.full(n, float(r.capacity))
                shown.clear()
                shown.update({"abm": abm, "des": des, "kb": kb})
                return {**abm, **des}

            final = int(np.ceil((system.model.end - system.model.start) / system.model.dt - 1e-9))
            parts = []
            for k, t, env in worker.run(params, ids, method, seed, hook):
                if last and k < final:
                    continue
                values = [(s, "stock", env[s]) for s in system.stocks] + [(v, kind, x) for kind, own in shown.items() for v, x in own.items()]
                for v, kind, x in values:
                    parts.append(pd.DataFrame({"run_id": ids, "step": np.int32(k), "t": t, "var": v, "kind": kind, "value": np.broadcast_to(np.asarray(x, float), ids.shape)}))
                if len(parts) > 200:
                    yield pd.concat(parts)
                    parts = []
            if parts:
                yield pd.concat(parts)

    return runs.mapInPandas(go, TRAJECTORY)
