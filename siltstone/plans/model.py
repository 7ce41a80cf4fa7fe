"""Models behind the planner, the judge, the schema and the retrieval agent. A model is any callable from a request (a dict) to a text;
whatever it says is checked, and where it fails or errs the rules take over and the answer says so."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import DataFrame

from siltstone.operators import retrieval
from siltstone.operators.inference import infer
from siltstone.operators.tasks import bootstrap
from siltstone.operators.validation import parse_object
from siltstone.plans import planner as pl
from siltstone.plans.agent import HeuristicJudge, State
from siltstone.plans.concurrent import together
from siltstone.schemas import Catalog, FieldSpec, validate_specs

Client = Callable[[dict[str, Any]], str]
CONFIDENCE = ("low", "medium", "high")
#: What a record has besides its fields.
RECORD_KEYS = ("call_id", "ordinal", "account_name", "customer_id", "date", "metadata", "evidence_refs", "quality_flags")

# ---- prompts ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prompt:
    """A versioned prompt; ``{name}`` places are filled in by ``render``."""

    name: str
    version: str
    template: str

    def render(self, **values: Any) -> str:
        return re.sub(r"\{([a-z_]+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], self.template)

    @property
    def digest(self) -> str:
        return hashlib.sha256(f"{self.name}\n{self.version}\n{self.template}".encode()).hexdigest()[:16]

    def metadata(self) -> dict[str, str]:
        return {"prompt_name": self.name, "prompt_version": self.version, "prompt_hash": self.digest}


PROMPTS = {
    p.name: p
    for p in (
        Prompt("planner", "1", "Plan how to answer the question over the catalog. Answer with one JSON object: operation, filters, group_by, expression, steps. Question: {query}"),
        Prompt("judge", "1", "Judge whether the evidence answers the question. Answer with one JSON object: answerable, evidence_sufficient, success, confidence, failure_modes. Question: {query}"),
        Prompt("schema", "1", "Propose at most {most} fields that calls like these should be described by. Answer with one JSON object: fields."),
        Prompt("tasks", "1", "Write at most {most} questions that this catalog should answer. Answer with one JSON object: tasks."),
        Prompt("search", "1", "Decide whether another search is needed. Answer with one JSON object: done, or tool and query. Question: {query}"),
    )
}


def prompt_state(prompts: dict[str, Prompt] = PROMPTS) -> dict[str, dict[str, str]]:
    return {k: p.metadata() for k, p in sorted(prompts.items())}


def response_text(response: Any) -> str:
    """The text of a chat or responses payload: ``output_text``, the joined texts of ``output``, or the first choice's message."""
    if isinstance(response, str):
        return response
    if not isinstance(response, dict):
        raise ValueError("a response must be an object or a text")
    if isinstance(response.get("output_text"), str):
        return response["output_text"]
    parts = [c.get("text") for item in response.get("output") or () if isinstance(item, dict) for c in item.get("content") or () if isinstance(c, dict)]
    parts = [p for p in parts if isinstance(p, str)]
    message = next((c.get("message", {}).get("content") for c in response.get("choices") or () if isinstance(c, dict)), None)
    if parts or isinstance(message, str):
        return "".join(parts) or message
    raise ValueError("a response without a text")


def _shown(catalog: Catalog) -> list[dict[str, Any]]:
    return [asdict(s) for s in catalog.fields.values()]


# ---- planner and judge -----------------------------------------------------------------------------------


class ModelPlanner:
    """Plans by a model; a request that fails or a plan that isn't valid is replaced by the rules', and ``planner`` of the plan says so."""

    def __init__(self, client: Client, name: str = "model", fallback: pl.Planner | None = None):
        self.client, self.name, self.fallback = client, name, fallback or pl.HeuristicPlanner()

    def _ask(self, query: str, catalog: Catalog, **more: Any) -> pl.Plan:
        try:
            text = self.client({"prompt": PROMPTS["planner"].render(query=query), **PROMPTS["planner"].metadata(), "query": query, "catalog": _shown(catalog), **more})
            return pl.bind(parse_object(response_text(text)), query, catalog, self.name)
        except Exception:  # noqa: BLE001  any fault of a client is answered by the rules
            plan = self.fallback.plan(query, catalog)
            return pl.replace(plan, planner=f"{self.name}->fallback:{plan.planner}")

    def plan(self, query: str, catalog: Catalog) -> pl.Plan:
        return self._ask(query, catalog)

    def replan(self, query: str, catalog: Catalog, observation: dict[str, Any]) -> pl.Plan:
        return self._ask(query, catalog, observation=compacted(replan_view(observation)))


def compacted(value: Any, items: int = 8, chars: int = 400) -> Any:
    """What a model is shown of a state: lists cut to the last ``items``, texts to ``chars``, at any depth."""
    if isinstance(value, dict):
        return {k: compacted(v, items, chars) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [compacted(v, items, chars) for v in value[-items:]]
    return value if not isinstance(value, str) or len(value) <= chars else value[: chars - 3] + "..."


# What a model is shown of each kind of thing: fixed sets of keys, and how many of them.


def _keys(items: list[dict[str, Any]], keys: tuple[str, ...]) -> list[dict[str, Any]]:
    return [{k: i.get(k) for k in keys} for i in items]


def record_view(records: list[dict[str, Any]], fields: tuple[str, ...], most: int = 12) -> list[dict[str, Any]]:
    """Records with their fields together, the first ``most``."""
    return [{**{k: r.get(k) for k in ("call_id", "account_name", "date")}, "fields": {f: r[f] for f in fields if f in r}, "quality_flags": r.get("quality_flags") or []} for r in records[:most]]


def evidence_view(evidence: list[dict[str, Any]], most: int = 8) -> list[dict[str, Any]]:
    return [e | {"matched_terms": e["matched_terms"] or []} for e in _keys(evidence[:most], ("chunk_id", "call_id", "snippet", "matched_terms"))]


def field_view(catalog: Catalog, most_values: int = 16) -> list[dict[str, Any]]:
    return [{"name": s.name, "type": s.type, "description": s.description, "allowed_values": list(s.allowed_values[:most_values]), "filterable": s.filterable, "aggregatable": s.aggregatable} for s in catalog.fields.values()]


def search_view(calls: list[dict[str, Any]], most: int = 6, shown: int = 3) -> list[dict[str, Any]]:
    """The last ``most`` searches, each with its first chunks."""
    return [{"tool": c.get("tool"), "query": c.get("query"), "result_count": len(c.get("chunks") or ()), "missing_terms": list(c.get("missing") or ()), "failure_reason": c.get("failure_reason") or "", "top_chunks": list(c.get("chunks") or ())[:shown]} for c in calls[-most:]]


def judgement_view(judgement: dict[str, Any]) -> dict[str, Any]:
    return {k: judgement.get(k) for k in ("judge", "answerable", "evidence_sufficient", "success", "needs_cu_feedback", "confidence", "failure_modes", "metrics")}


def replan_view(observation: dict[str, Any], most: int = 4) -> dict[str, Any]:
    """What a planner that plans again is shown: how the last plan was judged, how much it found, and some of what failed and of what was asked for."""
    told = judgement_view(observation.get("judgement") or {})
    return {"failure_modes": told["failure_modes"] or [], "success": told["success"], "counts": {k: len(observation.get(k) or ()) for k in ("records", "chunks")}, "column_requests": list((observation.get("judgement") or {}).get("missing_field_requests") or ())[:most], "search_failures": list(observation.get("failures") or ())[:most]}


class NoopJudge:
    """Says that nothing was judged."""

    def judge(self, plan: pl.Plan, state: State) -> dict[str, Any]:
        return {"answerable": True, "evidence_sufficient": True, "success": True, "needs_cu_feedback": False, "confidence": "low", "failure_modes": [], "missing_field_requests": [], "metrics": {}, "judge": "noop"}


class ModelJudge:
    """Judges by a model on top of the rules: their metrics stay, the model's flags, confidence and failure modes are normalised; where it fails the rules' verdict stands."""

    def __init__(self, client: Client, name: str = "model", fallback: Any = None):
        self.client, self.name, self.fallback = client, name, fallback or HeuristicJudge()

    def judge(self, plan: pl.Plan, state: State) -> dict[str, Any]:
        ruled = self.fallback.judge(plan, state)
        try:
            said = parse_object(response_text(self.client({"prompt": PROMPTS["judge"].render(query=plan.query), **PROMPTS["judge"].metadata(), "plan": asdict(plan), "state": compacted({"records": record_view(list(state.records.values()), tuple({k: None for r in state.records.values() for k in r if k not in RECORD_KEYS})), "evidence": evidence_view(state.evidence), "aggregation": state.aggregation, "failures": state.failures[-8:]}, items=12)})))
        except Exception:  # noqa: BLE001
            return ruled | {"judge": f"{self.name}->fallback:heuristic"}
        flags = {k: said[k] if isinstance(said.get(k), bool) else ruled[k] for k in ("answerable", "evidence_sufficient", "success")}
        modes = [str(m).strip() for m in said.get("failure_modes") or [] if str(m).strip()] if isinstance(said.get("failure_modes"), list) else ruled["failure_modes"]
        flags["success"] = flags["success"] and flags["answerable"]
        sure = said.get("confidence")
        return ruled | flags | {"confidence": sure if sure in CONFIDENCE else "low", "failure_modes": list(dict.fromkeys(modes)), "needs_cu_feedback": ruled["needs_cu_feedback"] or not flags["success"], "judge": self.name}


# ---- schema and tasks ------------------------------------------------------------------------------------


def induced(client: Client, chunks: DataFrame, strict: bool = False, most: int = 12, shown: int = 24) -> tuple[list[FieldSpec], str]:
    """(specs, provenance): a schema by a model that is shown ``shown`` chunks; with ``strict`` a fault is an error, else the counted schema is taken."""
    sample = [r.asDict() for r in chunks.orderBy("ordinal", "chunk_index").limit(shown).select("chunk_id", "text").collect()]
    try:
        got = parse_object(response_text(client({"prompt": PROMPTS["schema"].render(most=most), **PROMPTS["schema"].metadata(), "chunks": sample, "mode": "strict" if strict else "json"})))
        return validate_specs(got["fields"], most), "model"
    except Exception as e:
        if strict:
            raise ValueError(f"no schema from the model: {e}") from e
        return infer(chunks), "model->fallback:heuristic"


def model_tasks(client: Client, catalog: Catalog, most: int = 6) -> list[dict[str, Any]]:
    """Questions by a model, else those that the catalog's fields suggest."""
    try:
        got = parse_object(response_text(client({"prompt": PROMPTS["tasks"].render(most=most), **PROMPTS["tasks"].metadata(), "catalog": _shown(catalog)})))["tasks"]
        out = [{"query": str(t["query"]).strip(), "expected_operation": t.get("expected_operation") if t.get("expected_operation") in pl.OPERATIONS else None, "source_type": "llm_bootstrap"} for t in got if isinstance(t, dict) and str(t.get("query", "")).strip()]
    except Exception:  # noqa: BLE001
        out = []
    return out[:most] or bootstrap(catalog, most)


def schema_snapshot(catalog: Catalog) -> dict[str, Any]:
    """What a task's expectations were made for: fields, types and values, with a digest."""
    told = {s.name: {"type": s.type, "allowed_values": sorted(s.allowed_values)} for s in catalog.fields.values()}
    return {"adjusted_for": told, "schema_hash": hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]}


# ---- the retrieval agent ---------------------------------------------------------------------------------


@dataclass
class SearchCall:
    tool: str
    query: str
    chunks: list[str]
    missing: list[str] = field(default_factory=list)
    hits: list[dict[str, Any]] = field(default_factory=list, repr=False)


class RetrievalAgent:
    """Searches until a controller is content, at least ``least`` and at most ``most`` times. A search that says what an earlier one of the same tool said is
    refused; below ``least`` it is replaced by one for the terms that nothing has matched yet."""

    def __init__(self, search: Callable[[str, str], DataFrame], client: Client | None = None, least: int = 1, most: int = 4, alike: float = 0.8, tools: tuple[str, ...] = pl.SEARCH_TOOLS):
        self.search, self.client, self.least, self.most, self.alike, self.tools = search, client, least, most, alike, tools

    def _diverse(self, calls: list[SearchCall], tool: str, query: str) -> bool:
        return bool(query.strip()) and len(retrieval.diverse([*(c.query for c in calls if c.tool == tool), query], most=len(calls) + 2, alike=self.alike)) > len([c for c in calls if c.tool == tool])

    def _proposed(self, query: str, calls: list[SearchCall]) -> tuple[str, str] | None:
        if self.client is None:
            return None
        try:
            said = parse_object(response_text(self.client({"prompt": PROMPTS["search"].render(query=query), **PROMPTS["search"].metadata(), "query": query, "tools": list(self.tools), "calls": search_view([asdict(c) for c in calls])})))
        except Exception:  # noqa: BLE001
            return None
        tool = said.get("tool", "bm25_search_chunks")
        return None if said.get("done") or tool not in self.tools else (tool, str(said.get("query", "")))

    def run(self, query: str) -> list[SearchCall]:
        calls: list[SearchCall] = []
        asked: tuple[str, str] | None = ("bm25_search_chunks", query)
        while asked and len(calls) < self.most:
            tool, text = asked
            hits = [r.asDict() for r in self.search(tool, text).collect()]
            matched = {t for h in hits for t in h.get("matched_terms") or ()}
            calls.append(SearchCall(tool, text, [str(h["chunk_id"]) for h in hits], [t for t in pl.terms_of(text) if t not in matched][:8], hits))
            asked = self._proposed(query, calls)
            if asked and not self._diverse(calls, *asked):
                asked = None
            if asked is None and len(calls) < self.least:
                rest = " ".join(dict.fromkeys(t for c in calls for t in c.missing))
                asked = next(((t, rest) for t in ("bm25_search_chunks", "search_chunks") if self._diverse(calls, t, rest)), None)
        return calls


def branch_id(tool: str, query: str) -> str:
    return f"branch-{hashlib.sha256(f'{tool}|{" ".join(query.lower().split())}'.encode()).hexdigest()[:12]}"


def branches(agent: RetrievalAgent, queries: list[str], chunks: DataFrame, at_once: int = 8) -> dict[str, list[str]]:
    """One branch per diverse query, up to ``at_once`` side by side, in the queries' order: its stable id and the chunks it found, by first hit. A branch that names a
    chunk the corpus doesn't have is an error."""
    asked, spark = retrieval.diverse(queries), chunks.sparkSession
    runs = together(spark, [partial(agent.run, q) for q in asked], at_once)
    out = {branch_id("bm25_search_chunks", q): list(dict.fromkeys(i for c in calls for i in c.chunks)) for q, calls in zip(asked, runs)}
    named = sorted({i for found in out.values() for i in found})
    if named and (strange := [r[0] for r in retrieval.unknown_chunks(spark.createDataFrame([(i,) for i in named], "chunk_id string"), chunks.selectExpr("cast(chunk_id as string) as chunk_id")).collect()]):
        raise ValueError(f"a branch names unknown chunks: {sorted(strange)}")
    return out


def joined(found: dict[str, list[str]], limit: int = 20) -> list[str]:
    """Branches interleaved by rank, each chunk once."""
    longest = max(map(len, found.values()), default=0)
    return list(dict.fromkeys(ids[k] for k in range(longest) for ids in found.values() if k < len(ids)))[:limit]
