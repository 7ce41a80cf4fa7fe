"""Plan, execute, judge, refine. The loop runs on the driver; every step is a Spark job whose small, limited
result comes back."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import partial
from typing import TYPE_CHECKING, Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import snippet
from siltstone.operators import aggregates, filters, retrieval
from siltstone.operators.search_index import SearchIndex
from siltstone.plans.concurrent import together
from siltstone.plans.planner import HeuristicPlanner, Plan, Planner, Request, Step, terms_of, values_of
from siltstone.schemas import Catalog

if TYPE_CHECKING:
    from siltstone.plans.model import SearchCall


class EmbeddingClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Judge(Protocol):
    def judge(self, plan: Plan, state: State) -> dict[str, Any]: ...


@dataclass
class Corpus:
    """Silver rows (call_id, ordinal, account_name, fields, evidence_refs), chunks (chunk_id, call_id, text) and the catalog.
    Search documents are built once; ``vectors`` (chunk_id, embedding) and a client are needed for embedding search only. ``mode`` is how
    the general search tools search where a step doesn't say; ``index`` answers BM25 in place of a scan of the documents."""

    silver: DataFrame
    chunks: DataFrame
    catalog: Catalog
    vectors: DataFrame | None = None
    client: EmbeddingClient | None = None
    controller: Callable[[dict[str, Any]], str] | None = None
    mode: str = "bm25"
    index: SearchIndex | None = None
    _docs: DataFrame | None = None

    @property
    def documents(self) -> DataFrame:
        if self._docs is None:
            names = tuple(n for n, s in self.catalog.fields.items() if s.filterable)
            self._docs = retrieval.search_documents(self.chunks, self.silver, names).cache()
        return self._docs

    def hits(self, tool: str, mode: str | None, asked: list[str], limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, rank, score, matched_terms) of all queries in one job, by the tool that was asked for; query_id is the place in ``asked``. What isn't
        scored by terms has no matched_terms, and a hybrid list has no score."""
        q = self.silver.sparkSession.createDataFrame(list(enumerate(asked)), "query_id int, query string")
        how = routed(tool, mode or self.mode)
        if how == "lexical":
            out = retrieval.lexical(self.chunks if allowed is None else self.chunks.join(allowed, "chunk_id", "left_semi"), q, limit)
        elif how == "bm25":
            out = self._bm25(q, limit, allowed)
        else:
            if self.client is None or self.vectors is None:
                raise ValueError("no embeddings in this corpus")
            out = retrieval.embedding_batch(self.vectors, list(enumerate(self.client.embed(asked))), limit, allowed)
            if how == "hybrid":
                out = retrieval.zipped(self._bm25(q, limit, allowed), out, limit)
        have = lambda c, kind: F.col(c) if c in out.columns else F.lit(None).cast(kind)
        return out.select("query_id", "chunk_id", "rank", have("score", "double").alias("score"), have("matched_terms", "array<string>").alias("matched_terms"))

    def _bm25(self, q: DataFrame, limit: int, allowed: DataFrame | None) -> DataFrame:
        return retrieval.bm25(self.documents, q, limit, allowed) if self.index is None else self.index.search(q, limit, allowed)


def routed(tool: str, mode: str | None) -> str:
    """How a search tool searches: the embedding tool always by vectors, BM25 unless the mode asks for vectors, the plain one in the mode's way."""
    if tool == "embedding_search_chunks" or mode == "embedding":
        return "embedding"
    if mode == "hybrid":
        return "hybrid"
    return "lexical" if mode == "lexical" and tool == "search_chunks" else "bm25"


@dataclass
class State:
    records: dict[str, dict[str, Any]] = field(default_factory=dict)
    chunks: dict[str, dict[str, Any]] = field(default_factory=dict)
    aggregation: dict[str, Any] = field(default_factory=dict)
    used_fields: list[str] = field(default_factory=list)
    evidence: list[dict[str, Any]] = field(default_factory=list)
    failures: list[dict[str, Any]] = field(default_factory=list)
    requests: list[Request] = field(default_factory=list)
    trace: list[dict[str, Any]] = field(default_factory=list)


@dataclass
class Guard:
    """Stops a run after consecutive errors (0: any number) or seconds; the first reason sticks."""

    max_errors: int = 3
    max_seconds: float | None = None
    errors: int = 0
    reason: str | None = None
    began: float = field(default_factory=time.monotonic)

    def saw(self, ok: bool) -> None:
        self.errors = 0 if ok else self.errors + 1
        if self.reason is None and 0 < self.max_errors <= self.errors:
            self.reason = "max_errors"

    def stopped(self) -> bool:
        if self.reason is None and self.max_seconds is not None and time.monotonic() - self.began >= self.max_seconds:
            self.reason = "timeout"
        return self.reason is not None


class HeuristicJudge:
    def judge(self, plan: Plan, state: State) -> dict[str, Any]:
        answerable = bool(state.aggregation if plan.operation == "aggregate" else state.records)
        enough = not (plan.evidence and answerable) or bool(state.evidence)
        modes = [
            name
            for name, on in (
                ("empty_aggregation", plan.operation == "aggregate" and not state.aggregation),
                ("no_records", plan.operation != "aggregate" and not state.records),
                ("missing_evidence", not enough),
                ("retrieval_failure", bool(state.failures)),
                ("schema_gap", bool(state.requests)),
                ("search_only_schema_gap", plan.operation == "search" and answerable and bool(state.requests)),
            )
            if on
        ]
        success = answerable and enough
        confidence = "low" if not success else "medium" if state.failures or state.requests or plan.operation == "search" else "high"
        return {
            "answerable": answerable, "evidence_sufficient": enough, "success": success, "needs_cu_feedback": bool(state.requests) or not success or bool(state.failures), "confidence": confidence, "failure_modes": modes,
            "missing_field_requests": [asdict(r) for r in state.requests], "metrics": {"record_count": len(state.records), "evidence_count": len(state.evidence), "aggregation_group_count": len(state.aggregation), "search_failure_count": len(state.failures), "column_request_count": len(state.requests)},
        }


def as_result(compiled: aggregates.Compiled) -> dict[str, Any]:
    """An aggregate as the nested dict that an answer shows. Groups are vocabulary-sized."""
    rows = compiled.frame.collect()
    if compiled.kind != "table":
        return {k: v for k, v in rows[0].asDict().items()} if rows else {}
    out: dict[str, Any] = {}
    for r in rows:
        *keys, n = r
        at = out
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        at[keys[-1]] = n
    return out


class Agent:
    def __init__(self, corpus: Corpus, planner: Planner | None = None, judge: Judge | None = None, max_iterations: int = 2, guard: Guard | None = None):
        self.corpus, self.planner, self.judge = corpus, planner or HeuristicPlanner(), judge or HeuristicJudge()
        self.max_iterations, self.guard = max_iterations, guard or Guard()

    def answer(self, query: str) -> dict[str, Any]:
        state, catalog = State(), self.corpus.catalog
        plan = self.planner.plan(query, catalog)
        for k in range(self.max_iterations):
            for step in plan.steps:
                if self.guard.stopped():
                    break
                began = time.monotonic()
                try:
                    note, ok = self._step(step, query, plan, state), True
                except (ValueError, RuntimeError) as e:
                    note, ok = f"error: {e}", False
                self.guard.saw(ok)
                state.trace.append({"iteration": k + 1, "tool": step.tool, "arguments": step.arguments, "result": note, "latency_ms": round(1000 * (time.monotonic() - began), 3)})
            verdict = self.judge.judge(plan, state)
            if verdict["success"] or self.guard.stopped() or k + 1 == self.max_iterations or not hasattr(self.planner, "replan"):
                break
            plan = self.planner.replan(query, catalog, {"judgement": verdict, "records": list(state.records)[:10], "chunks": list(state.chunks)[:8], "failures": state.failures})
        if self.guard.reason:
            verdict = verdict | {"success": False, "needs_cu_feedback": True, "failure_modes": [*verdict["failure_modes"], f"guardrail:{self.guard.reason}"]}
        return {"query": query, "plan": plan, "answer": self._text(plan, state), "records": list(state.records.values()), "aggregation": state.aggregation, "evidence": state.evidence, "column_requests": state.requests, "judgement": verdict, "trace": state.trace}

    def _text(self, plan: Plan, state: State) -> str:
        if plan.operation == "aggregate":
            if not state.aggregation:
                return "No matching records were found for the requested aggregation."
            pairs = ", ".join(f"{k}: {v}" for k, v in state.aggregation.items())
            return f"Aggregation expression returned: {pairs}." if plan.expression else f"Grouped by {plan.group_by}: {pairs}."
        if not state.records:
            return "No matching calls were found."
        return f"Found {len(state.records)} matching call(s): " + ", ".join(f"{r['call_id']} ({r.get('account_name')})" for r in list(state.records.values())[:6]) + "."

    def _matching(self, given: dict[str, Any] | None, limit: int | None = None) -> DataFrame:
        return filters.query_silver(self.corpus.silver, filters.validate_filters(given or {}, self.corpus.catalog), limit)

    def _step(self, step: Step, query: str, plan: Plan, state: State) -> str:
        a, c = step.arguments, self.corpus
        if step.tool == "query_silver":
            rows = [r.asDict(recursive=True) for r in self._matching(a.get("filters", plan.filters), retrieval.bounded_limit(a.get("limit"), 50)).collect()]
            for r in rows:
                state.records.setdefault(r["call_id"], r)
            return f"{len(rows)} records"
        if step.tool == "aggregate_silver":
            got = aggregates.aggregate_silver(self._matching(a.get("filters", plan.filters)), c.catalog, a.get("group_by"), a.get("expression"))
            state.aggregation, state.used_fields = as_result(got), got.used_fields
            return f"{len(state.aggregation)} groups"
        if step.tool in ("search_chunks", "bm25_search_chunks", "embedding_search_chunks"):
            return self._search(step, query, plan, state)
        if step.tool == "fetch_chunks":
            return self._fetch(retrieval.bounded_limit(a.get("limit"), 8), state, list(a.get("refs") or ()), plan)
        if step.tool == "review_schema_gaps":
            state.requests = list({(r.action, r.field_name): r for r in (*plan.requests, *state.requests, *gaps(query, plan, state, c.catalog))}.values())
            return f"{len(state.requests)} requests"
        raise ValueError(f"tool not allowed: {step.tool}")

    def _search(self, step: Step, query: str, plan: Plan, state: State) -> str:
        """One query or a fan-out, one job a tool: every query is searched by the tool that was asked for, among the calls that the filters leave."""
        a, c = step.arguments, self.corpus
        limit = retrieval.bounded_limit(a.get("limit"), 10)
        asked = retrieval.diverse([str(q) for q in a.get("queries") or () if str(q).strip()] or [a.get("query") or query])
        given = a.get("filters", plan.filters)
        allowed = c.documents.join(self._matching(given).select("call_id"), "call_id", "left_semi").select("chunk_id") if given else None
        if a.get("mode", c.mode) == "agentic":
            calls = self._searched(asked, limit, allowed)
            asked = [call.query for call in calls]
            told = [(k, str(h["chunk_id"]), h["rank"], h["score"]) for k, call in enumerate(calls) for h in call.hits]
            hits = c.silver.sparkSession.createDataFrame(told, "query_id int, chunk_id string, rank int, score double").withColumn("chunk_id", F.col("chunk_id").cast(c.chunks.schema["chunk_id"].dataType))
        else:
            hits = c.hits(step.tool, a.get("mode"), asked, limit, allowed)
        rows = hits.join(c.chunks.select("chunk_id", "call_id", snippet("text").alias("snippet")), "chunk_id").orderBy("query_id", "rank").select("query_id", "chunk_id", "call_id", "snippet", "score", "rank").collect()
        for k, text in enumerate(asked):
            if not any(r["query_id"] == k for r in rows):
                state.failures.append({"tool": step.tool, "query": text, "query_terms": terms_of(text), "failure_reason": "no chunks matched"})
        for r in rows:
            state.chunks.setdefault(r["chunk_id"], r.asDict())
        if (a.get("promote_records") or plan.operation == "search") and rows:
            for r in retrieval.records_for(hits, c.chunks, c.silver).limit(limit).collect():
                state.records.setdefault(r["call_id"], r.asDict(recursive=True))
        return f"{len(rows)} chunks for {len(asked)} queries"

    def _searched(self, asked: list[str], limit: int, allowed: DataFrame | None) -> list[SearchCall]:
        """The searches of a retrieval agent per question, led by the corpus' controller where it has one, each by the tool that it names. Questions
        run side by side and come back in their order."""
        from siltstone.plans.model import RetrievalAgent

        mode = "lexical"  # for the plain tool: the other two name their own way
        look = lambda tool, text: self.corpus.hits(tool, mode, [text], limit, allowed)
        tools = ("bm25_search_chunks", "search_chunks", *(["embedding_search_chunks"] if self.corpus.client is not None else []))
        run = lambda text: RetrievalAgent(look, self.corpus.controller, least=2, tools=tools).run(text)
        return [call for calls in together(self.corpus.silver.sparkSession, [partial(run, text) for text in asked]) for call in calls]

    def _fetch(self, limit: int, state: State, given: list[str], plan: Plan) -> str:
        """Chunks by the refs given, else those of the records, else of the rows that were aggregated, else of the chunks found."""
        refs = given or [x for r in state.records.values() for xs in (r.get("evidence_refs") or {}).values() for x in xs]
        if not refs and state.used_fields:
            refs = [r["ref"] for r in aggregates.evidence_refs(self._matching(plan.filters), state.used_fields, limit).collect()]
        refs = list(dict.fromkeys(refs or [f"chunk:{i}" for i in state.chunks]))[:limit]
        if not refs:
            return "nothing to fetch"
        frame = self.corpus.silver.sparkSession.createDataFrame(list(enumerate(refs)), "pos int, ref string")
        got = retrieval.fetch(self.corpus.chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "call_id", snippet("text").alias("snippet")), frame).collect()
        known = {e["chunk_id"] for e in state.evidence}
        scores = lambda i: {k: v for k, v in state.chunks.get(i, {}).items() if k in ("score", "rank") and v is not None}
        state.evidence += [{"chunk_id": r["chunk_id"], "call_id": r["call_id"], "snippet": r["snippet"], **scores(r["chunk_id"])} for r in got if r["chunk_id"] not in known]
        return f"{len(got)} chunks"


def gaps(query: str, plan: Plan, state: State, catalog: Catalog) -> list[Request]:
    """What the schema lacks, from how the plan went."""
    empty_filter = bool(plan.filters) and not state.records and bool(state.chunks)
    why = (
        "filters found no records though retrieval found evidence" if empty_filter else
        "the aggregation found no groups" if plan.operation == "aggregate" and not state.aggregation else
        "only retrieval could answer: no field holds the concept" if plan.operation == "search" and state.chunks else
        "searches failed" if state.failures and (plan.operation == "search" or not state.records) else None
    )
    if why is None:
        return []
    words = values_of(query, state.failures)
    name = re.sub("[^a-z0-9]+", "_", "_".join(words[:3])).strip("_") or "query_signal"
    action = "improve_extraction" if empty_filter or name in catalog.fields else "add_field"
    return [Request(action, name, "list", f"Signal that makes downstream queries expressible: {query}", why, "high" if state.chunks else "medium", tuple(words), (query,), tuple(f"chunk:{c}" for c in list(state.chunks)[:3]))]
