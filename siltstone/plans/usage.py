"""What model calls cost: parsed usage, prices, deltas and a budget."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field
from typing import Any

from siltstone.plans.agent import Guard

#: Prices are read from this variable: ``model=input/output`` in USD per million tokens, separated by commas.
PRICES = "SILTSTONE_PRICES"


def parse_usage(response: Any) -> tuple[int, int]:
    """(input, output) tokens of a response's ``usage``, under either pair of names; 0 where it tells none."""
    u = response.get("usage") if isinstance(response, dict) else None
    pick = lambda *names: next((int(u[n]) for n in names if isinstance(u.get(n), (int, float)) and not isinstance(u.get(n), bool)), 0)
    return (pick("input_tokens", "prompt_tokens"), pick("output_tokens", "completion_tokens")) if isinstance(u, dict) else (0, 0)


def prices_from(text: str | None) -> dict[str, tuple[float, float]]:
    out = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        model, _, rates = part.partition("=")
        i, _, o = rates.partition("/")
        try:
            out[model.strip()] = (float(i), float(o or i))
        except ValueError:
            raise ValueError(f"not a price: {part!r}") from None
    return out


def prices_of_environment() -> dict[str, tuple[float, float]]:
    return prices_from(os.environ.get(PRICES))


def cost_of(input_tokens: int, output_tokens: int, rates: tuple[float, float] | None) -> float | None:
    """USD to ten places; unknown without rates."""
    return None if rates is None else round((input_tokens * rates[0] + output_tokens * rates[1]) / 1e6, 10)


@dataclass
class Usage:
    """Totals by model, and what was added since a mark."""

    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    by_model: dict[str, list[int]] = field(default_factory=dict)

    def saw(self, model: str, input_tokens: int, output_tokens: int) -> None:
        t = self.by_model.setdefault(model, [0, 0, 0])
        for k, v in enumerate((1, input_tokens, output_tokens)):
            t[k] += v

    def totals(self) -> dict[str, Any]:
        costs = [cost_of(i, o, self.rates.get(m)) for m, (_, i, o) in self.by_model.items()]
        known = [c for c in costs if c is not None]
        return {"calls": sum(t[0] for t in self.by_model.values()), "input_tokens": sum(t[1] for t in self.by_model.values()), "output_tokens": sum(t[2] for t in self.by_model.values()), "cost_usd": round(sum(known), 10) if known or not costs else None}

    def mark(self) -> dict[str, Any]:
        return self.totals()

    def since(self, mark: dict[str, Any]) -> dict[str, Any]:
        now = self.totals()
        return {k: round(now[k] - (mark[k] or 0), 10) if now[k] is not None else None for k in now}

    def unpriced(self) -> list[str]:
        return sorted(m for m in self.by_model if m not in self.rates)


@dataclass
class BudgetGuard(Guard):
    """A guard that also stops at a sum of USD; models without a price can't be counted and are warned of once."""

    max_usd: float | None = None
    usage: Usage = field(default_factory=Usage)
    warned: bool = False

    def stopped(self) -> bool:
        if self.max_usd is not None:
            if self.usage.unpriced() and not self.warned:
                self.warned = True
                warnings.warn(f"models without a price don't count against the budget: {self.usage.unpriced()}", stacklevel=2)
            if self.reason is None and (self.usage.totals()["cost_usd"] or 0.0) >= self.max_usd:
                self.reason = "budget"
        return super().stopped()
