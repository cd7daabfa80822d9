"""From a request's words to a search plan. Every lexicon is a parameter; this runs on the driver, over one sentence."""

from __future__ import annotations

import re
import unicodedata

from .search import SearchPlan

Lexicon = dict[str, list[str]]


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _hits(text: str, term: str, substring: bool) -> int:
    """Where a term begins, or -1; by default only at a word's beginning."""
    if substring:
        return text.find(term)
    found = re.search(rf"\b{re.escape(term)}", text)
    return found.start() if found else -1


def plan(request: str, sectors: Lexicon, stages: list[str], needs: Lexicon, stopwords: set[str], ai_words: list[str], limit: int = 5, match: str = "word") -> SearchPlan:
    """Sectors, stages, needs in the order of the request, keywords and whether AI signs are asked for. A limit of 0 is
    the default one. ``match``: ``word`` or ``substring``."""
    text, loose = fold(request), match == "substring"
    places = {n: min((p for t in terms if (p := _hits(text, fold(t), loose)) >= 0), default=-1) for n, terms in needs.items()}
    words = [w for w in re.split(r"\W+", text) if len(w) > 1 and w not in stopwords]
    made = SearchPlan(
        sectors=[s for s, terms in sectors.items() if any(_hits(text, fold(t), loose) >= 0 for t in terms)],
        stages=[s for s in stages if fold(s) in text],
        keywords=list(dict.fromkeys(words)),
        priorities=sorted((n for n, p in places.items() if p >= 0), key=lambda n: places[n]),
        wants_ai=any(_hits(text, fold(w), loose) >= 0 for w in ai_words),
        limit=limit or 5,
    )
    made.strategy = strategy(made)
    return made


def strategy(p: SearchPlan) -> str:
    """A sentence that says what the plan does, from the plan itself."""
    if not p.discriminates():
        return "the request names no filter: the order is by name"
    parts = [f"{name} in {', '.join(v)}" for name, v in (("sector", p.sectors), ("stage", p.stages), ("place", p.places)) if v]
    parts += [f"words {', '.join(p.keywords)}"] if p.keywords else []
    parts += [f"needs first: {', '.join(p.priorities)}"] if p.priorities else []
    return "; ".join(parts)


def outcome(p: SearchPlan | None, found: int) -> str:
    """What is said of a search."""
    if p is None:
        return "no plan"
    if not found:
        return "nothing matches"
    return "matched" if p.discriminates() else "matched, but the request does not tell entities apart"
