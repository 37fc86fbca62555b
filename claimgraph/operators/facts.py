"""Technical-result facts: an action (a keyword noun), its object (a genitive phrase) and a condition (a prepositional phrase), as row patterns."""

from __future__ import annotations

from .lexicon import FACT_KEYWORDS
from .patterns import Step, longest

_STEMS = {k[:-2] if k.endswith(("ие", "ия", "ие")) else k.rstrip("яе"): k for k in FACT_KEYWORDS}
#: Steps of a fact. A phrase goes on over "и" if a word of a phrase follows. The first noun of the object is in no oblique case but the genitive's.
FACT = (
    Step("action"),
    Step("before", 0, None),  # adjectives of the object's first noun
    Step("object"),
    Step("more", 0, None),
)
CONDITION = (*FACT, Step("preposition"), Step("condition", 1, None))
OBLIQUE = ("Ins", "Dat", "Loc")


def _kinds(tokens: list[dict]) -> list[int]:
    """For each token the steps of CONDITION that take it, as bits."""
    out = []
    for i, t in enumerate(tokens):
        word = t["pos"] in ("ADJ", "NOUN")
        case = (t.get("grammar") or {}).get("Case")
        joins = t["text"].lower() == "и" and i + 1 < len(tokens) and tokens[i + 1]["pos"] in ("ADJ", "NOUN")
        takes = (stem_of(t) is not None, t["pos"] == "ADJ" or (joins and i > 0 and tokens[i - 1]["pos"] == "ADJ"), t["pos"] == "NOUN" and (case not in OBLIQUE or (i > 0 and (tokens[i - 1]["pos"] == "ADJ" or tokens[i - 1]["text"].lower() == "и"))), word or joins, t["pos"] == "ADP", word or t["pos"] == "CCONJ")
        out.append(sum(1 << k for k, x in enumerate(takes) if x))
    return out


def stem_of(token: dict) -> str | None:
    text = token["text"].lower()
    return next((s for s in _STEMS if token["pos"] == "NOUN" and text.startswith(s) and len(text) <= len(s) + 3), None)


def match_facts(tokens: list[dict]) -> list[dict]:
    """Facts of one annotated text, lower-case, each (action, object, condit) once; condit is None where there is none. An object may hold the
    keyword of a further fact."""
    kinds, none, out = _kinds(tokens), [{}] * len(tokens), []
    text = lambda first, last: " ".join(t["text"].lower() for t in tokens[first[0] : last[1]])
    for i, t in enumerate(tokens):
        found = kinds[i] & 1 and (longest(kinds, none, CONDITION, i) or longest(kinds, none, FACT, i))
        if found:
            fact = {"action": _STEMS[stem_of(t)], "object": text(found[1], found[3]), "condit": text(found[4], found[5]) if len(found) > 4 else None}
            out += [fact] if fact not in out else []
    return out
