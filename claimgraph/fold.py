"""Triplets of a document folded into its invention graph, as pure functions; documents are independent.

The sides of a triplet are split into concepts, a concept into its name in dictionary form and its genitive tail. Concepts of
one name are one term; a pronoun stands for the invention, 'который' for its antecedent; what is someone's is linked to it.
"""

from __future__ import annotations

from .annotate import inflected
from .extraction import Side, phrase_at
from .linking import feature
from .operators.lexicon import PREPOSITIONS

ROOT = "0.0"
HAVE = {"verb_key": None, "preposition": None, "type": "have"}


# --- concepts ---------------------------------------------------------------------------------------------------------


def corrected(side: Side, role: str) -> None:
    """Heads that hang on another head are no heads, unless they are its equals; a conjunction is neither first nor last."""
    heads = {side.tokens[i]["id"]: i for i, (place, r) in side.labels.items() if place == "N" and r == role}
    for i in [i for i in heads.values() if side.tokens[i]["parent"] in heads and side.tokens[i]["deprel"] != "conj"]:
        side.labels[i] = ("I", role)
    own = sorted(i for i, (_, r) in side.labels.items() if r == role)
    for i in {own[0], own[-1]} if own else ():
        if side.tokens[i]["pos"] == "CCONJ":
            del side.labels[i]


def concepts(side: Side, role: str) -> tuple[list[dict], str | None]:
    """The side's coordinated phrases as concepts, and the words that introduce them."""
    heads = [i for i, (place, r) in sorted(side.labels.items()) if place == "N" and r == role]
    found: list[dict] = []
    held: list[int] = []
    introduced: list[str] = []
    open_ = True

    def close() -> None:
        if any(i in heads for i in held):
            found.append(concept(side, held, next(i for i in held if i in heads)))
        held.clear()

    for i, (place, r) in sorted(side.labels.items()):
        if r != role:
            continue
        if place == "P":
            if held:
                close()
            if open_:
                introduced.append(side.tokens[i]["text"].lower())
            continue
        open_ = open_ and not introduced
        if place == "N" and held and held[-1] != i - 1 and any(h in held for h in heads):
            close()  # another head beyond words that belong to neither
        between = side.tokens[i]["lemma"] == "и" and any(h < i for h in heads) and any(h > i for h in heads)
        if between and any(h in held for h in heads):
            close()
        else:
            held.append(i)
    close()
    return found, " ".join(introduced) or None


def concept(side: Side, places: list[int], head: int) -> dict:
    """key, text (in dictionary form up to its head), tail (what follows the head in the genitive), tokens' keys, head token."""
    tokens = side.tokens
    rest = [i for i in places if i > head and tokens[i]["lemma"] != "который"]
    genitive = bool(rest) and all(tokens[i]["pos"] in ("ADP", "CCONJ") or feature(tokens[i], "Case") in ("Gen", "Acc") for i in rest)
    name = [inflected(tokens[i], tokens[head]) for i in places if i <= head]
    if rest and not genitive:
        name += [tokens[i]["text"].lower() for i in rest]
    return {
        "key": f"{side.segment['id']}.{tokens[head]['id']}", "text": " ".join(name), "tail": " ".join(tokens[i]["text"].lower() for i in rest) if genitive else "",
        "keys": [f"{side.segment['id']}.{tokens[i]['id']}" for i in places], "tails": {f"{side.segment['id']}.{tokens[i]['id']}" for i in rest} if genitive else set(),
        "head": tokens[head], "which": side.which,
    }


def prepared(triplets: list[dict]) -> list[dict]:
    """Triplets as concepts; those of one verb are one, with the concepts of all on the side that continues."""
    out: dict[str, dict] = {}
    for t in triplets:
        corrected(t["subject"], "SBJ")
        corrected(t["object"], "OBJ")
        subjects, objects = concepts(t["subject"], "SBJ"), concepts(t["object"], "OBJ")
        known = out.get(t["act"]["key"])
        if known and t["act"]["side"] == "r":
            known["objects"] += objects[0]
        elif known:
            known["subjects"] += subjects[0]
        else:
            out[t["act"]["key"]] = {"subjects": subjects[0], "objects": objects[0], "verb": t["act"]["verb"], "key": t["act"]["key"], "preposition": objects[1]}
    return list(out.values())


# --- graph ------------------------------------------------------------------------------------------------------------


def stems(text: str) -> list[str]:
    """Words without their endings, as far as two forms of a word must agree."""
    return [w[: max(3, len(w) - 2)] for w in text.split()]


def same_words(a: list[str], b: list[str]) -> bool:
    return len(a) == len(b) and all(x[: min(len(x), len(y))] == y[: min(len(x), len(y))] for x, y in zip(a, b, strict=True))


class Graph:
    """terms, verbs, edges and refs of a document; later edges replace earlier ones between the same terms."""

    def __init__(self, root: Side | None, triplets: list[dict], segments: list[dict], deprecated=None):
        self.by_id, self.deprecated = {s["id"]: s for s in segments}, deprecated
        self.triplets = prepared(triplets)
        self.terms: dict[str, str] = {ROOT: "<UNKNOWN>"}
        self.head = None
        if root:
            corrected(root, "SBJ")
            named, _ = concepts(root, "SBJ")
            if named:
                self.head = named[0]["head"]
                self.terms[ROOT] = full(named[0])
        self.refs: dict[str, str] = {}
        self.verbs: dict[str, dict] = {}
        self.edges: dict[tuple[str, str], dict] = {}
        for at, t in enumerate(self.triplets):
            subjects = self.points(t["subjects"], at)
            objects = self.points(t["objects"], at) if subjects else []
            if objects:
                self.connect(t, subjects, objects)

    def connect(self, t: dict, subjects: list[str], objects: list[str]) -> None:
        verb = t["verb"]
        seen = self.verbs.setdefault(verb["lemma"], {"key": t["key"], "type": verb["kind"], "prepositions": {}})
        number = 0
        if t["preposition"]:
            word = PREPOSITIONS.get(t["preposition"], t["preposition"])
            number = seen["prepositions"].setdefault(word, len(seen["prepositions"]) + 1)
        for a in subjects:
            for b in objects:
                turn = verb["reversed"] or (b == ROOT and seen["type"] == "comp")
                if a != b:
                    self.link(*((b, a) if turn else (a, b)), {"verb_key": seen["key"], "preposition": number, "type": seen["type"]})

    def link(self, a: str, b: str, edge: dict) -> None:
        self.edges.pop((a, b), None)
        self.edges[a, b] = edge

    def points(self, found: list[dict], at: int) -> list[str]:
        """The terms of a side's concepts, made where they are new."""
        out = []
        for c in found:
            point = self.antecedent(c, at) if c["which"] and c["which"][0] == "which2" else self.point(c, at)
            if point is not None:
                out.append(point)
                if c["which"] and c["which"][0] == "which1":
                    owner = self.antecedent(c, at)
                    if owner is not None and owner != point:
                        self.link(owner, point, HAVE)
        return out

    def point(self, c: dict, at: int) -> str | None:
        if c["head"]["pos"] == "PRON":
            same = self.head and all(feature(c["head"], n) == feature(self.head, n) for n in ("Gender", "Number"))
            return ROOT if same else None
        if self.deprecated and self.deprecated(c["head"]["lemma"]):
            return None
        known = self.known(c)
        if known:
            if known != c["key"]:
                self.refs[c["key"]] = known
            return known
        owners, rest = self.owners(c["tail"], at) if c["tail"] else ([], "")
        self.terms[c["key"]] = " ".join(filter(None, (c["text"], rest)))
        for owner in owners:
            self.link(owner, c["key"], HAVE)
        return c["key"]

    def known(self, c: dict) -> str | None:
        k = self.refs.get(c["key"], c["key"])
        return k if k in self.terms else next((k for k, term in self.terms.items() if term == full(c)), None)

    def owners(self, tail: str, at: int) -> tuple[list[str], str]:
        """Earlier concepts that a genitive tail names, and what of the tail names none."""
        words, found = tail.split(), []
        for t in reversed(self.triplets[:at]):
            for c in (*t["subjects"], *t["objects"]):
                whole, name = stems(full(c)), stems(c["text"])
                tail_stems = stems(" ".join(words))
                owner = self.known(c)
                if owner is None:
                    continue
                if same_words(tail_stems, name) or same_words(tail_stems, whole[: len(words)]):
                    return [*found, owner], ""
                if len(whole) < len(words) and same_words(tail_stems[: len(whole)], whole):
                    words = words[len(whole) :]
                elif len(whole) < len(words) and same_words(tail_stems[-len(whole) :], whole):
                    words = words[: -len(whole)]
                else:
                    continue
                found.append(owner)
                words = [w for k, w in enumerate(words) if w != "и" or 0 < k < len(words) - 1]
                if not words:
                    return found, ""
        return found, " ".join(words)

    def antecedent(self, c: dict, at: int) -> str | None:
        """The term that a 'который' in a concept stands for: a term, the concept that holds it, or a phrase not met so far."""
        link = c["which"][1]
        if not link["parent"] or not link["point"]:
            return None
        key = f"{link['parent']}.{link['point']}"
        key = self.refs.get(key, key)
        if key in self.terms:
            return key
        holder = next((x for t in reversed(self.triplets[:at]) for x in (*t["subjects"], *t["objects"]) if key in x["keys"]), None)
        if holder and key not in holder["tails"]:
            return self.point(holder, at)
        segment = self.by_id.get(link["parent"])
        side = segment and phrase_at(segment, link["point"])
        if not side:
            return None
        heads = [i for i, (place, _) in side.labels.items() if place == "N"]
        made = concept(side, sorted(i for i in side.labels if i <= heads[0]), heads[0])
        known = self.known(made)
        if known is None:
            known = made["key"]
            self.terms[known] = made["text"]
        elif known != key:
            self.refs[key] = known
        return known

    def packed(self) -> dict:
        return {
            "terms": [{"key": k, "term": v, "ord": i} for i, (k, v) in enumerate(self.terms.items())],
            "verbs": [{"key": v["key"], "text": lemma, "type": v["type"], "prepositions": [{"number": n, "text": p} for p, n in v["prepositions"].items()]} for lemma, v in self.verbs.items()],
            "edges": [{"sbj_key": a, "obj_key": b, "verb_key": e["verb_key"], "prep_key": e["preposition"], "type": e["type"], "ord": i} for i, ((a, b), e) in enumerate(self.edges.items())],
            "refs": [{"key": v, "alias": k} for k, v in self.refs.items()],
        }


def full(c: dict) -> str:
    return " ".join(filter(None, (c["text"], c["tail"])))


def fold_graph(root: Side | None, triplets: list[dict], deprecated=None, segments: list[dict] = ()) -> dict:
    """The graph of a generic term and triplets as Extraction finds them in the segments."""
    return Graph(root, triplets, segments, deprecated).packed()
