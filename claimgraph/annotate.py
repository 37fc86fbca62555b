"""Annotators: text to tokens with part of speech, lemma, features, head and noun-phrase mark.

Any object with annotate(text) -> list of token dicts will do (see Annotator). RuleAnnotator is built in: closed word lists,
stems of the dictionary verbs and endings. It needs no model; its accuracy is that of endings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import Protocol

from .operators.lexicon import SEPARATORS, verbs


class Annotator(Protocol):
    def annotate(self, text: str) -> list[dict]: ...


WORD = re.compile(r"[A-Za-zА-Яа-яЁё0-9]+(?:-[A-Za-zА-Яа-яЁё0-9]+)*|[^\sA-Za-zА-Яа-яЁё0-9]")
# Closed classes, and the cases that prepositions govern.
CASES_AFTER = {
    "в": ("Loc", "Acc"), "во": ("Loc", "Acc"), "на": ("Loc", "Acc"), "из": ("Gen",), "изо": ("Gen",), "с": ("Ins", "Gen"), "со": ("Ins", "Gen"), "к": ("Dat",), "ко": ("Dat",), "для": ("Gen",), "от": ("Gen",),
    "до": ("Gen",), "у": ("Gen",), "без": ("Gen",), "через": ("Acc",), "между": ("Ins",), "под": ("Ins", "Acc"), "над": ("Ins",), "перед": ("Ins",), "по": ("Dat",), "о": ("Loc",), "об": ("Loc",), "при": ("Loc",), "внутри": ("Gen",), "вокруг": ("Gen",), "посредством": ("Gen",), "за": ("Ins", "Acc"),
}
UNITS = frozenset("мм см дм км мкм нм кг мг гц кгц мгц вт квт мпа кпа мин".split())
CLOSED = {"и": "CCONJ", "или": "CCONJ", "а": "CCONJ", "но": "CCONJ", "либо": "CCONJ", "что": "SCONJ", "чтобы": "SCONJ", "если": "SCONJ", "как": "SCONJ", "причем": "SCONJ", "не": "PART", "же": "PART", "также": "ADV", "при этом": "ADV", "соосно": "ADV", "жестко": "ADV", "вертикально": "ADV"}
PRONOUNS = {"он": "Masc", "она": "Fem", "оно": "Neut", "они": None, "его": "Masc", "ее": "Fem", "её": "Fem", "их": None, "им": "Masc", "ним": "Masc", "ней": "Fem", "ними": None, "них": None}
WHICH = {"который": ("Masc", "Nom"), "которая": ("Fem", "Nom"), "которое": ("Neut", "Nom"), "которые": (None, "Nom"), "которого": ("Masc", "Gen"), "которой": ("Fem", "Loc"), "котором": ("Masc", "Loc"), "которую": ("Fem", "Acc"), "которым": ("Masc", "Ins"), "которых": (None, "Loc"), "которыми": (None, "Ins")}
STEMS = {
    "содержать": ("содерж",), "оснащать": ("оснащ",), "включать": ("включ",), "иметь": ("имеющ", "имее", "имею"), "снабжать": ("снабж",), "вводить": ("введ", "вводи"), "состоять": ("состоя", "состои"), "изготавливать": ("изготовл", "изготавлив"),
    "составлять": ("составл",), "выполнять": ("выполн",), "использоваться": ("использу",), "являться": ("являе", "являю", "являющ"), "служить": ("служи", "служа"), "образовывать": ("образу", "образов"), "добавлять": ("добавл",), "помещать": ("помещ",),
    "укладывать": ("улож", "укладыв"), "устанавливать": ("установл", "устанавлив"), "подключать": ("подключ",), "подтягивать": ("подтян", "подтяг"), "соединять": ("соединя", "соединё", "соединен"), "взаимодействовать": ("взаимодейств",), "скреплять": ("скрепл",),
    "крепиться": ("крепи", "крепя"), "согласовывать": ("согласов",), "закреплять": ("закрепл",), "пересекаться": ("пересек",), "связанный": ("связан",), "шунтировать": ("шунтир",), "находиться": ("находи", "находя"), "надевать": ("надет", "надева"),
    "размещать": ("размещ",), "располагать": ("располож", "располага"), "сообщаться": ("сообща", "сообщен"), "сопряженный": ("сопряж",), "открывать": ("открыва", "открыт"), "изолировать": ("изолир",), "предназначать": ("предназнач",), "называть": ("называ", "назван"),
}
PARTICIPLE = re.compile(r"(?:щ|вш|нн|т|ем|им)(ий|ый|ая|ое|ее|ие|ые|его|ого|ей|ой|ем|ом|им|ым|их|ых|ими|ыми|ую|юю)(?:ся)?$")
SHORT = re.compile(r"(?:ен|ён|ан|ян|т|щен|жен)(|а|о|ы)$")
FINITE = re.compile(r"(?:ет|ит|ют|ят|ут|ат|ют|яет|ает|ал|ил|ел)(?:ся)?$")
ADJECTIVE = re.compile(r"(ый|ий|ой|ая|яя|ое|ее|ые|ие|ого|его|ому|ему|ым|им|ом|ем|ую|юю|ей|ых|их|ыми|ими)$")
NOUNLIKE = re.compile(r"(ние|ния|нию|нием|нии|ость|ости|остью|ция|ции|цию|цией|тор|тора|тором|тель|теля|телем|тели|ник|ника|ником|ники)$")
ADJ_FORMS = {"ый": ("Masc", "Nom"), "ий": ("Masc", "Nom"), "ой": ("Fem", "Gen"), "ая": ("Fem", "Nom"), "яя": ("Fem", "Nom"), "ое": ("Neut", "Nom"), "ее": ("Neut", "Nom"), "ые": (None, "Nom"), "ие": (None, "Nom"), "ого": ("Masc", "Gen"), "его": ("Masc", "Gen"), "ому": ("Masc", "Dat"), "ему": ("Masc", "Dat"), "ым": ("Masc", "Ins"), "им": ("Masc", "Ins"), "ом": ("Masc", "Loc"), "ем": ("Masc", "Loc"), "ую": ("Fem", "Acc"), "юю": ("Fem", "Acc"), "ей": ("Fem", "Gen"), "ых": (None, "Gen"), "их": (None, "Gen"), "ыми": (None, "Ins"), "ими": (None, "Ins")}
#: Noun endings to (gender, number, possible cases), longest first.
NOUN_FORMS = (
    ("ями", None, "Plur", ("Ins",)), ("ами", None, "Plur", ("Ins",)), ("ием", "Neut", "Sing", ("Ins",)), ("ия", "Neut", "Sing", ("Gen", "Nom")), ("ие", "Neut", "Sing", ("Nom", "Acc")), ("ии", "Fem", "Sing", ("Gen", "Loc", "Dat")), ("ость", "Fem", "Sing", ("Nom", "Acc")), ("ью", "Fem", "Sing", ("Ins",)),
    ("ах", None, "Plur", ("Loc",)), ("ях", None, "Plur", ("Loc",)), ("ов", None, "Plur", ("Gen",)), ("ев", None, "Plur", ("Gen",)), ("ам", None, "Plur", ("Dat",)), ("ям", None, "Plur", ("Dat",)), ("ом", "Masc", "Sing", ("Ins",)), ("ем", "Masc", "Sing", ("Ins",)), ("ой", "Fem", "Sing", ("Ins",)), ("ей", "Fem", "Sing", ("Ins", "Gen")),
    ("а", "Fem", "Sing", ("Nom", "Gen")), ("я", "Fem", "Sing", ("Nom", "Gen")), ("у", "Fem", "Sing", ("Acc", "Dat")), ("ю", "Fem", "Sing", ("Acc", "Dat")), ("ы", "Fem", "Plur", ("Nom", "Acc", "Gen")), ("и", "Fem", "Plur", ("Nom", "Acc", "Gen")), ("о", "Neut", "Sing", ("Nom", "Acc")), ("е", "Masc", "Sing", ("Loc", "Dat", "Nom")), ("", "Masc", "Sing", ("Nom", "Acc")),
)


def verb_of(word: str) -> str | None:
    best = max(((len(s), lemma) for lemma, stems in STEMS.items() for s in stems if word.startswith(s)), default=None)
    return best[1] if best else None


class RuleAnnotator:
    """Endings, closed lists and stems; one pass over the words, then cases by preposition, phrases and heads."""

    def annotate(self, text: str) -> list[dict]:
        tokens = [self._token(i + 1, w) for i, w in enumerate(WORD.findall(text))]
        for t, following in zip(tokens, [*tokens[1:], None], strict=True):
            low = t["text"].lower()
            if t["pos"] == "ADJ" and low.endswith(("ном", "вом")) and (following is None or following["pos"] not in ("NOUN", "ADJ")):
                t |= {"pos": "NOUN", "lemma": low[:-2], "grammar": {"Gender": "Masc", "Number": "Sing", "Case": "Ins"}, "cases": ("Ins",)}
        self._cases(tokens)
        self._phrases(tokens)
        self._heads(tokens)
        return tokens

    def _token(self, i: int, word: str) -> dict:
        low = word.lower()
        t = {"id": str(i), "text": word, "lemma": low, "pos": "NOUN", "grammar": {}, "parent": "0", "deprel": "dep", "mark": "O"}
        if not re.search(r"\w", word):
            return t | {"pos": "SYM" if word in "°%=" else "PUNCT", "grammar": None}
        if re.fullmatch(r"REP[0-9]+", word):
            return t | {"pos": "X"}
        if re.fullmatch(r"[0-9]+", word):
            return t | {"pos": "NUM"}
        if low in UNITS:
            return t | {"pos": "SYM"}
        if low == "себя":
            return t | {"pos": "PRON", "grammar": {"Case": "Gen"}}
        if low in CASES_AFTER:
            return t | {"pos": "ADP"}
        if low in CLOSED:
            return t | {"pos": CLOSED[low]}
        if low in WHICH:
            gender, case = WHICH[low]
            return t | {"pos": "PRON", "lemma": "который", "grammar": {"Gender": gender or "Masc", "Number": "Sing" if gender else "Plur", "Case": case}}
        if low in PRONOUNS:
            return t | {"pos": "PRON", "grammar": {"Gender": PRONOUNS[low] or "Masc", "Number": "Sing" if PRONOUNS[low] else "Plur", "Case": "Nom"}}
        lemma = verb_of(low)
        if lemma and not NOUNLIKE.search(low):
            if m := PARTICIPLE.search(low):
                gender, case = ADJ_FORMS.get(m[1], ("Masc", "Nom"))
                passive = re.search(r"(нн|т|ем|им)" + m[1] + "$", low) is not None
                return t | {"pos": "VERB", "lemma": lemma, "grammar": {"VerbForm": "Part", "Gender": gender or "Masc", "Number": "Sing" if gender else "Plur", "Case": case} | ({"Voice": "Pass", "Aspect": "Perf"} if passive else {})}
            if m := SHORT.search(low):
                return t | {"pos": "VERB", "lemma": lemma, "grammar": {"VerbForm": "Fin", "Voice": "Pass", "Aspect": "Perf", "Number": "Plur" if m[1] == "ы" else "Sing", "Gender": {"а": "Fem", "о": "Neut"}.get(m[1], "Masc")}}
            if FINITE.search(low) or low.endswith("ть"):
                return t | {"pos": "VERB", "lemma": lemma, "grammar": {"VerbForm": "Inf" if low.endswith("ть") else "Fin"}}
            if low.endswith(("я", "в")):
                return t | {"pos": "VERB", "lemma": lemma, "grammar": {"VerbForm": "Conv"}}
        if (m := ADJECTIVE.search(low)) and not NOUNLIKE.search(low) and len(low) > len(m[1]) + 2 and m[1] not in ("ом", "ем", "ей", "ой", "им", "ее", "ие", "их") or re.search(r"(н|ск|ов|лев)(ой|ие|ий|ом|им|их|ем|ей)$", low) and not NOUNLIKE.search(low):
            ending = ADJECTIVE.search(low)[1]
            gender, case = ADJ_FORMS[ending]
            return t | {"pos": "ADJ", "lemma": low[: -len(ending)] + "ый", "grammar": {"Gender": gender or "Masc", "Number": "Sing" if gender else "Plur", "Case": case}}
        if low.endswith("о") and re.search(r"(н|льн|к)о$", low):
            return t | {"pos": "ADV"}
        ending, gender, number, cases = next(f for f in NOUN_FORMS if low.endswith(f[0]))
        return t | {"lemma": nominative(low, ending, gender, number), "grammar": {"Gender": gender or "Masc", "Number": number, "Case": cases[0]}, "cases": cases}

    def _cases(self, tokens: list[dict]) -> None:
        governed, noun_before, adjective, before = None, False, None, ()
        for t in tokens:
            if t["pos"] == "ADP":
                governed, noun_before = CASES_AFTER[t["text"].lower()], False
            elif t["pos"] in ("NOUN", "ADJ"):
                options = t.pop("cases", (t["grammar"]["Case"],))
                wanted = governed or before or (("Gen",) if noun_before and t["pos"] == "NOUN" else ())
                t["grammar"]["Case"] = next((c for c in wanted if c in options), wanted[0] if governed and t["pos"] == "ADJ" else options[0])
                if t["pos"] == "ADJ":
                    adjective = t
                elif t["text"].lower() == "виде" and governed:  # "в виде" is a preposition of two words
                    t["deprel"], governed, noun_before = "fixed", None, True
                else:
                    _settle(t, adjective)
                    governed, noun_before, adjective, before = None, True, None, ()
            elif t["pos"] != "NUM":
                # Behind a conjunction the case of the noun before it is likely.
                last = next((x for x in reversed(tokens[: int(t["id"]) - 1]) if x["pos"] == "NOUN"), None)
                before = (last["grammar"]["Case"],) if t["pos"] == "CCONJ" and noun_before and last else ()
                governed, noun_before, adjective = None, False, None

    def _phrases(self, tokens: list[dict]) -> None:
        number, inside = 1, False
        for k, t in enumerate(tokens):
            nominal = t["pos"] in ("NOUN", "ADJ", "NUM", "DET", "X") or (t["pos"] == "SYM" and t["text"].isalpha()) or (t["pos"] == "PRON" and t["lemma"] not in ("который", "себя"))
            starts = nominal and inside and t["pos"] == "NOUN" and tokens[k - 1]["pos"] == "NOUN" and t["grammar"]["Case"] != "Gen"
            if inside and (not nominal or starts):
                number, inside = number + 1, False
            if nominal:
                t["mark"], inside = str(number), True
        for s in SEPARATORS:
            parts = s.split()
            if [t["text"].lower() for t in tokens[: len(parts)]] == parts:
                for t in tokens[: len(parts)]:
                    t["mark"] = "S"

    def _heads(self, tokens: list[dict]) -> None:
        noun = None
        verb = next((t["id"] for t in tokens if t["pos"] == "VERB"), None)
        for k, t in enumerate(tokens):
            after = next((x for x in tokens[k + 1 :] if x["pos"] == "NOUN"), None)
            if t["pos"] in ("ADJ", "NUM", "ADP") and after:
                t["parent"], t["deprel"] = after["id"], {"ADJ": "amod", "NUM": "nummod", "ADP": "case"}[t["pos"]]
            elif t["deprel"] == "fixed":
                t["parent"] = tokens[k - 1]["id"]
            elif t["pos"] == "NOUN":
                conj = noun and k and tokens[k - 1]["pos"] == "CCONJ"
                if conj or (noun and t["grammar"]["Case"] == "Gen" and t["mark"] == noun["mark"]):
                    t["parent"], t["deprel"] = noun["id"], "conj" if conj else "nmod"
                else:
                    t["parent"], t["deprel"] = (verb, "nsubj" if t["grammar"]["Case"] == "Nom" else "obl") if verb else ("0", "root")
                noun = t
            elif t["id"] == verb:
                t["parent"], t["deprel"] = "0", "root"


def _settle(noun: dict, adjective: dict | None) -> None:
    """What a noun's case, or the adjective before it, tells of its gender, number and dictionary form."""
    low, g = noun["text"].lower(), noun["grammar"]
    of = (adjective or {}).get("grammar") or {}
    if g["Number"] == "Plur" and low.endswith("и") and of.get("Number") == "Sing" and of.get("Gender") == "Fem":
        g |= {"Number": "Sing", "Gender": "Fem"}
        noun["lemma"] = low[:-1] + "ь"
    elif g["Number"] == "Sing" and g["Case"] == "Gen" and low.endswith("а"):
        g["Gender"], noun["lemma"] = "Masc", low[:-1]
    elif g["Number"] == "Sing" and g["Case"] == "Gen" and low.endswith("я") and not low.endswith("ия"):
        g["Gender"], noun["lemma"] = "Masc", low[:-1] + "ь"
    elif g["Case"] == "Loc" and low.endswith("е") and of.get("Gender") != "Fem":
        noun["lemma"] = low[:-1]
    elif g["Case"] == "Loc" and low.endswith("е"):
        g["Gender"], noun["lemma"] = "Fem", low[:-1] + "а"
    elif g["Case"] == "Dat" and low.endswith("у"):
        g["Gender"], noun["lemma"] = "Masc", low[:-1]
    elif g["Case"] == "Ins" and low.endswith("ем"):
        noun["lemma"] = low[:-2] + "ь"


def nominative(word: str, ending: str, gender: str | None, number: str) -> str:
    """A noun's dictionary form, as far as its ending tells."""
    base = word[: len(word) - len(ending)] if ending else word
    if number == "Plur" and ending in ("ами", "ах", "ов", "ам", "ы"):
        return base
    if ending in ("ием", "ия", "ие"):
        return base + "ие"
    if ending == "ии":
        return base + "ия"
    if ending in ("ой", "у"):
        return base + "а"
    if ending in ("ей", "ю"):
        return base + "я"
    if ending in ("ом",):
        return base
    return word


def inflected(token: dict, head: dict) -> str:
    """A word of a phrase in the nominative, adjectives and participles in the head's gender and number, as far as endings tell."""
    low, grammar, of = token["text"].lower(), token.get("grammar") or {}, head.get("grammar") or {}
    if token["pos"] == "NOUN":
        if grammar.get("Case") == "Nom" or not grammar:
            return low
        if grammar.get("Number") != "Plur":
            return token["lemma"]
        ending = next((e for e in ("ями", "ами", "ях", "ах", "ям", "ам", "ев", "ов") if low.endswith(e)), "")
        return low[: -len(ending)] + ("и" if ending[0] in "яе" or low[-len(ending) - 1] in "кгхжшщч" else "ы") if ending else low
    found = ADJECTIVE.search(low) if token["pos"] == "ADJ" or grammar.get("VerbForm") == "Part" else None
    if not found:
        return low
    stem, tail = low[: -len(found[1])], ""
    soft = found[1] in ("ий", "яя", "ее", "его", "ему", "ем", "юю", "ей") and stem[-1] == "н" or (stem[-1] in "кгхжшщч")
    if of.get("Number") == "Plur":
        return stem + ("ие" if soft else "ые") + tail
    hard = stem[-1] in "кгхжшщч"
    return stem + {"Fem": "яя" if soft and not hard else "ая", "Neut": "ее" if (soft and not hard) or stem[-1] in "жшщч" else "ое"}.get(of.get("Gender"), "ий" if soft else "ый")


class ConlluAnnotator:
    """Tokens looked up by text, for annotations made elsewhere."""

    def __init__(self, known: dict[str, list[dict]]):
        self.known = known

    def annotate(self, text: str) -> list[dict]:
        return [dict(t) for t in self.known.get(text, [])]


def bracketed(text: str, annotator: Annotator) -> str:
    """A text's lines with [ ] around their noun phrases."""
    lines = []
    for line in text.split("\n"):
        tokens = annotator.annotate(line)
        out = []
        for k, t in enumerate(tokens):
            inside = t["mark"].isdigit()
            opens = inside and (not k or tokens[k - 1]["mark"] != t["mark"])
            closes = inside and (k + 1 == len(tokens) or tokens[k + 1]["mark"] != t["mark"])
            out.append(("[ " if opens else "") + t["text"] + (" ]" if closes else ""))
        lines.append(" ".join(out))
    return "\n".join(lines)


_FACTORIES: dict[str, Callable[[], Annotator]] = {"rules": RuleAnnotator}


def register(name: str, factory: Callable[[], Annotator]) -> None:
    """Make an annotator known by name; on a cluster the registering module must be importable by the workers."""
    _FACTORIES[name] = factory
    get.cache_clear()


@cache
def get(name: str = "rules") -> Annotator:
    """One instance per Python worker."""
    return _FACTORIES[name]()


TARGET_VERBS = frozenset(verbs())
