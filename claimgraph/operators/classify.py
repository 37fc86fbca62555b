"""Segment templates and the finite-state machine that classifies them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Final type of each state.
FINAL = {"P0": "X", "P1": "N", "P2": "V_N", "P3": "N_V", "P4": "N_V_N", "P5": "A0", "P6": "A0", "P7": "N_который_V_N", "P8": "V_N", "P9": "N_-_N", "P10": "AV", "P11": "SC", "P12": "V<C>", "P13": "который_V_N", "P14": "V_N"}
#: Where an input leads from a state; an input that is not listed keeps it.
STATES: dict[str, dict[str, str]] = {
    "P0": {"N": "P1", "N0": "P1", "PR": "P1", "PR0": "P1", "V": "P2", "V<I>": "P2", "V<P>": "P2", "V<F>": "P14", "V<U>": "P2", "A": "P6", "A0": "P6", "-": "P9", "который": "P13", "V<C>": "P12", "AV": "P10", "SC": "P11"},
    "P1": {"-": "P9", "A": "P5", "A0": "P5", "который": "P7", "V": "P3", "V<I>": "P3", "V<P>": "P3", "V<F>": "P3", "V<C>": "P3", "V<U>": "P3"},
    "P2": {"N": "P8", "N0": "P8", "-": "P9", "который": "P7"},
    "P3": {"N": "P4", "N0": "P4", "PR": "P4", "PR0": "P4", "который": "P7", "-": "P9"},
    "P5": {"V": "P3", "V<I>": "P3", "V<P>": "P3", "V<F>": "P3", "V<C>": "P3", "V<U>": "P3"},
    "P6": {"V": "P3", "V<I>": "P3", "V<P>": "P3", "V<F>": "P3", "V<C>": "P3", "V<U>": "P3", "-": "P9", "который": "P7"},
    "P8": {"CC": "P2", "SC": "P2", "V": "P4", "V<I>": "P4", "V<P>": "P4", "V<F>": "P4", "V<C>": "P4", "V<U>": "P4", "-": "P9", "который": "P13"},
    "P11": {"-": "P9", "который": "P7"},
}
TRANSITIONS = {(state, symbol): to for state, row in STATES.items() for symbol, to in row.items()}
DROPPED = ("SEPARATOR", "PURPOSE", "NAMED")


def segment_type(template: Column) -> Column:
    """Type of a template such as 'N_V<P>_N'; UNKNOWN stays, a symbol without an edge keeps the state."""
    table = F.create_map(*[F.lit(x) for (s, i), t in TRANSITIONS.items() for x in (f"{s}~{i}", t)])
    names = F.create_map(*[F.lit(x) for pair in FINAL.items() for x in pair])
    last = F.aggregate(F.split(template, "_"), F.lit("P0"), lambda s, i: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("~"), i)), s))
    return F.when(template == "UNKNOWN", template).when(template == "DROPPED", F.lit(None)).otherwise(F.try_element_at(names, last))


def template(tokens: Column, text: Column) -> Column:
    """Symbols of a segment's tokens joined by '_'; UNKNOWN where nothing classifies it.

    A noun or pronoun, a conjunction and 'который' are not said twice; a direct noun stands for an oblique one beside it. An adjective
    counts where there is no verb and it heads the segment: first and after its governor, or last.
    """
    feature = lambda t, n: F.try_element_at(t["grammar"], F.lit(n))
    number = lambda c: c.try_cast("int")
    verb = F.exists(tokens, lambda t: t["pos"] == "VERB")
    noun = F.exists(tokens, lambda t: t["pos"] == "NOUN")
    case = lambda t: feature(t, "Case")
    final = F.element_at(tokens, -1)["id"]
    heads = lambda t, i: ((i == 0) & (number(t["id"]) > number(t["parent"]))) | ((t["id"] == final) & (number(t["parent"]) >= number(final)))
    symbol = lambda t, i: (
        F.when(t["mark"] == "S", F.lit(None))
        .when(t["pos"] == "NOUN", F.when(case(t).isin("Nom", "Acc"), "N0").when(case(t).isNotNull(), "N"))
        .when((t["pos"] == "PRON") & (t["lemma"] == "который"), "который")
        .when(t["pos"] == "PRON", F.when(case(t) == "Nom", "PR0").otherwise("PR"))
        .when(t["pos"] == "VERB", F.concat(F.lit("V<"), F.coalesce(F.substring(feature(t, "VerbForm"), 1, 1), F.lit("U")), F.lit(">")))
        .when(t["lemma"] == "-", "-")
        .when(t["pos"].isin("CCONJ", "SCONJ") & (t["mark"] == "O"), F.substring(t["pos"], 1, 2))
        .when(t["pos"].isin("ADV", "NUM") & ~verb & ~noun, "AV")
        .when((t["pos"] == "X") & (F.instr(text, "-") > 1), "X")
        .when((t["pos"] == "ADJ") & ~verb & heads(t, i), "A0")
    )
    symbols = F.array_compact(F.transform(tokens, symbol))

    def step(out: Column, s: Column) -> Column:
        before = F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(""))
        nouns, pronouns = ("N", "N0"), ("PR", "PR0")
        said = (before == s) & s.isin(*nouns, *pronouns, "который", "CC", "SC")
        covered = (s.isin(*nouns) & before.isin(*pronouns)) | (s.isin(*pronouns) & before.isin(*nouns)) | ((s == "N") & (before == "N0"))
        main = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(s))
        return F.when(said | covered, out).when((s == "N0") & (before == "N"), main).otherwise(F.concat(out, F.array(s)))

    collapsed = F.aggregate(symbols, F.array().cast("array<string>"), step)
    has = lambda pos: F.exists(tokens, lambda t: t["pos"] == pos)
    poor = (F.size(collapsed) == 0) | (F.array_join(collapsed, "_") == "CC")
    return F.when(poor, F.when(has("ADJ"), "A").when(has("SCONJ"), "SC").when(has("X"), "X").otherwise("UNKNOWN")).otherwise(F.array_join(collapsed, "_"))
