"""Token repairs and tags of a dictionary analyser, as column functions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dictionary analyser's tags by the names that a phrase chunker knows; other tags stay as they are.
CHUNK_TAGS = {
    "наст": "praes", "непрош": "inpraes", "прош": "praet", "им": "nom", "род": "gen", "дат": "dat", "вин": "acc", "твор": "ins", "пр": "abl", "парт": "part", "местн": "loc", "зват": "voc", "ед": "sg", "мн": "pl",
    "деепр": "ger", "инф": "inf", "прич": "partcp", "изъяв": "indic", "пов": "imper", "кр": "brev", "полн": "plen", "притяж": "poss", "прев": "supr", "срав": "comp", "1-л": "1p", "2-л": "2p", "3-л": "3p",
    "муж": "m", "жен": "f", "сред": "n", "несов": "ipf", "сов": "pf", "действ": "act", "страд": "pass", "од": "anim", "неод": "inan", "пе": "tran", "нп": "intr", "вводн": "parenth", "гео": "geo", "затр": "awkw", "имя": "persn",
    "искаж": "dist", "мж": "mf", "обсц": "obsc", "отч": "patrn", "прдк": "praed", "разг": "inform", "редк": "rare", "сокр": "abbr", "устар": "obsol", "фам": "famn",
}


def part_of_speech(tags: Column) -> Column:
    """The first tag of an analysis such as 'S,муж=им,ед'."""
    return F.get(F.split(tags, "[,=]"), F.lit(0))


def chunk_feature(tags: Column) -> Column:
    """An analysis as the chunker reads it: of alternatives in brackets the first, tags renamed, with commas; a verb is 'V' alone."""
    names = F.create_map(*[F.lit(x) for pair in CHUNK_TAGS.items() for x in pair])
    parts = F.filter(F.split(tags, "="), lambda x: x != "")
    first = F.transform(parts, lambda x: F.when(F.startswith(x, F.lit("(")), F.split_part(F.btrim(x, F.lit("()|")), F.lit("|"), F.lit(1))).otherwise(x))
    named = F.transform(F.flatten(F.transform(first, lambda x: F.split(x, ","))), lambda t: F.coalesce(F.try_element_at(names, t), t))
    joined = F.array_join(named, ",")
    return F.when(F.startswith(joined, F.lit("V")), "V").otherwise(joined)


def joined_dashes(tokens: Column, lemmas: Column | None = None) -> Column:
    """Tokens (id, text, lemma, pos, space_after) with what a dash splits put together under the last of its tokens.

    A token that ends in a dash with no space after it goes to the next one, a lone dash with the token before it as well; a token
    that begins with a dash takes the token before it, if it is an adjective, noun, verb or preposition. What is no adjective gets the
    lemma of its own part (from lemmas, a map, else the lower-case word), a preposition becomes a noun.
    """
    right = lambda i: F.coalesce(F.endswith(F.get(tokens, i)["text"], F.lit("-")) & ~F.get(tokens, i)["space_after"] & (i + 1 < F.size(tokens)), F.lit(False))
    left = lambda i: F.coalesce(F.startswith(F.get(tokens, i)["text"], F.lit("-")) & F.get(tokens, i)["pos"].isin("ADJ", "NOUN", "VERB", "ADP") & ~right(i), F.lit(False))
    lone = lambda i: right(i) & (F.get(tokens, i)["text"] == "-")

    def joined(t: Column, i: Column) -> Column:
        before, own = F.coalesce(F.get(tokens, i - 1)["text"], F.lit("")), F.substring(t["text"], F.lit(2), F.length(t["text"]))
        text = F.when(lone(i - 1), F.concat(F.coalesce(F.get(tokens, i - 2)["text"], F.lit("")), before, t["text"])).when(right(i - 1) | left(i), F.concat(before, t["text"])).otherwise(t["text"])
        lemma = F.lower(own) if lemmas is None else F.coalesce(F.try_element_at(lemmas, F.lower(own)), F.lower(own))
        mended = left(i) & t["pos"].isin("NOUN", "VERB", "ADP")
        gone = right(i) | lone(i + 1) | left(i + 1)
        return F.struct(gone.alias("gone"), t["id"].alias("id"), text.alias("text"), F.when(mended, lemma).otherwise(t["lemma"]).alias("lemma"), F.when(left(i) & (t["pos"] == "ADP"), "NOUN").otherwise(t["pos"]).alias("pos"))

    return F.transform(F.filter(F.transform(tokens, joined), lambda t: ~t["gone"]), lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text"), t["lemma"].alias("lemma"), t["pos"].alias("pos")))


def settled_words(tokens: Column, can_be: Column) -> Column:
    """Tokens that may be nouns, settled: can_be (aligned to tokens) has a noun's features where the dictionary says so, else null.

    A particle or adjective becomes that noun; a verb or adverb does if it stands in a phrase and governs no adverb.
    """

    def settle(t: Column, i: Column) -> Column:
        features = F.get(can_be, i)
        adverb = F.exists(tokens, lambda x: (x["parent"] == t["id"]) & (x["pos"] == "ADV"))
        noun = features.isNotNull() & (t["pos"].isin("PART", "ADJ") | (t["pos"].isin("VERB", "ADV") & ~adverb & t["mark"].rlike("^[0-9]+$")))
        return F.struct(
            t["id"].alias("id"), t["text"].alias("text"), t["lemma"].alias("lemma"), F.when(noun, "NOUN").otherwise(t["pos"]).alias("pos"), F.when(noun, features).otherwise(t["grammar"]).alias("grammar"),
            t["parent"].alias("parent"), t["deprel"].alias("deprel"), t["mark"].alias("mark"),
        )

    return F.transform(tokens, settle)
