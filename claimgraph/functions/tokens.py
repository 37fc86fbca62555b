"""Column functions over token arrays: ARRAY<STRUCT<id, text, lemma, pos, grammar MAP, parent, deprel, mark>>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<id:string,text:string,lemma:string,pos:string,grammar:map<string,string>,parent:string,deprel:string,mark:string>"


def feature(token: Column, name: str) -> Column:
    return F.try_element_at(token["grammar"], F.lit(name))


def gnc(token: Column) -> Column:
    """(gender, number, case)."""
    return F.struct(*[feature(token, n).alias(n.lower()) for n in ("Gender", "Number", "Case")])


def has_pos(tokens: Column, *pos: str) -> Column:
    return F.exists(tokens, lambda t: t["pos"].isin(*pos))


def has_lemma(tokens: Column, *lemmas: str) -> Column:
    return F.exists(tokens, lambda t: t["lemma"].isin(*lemmas))


def is_passive(token: Column) -> Column:
    return (feature(token, "Aspect") == "Perf") & (feature(token, "Voice") == "Pass")


def fuzzy_same_case(a: Column, b: Column) -> Column:
    """Cases that may stand for one another; equal cases outside these pairs are not among them."""
    pairs = (("Acc", "Gen"), ("Acc", "Nom"), ("Loc", "Ins"))
    return F.coalesce(reduce(lambda x, y: x | y, [a.isin(*p) & b.isin(*p) for p in pairs]), F.lit(False))


def first_token(tokens: Column, test) -> Column:
    return F.get(F.filter(tokens, test), F.lit(0))


def last_token(tokens: Column, test) -> Column:
    return F.try_element_at(F.filter(tokens, test), F.lit(-1))


def is_parent_of_pos(tokens: Column, token_id: Column, *pos: str) -> Column:
    return F.exists(tokens, lambda t: (t["parent"] == token_id) & t["pos"].isin(*pos))


def is_parent_of(tokens: Column, token_id: Column, child_id: Column) -> Column:
    """One of the tokens has the one id and hangs on the other."""
    return F.exists(tokens, lambda t: (t["id"] == child_id) & (t["parent"] == token_id))


def is_child_of(token: Column, parent_id: Column) -> Column:
    return F.coalesce(token["parent"] == parent_id, F.lit(False))


def is_root(token: Column) -> Column:
    return F.coalesce(token["parent"] == "0", F.lit(False))


def root_noun(tokens: Column) -> Column:
    return first_token(tokens, lambda t: (t["pos"] == "NOUN") & is_root(t))


def second_of(tokens: Column, pos: str) -> Column:
    """The second token of a part of speech."""
    return F.get(F.filter(tokens, lambda t: t["pos"] == pos), F.lit(1))


def with_text(tokens: Column, text: Column) -> Column:
    """The last token of a text: a token's copy behind it, or itself."""
    return last_token(tokens, lambda t: t["text"] == text)


def with_id(tokens: Column, token_id: Column) -> Column:
    return first_token(tokens, lambda t: t["id"] == token_id)


def is_purpose(tokens: Column, verbs: tuple[str, ...]) -> Column:
    """A purpose clause: the lemma 'цель', or first 'предназначать', or first 'для' without a dictionary verb."""
    head = F.get(tokens, F.lit(0))["lemma"]
    target = F.exists(tokens, lambda t: (t["pos"] == "VERB") & t["lemma"].isin(*verbs))
    return F.coalesce(has_lemma(tokens, "цель") | (head == "предназначать") | ((head == "для") & ~target), F.lit(False))


def joined_text(tokens: Column, labels: Column | None = None, wanted: tuple[str, ...] = ()) -> Column:
    """Token texts with spaces; with labels (aligned to tokens) only those whose label is wanted, lower-case."""
    if labels is None:
        return F.array_join(F.transform(tokens, lambda t: t["text"]), " ")
    chosen = F.filter(F.arrays_zip(tokens.alias("t"), labels.alias("l")), lambda z: z["l"].isin(*wanted))
    return F.lower(F.array_join(F.transform(chosen, lambda z: z["t"]["text"]), " "))


def numbered_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws(" ", t["text"], t["id"])), "  ")


def phrase_numbers(bio: Column) -> Column:
    """BIO tags to marks: 'O', or the phrase's number, which rises when an O follows a phrase (adjacent B share one)."""
    step = lambda s, tag: F.struct(
        F.when((tag == "O") & s["open"], s["n"] + 1).otherwise(s["n"]).alias("n"),
        (tag != "O").alias("open"),
        F.concat(s["out"], F.array(F.when(tag == "O", F.lit("O")).otherwise(s["n"].cast("string")))).alias("out"),
    )
    return F.aggregate(bio, F.struct(F.lit(1).alias("n"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("out")), step, lambda s: s["out"])


def bracketed(words: Column, bio: Column) -> Column:
    """The words with [ ] around phrases."""
    zipped = F.arrays_zip(words.alias("w"), bio.alias("b"), F.concat(F.slice(bio, F.lit(2), F.greatest(F.size(bio) - 1, F.lit(0))), F.array(F.lit("O"))).alias("next"))
    return F.array_join(F.transform(zipped, lambda z: F.concat(F.when(z["b"] == "B", F.lit("[ ")).otherwise(""), z["w"], F.when((z["b"] != "O") & (z["next"] != "I"), F.lit(" ]")).otherwise(""))), " ")


def starts_with_separator(tokens: Column, text: Column, except_begins: tuple[str, ...] = ("а также",)) -> Column:
    """The first token is marked as a separator's, and the text begins with none of the exceptions."""
    excepted = reduce(lambda a, b: a | b, [F.startswith(text, F.lit(e)) for e in except_begins], F.lit(False))
    return F.coalesce((F.get(tokens, F.lit(0))["mark"] == "S") & ~excepted, F.lit(False))


def label_positions(labels: Column, wanted: tuple[str, ...]) -> Column:
    """Where (from 0) labels of a kind stand."""
    return F.filter(F.transform(labels, lambda x, i: F.when(x.isin(*wanted), i)), lambda i: i.isNotNull())


def has_label(labels: Column, wanted: tuple[str, ...]) -> Column:
    return F.exists(labels, lambda x: x.isin(*wanted))


def between_heads(positions: Column, at: Column) -> Column:
    """A place with a head before and a head after it."""
    return F.exists(positions, lambda p: p < at) & F.exists(positions, lambda p: p > at)


def position_of_text(tokens: Column, text: Column | str) -> Column:
    """Where (from 0) a token's text first occurs; null if nowhere."""
    found = F.array_position(F.transform(tokens, lambda t: t["text"]), text)
    return F.when(found > 0, found - 1)


def bound_case(tokens: Column, verb_id: Column) -> Column:
    """The case of the first nominal after a verb."""
    after = lambda t: (t["id"].cast("int") > verb_id.cast("int")) & t["pos"].isin("NOUN", "PRON", "ADJ")
    return feature(first_token(tokens, after), "Case")


def last_phrase(tokens: Column) -> Column:
    """The tokens of the phrase that ends the segment; empty where none does."""
    mark = F.element_at(tokens, -1)["mark"]
    return F.when(mark.rlike("^[0-9]+$"), F.filter(tokens, lambda t: t["mark"] == mark)).otherwise(F.filter(tokens, lambda t: F.lit(False)))


def first_in_case(tokens: Column, pos: tuple[str, ...], cases: tuple[str, ...]) -> Column:
    """The id of the first token of a part of speech in one of the cases."""
    return first_token(tokens, lambda t: t["pos"].isin(*pos) & F.coalesce(feature(t, "Case").isin(*cases), F.lit(False)))["id"]


def fixed_words(udpipe: Column, dictionary: Column) -> Column:
    """Tokens with what a second analyser knows better: its part of speech, lemma and features where both give the same word, unless
    it has none for it. The two arrays need not be cut alike; a word is looked up by its text, the k-th by the k-th."""
    word = lambda t: F.lower(t["text"])

    def mended(t: Column, i: Column) -> Column:
        k = F.size(F.filter(F.slice(udpipe, F.lit(1), i + 1), lambda x: word(x) == word(t)))
        same = F.get(F.filter(dictionary, lambda x: word(x) == word(t)), k - 1)
        known = same.isNotNull() & same["pos"].isNotNull()
        return F.struct(
            t["id"].alias("id"), t["text"].alias("text"), F.when(known, F.coalesce(same["lemma"], t["lemma"])).otherwise(t["lemma"]).alias("lemma"), F.when(known, same["pos"]).otherwise(t["pos"]).alias("pos"),
            F.when(known, F.coalesce(same["grammar"], t["grammar"])).otherwise(t["grammar"]).alias("grammar"), t["parent"].alias("parent"), t["deprel"].alias("deprel"), t["mark"].alias("mark"),
        )

    return F.transform(udpipe, mended)
