"""The library's own operators on small patents and hand-made tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from claimgraph import annotate, fold
from claimgraph.functions import clean, tokens
from claimgraph.operators import classify, facts, graph, lexicon, numbering, ordered, segments
from claimgraph.plans import claims, samples
from claimgraph.sources import conllu, patents


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (clean.strip, "  а б \n", "а б"),
        (clean.clear_turnovers, "вал, например, и однако муфта", "вал и муфта"),
        (clean.clear_brackets, "вал (1), (2) и (3) ось", "вал  и  ось"),
        (clean.clear_first_number, "1. Вал", "Вал"),
        (clean.clear_tags, "a<b>c</b>", "a c "),
        (clean.merge_commas, "а , , б , .", "а, б."),
        (clean.correct_slashes, "5 /см вход/выход", "5/см вход / выход"),
        (clean.correct_dashes, "5 -7", "5-7"),
        (clean.replace_entities, "5&deg; &unknown; &lt;", "5° &unknown; <"),
        (clean.merge_conjunctions, "а, и, б а именно, в", "а, и б а именно в"),
        (clean.single_spaces, "а   б", "а б"),
        (clean.node_label, "а" * 25, "а" * 20 + "..."),
    ],
)
def test_cleaning_steps(spark, f, text, expected):
    assert one(spark, f, text) == expected


def test_claim_is_cut_at_the_distinguishing_phrase_once(spark):
    text = "Клапан, содержащий корпус, отличающийся тем, что а, характеризующийся тем, что б"
    assert one(spark, clean.split_parts, text) == ["Клапан, содержащий корпус", " а, характеризующийся тем, что б"]
    df = spark.createDataFrame([(1, "Клапан, , содержащий корпус, отличающийся тем, что корпус мал.")], "k int, t string")
    got = [tuple(r) for r in segments.claim_segments(df, ["k"], "t").orderBy("seg_id").collect()]
    assert got == [(1, 1, 1, "Клапан"), (1, 1, 3, "содержащий корпус"), (1, 2, 4, "корпус мал")]


def test_surrogates_come_back(spark):
    text = "вал 1,5 и вал 2-3, сталь А10"
    row = spark.createDataFrame([(text,)], "t string").select(segments.with_surrogates(F.col("t")).alias("s")).select("s.text", segments.restore(F.col("s.text"), F.col("s.originals")).alias("back")).first()
    assert "REP1" in row.text and row.back.replace(" ", "") == text.replace(" ", "")


def test_patents_keep_zeros_and_quarantine(spark):
    rows = {r.path: r for r in patents.read_patents(spark.createDataFrame(samples.PATENTS, "path string, value string")).collect()}
    assert rows["a.xml"].code == "RU_01000001_C1_20200115" and rows["a.xml"].ipc == ["F16K1/00", "F16L3/02"]
    assert [rows[f"{k}.xml"].error for k in "abcde"] == [None, None, "no code", "not a patent", "broken XML"]
    assert rows["a.xml"].org == "ООО Завод (RU)" and len(rows["a.xml"].claims) == 2


def test_files_are_found_whatever_their_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.XML").write_text(samples.PATENTS[0][1], encoding="utf-8")
    (tmp_path / "b.txt").write_text("no")
    assert patents.find_files(spark, str(tmp_path)).count() == 1


def test_conllu_rows(spark):
    text = "# c\n1\tВал\tвал\tNOUN\t_\tCase=Nom|Gender=Masc\t0\troot\t_\t_\n2\t.\t.\tPUNCT\t_\t_\t1\tpunct\t_\t_\n\n1\tОсь\tось\tNOUN\t_\tCase=Nom\t0\troot\t_\t_\n"
    rows = conllu.read_conllu(spark.createDataFrame([("p", text)], "path string, value string")).orderBy("sent_id", "pos_idx").collect()
    assert [(r.sent_id, r.id, r.pos) for r in rows] == [(0, "1", "NOUN"), (0, "2", "PUNCT"), (1, "1", "NOUN")]
    assert rows[0].grammar == {"Case": "Nom", "Gender": "Masc"} and rows[1].grammar is None


@pytest.mark.parametrize(("template", "kind"), [("N_V<P>_N", "N_V_N"), ("V<P>_N", "V_N"), ("V<F>_N", "V_N"), ("N_который_V<F>_N", "N_который_V_N"), ("который_V<F>_N", "который_V_N"), ("N_-_N", "N_-_N"), ("A0", "A0"), ("V<C>_N", "V<C>"), ("X", "X"), ("UNKNOWN", "UNKNOWN")])
def test_templates_are_classified(spark, template, kind):
    assert one(spark, classify.segment_type, template) == kind


def test_template_column_agrees_with_python(spark):
    texts = ["содержащий корпус и пружину", "корпус соединен с трубой", "в котором размещены блоки", "жесткий", "клапан", "и", "при этом вал закреплен на оси"]
    analysed = [(t, annotate.get().annotate(t)) for t in texts]
    keys = ("id", "text", "lemma", "pos", "grammar", "parent", "deprel", "mark")
    df = spark.createDataFrame([(t, [tuple(x[k] for k in keys) for x in a]) for t, a in analysed], f"text string, tokens array<{tokens.TOKEN}>")
    got = {r.text: r.template for r in df.select("text", classify.template(F.col("tokens"), F.col("text")).alias("template")).collect()}
    assert got == {t: claims.template_of(a, t) for t, a in analysed}


def test_windows(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("abcab")], "g int, at int, k string")
    got = ordered.nearest_preceding(df, ["g"], ["at"], F.col("k") == "a", F.col("at"), "near").orderBy("at").collect()
    assert [r.near for r in got] == [None, 0, 0, 0, 3]
    got = ordered.carry(df, ["g"], ["at"], F.col("k") == "a", F.col("at"), F.col("k") == "c", "held").orderBy("at").collect()
    assert [r.held for r in got] == [0, 0, None, 3, 3]
    assert [r.at for r in ordered.last_wins(df, ["g", "k"], ["at"]).orderBy("at").collect()] == [2, 3, 4]


def test_numbers_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = numbering.numbered(df, ["x"]).orderBy("x").collect()
    assert [(r.x, r.rn) for r in got] == [(i, i + 1) for i in range(1000)]
    chunks = numbering.limited_chunks(df, ["x"], 250, 100).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r.chunk, r["count"]) for r in chunks] == [(1, 100), (2, 100), (3, 50)]


def test_dictionary_has_every_verb_once():
    found = lexicon.verbs()
    assert len(found) == 37 and found["укладывать"]["kind"] == "comp" and found["вводить"]["reversed"]
    assert found["включать"]["objects"][2] == {"role": "OBJ", "phrase": True, "anchors": ["в себя"], "cases": ["Acc"]}


def test_graph_merges(spark):
    terms = spark.createDataFrame([("d", "0.0", "насос", 0), ("d", "1.1", "генератор", 1), ("d", "1.2", "генератор тока", 2), ("d", "2.1", "выход", 3), ("d", "2.2", "выход", 4)], "code string, key string, term string, ord int")
    edges = spark.createDataFrame([("d", "0.0", "1.2", "comp", 0), ("d", "1.2", "2.1", "have", 1), ("d", "1.2", "2.2", "have", 2), ("d", "1.1", "0.0", "conn", 3)], "code string, sbj_key string, obj_key string, type string, ord int")
    t, e = graph.post_process(terms, edges)
    assert {r.key for r in t.collect()} == {"0.0", "1.2", "2.1"}
    assert {(r.sbj_key, r.obj_key, r.type) for r in e.collect()} == {("0.0", "1.2", "comp"), ("1.2", "2.1", "have"), ("1.2", "0.0", "conn")}
    assert {(r.ancestor, r.descendant, r.depth) for r in graph.closure(e).collect()} == {("0.0", "1.2", 1), ("1.2", "2.1", 1), ("0.0", "2.1", 2)}


def test_facts_of_a_sentence():
    text = "Технический результат: увеличение срока службы пружины с помощью смазки, повышение надежности"
    got = facts.match_facts(annotate.get().annotate(text))
    assert [(f["action"], f["object"], f["condit"]) for f in got] == [("увеличение", "срока службы пружины", "с помощью смазки"), ("повышение", "надежности", None)]


def test_document_fold_links_every_segment_and_edge():
    got = claims.fold_document(["Клапан, содержащий корпус и пружину", "корпус соединен с трубой, а пружина закреплена на штоке"], [], annotate.get())
    assert all(s["link"]["type"] for s in got["segments"])
    keys = {t["key"] for t in got["graph"]["terms"]}
    assert all(e["sbj_key"] in keys and e["obj_key"] in keys for e in got["graph"]["edges"])
    text = {t["key"]: t["term"] for t in got["graph"]["terms"]}
    assert {(text[e["sbj_key"]], text[e["obj_key"]], e["type"]) for e in got["graph"]["edges"]} >= {("клапан", "корпус", "comp"), ("клапан", "пружина", "comp"), ("корпус", "труба", "conn")}
    assert fold.fold_graph(None, [])["terms"][0]["term"] == "<UNKNOWN>"


def test_ontology_files(spark, tmp_path):
    found = claims.records(patents.read_patents(spark.createDataFrame(samples.PATENTS, "path string, value string")))
    rows = claims.ontology(found, str(tmp_path / "owl"), limit=10, chunk=1)
    assert rows.where("p = 'contains'").count() == 5
    files = [os.path.join(tmp_path / "owl", f) for f in sorted(os.listdir(tmp_path / "owl"))]
    assert [re.sub("[0-9]{14}", "T", os.path.basename(f)) for f in files] == ["patents_T_1.owl", "patents_T_2.owl"]
    for f in files:
        body = open(f, encoding="utf-8").read()
        assert body.count("<owl:NamedIndividual") == body.count("</owl:NamedIndividual>") and re.search(r"</rdf:RDF>\s*$", body)


def test_stream_of_files(spark, tmp_path):
    from claimgraph.streaming import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(samples.PATENTS[0][1], encoding="utf-8")
    q = files.write_records(files.record_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_command_line_refuses_zero():
    from claimgraph.__main__ import parser

    assert parser().parse_args(["batch", "-i", "a", "-o", "b"]).limit == 1000
    with pytest.raises(SystemExit):
        parser().parse_args(["batch", "-i", "a", "-o", "b", "-l", "0"])


def test_stream_keeps_a_patent_once(spark, tmp_path):
    from claimgraph.streaming import files

    (tmp_path / "in").mkdir()
    for name in ("a.xml", "b.xml"):
        (tmp_path / "in" / name).write_text(samples.PATENTS[0][1], encoding="utf-8")
    (tmp_path / "in/c.xml").write_text(samples.PATENTS[1][1], encoding="utf-8")
    q = files.write_records(files.new_patents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.code for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["RU_01000001_C1_20200115", "RU_01000002_C1_20200115"]


def test_other_annotations_can_be_used():
    tokens_ = [{"id": "1", "text": "Вал", "lemma": "вал", "pos": "NOUN", "grammar": {"Case": "Nom"}, "parent": "0", "deprel": "root", "mark": "1"}]
    annotate.register("given", lambda: annotate.ConlluAnnotator({"Вал": tokens_}))
    assert annotate.get("given").annotate("Вал") == tokens_ and annotate.get("given").annotate("Ось") == []


def test_links_of_one_claim():
    parts = ["Привод, содержащий вал, причем вал установлен на опоре, при этом, для снижения трения, опора снабжена втулкой, называемой вкладышем, включая смазку"]
    got = {s["text"]: (s["type"], s["link"]["type"], s["link"]["parent"]) for s in claims.fold_document(parts, [], annotate.get())["segments"]}
    assert got["содержащий вал"] == ("V_N", "sub", 1) and got["причем вал установлен на опоре"][:2] == ("N_V_N", "self")
    assert got["при этом"][0] == "SEPARATOR" and got["для снижения трения"] == ("PURPOSE", "spec", 6) and got["опора снабжена втулкой"][1] == "self"
    assert got["называемой вкладышем"][0] == "NAMED"


def test_failed_documents_are_kept_apart(spark):
    found = patents.read_patents(spark.createDataFrame(samples.PATENTS, "path string, value string"))
    annotate.register("broken", lambda: None)
    got = {(r.path, r.error) for r in claims.failures(found, claims.folded(found)).collect()}
    assert got == {("c.xml", "no code"), ("d.xml", "not a patent"), ("e.xml", "broken XML")}


def test_valences_of_a_verb_are_tried_in_order():
    from claimgraph import extraction

    tokens_ = annotate.get().annotate("вал соединен с муфтой через шпонку")
    segment = {"id": 1, "tokens": tokens_, "type": "N_V_N", "link": {}}
    left, right = extraction.around(segment, 1)
    verb = lexicon.describe("соединять")
    assert extraction.find_both(left, right, verb) == "r"
    assert (left.text("SBJ"), right.text("OBJ"), right.text("VIA")) == ("вал", "с муфтой", "через шпонку")


def test_sets_and_dates(spark):
    from claimgraph.operators import intervals

    df = spark.createDataFrame([("20200115",), ("2020",), ("20201399",), (None,)], "t string").select(intervals.published(F.col("t")).alias("d"))
    assert [str(r.d) for r in df.collect()] == ["2020-01-15", "None", "None", "None"]
    points = spark.createDataFrame([(1, 5), (1, 20), (2, 5), (None, 5)], "k int, at int")
    spans = spark.createDataFrame([(1, 0, 6), (1, 5, 21), (1, 7, 7), (2, 6, 9), (1, None, 9)], "k int, low int, high int")
    assert sorted((r.k, r.at, r.low) for r in intervals.within(points, spans, ["k"], "at", "low", "high").collect()) == [(1, 5, 0), (1, 5, 5), (1, 20, 5)]


def test_templates_in_columns_are_those_of_the_fold(spark):
    texts = [s["text"] for _, c in samples.CLAIMS for s in claims.fold_document([c], [], annotate.get())["segments"]]
    texts += ["верхний", "и", "клапан установленный соединенный с валом", "который он", "5 - 7", "а также вал", "что вал", "он вал", "вал он", "выше 5"]
    rows = [(i, t, annotate.get().annotate(t)) for i, t in enumerate(texts)]
    plain = [(i, t, [{k: x.get(k) for k in ("id", "text", "lemma", "pos", "grammar", "parent", "deprel", "mark")} for x in ts]) for i, t, ts in rows]
    df = spark.createDataFrame(plain, f"i int, text string, tokens array<{tokens.TOKEN}>")
    got = {r.i: r.t for r in df.select("i", classify.template(F.col("tokens"), F.col("text")).alias("t")).collect()}
    assert got == {i: claims.template_of(ts, t) for i, t, ts in rows}


def test_numbers_set_aside_alike(spark):
    texts = ["вал диаметром 0,5 мм, шаг 1,4·10-5, угол α1=55-65°, вес 5 кг", "12 об./с и 0,66…0,69, λ/8; 28b, 28c мас.% d2/d1=1,0-1,5", "без чисел", "", "±10° ±0,05 5-й 3/об. a<b REP7 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segments.with_surrogates(F.col("t")).alias("s"))
    for r in df.collect():
        originals = []
        assert r.s.text == claims.set_aside(texts[r.i], originals) and r.s.originals == originals
        assert claims.put_back(r.s.text, originals) == texts[r.i]
