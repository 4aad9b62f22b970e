"""Files written in their formats and read back."""

import json
import os

from pyspark.sql import functions as F

from docketlens.sources import readers


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


MENTION = {
    "Entity_Extraction_Method": "SPACY", "docket_source": "line_entry", "judge_enum": None, "party_enum": None, "pacer_id": None, "docket_index": 9.0, "ucid": "gand;;3:10-cv-00010", "cid": "3:10-cv-00010", "court": "gand", "year": 2010,
    "original_text": "Signed by Judge Jane Poe.", "Extracted_Entity": "Jane Poe", "Prefix_Categories": "Nondescript_Judge", "Transferred_Flag": False, "full_span_start": 278, "full_span_end": 338.0, "Entity_Span_Start": 315.0,
    "Entity_Span_End": 327.0, "Parent_Entity": "jane poe", "SJID": "SJ000001",
}


def test_cases_lines_and_edges(spark, tmp_path):
    docket = [{"date_filed": "01/02/2010", "ind": "1", "docket_text": "COMPLAINT", "edges": [{"src": 0, "dst": 1}]}, {"date_filed": "x", "ind": "2", "docket_text": "ORDER", "edges": None}]
    put(tmp_path, "a.json", json.dumps({"ucid": "u1", "court": "txed", "docket": docket}, indent=1))
    put(tmp_path, "b.json", json.dumps({"ucid": "u2", "court": "cand", "docket": []}))
    cases = readers.cases(spark, str(tmp_path))
    lines = readers.docket_lines(cases).orderBy("ucid", "docket_index").collect()
    assert [(r.ucid, r.docket_index, str(r.date_filed), r.docket_text) for r in lines] == [("u1", 0, "2010-01-02", "COMPLAINT"), ("u1", 1, "None", "ORDER"), ("u2", None, "None", None)]
    assert [tuple(r) for r in readers.edges(readers.docket_lines(cases)).collect()] == [("u1", 0, 1)]


def test_entry_entities_leave_headers_to_their_own_reader(spark, tmp_path):
    head = "ucid,court,year,cid,docket_index,entry_date,original_text,full_span_start,full_span_end,extracted_pre_5,extracted_entity,extracted_post_5,Ent_span_start,Ent_span_end,docket_source,Entity_Extraction_Method\n"
    row = 'u1,txed,2010,c,3,d,"by ""Judge"", Poe",0,17,by,Poe,,14,17,line_entry,SPACY\n'
    put(tmp_path, "x/txed.csv", head + row + row)
    put(tmp_path, "x/headers.csv", head + row)
    got = readers.entry_entities(spark, str(tmp_path)).collect()
    assert [(r.original_text, r.extracted_entity, r.Ent_span_start) for r in got] == [('by "Judge", Poe', "Poe", 14)]


def test_mentions_as_lines_and_arrays_keep_repeats(spark, tmp_path):
    line = json.dumps(MENTION)
    put(tmp_path, "in/gand/10/a.jsonl", f"{line}\n{line}\n")
    put(tmp_path, "in/gand/11/b.jsonl", json.dumps([MENTION | {"ucid": "other", "year": 2011}, MENTION | {"ucid": "other", "year": 2011, "SJID": "Inconclusive", "Prefix_Categories": "No_Keywords"}], indent=1))
    put(tmp_path, "in/gand/11/c.jsonl", "")
    got = readers.mentions(spark, str(tmp_path / "in"))
    assert got.groupBy("ucid").count().orderBy("ucid").collect() == [("gand;;3:10-cv-00010", 2), ("other", 2)]
    one = got.where("ucid <> 'other'").first()
    assert {k: one[k] for k in MENTION} == MENTION and one.docket_index == 9
    readers.write_mentions(got, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out" / "court=gand"))[:2] == ["yy=10", "yy=11"]
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 3 and back.where("SJID = 'Inconclusive'").count() == 0


def test_entities_find_the_label(spark, tmp_path):
    rows = [{"name": "jane poe", "SJID": "SJ1", "Some_Guess": "FJC Judge", "Tot_UCIDs": 12.0, "is_FJC": True, "NID": 1394646.0}, {"name": "ann roe", "Judge_Label": "Magistrate_Judge", "NID": None, "is_FJC": False}]
    put(tmp_path, "e.jsonl", "\n".join(map(json.dumps, rows)))
    got = {r.name: r for r in readers.entities(spark, str(tmp_path / "e.jsonl")).collect()}
    assert (got["jane poe"].Judge_Label, got["jane poe"].NID, got["jane poe"].Tot_UCIDs, got["jane poe"].is_FJC) == ("FJC Judge", "1394646", 12, True)
    assert (got["ann roe"].Judge_Label, got["ann roe"].NID, got["ann roe"].is_FJC, got["ann roe"].SJID) == ("Magistrate_Judge", None, False, None)


def test_parties(spark, tmp_path):
    put(tmp_path, "p.csv", 'ucid,court,cid,year,filing_date,Role,Entity\nu,txed,c,2010,d,Defendant,"Poe, Ann"\n')
    assert readers.parties(spark, str(tmp_path / "p.csv")).select(F.concat_ws("|", "Role", "Entity")).first()[0] == "Defendant|Poe, Ann"
