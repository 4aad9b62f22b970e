"""Declared schemas of the inputs and outputs, as DDL (no session needed to import them)."""


def _ddl(text: str) -> str:
    return " ".join(text.split())


CASE = _ddl("""ucid string, case_id string, case_type string, court string, download_court string, judge string,
    nature_suit string, filing_date string, terminating_date string, case_status string,
    docket array<struct<date_filed:string,ind:string,docket_text:string,edges:array<struct<src:int,dst:int>>>>""")
UNIQUE_FILES = _ddl("ucid string, fpath string, court string, year int, judge string, nature_suit string, is_multi boolean, is_mdl boolean, mdl_code string, source string")
ENTRY_ENTITY = _ddl("""ucid string, court string, year int, cid string, docket_index int, entry_date string, original_text string,
    full_span_start int, full_span_end int, extracted_pre_5 string, extracted_entity string, extracted_post_5 string,
    Ent_span_start int, Ent_span_end int, docket_source string, Entity_Extraction_Method string""")
PARTY = _ddl("ucid string, court string, cid string, year int, filing_date string, Role string, Entity string")
ENTITY = _ddl("""name string, Presentable_Name string, SJID string, Judge_Label string, Head_UCIDs long,
    Tot_UCIDs long, is_FJC boolean, is_BA_MAG boolean, NID string, BA_MAG_ID string""")
MENTION = _ddl("""Entity_Extraction_Method string, docket_source string, judge_enum long, party_enum double, pacer_id double,
    docket_index double, ucid string, cid string, court string, year int, original_text string, Extracted_Entity string,
    Prefix_Categories string, Transferred_Flag boolean, full_span_start long, full_span_end double,
    Entity_Span_Start double, Entity_Span_End double, Parent_Entity string, SJID string""")
#: The same as the fields of a struct.
MENTION_FIELDS = ", ".join(f.strip().replace(" ", ": ", 1) for f in MENTION.split(","))
