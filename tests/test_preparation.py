"""Keywords, trimming, exceptions and spans of extracted names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docketlens.functions import court_words as W
from docketlens.functions import keywords, trimming
from docketlens.operators import preparation


def plain_spans(text, words):
    """Every substring is looked at: from each word's beginning the longest keyword that ends with a word."""
    low, out, at = text.lower(), [], 0
    inside = lambda i: 0 <= i < len(low) and re.match("[0-9a-z_]", low[i])
    words = {w.lower() for w in words}
    while at < len(low):
        if inside(at) and not inside(at - 1):
            ends = [e for e in range(len(low), at, -1) if not inside(e) and low[at:e] in words]
            if ends:
                out.append((at, ends[0]))
                at = ends[0]
                continue
        at += 1
    return out


def test_keywords_match_a_plain_scan():
    rnd, tree = random.Random(2), keywords.Keywords(W.KEYWORDS)
    pieces = [w for words in W.KEYWORDS.values() for w in words]
    noise = ["judge", "magistrate", "x", "_", ".", ", ", "court", "U.S.", "the", "É", "9", " j ", "hon", "-", "İ"]
    met, missed = set(), set()
    for _ in range(1500):
        text = "".join((lambda w: w.upper() if rnd.random() < 0.3 else w)(rnd.choice(pieces if rnd.random() < 0.5 else noise)) + rnd.choice(("", " ", " ", "  ", ".")) for _ in range(rnd.randint(1, 6)))
        got = tree.spans(text)
        if len(text.lower()) != len(text):
            assert all(text[a:b].lower() in pieces for _, a, b in got)
            continue
        for name, words in W.KEYWORDS.items():
            want = plain_spans(text, words)
            assert [(a, b) for c, a, b in got if c == name] == want
            (met if want else missed).add(name)
    assert met == missed == set(W.KEYWORDS)
    assert tree.spans(None) == tree.spans("") == []


def test_category_is_the_first_with_a_keyword(spark):
    rnd = random.Random(4)
    pieces = [w for words in W.KEYWORDS.values() for w in words] + ["prejudge", "filed", "_judge", "."]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 3))) for _ in range(600)] + ["assigned_judge", "", None, "Judge"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keywords.category(F.col("t")).alias("c")).collect()
    for t, c in got:
        want = t if t in W.OWN_CATEGORIES else next((name for name, words in W.KEYWORDS.items() if plain_spans(t or "", words)), "No_Keywords")
        assert c == want, t


def test_keyword_spans_of_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, "District Judge and Judge Poe", "k"), (2, None, "k"), (3, "", "k")], "id int, t string, keywords string")
    rows = keywords.keyword_spans(df, "id", "t").orderBy("id", "category", "start").collect()
    assert [tuple(r) for r in rows] == [(1, "District_Judge", "district judge", 0, 14, True), (1, "Nondescript_Judge", "judge", 9, 14, False), (1, "Nondescript_Judge", "judge", 19, 24, True)]


#: Extracted text -> what is left of it (None: no name), worked out by hand from the order of the steps.
TRIMMED = {
    "ordered by Magistrate Judge John A. Smith on 10/12/2015": "John A. Smith", "..Ruth Poe": "Ruth Poe", "Ruth Poe and others": "Ruth Poe", "-- Ruth Poe": "Ruth Poe", "([Ruth Poe": "Ruth Poe",
    "Ruth Poe: re motion": "Ruth Poe", "Judge Ruth Poe": "Ruth Poe", "byRuth Poe": "Ruth Poe", "Ruth Poe re": "Ruth Poe", "Ruth Poe 10/12/2015": "Ruth Poe", "Ruth PoeThe": "Ruth Poe", "Ruth Poe's order": "Ruth Poe's",
    "Ruth Poe MS JD-14": "Ruth Poe", "Ruth Poe on Monday": "Ruth Poe", "RUTH B. POE. Signed": "RUTH B. POE", "Ruth Poe M&R": "Ruth Poe", "Ruth Poe granting": "Ruth Poe", "Ruth Poe oral": "Ruth Poe", "RUTH POEin": "RUTH POE",
    "Poe MJDC": None, "Mag Judge Ruth Poe": "Ruth Poe", "Van Poe Dist. Judge": "Van Poe", "j udge Ruth Poe": "Ruth Poe", "SCOTTyes": "SCOTT", "Ruth Poe chambers": "Ruth Poe", "C. Chambers": "C. Chambers",
    "John Doe Jr. Adams": "John Doe Jr.", "Sr. Ruth Poe": "Ruth Poe", "Ann Bea Cee Poe. Fine Day Now": "Ann Bea Cee Poe", "Ruth Poe, MD": "Ruth Poe", "Ruth Poe ,": "Ruth Poe", "Ruth Poe Jr.": "Ruth Poe Jr.", "12 34": None,
    "dba Poe": None, "A b": None, "12 Main st": "Main st", "Jones, USDJ": "Jones", "John Smith, Jr. for": "John Smith, Jr.", "Mr. Poe": "Poe", "Re": None, "": None, "  ": None,
    # The comma is looked for from the 21st character on, and its place taken from the first: so it must agree.
    "Ruth Elizabeth Alexandra Poe, in room number three now": "Ruth El",
}


def test_trimming_by_hand():
    met = []
    for text, want in TRIMMED.items():
        start, stop, exception = trimming.trim(text, met)
        assert (None if start is None else text[start:stop]) == want and not exception, text
    for text in ("Hawkins Judge Smith", "Elaine Hon. Bucklo"):
        assert trimming.trim(text, met) == (0, len(text), True)
    trimming.trim("ch. 'Ruth", met)
    assert {*trimming.FIRST, *trimming.LAST, "title", "title inside"} == set(met)  # every step cuts somewhere


def test_what_is_left_stands_in_the_original():
    rnd = random.Random(9)
    junk = [*W.AFTER_NAMES, "Judge", "mag.", "USDJ", ".", ",", ", Jr.", "'s", "[", "1/2/2015", "The", "Poe", "Ann B.", "CHEN", "Monday", "§", "é", " ", "chambers", "r&r", "#", "Dr."]
    cut = 0
    for _ in range(4000):
        text = "".join(rnd.choice(junk) + rnd.choice((" ", " ", "")) for _ in range(rnd.randint(0, 7)))
        start, stop, _ = trimming.trim(text)
        assert (start is None) == (stop is None)
        if start is not None:
            assert 0 <= start < stop <= len(text) and text[start:stop].strip()
            cut += stop - start < len(text)
    assert cut > 1000


ROW = "id int, original_text string, full_span_start int, extracted_pre_5 string, extracted_entity string, extracted_post_5 string, Ent_span_start int, Ent_span_end int, Entity_Extraction_Method string"


def line(i, pre, name, post, at=100):
    start = at + len(pre)
    return (i, pre + (name or "") + post, at, pre, name, post, start, start + len(name or ""), "SPACY")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        line(1, "signed by District Judge ", "Ruth Poe on 1/2/2015", " ok"), line(2, "by ", "Hawkins Judge Smith", "."), line(3, "before Judges ", "Cassady, Bivens", " "), line(4, "o", "f Judge David Nuffer", ""),
        line(5, "by ", "Thomas J. Judge Rueter", ""), line(6, "by ", "x", ""), line(7, "by ", "Jr", ""), line(8, "by ", None, ""), line(9, "reassigned to ", "Ann Roe", "."), line(10, "transferred from x ", "12345", "."),
        line(11, "", "Poe Hon. ", ""), line(12, "before Judges ", "Doe, Roe", ""), line(12, "before Judges ", "Doe, Roe", ""),
    ], ROW)


def test_exceptions_are_taken_apart(rows):
    from docketlens.operators.mentions import eligibility

    flagged = eligibility(rows, "extracted_entity", "extracted_pre_5").withColumn("is_exception", F.col("is_exception") | F.col("id").isin(2, 4, 5, 11))
    out = preparation.exploded_exceptions(flagged.withColumns({c: F.lit(1) for c in ("piece", "offset", "mark", "last")})).orderBy("id", "Ent_span_start").collect()
    got = [(r.id, r.extracted_entity, r.extracted_pre_5, r.is_exception) for r in out]
    assert got == [
        (2, "Hawkins", " Judge ", False), (2, "Smith", " Judge ", False), (3, "Cassady", "before Judges ", False), (3, "Bivens", "before Judges ", False), (4, "David Nuffer", "Judge", False),
        (5, "Thomas J. Judge Rueter", "by ", True), (11, "Poe", " Hon. ", False),
    ]
    for r in out:  # spans are those of the line
        assert r.original_text[r.Ent_span_start - r.full_span_start : r.Ent_span_end - r.full_span_start] == r.extracted_entity
        assert r.piece == 1 and r.Entity_Extraction_Method == "SPACY_EXCEPTION_HANDLING" and r.extracted_post_5 == "<-?->"


def test_preparation_from_lines_to_categories(rows):
    out = preparation.prepared(rows).orderBy("id", "New_Span_Start").collect()
    got = [(r.id, r.New_Entity, r.New_Pre_Tokens, r.Prefix_Categories, r.Transferred_Flag) for r in out]
    assert got == [
        (1, "Ruth Poe", "signed by District Judge ", "District_Judge", False), (2, "Hawkins", "by ", "No_Keywords", False), (2, "Smith", "by Hawkins Judge ", "Nondescript_Judge", False),
        (3, "Cassady", "before Judges ", "Nondescript_Judge", False), (3, "Bivens", "before Judges Cassady, ", "Nondescript_Judge", False),
        (4, "David Nuffer", "of Judge ", "Nondescript_Judge", False),
        (5, "Thomas J. Judge Rueter", "by ", "No_Keywords", False), (9, "Ann Roe", "reassigned to ", "Judicial_Actor", False), (11, "Poe", "", "No_Keywords", False),
    ]
    for r in out:
        at = r.New_Span_Start - r.full_span_start
        assert r.original_text[at : r.New_Span_End - r.full_span_start] == r.New_Entity and r.New_Pre_Tokens + r.New_Entity + r.New_Post_Tokens == r.original_text
    assert preparation.prepared(rows.limit(0)).count() == 0


def test_headers_are_spanned_from_their_start(spark):
    df = spark.createDataFrame([("Ann Roe (presiding)", 0, 7, None, None, "assigned_judge", 0, 7, True)], "original_text string, Ent_span_start int, Ent_span_end int, Pre_span_start int, Pre_span_end int, Entity_Extraction_Method string, Respanned_Start int, Respanned_Length int, eligible boolean")
    r = preparation.categorised(preparation.respanned(df, is_header=True), is_header=True).first()
    assert (r.New_Entity, r.New_Pre_Tokens, r.Prefix_Categories, r.full_span_start, r.full_span_end) == ("Ann Roe", "assigned_judge", "assigned_judge", 0, 7)
