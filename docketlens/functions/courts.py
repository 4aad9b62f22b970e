"""Abbreviations of the federal district courts from the names of institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNALLOCATED = "Unallocated"
# States and territories by their abbreviation, with the letters of their districts (none: a single district).
STATES = {
    "al": "alabama nms", "ak": "alaska", "az": "arizona", "ar": "arkansas ew", "ca": "california cens", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district-of-columbia", "fl": "florida mns", "ga": "georgia mns",
    "gu": "guam", "hi": "hawaii", "id": "idaho", "il": "illinois cns", "in": "indiana ns", "ia": "iowa ns", "ks": "kansas", "ky": "kentucky ew", "la": "louisiana emw", "me": "maine", "md": "maryland", "ma": "massachusetts",
    "mi": "michigan ew", "mn": "minnesota", "ms": "mississippi ns", "mo": "missouri ew", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new-hampshire", "nj": "new-jersey", "nm": "new-mexico", "ny": "new-york ensw",
    "nc": "north-carolina emw", "nd": "north-dakota", "nmi": "northern-mariana-islands", "oh": "ohio ns", "ok": "oklahoma enw", "or": "oregon", "pa": "pennsylvania emw", "pr": "puerto-rico", "ri": "rhode-island", "sc": "south-carolina",
    "sd": "south-dakota", "tn": "tennessee emw", "tx": "texas ensw", "ut": "utah", "vt": "vermont", "vi": "virgin-islands", "va": "virginia ew", "wa": "washington ew", "wv": "west-virginia ns", "wi": "wisconsin ew", "wy": "wyoming",
}
DIRECTIONS = {"c": "central", "e": "eastern", "m": "middle", "n": "northern", "s": "southern", "w": "western"}


def _index() -> dict[str, str]:
    """``direction state`` (or ``state`` alone) to abbreviation: ``northern illinois`` to ``ilnd``."""
    out = {}
    for short, told in STATES.items():
        name, _, letters = told.partition(" ")
        place = name.replace("-", " ").removeprefix("district of ")
        if letters:
            out |= {f"{DIRECTIONS[x]} {place}": f"{short}{x}d" for x in letters}
        else:
            out[place] = f"{short}d"
    return out


COURTS = _index()
_PLACE = "|".join(sorted({k.split(" ", 1)[1] if k.split(" ")[0] in DIRECTIONS.values() and v[2] != "i" else k for k, v in COURTS.items()}, key=lambda p: (-len(p), p)))
_PATTERN = rf"\b(?:({'|'.join(DIRECTIONS.values())}) )?district (?:of |court (?:of|for) )(?:the )?({_PLACE})\b"


def court_key(institution: Column) -> Column:
    """``northern illinois`` of "U.S. Bankruptcy Court for the Northern District of Illinois"; null for other courts and for appeals."""
    low = F.regexp_replace(F.lower(institution), r"[\s,.]+", " ")
    key = F.concat_ws(" ", F.nullif(F.regexp_extract(low, _PATTERN, 1), F.lit("")), F.regexp_extract(low, _PATTERN, 2))
    return F.when(~low.rlike("circuit|appeals|supreme"), F.nullif(key, F.lit("")))


def classified(rows: DataFrame, institution: str, court: str = "court") -> DataFrame:
    """Rows with the court of an institution, null where it is no district court.  The index has a row a court (94), so it is broadcast."""
    index = rows.sparkSession.createDataFrame(list(COURTS.items()), f"_key string, `{court}` string")
    return rows.withColumn("_key", court_key(F.col(institution))).join(F.broadcast(index), "_key", "left").drop("_key")


# The states and territories of each circuit.
CIRCUITS = {
    "1": "me ma nh ri pr", "2": "ct ny vt", "3": "de nj pa vi", "4": "md nc sc va wv", "5": "la ms tx", "6": "ky mi oh tn", "7": "il in wi", "8": "ar ia mn mo ne nd sd", "9": "ak az ca hi id mt nv or wa gu nmi",
    "10": "co ks nm ok ut wy", "11": "al fl ga", "DC": "dc",
}


def circuit(court: Column) -> Column:
    """The circuit of a district's abbreviation, null for anything else."""
    state = {s: c for c, states in CIRCUITS.items() for s in states.split()}
    of = {court: state[court[:-1] if court[:-1] in state else court[:-2]] for court in COURTS.values()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(of.items()) for x in pair]), court)
