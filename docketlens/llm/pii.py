"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers.  Each distinct value found is a protected entity.  Over the whole
corpus, a term (a run of letters) co-occurs with an entity in every text that
holds both.  Frequencies count distinct texts: copies of a whole text are one.
The pointwise mutual information PMI(e; t) = log(p(e, t) / (p(e) p(t))) says how
much of the entity's information content IC(e) = -log p(e) the term gives away.
In texts that hold the entity, terms with PMI / IC of at least ``GENERALISE``
are generalised, of at least ``REMOVE`` removed.  The share alone decides, for
entities of one text too; p(t) is estimated from one text more than the term
was seen in, so that a word of a very small table is not telling by being rare.

Entities held by the same texts have the same shares and count as one, so a
list of a thousand addresses is no more work than one address.

Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans; repeated rows are
searched each; a row's disclosing terms follow from its own text, whatever its
``doc_id``; an entity that all texts hold has no information to give away; a
share on a threshold reaches it; a very long text is searched whole, in time
linear in its length; further columns are kept where asked for; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE = 0.7, 0.9
#: Keys (8 bytes each) up to which a list of texts is broadcast; beyond, it is joined.
BROADCAST_KEYS = 1_000_000

# Equivalent to the stated patterns, but linear in the length of the text: a
# match can begin only at the start of its run of digits (or local part).
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


def _emails(text: str):
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind and start."""
    if not text:
        return []
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in _ips(text)]
        out += [("card", *s) for s in _cards(text)]
        out += [("phone", *s) for s in _phones(text)] if "+" in text else []
    return out


def entity(kind: str, value: str) -> str:
    """One key for the spellings of a value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def outside(text: str, base: list[tuple[str, int, int]]):
    """Matches of terms that touch no base span."""
    taken = sorted((s, e) for _, s, e in base)
    at, reach = 0, 0  # spans that begin before the term ends, and how far they go
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            yield m


def observations(keyed: DataFrame, flush: int = 20_000) -> DataFrame:
    """``key, entity, term`` from ``text, key``: of every text with entities each entity, and each term outside them."""
    schema = pa.schema([("key", pa.int64()), ("entity", pa.string()), ("term", pa.string())])

    def run(batches):
        found: list[tuple[int, str | None, str | None]] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if spans := base_spans(text):
                    found += [(key, e, None) for e in {entity(k, text[a:b]) for k, a, b in spans}]
                    found += [(key, None, t) for t in {m[0].lower() for m in outside(text, spans)}]
                if len(found) > flush:
                    yield out()
                    found = []
        if found:
            yield out()

    return keyed.select("text", "key").mapInArrow(run, "key long, entity string, term string")


def term_frequencies(weighed: DataFrame, flush: int = 100_000) -> DataFrame:
    """``term, n`` from ``text, weight``: partial weights of the texts that hold each term, to be summed."""

    def run(batches):
        counts: dict[str, float] = {}

        def out():
            return pa.RecordBatch.from_pydict({"term": list(counts), "n": pa.array(counts.values(), pa.float64())}, schema=pa.schema([("term", pa.string()), ("n", pa.float64())]))

        for batch in batches:
            for text, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in {t.lower() for t in _TERM.findall(text)}:
                    counts[term] = counts.get(term, 0) + weight
                if len(counts) > flush:
                    yield out()
                    counts = {}
        if counts:
            yield out()

    return weighed.select("text", "weight").mapInArrow(run, "term string, n double")


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def disclosures(docs: DataFrame) -> DataFrame:
    """``key, term, share``: the terms of each text (by its hash) that give away an entity it holds, and
    how much of the entity's information at most, from ``GENERALISE`` up."""
    bound_batches(docs.sparkSession)
    keyed = docs.where("text <> ''").select("text", F.xxhash64("text").alias("key"))
    texts = stored(keyed.groupBy("key").agg(F.count("*").alias("copies")), "pii-texts")
    n = float(texts.count())
    seen = stored(observations(keyed), "pii-observations")
    held = stored(seen.where("entity IS NOT NULL").select("key", "entity").distinct(), "pii-held")
    # Entities of the same texts are one group.
    same = held.groupBy("entity").agg(F.count("*").alias("n_e"), F.expr("bit_xor(xxhash64(key))").alias("x"), F.expr("bit_xor(xxhash64(key, 1))").alias("y"))
    same = same.where(F.col("n_e") < n).select(F.col("entity").alias("_e"), F.struct("n_e", "x", "y").alias("who"), "n_e")
    groups = stored(held.join(same, F.col("entity") == F.col("_e")).select("key", "who", "n_e").distinct(), "pii-groups")
    # No share is reached beyond this frequency of a term, even if the term stands in every text of the entity.
    rare = f"n_t + 1 <= pow({n}D, {1 - GENERALISE}D) * pow(n_e, {GENERALISE}D) * 1.000001D"
    most = groups.agg(F.max("n_e").alias("n_e")).first().n_e or 0
    weighed = keyed.join(_few(texts.where("copies > 1").select(F.col("key").alias("_key"), "copies")), F.col("key") == F.col("_key"), "left")
    weighed = weighed.select("text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    frequency = term_frequencies(weighed).groupBy("term").agg(F.round(F.sum("n")).alias("n_t")).withColumn("n_e", F.lit(most)).where(rare).select(F.col("term").alias("_t"), "n_t")
    terms = seen.where("term IS NOT NULL").select("key", "term").distinct().join(frequency, F.col("term") == F.col("_t")).select(F.col("key").alias("_key"), "term", "n_t")
    pairs = stored(groups.join(terms, F.col("key") == F.col("_key")).where(rare).select("key", "who", "n_e", "term", "n_t"), "pii-pairs")
    share = F.expr(f"ln(n_et * {n}D / (n_e * (n_t + 1))) / ln({n}D / n_e)")
    shares = pairs.groupBy("who", "term", "n_e", "n_t").agg(F.count("*").alias("n_et")).select(F.col("who").alias("_w"), F.col("term").alias("_t"), share.alias("share"))
    told = pairs.join(shares.where(F.col("share") >= GENERALISE), F.expr("who = _w AND term = _t"))
    return told.groupBy("key", "term").agg(F.max("share").alias("share"))


def term_spans(text: str, base: list[tuple[str, int, int]], terms: dict[str, float]) -> list[tuple[str, int, int]]:
    """Disclosing terms outside the base spans."""
    return [("term", *m.span()) for m in outside(text, base) if m[0].lower() in terms]


def sanitise(text: str, spans: list[tuple[str, int, int]], terms: dict[str, float]) -> str:
    """The text with base spans replaced by their kind, terms generalised or removed."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            word = "" if kind == "term" and terms.get(text[start:end].lower(), 0) >= REMOVE else f"[{kind.upper()}]"
            out += (text[at:start], word)
        at = max(at, end)
    return "".join([*out, text[at:]])


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def private(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """``keep`` columns with ``n_email, n_ip, n_card, n_phone, base_sha256, spans``, and ``clean`` (the
    sanitised text) if asked for.  Two passes of statistics over the corpus, one of searching."""
    spark = docs.sparkSession
    found = disclosures(docs).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("_terms"))
    found = stored(found.withColumnRenamed("key", "_k"), "pii-disclosures")
    kept = docs.select(*keep, F.col("text").alias("_text"), F.xxhash64("text").alias("_key"))
    # Only texts with terms meet their terms; the others do not move.
    telling = _few(found.select("_k"))
    with_terms = kept.join(telling, F.col("_key") == F.col("_k"), "left_semi").join(found, F.col("_key") == F.col("_k")).drop("_key", "_k")
    without = kept.join(telling, F.col("_key") == F.col("_k"), "left_anti").drop("_key").withColumn("_terms", F.lit(None).cast("map<string,double>"))
    kept = with_terms.unionByName(without)
    bound_batches(spark)
    names = [*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"] + ["clean"] * with_text
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    ddl += "".join(f", n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", clean string" * with_text
    width = len(keep)

    def run(batches):
        for batch in batches:
            counts = {k: [] for k in KINDS}
            hashes, spans_out, clean = [], [], []
            for text, told in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                base = base_spans(text)
                terms = dict(told or ())
                more = term_spans(text, base, terms) if terms else []
                for k in KINDS:
                    counts[k].append(sum(b[0] == k for b in base))
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans_out.append(written(base + more))
                if with_text:
                    clean.append(text if not base and not more else sanitise(text, base + more, terms))
            cols = [batch.column(i) for i in range(width)] + [pa.array(counts[k], pa.int64()) for k in KINDS]
            cols += [pa.array(hashes, pa.string()), pa.array(spans_out, pa.string())] + [pa.array(clean, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return kept.mapInArrow(run, ddl)


def sanitised_documents(docs: DataFrame) -> DataFrame:
    """The documents with sanitised texts, and the columns they came with (``n_chars`` follows the text)."""
    # The row travels as one column: no name of its own meets a name of the result.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("text"))
    out = private(docs.select(row.alias("row"), "text"), ["row"], with_text=True)
    cols = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return out.select(*[cols[c].alias(c) if c in cols else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
