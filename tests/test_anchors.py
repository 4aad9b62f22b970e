"""Anchor rules against the same rules stated on plain strings, over all pairs; crossover and equal names by hand."""

from itertools import combinations

from docketlens.functions.fuzzy import partial_ratio, ratio, token_set_ratio, token_sort_ratio
from docketlens.operators import anchors, resolve

NAMES = """john robert smith|smith|smiths|smtih|jon smith|j smith|john r smith iii|robert smith|cole|coleman|amy j st eve|st eves|o connor|mary oconnor|connor|mc donald|donald
gelpi|gelp i|gustavo gelpi|karen j williams|karen m williams|karen williams|william|ann smith washington jones|washington jones|jude kim|david kim|kim|li|ann lin|cjr|charles j roe
a wallace tashima|atsushi wallace tashima|p k holmes iii|paul kinlock holmes iii|paul holmes|jr|van geulen|vangeulen|susan van geulen|ab c|abc|roberts|robertson|j|judithj""".replace("\n", "|").split("|")
SUFFIXES = {"i", "ii", "iii", "iv", "v", "jr", "jnr", "snr", "sr", "senior", "junior"}


def parts(n):
    w = n.split()
    b = w[:-1] if w[-1] in SUFFIXES else w
    return w, b, (b[-1] if b else None)


def rule_one(a, b):
    (w, x, p), (v, y, q) = parts(a), parts(b)
    if not p or not q or len(p) == 1 or len(q) == 1 or max(ratio(p, q), partial_ratio(p, q)) < 92:
        return False
    if 1 in (len(x), len(y)):
        return abs(len(p) - len(q)) <= 2
    split = any(len(m) == 2 and m[0] in ("jude", "j", "o", "mc", "van") and partial_ratio(m[1], other) >= 92 for m, other in ((w, b), (v, a)))
    return split or (len(w) > 1 and len(v) > 1 and len(w[0]) > 1 and len(v[0]) > 1 and w[0] != v[0] and partial_ratio(a, b) >= 98)


def rule_two(a, b):
    (w, x, p), (v, y, q) = parts(a), parts(b)
    if p and q and ratio(p, q) >= 90 and (token_set_ratio(a, b) >= 98 or (len(w) == 1) != (len(v) == 1)):
        return True
    if q and len(w) == 2 and 1 in (len(w[0]), len(w[1])) and ratio("".join(w), q) >= 95:
        return True
    if len(w) > 1 and len(v) > 1:
        if len(w) > 2 and len(v) > 2 and x[1][0] != y[1][0]:
            return False
        if ratio(x[0], y[0]) >= 90 and ratio(x[-1], y[-1]) >= 90:
            return not (len(x) == len(y) == 3 and x[1] != y[1])
    return len(w) == 2 and len(v) > 2 and len(x) == 2 and ratio(x[0], y[-2]) >= 90 and ratio(x[1], y[-1]) >= 90


def rule_three(a, b):
    (w, x, p), (v, y, q) = parts(a), parts(b)
    if len(w) < 2:
        return False
    if len(v) > 1 and ((ratio(x[0], y[0]) >= 90 and ratio(x[-1], y[-1]) >= 90) or ratio("".join(w), "".join(v)) >= 95):
        return True
    if w[0] in ("j", "jude") and q and ratio(w[1], q) >= 92:
        return True
    c, d = ".".join(w), ".".join(v)
    return (c in d or d in c or ratio(c, d) >= 92) and len("".join(w)) > 3 and len("".join(v)) > 3 and not (len(v) == 1 and b in HEADERS)


def rule_letter(a, b):
    (w, x, p), (v, y, q) = parts(a), parts(b)
    if len(w) < 2 or len(v) < 2 or (len(w[0]) > 1 and len(v[0]) > 1):
        return False
    if token_sort_ratio(a, b) > 80 and w[1] == v[1]:
        return True
    form = lambda m, n, k: " ".join([*[t[0] for t in n[:-1]], *m[len(n) :], k])
    return ratio(form(w, x, p), form(v, y, q)) >= 92 and p == q and not (len(w[1]) > 1 and len(v[1]) > 1 and w[1] != v[1])


HEADERS = {"gelpi", "vangeulen"}


def test_rules_against_all_pairs(spark):
    nodes = spark.createDataFrame([("c", n, n in HEADERS) for n in NAMES], "scope string, name string, was_header boolean")
    nodes = resolve.ordered(nodes, "scope", "name").cache()
    order = {r.ord: r.name for r in nodes.select("ord", "name").collect()}
    pairs = anchors.anchor_pairs(nodes, "scope", "name", ("was_header",)).cache()
    for edges, rule in (
        (anchors.surname_edges(pairs, "scope"), rule_one), (anchors.surname_or_ends_edges(pairs, "scope"), rule_two),
        (anchors.fused_name_edges(pairs, "scope", header="was_header"), rule_three), (anchors.first_letter_edges(pairs, "scope"), rule_letter),
    ):
        got = {(order[r.a_ord], order[r.b_ord]) for r in edges.collect()}
        want = {(order[i], order[j]) for i, j in combinations(sorted(order), 2) if rule(order[i], order[j])}
        assert got == want and want, rule.__name__


def test_crossover_and_equal_names(spark):
    nodes = spark.createDataFrame([("x", n) for n in ("ann smith", "bo smith jr", "smiths", "kim lopezs", "lopez", "ed marsh", "masrh", "roe")] + [("y", "lopez")], "court string, name string")
    got = {tuple(r) for r in anchors.crossover(nodes, "court", "name").collect()}
    assert got == {("x", "smiths", None, True), ("x", "lopez", "kim lopezs", False), ("x", "masrh", "ed marsh", False)}
    rows = [("a", None, 1), ("a", "f1", 2), ("a", None, 3), ("b", "f1", 4), ("b", "f2", 5), ("c", None, 6), ("d", None, 7), ("d", None, 8)]
    got = {tuple(r) for r in anchors.same_name(spark.createDataFrame(rows, "name string, id string, ord int"), "name", "id", "ord").collect()}
    assert got == {("a", 2, False), ("b", None, True), ("d", 7, False)}
