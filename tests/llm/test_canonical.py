from __future__ import annotations

from rollbook.llm.canonical import Entry, ReferenceIndex, nearest_reference, reference_hits

ENTRIES = [
    Entry(1, "institution", "University of Harbourg", "UHRB", "Universität Harbourg", "Harbourg"),
    Entry(2, "institution", "Technical University of Harbourg", None, None, "Harbourg"),
    Entry(3, "institution", "Stonefield University of Malmera", None, None, "Malmera"),
    Entry(4, "organisation", "Beacon Society", "BES", None, "Malmera"),
    Entry(5, "organisation", "Beacon Society of Ireland", None, None, "Malmera"),
    Entry(6, "institution", "Malmera School of Economics", None, None, "Malmera"),
]
REF = "ref_id int, kind string, canonical_name string, short_name string, local_name string, city string"
CASES = {
    "Univ. Harbourg": 1, "HARBOURG, UNIVERSITY OF": 1, "uhrb": 1, "Universitat Harburg": 1, "Faculty of Law, Uni of Harbuorg": 1, "Alma Mater Harbourg": 1,
    "TU Harbourg": 2, "Tech. Univ. of Hrabourg (PhD)": 2, "tuhrb": 2, "Stonefield Uni": 3, "Malmera Stonefeild University": 3, "the Beacon Soc.": 4, "Society, Beacon": 4, "BES": 4,
    "Beacon Soc. of Ireland, Board of Trustees": 5, "Beacon Society of Spain": 0, "Conservatory of Harbourg": 0, "Harbourg Business School": 0, "unknown": 0, "Q900": 0, "-": 0, "MBA": 0, "Malmera Econ": 6, "x" * 5000: 0,
    "University of Har bourg": 1, "Univ. Harbourg 1998": 1, "Univ. Harbourg, UHRB": 1, "Univ. Harbourg BES": 0,
}


def reference(spark, entries=ENTRIES):
    return spark.createDataFrame([(e.ref_id, e.kind, e.canonical, e.short, e.local, e.city) for e in entries], REF)


def test_lookup():
    index = ReferenceIndex(ENTRIES)
    assert {v: index.lookup(v)[0] for v in CASES} == CASES
    assert all(index.lookup(e.canonical) == (e.ref_id, 0) for e in ENTRIES)


def test_all_entries_within_distance_are_returned():
    index = ReferenceIndex([Entry(1, "institution", "University of Harbourg", None, None, "Harbourg"), Entry(2, "institution", "University of Harbourn", None, None, "Harbourn")])
    assert index.matches(["university", "harbourt"]) == {1: 1, 2: 1}
    assert index.lookup("University of Harbourt")[0] == 1  # ties: the smallest id


def test_operator_in_one_block_and_in_many(spark):
    rows = [(v, 7, "h") for v in CASES] * 2 + [(None, 7, "h"), ("", 7, "h")]
    df = spark.createDataFrame(rows, "v string, ref_id int, _hit string")
    for most in (100, 2, 1):
        got = nearest_reference(df, "v", reference(spark), max_entries=most)
        assert got.columns == ["v", "_hit", "ref_id", "distance"]
        assert got.count() == len(rows)
        assert {r.v: r.ref_id for r in got.collect()} == CASES | {None: 0, "": 0}


def test_empty_tables(spark):
    df = spark.createDataFrame([("Univ. Harbourg",)], "v string")
    assert nearest_reference(df, "v", spark.createDataFrame([], REF)).first().ref_id == 0
    assert nearest_reference(df.limit(0), "v", reference(spark)).collect() == []


AMBIGUOUS = [
    Entry(1, "institution", "University of Harbourg", "UHRB", None, "Harbourg"),
    Entry(2, "institution", "University of Harobury", None, None, "Harobury"),  # the same letters, but it is the other's short name
    Entry(3, "institution", "Stone University of Malmera", None, None, "Malmera"),
    Entry(4, "institution", "Sand University of Malmora", None, None, "Malmora"),  # both would be SUMLM
    Entry(5, "institution", "Technical University of Tarvfels", None, None, "Tarvfels"),
    Entry(6, "organisation", "Beacon Trust", "BTR", None, None),
    Entry(7, "organisation", "Boulder Trust", "BTR", None, None),
    Entry(8, "institution", "Catholic University of Tarvfels", "CUTRV", None, "Tarvfels"),
    Entry(9, "institution", "Central University of Tarvfels", "CUTRW", None, "Tarvfels"),
]


def test_what_is_unclear_does_not_depend_on_blocks(spark):
    want = {"UHRB": 1, "SUMLM": 0, "TUTRV": 5, "BTR": 6, "CUTRV": 8, "CUTRX": 0, "TUTRVX": 5}
    df = spark.createDataFrame([(v,) for v in want] * 3, "v string")
    for most in (1, 2, 5, 50_000):
        assert {r.v: r.ref_id for r in nearest_reference(df, "v", reference(spark, AMBIGUOUS), max_entries=most).collect()} == want, most
        hits = sorted((r.value, r.ref_id, r.distance, r.acronym) for r in reference_hits(df, "v", reference(spark, AMBIGUOUS), max_entries=most).collect())
        assert [h[1:] for h in hits if h[0] == "BTR"] == [(6, 0, ""), (7, 0, "")]  # equal short names: both are reported
        assert [h[1:] for h in hits if h[0] == "CUTRX"] == [(8, 1, "cutrv"), (9, 1, "cutrw")]


def test_rules_of_short_names_are_learned_from_the_list():
    towns = ("Harbourg", "Malmera", "Tarvfels", "Oldstone")
    listed = [Entry(i, "institution", f"University of {t}", f"U{t[:2].upper()}", None, t) for i, t in enumerate(towns)]
    index = ReferenceIndex([*listed, Entry(9, "institution", "Catholic University of Dorlan", None, None, "Dorlan")])
    assert index.lookup("CUDO")[0] == 9 and index.lookup("CUDRL")[0] == 0


def test_aliases_are_data(spark):
    aliases = spark.createDataFrame([(2, "Polytech on the Hill"), (2, ""), (None, "x"), (77, "nowhere")], "ref_id int, alias string")
    df = spark.createDataFrame([("Polytech on the Hlil",)], "v string")
    for most in (1, 100):
        assert nearest_reference(df, "v", reference(spark), aliases=aliases, max_entries=most).first().ref_id == 2
    assert nearest_reference(df, "v", reference(spark)).first().ref_id == 0


def test_hits_equal_brute_force():
    """Every entry with a path whose words are within their distances, words in place, is found; no other."""
    from rollbook.llm.automaton import distance
    from rollbook.llm.canonical import alias_paths, reach

    towns = ["harbourg", "harbourn", "harburg", "marlow", "marlaw", "malmera"]
    entries = [Entry(i, "institution", f"University of {t}", None, None, t) for i, t in enumerate(towns)]
    index = ReferenceIndex(entries)
    for typed in [*towns, "harborg", "marlov", "malmeera", "xxxx", "harrbourgg"]:
        want = {}
        for e in entries:
            for path in alias_paths(e):
                if len(path) == 2 and path[0] == "university" and (d := distance(typed, path[1], 3)) <= reach(len(path[1])) and d <= reach(len(typed) + 2):
                    want[e.ref_id] = min(d, want.get(e.ref_id, 9))
        assert index.matches(["university", typed]) == want
