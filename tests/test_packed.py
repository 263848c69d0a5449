from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.operators import packed
from rollbook.operators.packed import Scorer, segment, split_packed

COUNTS = {"Alpha": 50.0, "Beta": 50.0, "Gamma": 50.0, "Secretary of State; Deputy Leader": 30.0, '"Agora" rapporteur, second term': 30.0, "Senate | Upper House": 30.0}
SCORER = Scorer(COUNTS, 300.0)


def cut(cell):
    return segment(cell, SCORER)


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        (None, []),
        ("", []),
        ("   ", []),
        ("Alpha", ["Alpha"]),
        ("Alpha || Beta || || Alpha", ["Alpha", "Beta", "Alpha"]),
        (" Alpha; Beta\nGamma ", ["Alpha", "Beta", "Gamma"]),
        ('"Secretary of State; Deputy Leader"; Beta', ["Secretary of State; Deputy Leader", "Beta"]),
        (r"Secretary of State\; Deputy Leader;Beta", ["Secretary of State; Deputy Leader", "Beta"]),
        ("Secretary of State; Deputy Leader", ["Secretary of State; Deputy Leader"]),
        ('"""Agora"" rapporteur, second term", Beta', ['"Agora" rapporteur, second term', "Beta"]),
        ('"Agora" rapporteur, second term | Beta', ['"Agora" rapporteur, second term', "Beta"]),
        ("«Senate | Upper House» | Alpha", ["Senate | Upper House", "Alpha"]),
        (r"Senate \| Upper House || Alpha", ["Senate | Upper House", "Alpha"]),
        ("“Alpha” / Beta", ["Alpha", "Beta"]),
        ("Alpha (1990-01-01 to 1991-01-01), Beta (from 1992-01-01)", ["Alpha (1990-01-01 to 1991-01-01)", "Beta (from 1992-01-01)"]),
    ],
)
def test_segment(cell, want):
    assert cut(cell) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(sorted(COUNTS)), min_size=1, max_size=7), st.sampled_from([" || ", "; ", ", ", "\n", " • ", " | "]))
def test_round_trip_of_protected_values(values, joiner):
    kind = joiner.strip(" ") or joiner
    inner = {"||": "|", "|": "|"}.get(kind, kind)
    written = [f'"{v.replace(chr(34), chr(34) * 2)}"' if inner in v else v for v in values]
    assert cut(joiner.join(written)) == values


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='ab |;,/\n\t"«»\\•(', max_size=60))
def test_any_text_is_cut_without_loss_of_letters(cell):
    got = cut(cell)
    assert all(v == v.strip() and v for v in got)
    assert "".join(c for v in got for c in v if c in "ab") == "".join(c for c in cell if c in "ab")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_operator_cases(spark, monkeypatch):
    cells = [(1, "Alpha || Beta"), (2, None), (3, ""), (4, "Alpha; Beta; Alpha"), (4, "Alpha; Beta; Alpha"), (None, "Beta"), (6, " | ".join(["Alpha"] * 3000))]
    df = spark.createDataFrame([(i, c, "kept", 9) for i, c in cells], "id int, cell string, _values string, pos int")
    got = split_packed(df, "cell")
    assert got.columns == ["id", "cell", "_values", "val", "pos"]
    out = sorted((r.id or 0, r.pos, r.val) for r in got.collect() if r.id != 6)
    assert out == sorted([(1, 1, "Alpha"), (1, 2, "Beta"), (0, 1, "Beta")] + 2 * [(4, 1, "Alpha"), (4, 2, "Beta"), (4, 3, "Alpha")])
    assert got.where("id = 6").count() == 3000
    assert {r._values for r in got.collect()} == {"kept"}
    assert rows(split_packed(df.limit(0), "cell")) == []
    assert rows(split_packed(df.where("cell = '' or cell is null").repartition(3), "cell")) == []
    joined = sorted((r.id or 0, r.pos, r.val) for r in split_packed(df, "cell", max_broadcast=0).collect() if r.id != 6)
    assert joined == out


def test_extra_values_protect_rare_ones(spark):
    df = spark.createDataFrame([("College of Law, Oldtown; Beta",), ("Beta",), ("Beta, College",)], "cell string")
    known = spark.createDataFrame([("College of Law, Oldtown",), (None,), ("",)], "v string")
    assert ("College of Law, Oldtown" in {r.val for r in split_packed(df, "cell", extra_values=known).collect()})


def test_models_are_rebuilt_for_another_dictionary():
    a, b = {"x": 1.0}, {"y": 1.0}
    assert packed._model(a, 1.0).counts is a
    assert packed._model(b, 1.0).counts is b


LONG = "Ministry of Trade, Industry, Energy, Small Firms, Tourism, Crafts"


@pytest.mark.parametrize("pieces", range(2, 7))
def test_known_values_of_any_number_of_pieces_stay_whole(pieces):
    value = ", ".join(LONG.split(", ")[:pieces])
    scorer = Scorer({value: 500.0, "Mayor": 500.0}, 1000.0)
    assert segment(f"{value}, Mayor", scorer) == [value, "Mayor"]
    assert segment(f"Mayor, {value} (2001-01-01 to 2002-01-01), Mayor", scorer) == ["Mayor", f"{value} (2001-01-01 to 2002-01-01)", "Mayor"]


TOWNS = ("Aston", "Bolton", "Cadby", "Denby", "Elton", "Formby")
COUNCIL = {f"Councillor of {t}, ward 4": 20.0 for t in TOWNS} | {f"Mayor of {t}": 20.0 for t in (*TOWNS, "Newtown", "Oldby")}


def test_templates_join_across_a_delimiter():
    scorer = Scorer(COUNCIL, sum(COUNCIL.values()))
    assert "Councillor of Newtown, ward 4" not in COUNCIL
    assert segment("Councillor of Newtown, ward 4, Mayor of Oldby", scorer) == ["Councillor of Newtown, ward 4", "Mayor of Oldby"]


def brute_spans(cell, scorer, begins, ends):
    """Every stretch between two places that is a known value or, with its names blanked, a productive template."""
    out = {}
    for e in ends:
        for b in begins:
            key = cell[b:e]
            template = packed.blanked(key, scorer.names)
            if key and (key in scorer.counts or "_" in template and template != key and scorer.templates.get(template, 0) >= 2):
                out.setdefault(e, set()).add(b)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*TOWNS, "Newtown", "Councillor of", "Mayor of", "ward 4", ",", ";", " ", "||", '"', "(", "(2001-01-01)", "x", "\\"]), max_size=14))
def test_spans_equal_brute_force(parts):
    scorer = Scorer(COUNCIL, sum(COUNCIL.values()))
    cell = " ".join(parts)
    begins, ends = {0}, {len(cell)}
    for start, end, mark in packed._specials(cell):
        if mark in packed.KINDS:
            ends.add(packed._trimmed(cell, 0, start)[2])
            begins.add(packed._trimmed(cell, end, len(cell))[0])
    assert {e: set(bs) for e, bs in scorer.spans(cell, begins, ends).items()} == brute_spans(cell, scorer, begins, ends)


@pytest.mark.parametrize("limit", [0, 3])
def test_rows_do_not_depend_on_the_size_of_a_shard(spark, limit):
    towns = [f"Councillor of {t}, ward 4" for t in TOWNS]
    cells = [f'"{v}"; Mayor of {t}' for v, t in zip(towns * 3, TOWNS * 3)] + [f"Mayor of {t}" for t in (*TOWNS, "Newtown", "Oldby") * 2]
    cells += ["Councillor of Newtown, ward 4, Mayor of Oldby", r"Councillor of Newtown\, ward 4; Mayor of Cadby", f'"{LONG}"', f'"{LONG}" | Alpha', f"{LONG}, Mayor of Aston", '"the ""Agora"" club, board", Alpha', "Alpha", "Alpha", "Q12; Q13", ";;", "“", ""]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, cell string")
    got = {r.id: [] for r in df.collect()}
    for r in split_packed(df, "cell", max_broadcast=limit, extra_values=spark.createDataFrame([(LONG,)], "v string")).orderBy("id", "pos").collect():
        got[r.id].append(r.val)
    n = len(TOWNS) * 3 + 16
    assert got[n] == ["Councillor of Newtown, ward 4", "Mayor of Oldby"]
    assert got[n + 1] == ["Councillor of Newtown, ward 4", "Mayor of Cadby"]
    assert got[n + 3] == [LONG, "Alpha"] and got[n + 4] == [LONG, "Mayor of Aston"]
    assert got[n + 5] == ['the "Agora" club, board', "Alpha"]
    assert got[n + 9] == [] and got[n + 11] == []
    whole = {r.id: [] for r in df.collect()}
    for r in split_packed(df, "cell", extra_values=spark.createDataFrame([(LONG,)], "v string")).orderBy("id", "pos").collect():
        whole[r.id].append(r.val)
    assert got == whole
