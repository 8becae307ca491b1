from rillflow.plans import catalogue as C
from rillflow.plans import schema


def test_catalogue():
    assert len(C.KEYS) == 41 and len(set(C.KEYS)) == 41 and len(C.DEFAULTS) == 39
    assert [k for k, *_ in schema.ZONINGS] == [k for k in C.TABS["zonages"] if k != "gbif"]
    assert C.tab_of("rpg") == "agricole"


def test_selections():
    assert C.selection(["rpg", "nothing"]) == {"rpg"} and C.selection(None) == C.DEFAULTS
    assert C.as_text({"irep", "metriques", "rpg"}) == "metriques,rpg,irep"
    assert C.from_text(None) == C.DEFAULTS and C.from_text("") == set()
    assert C.from_text(C.as_text({"carhab", "bio"})) == {"carhab", "bio"}
    assert C.from_text("rpg", known="rpg,bio") == {"rpg"} | (C.DEFAULTS - {"rpg", "bio"})
    assert C.from_text("rpg", later=["zhim", "carhab"]) == {"rpg", "zhim"}


def test_settings():
    stored = {"a": "yes", "b": "x", "c": "3", "d": True}
    assert [C.setting(stored, k, d) for k, d in (("a", False), ("b", 2), ("c", 1.5), ("d", False), ("e", "z"))] == [True, 2, 3.0, True, "z"]
