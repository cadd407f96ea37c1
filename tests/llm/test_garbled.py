import pytest

from samewise.llm.garbled import _inverse, repair, stretches, unescape

LINES = ["Crème brûlée next to the tide chart? Déjà vu… ok.", "Das Kettenöl läuft über 5 Stunden – größer geht’s nicht.", "She said “the heddle isn’t noisy” — well, it is…", "Я почистил котёл у канала утром, дорого.", "About £53 – or €58 – for it, don’t ask.", "O fogão mede 26 mm e não há razão."]


@pytest.mark.parametrize("chain, write, read", [("utf8>cp437", "utf-8", "cp437"), ("utf8>mac_roman", "utf-8", "mac_roman"), ("utf8>latin1", "utf-8", "latin1"), ("cp1252>mac_roman", "cp1252", "mac_roman")])
def test_inverse(chain, write, read):
    for c in "éüß–’€":
        try:
            bad = c.encode(write).decode(read)
        except UnicodeError:
            continue
        assert _inverse(chain)(bad) == c


def test_stretches_and_entities():
    t = "One. Two…  three\n<b>four</b>[i]five"
    assert "".join(stretches(t)) == t and stretches("") == []
    assert unescape("&Atilde;&copy; &amp; &nbsp;") == "Ã© &amp; &nbsp;"


def corpus():
    good = [f"{a} {b}" for i, a in enumerate(LINES * 12) for b in [LINES[(i * 5 + 1) % 6]]]
    bad = {}
    for i, (w, r) in enumerate([("utf-8", "cp437"), ("utf-8", "latin1"), ("utf-8", "mac_roman"), ("cp1252", "mac_roman")] * 3):
        s = LINES[i % 3]
        bad[1000 + i] = (s, s.encode(w).decode(r))
    twice = LINES[0].encode().decode("latin1").encode().decode("latin1")
    bad[2000] = (LINES[0], twice)
    return good, bad


def test_found_and_restored(spark):
    good, bad = corpus()
    data = [(i, t, "a", "clash") for i, t in enumerate(good)] + [(i, "Fine start. " + b, "a", "clash") for i, (_, b) in bad.items()]
    data += [(3000, None, "a", "clash"), (3001, "", None, "clash"), (3002, "ÂGE MÛR and PÃO DE AÇÚCAR", "a", "clash"), (3003, "├── rack\n└── bin", "a", "clash"), (3004, "lost F��r", "a", "clash"), (3005, "plain &amp; &nbsp; ascii " * 5000, "b", "clash"), (3006, "caf&Atilde;&copy; cr&Atilde;&uml;me &Atilde;&copy;t&Atilde;&copy;", "a", "clash")]
    out = {r["doc_id"]: r for r in repair(spark.createDataFrame(data, "doc_id long, text string, source string, restored string"), "doc_id", "text", "source").collect()}
    assert {i for i, r in out.items() if r["garbled"]} == set(bad) | {3004, 3006}
    assert sum(out[i]["restored"] == "Fine start. " + s for i, (s, _) in bad.items()) >= len(bad) - 1
    assert out[3000]["restored"] is None and out[3001]["restored"] == "" and not out[3004]["whole"] and out[3006]["restored"] == "café crème été"


def test_empty_table(spark):
    e = spark.createDataFrame([], "doc_id long, text string, source string")
    assert repair(e, "doc_id", "text", "source").collect() == []


def test_fields_are_told_by_stretch():
    from samewise.llm.garbled import quoted

    t = "Own. > no\n> a quoted line\nown again\n[quote=x]inner [quote]deep[/quote] still[/quote] out <blockquote>b</blockquote> end"
    parts = stretches(t)
    said = dict(zip(parts, quoted(t, parts)))
    assert said["> a quoted line\n"] and not said["own again\n"] and not said["Own. "]
    inside = "".join(s for s, q in zip(parts, quoted(t, parts)) if q)
    assert "deep" in inside and "still" in inside and "b" in inside and "end" not in inside and "out" not in inside
    assert quoted("no quotation", ["no quotation"]) == [False] and all(quoted("[quote] never closed", stretches("[quote] never closed")))


def test_signatures_come_back():
    from samewise.llm.garbled import _read, _runs, signature

    t = "Crème brûlée.\n> déjà vu\nplain\n"
    parts, fields = _read(signature(t))
    assert parts == [_runs(s) for s in stretches(t) if _runs(s)] and fields == [False, True]
    assert signature("plain") == ""


def test_text_garbled_many_times_is_repaired_as_often(spark):
    good, bad = corpus()
    s = LINES[0]
    for _ in range(5):
        s = s.encode().decode("latin1")
    data = [(i, t, "a") for i, t in enumerate(good)] + [(1000 + i, b, "a") for i, (_, b) in enumerate(bad.values())] + [(9999, s, "a")]
    out = {r["doc_id"]: r for r in repair(spark.createDataFrame(data, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert out[9999]["garbled"] and out[9999]["restored"] == LINES[0]
