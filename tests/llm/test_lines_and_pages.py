from collections import defaultdict


import numpy as np

from tamiz.llm import boilerplate, lines

DOC = "row_id bigint, source string, url string, content string, k1 int, line string, site_name string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOC)


ROWS = [(i, "s", f"u{i}", f"Comparte  ESTO {i}\nTexto propio número {'abcdefghij'[i % 10] * (i + 1)}.\n\n") for i in range(10)]
ROWS += [(10, "s", "u1", "comparte esto 7"), (11, "t", "u1", "Comparte esto 1"), (12, "s", "u12", None), (13, "s", "u13", ""), (14, None, None, "a b\r"), (15, "s", "u1", "x" * 300_000)]


def brute(rows, least):
    import re

    seen = defaultdict(set)
    keyed = []
    for row_id, source, url, content in rows:
        for n, line in enumerate((content or "").split("\n"), 1):
            w = re.sub(r"\d+", "0", re.sub(r"\s+", " ", line.lower()).strip())
            if w:
                keyed.append((row_id, n, source, w))
                if url is not None:
                    seen[source, w].add(url)
    return {(r, n) for r, n, s, w in keyed if len(seen[s, w]) >= least}


def test_repeated_lines_in_one_and_many_deltas(spark, tmp_path):
    docs = table(spark, ROWS)
    want = brute(ROWS, 8)
    assert want
    whole = lines.LineCounts(spark, str(tmp_path / "a"))
    crossed = whole.update(docs)
    assert crossed.count() == 1
    assert {tuple(r) for r in lines.flag_lines(docs, whole.repeated()).collect()} == want
    steps = lines.LineCounts(spark, str(tmp_path / "b"))
    new = [steps.update(docs.where(c)).count() for c in ("row_id < 5", "row_id >= 5 and row_id < 8", "row_id >= 4")]
    assert new == [0, 1, 0]
    assert sorted(map(tuple, steps.repeated().collect())) == sorted(map(tuple, whole.repeated().collect()))
    assert sorted(map(tuple, whole.flagged().collect())) == sorted(want) == sorted(map(tuple, steps.flagged().collect()))
    kept = {r["row_id"]: r["content"] for r in lines.drop_lines(docs, lines.flag_lines(docs, whole.repeated())).collect()}
    assert kept[0] == ROWS[0][3].split("\n", 1)[1] and kept[11] == ROWS[11][3] and kept[12] is None and kept[13] == "" and kept[10] == "" and len(kept) == len(ROWS)


def test_a_delta_rebuilds_only_what_it_changes(spark, tmp_path):
    first = [(i, "s", f"u{i}", f"pie\npropio {chr(97 + i) * 3}") for i in range(7)] + [(50, "s", "v", "otro texto"), (51, "t", "w", "pie"), (52, "s", None, "pie")]
    second = [(20, "s", "u20", "PIE\nuno"), (21, "s", "u21", "nada")]
    counts = lines.LineCounts(spark, str(tmp_path / "d"))
    assert counts.update(table(spark, first)).count() == 0 and counts.flagged().count() == 0
    # another process goes on
    counts = lines.LineCounts(spark, str(tmp_path / "d"))
    crossed = counts.update(table(spark, second))
    assert crossed.count() == 1
    assert {r["row_id"] for r in counts.to_rebuild(crossed).collect()} == {*range(7), 52, 20}
    got = {r["row_id"]: r["content"] for r in counts.rebuild(table(spark, first + second), crossed).collect()}
    assert got.keys() == {*range(7), 52, 20} and got[20] == "uno" and got[3] == "propio ddd" and got[52] == ""
    # counts that did not change are not written again
    assert counts._read("counts", counts.COUNTS, counts.kept.live()[-1:]).count() == 3
    third = counts.update(table(spark, [(30, "s", "u30", "pie"), (31, "s", "u3", "pie")]))
    assert third.count() == 0 and {r["row_id"] for r in counts.to_rebuild(third).collect()} == {30, 31}


def test_no_documents(spark, tmp_path):
    counts = lines.LineCounts(spark, str(tmp_path / "c"))
    docs = spark.createDataFrame([], DOC)
    assert counts.update(docs).count() == 0 and lines.flag_lines(docs, counts.repeated()).count() == 0


PARAGRAPH = "El consejo revisó el plan durante la reunión, según explicó la alcaldesa; la votación, aplazada dos veces, terminó sin acuerdo. "


def test_main_content(spark):
    rows, want = [], set()
    for i in range(30):
        body = [
            ("Inicio > Ciencia", False), ("Portada | Ciencia | Cultura | Deportes", False), ("Por Ana Paz Luna", False), (PARAGRAPH * 2 + f"Caso {'abcdefghijklmnopqrstuvwxyzñáéí'[i]}.", True),
            ("", None), (f"La vacuna {i * 'a'}b, un plan", True), (PARAGRAPH + "x" * i + ".", True), ("Foto: archivo, el puerto", False), (f"- Un plan {'z' * i} y otro", True), (f"- La red {'y' * i} nueva", True),
            (f"—¿Y la red {'w' * i}?", True), (PARAGRAPH + "y" * i + ".", True), ("Le puede interesar", False), (f"El censo {'q' * i}k: un museo", False), (f"La feria {'r' * i}k: un puente", False),
            (f"lector_ab{i}: no estoy de acuerdo.", False), ("© Diario. Todos los derechos reservados.", False),
        ]
        rows.append((i, "d.example", f"u{i}", "\n".join(t for t, _ in body)))
        want |= {(i, n) for n, (_, keep) in enumerate(body, 1) if keep is False}
    rows += [(90, None, None, None), (91, "d.example", "v", ""), (92, "nosuch", "w", " \n\t"), (93, "d.example", "z", "y" * 200_000)]
    sites = spark.createDataFrame([("d.example", "Diario", "a")], "source string, site_name string, row_id string")
    got = {tuple(r) for r in boilerplate.outside_main(table(spark, rows), sites).collect()}
    assert {g for g in got if g[0] < 90} == want
    assert not {g[0] for g in got} & {90, 91, 92}
    empty = spark.createDataFrame([], DOC)
    assert boilerplate.outside_main(empty, sites).count() == 0


def test_the_ratio_rejects_sentences_of_furniture(spark):
    rows = []
    for i in range(300):
        word = "".join("abcdefghij"[int(d)] for d in f"{i:03d}")
        body = [f"El {x}{word} sigue. " + PARAGRAPH for x in "mnpqrs"]
        rows.append((i, "d.example", f"u{i}", "\n".join([*body, f"Pulse aquí y descubra {word}.", "© Diario. Todos los derechos reservados."])))
    sites = spark.createDataFrame([("d.example", "Diario", "a")], "source string, site_name string, row_id string")
    got = {tuple(r) for r in boilerplate.outside_main(table(spark, rows), sites).collect()}
    assert got == {(i, n) for i in range(300) for n in (7, 8)}


def test_an_article_taken_over_by_other_sites_is_no_template(spark):
    rows = []
    for i in range(40):
        word = "".join("abcdefghij"[int(d)] for d in f"{i:02d}")
        rows.append((i, f"s{i}.example", f"u{i}", "\n".join([*(f"El {x} sigue. " + PARAGRAPH for x in "mnp"), f"Otra cosa {word}. " + PARAGRAPH])))
        rows += [(100 + 40 * n + i, f"s{i}.example", f"v{n}{i}", "\n".join([*(f"La {x}{word}{n} sigue. " + PARAGRAPH for x in "mnp"), "Reciba el boletín de la mañana."])) for n in range(5)]
    sites = spark.createDataFrame([], "source string, site_name string")
    got = {tuple(r) for r in boilerplate.outside_main(table(spark, rows), sites).collect()}
    assert got == {(r[0], 4) for r in rows if r[0] >= 100}


def test_without_the_ratios_nothing_is_told_apart():
    kind, page = np.array([boilerplate.RUNNING, boilerplate.TEXT, boilerplate.RUNNING]), np.zeros(3, int)
    ones, none = np.ones(3), np.zeros(3)
    assert (boilerplate._judged(ones, none, kind, page, none.astype(bool), none, none, none, none) >= boilerplate.THRESHOLD).all()
    assert (boilerplate._judged(none, none, kind, page, none.astype(bool), none, none, none, none) < boilerplate.THRESHOLD).all()
