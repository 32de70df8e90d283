import duckdb
import numpy as np

from postlode.llm import holdout, p7_quality as P, quality as Q

DOC = "doc_id bigint, text string, lang string, probability double"

#: Written and labelled by hand for these tests; neither trained on nor calibrated on.
PROSE = [
    "> Could you tell me whether the parcel has arrived? I have been\n> waiting since Monday and would like to plan the delivery.\n\nYes, it came this morning.",
    "It was quiet in the reading room.\nNobody had opened the windows since spring, and the dust on\nthe shelves told us that the catalogue had not been used for\na long time.",
    "Bonjour Yara,\n\nEst-ce que vous pouvez m'envoyer le plan avant jeudi ? Il nous manque toujours la dernière page.\n\nCordialement\nNoël",
    "Hola Inés,\n\n¿Puedes revisar el presupuesto otra vez? Creo que falta una factura y no quiero enviarlo así.\n\nSaludos\nBelén",
    "If the import fails again, do not delete anything. Send me the log and tell me which part you were working on.\n\n2025-02-03 10:11:12 WARN retry 1",
    "I still think that we should have kept the smaller printer, since nobody uses the large one.",
]
JUNK = [
    "name;city;amount\nPetra;Kiel;12.50\nUlric;Bonn;8.00\nGreta;Ulm;77.10\nNola;Jena;3.25",
    "From: Petra\nTo: Ulric\nDate: Monday\nSubject: boiler\nSize: 14 KB\nFolder: Inbox",
    "TWFpbGJveCBhcmNoaXZlcyBhcmUgb2xkLCBhbmQgc28gYXJlIHRoZWly\nIGVuY29kaW5ncywgd2hpY2ggaXMgd2h5IHRoaXMgbGluZSBpcyBoZXJl\nQUFBQUFBQUFBQUFBQUFBQUFBQUFBQUFBQUFBQUFBQUFBQUFBQUFBQUFB",
    "the lamp of the desk the lamp of the desk the lamp of the desk the lamp of the desk the lamp of the desk",
    "lamp, desk for Nola, two chairs, green folder, the key of the cellar, 14 x pencil, ruler, old lamp, stapler, glue, 3 x tape",
    "I have added the list.\n\n* folder\n* lamp for Petra\n* two boxes of paper\n* the blue index\n* ruler\n* 15 x envelope\n* green ink",
]


def test_statistics_by_hand():
    d = dict(zip(Q.NAMES, Q.statistics("The lamp, is on.\n\nNo end here", "en"), strict=True))
    assert d["n_words"] == 7 and abs(d["mean_word_length"] - 20 / 7) < 1e-9 and d["punct_line_share"] == 0.5
    assert abs(d["symbol_ratio"] - 2 / 22) < 1e-9 and abs(d["common_word_share"] - 4 / 7) < 1e-9
    assert Q.statistics(None) is None and set(Q.statistics(" \n\t ")) == {0.0} and len(Q.statistics("!!!")) == len(Q.NAMES)


def test_greeting_and_closing_are_set_aside():
    parts, aside = Q.units("Dear Nola,\n\n- lamp\n- ruler\n\nBest wishes\nUlric")
    assert [p[0] for p in parts] == ["bullet", "bullet"] and aside == ["dear", "nola", "best", "wishes", "ulric"]


def test_weak_labels_speak_of_pure_texts_only():
    prose, junk = "I think that we should wait until the lamp is here, because it was late.", "- lamp\n- ruler\n- glue\n- tape\n- two chairs"
    assert Q.weak_label(prose)[0] == 0.0 and Q.weak_label(junk)[0] == 1.0 and Q.weak_label(f"{prose}\n\n{junk}")[0] is None
    assert Q.weak_label("of at the with\nand on is at from\nis or as the of with")[0] == 1.0
    assert [Q.weak_label(t)[0] for t in (None, "", " \n")] == [None] * 3
    made = Q.examples([prose, junk + junk * 3])
    assert [y for _, y in made] == [0.0, 1.0, 1.0] and all(len(x) == len(Q.NAMES) for x, _ in made)
    assert Q.examples([]) == []


def test_trees_learn_and_are_calibrated():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rnd.random(3000) < 0.1)).astype(float)
    m = Q.Boosted().fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    p = m.probability(x[2500:])
    assert ((p > 0.5) == (y[2500:] > 0.5)).mean() > 0.85 and abs(p.mean() - y[2500:].mean()) < 0.05
    constant = Q.Boosted().fit(np.zeros((20, 2)), np.array([0.0, 1.0] * 10))
    assert abs(constant.probability(np.zeros((1, 2)))[0] - 0.5) < 0.01


def test_texts_of_the_tests_by_seeds_alone(spark):
    """Even a corpus without a single example gives a classifier; its rows are the texts of the tests."""
    rows = [(k, t, None, 0.5) for k, t in enumerate([*PROSE, *JUNK])]
    rows += [(9001, None, None, None), (9002, "", None, None), (9003, " \n", "en", None), (None, "The null id is read like any other, I think.", None, None)]
    got = {r.doc_id: r.probability for r in P.scored(spark.createDataFrame(rows, DOC).select("doc_id", "text", "lang", "probability")).collect()}
    assert len(got) == len(rows) and got[9001] is None and got[9002] is None and got[9003] is None and got[None] < 0.5
    right = sum((got[k] > 0.5) == (k >= len(PROSE)) for k in range(len(PROSE) + len(JUNK)))
    assert right >= len(PROSE) + len(JUNK) - 1
    assert P.scored(spark.createDataFrame([], DOC)).count() == 0


def test_held_out_texts(spark):
    """Trained on other texts, calibrated on one half of the checked ones, right on the other."""
    documents = spark.createDataFrame([(k, t, None, None) for k, t in enumerate([*holdout.CHECKED_PROSE, *holdout.CHECKED_JUNK])], DOC)
    x, y = P.held_out(False)
    p = P.trained(documents).probability(x[:, 1:])
    assert len(y) > 20 and ((p > 0.5) == (y > 0.5)).mean() > 0.9
    calibrating, reporting = (set(map(tuple, P.held_out(k)[0])) for k in (True, False))
    assert not calibrating & reporting


def test_statistics_as_expressions(spark):
    texts = [None, "", " \n\t", "One lamp, two chairs.\r\nNo end\r\n\r\n“Done!”  ", "$$ %%", "Grüße aus Köln: ja?", "zzz"]
    documents = spark.createDataFrame([(k, t, "de" if t and "ü" in t else None, None) for k, t in enumerate(texts)], DOC)
    got = {r.doc_id: tuple(r)[1:] for r in P.text_statistics(documents).collect()}
    assert got[0] == (None,) * 5 and got[1] == got[2] == (0, 0.0, 0.0, 0.0, 0.0)
    assert got[3][:2] == (7, 25 / 7) and abs(got[3][3] - 2 / 3) < 1e-9 and got[4][0] == 0 and got[4][2] == 1.0 and got[5][3] == 1.0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, t, "de" if t and "ü" in t else None) for k, t in enumerate(texts)])
    for row in con.execute(P.SQL["p7_text_statistics"]).fetchall():
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(row[1:], got[row[0]], strict=True)), row


def test_long_and_odd_texts():
    for text in ("x" * 300_000, "word " * 100_000, "\n" * 100_000, "a|b\t;" * 50_000, "\ud800", "💾" * 1000):
        assert len(Q.statistics(text)) == len(Q.NAMES)
        Q.weak_label(text)
