"""Leaks, mixtures and residue."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from screeline.llm import queries, residue
from screeline.llm.hashed import codes
from screeline.llm.linear import Rows, fit
from screeline.llm.leakage import ItemIndex, LeakRule, find_leaks, leaks
from screeline.llm.mixture import draw, drawn_report, mixture_plan, plan_report, rake
from screeline.llm.tokens import with_tokens
from screeline.llm.topics import DIMS, k_means, learn_topics, packed_words

ITEM = "Skipping the ramp at Zemnulork Point means tilted bergschrund, followed by seventy metres of drained ground facing Brypith Tower in slush before noon."
WORDS = ITEM.split()


def found(text, rule=LeakRule()):
    return bool(leaks(ItemIndex([(1, ITEM)], rule), [5], [text]))


AROUND = "We left early and the weather held for most of the day. {} Nobody else was about and we were home by dark."


@pytest.mark.parametrize("start", [0, 3, 7, len(WORDS) - 12])
def test_twelve_words_leak_and_ten_do_not(start):
    assert found(AROUND.format(" ".join(WORDS[start : start + 12])))
    assert not found(AROUND.format(" ".join(WORDS[start : start + 10])))


@pytest.mark.parametrize(
    "change",
    [
        str.upper,
        lambda t: t.replace(" ", "  ").replace(",", ""),
        lambda t: t.replace("bergschrund", "berg-\n> schrund").replace("metres", "met­res"),
        lambda t: "> " + t.replace("ground", "<b>ground</b>").replace("ramp", "*ramp*").replace(" in ", "​ in&nbsp;"),
        lambda t: t.replace("tilted", "t ilted").replace("drained ground", "drainedground"),
        lambda t: "\n".join("| " + w for w in t.split(" ")),
    ],
)
def test_appearance_is_ignored(change):
    assert found(AROUND.format(change(ITEM)))


def test_edits_within_and_beyond_the_budget():
    w = list(WORDS)
    for i in (3, 9, 15):
        w[i] = "other"
    assert found(AROUND.format(" ".join(w)))
    assert found(AROUND.format(" ".join(x for i, x in enumerate(WORDS) if i not in (4, 11))))
    assert found(AROUND.format(" ".join(x + " really" if i in (5, 14) else x for i, x in enumerate(WORDS))))
    assert not found(AROUND.format(" ".join("other" if i % 4 == 2 else x for i, x in enumerate(WORDS))))
    assert not found(AROUND.format(" ".join(WORDS[::-1])))


def test_passages_may_begin_with_a_short_word():
    w = WORDS[WORDS.index("at") :][:13]
    assert len(w) == 13 and not found(AROUND.format(" ".join(w[2:])))
    assert found(AROUND.format(" ".join([w[0], "other", *w[2:]])))


def test_three_edits_in_the_middle_of_eighteen_words():
    item = "on the way to a top we Zemnulorkstone then Brypithtower and Kolvaristeep so up to it at last".split()
    text = AROUND.format(" ".join("other" if len(w) > 9 else w for w in item))
    assert sum(len(w) > 9 for w in item) == 3
    assert leaks(ItemIndex([(1, " ".join(item))], LeakRule()), [5], [text]) == [(5, 1, 18, 3)]


def test_filter_keeps_all_that_alignment_accepts():
    """Random passages with edits: whatever a filter that passes everything lets through."""
    rng = np.random.default_rng(0)
    loose = ItemIndex([(1, ITEM)], LeakRule())
    loose.least[:] = 1
    loose.windows = [(lo, hi, np.ones_like(k)) for lo, hi, k in loose.windows]
    strict = ItemIndex([(1, ITEM)], LeakRule())
    texts = []
    for _ in range(300):
        n = int(rng.integers(8, len(WORDS) + 1))
        s = int(rng.integers(0, len(WORDS) - n + 1))
        w = [("x" * int(rng.integers(1, 9))) if rng.random() < 0.12 else x for x in WORDS[s : s + n] if rng.random() > 0.05]
        texts.append(AROUND.format(" ".join(w)))
    ids = list(range(300))
    assert {d for d, *_ in leaks(strict, ids, texts)} == {d for d, *_ in leaks(loose, ids, texts)}


def test_leaks_of_tables(spark):
    long = "word " * 40_000 + ITEM + " word" * 1000
    docs = spark.createDataFrame([(1, AROUND.format(ITEM), "x"), (2, None, ""), (3, "", ""), (4, long, ""), (1, AROUND.format(ITEM), "x"), (None, ITEM, ""), (5, "nothing here", "")], "doc_id long, text string, d string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, ITEM), (7, ITEM)], "item_id long, item_text string")
    for block in (8_000_000, 100):
        got = {(r.doc_id, r.item_id): (r.words, r.edits) for r in find_leaks(docs, items, block_chars=block).collect()}
        assert set(got) == {(1, 7), (1, 10), (4, 7), (4, 10)} and got[(4, 7)] == (len(WORDS), 0)
    assert find_leaks(docs.limit(0), items).count() == find_leaks(docs, items.limit(0)).count() == 0


def test_raking_meets_shares_and_caps():
    cells = [{"source": s, "lang": la, "topic": "t", "tokens": n} for s, la, n in (("a", "en", 1000), ("a", "de", 500), ("b", "en", 300), ("c", "en", 50), ("d", "en", 0))]
    shares, repeats = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 2.0, "b": 3.0, "c": 2.0, "d": 1.0}
    w = rake(cells, shares, repeats, 1000.0)
    have = {s: sum(x * c["tokens"] for x, c in zip(w, cells) if c["source"] == s) for s in shares}
    assert have["c"] == pytest.approx(100) and have["a"] / have["b"] == pytest.approx(5 / 3) and sum(have.values()) == pytest.approx(1000)
    assert all(x <= repeats[c["source"]] + 1e-9 for x, c in zip(w, cells))
    assert rake([], {}, {}, 10.0).size == 0


def mixed(spark, n=3000):
    rng = np.random.default_rng(0)
    rows = [(i, "snow on the ridge " * int(rng.integers(2, 30)), str(rng.choice(["a", " A ", "b", "b c", "other", None], p=[0.4, 0.1, 0.2, 0.05, 0.2, 0.05])), str(rng.choice(["en", "EN ", "de"]))) for i in range(n)]
    rows = [(i, t, None if s == "None" else s, la) for i, t, s, la in rows] + [(n, None, "a", None), (n + 1, "", "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return docs, spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("b_c", 0.1, 4), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")


def test_mixture_reaches_its_shares(spark):
    docs, target = mixed(spark)
    counted, plan = mixture_plan(docs, target)
    report = {r.source: r for r in drawn_report(counted, plan).collect()}
    assert not report["none"].reachable and report["a"].reachable and report["b"].reachable
    assert all(r.actual_share == pytest.approx(r.planned_share, abs=0.01) and r.most_repeats <= r.max_repeats for r in report.values())
    assert report["a"].actual_share == pytest.approx(report["b"].actual_share, abs=0.01)
    again, twice = (draw(counted, plan).orderBy("doc").collect() for _ in range(2))
    assert again == twice and all(r.repeats >= 1 for r in again)


def test_mixture_of_nothing(spark):
    docs, target = mixed(spark, 20)
    counted, plan = mixture_plan(docs.limit(0), target)
    assert draw(counted, plan).count() == 0 and drawn_report(counted, plan).count() == 4
    _, plan = mixture_plan(docs, target.limit(0))
    assert plan_report(spark, plan).count() == 0


def test_raking_says_when_it_does_not_settle():
    cells = [{"source": s, "lang": la, "topic": t, "tokens": n} for s, la, t, n in (("a", "x", "p", 90), ("a", "y", "q", 10), ("b", "x", "q", 40), ("b", "y", "p", 60))]
    with pytest.raises(RuntimeError):
        rake(cells, {"a": 0.3, "b": 0.7}, {"a": 9.0, "b": 9.0}, 200.0, rounds=1)
    w = rake(cells, {"a": 0.3, "b": 0.7}, {"a": 9.0, "b": 9.0}, 200.0)
    assert sum(x * c["tokens"] for x, c in zip(w, cells) if c["source"] == "a") == pytest.approx(60)


def test_topics_part_texts_by_their_words():
    rng = np.random.default_rng(0)
    kinds = [["snow", "ice", "frost", "wind", "storm", "cornice"], ["boots", "rope", "stove", "shell", "helmet", "gloves"], ["bus", "road", "gate", "permit", "parking", "crew"]]
    texts = [" ".join(rng.choice(kinds[i % 3], 5)) + " and the" for i in range(120)]
    topics = k_means(texts, 3)
    got = topics.of([*texts, None, "", "??"])
    assert len({got[i] for i in range(3)}) == 3 and all(got[i] == got[i % 3] for i in range(120)) and got[120:] == ["none"] * 3
    assert k_means([], 3).of(["snow"]) == ["none"] and len(set(k_means(["same words"] * 9, 3).of(["same words"]))) == 1


def test_topics_are_those_of_all_texts(spark):
    """Each text's centre, the mean of all texts of its topic, is the nearest."""
    rng = np.random.default_rng(0)
    kinds = [[a + b for b in ("al", "en", "is", "or", "un", "ath", "eck", "ill")] for a in "bcdfgk"]
    rows = [(i, " ".join([*rng.choice(kinds[i % 6], 4), *rng.choice(kinds[int(rng.integers(6))], 3)]), "en", "a") for i in range(6_000)]
    rows += [(20_000 + i, rows[0][1], "en", "a") for i in range(1_500)] + [(30_000, None, "en", "a"), (30_001, "??", "en", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    target = spark.createDataFrame([("a", 1.0, 2.0)], "source string, target_share double, max_repeats double")
    one = {r.doc: r.topic for r in mixture_plan(d.repartition(7), target)[0].collect()}
    assert one.pop(30_000) == one.pop(30_001) == "none" and len(one) == 7_500
    known = {w: i for i, w in enumerate(sorted({w for k in kinds for w in k}))}
    assert len(set(codes(list(known)) % DIMS)) == len(known)
    x = np.zeros((7_500, len(known)))
    for i, (_, text, *_) in enumerate(rows[:7_500]):
        x[i, [known[w] for w in text.split()]] = 1
    x *= np.log(7_501 / x.sum(0))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    topic = np.array([one[i] for i, *_ in rows[:7_500]])
    names = sorted(set(topic))
    centres = np.array([x[topic == t].mean(0) for t in names])
    near = x @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T
    assert len(names) == 8 and (near[np.arange(7_500), np.searchsorted(names, topic)] >= near.max(1) - 1e-6).all()
    assert len(set(topic[6_000:])) == 1


def test_topics_of_a_table_are_those_of_a_list(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["snow", "ice", "rope", "bus", "gate", "mud", "fox", "hut"], 3)) for _ in range(300)] + [None, "", "snow " * 40_000]
    table = spark.createDataFrame([(w,) for w in packed_words(texts)], "words binary")
    want = k_means(texts, 4)
    assert len(want.centres) == 4 and all(np.array_equal(want.centres, learn_topics(table.repartition(n), "words", 4).centres) for n in (1, 5))
    assert learn_topics(table.limit(0), "words", 4).of(["snow"]) == ["none"]
    assert want.of(["rope snow"]) == want.of(["rope rope rope snow"])
    with pytest.raises(RuntimeError):
        k_means(texts, 4, rounds=1)


def test_reachable_is_read_from_the_raked_weights(spark):
    d = spark.createDataFrame([(i, "word " * 10, "en", "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, lang string, source string")
    for repeats, reached in ((2.0, False), (4.0, True)):
        target = spark.createDataFrame([("a", 0.7, 1.0), ("b", 0.3, repeats)], "source string, target_share double, max_repeats double")
        _, plan = mixture_plan(d, target)
        rows = {r.source: r for r in plan_report(spark, plan).collect()}
        assert rows["a"].reachable and rows["b"].reachable is reached and rows["b"].planned_tokens == pytest.approx(min(1, repeats / 3) * 0.3 * plan.size)
        assert {m["margin"] for m in plan.margins} == {"lang", "topic"}


def test_tokens(spark):
    d = spark.createDataFrame([("the ridge", "x"), (None, "y"), ("", "z"), ("<|endoftext|>" + "a" * 100_000, "w")], "text string, `_text` string")
    t = {r["_text"]: r.tokens for r in with_tokens(d, "text", ["_text"]).collect()}
    assert t["x"] == 2 and t["y"] == t["z"] == 0 and t["w"] > 100
    with pytest.raises(FileNotFoundError):
        with_tokens(d, "text", [], "/nowhere")


FIELDS = ["{{name}}", "{{ a.b_c }}", "${NAME}", "#{name_x}", "$page.name$", "<%= page.name %>", "{% if name %}", "%(name)s", "%%NAME%%", "@@NAME_X@@", "__NAME__", "[[name_x]]", "{name_x}", "[INSERT NAME HERE]", "[NAME GOES\nHERE]", "[your name here]", "(add name here)", "<your name>", "<START NAME>", "&lt;your name&gt;", "«start name»: to be filled in"]
NO_FIELDS = ["{A}, {B} and {C}", "{3,450}", "30% to 40% and 5%", "[Edit: open again]", "<b>of</b>", "<B>OF</B><BR>", "$12 for 3 <5 km", "(seen in early June)", "Date: TBD by the leader", "«bonjour» dit-il", "a_b and __", ">> quoted", "x = {1, 2}"]


LONG = "the name of the place where your party left the cars, with the road that leads there and the hour of the start"


def test_spots_end_at_their_delimiters():
    whole = [f"{{% if {LONG} %}}", f"<%= {LONG} %>", f"[insert {LONG} here]", f"<your {LONG}>", f"«{LONG}»", f"(add {LONG} here)", "{{ a.b }}", "${X_Y}", "%(x_y)s", "$a.b_c$", "%%X%%", "@@x_y@@", "__x_y__", "[[x]]", "#{x}"]
    for s in whole:
        assert residue.spots(f"Turn left at the {s} and go on.") == [s], s
    assert residue.spots("(seen [ROUTE NAME GOES HERE] in May)") == ["(seen [ROUTE NAME GOES HERE] in May)", "[ROUTE NAME GOES HERE]"]
    for s in (f"<your {LONG}", "30% to 18%, a $40 permit, <10 cars", "snake_case_name and a*b*c", "> quoted", f"«{LONG}"):
        assert residue.spots(f"Turn left at the {s} and go on") == [], s
    for hostile in ("{" * 200_000, "<" * 200_000, "_a" * 100_000, "__" + "a_" * 100_000, "(" * 200_000 + "x", "[" * 100_000 + "(" * 100_000, "%" * 200_000):
        assert isinstance(residue.spots(hostile), list)  # in linear time


def test_weak_labels():
    family = lambda t: residue.text_family(t, *residue.words_of(t)[1:])
    assert family("HTTP Error 503. Try again.") == "status" and family("Please enable JavaScript now.") == "script" and family("ha ha ha ha ha ha ha ha ha") == "repeats"
    assert family("I write JavaScript tools") is None and family("") is None and family("Snow on top") is None
    assert family("We climbed the ridge in snow and waited there at a lake for our partner") == "content"
    assert family("We climbed the ridge in snow and waited there at a {{lake}} for our partner") is None
    got = [residue.spot_family(s) for s in ("{{x}}", "[INSERT A B HERE]", "<b>", "(in snow)", "{3,4}", "[Edit: again]", "@@xy@@", "(put it here)")]
    assert got == ["double braces", "insert here", "content", "content", "content", "content", None, "round here"]


def test_text_features_are_those_of_each_text():
    texts = ["We saw 2 foxes. We saw.", "", "Snow", "a\nb c"]
    together = residue.text_features(texts)
    assert len(together) == 4 and together.begin.tolist() == [0, 18, 25, 33, 45]
    for i, t in enumerate(texts):
        alone = residue.text_features([t])
        assert alone.features.tolist() == together.features[together.begin[i] : together.begin[i + 1]].tolist()


def test_linear_fit_reaches_the_minimum():
    rng = np.random.default_rng(0)
    rows = Rows.of([rng.integers(0, 40, rng.integers(1, 9)) for _ in range(300)])
    label = (rng.random(300) < 0.3).astype(float)
    m = fit(rows, label, 64, penalty=1e-2, prior=0.25)
    x = np.zeros((300, 64))
    for i in range(300):
        np.add.at(x[i], rows.features[rows.begin[i] : rows.begin[i + 1]], 1 / np.sqrt(rows.begin[i + 1] - rows.begin[i]))
    share = np.where(label == 1, 0.25 / label.sum(), 0.75 / (1 - label).sum())
    chance = 1 / (1 + np.exp(-(x @ m.weights + m.bias)))
    assert np.abs(x.T @ (share * (chance - label)) + 1e-2 * m.weights).max() < 1e-5 and abs((share * (chance - label)).sum()) < 1e-5
    assert np.allclose(m.scores(rows), x @ m.weights + m.bias, atol=1e-5) and m.slope < 1e-6
    with pytest.raises(RuntimeError):
        fit(rows, label, 64, rounds=1)


def test_styles_without_a_label_are_found(spark):
    """The labels know ten styles of fields; these nine they don't."""
    styles = ["$route.{}$", "%%{}%%", "@@{}@@", "__{}__", "[[{}]]", "#{{{}}}", "[{} goes here]", "[your {} here]", "«{}»: to be filled in"]
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").filter("text is not null")
    plain = d.filter(~F.col("text").rlike(r"[{}\[\]<>«@#$%_*(]")).orderBy("doc_id").limit(90).select("text").collect()
    rows = [(10_000 + i, r["text"] + " We met at the " + styles[i % 9].format("start_name") + " then.", "h") for i, r in enumerate(plain)]
    both = d.select("doc_id", "text", "route_id").unionByName(spark.createDataFrame(rows, "doc_id long, text string, route_id string"))
    got = {r.doc_id for r in residue.find_residue(both).filter("doc_id >= 10000 and field").collect()}
    assert len(got) >= 0.9 * len(rows) and len({i % 9 for i in got}) == 9


def texts(spark, extra):
    rng = np.random.default_rng(0)
    vocabulary = "snow ridge climbed fox lake turned early mud north boots helmet slow windy gully notch rope partner waited summit cloud we the at in and".split()
    vocabulary += [a + b for a in ("gran", "tor", "bel", "mun", "skar", "rill", "fen") for b in ("ite", "vik", "horn", "dale", "beck", "stone", "lake", "moor")]
    sentence = lambda: " ".join(rng.choice(vocabulary, int(rng.integers(7, 15)), replace=False)).capitalize() + "."
    rows = [(i, " ".join(sentence() for _ in range(int(rng.integers(2, 7)))), f"h{i % 40}") for i in range(400)]
    bad = ["404 - the page you asked for could not be found.", "Please enable JavaScript to view the map.", "lorem ipsum dolor sit amet " * 5, "xxx " * 12, "HTTP Error 503. The service is unavailable."]
    marks = ["{{lake}}", "<b>", "${NOTCH_NAME}", "(in snow)", "[INSERT ROPE HERE]", "(early)", "{% if rope %}", "[Edit: open again]", "<%= page.fox %>", "{3,4}"]
    rows += [(3000 + i, " ".join(sentence() for _ in range(3)) + " " + marks[i % 10] + " " + sentence(), f"h{i % 40}") for i in range(100)]
    rows += [(1000 + i, bad[i % 5] + (f"\nBack to the start page {i}" if i % 2 else ""), f"h{i % 40}") for i in range(100)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, route_id string"), rows


def test_residue_is_found_and_mentions_are_not(spark):
    story = "We climbed the ridge in snow and waited at the lake. The booking page answered with a 404 the night before, so my partner called. Boots helped on the mud north of the notch and the fox turned early at the summit cloud."
    extra = [(2000, story, "h1"), (2001, story + " Meet at {{trail_head}} then.", "h2"), (2002, None, "h1"), (2003, "", None), (2004, "Bitte JavaScript aktivieren, error 404.", None), (2005, "a " * 5000, "h9")]
    d, rows = texts(spark, extra)
    got = {r.doc_id: r.field for r in residue.find_residue(d.withColumn("label", F.lit("x"))).collect()}
    assert {i for i, *_ in rows if 1000 <= i < 2000 or i >= 3000 and i % 2 == 0} | {2001, 2004} <= set(got) and not {i for i, *_ in rows if i < 1000 or i >= 3000 and i % 2} & set(got)
    assert got[2001] and not {2000, 2002, 2003} & set(got)
    assert residue.find_residue(d.limit(0)).count() == 0 and residue.find_residue(d.filter("doc_id < 50")).count() == 0
    for r in residue.validate(d).collect():
        assert r.agreed >= 0.95 * r["rows"]


@pytest.mark.parametrize("name", ["p2_clusters", "p4_found", "p5_splits", "p6_found", "p7_found", "p8_report", "p8_margins", "p9_validation"])
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
