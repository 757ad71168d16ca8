"""Rules of the retrieval and answer operators on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import answer, chunking, dataset, evaluate, forum, html, intent, ranking, routing, vector
from quillmark.sources import store
from quillmark.streaming.feedback import helpfulness


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_sentences_and_tokens(spark):
    assert one(spark, T.sentences(F.lit(" A b.  C d! e "))) == ["A b.", "C d!", "e"]
    assert one(spark, T.token_set(F.lit("The Élan of élan, is x9z"))) == ["élan", "x9z"]
    assert one(spark, T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0


def test_clean_and_truncate(spark):
    assert one(spark, T.clean_comment(F.lit("see [x](http://y)\n\n\n\nz &amp;lt; cr Edit: gone\nkept "))) == "see x\n\nz < cr \nkept"
    assert one(spark, T.truncated(F.lit("ab. cd"), 4)) == "ab."
    assert one(spark, T.truncated(F.lit("abcdef"), 4)) == "abcd."
    assert one(spark, T.quoted(F.lit("C++ & (x)/é"))) == "C%2B%2B_%26_%28x%29/%C3%A9"


def words(n, end="."):
    return " ".join(["w"] * n) + end


def test_chunks(spark):
    def cut(t):
        df = spark.createDataFrame([(1, t)], "k int, text string")
        rows = chunking.chunks(df, F.lit("t"), F.lit("s")).orderBy("chunk_index").collect()
        assert all(r.word_count == len(r.text.split()) and r.total_chunks == len(rows) for r in rows)
        return [r.word_count for r in rows]

    assert cut("") == [] and cut(words(49)) == [] and cut(words(50)) == [50]
    assert cut(words(300)) == [300]
    assert cut(" ".join([words(60)] * 5)) == [180, 180]
    assert cut(words(30) + " " + words(200)) == [200] and cut(None) == []


def test_chunk_bounds_follow_the_plain_rule():
    def plain(counts, target, overlap, least):
        out, cur = [], []
        for i, n in enumerate(counts):
            if cur and sum(counts[c] for c in cur) + n > target:
                held = sum(counts[c] for c in cur)
                if held >= least:
                    out.append((cur[0], i, held))
                keep = []
                if held >= overlap:
                    while sum(counts[c] for c in keep) < overlap:
                        keep.insert(0, cur.pop())
                cur = keep
            cur.append(i)
        held = sum(counts[c] for c in cur)
        return out + ([(cur[0], len(counts), held)] if held >= least else [])

    r = random.Random(3)
    for _ in range(500):
        counts = [r.choice((1, 3, 8, 20, 60, 250)) for _ in range(r.randint(0, 60))]
        for sizes in ((200, 50, 50), (20, 5, 10), (30, 0, 1)):
            assert chunking.bounds(counts, *sizes) == plain(counts, *sizes)


def test_vector_search(spark):
    index = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r.vec_id for r in vector.top_k(index, q, 9).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.vec_id for r in vector.mmr(index, q, 2, weight=1.0).orderBy("rank").collect()] == [0, 1]


def test_vector_search_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "INDEX_BLOCK", 7, raising=False)
    r = random.Random(5)
    rows = [(i, [float(r.randint(-4, 4)) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0])]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = index.where("vec_id % 2 = 0 and vec_id < 60").selectExpr("vec_id as query_id", "embedding as query")
    full = {i: v for i, v in rows if i < 60}
    dots = {i: sorted((-sum(a * b for a, b in zip(full[i], v)), j) for j, v in full.items()) for i in range(0, 60, 2)}
    want = {(i, k + 1, j) for i, d in dots.items() for k, (_, j) in enumerate(d[:3])}
    assert {(r.query_id, r.rank, r.vec_id) for r in vector.top_k(index, q, 3, floor=-99.0).collect()} == want
    assert {(r.query_id, r.rank, r.vec_id) for r in vector.mmr(index, q, 3, weight=1.0, floor=-99.0).collect()} == want


def test_scores(spark):
    assert abs(one(spark, ranking.comment_quality(F.lit(0), F.lit(60), F.lit(9), F.lit(True))) - 10.0) < 1e-9
    assert one(spark, ranking.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2


def test_routing(spark):
    assert one(spark, routing.expanded(F.lit("q"), F.lit("verify"))) == ["q", "q myth misconception", "q scientific evidence"]
    assert one(spark, routing.sources(F.lit("fact"))) == ["article", "forum"]
    assert one(spark, routing.sources(F.lit("other"))) == []
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (1, "c", 0.1)], "k int, label string, p double")
    assert tuple(routing.prediction(p, "k").first()) == (1, "a", 0.5, True, {"a": 0.5, "b": 0.4, "c": 0.1})
    assert one(spark, routing.forums(F.lit(None).cast("string"))) == one(spark, routing.forums(F.lit("other"))) == list(routing.FORUMS["fact"][:3])
    assert tuple(one(spark, routing.overridden(F.lit("FACT"), F.lit("x"), F.lit(0.2)))) == ("fact", 1.0, True)
    assert tuple(one(spark, routing.overridden(F.lit(None).cast("string"), F.lit("x"), F.lit(0.2)))) == ("x", 0.2, False)
    errors = [one(spark, routing.request_errors(F.lit(q).cast("string"), F.lit(k).cast("int"))) for q, k in (("ab", 0), ("abc", 20), ("x" * 501, 21), (None, None))]
    assert errors == [["query", "top_k"], [], ["query", "top_k"], ["query"]]


def test_dedup_order(spark):
    rows = [(1, 0, "a b c d", 0.2), (1, 1, "x y z", 0.5), (1, 2, "a b c d", 0.9), (1, 3, "a b c d", 0.1)]
    df = spark.createDataFrame(rows, "g int, ord int, text string, relevance double")
    assert [r.sent_ord for r in answer.deduplicated(df, "g", "ord").orderBy("pos").collect()] == [1, 2]


def test_groups_beyond_the_bound_are_errors(spark, monkeypatch):
    monkeypatch.setattr(answer, "MOST", 3)
    df = spark.range(4).selectExpr("1 as g", "id as ord", "'a b c' as text", "1.0D as relevance", "0.0D as position")
    for f in (lambda d: answer.deduplicated(d, "g", "ord"), lambda d: answer.textrank(d, "g", "ord", F.lit("a"))):
        assert f(df.where("ord < 3")).count() > 0
        with pytest.raises(Exception, match="more sentences than 3"):
            f(df).collect()


def test_textrank_against_plain_iteration(spark):
    texts = ["alpha beta gamma", "beta gamma delta", "delta epsilon zeta", "alpha zeta omega"]
    df = spark.createDataFrame([(1, i, t, 1.0, i / 4) for i, t in enumerate(texts)], "g int, ord int, text string, relevance double, position double")
    sets = [set(t.split()) for t in texts]
    sim = [[0 if i == j else len(a & b) / len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    s = [0.25] * 4
    for _ in range(30):
        s = [0.15 / 4 + 0.85 * sum(sim[j][i] / sum(sim[j]) * s[j] for j in range(4) if sum(sim[j])) for i in range(4)]
    want = [s[i] + 0.3 * len(sets[i] & {"omega"}) + 0.1 * (1 - i / 4) for i in range(4)]
    got = {r.sent_ord: r.score for r in answer.textrank(df, "g", "ord", F.lit("omega"), top=4).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(4))


def test_html_sections(spark):
    page = (
        "<p>lead text that is long enough</p><h2><span class='mw-headline'>One</span><span>[edit]</span></h2>"
        "<p>a paragraph with<sup>[1]</sup> enough  words [2]<p>unclosed but long enough text"
        "<h3>See also</h3><p>skipped paragraph, long enough</p><h4>Empty</h4><p>short</p>"
        "<h2>Two</h2><ul><li>first item long</li><li>x</li><li>outer item<ol><li>inner item, long</li></ol></li></ul>"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "<h2>T</h2>" + "<ul>" + "".join(f"<li>list item no {i}</li>" for i in range(14)) + "</ul>")], "page_id int, html string")
    got = [(r.page_id, r.title, r.level, r.ref_level, r.content) for r in html.sections(df, "page_id").orderBy("page_id", "section").collect()]
    assert got[:2] == [
        (1, "One", 2, 3, "a paragraph with enough words  unclosed but long enough text"),
        (1, "Two", 2, 2, "• first item long • outer iteminner item, long • inner item, long • inner item, long"),
    ]
    assert len(got) == 3 and got[2][4].count("•") == 10  # the first ten items


def test_references_without_semicolon(spark):
    page = "<h1>a &amp; b&amp</h1><p>x&ampy; &lt &#38; &#38 &quo; & &copy;&amp;amp; \ue000 long enough</p>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    rows = [html.sections(df, "page_id", ("h1",), *more).first() for more in ((), (False,))]
    assert [(r.title, r.content) for r in rows] == [
        ("a & b&", "x&y; < & & &quo; & ©&amp; \ue000 long enough"),
        ("a & b&amp", "x&ampy; &lt & &#38 &quo; & ©&amp; \ue000 long enough"),
    ]
    cut_short = "<h1>t&amp</h1><p>a text that is long enough</p>"  # as the pages of sf0.1 have it
    assert [html.parsed(cut_short, unended=u)["text"] for u in (True, False)] == ["t&a text that is long enough", "t&ampa text that is long enough"]


def test_articles_keep_unended_references(spark):
    df = spark.createDataFrame([(1, "<h1>t&amp</h1><p>a text that is long &lt enough</p>")], "page_id int, html string")
    got = [html.articles(df, "page_id", ("h1",), u).first().sections[0] for u in (True, False)]
    assert [(s.title, s.content) for s in got] == [("t&", "a text that is long < enough"), ("t&amp", "a text that is long &lt enough")]


def test_html_facts(spark):
    page = '<table class="x infobox"><tr><th>A</th><td>1</td></tr><tr><th>A</th><td> 2<b>3</b>[4]</td></tr><tr><th>B</th><td> </td></tr><tr><td>no header</td></tr></table><table class="infobox"><tr><th>C</th><td>c</td></tr></table>'
    refs = '<ol><li>x</li></ol><ol class="references"><li>a<ul><li>b</li></ul></li><li>c</li></ol><ol class="references"><li>d</li></ol><div class="dmbox y"></div>'
    df = spark.createDataFrame([(1, page), (2, refs), (3, '<table id="disambig"></table>'), (4, None)], "page_id int, html string")
    got = {r.page_id: (r.infobox, r.n_references, r.disambiguation) for r in html.facts(df, "page_id").collect()}
    assert got == {1: ({"A": "23"}, 0, False), 2: ({}, 3, True), 3: ({}, 0, True), 4: ({}, 0, False)}
    assert [r[0] for r in df.limit(1).select(html.stripped(F.lit("a <b>b</b> &amp; <i>c</i>"))).collect()] == ["a b & c"]
    a = {r.page_id: r for r in html.articles(df, "page_id").collect()}
    assert a[1].sections is None and a[1].total_word_count == 0 and a[2].n_references == 3


def test_cache_and_feedback(spark, tmp_path):
    cache = spark.createDataFrame([("k", 1.0, "old")], "key string, fetched_at double, data string")
    new = spark.createDataFrame([("k", 5.0, "new")], "key string, fetched_at double, data string")
    assert store.upsert(cache, new).first().data == "new"
    wanted = spark.createDataFrame([("k",)], "key string")
    assert store.cache_lookup(wanted, cache, F.lit(86_401.0)).first().data is None
    rows = spark.createDataFrame([("q", True, None, 10.0), ("q", False, "fact", 20.0)], store.FEEDBACK)
    store.record_feedback(rows, str(tmp_path / "log"))
    q = helpfulness(store.feedback_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("fb").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.helpful) for r in spark.table("fb").collect()] == [(2, 1)]


def test_stratified_folds_deal_out_each_label(spark):
    rows = [(i, "hot") for i in range(503)] + [(1000 + i, "rare") for i in range(5)] + [(2000 + i, None) for i in range(7)]
    got = intent.stratified(spark.createDataFrame(rows, "id long, label string"), "id", "label").collect()
    assert sorted(r.id for r in got) == [i for i, _ in rows]
    for label in ("hot", "rare", None):
        n = [sum(r.fold == k and r.label == label for r in got) for k in range(5)]
        assert sum(n) == sum(x == label for _, x in rows) and max(n) - min(n) <= 1


def test_training(spark):
    rows = [(f"how to cook {w} well", "advice") for w in "abcdef"] + [(f"when did the {w} war begin", "history") for w in "abcdef"]
    df = spark.createDataFrame(rows, "text string, label string")
    m = intent.training_pipeline(10).fit(intent.balanced(df))
    assert [s.__class__.__name__ for s in m.stages].count("LogCounts") == 1
    assert m.transform(df).where("prediction = target").count() == 12
    assert one(spark, intent.soft_vote([F.array(F.lit(1.0)), F.array(F.lit(0.0)), F.array(F.lit(0.0))], [2, 1, 1])) == [0.5]


def test_fill_templates(spark):
    t = spark.createDataFrame([(1, "a", "{x_a} and {x_b}, {place} {none}"), (2, "b", None), (3, "b", "")], "template_id int, label string, template string")
    got = [(r.template_id, r.text) for r in dataset.fill(t, {"x": ["p", "q"], "place": ["Rome"]}, 40).collect()]
    assert {x for i, x in got if i == 1} == {f"{a} and {b}, Rome {{none}}" for a in "pq" for b in "pq"}
    assert [x for i, x in got if i > 1] == [None] * 40 + [""] * 40


def test_noise(spark):
    assert one(spark, dataset.swapped(F.lit("abcd"), F.lit(2))) == "abdc"
    assert one(spark, dataset.swapped(F.lit("abcd"), F.lit(1))) == "acbd"
    e = spark.range(600).selectExpr("id", "'Some four words Here' as text", "'l' as label", "'template' as source", "1.0D as confidence")
    rows = dataset.augment(e, "id").where("source = 'augmented'").collect()
    assert 130 < len(rows) < 230 and {r.confidence for r in rows} == {0.9}
    texts = {r.text for r in rows}
    assert {"some four words here", "SOME FOUR WORDS HERE", "Some words Here", "Some four Here", "Some four words"} <= texts
    assert all(t[0] in "Ss" and sorted(t.lower()) == sorted("some four words here") for t in texts if len(t) == 20)
    short = spark.createDataFrame([(i, t) for i in range(30) for t in ("", "ab", None)], "id int, text string").select("id", "text", dataset.noisy(F.col("text"), F.col("id")).alias("x"))
    assert all((r.x or "").lower() == (r.text or "") for r in short.collect())


def test_case_changes_letter_by_letter(spark):
    assert one(spark, dataset.uppered(F.lit("Größe ŉ ᾳ ﬁ 😀\nç"))) == "GRÖẞE ŉ ᾼ ﬁ 😀\nÇ"
    assert one(spark, dataset.lowered(F.lit("İST ΟΔΟΣ 😀"))) == "ist οδοσ 😀"
    assert [one(spark, f(F.lit(t))) for f in (dataset.uppered, dataset.lowered) for t in ("", None)] == ["", None] * 2
    e = spark.createDataFrame([(i, "Maß und Fuß", "l", "template", 1.0) for i in range(60)], "id int, text string, label string, source string, confidence double")
    assert "MAẞ UND FUẞ" in {r.text for r in dataset.augment(e, "id", 1.0).collect()}


def test_append_manual(spark):
    e = spark.createDataFrame([], dataset.EXAMPLE)
    assert [tuple(r) for r in dataset.append_manual(e, [("q", "fact")]).collect()] == [("q", "fact", "manual", 1.0)]


def test_key_points(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(["The monkey ran.", "The KEY thing. " + "x" * 150, "So, as a result, yes.", "Overall"])], "g int, ord int, text string")
    assert [r.point for r in answer.key_points(d, "g", "ord").orderBy("ord").collect()] == ["The KEY thing.", "So, as a result, yes.", "Overall"]


def test_formatted_and_complete(spark):
    rows = [(1, i, f"S{i}.", "advice", "t", 1.0) for i in (1, 2)] + [(2, i, f"S{i}.", "odd", "t" if i < 6 else "u", 1.0) for i in range(1, 7)] + [(3, 1, "a myth it is", "verify", "t", 1.0)]
    d = spark.createDataFrame(rows, "q int, ord int, text string, mode string, title string, relevance double")
    got = {r.q: r.answer for r in answer.formatted(d, "q", "ord").collect()}
    assert got[1] == answer.INTRO["advice"] + "\n• S1.\n• S2." + answer.NOTE
    assert got[2] == "S1. S2. S3. S4.\n\nS5.\n\nS6."
    assert got[3].startswith("**Verdict: " + answer.VERDICTS["FALSE"] + "**\n\n" + answer.INTRO["verify"])
    cited = spark.createDataFrame([(2, 2, "B", "v", "forum"), (2, 1, "A", "u", "article")], "q int, citation int, title string, url string, source string")
    full = answer.complete(spark.createDataFrame([(2,), (9,)], "q int"), answer.formatted(d, "q", "ord").withColumn("confidence", F.lit(0.5)), answer.footer(cited, "q"), "q")
    out = {r.q: (r.answer, r.confidence) for r in full.collect()}
    assert out[9] == (answer.NO_RESULT, 0.0)
    assert out[2] == (got[2] + answer.FOOTER + "  [1] 📖 A\n      u\n  [2] 💬 B\n      v\n", 0.5)


def test_sentence_rows(spark):
    d = spark.createDataFrame([(1, "A b c. One two three four five. Six.")], "g int, text string")
    assert [(r.sentence, round(r.position, 3)) for r in answer.sentence_rows(d, T.sentences(F.col("text"))).collect()] == [("One two three four five.", 0.333)]


def test_forum_and_keywords(spark):
    p = spark.createDataFrame([(1, None, "x"), (2, "mod", "x"), (3, None, "[deleted]"), (4, "", "[removed]"), (5, None, None)], "id int, removed_by string, selftext string")
    assert {r.id for r in forum.live_posts(p).collect()} == {1, 4, 5}
    c = spark.createDataFrame([(1, i, "[removed]" if i < 5 else "see https://x.y", "t3_a" if i % 2 else "t1_a") for i in range(30)], "t int, i int, body string, parent string")
    got = forum.comments(c, "t", ["i"], parent="parent").collect()
    assert sorted(r.i for r in got) == list(range(5, 20)) and all(r.has_links and r.word_count == 2 and r.is_top_level == bool(r.i % 2) for r in got)
    k = one(spark, evaluate.keywords(F.lit("The Sun"), F.array(F.lit("SUN"), F.lit("moon"))))
    assert (k.found, k.missing, k.recall) == (["SUN"], ["moon"], 0.5)


def test_ensemble(spark):
    words = {"advice": ("should help tips", "recommend best way"), "history": ("war king century", "empire battle year"), "science": ("cell atom energy", "gravity light mass")}
    rows = [(i * 10 + j, f"{w.split()[j % 3]} {w} {w.split()[(i + j) % 3]} n{j}", label) for i, (label, ws) in enumerate(words.items()) for j in range(10) for w in ws]
    train = spark.createDataFrame([(k, t, label) for k, (_, t, label) in enumerate(rows)], "id int, text string, label string")
    labels, apply = intent.ensemble(train, "id", trees=5, parts=2, max_iter=4)
    assert labels == ["advice", "history", "science"]
    new = spark.createDataFrame([(1, "tips should help"), (2, "battle of the empire year"), (3, "light and mass of gravity"), (4, "")], "id int, text string")
    got = {r.id: r.votes for r in apply(new).collect()}
    assert all(abs(sum(v) - 1) < 1e-6 for v in got.values())
    assert [got[i].index(max(got[i])) for i in (1, 2, 3)] == [0, 1, 2]
