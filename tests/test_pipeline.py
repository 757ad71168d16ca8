"""Connectors, searches, fan-out, embeddings, the answer path, training and the engine on small frames."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillmark.engine import REQUEST, Engine
from quillmark.operators import embedding, evaluate, examples, html, intent, retrieval, vector
from quillmark.plans.answering import Corpus, asked
from quillmark.sources import replay, store


def sentence(words, n):
    return " ".join([words] * n).capitalize() + "."


# -- connectors ---------------------------------------------------------------------------------------------------------


def test_replay_source_keeps_errors_apart(spark, tmp_path):
    lines = [
        json.dumps({"kind": "search", "key": "q", "body": [{"title": "T", "snippet": "<b>s</b>", "pageid": 3}]}),
        "not json",
        json.dumps({"kind": "summary", "key": "T", "body": "sum"}),
        json.dumps({"key": "no kind"}),
        "",
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "_skip").write_text("x")
    rows = replay.replayed(spark, str(tmp_path), "search")
    hits = replay.search_hits(rows).collect()
    assert [(r.search, r.hit_idx, r.title, r.snippet, r.pageid, r.wordcount) for r in hits] == [("q", 0, "T", "<b>s</b>", 3, 0)]
    bad = [r.error.split(":")[:2] for r in rows.where("error is not null").collect()]
    assert sorted(bad) == [["a.jsonl", "2"], ["a.jsonl", "4"]]
    assert replay.replayed(spark, str(tmp_path / "a.jsonl"), "summary").where("error is null").first().value == "sum"


def test_articles_and_threads_from_responses(spark):
    one = lambda value, kind: spark.createDataFrame([("A B", value, None)], f"key string, value {kind}, error string")
    none = spark.createDataFrame([], "key string, value string, error string")
    cats = [f"Category:c{i}" for i in range(25)]
    a = replay.articles(none, one("<p>x</p>", "string"), one(cats, "array<string>"), "http://h/wiki/").first()
    assert (a.title, a.url, a.summary, len(a.categories), a.categories[0]) == ("A B", "http://h/wiki/A_B", "", 20, "c0")
    thread = [("t", "self", "/p", 1, 2, 0.0, None, None, [("b", 1, "u", 0.0, "t3_x", None)])]
    found = spark.createDataFrame([("7|science", thread, None)], f"key string, value {replay.SCHEMAS['threads']}, error string")
    posts, said = replay.threads(found)
    p, c = posts.first(), said.first()
    assert (p.query_id, p.forum, p.hit_idx, p.thread_id) == (7, "science", 0, "/p") and (c.thread_id, c.slot, c.awards) == ("/p", 0, 0)


def test_clients_and_limiter(monkeypatch):
    now, slept, urls = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    limiter = replay.Limiter(0.1, lambda: now[0], sleep)

    def get(url, headers):
        urls.append(url)
        assert headers == {"User-Agent": replay.AGENT}
        if "summary" in url:
            return 404, b"{}"
        if "srsearch" in url:
            return 200, json.dumps({"query": {"search": [{"title": "T", "snippet": "s", "pageid": 1}]}}).encode()
        if "categories" in url:
            return 200, json.dumps({"query": {"pages": {"1": {"categories": [{"title": "Category:x"}]}, "2": {}}}}).encode()
        if "prop=text" in url:
            return 200, json.dumps({"parse": {"text": {"*": "<p>"}}}).encode()
        return 500, b""

    c = replay.ArticleClient("http://api", "http://rest/summary/", limiter, get)
    assert c.search("a b") == [{"title": "T", "snippet": "s", "pageid": 1, "wordcount": 0}] and "srlimit=5" in urls[0]
    assert c.summary("A B") == "" and urls[1].endswith("A%20B")
    assert c.html("T") == "<p>" and c.categories("T") == ["Category:x"]
    assert limiter.count == 4 and slept == [0.1, 0.1, 0.1]
    monkeypatch.setenv("FORUM_ID", "me")
    f = replay.ForumClient("http://forum", "FORUM_ID", "FORUM_SECRET", limiter, get)
    assert f.credentials == ("me", None)
    with pytest.raises(OSError, match="status 500"):
        f.search("q", "science")


def test_fetched_rows_fail_one_by_one(spark):
    def connect():
        def request(key):
            if key == "bad":
                raise ValueError("no")
            return {"k": key}

        return request

    got = {r.key: (r.body, r.error) for r in replay.fetched(spark.createDataFrame([("a",), ("bad",)], "key string"), connect).collect()}
    assert got == {"a": ('{"k": "a"}', None), "bad": (None, "ValueError: no")}


# -- searches ---------------------------------------------------------------------------------------------------------


def test_article_search_order_titles_and_flags(spark):
    q = spark.createDataFrame([(1, "q", "history"), (2, "z", "fact")], "query_id int, query string, mode string")
    hits = [("q", 0, "A"), ("q", 1, "D"), ("q", 2, "B"), ("q", 3, "late"), ("q history timeline", 0, "A"), ("q history timeline", 1, "C"), ("q historical event", 0, "E")]
    h = spark.createDataFrame(hits, "search string, hit_idx int, title string")
    flags = spark.createDataFrame([("D", True), ("A", False), ("B", None)], "title string, disambiguation boolean")
    got = [(r.query_id, r.rank, r.title) for r in retrieval.article_search(q, h, flags).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "A"), (1, 2, "B"), (1, 3, "C")]


def test_forum_search_and_parts(spark):
    q = spark.createDataFrame([(1, "blue sky", "verify")], "query_id int, query string, mode string")
    posts = [(1, f"t{i}", f, i % 4, f"u{i}", title, 5, 3, "x" * n, gone) for i, (f, title, n, gone) in enumerate([("skeptic", "blue sky", 60, None), ("skeptic", "other", 50, None), ("DebunkThis", "blue", 60, "mod"), ("DebunkThis", "late", 60, None), ("askscience", "blue sky", 60, None), ("IsItBullshit", "none", 10, "")])]
    p = spark.createDataFrame(posts, "query_id int, thread_id string, forum string, hit_idx int, url string, title string, score int, num_comments int, selftext string, removed_by string")
    said = [("t0", i, f"comment {i} " * (20 if i == 2 else 4), 9 if i == 2 else 0, 0, "t3_a") for i in range(8)] + [("t0", 8, "[removed]", 99, 9, "t3_a")]
    c = spark.createDataFrame(said, "thread_id string, slot int, body string, score int, awards int, parent_id string")
    best = retrieval.best_comments(c, "thread_id", "slot")
    rows = best.orderBy("rank").collect()
    assert len(rows) == 5 and rows[0].slot == 2 and [r.slot for r in rows[1:]] == [0, 1, 3, 4]
    found = retrieval.forum_search(q, p, best.groupBy("thread_id").agg(F.max("quality").alias("quality")))
    # askscience is not among the first three forums, t2 was removed, t3 is a fourth hit
    assert [r.thread_id for r in found.orderBy("rank").collect()] == ["t0", "t5", "t1"]  # equal scores follow the order of forums
    parts = retrieval.thread_parts(found, p.select("thread_id", "url", "title", "forum", "selftext"), best).orderBy("ord").collect()
    assert [x.section_title for x in parts] == ["r/skeptic"] * 5 + ["r/skeptic (OP)"]  # 50 characters are too few
    assert json.loads(parts[0].metadata)["comment_score"] == 9 and json.loads(parts[-1].metadata) == {"is_original_post": True}


def test_article_parts_and_routing(spark):
    a = spark.createDataFrame([("T", "u", "sum", [("One", "text one"), ("Two", "text two")], [str(i) for i in range(9)], 4), ("E", "e", "", None, [], 0)], "title string, url string, summary string, sections array<struct<title:string,content:string>>, categories array<string>, n_references int")
    found = spark.createDataFrame([(1, 1, "T"), (1, 2, "E"), (2, 1, "T")], "query_id int, rank int, title string")
    parts = retrieval.article_parts(found, a)
    got = [(r.query_id, r.section_title, r.text) for r in parts.orderBy("query_id", "ord").collect()]
    assert got == [(k, s, t) for k in (1, 2) for s, t in (("One", "text one"), ("Two", "text two"), ("Summary", "sum"))]
    meta = [json.loads(r.metadata) for r in parts.where("query_id = 1").orderBy("ord").collect()]
    assert meta[0] == {"references_count": 4, "categories": ["0", "1", "2", "3", "4"]} and meta[2] == {"is_summary": True}
    q = spark.createDataFrame([(1, "advice"), (2, "fact")], "query_id int, mode string")
    assert {r.query_id for r in retrieval.routed(parts, q).collect()} == {2}


# -- embeddings ---------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "BLUE red Red"), (3, ""), (4, None)], "k int, text string")
    v = {r.k: r.embedding for r in embedding.embedded(df, 32).collect()}
    assert v[1] == v[2] and len(v[1]) == 32 and abs(sum(x * x for x in v[1]) - 1) < 1e-6
    assert set(v[3]) == set(v[4]) == {0.0}

    def load():
        return lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    m = [r.e for r in df.orderBy("k").select(embedding.modelled(F.col("text"), load, 2).alias("e")).collect()]
    assert [round(x, 4) for x in m[0]] == [0.6, 0.8] and m[2] == [0.0, 0.0]
    both = embedding.appended(spark.createDataFrame([(9, [1.0])], "k int, embedding array<float>"), embedding.embedded(df, 1))
    assert both.count() == 5 and both.columns == ["k", "embedding"]


def test_each_question_searches_its_own_chunks(spark):
    index = [(q, i, [math.cos(i + q), math.sin(i + q)]) for q in (1, 2) for i in range(30)]
    df = spark.createDataFrame(index, "query_id long, vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [0.0, 1.0], 4)], "query_id long, query array<float>, top_k int")
    got = [(r.query_id, r["rank"]) for r in vector.mmr(df, q, own=True, floor=-1.0).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4)]
    alone = vector.mmr(df.where("query_id = 2").drop("query_id"), q.where("query_id = 2").drop("top_k"), 4, floor=-1.0).collect()
    assert {(r["rank"], r.vec_id) for r in alone} == {(r["rank"], r.vec_id) for r in vector.mmr(df, q, own=True, floor=-1.0).where("query_id = 2").collect()}


# -- answers ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    page = "<h2>Light</h2><p>" + sentence("the blue sky scatters light", 12) + " " + sentence("studies show that short waves scatter most of all", 6) + "</p><h2>See also</h2><p>" + sentence("nothing here", 40) + "</p>"
    pages = spark.createDataFrame([("Sky", "http://h/Sky", "", ["c"], page)], "title string, url string, summary string, categories array<string>, html string")
    a = html.articles(pages, "title").drop("infobox")
    hits = spark.createDataFrame([("why is the sky blue", 0, "Sky")], "search string, hit_idx int, title string")
    posts = spark.createDataFrame([(2, "t", "advice", 0, "http://f/t", "save money", 7, 2, " ".join([sentence("put something aside each month and save money early", 1)] * 8), None)], "query_id long, thread_id string, forum string, hit_idx int, url string, title string, score int, num_comments int, selftext string, removed_by string")
    said = spark.createDataFrame([("t", 0, " ".join([sentence("a budget is the main way to save money", 1)] * 7), 12, 0, "t3_t")], "thread_id string, slot int, body string, score int, awards int, parent_id string")
    return Corpus(hits, a, posts, said)


def test_ask_answers_routes_and_falls_back(spark, corpus):
    requests = spark.createDataFrame([(1, "why is the sky blue", None, None), (2, "how to save money", "ADVICE", 3), (3, "nobody knows this", None, 5), (4, "no", None, 5)], REQUEST)
    predictions = spark.createDataFrame([(k, "science", 0.71239, False, {"science": 0.71239}) for k in (1, 2, 3, 4)], "query_id long, predicted string, confidence double, is_ambiguous boolean, probabilities map<string,double>")
    got = {r.query_id: r for r in asked(requests, predictions, corpus, 64, debug=True).collect()}
    assert set(got) == {1, 2, 3}  # the fourth is out of bounds
    one, two, three = got[1], got[2], got[3]
    assert (one.detected_mode, one.mode_confidence, one.mode_was_forced) == ("science", 0.712, False)
    assert "sky scatters light" in one.answer and "nothing here" not in one.answer and one.sources[0].url == "http://h/Sky" and one.key_points
    assert one.debug.intent_probabilities == {"science": 0.71239} and one.debug.chunks_retrieved >= 1 and one.debug.synthesis_metadata.from_articles >= 1
    assert (two.detected_mode, two.mode_confidence, two.mode_was_forced) == ("advice", 1.0, True) and two.debug.intent_probabilities is None
    assert "• " in two.answer and {s.source_type for s in two.sources} == {"forum"} and 0 < two.confidence <= 1
    assert three.confidence == 0.0 and three.sources == [] and three.key_points == [] and three.debug.chunks_retrieved == 0


# -- training, engine, evaluation -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trained(spark):
    engine = Engine(spark)
    engine.train(examples.full(spark, 2), folds=2, max_iter=12)
    return engine


def test_examples_split_train_save_load(spark, tmp_path, trained):
    full = examples.full(spark, 2)
    n = sum(map(len, examples.TEMPLATES.values()))
    counts = {r.source: r["count"] for r in full.groupBy("source").count().collect()}
    assert counts["template"] == 2 * n == 120 and counts["manual"] == 14 and 0 < counts["augmented"] < 72
    store.save_examples(full, str(tmp_path / "x"))
    assert store.load_examples(spark, str(tmp_path / "x")).exceptAll(full).isEmpty()
    (tmp_path / "array.json").write_text(json.dumps([{"text": "a", "label": "fact"}, {"text": "b", "label": "fact"}], indent=2))
    assert store.load_examples(spark, str(tmp_path / "array.json"), array=True).count() == 2

    engine = Engine(spark)
    assert engine.health() == {"status": "loading", "models_loaded": False, "version": "1.0.0"}
    with pytest.raises(RuntimeError, match="no model"):
        engine.predict(spark.createDataFrame([(1, "x")], "query_id long, query string"))
    engine, metrics = trained, trained.training
    assert len(metrics["cv_f1"]) == 2 and abs(metrics["cv_f1_mean"] - sum(metrics["cv_f1"]) / 2) < 1e-12 and metrics["cv_f1_std"] >= 0
    assert metrics["train_size"] + metrics["test_size"] == full.count() and metrics["test"]["accuracy"] > 0.5
    assert sum(map(sum, metrics["test"]["confusion"])) == metrics["test_size"]
    engine.save(str(tmp_path / "m"))
    other = Engine(spark)
    other.load(str(tmp_path / "m"))
    assert other.training == metrics
    q = spark.createDataFrame([(1, "is it true that bats are blind"), (2, "what is the capital of Peru?")], "query_id long, query string")
    one, two = ([tuple(r) for r in e.predict(q).orderBy("query_id").collect()] for e in (engine, other))
    assert one == two and [r[1] for r in one] == ["verify", "fact"] and abs(sum(one[0][4].values()) - 1) < 1e-9


def test_split_keeps_the_shares_of_labels(spark):
    rows = [(i, "hot") for i in range(200)] + [(300 + i, "rare") for i in range(10)] + [(400, "one")]
    got = intent.split(spark.createDataFrame(rows, "id long, label string"), "id", "label").collect()
    assert {k: sum(r.test for r in got if r.label == k) for k in ("hot", "rare", "one")} == {"hot": 40, "rare": 2, "one": 0}


def test_accents_and_log_counts(spark):
    assert dict(zip(intent.ACCENTED, intent.PLAIN))["é"] == "e" and len(intent.ACCENTED) == len(intent.PLAIN)
    rows = [("été ete cat cat", "a"), ("ete dog", "a"), ("dog cat", "b")]
    m = intent.training_pipeline(5).fit(intent.balanced(spark.createDataFrame(rows, "text string, label string")))
    out = m.transform(spark.createDataFrame([("ÉTÉ ete x", "a", 1.0)], "text string, label string, weight double")).first()
    assert out.w1 == ["ete", "ete"] and abs(max(out.logtf.values) - (1 + math.log(2))) < 1e-12


def test_engine_asks_evaluates_and_records(spark, corpus, tmp_path, trained):
    engine = Engine(spark, corpus, str(tmp_path / "log"), 64)
    requests = spark.createDataFrame([(1, "why is the sky blue", "science", 5), (2, "x", None, 99)], REQUEST)
    with pytest.raises(RuntimeError, match="not ready"):
        engine.ask(requests)
    assert [(r.query_id, r.errors) for r in engine.rejected(requests).collect()] == [(2, ["query", "top_k"])]
    cases = spark.createDataFrame([("why is the sky blue", "science", ["sky", "moon"])], "query string, expected_mode string, expected_keywords array<string>")
    results, metrics = engine.evaluate(cases)  # without a model every case fails
    assert results.first().error.startswith("RuntimeError") and metrics.first().error_rate == 1.0 and metrics.first().intent_accuracy is None
    engine.model = trained.model
    assert engine.ready and engine.health()["status"] == "healthy"
    results, metrics = engine.evaluate(cases)
    r = results.first()
    assert (r.keywords_missing, r.error) == (["moon"], None) or r.num_sources == 0
    assert metrics.first().error_rate == 0.0 and len(evaluate.report_lines(metrics).collect()) == 12
    store.save_evaluation(results, metrics, str(tmp_path / "eval"), "20260101_000000")
    assert spark.read.json(str(tmp_path / "eval" / "details")).first().run_ts is not None
    engine.record_feedback(spark.createDataFrame([("q", True, None)], "query string, was_helpful boolean, correct_mode string"))
    assert spark.read.schema(store.FEEDBACK).json(str(tmp_path / "log")).first().timestamp > 1e9
    with pytest.raises(ValueError, match="feedback_path"):
        Engine(spark).record_feedback(requests)


def test_article_codec_and_upsert_ties(spark):
    s = [("One", 2, "text", None)]
    a = spark.createDataFrame([("T", s)], "title string, sections array<struct<title:string,level:int,content:string,parent_section:string>>")
    coded = store.encode_articles(a)
    assert "parent_section" not in coded.first().data
    assert store.decode_articles(coded, a.schema).collect() == a.collect()
    rows = lambda *x: spark.createDataFrame(list(x), "key string, fetched_at double, data string")
    out = {r.key: r.data for r in store.upsert(rows(("k", 1.0, "zz"), ("o", 5.0, "old")), rows(("k", 1.0, "a"), ("k", 1.0, "b"), ("o", 4.0, "new"))).collect()}
    assert out == {"k": "b", "o": "old"}
    assert store.dimensions(spark.createDataFrame([(None,), ([1.0, 2.0],)], "embedding array<float>")) == 2
