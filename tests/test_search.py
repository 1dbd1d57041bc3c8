import random
from collections import Counter

import pytest
from test_text import plain_distance

from lodestone.errors import InvalidInput
from lodestone.functions.text import tokenize_text
from lodestone.operators import bm25
from lodestone.operators.fuzzy import near_terms
from lodestone.operators.index import ID, build_postings, clean_documents, lookup_term, vocabulary
from lodestone.plans.search import IndexTables, search, search_all
from lodestone.settings import IndexSettings, RankingCriterion, SearchQuery

DEFAULT = {"min_word_size_for_1_typo": 4, "min_word_size_for_2_typos": 7}


def run(index, *queries, typos=True):
    return search(index, [q if isinstance(q, SearchQuery) else SearchQuery(q) for q in queries], typos).orderBy("qk", "rank").collect()


def table(spark, rows, schema, settings):
    return IndexTables.of(spark.createDataFrame(rows, schema), settings)


@pytest.fixture(scope="module")
def plants(spark):
    rows = [
        ("p-oak", "A tall garden oak", "Tree", 1890, 30.5, False, ["shade", "dry soil"]),
        ("p-iris", "A small garden iris", "Flower", 2019, 0.6, True, ["wet soil"]),
        ("p-fig", "A broad garden fig", "Tree", 1975, 8.0, True, ["shade"]),
    ]
    settings = IndexSettings("plants", ("label", "kind"), (), (RankingCriterion("~filters"), RankingCriterion("~score")), **DEFAULT)
    return table(spark, rows, "documentID string, label string, kind string, planted int, height double, edible boolean, likes array<string>", settings)


def leaf(field, operator, value, score=0.0):
    return {"field": field, "operator": operator, "value": value, "score": score}


def scored(index, tree):
    return [(r[ID], r["filter_score"]) for r in run(index, SearchQuery("garden", filters=tree))]


def test_filter_scores_rank(plants):
    either = [leaf("kind", "", "Flower", 0.75), leaf("planted", "_lt", 1900, 4.0)]
    assert scored(plants, {"operator": "OR", "filters": either}) == [("p-oak", 4.0), ("p-iris", 0.75)]
    both = [leaf("kind", "", "Tree", 0.5), leaf("edible", "", True, 1.25)]
    assert scored(plants, {"operator": "AND", "filters": both}) == [("p-fig", 1.75)]
    liked = [leaf("likes", "_contains", "soil", 1.0), leaf("likes", "_contains", "shade", 0.5)]
    assert scored(plants, {"operator": "OR", "filters": liked}) == [("p-oak", 1.5), ("p-iris", 1.0), ("p-fig", 0.5)]


def test_no_tokens_no_hits(plants):
    assert run(plants, "") == [] and run(plants, " ;,# ") == [] and run(plants, "submarine") == []


def test_field_restriction(plants):
    assert {r[ID] for r in run(plants, SearchQuery("tree", restrict_searchable_fields=("kind",)))} == {"p-oak", "p-fig"}
    assert run(plants, SearchQuery("tree", restrict_searchable_fields=("label",))) == []
    with pytest.raises(InvalidInput, match="not configured as a searchable field"):
        run(plants, SearchQuery("tree", restrict_searchable_fields=("kind", "height")))


def test_distinct_keeps_first_in_ranking(spark):
    rows = [("k1", "red kite", 10.0), ("k2", "red kite", 40.0), ("k3", "red barn", 20.0), ("k4", "red barn", 15.0), ("k5", "red kite", 25.0), ("k6", "blue barn", 99.0)]
    ranking = (RankingCriterion("price", "desc"),)
    every = table(spark, rows, "documentID string, name string, price double", IndexSettings("d", ("name",), (), ranking, **DEFAULT))
    assert [r[ID] for r in run(every, "red")] == ["k2", "k5", "k3", "k4", "k1"]
    assert [r["total"] for r in run(every, SearchQuery("red", page=3, page_size=2))] == [5]
    once = table(spark, rows, "documentID string, name string, price double", IndexSettings("d", ("name",), (), ranking, distinct_field="name", **DEFAULT))
    assert [(r[ID], r["total"]) for r in run(once, "red")] == [("k2", 2), ("k3", 2)]


def test_protected_words(spark):
    rows = [("1", "lantern repair", "brass"), ("2", "saddle care", "leather"), ("3", "candle making", "beeswax")]
    settings = IndexSettings("p", ("title", "content"), (), (), 3, 6, non_typo_tolerant_words=("lantern", "saddle"))
    index = table(spark, rows, "documentID string, title string, content string", settings)
    expected = {"lantern": 1, "LANTERN": 1, "saddle": 1, "lantrn": 0, "Sadle": 0, "lant": 1, "candel": 1, "beeswx": 1}
    found = Counter(r["qk"] for r in run(index, *expected))
    assert [found[k] for k in range(len(expected))] == list(expected.values())


def test_exact_and_typo_reporting(spark):
    rows = [("1", "Harbour Lights", ["Mira Holm"]), ("2", "Harbours of the North", ["Jon Vale"]), ("3", "Inland", ["Ida Berg"])]
    index = table(spark, rows, "documentID string, title string, people array<string>", IndexSettings("o", ("title", "people"), **DEFAULT))
    hit = next(r for r in run(index, "mira harbour lights") if r[ID] == "1")
    assert (hit["num_typos"], hit["number_exact_words"], hit["score"]) == (0, 3, 3.0)
    assert hit["field_matches"] == {"people": ["mira"], "title": ["harbour", "lights"]}
    typo = run(index, "harbuor")
    assert {r[ID] for r in typo} == {"1", "2"} and {r["score"] for r in typo} == {0.8} and all(r["num_typos"] == 1 for r in typo)


def test_ranking_ties(spark):
    rows = [("c", "boat one", 2.0, 5.0), ("a", "boat two", 9.0, 1.0), ("d", "boat three", 2.0, 4.0), ("b", "boat four", 7.0, 0.0), ("e", "boat five", None, 8.0)]
    settings = IndexSettings("r", ("title",), (), (RankingCriterion("speed", "desc"), RankingCriterion("crew", "desc")), **DEFAULT)
    index = table(spark, rows, "documentID string, title string, speed double, crew double", settings)
    assert [r[ID] for r in run(index, "boat")] == ["a", "b", "c", "d", "e"]


def test_all_hits_rank_as_pages_do(spark):
    rows = [(f"{k:03}", "kite " * (k % 4) + ("boat" if k % 3 else "barn"), k % 7 if k % 5 else None) for k in range(300)]
    settings = IndexSettings("r", ("title",), (), (RankingCriterion("crew", "desc"), RankingCriterion("~score", "asc")), **DEFAULT)
    index = table(spark, rows, "documentID string, title string, crew int", settings)
    batch = [SearchQuery("kite boat", page_size=400), SearchQuery("barn"), SearchQuery("submarine"), SearchQuery("kite", filters={"filters": [leaf("crew", "_gte", 2, 1.5)]})]
    pages = run(index, *batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        every = search_all(index, batch).orderBy("qk", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["qk"] for r in pages}) == 3 and len(pages) > 300 and every == pages
    assert search_all(index, [SearchQuery("submarine")]).collect() == []


def test_near_terms_plans_agree(spark):
    words = ["the", "form", "from", "farm", "firm", "fork", "receive", "recieve", "calendar", "calender", "frm"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    tokens = spark.createDataFrame([("form",), ("teh",), ("recieve",), ("calender",), ("xyz",)], "token string")
    expected = {(t, w, plain_distance(t, w)) for t in ("form", "teh", "recieve", "calender", "xyz") for w in words if t != w and plain_distance(t, w) <= 2}
    for n in (2, 5, None):
        assert {tuple(r) for r in near_terms(tokens, terms, 2, n).collect()} == expected
    assert {tuple(r)[:2] for r in near_terms(tokens, terms, 1, 2).collect()} == {("form", "from"), ("form", "farm"), ("form", "firm"), ("form", "fork"), ("form", "frm"), ("teh", "the"), ("recieve", "receive"), ("calender", "calendar")}
    assert near_terms(tokens, terms, 2, 5, limit=1).count() == 4


def test_posting_lists(spark):
    rows = [("0", "Tin Teapot", "tin and tin", ["t"]), ("1", "Tray", "plain", [])]
    docs = spark.createDataFrame(rows, "documentID string, title string, description string, tags array<string>")
    settings = IndexSettings("i", ("title", "description", "tags"), fields_without_prefix_search=("description", "tags"))
    postings = build_postings(docs, settings)
    assert sorted(map(tuple, lookup_term(postings, settings, "tin").collect())) == [("0", "description", 2.0), ("0", "title", 1.0)]
    assert sorted(map(tuple, lookup_term(postings, settings, "t").collect())) == [("0", "tags", 1.0), ("0", "title", 1.0), ("1", "title", 1.0)]


def test_rejected_documents(spark):
    docs = spark.createDataFrame([(" a ", 1), (None, 2), (" \t", 3)], "documentID string, n int")
    valid, rejected = clean_documents(docs)
    assert [r[ID] for r in valid.collect()] == ["a"] and rejected.count() == 2
    assert clean_documents(spark.createDataFrame([(1,)], "documentID int"))[1].count() == 1


def test_bm25(spark):
    rows = [("1", "the quick brown fox", "a quick animal of the forest"), ("2", "brown dog", "the fox"), ("3", "quick thing", "none here at all")]
    settings = IndexSettings("b", ("title", "description"), fields_without_prefix_search=("title", "description"))
    docs = spark.createDataFrame(rows, "documentID string, title string, description string")
    postings = build_postings(docs, settings)
    freq = {r["key"]: r["df"] for r in bm25.document_frequency(postings, settings).collect()}
    assert freq["quick"] == 2 and freq["brown"] == 2
    scores = {(r[ID], r["token"]): r["bm25"] for r in bm25.bm25_scores(docs, postings, settings, ["quick", "missing"]).collect()}
    import math

    lengths = {"1": 10, "2": 4, "3": 6}
    for ident, tf in (("1", 2), ("3", 1)):
        norm = 1.2 * (0.25 + 0.75 * lengths[ident] / (20 / 3))
        assert scores[ident, "quick"] == pytest.approx(math.log(3 / 2) * tf * 2.2 / (tf + norm))
    assert len(scores) == 2


def brute(docs, settings, query):
    """Plain search over dicts, written from the semantics, without filters."""
    fields = {f: (f not in settings.fields_without_prefix_search) for f in settings.searchable_fields}
    index = {}
    for d in docs:
        for f, wide in fields.items():
            tf = Counter(tokenize_text(d[f] or ""))
            keys = {p: 1.0 for w in tf for p in (w[:i] for i in range(1, len(w) + 1))} if wide else {w: float(n) for w, n in tf.items()}
            for k, v in keys.items():
                index.setdefault(k, []).append((d[ID], f, v))
    tokens = tokenize_text(query)
    score, typo_terms, exact_words, found = Counter(), {}, Counter(), {}
    for t in tokens:
        exact = {}
        for ident, f, v in index.get(t, ()):
            exact.setdefault(ident, []).append((f, v))
        best = {}
        for cls, least, factor in ((1, settings.min_word_size_for_1_typo, 0.8), (2, settings.min_word_size_for_2_typos, 0.6)):
            if least <= 0 or len(t) < least:
                continue
            for term in index:
                if term != t and plain_distance(t, term) <= cls:
                    for ident, f, v in index[term]:
                        if ident not in exact:
                            key = (cls, term, -v, f)
                            if ident not in best or key < best[ident][0]:
                                best[ident] = (key, v * factor)
        found.setdefault(t, set(exact) | set(best))
        for ident, hits in exact.items():
            score[ident] += max(v for _, v in hits)
        for ident, (key, v) in best.items():
            score[ident] += v
            typo_terms.setdefault(ident, set()).add(key[1])
    keep = set.intersection(*found.values()) if found else set()
    for d in docs:
        for t in set(tokens):
            if any(t in tokenize_text(d[f] or "") for f in fields):
                exact_words[d[ID]] += 1
    return {i: (round(score[i], 9), len(typo_terms.get(i, ())), exact_words[i]) for i in keep}


def test_against_plain_search(spark):
    rng = random.Random(3)
    words = ["abc", "abd", "acbd", "abcde", "abcdf", "bacde", "xyzzy", "xyzz", "zyxwv", "a", "ab"]
    for trial in range(4):
        docs = [{ID: str(i), "title": " ".join(rng.choices(words, k=rng.randint(0, 4))), "body": " ".join(rng.choices(words, k=rng.randint(0, 6)))} for i in range(12)]
        settings = IndexSettings("x", ("title", "body"), (), (), 3, 5, ("body",) if trial % 2 else ())
        index = table(spark, [(d[ID], d["title"], d["body"]) for d in docs], "documentID string, title string, body string", settings)
        queries = [" ".join(rng.choices([*words, "abce", "xyzy"], k=rng.randint(1, 3))) for _ in range(6)]
        got: dict = {}
        for r in run(index, *(SearchQuery(q, page_size=50) for q in queries)):
            got.setdefault(r["qk"], {})[r[ID]] = (round(r["score"], 9), r["num_typos"], r["number_exact_words"])
        for k, q in enumerate(queries):
            assert got.get(k, {}) == brute(docs, settings, q), q
