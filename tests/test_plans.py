"""What the plans must keep to hold at scale."""

import pytest

from lodestone import queries
from lodestone.operators.bm25 import bm25_scores
from lodestone.operators.fuzzy import near_stored
from lodestone.operators.index import ID, lookup_term
from lodestone.plans.search import IndexTables, fetch_documents, matches, search_pages
from lodestone.settings import IndexSettings, RankingCriterion, SearchQuery
from lodestone.sources.store import IndexStore


@pytest.fixture(scope="module")
def store(spark, sf_dir, tmp_path_factory):
    s = IndexStore(spark, str(tmp_path_factory.mktemp("index") / "documents"))
    s.create(IndexSettings("documents", ("text",), ("n_chars",), (RankingCriterion("n_chars"),), fields_without_prefix_search=("text",)).validated())
    s.upsert(queries._docs(spark, sf_dir))
    return s


def plan_of(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    """The file scans of a plan: (columns read, pushed filters)."""
    return [(x.split("ReadSchema: struct<")[1].split(">")[0], x.split("PushedFilters: [")[1].split("]")[0]) for x in plan.split("FileScan parquet")[1:]]


def is_clean(plan):
    return "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize(("text", "terms"), [("the of", {"the", "of"}), ("ofthe", None)])
def test_search_of_a_stored_index(spark, store, text, terms):
    """As the engine plans it, typos included: terms and filters reach the scans, ranks
    are limited before the shuffle, and ranking reads no text."""
    tree = {"filters": [{"field": "n_chars", "operator": "_gt", "value": 100}]}
    plan = plan_of(spark, search_pages(store.tables(), [SearchQuery(text, filters=tree)]))
    found = scans(plan)
    postings = [p for columns, p in found if "tf:" in columns]
    assert postings and all("EqualTo(term," in p or "In(term," in p for p in postings)
    if terms:
        assert all(f"EqualTo(term,{t})" in postings[0] for t in terms)
    documents = [(c, p) for c, p in found if "n_chars" in c]
    assert documents and all("GreaterThan(n_chars,100)" in p and "text:" not in c for c, p in documents)
    assert not any("variant:" in c for c, _ in found)  # candidates were found before
    assert "WindowGroupLimit" in plan and is_clean(plan)


def test_search_without_filters_reads_no_documents(spark, store):
    tables = store.tables()
    tables.settings = IndexSettings("documents", ("text",), fields_without_prefix_search=("text",)).validated()
    plan = plan_of(spark, search_pages(tables, [SearchQuery("the of")]))
    assert not any("lang:" in c or "text:" in c or "n_chars:" in c for c, _ in scans(plan))
    fetched = plan_of(spark, fetch_documents(tables, ["3", "17"], ["lang"]))
    assert all(p.count("EqualTo(documentID,") == 2 and "text:" not in c for c, p in scans(fetched))


def test_bm25_and_posting_list_prune_by_term(spark, store):
    tables = store.tables()
    plan = plan_of(spark, bm25_scores(tables.docs, tables.postings, tables.settings, ["the", "und"]))
    assert all("EqualTo(term,the)" in p and "EqualTo(term,und)" in p for c, p in scans(plan) if "term:" in c)
    plan = plan_of(spark, lookup_term(tables.postings, tables.settings, "the"))
    assert all("EqualTo(term,the)" in p for _, p in scans(plan))


def test_probes_reach_the_variants(spark, store):
    plan = plan_of(spark, near_stored(["abcdefghi"], store.tables().variants, 2))
    assert all("EqualTo(variant,abcdefg)" in p for c, p in scans(plan) if "variant:" in c) and is_clean(plan)


def broadcasts(plan):
    """The subtrees that a plan broadcasts."""
    lines = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan.splitlines()]
    out = []
    for k, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if lines[j][0] <= depth), len(lines))
            out.append("\n".join(x for _, x in lines[k:end]))
    return out


@pytest.mark.parametrize(("texts", "typos", "reads"), [(["re"], False, 1), (["re", "re bolt promo"], True, 2), ([f"re{k}" for k in range(200)], False, 2)])
def test_postings_made_on_the_fly_are_not_broadcast(spark, sf_dir, texts, typos, reads):
    """Whatever small size the planner takes them for; a few exact words need no vocabulary."""
    index = IndexTables.of(queries._parts(spark, sf_dir), queries.PARTS)
    plan = plan_of(spark, matches(index, [SearchQuery(t) for t in texts], typos))
    assert broadcasts(plan) and not any("count(1)" in b or "FileScan" in b for b in broadcasts(plan)) and is_clean(plan)
    assert len(scans(plan)) >= reads and (reads > 1 or len(scans(plan)) == 1)


def test_exact_words_on_the_fly_with_and_without_a_vocabulary(spark, sf_dir, monkeypatch):
    index = IndexTables.of(queries._parts(spark, sf_dir), queries.PARTS)
    batch = [SearchQuery("re"), SearchQuery("re s s"), SearchQuery("promo b"), SearchQuery("s", restrict_searchable_fields=("p_type",)), SearchQuery("")]
    direct = sorted(map(str, matches(index, batch, False).collect()))
    monkeypatch.setattr("lodestone.plans.search.PROBES", 0)
    assert direct and direct == sorted(map(str, matches(index, batch, False).collect()))


def test_no_query_of_the_engine_runs_python(spark, sf_dir):
    for name, f in queries.QUERIES.items():  # those of the engine run it while they are planned
        plan = plan_of(spark, f(spark, sf_dir))
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan, name


def test_segments(spark, store, sf_dir):
    before = store.docs().count()
    french = store.docs().where("lang = 'fr'")
    n = french.count()
    store.delete(french.select(ID))
    assert store.docs().count() == before - n and store.postings().join(french.select(ID), ID, "left_semi").count() == 0
    store.reindex()
    assert len(store.manifest()["segments"]) == 1 and store.docs().count() == before - n
