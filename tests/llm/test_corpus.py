"""Corpus operators against brute force on small tables, and their odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, exact_dedup, langid, near_dup, packing, queries, sharding, suffix_dedup, toxicity, url_filter, warc
from lodestone.llm.common import connected_components

LONG = " ".join(f"w{i % 97}x{i}" for i in range(3000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, text_key string, h string, key string, size string, shard string, words string, bin string, rows int"
TEXTS = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, LONG + " tail"), (8, "Ünï cødé ß"), (None, None), (9, "x"), (9, "y"), (10, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", 0, k, "t", "h", "k", "z", "q", "w", "b", 1) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- exact dedup


def test_trie_holds_every_key():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(400)]
    trie = exact_dedup.Trie()
    for n, k in enumerate(keys):
        trie.insert(k, "", n, 1, n, 1, 1)
    expected = {k: [keys.index(k), len(keys) - 1 - keys[::-1].index(k), keys.count(k)] for k in keys}
    assert {k: [t[0], t[2], t[4]] for k, t in trie.terminals()} == expected


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_exact_dedup_odd(odd, empty, budget):
    rows = exact_dedup.exact_membership(odd, keep="max", trie_bytes=budget).collect()
    assert len(rows) == len(TEXTS)
    by_text = defaultdict(list)
    for i, t in TEXTS:
        by_text[t or ""].append(i)
    for r in rows:
        t = next(t for t in by_text if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(by_text[t]) and r["keep_id"] == max((i for i in by_text[t] if i is not None), default=None)
    assert Counter(r["text_sha256"] for r in rows if r["kept"]) == Counter({r["text_sha256"]: 1 for r in rows})
    kept = exact_dedup.exact_dedup(odd, keep="min", trie_bytes=budget)
    assert kept.columns == odd.columns and kept.count() == len(by_text)
    assert exact_dedup.exact_membership(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


# --- near duplicates


def brute_components(rows, size, percent):
    sets = [frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset()) for w in (words(t) for _, t in rows)]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k in range(len(rows)):
        ids[find(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((i for i in ids[find(k)] if i is not None), default=None) if sets[k] else rows[k][0]) for k in range(len(rows))]


def test_near_dup_against_brute_force(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(4)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(150)]
    for k in range(60):  # a family around the threshold
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"u{rng.randint(0, 10**6)}"
        rows.append((1000 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows, 4, 80)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    got = near_dup.near_components(df, 4, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_near_dup_odd(odd, empty):
    got = near_dup.near_components(odd, 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    order = lambda x: [(v is None, v) for v in x]
    assert sorted(map(tuple, got), key=order) == sorted(brute_components(TEXTS, 5, 80), key=order)
    kept = near_dup.near_dedup(odd)
    assert kept.columns == odd.columns
    # one of each group of texts with words; all of the five without words
    assert sorted(r["text"] for r in kept.collect() if words(r["text"])) == sorted(["a b c d e", min(LONG, LONG + " tail", key=len), "Ünï cødé ß", "x", "y"])
    assert sum(not words(r["text"]) for r in kept.collect()) == 4
    assert near_dup.near_components(empty).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = (np.concatenate((common, rng.integers(0, 2**63, 100).astype(np.uint64))) for _ in range(2))
    n, k = near_dup.FINE_BITS, near_dup.FINE_SAMPLES
    odd_bits = int(np.bitwise_count((near_dup.odd_sketch(near_dup.minhash(a, k), n) ^ near_dup.odd_sketch(near_dup.minhash(b, k), n)).view(np.uint64)).sum())
    estimate = 1 + n / (4 * k) * np.log(1 - 2 * odd_bits / n)
    assert abs(estimate - 900 / 1100) < 0.05


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 4), (7, 6), (6, 5), (9, 9)]
    assert sorted(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 4)]


# --- repeated strings


def brute_removal(rows, length):
    data = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask, until = [], -1
        for i in range(len(b)):
            if i + length <= len(b) and seen[b[i : i + length]] > 1:
                until = i + length
            mask.append(i < until)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out.append((len(b), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize(("class_regions", "shard_bytes"), [(256, 1 << 20), (1, 1 << 20), (256, 500)])
def test_suffix_dedup(spark, class_regions, shard_bytes):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    rows = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 400))) + passage[rng.randint(0, 80) : rng.randint(150, 300)] + "".join(rng.choices("xyz", k=rng.randint(0, 200))) for _ in range(60)]
    rows += [None, "", "ab" * 400, "ab" * 400, "c" * 1000, passage, passage + "é" * 300, rows[0], "q" * 99, "q" * 99]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = suffix_dedup.repeated_spans(df, 100, 16, class_regions=class_regions, shard_bytes=shard_bytes).collect()
    assert [tuple(r)[1:5] for r in sorted(got, key=lambda r: r["doc_id"])] == brute_removal(rows, 100)


def test_suffix_dedup_odd(odd, empty):
    got = suffix_dedup.repeated_spans(odd, 200).collect()
    expected = brute_removal([t for _, t in TEXTS], 200)
    assert Counter(tuple(r)[1:5] for r in got) == Counter(expected)
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for _ in range(20):
        text = np.frombuffer(bytes(rng.choices(b"ab", k=rng.randint(1, 300))), np.uint8)
        keys = suffix_dedup.packed(text, 64)
        sa = suffix_dedup.suffix_array(keys, len(text))
        raw = text.tobytes()
        assert sorted(range(len(raw)), key=lambda i: raw[i:]) == sa.tolist()
        lcp = suffix_dedup.common_prefixes(keys, sa, 20)
        for x, y in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while n < 20 and x + n < len(raw) and y + n < len(raw) and raw[x + n] == raw[y + n]:
                n += 1
            assert lcp[y] >= n  # zero padding may add to it beyond the end


def test_shards_merge_by_binary_search():
    a, b = np.array([b"aa", b"cc", b"dd"], "S2"), np.array([b"bb", b"cc", b"zz"], "S2")
    assert [x.tolist() for x in suffix_dedup.merge_shards(a, b)] == [[False, True, False], [False, True, False]]


# --- sharding


def test_sharding(docs, odd, empty):
    rows = sharding.balanced_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    size = Counter()
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    for r in rows:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 4
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    got = sharding.balanced_shards(odd, 3).collect()
    assert len(got) == len(TEXTS) and {r["size"] for r in got if r["text_crc32"] is None} == {8}
    assert sharding.balanced_shards(empty, 3).count() == 0


# --- packing


def test_best_fit_against_plain():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randint(1, 80)
        sizes, sources, clusters = ([rng.randint(1, 50) for _ in range(n)], [rng.randint(0, 5) for _ in range(n)], [rng.randint(-1, 3) for _ in range(n)])
        bins: list[dict] = []
        expected = []
        for size, s, c in zip(sizes, sources, clusters, strict=True):
            fit = [b for b in bins if b["left"] >= size and s not in b["s"] and (c < 0 or c not in b["c"])]
            best = min((b["left"] for b in fit), default=None)
            expected.append(best)
            if best is None:
                bins.append({"left": 50 - size, "s": {s}, "c": {c}})
            else:  # of equally tight bins the one that the packer took
                chosen = next(b for b in fit if b["left"] == best)
                chosen["left"] -= size
                chosen["s"].add(s)
                chosen["c"].add(c)
        got = packing.best_fit(sizes, sources, clusters, 50)
        left, seen = {}, defaultdict(lambda: (set(), set()))
        for size, s, c, b in zip(sizes, sources, clusters, got, strict=True):
            assert s not in seen[b][0] and (c < 0 or c not in seen[b][1])
            fits = [v for k, v in left.items() if v >= size and s not in seen[k][0] and (c < 0 or c not in seen[k][1])]
            assert left.get(b) == min(fits, default=None)
            left[b] = left.get(b, 50) - size
            seen[b][0].add(s)
            seen[b][1].add(c)
        assert all(v >= 0 for v in left.values()) and len(expected) == n


def test_packing(docs, odd, empty):
    for df, block in ((docs, 64), (odd, 4)):
        rows = packing.pack(df, 256, block).collect()
        total = sum(len(words(r["text"])) for r in df.select("text").collect())
        assert sum(r["n_words"] for r in rows) == total
        bins = defaultdict(list)
        for r in rows:
            bins[r["bin_id"]].append(r)
        for b in bins.values():
            b.sort(key=lambda r: r["bin_start"])
            assert [r["bin_start"] for r in b] == [sum(x["n_words"] for x in b[:k]) for k in range(len(b))] and sum(r["n_words"] for r in b) == b[0]["bin_words"] <= 256
            assert len({r["source"] for r in b}) == len(b)
    assert packing.pack(empty).count() == 0


# --- URL filters


def test_url_filter(spark):
    urls = [
        ("http://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("https://a.b.example.org/en/12?x#y", "a.b.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://x.com/de", "x.com", "/de", None, "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("http://x.org?/de/", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http:///es/", "", "/es/", None, "allow"),
        ("a://b://c.com/de/", "b:", "//c.com/de/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)] + [(0, urls[0][0]), (None, urls[1][0])], "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    for broadcast in (10**6, 0):
        url_filter.BROADCAST_RULES, old = broadcast, url_filter.BROADCAST_RULES
        rows = url_filter.url_verdicts(df, queries.URL_RULES).collect()
        url_filter.BROADCAST_RULES = old
        assert len(rows) == len(urls) + 2 and sum(r["page_id"] == 0 for r in rows) == 2
        for r in rows:
            assert tuple(r)[1:] == urls[r["page_id"] if r["page_id"] is not None else 1][1:]
    assert url_filter.filter_urls(df, queries.URL_RULES).count() == len(urls) - 3 and url_filter.filter_urls(df, queries.URL_RULES).columns == df.columns
    assert url_filter.url_verdicts(df.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.url_verdicts(df, []).where("verdict = 'allow'").count() == len(urls) + 2


# --- language


def test_language(docs, odd, empty):
    profiles = langid.learn(docs, ~langid.held_out())
    rows = langid.predict(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    odd_rows = langid.predict(odd, profiles).collect()
    assert len(odd_rows) == len(TEXTS) and sum(r["lang_pred"] == "und" for r in odd_rows) == sum(not any(c.isalpha() for c in t or "") for _, t in TEXTS)
    assert langid.learn(empty, F.lit(True)) == {} and langid.predict(odd, {}).where("lang_pred != 'und'").count() == 0
    assert langid.predict(empty, profiles).count() == 0


# --- decontamination


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "Short item"), (3, ""), (4, None), (1, "one two three four five six seven eight nine ten"), (12, "short ITEM x")], "item_id long, text string")
    text = "zero ONE two-three four five six; seven eight nine zzz short item x end"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "SHORT item"), (1, text)], "doc_id long, text string").withColumns({"key": F.lit(1), "items": F.lit("c"), "gram": F.lit("g")})
    for windows, keys in ((10**6, 0), (0, 10**6), (0, 0)):
        rows = decontam.contamination(df, bench, broadcast_windows=windows, broadcast_keys=keys).select("doc_id", "n_words", "n_hit", "items").collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows) == Counter({(1, 15, 12, ("1", "12", "2")): 2, (2, 1, 0, ()): 1, (3, 0, 0, ()): 1, (4, 2, 2, ("2",)): 1})
    assert sorted(r["doc_id"] for r in decontam.decontaminate(df, bench).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(df, bench, remove="spans").collect()}
    assert [re.findall(r"\w+", cut[k] or "") for k in (1, 2, 3, 4)] == [["zero", "zzz", "end"], ["short"], [], []]
    assert decontam.contamination(odd, bench).count() == len(TEXTS) and decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


# --- toxicity


def test_ordinal_regression():
    rng = np.random.default_rng(0)
    rows = [list(np.flatnonzero(rng.random(4) < 0.4)) for _ in range(3000)]
    true = np.array([3.0, 1.5, 0.0, -2.0])
    score = np.array([sum(true[c] for c in r) for r in rows]) + rng.logistic(size=3000)
    grades = (score > 0.5).astype(int) + (score > 2.5)
    w, b = toxicity.fit_cumulative_link(rows, grades, 4)
    assert np.abs(w - true).max() < 0.4 and abs(b[0] - 0.5) < 0.3 and abs(b[1] - 2.5) < 0.4


def test_toxicity(spark, docs, sf_dir, odd, empty):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = rng.choices(vocab, k=40) + (rng.choices(["vilewordish", "vilewordly", "nastything"], k=rng.randint(1, 4)) if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if i < 400:
            labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = {r["doc_id"]: r for r in toxicity.severity(df, model).collect()}
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in range(400, 600))
    assert all(0 <= r["severity"] <= len(model.thresholds) for r in got.values())
    kept = toxicity.drop_toxic(df, model)
    assert kept.count() == 480 and kept.columns == df.columns
    assert toxicity.severity(odd, model).count() == len(TEXTS) and toxicity.drop_toxic(odd, model).count() == len(TEXTS)
    none = toxicity.fit(empty.select("doc_id", "text"), lab)
    assert toxicity.severity(odd, none).where("severity > 0 OR toxic").count() == 0 and toxicity.drop_toxic(empty, model).count() == 0


# --- archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_converter(version):
    bodies = [b"HTTP/1.0 200 OK\nA: b\n\n<html>\n\nx", b"", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)), b"plain"]
    data = warc.arc_version_block(version, date="199901020304") + b"".join(warc.arc_record(version, f"http://x/{i}", b, "19990102030405") for i, b in enumerate(bodies))
    parsed = list(warc.parse_arc(data))
    assert [p.body for p in parsed[1:]] == bodies and {p.version for p in parsed} == {version} and not any(p.truncated for p in parsed)
    records = list(warc.parse_warc(iter([b"".join(warc.arc_to_warc(data))])))
    assert [h["WARC-Type"] for h, _ in records] == ["warcinfo", "response", "resource", "response", "resource"]
    assert [b for _, b in records[1:]] == bodies and records[1][0]["WARC-Date"] == "1999-01-02T03:04:05Z" and records[0][0]["WARC-Date"] == "1999-01-02T03:04:00Z"
    assert records[3][0]["WARC-Payload-Digest"] == warc.sha1_base32(bytes(range(256)))
    assert list(warc.parse_arc(data[:-3]))[-1].truncated
    with pytest.raises(ValueError, match="malformed"):
        list(warc.parse_arc(data + b"broken line\n"))


def test_archive_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a b/\n5", big), (3, None, big), (2, "http://a/2", "small"), (4, "http://a/4", "small"), (6, "http://a/6", None), (7, "http://a/7", "\r\n\r\nWARC/1.0\r\n\r\n"), (8, "u", other), (None, "http://n/", big), (8, "u", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "id": F.lit(0)})
    got = warc.round_trip(df, str(tmp_path / "w")).collect()
    expected = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == big and i != 5
        expected[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 5 if again else None, None if again else body] += 1
    assert Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == expected
    assert warc.round_trip(df.limit(0), str(tmp_path / "e")).count() == 0


def test_inflate_members():
    import gzip

    parts = [bytes(random.Random(k).choices(range(256), k=3000)) for k in range(3)]
    assert b"".join(warc.inflate(b"".join(map(gzip.compress, parts)), 500)) == b"".join(parts)
    assert b"".join(warc.inflate(b"plain" * 100, 7)) == b"plain" * 100


# --- pipeline


def test_pipeline(spark, sf_dir, docs):
    from corpus_pipeline import STAGES, run

    state = docs
    for name, stage in STAGES[:-1]:
        out = stage(spark, state, sf_dir)
        assert out.columns == docs.columns, name
        state = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < state.count() <= docs.count()
    rows = run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in state.collect()}
    kept = {r["doc_id"] for r in state.collect() if words(r["text"])}
    assert {r["doc_id"] for r in rows} == kept
