"""Odd identifiers and columns, long texts, hot groups, and how work grows."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_corpus import brute_components

from lodestone.llm import common, decontam, exact_dedup, near_dup, packing, sharding, suffix_dedup, warc


def test_identifiers_of_any_type(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six"), ("c", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_membership(df, keep="max").collect()} == {("b", "b", True), ("a", "b", False), (None, "b", False), ("c", "c", True)}
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(df).collect()} == {"a", "c"}
    assert {r["doc_id"] for r in near_dup.near_dedup(df).collect()} == {"a", "c"}
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.near_components(df).collect()} == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c")}
    assert suffix_dedup.repeated_spans(df).count() == sharding.balanced_shards(df, 2).count() == 4
    dated = df.select(F.to_date(F.lit("2024-01-02")).alias("doc_id"), "text")
    assert exact_dedup.exact_dedup(dated).count() == 2


def test_repeated_rows_with_other_columns(spark):
    """Of rows with one identifier and text the same one stays, however they lie."""
    rows = [(1, "a b c d e f", f"v{k}", {"k": str(k)}) for k in range(20)]
    schema = "doc_id int, text string, row string, tie map<string,string>"
    kept = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(1 + seed)
        exact, near = exact_dedup.exact_dedup(df).collect(), near_dup.near_dedup(df).collect()
        assert len(exact) == len(near) == 1 and exact[0]["row"] == near[0]["row"]
        kept.add(exact[0]["row"])
    assert len(kept) == 1


def test_trie_spills_subtrees():
    rng = random.Random(7)
    keys = [bytes([rng.choice(b"abc")]) + bytes(rng.choices(b"xy", k=30)) for _ in range(600)]
    trie, given = exact_dedup.Trie(), []
    for n, k in enumerate(keys):
        trie.insert(k, "t", n, 1, n, 1, 1)
        if trie.held > 30_000:
            before = len(list(trie.terminals()))
            out = list(trie.spill(30_000))
            left = len(list(trie.terminals()))
            assert 0 < left < before and left + len(out) == before and trie.held <= 15_000
            # what went is whole subtrees: of each, all keys below its prefix
            given += out
    given += list(trie.terminals())
    assert Counter(k for k, t in given for _ in range(t[4])) == Counter(keys)
    trie = exact_dedup.Trie()
    for k in (b"aa", b"ab", b"b"):
        trie.insert(k, k, 1, 1, 1, 1, 1)
    assert sorted(k for k, _ in trie.spill(0, b"ab")) == [b"aa", b"b"] and [k for k, _ in trie.terminals()] == [b"ab"]


def weight_below(node):
    return len(node[0]) + (exact_dedup.NODE_BYTES if node[0] else 0) + sum(weight_below(x) for x in node[1].values())


def test_trie_weights():
    rng = random.Random(3)
    trie = exact_dedup.Trie()
    for n in range(500):
        trie.insert(bytes(rng.choices(b"ab", k=rng.randint(0, 9))), "t", n, 1, n, 1, 1)
    stack = [trie.root]
    while stack:
        node = stack.pop()
        assert node[3] == weight_below(node)
        stack += node[1].values()


def test_near_duplicates_give_out_no_pairs(spark, monkeypatch):
    """Members at 0.754 of one another, unlinked: rows grow with the family."""
    counted = {}
    plain = common.materialize

    def counting(df, label="stage"):
        out = plain(df, label)
        counted[label] = out.count()
        return out

    monkeypatch.setattr(near_dup, "materialize", counting)
    given = {}
    for members in (64, 128, 256):
        # 5-word sets of 796, of which 686 are common to all: 0.757 for every pair
        shared = [f"s{k}" for k in range(690)]
        rows = [(m, " ".join(shared + [f"m{m}x{k}" for k in range(110)])) for m in range(members)]
        got = near_dup.near_components(spark.createDataFrame(rows, "doc_id int, text string"), 5, 80)
        if members == 64:
            assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute_components(rows, 5, 80))
        given[members] = (counted["mixed"], counted["marked"], counted["links"])
    assert given[256][1] > 256  # the family does reach step 2
    assert given[128][0] <= 2.2 * given[64][0] and given[256][0] <= 2.2 * given[128][0]
    assert all(marked <= mixed and links == 0 for mixed, marked, links in given.values())


def test_near_duplicate_blocks_of_sizes(spark, monkeypatch):
    """Subsets at the very threshold, in many size classes and small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(2)
    rows = []
    for f in range(6):
        base = [f"f{f}w{k}" for k in range(60 + 90 * f)]
        for c in range(14):
            cut = rng.choice([1.0, 0.9, 0.81, 0.8, 0.79, 0.66])
            rows.append((len(rows), " ".join(base[: int(len(base) * cut)] + [f"z{rng.randint(0, 999)}" for _ in range(c % 3)])))
    got = near_dup.near_components(spark.createDataFrame(rows, "doc_id int, text string"), 4, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 4, 80))


def test_very_long_texts(spark):
    rng = random.Random(11)
    alphabet = "abcdefghijklmnopqrstuvwxyz     "
    passage = "".join(rng.choices(alphabet, k=700))
    long = "".join(rng.choices(alphabet, k=2_600_000))
    cut = suffix_dedup.PIECE
    long = long[: cut - 300] + passage + long[cut + 400 : 2 * cut + 5000] + passage + long[2 * cut + 5700 :]
    rows = [(1, long), (2, "short"), (3, long[:1_300_000] + " tail"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(df.where("doc_id != 3")).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"]) == (1400, 2, 0)
    kept = bytearray(long.encode())
    for s, e in ((2 * cut + 5000, 2 * cut + 5700), (cut - 300, cut + 400)):
        assert list(zip(got[1]["spans"][::2], got[1]["spans"][1::2], strict=True)).count((s, e)) == 1
        del kept[s:e]
    assert got[1]["kept_sha256"] == hashlib.sha256(bytes(kept)).hexdigest()
    near = {r["doc_id"]: r["component_id"] for r in near_dup.near_components(df.union(spark.createDataFrame([(9, long + " one more word")], df.schema))).collect()}
    assert near[9] == near[1] == 1 and near[3] == 3
    pieces = packing.pack(df.withColumn("source", F.lit("s"))).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {i: len(t.split()) for i, t in rows if t}


def test_decontamination_of_long_texts(spark):
    """Equal on all paths; a window row does not carry its document."""
    item = [f"b{k}" for k in range(12)]
    text = " ".join(w for k in range(3000) for w in ([*item, f"gap{k}"] if k % 2 else [f"own{k}"]))
    docs = spark.createDataFrame([(1, text), (2, "b1 b2")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "own4")], "item_id int, text string")
    expected = None
    for windows, keys in ((10**6, 0), (0, 10**6), (0, 0)):
        found = decontam.contamination(docs, bench, broadcast_windows=windows, broadcast_keys=keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any("words#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line) and "Python" not in plan
        rows = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["spans"]), r["items"]) for r in found.collect()}
        expected = expected or rows
        assert rows == expected
    assert expected == {1: (1500 * 13 + 1500, 1500 * 12 + 1, 1500, ["1", "2"]), 2: (2, 0, 0, [])}


def test_cut_words_keeps_the_rest(spark):
    item = "one two three four five six seven eight"
    text = f"\u0001 keep\u0001me, {item}! and\n\u0001{item} end "
    rows = [(1, text, ["x"], 5, "r"), (2, None, None, 6, "r"), (3, "\u0001", None, 7, "r"), (1, text, ["x"], 5, "r")]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans array<string>, row_key int, row string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = decontam.decontaminate(df, bench, remove="spans")
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] != 2) == [(1, "\u0001 keep\u0001me, and\n\u0001end ")] * 2 + [(3, "\u0001")]
    assert sorted(r["doc_id"] for r in decontam.decontaminate(df, bench).collect()) == [2, 3]


def test_groups_larger_than_a_shard(spark):
    """A group of two thirds of all bytes is spread; smaller ones are not cut, and sizes
    are equal."""
    rows = [(k, "hot text " * 12) for k in range(1600)] + [(2000 + k, f"pair {k // 2} " * 8) for k in range(120)] + [(4000 + k, f"alone {k} " * 10) for k in range(700)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id int, text string"), 8).collect()
    texts = dict(rows)
    load, where = Counter(), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(load.values()) / 8
    assert max(load.values()) - min(load.values()) <= 0.05 * mean
    hot = rows[0][1]
    least = -(-1600 * (len(hot) + 8) // mean)
    assert len(where[hot]) >= least
    cut = sum(len(v) > 1 for t, v in where.items() if t != hot)
    assert cut == 0  # of the 60 linked pairs none is cut


def test_archives_by_bytes_and_members(spark, tmp_path):
    rows = [(f"id {k}%", f"http://a/{k}", "<p>" + str(k) * 50 + "".join(random.Random(k).choices("abcdef", k=3000))) for k in range(60)]
    rows.append(("big", "http://a/big", "z" * (17 << 20)))
    df = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, archive_bytes=20_000)
    archives = [f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*"))]
    assert len(archives) > 4 and all(len(a) < 45_000 for a in archives)
    n = 0
    for a in archives:
        assert gzip.decompress(a)  # a plain gzip file
        for at, content in warc.members(a):
            records = list(warc.parse_warc(iter([content]))) if content else []
            n += len(records)
            assert len(records) <= 1 and list(warc.members(a[at:]))[0][1] == content
    got = {r["id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, path, "string").collect()}
    assert got == {i: html for i, _, html in rows} and n >= len(rows) + 1


@pytest.mark.parametrize("version", [1, 2])
def test_arc_folder(spark, tmp_path, version):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    bodies = {f"http://x/{k}": b"HTTP/1.0 200 OK\r\n\r\n" + b"body %d " % k * 200 for k in range(9)}
    records = [warc.arc_record(version, u, b, "19990102030405", "1.2.3.4") for u, b in bodies.items()]
    block = warc.arc_version_block(version)
    (tmp_path / "in" / "a.arc").write_bytes(block + b"".join(records[:3]))
    (tmp_path / "in" / "sub" / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, [block, *records[3:6]])))
    (tmp_path / "in" / "c.arc.gz").write_bytes(gzip.compress(block + b"".join(records[6:])))
    (tmp_path / "in" / "other.txt").write_bytes(b"no archive")
    got = warc.read_arc_files(spark, str(tmp_path / "in")).where("position > 0").collect()
    assert {r["url"]: bytes(r["body"]) for r in got} == bodies and {(r["version"], r["ip"], r["date"], r["truncated"]) for r in got} == {(version, "1.2.3.4", "19990102030405", False)}
    warc.convert_arc_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    found = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert {r["url"]: bytes(r["payload"]) for r in found} == {u: b.split(b"\r\n\r\n", 1)[1] for u, b in bodies.items()}
    assert {(r["record_type"], r["date"]) for r in found} == {("response", "1999-01-02T03:04:05Z")}


def test_intermediate_tables_go(spark, tmp_path, sf_dir, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = [near_dup.near_components(docs), suffix_dedup.repeated_spans(docs)]
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 2 and all(r.count() == docs.count() for r in results)
    for r in results:
        common.release(r)
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]
