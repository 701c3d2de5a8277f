"""Operators in DataFrame functions: mixing, quality rules, sharding, decontamination."""
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from mathtide.llm import decontaminate, mixing, quality_rules, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- mixing ---------------------------------------------------------------------------------------------------------------

def oracle(df, sql):
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(sql).fetchall()


def test_mix_matches_sql(documents_mid):
    got = mixing.mix(documents_mid).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(oracle(documents_mid, queries.OP4_SQL))


def test_mix_budgets(nasty):
    rows = mixing.mix(nasty).collect()
    assert len(rows) == nasty.count()
    total = sum(r["size"] for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(x[0]["target"] for x in by_source.values()) - 1.5 * total) < 1e-6
    for own in by_source.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert sum(r["taken"] for r in own) == int(own[0]["target"])


def test_targets_refill(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 1)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights a 3, b 1, c 2, null 3; 316.5 in all; a and null are held at 20 and 2, c at 200
    assert got == {"a": 20.0, None: 2.0, "c": 196.33333333333334, "b": 98.16666666666667}


def test_mix_same_at_any_partitioning(documents):
    one = sorted(map(tuple, mixing.mix(documents).collect()), key=repr)
    two = sorted(map(tuple, mixing.mix(documents.repartition(13)).collect()), key=repr)
    assert one == two


def test_taken_documents_hold_the_budget(documents):
    mixed = mixing.mix(documents)
    docs = mixing.taken_documents(documents, mixed.select("doc_id", "size", "taken"), ["doc_id"])
    assert docs.columns == documents.columns
    words = sum(len(WORD.findall(r["text"])) for r in docs.collect())
    assert words == mixed.agg(F.sum("taken")).first()[0]


def test_mix_empty(empty):
    assert mixing.mix(empty).count() == 0


# -- quality rules --------------------------------------------------------------------------------------------------------

def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_match_brute_force(documents_mid, nasty):
    for df in (documents_mid, nasty):
        got = sorted((tuple(r) for r in quality_rules.judge(df).select("doc_id", *COUNTS).collect()), key=repr)
        want = sorted(((r["doc_id"], *brute_statistics(r["text"])) for r in df.select("doc_id", "text").collect()), key=repr)
        assert got == want


def test_overlapping_repeats(spark):
    text = " ".join(["a b c d e f g h i"] * 3) + " x " + "a b c d e f g h"
    df = spark.createDataFrame([(1, text, "en", "s")], "doc_id int, text string, lang string, source string")
    got = quality_rules.judge(df).first()
    assert got["n_repeat_words"] == brute_statistics(text)[4]


def test_verdicts(documents_mid, labels):
    rows = quality_rules.judge(documents_mid).join(labels, "doc_id").collect()
    for r in rows:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.1 * len(junk)


def test_rules_empty(empty):
    assert quality_rules.judge(empty).count() == 0


# -- sharding -------------------------------------------------------------------------------------------------------------

def test_place_is_longest_first():
    got = dict(sharding.place([("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 2)], 2))
    loads = Counter()
    for name, size in (("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 2)):
        loads[got[name]] += size
    assert sorted(loads.values()) == [10, 11]


def test_shards(documents_mid):
    import zlib
    rows = sharding.shard(documents_mid).collect()
    texts = {r["doc_id"]: r["text"] for r in documents_mid.select("doc_id", "text").collect()}
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert len(rows) == len(texts) and len(loads) == 40
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= 1.02 * min(loads.values())


def test_shards_nasty(nasty, empty):
    rows = sharding.shard(nasty).collect()
    assert len(rows) == nasty.count()
    nothing = [r for r in rows if r["doc_id"] in (2, 3)]
    assert {(r["size"], r["text_crc32"]) for r in nothing} == {(16, 0)} and len({r["shard"] for r in nothing}) == 1
    assert sharding.shard(empty).count() == 0


# -- decontamination ------------------------------------------------------------------------------------------------------

def plain(text):
    return text.lower().translate(str.maketrans({c: " " for c in decontaminate.PUNCTUATION})).split()


def brute_leaks(docs, items):
    """All windows of the items' lengths by weighted Jaccard."""
    def grams(w):
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    found = {}
    for item, it in items.items():
        iw = plain(it)
        ig = grams(iw)
        if not ig:
            continue
        for doc, text in docs.items():
            w = plain(text or "")
            if not ({" ".join(g) for g in ig} & {" ".join(g) for g in grams(w)}):
                continue
            best = 0.0
            for s in range(max(1, len(w) - len(iw) + 1)):
                g = grams(w[s:s + len(iw)])
                both = sum((g & ig).values())
                best = max(best, both / max(sum((g | ig).values()), 1))
            if best >= 0.8:
                found[doc, item] = best
    return found


@pytest.fixture(scope="module")
def leaky(spark, documents):
    """Documents with whole, edited, shifted and repeated passages of items."""
    items = {r["item_id"]: r["text"] for r in
             spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12).collect()}
    base = [r["text"] for r in documents.orderBy("doc_id").limit(24).collect()]
    docs = {}
    for k, (item, text) in enumerate(items.items()):
        w = text.split()
        docs[1000 + k] = base[k] + "\n" + text + "\n" + base[k + 12]
        docs[2000 + k] = base[k] + " " + text.upper().replace(".", " !") + " " + base[k]
        docs[3000 + k] = base[k] + " " + " ".join(w[:-1] + ["changed"]) + " tail of words"
        docs[4000 + k] = base[k] + " " + " ".join(w[:2] + ["inserted"] + w[2:])
        docs[5000 + k] = base[k] + " " + " ".join(w[:len(w) // 2])
        docs[6000 + k] = " ".join(w[1:])
        docs[7000 + k] = text + " " + text
    docs[9000], docs[9001] = None, ""
    return docs, items


def test_leaks_match_brute_force(spark, leaky):
    docs, items = leaky
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    i = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(d, i).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_repeating_item(spark):
    """Weights count: a window with other multiplicities is less similar."""
    item = "a b c d e a b c d e a b c d e a b c d e"
    docs = {1: "x " + item + " y", 2: "a b c d e", 3: item.replace("a b c d e a b", "a b c q e a b", 1)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(d, i).collect()}
    assert got == set(brute_leaks(docs, {1: item, 4: "two words"}))


def test_leaks_nasty(spark, nasty, empty):
    i = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (None, "one")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.find(nasty, i).select("doc_id", "item_id").collect()), key=repr)
    assert got == [(1, 1), (5, None), (7, 1)]
    assert decontaminate.find(empty, i).count() == 0
    assert decontaminate.find(nasty, i.where("false")).count() == 0


def test_short_items_match_all_windows(spark):
    """Items of one to four words are found inside longer and shorter documents."""
    items = {1: "alpha", 2: "beta gamma", 3: "delta eps zeta", 4: "one two three four", 5: "five words are one shingle"}
    docs = {1: "a long text where Alpha stands, and beta gamma too; alpha again",
            2: "delta eps zeta", 3: "x one two three four y", 4: "beta x gamma", 5: "say beta gamma",
            6: "one two three", 7: None, 8: "here five words are one shingle and delta eps zeta", 9: "alphabet betas"}
    want = {}
    for d, text in docs.items():
        w = plain(text or "")
        for i, item in items.items():
            iw = plain(item)
            at = [s for s in range(len(w) - len(iw) + 1) if w[s:s + len(iw)] == iw]
            if at:
                want[d, i] = (1.0, 0, at[0])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    it = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.find(df, it).collect()}
    assert got == want and len(want) == 7


def test_leaks_under_null_and_repeated_ids(spark):
    """Every row's windows are verified, also where rows share an id and their
    windows of one length begin at the same word."""
    item = [f"w{i}" for i in range(20)]
    decoy = ["first", "words", *item[2:7], *[f"x{i}" for i in range(13)]]
    texts = [" ".join(decoy)] * 12 + [" ".join(item)] + [" ".join(decoy)] * 12
    i = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for at in (0, 12, 24):
        own = [t for t in texts if t != " ".join(item)]
        own.insert(at, " ".join(item))
        for k in (None, 7):
            d = spark.createDataFrame([(k, t) for t in own], "doc_id long, text string").coalesce(1)
            got = [tuple(r) for r in decontaminate.find(d, i).collect()]
            assert got == [(k, 1, 1.0, 0, 0)]


def test_no_python_on_native_paths(documents, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for df in (quality_rules.judge(documents), decontaminate.find(documents, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_least_hashed(spark):
    from mathtide.llm.common import least_hashed
    df = spark.range(0, 50_000)
    h = F.xxhash64("id")
    want = [r["id"] for r in df.orderBy(h, "id").limit(2000).collect()]
    assert [r["id"] for r in least_hashed(df, ["id"], 2000).collect()] == want
    assert least_hashed(df.where("id < 10"), ["id"], 2000).count() == 10
    assert least_hashed(df.where("id < 0"), ["id"], 2000).count() == 0
