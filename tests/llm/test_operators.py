"""The operators against plain versions, on small tables with odd rows: nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import classify, components, decontaminate, fingerprints, htmltext, labelled_pages, linededup, neighbours, packing, queries, setjoin, sharding, sstable, urlfilter
from lodestone.llm.tokens import Encoder, vocabulary_path
from lodestone.llm.words import ALNUM, NOT_SPACE, WordHasher
from tests.llm import brute

WORDS = "der die das and the of to in ich nicht Straße élan naïve one two three four five six seven".split()


def texts(n, seed, low=0, high=60):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(low, high))) for _ in range(n)]


def near(text, r):
    w = text.split(" ")
    w[r.randrange(len(w))] = "changed"
    return " ".join(w)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    base = texts(60, 1, 30, 90)
    out = [*base, *texts(20, 2, 0, 5), "", "   ", "\n\t", "one", "ONE", "x" * 3000, "long " * 5000]
    hub = base[0]
    for _ in range(40):
        hub = near(hub, r) if r.random() < 0.3 else hub
        out.append(near(hub, r))
    out += [base[1]] * 30
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(out)]
    return [*rows, (1000, None, None, None, None)]


def counted(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- words and tokens ------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA z\n\t\v\x1cé,.9'ß日"))))
def test_word_hashes(values):
    for allowed, pattern in ((NOT_SPACE, "[^\x20\x09-\x0d]+"), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        import re

        got = [w.tolist() for _, part in WordHasher(allowed).texts(pa.array(values, pa.string())) for w in part]
        want = [re.findall(pattern, brute.lower(v or "")) for v in values]
        assert [len(x) for x in got] == [len(x) for x in want]
        seen = {}
        for g, w in zip(got, want):
            for h, word in zip(g, w):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_word_hashes_of_slices_and_long_texts(monkeypatch):
    from lodestone.llm import words

    values = ["a b", None, "ab " * 3000 + "end", "c" * 9000 + " d", ""]
    whole = [w.tolist() for _, part in WordHasher(NOT_SPACE).texts(pa.array(values)) for w in part]
    monkeypatch.setattr(words, "PIECE", 1000)
    assert [w.tolist() for _, part in WordHasher(NOT_SPACE).texts(pa.array(values)) for w in part] == whole
    assert [w.tolist() for _, part in WordHasher(NOT_SPACE).texts(pa.array(["x", *values]).slice(1)) for w in part] == whole


ODD = ["a", "B", "'s", "'re", "'", "é", "É", "é", "Σ", "ς", "ﬁ", "<|endoftext|>", "<|", " ", "  ", "\x1c", "\x85", "　", "日", "1", "²", "!", "—", "😀", "İ", "ß", "ẞ", "×", "µ", "\t", "\n", "\x0b", "don't", "_", "‍", "ͅ", "the", "The,", "A.", "b,.", "I.", "K"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD)).map("".join))
def test_encoder_is_the_tokenizer(text):
    got = np.frombuffer(test_encoder_is_the_tokenizer.encoder.encode(text), "<u4").tolist()
    assert got == brute.ids(text)[:-1]


def test_long_texts_are_encoded_by_pieces(monkeypatch):
    from lodestone.llm import tokens

    monkeypatch.setattr(tokens, "PIECE", 40)
    values = ["a b", None, "", "word, " * 50 + "end", "x" * 300, "é " * 70, "one\ttwo\nthree"]
    ids, starts = tokens.Encoder(vocabulary_path()).encode_all(pa.array(["drop", *values]).slice(1), 2)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [brute.ids(v) for v in values]
    assert tokens.Encoder(vocabulary_path()).encode_all(pa.array([], pa.string()), 2)[1].tolist() == [0]
    column = pa.array([f"{v or ''} Word. WORD, ÉÉ. a.b, It's." for v in values] * 9, pa.large_string())
    for low in (0, 3, 20):  # parts of one buffer, again as a part of a record batch
        for part in (column.slice(low, 15), pa.RecordBatch.from_arrays([column], ["c"]).slice(low, 15).column(0)):
            ids, starts = tokens.Encoder(vocabulary_path()).encode_all(part, 2)
            assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [brute.ids(v) for v in part.to_pylist()]


test_encoder_is_the_tokenizer.encoder = Encoder(vocabulary_path(), most=50)


# --- 1 ---------------------------------------------------------------------------------------


def test_line_dedup(spark):
    line = "this is a line that many sites have"
    data = [(i, f"own text {i}\n{line}\nshort", "en", f"s{i}", 0) for i in range(12)]
    data += [(50 + i, "a line of one site only, many times", "en", "s1", 0) for i in range(30)]
    data += [(90 + i, f"{line}\na line that nine sites have, not ten", "en", f"s{i}", 0) for i in range(9)]
    data += [(200, None, None, None, None), (201, "", None, None, None), (202, line, None, None, None), (0, f"own text 0\n{line}\nshort", "en", "s0", 0)]
    out = linededup.remove_boilerplate(table(spark, data)).select("doc_id", "text", "__lines", "__removed").collect()
    assert len(out) == len(data)
    for r in out:
        if r.doc_id < 12:
            assert (r.text, r["__lines"], r["__removed"]) == (f"own text {r.doc_id}\nshort", 3, 1)
        elif 90 <= r.doc_id < 99:
            assert r.text == "a line that nine sites have, not ten"
        elif r.doc_id == 200:
            assert r.text is None and r["__lines"] == 0
        elif r.doc_id == 202:
            assert r.text == "" and r["__removed"] == 1
        else:
            assert r["__removed"] == 0
    assert linededup.remove_boilerplate(table(spark, data).limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "this is a line that many sites have"
    data = [(i, f"own {i}\n{line}", "en", f"s{i}", i) for i in range(11)]
    odd = table(spark, data).selectExpr("*", "doc_id + 1 AS __id", "doc_id + 2 AS `__hash`", "doc_id + 3 AS __gone", "'a' AS pos", "'b' AS h1", "'c' AS `odd.name`", "doc_id + 4 AS id")
    out = linededup.remove_boilerplate(odd)
    assert out.columns == [*odd.columns, "__lines", "__removed"]
    for r in out.collect():
        assert (r.text, r["__removed"], r["__id"], r["__hash"], r["__gone"], r.pos, r.h1, r["odd.name"], r.id) == (f"own {r.doc_id}", 1, r.doc_id + 1, r.doc_id + 2, r.doc_id + 3, "a", "b", "c", r.doc_id + 4)
    with pytest.raises(ValueError):
        linededup.remove_boilerplate(odd.withColumn("__LINES", F.lit(1)))


# --- 2 ---------------------------------------------------------------------------------------

URLS = ["http://www.Example.com/en/1?x=/en/", "https://EXAMPLE.com/en/", "http://a.b.example.com/en", "http://x.net/es/1#a", "http://net/fr/", "http://y.net/de/", "http://z.com", "http://z.com/", "http://notexample.com/en/", None, "", "no scheme", "://", "http://", "ftp://a.com:80/en/", "http://x.net/es", "http://www.example.com.net/fr/q", "http://z.com?u=http://net/es/", "x://a.com/b://c.net/es/", "http://b.com/\nline"]


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    import re

    host = brute.lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_filter(spark):
    more = [*urlfilter.RULES, ("b.example.com", "", "block"), ("COM", "/en/", "block")]
    for rules in (urlfilter.RULES, more, more[:1], [("a.com", "/", "allow"), ("a.com", "/", "block")], []):
        df = spark.createDataFrame([*enumerate(URLS), (0, URLS[0])], "page_id long, url string")
        got = counted(urlfilter.judge(df, rules), ["page_id", "host", "path", "rule", "verdict"])
        low = [(brute.lower(h), p, v) for h, p, v in rules]
        low = [(h, p, "block" if (h, p, "block") in low else v) for h, p, v in low]
        assert got == Counter((i, *plain_judge(u, low)) for i, u in [*enumerate(URLS), (0, URLS[0])])
    assert urlfilter.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(df, [("", "/", "block")])


def test_hosts_of_many_labels(spark):
    import time

    url = "http://" + "a." * 100_000 + "example.com/en/x"
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    urlfilter.judge(df).collect()
    began = time.perf_counter()
    assert urlfilter.judge(df).first()["rule"] == "example.com/en/"
    assert time.perf_counter() - began < 6  # several Spark jobs


@pytest.mark.parametrize("many", [5, 700])
def test_cascade_is_exact_over_its_universe(spark, many):
    r = spark.range(200_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("k"), "id").alias("h2")).toPandas()
    h1, h2 = r.h1.to_numpy(), r.h2.to_numpy()
    taken = lambda first: (h1[many:][(x := first.has(h1[many:], h2[many:], 0))], h2[many:][x])
    cascade = urlfilter.build_cascade((h1[:many], h2[:many]), len(h1) - many, taken)
    assert np.array_equal(cascade.has(h1, h2), np.arange(len(h1)) < many)
    assert len(cascade.levels) <= 3 and cascade.size() <= 16 + 3 * many
    tight = urlfilter.build_cascade((h1[:many], h2[:many]), 1, taken)  # a count that is much too low costs levels, not truth
    assert np.array_equal(tight.has(h1, h2), np.arange(len(h1)) < many)


# --- 3 ---------------------------------------------------------------------------------------


def test_sharding(spark, corpus):
    data = [*corpus, corpus[3], corpus[3], (None, "no id", None, None, None)]
    first = sharding.SlotMap.initial(40)
    out = sharding.place(table(spark, data), first, first.grown()).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.shard == first.owner[r.virtual_slot]
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    where = {r.doc_id: (r.shard, r.grown_shard) for r in out}
    some = sharding.place(table(spark, data[::3]), first, first.grown()).collect()
    assert all(where[r.doc_id] == (r.shard, r.grown_shard) for r in some)
    assert sharding.place(table(spark, data).limit(0), first, first.grown()).count() == 0


def test_slot_maps(spark, tmp_path):
    m = sharding.SlotMap.initial(40)
    grown = m.grown()
    moved = m.moved(grown)
    assert abs(len(moved) - sharding.SLOTS / 41) < 41 and all(grown.owner[s] == 40 for s in moved)
    per = Counter(grown.owner)
    assert max(per.values()) - min(per.values()) <= 10
    weight = {s: 1000 if s % 40 == 3 else 10 for s in range(sharding.SLOTS)}
    even = m.rebalanced(weight)
    load = Counter()
    for s, x in enumerate(even.owner):
        load[x] += weight[s]
    assert max(load.values()) - min(load.values()) <= 1000  # no more than a slot holds; it was 205,000
    assert (even.version, grown.version) == (2, 2)
    even.save(spark, f"{tmp_path}/maps")
    assert sharding.SlotMap.load(spark, f"{tmp_path}/maps", 2) == even
    slots = sharding.slot_bytes(spark.createDataFrame([(1, "ab"), (1, None)], "doc_id long, text string")).collect()
    assert [(r.rows, r.bytes) for r in slots] == [(2, 34)]


def test_query_places_by_stored_maps(spark, tmp_path, monkeypatch):
    """With other owners in the stored maps, rows go where these say."""
    table(spark, [(i, f"text {i}", None, None, None) for i in range(50)]).write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{tmp_path}/maps"
    monkeypatch.setattr(queries, "new_path", lambda spark, name: folder)
    plain = queries.op3_sharding(spark, str(tmp_path)).collect()
    first = sharding.SlotMap.initial(40)
    assert [sharding.SlotMap.load(spark, folder, v) for v in (1, 2)] == [first, first.grown()]
    assert {(r.virtual_slot, r.shard, r.grown_shard) for r in plain} == {(r.virtual_slot, first.owner[r.virtual_slot], first.grown().owner[r.virtual_slot]) for r in plain}
    load = sharding.SlotMap.load
    monkeypatch.setattr(queries, "new_path", lambda spark, name: f"{folder}2")
    monkeypatch.setattr(sharding.SlotMap, "load", classmethod(lambda cls, *a: cls(a[2], 41, tuple(40 - x for x in load(*a).owner))))
    turned = queries.op3_sharding(spark, str(tmp_path)).collect()
    assert {(r.doc_id, 40 - r.shard, 40 - r.grown_shard) for r in turned} == {(r.doc_id, r.shard, r.grown_shard) for r in plain}


# --- 4 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60), (1, 50)])
def test_set_join(spark, corpus, k, percent):
    data = [*corpus, corpus[3], (None, corpus[3][1], None, None, None), (2000, corpus[2][1].upper(), None, None, None)]
    df = table(spark, data).withColumn("cls", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("h", F.lit(0))
    got = counted(setjoin.join(df, k, percent), ["doc_id", "n_shingles", "component_id"])
    assert got == Counter(brute.jaccard_components([(d, t) for d, t, *_ in data], k, percent))


@pytest.mark.parametrize("sizes", [{"HOT": 2, "CELL": 4, "PIVOTS": 2}, {"HOT": 2, "CELL": 4, "PIVOTS": 0, "MOST_SENT": 0}, {"HOT": 10**9, "CELL": 2, "PIVOTS": 1}, {"MOST_HOT": 3, "HOT": 2, "CELL": 8}, {"NARROW": 1, "WIDE": 1, "LEAST_BITS": 64}, {"LEAVES": 3, "CELL": 4, "HOT": 10**9, "FANOUT": 2}])
def test_set_join_by_cells(spark, corpus, monkeypatch, sizes):
    """The ways for frequent tokens and large blocks, forced on a small table."""
    for name, value in sizes.items():
        monkeypatch.setattr(setjoin, name, value)
    got = counted(setjoin.join(table(spark, corpus), 3, 70), ["doc_id", "n_shingles", "component_id"])
    assert got == Counter(brute.jaccard_components([(d, t) for d, t, *_ in corpus], 3, 70))


def test_set_join_of_nothing(spark, corpus):
    assert setjoin.join(table(spark, corpus).limit(0)).count() == 0
    assert counted(setjoin.join(table(spark, [(1, None, None, None, None), (2, "", None, None, None)])), ["doc_id", "n_shingles", "component_id"]) == Counter([(1, 0, 1), (2, 0, 2)])


def test_keep_one(spark, corpus):
    data = [*corpus, corpus[3], corpus[-1]]
    kept = [r.doc_id for r in setjoin.keep_one(table(spark, data), 5, 80).collect()]
    least = {d for d, n, c in brute.jaccard_components([(d, t) for d, t, *_ in data], 5, 80) if c == d}
    assert set(kept) == least
    assert kept.count(3) == 1 and kept.count(1000) == 2  # empty sets are linked with nothing


def test_keep_one_keeps_columns_of_any_name(spark):
    text = " ".join(WORDS)
    docs = spark.createDataFrame([(1, text, 11, 21, 31), (2, text, 12, 22, 32), (2, text, 13, 23, 33), (3, "other words", 14, 24, 34)], "doc_id long, text string, __id int, __h int, h int")
    out = setjoin.keep_one(docs)
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {(11, 21, 31), (14, 24, 34)}


def test_trees_find_what_pairs_find():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64)) for _ in range(40)]
    sets = {}
    for i in range(160):
        s = base[i % 40]
        sets[i] = s if i < 40 else np.unique(np.concatenate([s[r.random(len(s)) > 0.04 * r.random()], r.integers(0, 2**63, 1 + int(len(s) * 0.05 * r.random())).astype(np.uint64)]))
    near = {i: {j for j in sets if i != j and setjoin.reaches(sets[i], sets[j], 85)} for i in sets}
    for per_token, exact in ((2, False), (8, True)):
        left = [(0, i, len(s), setjoin.bitmap(s, per_token), None) for i, s in sets.items()]
        for side in (None, [x for x in left if x[1] % 2]):
            leaves = setjoin.Leaves(85)
            leaves.sets = sets if exact else {}
            setjoin.tree_pairs(left, side, leaves)
            for i in sets:
                for j in near[i] & {x[1] for x in side or left}:
                    assert leaves.groups.root(i) == leaves.groups.root(j)
            if exact:
                assert all(b in near[a] for a, b in leaves.groups.links)
        # several blocks in one tree: leaves meet within their block only
        leaves = setjoin.Leaves(85)
        leaves.sets = {(i % 3, i): s for i, s in sets.items()} if exact else {}
        setjoin.tree_pairs([(i % 3, (i % 3, i), len(s), setjoin.bitmap(s, per_token), None) for i, s in sets.items()], None, leaves)
        assert all(a[0] == b[0] for a, b in leaves.groups.links)
        for i in sets:
            for j in near[i]:
                assert i % 3 != j % 3 or leaves.groups.root((i % 3, i)) == leaves.groups.root((j % 3, j))
        assert sum(leaves.left.values()) < sum(leaves.asked.values()) < len(sets) ** 2 / 2


@pytest.mark.parametrize("at_once", [1 << 20, 0])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7), (-5, 100)]
    got = dict(counted(components.components(spark.createDataFrame(links, "a long, b long")), ["node", "root"]))
    want = {i: 0 for i in range(41)} | {x: -5 for x in (-5, 100, 200, 300)}
    assert got == {(k, v): 1 for k, v in want.items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent, low, high", [(40, 64, 160), (40, 100, 250), (25, 64, 256), (20, 60, 300)])
def test_sets_of_very_different_sizes_link(spark, percent, low, high):
    words = [f"w{i}" for i in range(high)]
    docs = [(1, " ".join(words[:low])), (2, " ".join(words)), (3, " ".join(words[: low - 1])), (4, " ".join(f"v{i}" for i in range(high)))]
    sets = {d: np.unique(np.array([hash(w) & (2**63 - 1) for w in t.split()], np.uint64)) for d, t in docs}
    for right in (None, 2, 1):
        left = {d: (0, d, len(s), setjoin.bitmap(s, 2), None) for d, s in sets.items()}
        side = None if right is None else [left.pop(right)]
        left = [*left.values()]
        leaves = setjoin.Leaves(percent)
        setjoin.tree_pairs(left, side, leaves)
        assert leaves.groups.root(1) == leaves.groups.root(2)
    got = counted(setjoin.join(spark.createDataFrame([d for d in docs if d[0] != 3], "doc_id long, text string"), 1, percent), ["doc_id", "n_shingles", "component_id"])
    assert got == Counter(brute.jaccard_components([d for d in docs if d[0] != 3], 1, percent))
    assert got[(2, high, 1)] == 1


@pytest.mark.parametrize("percent", [0, 100])
def test_no_other_thresholds(spark, percent):
    with pytest.raises(ValueError):
        setjoin.join(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1, percent)


# --- 5 ---------------------------------------------------------------------------------------


def test_sstable(spark, corpus, tmp_path):
    df = table(spark, corpus)
    got = counted(sstable.write_and_read(df), ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert got == Counter(brute.sstable([(d, t) for d, t, *_ in corpus]))
    folder = f"file://{tmp_path}/shards"
    shards = sstable.write(df, folder, shard_bytes=2000, block_bytes=500)
    assert shards.count() > 5
    assert counted(sstable.read(spark, folder, shards), ["doc_id", "start", "n_tokens", "ids_crc32"]) == got
    for d, t, *_ in corpus[::17]:
        assert sstable.lookup(spark, folder, shards, d) == brute.ids(t)
    assert sstable.lookup(spark, folder, shards, 999_999) is None
    assert sstable.write_and_read(df.limit(0)).count() == 0


def test_sstable_repeated_and_missing_ids(spark, tmp_path):
    data = [(5, "b"), (5, "b"), (5, "a"), (None, "n"), (-3, "x"), (-(1 << 63), "least"), ((1 << 63) - 1, "greatest")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = sstable.write_and_read(df).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -(1 << 63), -3, 5, 5, 5, (1 << 63) - 1]
    folder = f"file://{tmp_path}/shards"
    shards = sstable.write(df, folder, shard_bytes=1)
    for k, t in [(None, "n"), (-(1 << 63), "least"), ((1 << 63) - 1, "greatest"), (-3, "x")]:
        assert sstable.lookup(spark, folder, shards, k) == brute.ids(t)
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 2**32 - 1), max_size=40)), max_size=60), st.integers(1, 400))
def test_shard_round_trip(entries, block):
    entries.sort(key=lambda x: x[0])
    w = sstable.ShardWriter(block)
    for k, ids in entries:
        w.add(k, np.array(ids, "<u4").tobytes())
    data = w.finish()
    shard = sstable.Shard.of(data)
    assert [(k, x.tolist()) for k, x in shard.items()] == entries
    first = {}
    for k, ids in entries:
        first.setdefault(k, ids)
    for k, ids in first.items():
        assert shard.get(k) == ids
    assert (shard.entries, shard.tokens) == (len(entries), sum(len(x) for _, x in entries))
    absent = [k + 1 for k in first if k + 1 not in first and k < 2**63 - 1]
    assert all(shard.get(k) is None for k in absent)


def test_a_lookup_reads_one_block():
    w = sstable.ShardWriter(200)
    for k in range(2000):
        w.add(k, np.arange(20, dtype="<u4").tobytes())
    data, read = w.finish(), []

    def fetch(offset, length):
        read.append(length)
        return data[offset : offset + length]

    shard = sstable.Shard(fetch, len(data))
    known = sum(read)
    assert shard.get(777) == list(range(20)) and len(read) <= 4 and sum(read) - known < 600


def test_damage_is_seen():
    w = sstable.ShardWriter()
    w.add(1, np.arange(10, dtype="<u4").tobytes())
    data = bytearray(w.finish())
    for at in (3, len(data) - 60, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(sstable.Shard.of(bytes(bad)).items())
    with pytest.raises(ValueError):
        sstable.Shard.of(b"short")


# --- 6 ---------------------------------------------------------------------------------------


def test_classifier(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(60))
    bad = lambda: " ".join(r.choice(WORDS) + "***" for _ in range(60))
    data = [(i, good() if i % 2 else bad(), None, None, None) for i in range(400)]
    labels = [(i, i % 2) for i in range(400)] + [(1, None), (2, 7), (None, 1), (9999, 1)]
    docs = table(spark, [*data, (5000, None, None, None, None), (5001, "", None, None, None)])
    model = classify.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
    out = {r.doc_id: r for r in classify.score(docs, model, keep=["doc_id"]).withColumn("held", classify.held_out(F.col("doc_id"))).collect()}
    assert len(out) == 402
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(out[d].held == (d in held) for d in range(400))
    assert np.mean([(out[d].score >= 0.5) == (d % 2 == 1) for d in held]) > 0.97
    assert out[5000].score == out[5001].score and 0 <= out[5000].score <= 1
    empty = classify.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert {r.score for r in classify.score(docs, empty, keep=["doc_id"]).collect()} == {0.5}
    with pytest.raises(ValueError):
        classify.score(docs.withColumn("score", F.lit(1)), model)


def test_features_are_those_of_a_plain_count():
    """The same n-grams have the same numbers, and (but for rare collisions) different ones different numbers."""
    values = [*texts(60, 3, 0, 40), "A b. A a a", "x1 Xy ÉÉ 'q' a--", "", "one One ONE"]
    seen, made = {}, classify.Features()
    for v, words in zip(values, made.texts(pa.array(values))):
        want = brute.quality_features(v)
        got = made.index(words).tolist()
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert seen.setdefault(w, g) == g
    assert len(set(seen.values())) > 0.98 * len(seen)


def test_updates_are_those_of_a_plain_loop():
    r = np.random.default_rng(2)
    data = [(int(r.integers(2)), np.unique(r.integers(0, 64, r.integers(0, 12)))) for _ in range(50)]
    data = [(y, at, r.random(len(at)) * 3) for y, at in data]
    for order in (lambda e: data, lambda e: data[e::2] + data[1 - e % 2 :: 2]):
        w, bias = classify.train(order, bits=6, epochs=2, alpha=0.3, beta=1.0, l1=0.05, l2=1e-4)
        want, b = brute.ftrl(lambda e: [(y, dict(zip(at.tolist(), x.tolist()))) for y, at, x in order(e)], 2, 0.3, 1.0, 0.05, 1e-4)
        assert bias == pytest.approx(b) and all(w[i] == pytest.approx(want.get(i, 0.0)) for i in range(64))


def test_fitting_takes_texts_in_an_order_of_their_own(spark, monkeypatch):
    """However rows are dealt; repeated rows count once, and no more than `most` are taken."""
    data = [(i % 40, f"{WORDS[i % 7]} {WORDS[i % 5]} {i % 44}", None, None, None) for i in range(130)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(3, 0)], "doc_id long, quality int")
    models = [classify.fit(table(spark, rows).repartition(n), labels, "quality") for rows, n in ((data, 1), (data[::-1] + data[:30], 3))]
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1] and np.any(models[0][0])
    seen = []
    monkeypatch.setattr(classify, "train", lambda examples: seen.append(len(list(examples(0)))))
    monkeypatch.setattr(classify, "PART_BYTES", 100)
    classify.fit(table(spark, data), labels, "quality", most=9)
    assert seen == [9]


# --- 7 ---------------------------------------------------------------------------------------


def test_packing(spark, corpus):
    data = [*corpus, (7000, " ".join(texts(400, 9, 20, 40)), None, None, None)]
    out = packing.pack(table(spark, data)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and len(r.ids) == r.length
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    lengths = [r.length for r in sorted(out, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for d, t, *_ in data:
        ids, at = brute.ids(t), 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids == ids[at : at + r.length] and r.ids_crc32 == brute.crc(r.ids)
            at += r.length
        assert at == len(ids)
    assert packing.pack(table(spark, data).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table(spark, data), longest=100)


@given(st.integers(0, 10**6), st.integers(0, 13))
def test_binary_lengths(n, b):
    x = packing.binary_lengths(n, 1 << b)
    assert sum(x) == n and all(v & (v - 1) == 0 and v <= 1 << b for v in x) and x == sorted(x, reverse=True)


# --- 8 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def page_model():
    return htmltext.train(labelled_pages.pages())


def right_share(model, pages):
    """Share of the characters that are put on the right side."""
    right = total = 0
    for source in pages:
        page = htmltext.Page(source)
        for y, odds, own in zip(htmltext.labels(page), model.log_odds(page), page.own):
            total += own
            right += own * ((odds > 0) == (y == 1))
    assert total > 1000
    return right / total


def test_page_model_on_held_out_pages(page_model):
    assert right_share(page_model, labelled_pages.pages(30, None, 1000)) > 0.97


@pytest.mark.parametrize("family", ["semantic", "named", "unknown", "plain", "wrapped", "table", "encyclopedia"])
def test_page_model_on_a_layout_it_never_saw(family):
    """Text and links carry the decision, not names. (Pages without any box around the text need to have been seen.)"""
    model = htmltext.train(labelled_pages.pages(100, [f for f in labelled_pages.FAMILIES if f != family]))
    assert right_share(model, labelled_pages.pages(60, [family], 1000)) > 0.96


ARTICLE = "<h1>Tea time</h1><p>One two three four.</p><p>Five six, seven eight nine. More words follow here.</p>"
ITS_TEXT = "Tea time One two three four. Five six, seven eight nine. More words follow here."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About</a></li></ul>"
LAYOUTS = {
    "fragment": ARTICLE, "bare body": f"<html><body>{ARTICLE}</body></html>", "bare body with furniture": f"<body><nav>{MENU}</nav>{ARTICLE}<footer>&copy; me</footer></body>",
    "plain div": f"<body><div>{ARTICLE}</div></body>", "unknown name": f"<body><div class='zq9'>{ARTICLE}</div></body>", "unknown names": f"<body><div class='xk'>{MENU}</div><div class='zq9'>{ARTICLE}</div><div class=bb>Copyright 2020 me</div></body>",
    "wiki": f"<body><div id='content'><div id='bodyContent'>{ARTICLE}</div></div></body>", "wiki alone": f"<body><div id='bodyContent'>{ARTICLE}</div></body>",
    "table": f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a><br><a href=/a>About</a></td><td>{ARTICLE}</td></tr></table></body>",
    "svg in svg": ARTICLE.replace("<p>Five", "<svg><svg><text>in</text></svg><text>no</text></svg><p>Five"),
    **{f"unended {t} in {box}": f"<body><nav>{MENU}</nav><{box}>{ARTICLE.replace('<p>Five', f'<{t}><p>Five')}</{box}><footer>&copy; me</footer></body>" for t in ("svg", "object", "select", "video", "audio", "iframe", "canvas") for box in ("article", "div")},
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(page_model, name):
    assert page_model.text(LAYOUTS[name]) == ITS_TEXT


def test_an_ended_player_after_an_unended_one(page_model):
    assert page_model.text(f"<article><video>{ARTICLE}<video>no player here</video></article>") == ITS_TEXT


def test_reading_takes_time_in_proportion():
    import time

    for source in ("<b>{}</i>{}", "<div>{}</p>{}", "<li><b>{}<p>{}", "<i>{}</b>{}", "<svg>{}<div>{}"):
        a, b = source.format(" ", " ").split(" ")[:2]
        began = time.perf_counter()
        htmltext.Page(a * 40_000 + b * 40_000)
        assert time.perf_counter() - began < 6


def test_text_by_all_labellings(page_model):
    """The whole extraction of small pages, with marginals summed over all labellings."""
    import html as h
    import itertools
    import math
    import re

    for source in ("<div class=ad>x y</div><p>one &amp; two</p>", "<nav><a>home</a></nav><article>a<b>b</b> <p>c &lt; d</article>", "<div><p>One, two.</p><select><option>x</select></div>t"):
        page = htmltext.Page(source)
        own = [sum(page_model.weights.get(f, 0.0) for f in htmltext.features(s)) for s in htmltext.signatures(page)]
        main = [0.0] * len(own)
        for ys in itertools.product((0, 1), repeat=len(own)):
            p = math.exp(sum(w for w, y in zip(own, ys) if y)) * math.prod(page_model.edges.get(t, page_model.edges["*"])[2 * ys[up] + y] for t, up, y in [*zip(page.tag, page.parent, ys)][1:])
            main = [m + (p if y else -p) for m, y in zip(main, ys)]
        blocks = [""]
        for k, text in page.texts:
            blocks = [*blocks, ""] if k < 0 else [*blocks[:-1], blocks[-1] + text * (main[k] > 0)]
        want = " ".join(x for b in blocks for x in re.split(r"\s+", h.unescape(b)) if x)
        assert page_model.text(source) == want


PAGES = [
    ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Tea &amp; time</h1><p>One  two\n<b>three</b>four.<br>five<p>six</article><footer>&copy; me</footer>", "Tea & time One two threefour. five six"),
    ("<body><div class=\"ad\">Buy</div><article><p>a &lt;b&gt; &amp;amp;</p><script>x</script><style>p{}</style><!-- c --><div class='comments'><p>bad</p></div><form><input> go</form></article>", "a <b> &amp;"),
    ("<article><p>cut off <b", "cut off"), ("<article><p>a < b and c</p></article>", "a < b and c"), ("", ""), (None, ""), ("<nav>x</nav>", ""),
]


def test_extraction(spark, page_model):
    data = [(i, f"u{i}", h, None) for i, (h, _) in enumerate(PAGES)]
    out = htmltext.extract(spark.createDataFrame(data, "page_id long, url string, html string, text2 string"), page_model, keep=["page_id", "url"])
    assert {r.page_id: r.text for r in out.collect()} == {i: t for i, (_, t) in enumerate(PAGES)}


EMBEDDED = [
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", "Let x=1 be"),
    ("<article><p>Let <math><mi>x</mi><mspace/> be given</p><p>then more</p></article>", "Let x be given then more"),
    *((f"<article><p>one two three four</p><{t}><p>five six seven eight</p><h2>nine</h2></article>", "one two three four five six seven eight nine") for t in ("svg", "math", "select", "object", "video", "audio", "canvas", "iframe", "noscript", "template")),
    *((f"<article><p>one two {open}</p><h2>Three</h2><p>four five six</p></article><footer>&copy; me</footer>", "one two Three four five six") for open in ("<svg>", "<svg><g><path d='m'/><title>", "<math>", "<select>", "<object>", "<video>", "<iframe>")),
    ("<article><p>one</p><svg><foreignObject><p>two</p></foreignObject><circle/></svg><p>three</p></article>", "one two three"),
    ("<article><p>one</p><script>if (a) { '<p>no</p>' }</script><p>two</p><style>p{}</style><textarea>no</textarea></article>", "one two"),
    ("<article><p>one two three</p><form><select><option>Choose one</select></form><p>four five six</p></article>", "one two three four five six"),
]


@pytest.mark.parametrize("source, text", EMBEDDED)
def test_embedded_elements_lose_no_text(page_model, source, text):
    assert page_model.text(source) == text


def test_messages_give_exact_marginals(page_model):
    """Against all labellings of a small tree."""
    import itertools
    import math

    page = htmltext.Page("<body><div class=ad><p>x y</p></div><article><p>main <b>text</b></p></article>")
    own = [sum(page_model.weights.get(f, 0.0) for f in htmltext.features(s)) for s in htmltext.signatures(page)]
    own = [max(-30.0, min(30.0, x)) for x in own]
    n = len(own)
    sums = [[0.0, 0.0] for _ in range(n)]
    for ys in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(w for w, y in zip(own, ys) if y))
        for k in range(1, n):
            p *= page_model.edges.get(page.tag[k], page_model.edges["*"])[2 * ys[page.parent[k]] + ys[k]]
        for k, y in enumerate(ys):
            sums[k][y] += p
    for k, odds in enumerate(page_model.log_odds(page)):
        assert odds == pytest.approx(math.log(sums[k][1] / sums[k][0]), abs=1e-6)


# --- 9 ---------------------------------------------------------------------------------------


def test_fingerprints(spark):
    data = ["Straße", "STRASSE", " strasse\n", "ﬁn", "fin", "café", "café", "a  b", "a b", "ab", "", None, "   ", "Σας", "σασ", "①", "1"]
    rows = spark.createDataFrame([*enumerate(data), (0, data[0])], "doc_id int, text string")
    found = {}
    for r in fingerprints.fingerprint(rows.withColumn("h1", F.lit("clash"))).collect():
        found.setdefault(r.fingerprint, set()).add(r.doc_id)
    want = {}
    for i, t in enumerate(data):
        want.setdefault(brute.canonical(t), set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert fingerprints.fingerprint(rows.limit(0)).count() == 0


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "hashes", lambda canon: [F.length(canon).cast("long"), F.lit(0).cast("long")])
    rows = spark.createDataFrame([*enumerate(["aa", "bb", "cc", "AA", "d"])], "doc_id int, text string")
    out = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(rows).collect()}
    assert out[0] == out[3] and len({out[0], out[1], out[2], out[4]}) == 4


def test_edited(spark, corpus):
    data = [(d, t) for d, t, *_ in corpus]
    out = neighbours.edited_fingerprints(table(spark, corpus).withColumn("k", F.lit("clash")))
    assert counted(out, ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]) == Counter(brute.edited(data))
    one = neighbours.edited_fingerprints(table(spark, [(5, "abcdef", None, None, None)])).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    assert neighbours.edited_fingerprints(table(spark, corpus).limit(0)).count() == 0
    odd = table(spark, [(None, "z", None, None, None), (1, "b", None, None, None), (1, None, None, None, None), (1, "a", None, None, None)])
    assert neighbours.edited_fingerprints(odd).count() == 4


def test_ranges_split_rows_of_one_id(spark):
    """Rows without ids, or of one id, go to many ranges; each has the next of its order all the same."""
    data = [(None, f"text {i}", None, None, None) for i in range(150)] + [(7, f"more {i}", None, None, None) for i in range(150)] + [(i, f"own {i}", None, None, None) for i in range(60)]
    rows = neighbours.placed(table(spark, data), "doc_id", "text")
    bounds = neighbours._bounds(rows)
    assert len(bounds) == 3
    out = neighbours.with_next(rows, ["text"], lambda df: df).collect()
    order = sorted(rows.collect(), key=lambda r: (r.none, r.nk, r.th))
    assert {r.text: r.next_text for r in out} == {a.text: b.text for a, b in zip(order, [*order[1:], order[0]])}
    ranges = rows.select(neighbours._range_of(F.struct(*neighbours.PLACE), bounds).alias("r"), "none", "nk").distinct().collect()
    assert len({r.r for r in ranges}) == 4 and len({r.r for r in ranges if r.none}) >= 2
    many = sorted({(False, i, j) for i in range(40) for j in (-5, 5)})
    keys = spark.createDataFrame([(False, i, j) for i in range(-1, 42) for j in (-9, -5, 0, 5, 9)], "none boolean, nk long, th long")
    assert all(r.r == sum(b < (r.none, r.nk, r.th) for b in many) for r in keys.withColumn("r", neighbours._range_of(F.struct("none", "nk", "th"), many)).collect())


# --- 10 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_items_without_ids_hit(spark, tmp_path, block):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(None, item), (None, "short item"), (7, "a short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "a short item"), (3, "nothing"), (4, "the short item")], "doc_id long, text string")
    out = decontaminate.find_hits(docs, items, keep=["doc_id"], block_bytes=block, unnamed=True).select("doc_id", decontaminate.hit_words().alias("n"), "items")
    assert {r.doc_id: (r.n, r["items"]) for r in out.collect()} == {1: (11, []), 2: (3, ["7"]), 3: (0, []), 4: (2, [])}
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()] == [3]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, block):
    r = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    run = lambda n: [r.choice(pool) for _ in range(n)]
    items = [(i, " ".join(run(r.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(25)] + [(90, None), (91, "..."), (None, "w1"), (92, "Same same SAME same same same same same same same same")]
    items.append((93, items[-1][1]))
    docs = []
    for i in range(80):
        w = run(r.randint(0, 80))
        _, t = items[r.randrange(25)]
        cut = t.split(" ")
        a = r.randint(0, len(cut))
        docs.append((i, "; ".join([*w[:20], *cut[a : a + r.randint(5, 20)], *w[20:]]).upper()))
    docs += [(100, None), (101, ""), (102, "same " * 40), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hits = decontaminate.find_hits(df, spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id", "text"], block_bytes=block)
    n = decontaminate.hit_words()
    out = hits.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("sha"), (n > 0).alias("c"))
    assert counted(out, out.columns) == Counter(brute.decontamination(docs, items))
    none = decontaminate.find_hits(df, spark.createDataFrame([], "item_id long, text string"), keep=["doc_id"])
    assert none.where(F.size("items") > 0).count() == 0 and none.count() == len(docs)


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_rows_keep_their_own_hits_in_any_number_of_blocks(spark, block):
    """Rows of one id, equal rows, null ids and columns called like the operator's own."""
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    docs = [(1, f"q {a}", 1), (1, f"{b} q r", 2), (1, "clean", 3), (1, "clean", 4), (None, f"{a} {b}", 5), (None, None, 6), (1, f"q {a}", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row int").withColumn("kept", F.lit("x"))
    items = spark.createDataFrame([("A", a), ("B", b), ("C", "clean")], "item_id string, text string")
    for keep in (["doc_id"], ["row", "kept", "text"], []):
        out = decontaminate.find_hits(df, items, keep=keep, block_bytes=block)
        assert out.columns == [*keep, "n_words", "hit_starts", "hit_ends", "items"]
        want = Counter([(13, (1,), (13,), ("A",)), (14, (0,), (12,), ("B",)), (1, (0,), (1,), ("C",)), (1, (0,), (1,), ("C",)), (24, (0,), (24,), ("A", "B")), (0, (), (), ()), (13, (1,), (13,), ("A",))])
        assert Counter((r.n_words, tuple(r.hit_starts), tuple(r.hit_ends), tuple(r["items"])) for r in out.collect()) == want
    with pytest.raises(ValueError):
        decontaminate.find_hits(df.withColumn("N_words", F.lit(1)), items, block_bytes=block)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), min_size=10, max_size=30))
def test_no_long_span_is_missed(doc, item):
    d, i = (np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1) for x in (doc, item))
    spans, _ = decontaminate.Fingerprints(["x"], [i], 10, 5).match(d)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    want = {p for k in range(len(doc) - 9) if tuple(doc[k : k + 10]) in windows for p in range(k, k + 10)}
    assert {p for a, b in spans for p in range(a, b)} == want


# --- shared folder ---------------------------------------------------------------------------


def test_shared_folder_is_said_in_full(spark, tmp_path, monkeypatch):
    from lodestone.llm import store

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, *_):
            return self.value

    class Session:
        _jvm, _jsc, sparkContext = spark._jvm, spark._jsc, spark.sparkContext

        def __init__(self, value):
            self.conf = Conf(value)

    assert store.shared_dir(Session(f"{tmp_path}/x/")) == f"file://{tmp_path}/x"
    assert store.shared_dir(Session("file:///a/b")) == "file:///a/b"
    assert store.shared_dir(Session("hdfs://host/a")) == "hdfs://host/a"


def test_written_tables(spark):
    from lodestone.llm import store

    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = store.materialize(spark.range(5), "t")
    assert made.count() == 5 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    assert store.materialize(spark.range(0), "none").count() == 0
    store.discard(made)
    with pytest.raises(Exception):
        spark.read.parquet(made.inputFiles()[0]).count()
