"""Sharding, fingerprints, near-duplicates, token files, packing and url rules against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from synthkit.llm import packing, sharding, simhash, simhash_dedup, token_file, url_filter
from synthkit.llm.catalog import URL_RULES
from synthkit.llm.tokens import Encoder
from synthkit.session import scratch_dir


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_encoder_is_exact(encoder, documents):
    odd = ["", " ", "\n", "a  b", "a\n\nb \n c", "it's we'll  'S", "a\tb \t c", "x\n\n<|endoftext|> y", "12³ ½", "日本語 テスト", " lead",
           "trail ", "trail\n", "a\x1cb c", "don't\r\nnow", "Ωmega αβγ", "\n\n\nfoo"]
    rng = random.Random(1)
    odd += ["".join(rng.choice(" \n\n  abcé'sΩ1.,<|>\t'll½🙂") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    small = Encoder(max_entries=50)
    for t in [*odd, *(r.text for r in documents.limit(40).collect())]:
        assert encoder.encode(t) == small.encode(t) == encoder.whole(t)


def test_token_files_round_trip(spark, encoder, documents, edge, nothing):
    for docs in (documents, edge):
        folder = scratch_dir(spark, "files")
        manifest = token_file.write_sequences(docs, folder, seq_len=64, batch_rows=4, files=5)
        got = sorted((tuple(r) for r in token_file.read_documents(spark, folder, manifest).collect()), key=lambda r: r[1])
        rows = [(r.doc_id, [*np.frombuffer(encoder.whole(r.text or ""), "<u4"), 2]) for r in docs.collect()]
        assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(i), crc(i)) for d, i in rows)
        ids = [-1 if d is None else d for d, *_ in got]
        assert ids == sorted(ids) and [s for _, s, _, _ in got] == np.cumsum([0, *(n for *_, n, _ in got)])[:-1].tolist()
        one = token_file.SequenceFile(f"{folder}/{manifest[0]['file']}")
        last = -(-manifest[0]["n_tokens"] // 64) - 1
        assert len(one.ids(0)) == 64 and sum(one.mask(last).to_pylist()) == manifest[0]["n_tokens"] - 64 * last
        view = one.batch(0).column(0).flatten().to_numpy(zero_copy_only=True)
        assert np.shares_memory(view, one.ids(0)) and one.ids(0).dtype == np.uint16
    assert token_file.token_files(nothing).count() == 0


def check_packing(rows, capacity):
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_packing_places_every_piece_once(spark, encoder, documents, edge, nothing):
    for docs, capacity in ((documents, 1024), (edge, 1024), (documents, 50)):
        rows = packing.pack_documents(docs, capacity=capacity, with_ids=True).collect()
        want = Counter()
        for r in docs.collect():
            ids = [*np.frombuffer(encoder.whole(r.text or ""), "<u4").tolist(), 2]
            pieces = packing.cut(len(ids), capacity)
            assert all(n == capacity for _, n in pieces[1:]) and sum(n for _, n in pieces) == len(ids)
            want.update((r.doc_id, k, s, n, crc(ids[s:s + n])) for k, (s, n) in enumerate(pieces))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        assert all(crc(r.ids) == r.ids_crc32 for r in rows)
        used, total = check_packing(rows, capacity), sum(r.length for r in rows)
        assert used <= 1.02 * total / capacity + 2
    assert packing.pack_documents(nothing).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 1025, 20_000), rng.integers(300, 700, 5000), np.full(1000, 1), np.array([1024] * 5 + [1023, 1]),
                    np.repeat(341, 900), np.array([7]), rng.integers(150, 600, 300)):
        histogram = Counter(lengths.tolist())
        ranges, bins = packing.plan(dict(histogram))
        assert bins <= 1.012 * lengths.sum() / 1024 + 2
        got, fill = Counter(), defaultdict(int)
        for length, _, n, times, first, _ in ranges:
            got[length] += n * times
            for b in range(first, first + n):
                fill[b] += length * times
        assert got == histogram and max(fill.values()) <= 1024 and len(fill) == bins
    assert packing.plan({}) == ([], 0)


def test_shards_are_even_and_gapless(spark, edge, nothing):
    rows = [(i, f"text {i} " * (1 + i * 7919 % 50)) for i in range(6000)] + [(10_000 + i, "copy of one text " * 20) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shard_by_bytes(docs, whole=0.02).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    mean = sum(r["size"] for r in got) / 16
    assert len(got) == len(rows) and set(by) == set(range(16))
    assert all(abs(sum(r["size"] for r in v) / mean - 1) < 0.05 for v in by.values())
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32].add(r.shard)
    copies = groups.pop(zlib.crc32(("copy of one text " * 20).encode()))
    assert len(copies) > 3 and all(len(s) == 1 for s in groups.values())
    some = sharding.shard_by_bytes(edge).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in some) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in edge.collect())
    assert sharding.shard_by_bytes(nothing).count() == 0


def plain_simhash(text):
    import re
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    terms = words if len(words) < 2 else [f"{a} {b}" for a, b in zip(words, words[1:])]
    votes = [0] * 64
    for t in terms:
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        for b in range(64):
            votes[b] += min(32, len(t)) * (1 if h >> b & 1 else -1)
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_fingerprints_and_edits(spark, documents, edge, nothing):
    docs = documents.select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in simhash.edited_fingerprints(docs).collect()}
    for i, r in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)].text, len(r.text) // 4
        new = r.text[:len(r.text) - k] + after[:k]
        x = got[r.doc_id]
        assert x.n_chars == len(r.text) and x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        if i % 10 == 0:
            a, b, c = plain_simhash(r.text), plain_simhash(new), plain_simhash(after)
            assert (x.fingerprint % 2**64, x.edited_fingerprint % 2**64) == (a, b)
            for near, other in ((x.near_edited, b), (x.near_next, c)):
                assert near == pytest.approx(max(0, np.cos(np.pi * (a ^ other).bit_count() / 64)), abs=1e-9)
    assert np.mean([x.near_edited > x.near_next for x in got.values()]) > 0.95
    some = simhash.edited_fingerprints(edge).collect()
    prints = defaultdict(set)
    for r in some:
        prints[r.doc_id].add(r.fingerprint)
    assert len(some) == 13 and prints[1] == prints[2] == prints[3] == {0} and prints[7] < prints[8]
    alone = simhash.edited_fingerprints(edge.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert simhash.edited_fingerprints(nothing).count() == 0


def near_set(rng, n, flips):
    base = [rng.getrandbits(64) for _ in range(n)]
    out = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("radius,blocks", [(0, 2), (1, 3), (3, 6)])
def test_block_tables_find_all_neighbours(spark, radius, blocks):
    prints = near_set(random.Random(2), 25, 5)
    df = spark.createDataFrame([(signed(p),) for p in prints] + [(None,), (signed(prints[0]),)], "fingerprint long")
    got = {(r.query % 2**64, r.fingerprint % 2**64, r.distance) for r in simhash.near_fingerprints(df, df, radius, blocks).collect()}
    assert got == {(a, b, (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius}


def plain_components(prints, radius):
    arr, parent = np.array(prints, np.uint64), {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = find(p), find(prints[j])
            parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("radius,bucket", [(2, 2048), (2, 1), (1, 1), (3, 1)])
def test_components_match_brute_force(spark, radius, bucket):
    rng = random.Random(9)
    prints = near_set(rng, 30, 4)
    chain = [rng.getrandbits(64)]
    for i in range(0, 40, 2):  # a chain: each two bits from the one before, far from the first
        chain.append(chain[-1] ^ (3 << i))
    prints = sorted({*prints, *chain, 0, 2**64 - 1})
    rows = [(i, signed(p)) for i, p in enumerate(rng.sample(prints, len(prints)))] + [(5000 + i, signed(chain[3])) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    root = plain_components(prints, radius)
    first = {}
    for d, p in rows:
        r = root[p % 2**64]
        first[r] = min(first.get(r, d), d)
    got = simhash_dedup.assign_components(df, radius=radius, blocks=radius + 2, bucket=bucket).collect()
    assert len(got) == len(rows) and all(r.component_id == first[root[r.fingerprint % 2**64]] for r in got)


def test_bit_sliced_comparison_is_exact():
    rng = np.random.default_rng(1)
    prints = np.array(near_set(random.Random(4), 40, 4), np.uint64)
    keys = np.sort(rng.integers(0, 4, len(prints)))
    for radius in range(4):
        got = {(int(x), int(y)) for a, b in simhash_dedup.bucket_links(keys, prints, radius, chunk=64) for x, y in zip(a, b)}
        assert got == {(int(prints[i]), int(prints[j])) for i in range(len(prints)) for j in range(i + 1, len(prints))
                       if keys[i] == keys[j] and int(prints[i] ^ prints[j]).bit_count() <= radius}


def test_dedup_edges(spark, edge, nothing):
    got = simhash_dedup.near_duplicates(edge).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert len(got) == 13 and by[1] == by[2] == by[3] == {(0, 1)} and (list(by[7])[0][0], 7) in by[8]
    kept = simhash_dedup.drop_near_duplicates(edge)
    rows = kept.collect()
    assert kept.columns == edge.columns and Counter(r.doc_id for r in rows) == Counter([1, 4, 5, 6, 7, 8, 9, 10, None])
    assert simhash_dedup.near_duplicates(nothing).count() == 0 and simhash_dedup.drop_near_duplicates(nothing).count() == 0


def test_url_rules_and_features(spark):
    rows = [(1, None), (2, "nohost"), (3, "http://A.Example.COM/en/1?x=1"), (4, "HTTP://www.example.com/en/2"), (5, "a://com"), (6, "b://x.net/es/?"),
            (7, "c://net/es"), (8, "http://éx.com/\n/a#b"), (9, ""), (10, "http://xnet/es/"), (11, "http://x/://y.com/en/"), (12, "http://EX.com?q=/fr/"),
            (12, "http://EX.com?q=/fr/"), (None, "https://example.com/en/" + "x" * 50_000)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = url_filter.judge_with_rules(pages, URL_RULES)
    assert got.columns[:3] == pages.columns and got.count() == len(rows)
    by = {r.page_id: r for r in got.select("page_id", F.col("host_").alias("h"), "path", "rule", "verdict").collect()}
    assert (by[1].h, by[1].path, by[1].rule) == (by[2].h, by[2].path, by[2].rule) == ("", "", None)
    assert (by[3].h, by[3].path, by[3].rule, by[3].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (by[4].rule, by[4].verdict) == ("www.example.com/en/", "allow") and by[5].rule is None
    assert (by[6].rule, by[7].rule, by[8].rule, by[8].path) == ("net/es/", None, "com/", "/\n/a")
    assert by[10].rule is None and (by[11].h, by[11].path) == ("x", "/://y.com/en/") and (by[12].h, by[12].path, by[12].rule) == ("ex.com", "", None)
    assert by[None].rule == "example.com/en/"
    assert url_filter.judge_with_rules(pages.limit(0), URL_RULES).count() == 0
    h = spark.createDataFrame([("aabb",), ("",), ("aaaa",)], "t string").select(url_filter.entropy(F.col("t"))).collect()
    assert [round(r[0], 6) for r in h] == [1.0, 0.0, 0.0]


def test_url_trees_learn(spark):
    rng = random.Random(3)

    def url(bad):
        host = "".join(rng.choice("abcdef") for _ in range(6)) + ("-cheap-0" + str(rng.randrange(100)) if bad else "")
        return f"http://{host}.org/" + "/".join("p" * rng.randint(1, 5) for _ in range(rng.randint(1, 4)))
    rows = [(url(i % 2), i % 2) for i in range(600)]
    labelled = spark.createDataFrame(rows[:400] + [(None, 1), ("http://x.org/", None)], "url string, label int")
    model = url_filter.train(labelled)
    got = url_filter.judge(spark.createDataFrame(rows[400:], "url string, label int"), {}, model).collect()
    assert np.mean([(r.verdict == "block") == bool(r.label) for r in got]) > 0.95


def test_copies_of_a_hot_url_do_not_fill_the_training_sample(spark):
    from synthkit.llm import url_filter
    rows = spark.createDataFrame([(f"https://{'spam' if i % 2 else 'good'}{i}.example.com/p", i % 2) for i in range(100)], "url string, label int")
    hot = rows.orderBy(F.xxhash64("url")).limit(1).crossJoin(spark.range(60)).drop("id")
    model = url_filter.train(rows.union(hot), most=40)
    assert model.model is not None and 0.2 < model.overall < 0.8
    assert model.overall == url_filter.train(rows, most=40).overall


def test_fingerprint_tables_are_not_broadcast(spark):
    from synthkit.llm.common import materialize
    found = materialize(spark.range(500).select((F.col("id") * 977).alias("fingerprint")), "prints")  # a small file, twenty keys a row
    near = simhash.near_fingerprints(found.where("fingerprint % 50 = 0"), found)
    assert "Broadcast" not in near._jdf.queryExecution().sparkPlan().toString() and near.where("distance = 0").count() == 10
