"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import chat_format, context_tree, decontaminate, exact_dedup, mixing, near_dedup, sharding, site_lines, toxicity, url_reputation
from marlstone.llm.bytesets import pieces, shingle_hashes, word_hashes, word_spans
from marlstone.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digit string, group string, uid long, shard int, size int, target double, line string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def frame(spark, rows):
    """Documents of (doc_id, text[, source]) with extra columns whose names operators use themselves; written, as tables are."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "g", 7, 3, 9, 0.5, "l") for r in rows]
    return Scratch(spark, "test").keep(spark.createDataFrame(full, DOCS).coalesce(2))


HARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, "One two"), (7, "word " * 60000), (8, "word " * 60000), (9, "ümläut \x00 ok"), (9, "other text here")]


# 10: exact dedup


def test_exact_dedup_matches_brute_force(spark):
    base = "abc" * 5000
    rows = [*HARD, (20, base), (21, base), (22, base[:-1] + "x"), (23, "y" + base[1:]), (24, base[:700] + "z" + base[701:]), (25, base[:700] + "z" + base[701:])]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


# 3: near dedup


def brute_components(rows, width, percent=80):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [len(s) for s in sets], [least.get(root(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def variants(seed, n_base=12, copies=14, length=120, edits=14):
    """Families of texts with random edits, so that similarities lie on both sides of the limit."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for _ in range(n_base):
        base = list(rng.choice(vocabulary, length))
        for _ in range(copies):
            text = list(base)
            for at in rng.integers(0, length, rng.integers(0, edits)):
                text[at] = str(rng.choice(vocabulary))
            rows.append((len(rows) * 3 + 5, " ".join(text)))
    return rows


@pytest.mark.parametrize(("width", "block", "centres", "spread"), [(2, 768, 6, 4096), (5, 768, 6, 4096), (2, 6, 2, 3)])
def test_near_duplicates_match_brute_force(spark, width, block, centres, spread, monkeypatch):
    """The last case has every posting and group dealt out, and fragments compared in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CENTRES", centres)
    monkeypatch.setattr(near_dedup, "SPREAD", spread)
    rows = [*HARD, *variants(width)]
    got = near_dedup.near_duplicates(frame(spark, rows), width).collect()
    sizes, components = brute_components(rows, width)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, n, c) for (d, _), n, c in zip(rows, sizes, components, strict=True))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_one_of_each_near_duplicate_group(spark):
    rows = [(3, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (9, None), (8, ""), (7, "quite another text of some words here")]
    got = near_dedup.one_of_each(frame(spark, rows))
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(2, rows[0][1]), (7, rows[-1][1])]
    assert got.count() == 4
    assert got.columns == frame(spark, rows).columns


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """A chain of texts, each near the next, and hundreds of copies with one edit: one component, in few comparisons."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join([f"n{j}" for j in range(i)] + base[i:]) for i in range(0, 40, 2)]
    edited = [" ".join([*base[:k], f"e{i}", *base[k + 1 :]]) for i, k in enumerate(np.random.default_rng(1).integers(2, 58, 300))]
    rows = [(i + 1, t) for i, t in enumerate([*chain, *edited, "quite another text " * 9])]
    got = near_dedup.near_duplicates(frame(spark, rows), 2).collect()
    sizes, components = brute_components(rows, 2)
    assert {r.doc_id: r.component_id for r in got} == {d: c for (d, _), c in zip(rows, components, strict=True)}
    assert len(set(components)) == 2


def test_near_duplicates_of_a_derived_frame(spark):
    """Rows that come from a shuffle keep their numbers."""
    rows = variants(7, 6)
    docs = frame(spark, rows).repartition(3).filter("doc_id > 0")
    _, components = brute_components(rows, 2)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2).collect()} == {d: c for (d, _), c in zip(rows, components, strict=True)}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, []), 2).count() == 0
    assert near_dedup.one_of_each(frame(spark, [(1, None)])).count() == 1


# 9: decontamination


def brute_contained(docs, items, width=5):
    def grams(text):
        w = words_of(text)
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    out = Counter()
    for d, text, *_ in docs:
        own = grams(text)
        for i, item in items:
            want = grams(item)
            if want and len(own & want) >= 0.8 * len(want):
                out[d, i, len(want), len(own & want)] += 1
    return out


def test_contained_items_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(6, 60, 40))] + [(90, None), (91, ""), (92, "short one"), (93, "v1 v2 v3 v4 v5 v6 v7")]
    docs = list(HARD)
    for i, item in items[:40]:
        w = item.split()
        docs.append((100 + i, f"{say(3000)} {item.upper()} {say(3000)}"))
        w[len(w) // 2] = "changed"
        docs.append((200 + i, f"{say(40)} {' '.join(w)} {say(9)}"))
        docs.append((300 + i, say(200)))
    docs.append((400, "Short one"))
    got = decontaminate.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in got) == brute_contained(docs, items)
    assert {100 + i for i in range(40)} <= {r.doc_id for r in got}


def test_items_of_few_shingles_are_never_missed(spark):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice([f"v{i}" for i in range(400)], n))
    items = [(i, " ".join(f"i{i}w{k}" for k in range(5))) for i in range(400)]
    items += [(500 + 3 * i + e, " ".join(f"r{i}e{e}w{k % distinct}" for k in range(64))) for i in range(30) for e, distinct in enumerate((1, 2, 4))]
    docs = [(i, f"{say(60)} {item} {say(60)}") for i, item in items]
    got = decontaminate.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in got) == brute_contained(docs, items)
    assert {r.doc_id for r in got} == {i for i, _ in items}


def test_blocks_of_a_larger_benchmark_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(10)], "item_id long, text string")
    docs = frame(spark, [(i, "before " + " ".join(f"i{i}w{k}" for k in range(12)) + " after") for i in range(10)] + [(50, "clean text with words in it")])
    assert decontaminate.contained_items(docs, items).count() == 10
    assert [r.doc_id for r in decontaminate.clean_documents(docs, items).collect()] == [50]
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0


# 4: mixing


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", "c", "é", None][i % 5]) for i in range(2000)]
    rows += [(9000 + i, "tiny", "z") for i in range(3)] + [(None, "a b c", "a"), (1, None, "a"), (5, "", "e m p t y")]
    docs = frame(spark, rows)
    got = mixing.mixing_plan(docs).collect()
    assert len(got) == len(rows)
    sizes, total = Counter(), 0
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    total = sum(sizes.values())
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    want = {s: 3.0 * sizes[s] if s in capped else share[s] for s in order}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in order)
    draw = lambda doc, seed: None if doc is None else (xxhash.xxh64_intdigest(struct.pack("<i", seed), _long_hash(doc)) >> 11) / (1 << 53)
    by_source = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            assert r.copies == math.floor(r.rate) + (draw(r.doc_id, r.seed) < r.rate - math.floor(r.rate))
        by_source[r.source].append(r)
    for source, all_rows in by_source.items():
        if any(r.doc_id is None for r in all_rows):
            continue
        off = [abs(sum(r.size * (math.floor(r.rate) + (draw(r.doc_id, s) < r.rate - math.floor(r.rate))) for r in all_rows) - want[source]) for s in range(mixing.SEEDS)]
        assert off[all_rows[0].seed] == pytest.approx(min(off))
    again = mixing.mixing_plan(docs.repartition(7)).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in got)
    emitted = mixing.mix(docs)
    assert emitted.columns == docs.columns
    assert Counter(r.doc_id for r in emitted.collect()) == Counter({k: v for k, v in _copies(got).items() if v})


def _long_hash(doc):
    """Spark's xxhash64 of a long with its seed 42, which seeds the hash of the next column."""
    return xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)


def _copies(rows):
    out = Counter()
    for r in rows:
        out[r.doc_id] += r.copies
    return out


def test_ranks_of_many_sources_are_gapless(spark):
    """With small parts, adaptive execution joins them by size, which differs with the columns that are read."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16384", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 20000
        docs = frame(spark, [(i + 1, "a b", f"s{i:05}") for i in range(n)])
        scratch = Scratch(spark, "test")
        targets = mixing.source_targets(scratch.keep(docs.groupBy("source").agg(F.sum("doc_id").alias("source_size"))), scratch, [1, 2, 4, 8, 16], 1e9)
        got = sorted((r.source, r.target) for r in targets.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    unit = n * (n + 1) / 2 / (31 * n / 5)
    assert [s for s, _ in got] == [f"s{i:05}" for i in range(n)]
    assert [t / unit for _, t in got] == pytest.approx([2 ** (i % 5) for i in range(n)])


def test_mixing_nothing(spark):
    assert mixing.mixing_plan(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).count() == 0


# 6: sharding


def test_shards_are_balanced_and_slots_gapless(spark):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(3000)] + [(7, "y" * 50)] * 2500 + [(None, None), (None, "z"), (1, "")]
    got = sharding.assign_shards(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(load.values()) / 8
    assert max(load.values()) <= 1.02 * mean and min(load.values()) >= 0.9 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.assign_shards(frame(spark, [])).count() == 0


def test_small_tables_are_balanced_too(spark):
    """No shard is further above the mean than the slack and a document."""
    got = sharding.assign_shards(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    mean, largest = sum(r.b for r in got) / 8, max(r.m for r in got)
    assert len(got) == 8 and all(r.b <= 1.01 * mean + largest for r in got)
    others = sorted(r.b for r in got)[:-1]
    assert max(others) <= 1.02 * mean


def test_one_text_of_one_key_is_spread(spark):
    rows = [(5, "same" * 50)] * 3000 + [(i, "x" * 40) for i in range(3000)]
    load = Counter()
    for r in sharding.assign_shards(frame(spark, rows)).collect():
        load[r.shard] += r.size
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) <= 1.02 * mean


def test_ring_moves_little_when_a_shard_is_added():
    cells = [(a, -1, 100 + a * 13 % 50) for a in range(4000)]
    before, after = sharding.place_cells(cells, 8, 0.25), sharding.place_cells(cells, 9, 0.25)
    eight, nine = sharding.Ring(8), sharding.Ring(9)
    assert sum(before[c] != after[c] for c in before if c[0] % 2 == 0) < len(cells)
    nine.arcs, nine.firsts = eight.arcs, np.searchsorted(nine.spots, (np.arange(eight.arcs) + 0.5) / eight.arcs).tolist()
    owners = [next(eight.clockwise(a)) for a in range(0, eight.arcs, 7)]
    assert owners == [next(s for s in nine.clockwise(a) if s < 8) for a in range(0, eight.arcs, 7)]
    grown = [next(nine.clockwise(a)) for a in range(0, eight.arcs, 7)]
    assert all(x == y or y == 8 for x, y in zip(owners, grown, strict=True)) and 0.05 < sum(y == 8 for y in grown) / len(grown) < 0.2


def test_overflow_goes_clockwise():
    cells = [(a, -1, 1) for a in range(400)]
    ring, most = sharding.Ring(8), 1.01 * 400 / 8
    placed, load = sharding.place_cells(cells, 8, 0.01), Counter()
    from marlstone.llm.bytesets import mix64

    for i in np.argsort(mix64(np.array([c[0] << 24 for c in cells], dtype=np.uint64)), kind="stable"):
        want = next(s for s in ring.clockwise(cells[i][0]) if load[s] + 1 <= most)
        load[want] += 1
        assert placed[cells[i][0], -1] == want


def test_many_shards_are_placed_at_once():
    cells = [(a, -1, 100) for a in range(sharding.arcs_of(500))]
    load = Counter(sharding.place_cells(cells, 500, 0.05).values())
    assert len(load) == 500 and max(load.values()) <= 1.05 * len(cells) / 500


def test_query_rows_are_the_ring_s(spark):
    """Each row's shard is that of its arc and cell, found again from the hashes alone; slots go by input partition, then doc_id."""
    rows = [(i, "x" * (i * 37 % 60)) for i in range(4000)] + [(None, None), (3, "twice")]  # no arc holds a share
    docs = frame(spark, rows)
    narrow = sharding._narrow(docs).withColumn("arc", sharding._row_arc(F.col("doc_id"), 8)).collect()
    size = Counter()
    for r in narrow:
        size[r.arc] += r.size
    placed = sharding.place_cells(sorted((a, -1, b) for a, b in size.items()), 8)
    want, slots = Counter(), Counter()
    for r in sorted(narrow, key=lambda r: (r.uid >> 33, r.doc_id is not None, r.doc_id or 0, r.uid)):
        shard = placed[r.arc, -1]
        want[r.doc_id, r.size, r.text_crc32, "bytes", shard, slots[shard], None] += 1
        slots[shard] += 1
    assert Counter(tuple(r) for r in sharding.assign_shards(docs).collect()) == want


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [*HARD, *[(100 + i, "text" * i) for i in range(200)], (100, "")]
    docs = frame(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows) and set(back.columns) == {*docs.columns, "shard", "slot"}
    whole = sharding.sharded(docs)
    assert whole.columns == [*[c for c in docs.columns if c not in ("size", "shard")], "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter((r.doc_id, r.text, r.uid) for r in whole.collect()) == Counter((*r, 7) for r in rows)
    assert sharding.sharded(docs.limit(0)).count() == 0


# 7: site lines


def test_site_lines(spark):
    rows = [(i, f"head\nown {i}\nfoot {i % 2}\n", "h1") for i in range(20)] + [(100 + i, f"head\nother {i}", "h2") for i in range(3)] + [(200, None, None), (201, "", "h1"), (202, "head\nhead\nlast", "h1")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in site_lines.drop_boilerplate(docs, docs["source"], docs["text"], 0.5, 5).collect()}
    assert got[3].clean_text == "own 3\nfoot 1\n" and got[3].n_lines == 4 and got[3].n_dropped == 1
    assert got[202].clean_text == "last" and got[202].n_dropped == 2
    assert got[101].clean_text == "head\nother 1" and got[200].clean_text == "" and len(got) == len(rows)
    assert site_lines.drop_boilerplate(docs.limit(0), docs["source"], docs["text"]).count() == 0


# 1: urls


URLS = [(1, "http://Blog.Example.ORG/es/a?x#y"), (2, "https://example.org/en/1x"), (3, "ftp://a.com/de/1"), (4, "http://b.com/fr/"), (5, "no url"), (6, None), (7, "http://bad.net/1"), (8, "http://good.net?q"), (9, "http://xexample.org/es/"), (10, "://"), (11, "http://org"), (11, "http://bad.net/2")]


def test_url_rules_and_reputation(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    pages = spark.createDataFrame([(*u, "x") for u in URLS] + [(100 + i, f"http://bad.net/{i}", "x") for i in range(60)] + [(200 + i, f"http://good.net/{i}", "x") for i in range(60)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(60)] + [(3, None), (77777, 1)], "page_id long, good int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, outcomes, rules).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [
        ("blog.example.org", "/es/a", "example.org/es/", "block"), ("example.org", "/en/1x", "example.org/en/1", "block"), ("a.com", "/de/1", "com/de/", "block"), ("b.com", "/fr/", "com/fr/", "allow"),
    ]
    assert [(got[i].host, got[i].path, got[i].rule) for i in (5, 6, 10)] == [("", "", None)] * 3
    assert got[7].verdict == "block" and got[8].verdict == "allow" and got[9].rule == "org/" and got[11].path in ("", "/2")
    assert got[7].host_lower < got[7].host_mean < got[7].host_upper < 0.5 < got[8].host_lower
    assert url_reputation.judge_urls(pages, outcomes, rules).count() == len(URLS) + 120
    assert url_reputation.judge_urls(pages, outcomes.limit(0), rules).filter("host_labels > 0").count() == 0
    assert url_reputation.judge_urls(pages.limit(0), outcomes, rules).count() == 0


def test_domains_and_suffixes(spark):
    hosts = ["a.b.co.uk", "user:p@x.example.com:8080", "co.uk", "localhost", "", "1.b.my.own", "xco.uk"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    name = url_reputation.host_name(F.col("host"))
    suffix = url_reputation.host_suffix(name)
    got = {r.host: (r.s, r.d, r.o) for r in rows.select("host", suffix.alias("s"), url_reputation.registered_domain(name, suffix).alias("d"), url_reputation.host_suffix(name, ("my.own", "b.my.own")).alias("o")).collect()}
    assert [got[h][:2] for h in hosts[:5]] == [("co.uk", "b.co.uk"), ("com", "example.com"), ("co.uk", "co.uk"), ("localhost", "localhost"), ("", "")]
    assert got["1.b.my.own"][2] == "b.my.own" and got["xco.uk"][:2] == ("uk", "xco.uk")


# 2: toxicity


def brute_features(text):
    """Words and word beginnings of a text, and its dense features, byte by byte."""
    data = (text or "").encode()
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    words = [bytes(w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", low)]
    found = {("word", w) for w in words} | {("begins", w[:k]) for w in words for k in (4, 5, 6) if len(w) > k}
    n = max(1, len(data))
    space = {0x20, 9, 10, 11, 12, 13}
    symbol = sum(not letter(b) and b not in space and not 48 <= b <= 57 and b not in b".," for b in data) / n
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    dense = [sum(65 <= b <= 90 for b in data) / n, sum(48 <= b <= 57 for b in data) / n, symbol, sum(b in space for b in data) / n, again, math.log1p(n) / 10, float(symbol > 0.05)]
    return found, dense


def brute_fit(x, y, l2=2e-3):
    """The minimum of the balanced logistic loss with an L2 penalty, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    rate = 0.5 * np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) + 0.5 / len(y)
    penalty, w = np.r_[np.full(x.shape[1] - 1, l2), 0], np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (rate * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), (rate * (p - y)) @ x + penalty * w)
    return w


def test_toxicity_chain_matches_brute_force(spark):
    """The whole chain again in plain code: features, folds, out-of-fold probabilities and the models on them."""
    rng = np.random.default_rng(11)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows, labels = [], []
    for i in range(260):
        low, toxic = bool(rng.random() < 0.3), bool(rng.random() < 0.3)
        w = [*rng.choice(plain, 12), *(["sloppy!"] if low and rng.random() < 0.8 else []), *(["vile"] if toxic and rng.random() < 0.8 else [])]
        rows.append((i, " ".join(rng.permutation(w))))
        labels.append((i, int(low), int(toxic)))
    docs = frame(spark, rows)
    model = toxicity.fit_chain(docs, spark.createDataFrame(labels, "doc_id long, low int, toxic int"), ["low", "toxic"])
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    found = [brute_features(t) for _, t in rows]
    names = sorted({f for s, _ in found for f in s})
    y = np.array([lab[1:] for lab in labels], float)
    n = len(rows)
    chosen = set()
    for c in range(2):
        share, score = (y[:, c].sum() + 0.5) / (n + 1), {}
        for f in names:
            has = np.array([f in s for s, _ in found])
            if has.sum() >= 3:
                score[f] = abs((y[has, c].sum() - has.sum() * share) / math.sqrt(has.sum() * share * (1 - share) + 0.25))
        chosen |= {f for f, z in score.items() if z > 3.5}
    assert len(chosen) == len(model.selected) > 2
    dense = np.array([d for _, d in found])
    dense = np.clip((dense - dense.mean(axis=0)) / np.maximum(dense.std(axis=0), 1e-3), -8, 8)
    x = np.c_[np.array([[f in s for f in sorted(chosen)] for s, _ in found], float), dense]
    folds = np.array([fold[i] for i, _ in rows])
    use = x
    for c in range(2):
        held = np.zeros(n)
        for k in range(toxicity.FOLDS):
            w = brute_fit(x[folds != k], y[folds != k, c])
            held[folds == k] = 1 / (1 + np.exp(-(np.c_[x[folds == k], np.ones((folds == k).sum())] @ w)))
        w = brute_fit(x, y[:, c])
        p = 1 / (1 + np.exp(-(np.c_[use, np.ones(n)] @ w)))
        x, use = np.c_[x, held], np.c_[use, p]
    got = {r.doc_id: (r.p_low, r.p_toxic) for r in toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, low int, toxic int"), ["low", "toxic"]).collect()}
    off = np.abs(np.array([got[i] for i, _ in rows]) - use[:, -2:])
    assert off.max() < 0.02 and off.mean() < 0.005


def test_labelled_rows_are_bounded_by_hash(spark):
    known = spark.range(5000).select(F.col("id").alias("doc_id"))
    some = toxicity._bounded(known, 1000, 11)
    assert 950 <= some.count() <= 1000 and toxicity._bounded(known, 5000, 11).count() == 5000
    assert {r.doc_id for r in toxicity._bounded(known, 500, 11).collect()} <= {r.doc_id for r in some.collect()}


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(3)
    plain, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(900):
        toxic, low = i % 9 == 0, i % 7 == 0
        w = list(rng.choice(plain, int(rng.integers(5, 80))))
        if toxic:
            w[int(rng.integers(0, len(w)))] = str(rng.choice(bad)) + "."
        rows.append((i, " ".join(w).upper() if low else " ".join(w)))
        if i < 700:
            labels.append((i, int(low), int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "plain words " * 30000), (None, "vile")]
    docs, known = frame(spark, rows), spark.createDataFrame([*labels, (3, 1, None), (77777, 0, 1)], "doc_id long, low int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, known, ["low", "toxic"]).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(700, 900) if got[i].rejected != (i % 9 == 0)]
    assert len(wrong) <= 2
    assert sum((got[i].p_low > 0.5) != (i % 7 == 0) for i in range(700, 900)) <= 2
    assert not got[5000].rejected and not got[5002].rejected and got[None].rejected
    kept = toxicity.clean_documents(docs, known, ["low", "toxic"])
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got.values())


def test_toxicity_without_labels(spark):
    docs, none = frame(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.rejected for r in toxicity.score_documents(docs, none, ["toxic"]).collect()] == [False, False]
    assert toxicity.score_documents(docs.limit(0), none, ["toxic"]).count() == 0


# 5: context trees


def brute_ctw(texts, depth):
    """Counts by (context, node), and each node's mixed probability, computed the plain way."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        raw = [255] * depth + list(" ".join(words_of(t)).encode()) + [255]
        for k in range(depth, len(raw)):
            for d in range(depth + 1):
                node = 1
                for s in range(7, -1, -1):
                    bit = raw[k] >> s & 1
                    counts[tuple(raw[k - d : k]), node][bit] += 1
                    node = node * 2 + bit

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    longer, mixed, weight = defaultdict(float), {}, {}
    for ctx, node in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[ctx, node])
        if len(ctx) == depth:
            mixed[ctx, node], weight[ctx, node] = own, 1.0
        else:
            rest = longer[ctx, node]
            mixed[ctx, node] = math.log(0.5) + max(own, rest) + math.log1p(math.exp(-abs(own - rest)))
            weight[ctx, node] = 1 / (1 + math.exp(min(700, rest - own)))
        if ctx:
            longer[ctx[1:], node] += mixed[ctx, node]

    def score(t):
        raw, total = [255] * depth + list(" ".join(words_of(t)).encode()) + [255], 0.0
        for k in range(depth, len(raw)):
            node = 1
            for s in range(7, -1, -1):
                bit, chance = raw[k] >> s & 1, None
                for d in range(depth, -1, -1):
                    key = (tuple(raw[k - d : k]), node)
                    if key in counts:
                        p = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
                        chance = p if chance is None else weight[key] * p + (1 - weight[key]) * chance
                chance = 0.5 if chance is None else chance
                total += math.log10(chance if bit else 1 - chance)
                node = node * 2 + bit
        return total

    return score


def test_context_tree_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "mat", "Ünit", "on"], int(rng.integers(0, 12))))) for i in range(60)] + [(None, "the end"), (61, None)]
    got = {r.doc_id: r for r in context_tree.score_texts(frame(spark, rows), depth=3).collect()}
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    train = [t for i, t in rows if not held[i]]
    score = brute_ctw(train, 3)
    counts = Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*words_of(t), None]
        assert got[i].held_out == held[i] and got[i].n_tokens == len(tokens) and got[i].train_tokens == n
        assert got[i].n_known == sum(counts[w] > 0 for w in tokens)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert got[i].score == pytest.approx(score(t), rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("hot", [0, 1 << 21])
def test_context_tree_keeps_every_node(spark, hot, monkeypatch):
    """Enough random bytes for tens of thousands of nodes: none is lost, whether its gram is joined or broadcast."""
    monkeypatch.setattr(context_tree, "HOT_GRAMS", hot)
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 100))) for i in range(300)]
    got = {r.doc_id: r.score for r in context_tree.score_texts(frame(spark, rows)).collect()}
    score = brute_ctw([t for i, t in rows if zlib.crc32(str(i).encode()) % 10], 5)
    for i, t in rows:
        assert got[i] == pytest.approx(score(t), rel=1e-9)


def test_bytes_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("some text and more of it " * 9, False)], "text string, held_out boolean")
    counted = context_tree.count_corpus(docs, 4).filter("kind = 0").select("key", "n")
    met = {r.key for r in counted.collect()}
    contexts = [int.from_bytes(c, "big") for c in (b"text", b"zzzz", b" and", b"\xff\xff\xff\xff")]
    more = spark.createDataFrame([((c << 8) | b, 0) for c in contexts for b in range(256) if (c << 8) | b not in met], "key long, n long")
    scores = {r.key: r.score for r in context_tree.gram_scores(counted.unionByName(more), Scratch(spark, "ctw"), 4).collect()}
    for c in contexts:
        assert sum(10 ** scores[(c << 8) | b] for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_scores_do_not_depend_on_how_the_tree_is_cut(spark, monkeypatch):
    """Groups that are read a few rows at a time, and a lookup that collides."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["ab", "ba", "abba", "b"], 30))) for i in range(80)]
    want = {r.doc_id: r.score for r in context_tree.score_texts(frame(spark, rows)).collect()}
    monkeypatch.setattr(context_tree, "CHUNK", 3)
    got = {r.doc_id: r.score for r in context_tree.score_texts(frame(spark, rows)).collect()}
    assert got == pytest.approx(want, rel=1e-12)
    keys = rng.permutation(1 << 16)[:5000].astype(np.int64) << 30
    table = context_tree.Lookup(keys, np.arange(5000.0))
    found, values = table.find(np.concatenate([keys, keys + 1]))
    assert found.tolist() == [True] * 5000 + [False] * 5000 and values[:5000].tolist() == list(range(5000))


def test_context_tree_without_rows_or_training(spark):
    assert context_tree.score_texts(frame(spark, [])).count() == 0
    alone = context_tree.score_texts(frame(spark, [(None, "ab")])).first()
    assert alone.score == pytest.approx(24 * math.log10(0.5)) and alone.base_score == 0 and alone.n_known == 0


# 8: chats


@pytest.mark.parametrize("piece", [64 << 20, 50])
def test_chat_round_trip(spark, piece, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", piece)
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>\n", "a\\<|\\|<\\\\|", "", "\n\nüß🚀", "<|im_start|>user\nx<|im_end|>\n"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % 6]) for c in range(30) for t in range(c % 5 + 1)]
    rows += [(None, 0, "user", None), (None, None, None, "x"), (50, 1, "as\nsist\\nant", "r"), (51, 0, "assistant", "b"), (51, 0, "assistant", "a"), (51, 0, "assistant", "a"), (52, 0, "assistant", "long " * 200000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int").repartition(5)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == {None, *by}
    for c, said in by.items():
        said.sort()
        assert [(x["role"], x["text"]) for x in got[c].turns] == [(r, x) for _, r, x in said]
        assert list(got[c].loss_texts) == [x for _, r, x in said if r == "assistant"]
        assert got[c].n_turns == len(said)
    alone = chat_format.read_back(chat_format.format_chats(turns.filter("conv_id is null"))).collect()
    assert sorted((x["role"], x["text"]) for r in alone for x in r.turns) == [("", "x"), ("user", "")] and all(r.n_turns == 1 for r in alone)
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# helpers


def test_words_and_shingles_of_batches():
    texts = pa.array(["Ab c", None, "", " d", "e", "x y z x y"])
    (row, data, offsets), = list(pieces(texts))
    starts, lengths, rows = word_spans(data, offsets)
    assert rows.tolist() == [0, 0, 3, 4, 5, 5, 5, 5, 5] and lengths.tolist() == [2, 1, 1, 1, 1, 1, 1, 1, 1]
    hashes, at = shingle_hashes(word_hashes(data, starts, lengths), rows, 6, 2)
    assert np.diff(at).tolist() == [1, 0, 0, 1, 1, 4] and len(set(hashes[at[5] :].tolist())) == 3
