import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import components, exact_dedup, ngram_join, suffix_dedup, url_filters, warc

from .conftest import ODD, documents

# ---- suffix dedup


def plain_removal(texts, length):
    seen, out = set(), {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            else:
                seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def random_texts(rng, n=120):
    make = lambda size: "".join(rng.choice("abcdefgh ") for _ in range(size))
    shared = [make(rng.randint(80, 400)) for _ in range(10)]
    texts = ["".join(rng.choice(shared)[rng.randint(0, 60) :] if rng.random() < 0.6 else make(rng.randint(1, 150)) for _ in range(rng.randint(0, 5))) for _ in range(n)]
    return [*texts, *ODD, "a" * 1500, "ab" * 700 + "c" + "ab" * 300, "a" * 99, "a" * 100, "abc" * 400, "xyz" * 40 + "a" * 250]


@pytest.mark.parametrize(("large", "at_once"), [(20_000, 1_500_000), (2, 1_500_000), (20_000, 300)])
def test_suffix_dedup(spark, large, at_once):
    texts = random_texts(random.Random(3))
    df = documents(spark, texts).repartition(5).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, large=large, at_once=at_once).collect()}
    assert got == plain_removal(texts, 100)


@pytest.mark.parametrize("length", [64, 100, 112, 113, 200, 1000])
def test_span_ranks_cover_all_bytes(length):
    import numpy as np

    rng = np.random.default_rng(11)
    for _ in range(3):
        data = rng.integers(32, 127, 3 * length, dtype=np.uint8)
        spans = {(a, lo, hi): s for a, lo, hi, _, s in zip(*suffix_dedup.anchors(data, np.array([len(data)]), length), strict=True)}
        for at in rng.choice(len(data), 150, replace=False):
            other = data.copy()
            other[at] ^= 1
            for a, lo, hi, _, s in zip(*suffix_dedup.anchors(other, np.array([len(data)]), length), strict=True):
                if (a, lo, hi) in spans:
                    assert (spans[a, lo, hi] != s) == (lo <= at < hi + length)


def test_suffix_dedup_odd_ids(spark):
    long = "abcdefghij" * 15
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (1, "z" + long[1:]), (2, "q" * 5)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed > 0) for r in suffix_dedup.suffix_dedup(df).collect()))
    # within itself the text repeats from its eleventh byte on
    assert len(got) == 5 and [g[2] for g in got] == [150, 150, 150, 150, 5] and not got[-1][3]
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0
    with pytest.raises(TypeError, match="integer"):
        suffix_dedup.suffix_dedup(df.withColumn("doc_id", F.lit("x")))


# ---- exact dedup


@pytest.mark.parametrize("all_digests", [True, False])
@pytest.mark.parametrize(("few", "buckets"), [(0, 5), (0, 1 << 20), (1000, 1 << 20)])
def test_exact_dedup(spark, monkeypatch, all_digests, few, buckets):
    monkeypatch.setattr(exact_dedup, "FEW_GROUPS", few)
    monkeypatch.setattr(exact_dedup, "BUCKETS", buckets)
    rng = random.Random(8)
    texts = [*ODD, *(rng.choice([" ", "", "\n"]).join(rng.choice(["ab", "a b", "a", "b" * 70, "b" * 70 + "c"])) for _ in range(150))]
    df = documents(spark, texts).withColumn("group_size", F.lit("clash"))
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for r in exact_dedup.exact_dedup(df, all_digests=all_digests).collect():
        same = [i for i, n in enumerate(norm) if n == norm[r.doc_id]]
        keep = min(same, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), keep == r.doc_id)
        if all_digests or len(same) > 1 or r.text_sha256 is not None:
            assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_dedup(df.limit(0), all_digests=all_digests).count() == 0


def test_exact_dedup_hot_group(spark):
    df = documents(spark, ["hot text"] * 3000 + [f"t{i}" for i in range(3000)])
    got = exact_dedup.exact_dedup(df)
    assert got.where("kept").count() == 3001 and got.where("group_size = 3000").count() == 3000


# ---- n-gram join


def plain_components(texts, width=5):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
    least = list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return {i: (len(a), find(i)) for i, a in enumerate(sets)}


def near_copies(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for size, copies in ((30, 60), (90, 60), (200, 12), (12, 20)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(2, size // 14))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(boiler + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]) for _ in range(80)]
    texts += [t.upper().replace(" ", "\n ") for t in texts[::17]]
    texts += [*ODD, "a b", "A  b", "a b c", "b a"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("frequent", "spreads", "combined", "few"), [(16, 8, 64, 1000), (2, 0, 64, 1000), (2, 0, 20, 0), (1 << 30, 8, 64, 1000)])
def test_ngram_join(spark, monkeypatch, frequent, spreads, combined, few):
    for name, value in (("FREQUENT", frequent), ("FREQUENT_SPREADS", spreads), ("FEW_ITEMS", few), ("COMBINED", combined)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = near_copies(random.Random(9))
    df = documents(spark, texts).repartition(6).withColumn("item", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df).collect()}
    assert got == plain_components(texts)


def test_index_entries_meet():
    import numpy as np

    rng = np.random.default_rng(10)
    for _ in range(400):
        n = int(rng.integers(4, 110))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = x.copy()
        y[rng.integers(0, len(y), len(y) // 7)] = rng.integers(0, 2**63, len(y) // 7, dtype=np.uint64)
        y = np.unique(y)[: int(rng.integers(max(1, int(len(y) * 0.8)), len(y) + 1))]
        of = {int(h): int(c) for h, c in zip(np.union1d(x, y), rng.integers(0, 3, len(np.union1d(x, y))), strict=True)}
        common = len(np.intersect1d(x, y))
        if 4 * common >= 3 * (len(x) + len(y) - common):
            differ = len(x) + len(y) - 2 * common
            (ex, px), (ey, py) = (ngram_join.index_entries(s, np.array([of[int(h)] for h in s], dtype=np.uint8)) for s in (x, y))
            both = np.intersect1d(ex, ey)
            assert any(min(len(x) - px[np.searchsorted(ex, e)], len(y) - py[np.searchsorted(ey, e)]) >= common for e in both)
            sketches = [ngram_join.parity(s) for s in (x, y)]
            assert np.bitwise_count(np.bitwise_xor(*(ngram_join.folded(s, min(map(len, sketches))) for s in sketches))).sum() <= differ


def test_small_parities_of_all_sizes(spark):
    import numpy as np

    rng, rows, wanted = np.random.default_rng(12), [], []
    for n in (0, 1, 3, 31, 63, 64, 65, 100, 127, 128, 129, 250, 300, 511, 513, 700, 1030, 4000, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[: n - n // 8], rng.integers(0, 2**63, n // 4, dtype=np.uint64))))
        one, two = (ngram_join.small_parity(ngram_join.parity(s), len(s)) for s in (x, y))
        least = min(len(one), len(two)) * 2 // 3
        rows.append(([int(w) for w in one], [int(w) for w in two]))
        plain = [ngram_join.folded(ngram_join.parity(s), 8 * least) for s in (x, y)]
        wanted.append(int(np.bitwise_count(plain[0] ^ plain[1]).sum()))
        assert wanted[-1] <= len(np.setxor1d(x, y)) and least >= 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x array<long>, y array<long>")
    assert [r.d for r in df.select("i", ngram_join.differing("x", "y").alias("d")).orderBy("i").collect()] == wanted


def test_ngram_join_string_ids(spark):
    rows = [("b", "a b c d e f g h i j"), ("a", "a b c d e f g h i j k"), ("10", "p q"), ("9", "P  q"), (None, "a b c d e f g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df).collect())
    assert got == [("", 8, "a"), ("10", 1, "10"), ("9", 1, "10"), ("a", 7, "a"), ("b", 6, "a")]


def test_ngram_join_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (7, 0, 7)]
    assert ngram_join.ngram_jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1000, 0])
def test_ngram_join_shared_and_null_ids(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW_ITEMS", few)
    words = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    text = lambda c, *extra: " ".join([*words[c], *extra])
    # id 5 stands for two texts, each with a near copy of its own; three texts are tied by the one without an id
    rows = [(5, text(0)), (5, text(1)), (6, text(0, "one")), (7, text(1, "two"))]
    chain = ["p1 p2 p3 p4", "p1 p2 p3 p4 q1 q2 q3 q4", "q1 q2 q3 q4"]
    rows += [(9, text(2, *chain[0].split())), (None, text(2, *chain[1].split())), (8, text(2, *"p1 p2 p3 p4 q1 q2 q3 q4 r1 r2 r3 r4 r5".split()))]
    rows += [(None, "alone " + " ".join(f"v{i}" for i in range(9))), (None, text(0, "three"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.ngram_jaccard_components(df).collect()))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets, least = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 4 * len(a & b) >= 3 * len(a | b):
                least = [least[i] if x == least[j] else x for x in least]
    names = [min((i for (i, _), x in zip(rows, least, strict=True) if x == y and i is not None), default=0) for y in least]
    assert got == sorted((i or 0, len(a), name) for (i, _), a, name in zip(rows, sets, names, strict=True))
    assert names == [5, 5, 5, 5, 8, 8, 8, 0, 5] and least[0] != least[1] and len({least[4], least[5], least[6]}) == 1


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, x) for x in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(9, 9)]
    least = {}
    for a, b in edges:
        if a != b:
            least.setdefault(a, a)
            least.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == least
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- URL filters


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "", "allow"), ("b.example.org", "/es/x", "allow"), ("com", "/de/", "block"), ("com", "/de/", "allow")]


def plain_verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[2] if best else None, best[3] if best else "allow")


def test_url_filter(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "ROWS_PER_SWEEP", 40)
    rng = random.Random(12)
    hosts = ["example.org", "EXAMPLE.org", "b.example.org", "a.b.example.org", "myexample.org", "org", "x.com", "com", "xcom", "", "é.org", "example.org:80", "u@example.org", "example.org."]
    paths = ["", "/", "/es/", "/es", "/es/x", "/es/xy", "/en/1", "/en/12", "/en/2", "/de/", "/de", "/es?/x", "#/es/", "/日", "/es/\U0010ffff"]
    urls = [None, "", "no scheme", "://", "a://b://c/d"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    df = spark.createDataFrame([(i // 2, u, "h") for i, u in enumerate(urls)], "page_id long, url string, path string")
    got = sorted((tuple(r) for r in url_filters.url_filter(df, url_filters.rule_table(spark, RULES)).collect()), key=repr)
    assert got == sorted(((i // 2, *plain_verdict(u, RULES)) for i, u in enumerate(urls)), key=repr)
    none = url_filters.url_filter(df, url_filters.rule_table(spark, []), default="block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}
    assert url_filters.url_filter(df.limit(0), url_filters.rule_table(spark, RULES)).count() == 0


def test_url_filter_nested_rules_over_many_ranges(spark, monkeypatch):
    """Deeply nested rules, one URL in a third of all rows, a very long URL, rows without an id, columns that clash."""
    monkeypatch.setattr(url_filters, "ROWS_PER_SWEEP", 60)
    monkeypatch.setattr(url_filters, "STARTS_PER_FOLD", 3)
    rng = random.Random(5)
    hosts = ["a", "b.a", "c.b.a", "ab.a", "a.a"]
    rules = sorted({(rng.choice(hosts), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(6)))) for _ in range(40)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules] + [("a", "nowhere", "block"), ("a/x", "", "block"), ("", "/", "block")]
    urls = [f"s://{rng.choice(hosts)}/{''.join(rng.choice('xy/') for _ in range(rng.randrange(8)))}" for _ in range(150)]
    urls += ["s://c.b.a/xy/x"] * 80 + ["s://b.a/" + "xy/" * 100_000]
    rows = [(None if i % 11 == 0 else i, u, "h", "k", "r", "s") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, path string, key string, rule string, stack string")
    table = url_filters.rule_table(spark, [*rules, (None, "/", "block"), ("a", "/", None)])
    got = sorted((tuple(r) for r in url_filters.url_filter(df, table).collect()), key=repr)
    assert got == sorted(((r[0], *plain_verdict(r[1], rules)) for r in rows), key=repr)


# ---- WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, lang string")


PAGES = [(i * 3 % 101, f"http://x.org/{i % 7} é", ["same", "", None, f"<p>{i}</p>" * (i % 40), "big" * 5000][i % 5], "en") for i in range(101)]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_SHARD", 1 << 12)
    df = pages(spark, [*PAGES, (500, None, "same", "en"), (501, "http://a\r\nb", "u", "en")])
    first, size = {}, {}
    for r in df.orderBy("page_id").collect():
        digest = base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()
        first.setdefault(digest, r.page_id)
        size[r.page_id] = (len((r.html or "").encode()), digest)
    for least in (0, 3, 10**9):
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, min_payload=least).collect()}
        wanted = {}
        for i, (n, digest) in size.items():
            original = first[digest] if n >= least else i
            wanted[i] = (n, digest, "response" if original == i else "revisit", None if original == i else original)
        assert got == wanted


def test_warc_is_deterministic_and_rolls(spark, tmp_path):
    df = pages(spark, PAGES)
    made = [warc.write_warc(x, f"file://{tmp_path}/{i}", roll=2000).orderBy("path").collect() for i, x in enumerate((df, df.repartition(7), df.orderBy(F.desc("page_id"))))]
    assert made[0] == made[1] == made[2] and len(made[0]) > 1 and any(r.seq for r in made[0])
    for r in made[0]:
        data = (tmp_path / "0" / r.path).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.n_bytes
    back = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}/0").where("record_type = 'response'").collect()}
    assert all(back[i] == (html or "").encode() for i, _, html, _ in PAGES if i in back)
    (tmp_path / "0" / made[0][0].path).write_bytes(b"\x1f\x8bbroken")
    with pytest.raises(Exception, match="(?i)error|invalid|breaks"):
        warc.read_warc(spark, f"file://{tmp_path}/0").collect()


def test_warc_shards_follow_the_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_SHARD", 1 << 12)
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 20, "en") for i in range(300)] + [(None, "http://n", f"no id {i} " * 20, "en") for i in range(100)] + [(7, "http://h", f"hot {i} " * 30, "en") for i in range(100)]
    shards = {}
    for name, extra in (("near", []), ("far", [(1 << 60, "http://far", "x", "en")])):
        made = warc.write_warc(pages(spark, rows + extra), f"file://{tmp_path}/{name}").collect()
        shards[name] = len({r.shard for r in made})
        assert sum(r.n_records for r in made) == len(rows + extra) and max(r.n_records for r in made) < 100
    assert abs(shards["near"] - shards["far"]) <= 1 and shards["near"] > 10


def test_warc_string_ids(spark):
    rows = [("b", "http://x", "same", "en"), ("a\r\n:é", "http://x", "same", "en"), ("", "http://x", "same", "en"), (None, "http://x", "same", "en"), ("10", "http://x", "other", "en"), ("9", "http://x", "other", "en")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, lang string")
    got = sorted((r.page_id is None, r.page_id or "", r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [(False, "", "response", None), (False, "10", "response", None), (False, "9", "revisit", "10"), (False, "a\r\n:é", "revisit", ""), (False, "b", "revisit", ""), (True, "", "response", None)]
    with pytest.raises(TypeError, match="integer or a string"):
        warc.round_trip(df.select(F.lit(1.5).alias("page_id"), "url", "html"))


def test_warc_odd_tables(spark):
    df = pages(spark, [(None, "http://x", "p", "en"), (4, "http://x", "p", "en"), (4, "http://x", "p", "en"), (4, "http://x", "q", "en"), (9, "http://x", "q", "en"), (None, None, None, None)])
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    assert got == [(0, 0, "response", 0), (0, 1, "response", 0), (4, 1, "response", 0), (4, 1, "response", 0), (4, 1, "revisit", 4), (9, 1, "revisit", 4)]
    assert warc.round_trip(df.limit(0)).count() == 0
