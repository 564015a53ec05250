"""Corpus operators against brute force, on small fixtures and on the sf0.001 tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import op1_exact_dedup as op1
from gridloom.llm import op2_quality as op2
from gridloom.llm import op3_sketch as op3
from gridloom.llm import op4_language as op4
from gridloom.llm import op5_bpe as op5
from gridloom.llm import op6_jaccard as op6
from gridloom.llm import op7_url_filter as op7
from gridloom.llm import op8_store as op8
from gridloom.llm import op9_packing as op9
from gridloom.llm import op10_licenses as op10
from gridloom.llm import parts, registry
from gridloom.llm.components import components
from gridloom.llm.divideskip import search, t_occurrence
from gridloom.llm.tokens import encoder, vocabulary
from gridloom.llm.trie import PatriciaTrie

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_rows():
    rng = random.Random(7)
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base.upper()), (4, ""), (5, None), (6, "one two"), (7, "ONE two"), (8, " \t\n"), (9, base + " and more"), (None, base), (10, "x"), (10, "x"), (11, "ünï ÇÖDÉ 漢字 \U0001f600"), (12, "a" * 70_000), (13, "word " * 30_000), (14, "short"), (14, "other text of the same id")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows; and a column with a name that results have too."""
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).withColumns({"kept": F.lit("clash"), "score": F.lit("clash"), "keep_id": F.lit("clash"), "length": F.lit("clash"), "digest": F.lit("clash")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


# 1


@pytest.mark.parametrize("limits", [{}, {"trie_bytes": 40_000, "owner_bytes": 50_000}])
def test_exact_duplicates(odd, limits):
    got = op1.exact_duplicates(odd, **limits).collect()
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[lowered(t)].append(i)
    assert len(got) == len(odd_rows())
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(by_digest)


def test_exact_duplicates_of_nothing(empty):
    assert op1.exact_duplicates(empty).count() == 0
    assert op1.deduplicate(empty).collect() == [] and op1.deduplicate(empty).columns == empty.columns


def test_deduplicate(spark):
    """Repeated ids with texts that differ in case only, null against empty, and columns with the names that are used inside."""
    rows = [(10, "Abc"), (10, "abc"), (11, None), (11, ""), (12, "ABC"), (9, "x"), (9, "y"), (None, "z"), (3, "z"), (None, "only"), (None, "only"), (7, "x" * 100_000), (8, "X" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in ("_id", "_digest", "kept_id", "digest", "kept", "KEPT_DIGEST")})
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want = Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())
    got = op1.deduplicate(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, lowered(r.text)) for r in got.collect()) == want


def test_trie():
    rng = random.Random(1)
    trie, want, away = PatriciaTrie(lambda a, b: a + b), Counter(), Counter()
    for _ in range(4000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        want[key] += 1
        if not trie.insert(key, 1):
            away[key] += 1
        if rng.random() < 0.003:
            for k, v in trie.give_up():
                away[k] += v
    assert Counter(dict(trie.items())) + away == want
    assert not set(dict(trie.items())) & set(away)


# 2 and 4


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op2.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    held = got.filter("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)
    assert got.filter("held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count() == 0


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (12, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert op2.quality(odd, labels).count() == len(odd_rows())
    assert op2.quality(empty, labels).count() == 0
    assert {r.score for r in op2.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert op2.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op4.language_id(docs).filter("held_out").join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    odds = op4.language_id(odd).collect()
    assert len(odds) == len(odd_rows())
    no_letter = {r.doc_id for r in odds if r.lang_pred == "und"}
    assert no_letter == {4, 5, 8}
    assert op4.language_id(empty).count() == 0
    assert {r.lang_pred for r in op4.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 20, 200])
def test_codewords(n):
    code = op4.codewords(n)
    assert len(np.unique(code, axis=0)) == n or n == 1
    assert n == 1 or all(len(set(c)) == 2 for c in code.T)
    if n > 5:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= code.shape[1] / 4


# 3


def shingles(text, lower=str.lower):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches(docs, texts):
    got = {r.doc_id: r for r in op3.fingerprint(docs, ranges=7).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for at, i in enumerate(order):
        text, following = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(abs(got[i].near_edited - jaccard(shingles(text), shingles(edited))))
    assert sum(errors) / len(errors) < 0.06
    prints = defaultdict(set)
    for i, t in texts.items():
        prints[t].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_sketches_of_odd_rows(spark, odd, empty):
    assert op3.fingerprint(odd).count() == len(odd_rows())
    assert op3.fingerprint(empty).count() == 0
    one = op3.fingerprint(spark.createDataFrame([(5, "a b c d e f", "", "", 0)], SCHEMA)).head()
    assert one.edited_sha256 == hashlib.sha256(("a b c d e f"[:6] + "a b c d e f"[:5]).encode()).hexdigest()
    assert one.near_next == 1.0


# 5


def test_bpe(docs, texts, odd):
    tiktoken = pytest.importorskip("tiktoken")
    with open(op5.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=op5.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    for table, source in ((docs, list(texts.items())), (odd, [(i, t) for i, t, *_ in odd_rows()])):
        want = Counter()
        for i, t in source:
            ids = library.encode_ordinary(t or "")
            want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
        assert Counter(map(tuple, op5.bpe_encode(table).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_bpe_of_odd_strings(seed):
    tiktoken = pytest.importorskip("tiktoken")
    with open(op5.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=op5.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(seed)
    letters = "ab 'sSt\n\t\r  \x1c\x85\xa0\u2003\u3000éÉßñ1２Ⅷ..!?漢字😀\u0301\u200b"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["ab" * 2000, "!" * 500]
    for text, blob in zip(odd, op5.encode_texts(odd, op5.default_path(), op5.default_pattern()), strict=True):
        ids = np.frombuffer(blob, dtype="<u4").tolist()
        assert ids == library.encode_ordinary(text) and op5.decode_ids(ids, op5.default_path()) == text.encode()


def test_bpe_of_other_patterns():
    """Matches across spaces."""
    tiktoken = pytest.importorskip("tiktoken")
    with open(op5.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    for pattern in (r"[^\n]+|\n", r"\w+ \w+|\w+|\W"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for text in ("one two three four", "of the first", "a  b\nc d e"):
            assert np.frombuffer(op5.encode_texts([text], op5.default_path(), pattern)[0], dtype="<u4").tolist() == library.encode_ordinary(text)


# 6


def plain_groups(rows, percent=75):
    sets = [(i, shingles(t, lowered)) for i, t in rows]
    tree = {i: i for i, _ in rows if i is not None}

    def root(x):
        while tree[x] != x:
            x = tree[x]
        return x

    holders = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(at)
    both = Counter((a, b) for own in holders.values() for a in own for b in own if a < b)
    for (a, b), n in both.items():
        (i, s), (j, t) = sets[a], sets[b]
        if i is not None and j is not None and 100 * n >= percent * (len(s) + len(t) - n):
            p, q = root(i), root(j)
            tree[max(p, q)] = min(p, q)
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def near_copies(seed, groups=12, size=9):
    rng = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for g in range(groups):
        words = [f"{rng.choice(WORDS)}{rng.randint(0, 400)}" for _ in range(rng.randint(4, 90))]
        for _ in range(rng.randint(1, size)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 99)}"
            if g % 3 == 0:
                own[len(own) // 2 : len(own) // 2] = passage
            rows.append((rng.randint(0, 10_000) * 100 + len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [op6.BLOCK, 200])
def test_near_groups(spark, seed, block):
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    assert Counter(map(tuple, op6.near_groups(df, block=block).collect())) == plain_groups(rows)


def test_near_groups_of_odd_rows(odd, empty):
    assert Counter(map(tuple, op6.near_groups(odd).collect())) == plain_groups([(i, t) for i, t, *_ in odd_rows()])
    assert op6.near_groups(empty).count() == 0


def test_often_shared_hashes(spark, monkeypatch):
    rows = near_copies(5, groups=4, size=40)
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    monkeypatch.setattr(op6, "OFTEN", 3)
    chunk = list(op6._chunk_rows(0, [i for i, _ in rows], op6.shingle_sets([t.encode() for _, t in rows]), 4))
    answered = [r for b in op6._answer(iter([op6._batch(sorted(chunk, key=lambda r: (r[1], r[0])))])) for r in op6._rows(b)]
    found = [r for b in op6._sets(iter([op6._batch(sorted(answered, key=lambda r: (r[0], r[1])))]), 75) for r in b.to_pylist()]
    own = {i: shingles(t, lowered) for i, t in rows}
    shared = Counter(x for s in own.values() for x in s)
    for r in found:
        n = sum(shared[x] > 1 for x in own[r["doc_id"]])
        if r["members"] is not None:
            assert len(r["members"]) == 8 * n
    assert df.count() == len(found)


def test_t_occurrence():
    rng = random.Random(3)
    for _ in range(300):
        lists = [np.array(sorted(rng.sample(range(40), rng.randint(0, 30))), dtype=np.int64) for _ in range(rng.randint(1, 12))]
        t = rng.randint(1, 12)
        count = Counter(x for own in lists for x in own.tolist())
        ids, n = t_occurrence(lists, t)
        assert dict(zip(ids.tolist(), n.tolist())) == {k: v for k, v in count.items() if v >= t}


def test_search():
    """One query against many sets, of which only a part of the hashes may be shared."""
    rng = random.Random(8)
    for _ in range(200):
        own = sorted(rng.sample(range(30), rng.randint(1, 20)))
        sets = [sorted(set(own) ^ set(rng.sample(range(40), rng.randint(0, 8)))) for _ in range(rng.randint(1, 25))]
        unshared = [rng.randint(0, 3) for _ in sets]
        got = search(np.array(own, dtype=np.uint64), len(own), [np.array(s, dtype=np.uint64) for s in sets], np.array([len(s) + u for s, u in zip(sets, unshared)]), 75)
        want = [i for i, (s, u) in enumerate(zip(sets, unshared)) if s and 100 * len(set(own) & set(s)) >= 75 * (len(set(own) | set(s)) + u)]
        assert got.tolist() == want


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    tree = {x: x for e in links for x in e}

    def root(x):
        while tree[x] != x:
            x = tree[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        tree[max(p, q)] = min(p, q)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == {(x, root(x)) for x in linked}


# 7


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "http://ORG/x": ("org", "/x", "org/", "allow"), "http://org": ("org", "", None, "allow"), "http://org?x": ("org", "", None, "allow"),
        "http://a.Example.org/es/1?u=/fr/": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "x://example.org/en/18.html#t": ("example.org", "/en/18.html", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"), "http://a.com/de": ("a.com", "/de", None, "allow"), "http://a.com:80/de/": ("a.com:80", "/de/", None, "allow"),
        "http://b.com/fr/x//y": ("b.com", "/fr/x//y", "com/fr/", "allow"), "http://É.com/fr/": ("É.com", "/fr/", "com/fr/", "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op7.filter_urls(pages).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert op7.filter_urls(pages.limit(0)).count() == 0


def test_urls_of_any_length(spark):
    """Megabytes of one segment, of many segments and of many labels; repeated rows, columns with names of results."""
    long_ = ["http://example.org/es/" + "a" * 3_000_000, "http://example.org/" + "x/" * 1_000_000, "http://" + "a." * 1_000_000 + "example.org/en/1", "http://example.org/en/1" + "1" * 3_000_000]
    pages = spark.createDataFrame([(1, long_[0]), (2, long_[1]), (3, long_[2]), (4, long_[3]), (4, long_[3])], "page_id long, url string").withColumns({n: F.lit("clash") for n in ("host", "path", "rule", "verdict")})
    got = [(r.page_id, r.rule, r.verdict) for r in op7.filter_urls(pages).select("page_id", "rule", "verdict").collect()]
    assert sorted(got) == [(1, "example.org/es/", "block"), (2, "org/", "allow"), (3, "example.org/en/1", "block"), (4, "example.org/en/1", "block"), (4, "example.org/en/1", "block")]


def test_longest_host_first():
    trie = op7.UrlTrie([("allow", "b.com", "/"), ("block", "com", "/a/b/c"), ("block", "b.com", "/x"), ("allow", "b.com", "/x/y/")])
    assert trie.find("a.b.com", "/a/b/c")[0] == "b.com/" and trie.find("b.com", "/xyz")[0] == "b.com/x" and trie.find("b.com", "/x/y/z")[0] == "b.com/x/y/"
    assert trie.find("com", "/a/b/cd")[0] == "com/a/b/c" and trie.find("", "") is None


# 8 and 9


def plain_ids(name, end, rows):
    own = encoder(vocabulary(name))
    return [(i, own.whole(t or "") + end.to_bytes(4, "little")) for i, t in rows]


def test_encoder_is_the_library(texts):
    rng = random.Random(4)
    letters = "ab 'sSt\n\t\r  \x1c\x85\xa0\u3000éÉßñ1２Ⅷ..!?漢字😀\u0301\u200bΣς<|endoftext|>İI"
    odd = [*texts.values(), *("".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)), "a." * 300]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = encoder(vocabulary(name))
        assert own.encode(odd) == [own.whole(t) for t in odd]


def test_store(spark, odd, empty, tmp_path):
    out = f"file://{tmp_path}/store"
    op8.write_store(odd, out)
    blobs = sorted(plain_ids(op8.VOCABULARY, 1, [(i, t) for i, t, *_ in odd_rows()]), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    start, want = 0, Counter()
    for i, b in blobs:
        want[(i, start if i not in (10,) else None, len(b) // 4, zlib.crc32(b))] += 1
        start += len(b) // 4
    got = op8.read_sums(spark, out).collect()
    assert Counter((r.doc_id, r.start if r.doc_id not in (10,) else None, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.start for r in got) == [0, *np.cumsum([len(b) // 4 for _, b in blobs])[:-1].tolist()]
    assert Counter((r.doc_id, np.array(r.ids, dtype="<u4").tobytes()) for r in op8.read_ids(spark, out).collect()) == Counter(blobs)
    stored = op8.chunks(spark, out).collect()
    assert len({bytes(r.digest) for r in stored}) == len(stored)
    assert sum(r.n_ids for r in stored) < start
    assert op8.verify(spark, out)
    assert op8.store_and_read(empty).count() == 0


def test_store_files(spark, odd, tmp_path, monkeypatch):
    """Tasks write the store themselves, whole files only; by Spark's writer, where pyarrow doesn't know the file system, it has the same rows."""
    op8.write_store(odd, f"file://{tmp_path}/own")
    names = [p.name for x in ("chunks", "recipes") for p in (tmp_path / "own" / x).rglob("*") if p.is_file()]
    assert names and all(re.fullmatch(r"part-\d+\.parquet", n) for n in names)

    def unknown(path):
        raise pa.ArrowInvalid("no such file system")

    monkeypatch.setattr(parts, "placed", unknown)
    op8.write_store(odd, f"file://{tmp_path}/other")
    read = [(op8.chunks(spark, out).orderBy("digest").collect(), op8.recipes(spark, out).select("doc_id", "n_tokens", "digests", "lengths").orderBy("doc_id", "n_tokens", "digests").collect(), op8.verify(spark, out)) for out in (f"file://{tmp_path}/own", f"file://{tmp_path}/other")]
    assert read[0] == read[1] and read[0][2]


def test_failed_part(spark, tmp_path):
    """A step that fails leaves no file."""
    def step(batches):
        for batch in batches:
            yield "a", batch
        raise ValueError("in between")

    with pytest.raises(Exception, match="in between"):
        parts.write_parts(spark.range(100), step, "id long", f"file://{tmp_path}/failed")
    assert not [p for p in (tmp_path / "failed").rglob("*") if p.is_file()]
    assert parts.write_parts(spark.range(0), lambda b: (("a", x) for x in b), "id long", f"file://{tmp_path}/none") == 0
    assert parts.read_parts(spark, "id long", f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 300])
def test_repeated_chunks(size):
    """Equal digests on both sides of a batch's end, after rows of documents."""
    rng = random.Random(size)
    digests = [None] * 5 + sorted(rng.choices([rng.randbytes(16) for _ in range(40)], k=200))
    batches = pa.table({"digest": pa.array(digests, pa.binary()), "n": list(range(205))}).to_batches(max_chunksize=size)
    got = [(kind, r["digest"]) for kind, b in op8._once(iter(batches)) for r in b.to_pylist()]
    assert got == [("document", None)] * 5 + [("chunk", d) for d in sorted(set(digests[5:]))]


@pytest.mark.parametrize("width", [2, 4])
def test_checked_chunks(width):
    """Sums and ids of chunks of a slice of a batch; other bytes, or another number of ids, are refused."""
    rng = random.Random(width)
    ids = [np.array([rng.randrange(1 << 8 * width) for _ in range(rng.randint(1, 90))], dtype="<u4") for _ in range(30)]
    data = [x.astype(f"<u{width}").tobytes() for x in ids]

    def checked(data, n, full=True):
        batch = pa.RecordBatch.from_arrays([pa.array([op8.digest_of(x.astype(f"<u{width}").tobytes()) for x in ids], pa.binary()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["digest", "n_ids", "data"])
        return [r for b in op8._checked(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)]), width, full) for r in b.to_pylist()]

    n = [len(x) for x in ids]
    assert [(r["n_ids"], r["crc"], r["ids"]) for r in checked(data, n)] == [(len(x), zlib.crc32(x.tobytes()), x.tobytes()) for x in ids]
    for bad in ((data[:9] + [bytes(len(data[9]))] + data[10:], n), (data, n[:9] + [n[9] + 1] + n[10:])):
        with pytest.raises(ValueError, match="differs from its digest"):
            checked(*bad)


def test_crc_of_parts():
    rng = random.Random(1)
    for _ in range(30):
        parts = [rng.randbytes(4 * rng.randint(0, 90)) for _ in range(rng.randint(1, 6))]
        after = np.array([sum(map(len, parts[k + 1 :])) for k in range(len(parts))])
        shares = op8.followed_by(np.array([zlib.crc32(p) for p in parts]), after)
        assert np.bitwise_xor.reduce(shares) == zlib.crc32(b"".join(parts))


def test_chunks_shift():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 50_000, 20_000).astype(np.uint32)

    def cut(x):
        ends = op8.cuts(0, len(x), op8.boundaries(x))
        return [x[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    a, b = cut(shared), cut(np.concatenate([shared[:333], np.array([7], dtype=np.uint32), shared[333:]]))
    assert len(set(a) & set(b)) > 0.9 * len(a)
    assert all(len(x) // 4 <= op8.MOST for x in a) and all(len(x) // 4 >= op8.LEAST for x in a[:-1])


def plain_packing(counts, capacity):
    left, bins = Counter(counts), []
    while sum(left.values()):
        gap, own = capacity, []
        while fits := [x for x in left if left[x] > 0 and x <= gap]:
            own.append(max(fits))
            left[own[-1]] -= 1
            gap -= own[-1]
        if gap and len(own) > 1:
            least = min(own)
            pairs = [(a + b, a) for a in left for b in left if b <= a and left[a] > 0 and left[b] > (a == b) and least < a + b <= gap + least]
            if pairs:
                total, a = max(pairs)
                own.remove(least)
                left[least] += 1
                own += [a, total - a]
                left[a] -= 1
                left[total - a] -= 1
        bins.append(tuple(sorted(own, reverse=True)))
    return sorted(bins)


def test_plan():
    rng = random.Random(0)
    for _ in range(200):
        capacity = rng.choice([8, 20, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        assert sorted(tuple(x for n, k in own for x in [n] * k) for times, own in op9.plan(counts, capacity) for _ in range(times)) == plain_packing(counts, capacity)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, texts, which):
    source = list(texts.items()) if which == "docs" else [(i, t) for i, t, *_ in odd_rows()]
    got = op9.best_fit_pack(request.getfixturevalue(which)).collect()
    want = Counter()
    for i, b in plain_ids(op9.VOCABULARY, 2, source):
        n = len(b) // 4
        at, upto, piece = 0, n - (n - 1) // 1024 * 1024, 0
        while at < n:
            want[(i, piece, at, upto - at, zlib.crc32(b[4 * at : 4 * upto]))] += 1
            at, upto, piece = upto, upto + 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 1024
    assert len(bins) == len(plain_packing(Counter(r.length for r in got), 1024))


def test_packing_of_nothing(empty):
    assert op9.best_fit_pack(empty).count() == 0


# 10


def test_licenses(spark):
    from gridloom.llm.license_texts import MIT, TEXTS

    mine = "MIT Licence\n" + "Copyright (c) 2024 Somebody\n© Others\n" + MIT.partition("\n")[2].upper().replace('"', "'")
    rows = [(1, mine), (2, MIT + "\nand more"), (3, None), (4, ""), (5, "text\nReleased under the MIT Licence!\nlicensed under CC BY-NC 4.0"), (None, TEXTS["Zlib"]), (6, "not a license")]
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in op10.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, ""), 4: (None, ""), 5: (None, "CC-BY-NC-4.0,MIT"), None: ("Zlib", ""), 6: (None, "")}
    assert op10.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_forms(spark):
    """Each short licence with and without titles, and each long one as it is installed here."""
    from pathlib import Path

    from gridloom.llm.license_texts import BSD_HEAD, BSD_TAIL, BSD_THIRD, ISC, MIT, TEXTS

    holder = "\n\nCopyright (c) 2020 Some Body\n\n"
    body = {"MIT": MIT.partition("\n")[2], "ISC": ISC.partition("\n")[2], "0BSD": TEXTS["0BSD"], "BSD-2-Clause": BSD_HEAD + BSD_TAIL, "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_TAIL, "Zlib": TEXTS["Zlib"]}
    titles = {"MIT": "The MIT License (MIT)", "ISC": "The ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
    rows = [(k, title + holder + text) for k, text in body.items() for title in ("", titles[k])]
    rows += [("BSD-3-Clause", rows[9][1].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "BSD-3-Clause": "BSD", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    own = [(k, path.read_text("utf-8")) for k, name in files.items() if (path := Path("/usr/share/common-licenses", name)).exists()]
    rows += own + [(k, text.partition("How to Apply These Terms")[0]) for k, text in own if k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1")]
    rows += [(None, text + "\nand a line more") for _, text in own]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in op10.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]


def test_license_store(spark):
    """A store of one's own, and documents that are its texts whole, in other case and punctuation, or in part; repeated and long ones."""
    texts = spark.createDataFrame([("OWN-1", "The Own Licence\nCopyright 2020 Me\nDo as you like; " + "at all times " * 50_000), ("OWN-2", "Nothing is allowed."), ("ALSO-2", "nothing is allowed")], "license_id string, text string")
    long_ = "THE OWN LICENSE!\n(c) Copyright 1999 You\ndo as you like " + "at all times, " * 50_000
    rows = [(1, long_), (2, "Nothing -- is ALLOWED"), (2, "Nothing -- is ALLOWED"), (3, "Nothing is allowed here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("digest", "license_id", "_spelled")})
    got = Counter((r.doc_id, r.license_id) for r in op10.scan_licenses(docs, op10.digest_store(texts)).collect())
    assert got == Counter({(1, "OWN-1"): 1, (2, "ALSO-2"): 2, (3, None): 1, (None, None): 1})


def test_damaged_store(spark, odd, tmp_path, monkeypatch):
    """A lost chunk, a recipe with other lengths or another place, each in an otherwise whole store."""
    def changed(name, folder, how):
        out, other = f"file://{tmp_path}/{name}", spark.read.parquet(f"file://{tmp_path}/whole/{folder}")
        for x in ("chunks", "recipes", "root"):
            (how(other) if x == folder else spark.read.parquet(f"file://{tmp_path}/whole/{x}")).write.partitionBy(*["kind"] * (x != "root")).parquet(f"{out}/{x}")
        return out

    op8.write_store(odd, f"file://{tmp_path}/whole")
    lost = op8.chunks(spark, f"file://{tmp_path}/whole").first()["digest"]
    for read in (op8.read_sums, op8.read_ids):
        with pytest.raises(Exception, match="a chunk is missing"):
            read(spark, changed(f"lost {read.__name__}", "chunks", lambda df: df.filter(~F.col("digest").eqNullSafe(F.lit(lost))))).collect()
    longer = changed("longer", "recipes", lambda df: df.withColumn("lengths", F.expr("transform(lengths, x -> x + 1)")))
    with pytest.raises(Exception, match="lengths of a recipe"):
        op8.read_sums(spark, longer).collect()
    assert not op8.verify(spark, changed("moved", "recipes", lambda df: df.withColumn("before", F.col("before") + 1)))
    monkeypatch.setattr(op8, "verify", lambda *a: False)
    with pytest.raises(ValueError, match="roots"):
        op8.store_and_read(odd)


def test_sample_has_every_language(spark, monkeypatch):
    """More languages than the bound holds whole samples of, in a table laid out by language."""
    monkeypatch.setattr(op4, "SAMPLE_IN_ALL", 120)
    rows = [(100 * i + j, f"{chr(97 + i) * 3} {chr(98 + i) * 2} {j}", f"l{i:02}") for i in range(12) for j in range(60)]
    model = op4.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == [f"l{i:02}" for i in range(12)]
