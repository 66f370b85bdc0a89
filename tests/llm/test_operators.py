"""The operators against brute force on small fixtures with nulls, empties, long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanveil.llm import content_sort, factors, hashing, importance, mixing, neighbours, packing, parity_join, tokens, url_rules, warc
from spanveil.llm.scratch import keep, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, kept string"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{(i or 0) % 3}", None, 5, 6, "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, alphabet=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(alphabet)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, a hot group, odd characters and sizes."""
    rnd = random.Random(3)
    out = [None, "", " \n\t", "one", "one two three", "One Two\x0bThree", "é É\xa0x 😀 <|endoftext|> y", "a\x00b c"]
    out.append(" ".join(words(9000, 1)))
    base = [words(rnd.randint(8, 160), 10 + k, 5000) for k in range(12)]
    passage = words(60, 77, 5000)
    for k, b in enumerate(base):
        out.append(" ".join(b))
        for _ in range(rnd.randint(0, 6)):
            c = list(b)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):
                c[rnd.randrange(len(c))] = f"z{rnd.randrange(99)}"
            if rnd.random() < 0.3:
                c[5:5] = passage
            out.append((" " if rnd.random() < 0.7 else "\n").join(c).upper() if rnd.random() < 0.3 else " ".join(c))
    out += ["hot copy of one text " * 12] * 40
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    return list(zip(ids, out))


def test_exact_dedup(spark, texts):
    for retain, best in (("smallest", min), ("largest", max)):
        got = {r.doc_id: r for r in content_sort.exact_groups(documents(spark, texts), retain=retain).collect()}
        norm = {i: (t or "").encode().translate(LOW) for i, t in texts}
        groups = {}
        for i, n in norm.items():
            groups.setdefault(n, []).append(i)
        assert len(got) == len(texts)
        for i, n in norm.items():
            keep = best(groups[n])
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(groups[n]), i == keep, hashlib.sha256(n).hexdigest())


def test_exact_dedup_finds_groups_by_neighbours(spark):
    """All equal texts that are not split meet in one run; a text of half the rows is split, one of all rows as well."""
    low = [(i, f"text {i // 2}") for i in range(400)]
    hot = [(1000 + i, "Hot text") for i in range(400)]
    docs = documents(spark, low + hot).repartition(7)
    runs = content_sort.sorted_runs(docs, "doc_id", "text", F.min, False).collect()
    assert all(r.run_size == 2 for r in runs if r.id < 1000)
    own = [r for r in runs if r.id >= 1000]
    assert len({r.run for r in own}) > 1 and sum(r.norm is not None for r in own) == len({r.run for r in own})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = content_sort.sorted_runs(documents(spark, hot), "doc_id", "text", F.min, False).select(F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in tasks}) > 1
    got = content_sort.exact_groups(documents(spark, hot)).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(1000, 400)}


def test_exact_dedup_of_repeated_and_null_ids(spark):
    got = content_sort.exact_groups(documents(spark, [(1, "a"), (1, "a"), (None, "A"), (None, "b")]), retain="largest").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]


@pytest.mark.parametrize("held", [50, 400_000])
def test_substring_dedup(spark, texts, held, monkeypatch):
    monkeypatch.setattr(factors, "HELD", held)
    docs = documents(spark, texts).repartition(5)
    got = {r.doc_id: r for r in factors.remove(docs, factors.parse(docs)).collect()}
    seen = set()
    for i, t in sorted(texts):
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for s in range(len(w) - 19):
            win = tuple(w[s : s + 20])
            if win in seen:
                gone[s : s + 20] = b"\1" * 20
            seen.add(win)
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), kept)


def test_factors_point_to_equal_earlier_words(spark, texts):
    by_id = {i: (t or "").split() for i, t in texts if t and t.isascii()}
    found = factors.parse(documents(spark, [x for x in texts if x[0] in by_id])).collect()
    assert found
    for f in found:
        n = f.windows + 19
        assert (f.ref_doc_id, f.ref_start) < (f.doc_id, f.start)
        assert by_id[f.doc_id][f.start : f.start + n] == by_id[f.ref_doc_id][f.ref_start : f.ref_start + n]


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
@pytest.mark.parametrize("many", [3, 32])
def test_jaccard_join(spark, texts, width, percent, many, monkeypatch):
    monkeypatch.setattr(parity_join, "MANY", many)
    monkeypatch.setattr(parity_join, "CELL", 8)
    got = {r.doc_id: r for r in parity_join.join_components(documents(spark, texts).repartition(3), width, percent).collect()}
    sets = {}
    for i, t in texts:
        w = (t or "").encode().translate(LOW).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), top(i)) for i, s in sets.items()}


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


def test_words_of_one_letter_sum_do_not_collide(spark):
    a, b = thue_morse(1024)
    filler = " ".join(f"f{i}" for i in range(19))
    docs = documents(spark, [(1, f"{filler} {a}"), (2, f"{filler} {b}"), (3, a), (4, b)])
    assert {r.doc_id: r.n_removed for r in factors.remove(docs, factors.parse(docs)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    got = {r.doc_id: r.component_id for r in parity_join.join_components(docs, 4, 85).collect()}
    assert got[3] == 3 and got[4] == 4


def test_word_hashes():
    rnd = random.Random(1)
    for step in (50, 1 << 18):
        texts = ["".join(rnd.choice(["a", "B", "cc ", "\n", "  ", "x" * 33, "y" * 70, "z" * 3000, "é"]) for _ in range(rnd.randrange(30))).encode() for _ in range(200)]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        starts, ends, first = hashing.spans(data, off)
        h = hashing.word_hashes(data, starts, ends, hashing.Table(9, lower=True))
        assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [w for t in texts for w in t.split()]
        assert np.diff(first).tolist() == [len(t.split()) for t in texts]
        names = [w.translate(LOW) for t in texts for w in t.split()]
        assert len(set(names)) == len(set(h.tolist())) == len(set(zip(names, h.tolist())))
        for n in (1, 2, 5, 20):
            g = hashing.ngrams(h, n).tolist()
            grams = [tuple(names[i : i + n]) for i in range(len(names) - n + 1)]
            assert len(set(g)) == len(set(grams)) == len(set(zip(g, grams)))


def test_jaccard_join_of_repeated_and_null_ids(spark):
    a, b = " ".join(words(60, 1, 5000)), " ".join(words(60, 2, 5000))
    near_b = b.replace(b.split()[30], "other")
    rows = [(1, a), (5, a), (5, b), (7, near_b), (None, b), (9, "alone"), (9, "alone")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in parity_join.join_components(documents(spark, rows), 5, 80).collect())
    assert got == sorted([("1", "None"), ("5", "None"), ("5", "None"), ("7", "None"), ("None", "None"), ("9", "9"), ("9", "9")])


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_jaccard_join_beyond_its_broadcasts(spark, texts, small, monkeypatch):
    want = {r.doc_id: r.component_id for r in parity_join.join_components(documents(spark, texts), 4, 85).collect()}
    monkeypatch.setattr(parity_join, "SMALL", small)
    monkeypatch.setattr(parity_join, "BROADCAST_BYTES", small)
    monkeypatch.setattr(parity_join, "MANY", 4)
    assert {r.doc_id: r.component_id for r in parity_join.join_components(documents(spark, texts), 4, 85).collect()} == want


def test_very_long_text(spark):
    """A text of about 100 MB next to a copy of a part of it."""
    some = lambda n: F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), ((i.cast("long") * 7919) % 1_000_003).cast("string"), F.lit("x"))))
    text = F.repeat(F.concat(some(1_000_003), F.lit(" ")), 11)
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), text.alias("text")).unionByName(spark.range(1).select(F.lit(2).alias("doc_id"), some(1000).alias("text")))
    docs = keep(docs, "test-long")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in factors.remove(docs, factors.parse(docs)).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (11_000_033, 10_000_030), 2: (1000, 1000)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.join_components(docs, 4, 85).collect()}
    assert got == {1: (1_000_003, 1), 2: (997, 2)}


def test_parity_sketch_is_a_lower_bound():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        a, b = rnd.integers(0, 1 << 60, 80, dtype=np.uint64), rnd.integers(0, 1 << 60, 60, dtype=np.uint64)
        x, y = np.unique(np.concatenate([a, b])), np.unique(b)
        s = [parity_join.small_sketches(np.zeros(len(z), np.int64), z, np.array([bits])) [0] for z, bits in ((x, 256), (y, 128))]
        assert parity_join._distance(*s) <= len(np.setxor1d(x, y))


def test_jaccard_join_bands_lose_nothing():
    bands = parity_join.Bands(85)
    for x in range(1, 400):
        for y in range(x, int(x / 0.85) + 1):
            b = int(bands.of(np.array([y]))[0])
            own = int(bands.of(np.array([x]))[0])
            assert own == b or (own == b - 1 and bands.reaches(np.array([x]), np.array([own]))[0])
            assert bands.differences(x + y) <= bands.most[b]


def test_token_counts_and_packing(spark, texts):
    tok = Tokenizer.from_file(PATH)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    docs = documents(spark, texts).repartition(3)
    got = {r.doc_id: r for r in tokens.count_tokens(docs, PATH, limit=50, sample_docs=5).collect()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 50) for i, t in texts}
    rows = packing.pack(docs, PATH, end_id=2, tiers=(256, 128, 64, 32), pool_tokens=3000).withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, v in ids.items():
        whole, at = np.array([*v, 2], "<u4").tobytes(), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.crc == zlib.crc32(whole[4 * at : 4 * (at + r.length)]) and r.doc_tokens == len(v) + 1
            at += r.length
        assert at == len(v) + 1
    for piece in by_seq.values():
        at = 0
        for r in sorted(piece, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == piece[0].tier <= 256 and at & (at - 1) == 0
    steps = Counter()
    for piece in by_seq.values():
        steps[piece[0].step_group] += piece[0].tier
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_pieces_equal_the_library():
    tok, _ = tokens.tokenizer(PATH)
    rnd = random.Random(5)
    bits = ["\x1c", "\x85", "\xa0", "a", "WORD", "é", "É", "\u0301", "\u0338", "'", "'S", "1", "²", "!", ",", ".", "|", "#", "ß", "İ", "ς", "日本", "😀", "<|ENDOFTEXT|>", "K", "I", "z,"]
    pieces = [p for _ in range(4000) for p in "".join(rnd.choices(bits, k=rnd.randint(1, 6))).encode().split()]
    known = tokens.Pieces(tok, lambda e: tuple(e.ids)).learn([pieces])
    assert all(known[p] == tuple(tok.encode(p.decode(), add_special_tokens=False).ids) for p in set(pieces))


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rnd.standard_normal(16)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]  # ties
    odd = [(330, None), (340, [0.0] * 16), (350, [float("nan")] * 16), (360, [None] + [1.0] * 15), (370, [float("inf")] + [1.0] * 15), (380, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, id string").repartition(4)
    got = {}
    for r in neighbours.nearest(df, F.pmod("id", F.lit(10)) == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i, _ in rows if i % 10 == 0]
    x = np.array([v for _, v in rows])
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11)) and all(s == d[v] for _, v, s in found)
    assert hits / (10 * len(got)) >= 0.95
    assert neighbours.nearest(df.where("vec_id > 329"), F.lit(True), k=10).where("vec_id is not null").count() == 0
    assert neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("id") == 0).count() == 2


def test_code_error_bound():
    rnd = np.random.default_rng(2)
    x, turn = rnd.standard_normal((2000, 64)), neighbours.rotation(64, 4, 3)
    centre = np.zeros(64)
    epsilon = neighbours.calibrated(x, centre, turn, 0.005)
    code, norm, dot = neighbours.encode(x, centre, turn)
    q = rnd.standard_normal((50, 64))
    length, unit = neighbours.turned(q, centre, turn)
    true = (q @ x.T) / norm / length[:, None]
    missed = np.mean(true > neighbours.estimates(unit, code, dot) + epsilon * neighbours.deviation(dot, 256))
    assert missed < 0.01


@pytest.mark.parametrize("block", [16_384, 7])
def test_neighbours_compares_few_exactly(spark, block):
    x = np.random.default_rng(5).standard_normal((4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (17, x[17].tolist())], "vec_id long, embedding array<double>").repartition(3)
    stats = {}
    got = {}
    for r in neighbours.nearest(df, F.pmod("id", F.lit(200)) == 0, block=block, stats=stats).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == list(range(0, 4000, 200)) and stats["exact"] < 0.2 * stats["pairs"]
    x = np.vstack([x, x[17]])
    ids = np.append(np.arange(4000), 17)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [r for r, _ in sorted(found)] == list(range(1, 11))
        hits += len(set(want) & {v for _, v in found})
    assert hits >= 0.95 * 10 * len(got)


def test_neighbours_of_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(empty, F.lit(True)).count() == 0


def test_warc_round_trip(spark):
    magic = "WARC/1.0\r\n"
    fake = magic + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "x" * 1200
    rows = [(1, "http://a/", big), (2, None, fake + "tail"), (3, "u", big), (4, "u", None), (5, "u", ""), (6, "u\r\n" + magic, magic), (7, "u", "abc" + magic * 2 + "WARC/1.0"), (8, "u", fake * 60 + "é"), (9, "u", "WARC/1.0\r"), (None, "u", "z"), (11, "u", fake.replace("5", "2000") + "\r\n\r\n")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # splits inside records
    try:
        path = new_path(spark, "test")
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
        out = [(warc_id(r.headers), field(r.headers, "WARC-Type"), field(r.headers, "WARC-Refers-To"), bytes(r.payload).decode()) for r in warc.read_warc(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("" if i is None else str(i), "revisit" if i == 1 else "response", "<urn:page:3>" if i == 1 else None, "" if i == 1 else h or "") for i, _, h in rows]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_warc_does_not_depend_on_splits(spark, monkeypatch):
    """The split size changes after every table that is written."""
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, "u", "plain " * (i % 40) if i % 3 else fake * (1 + i % 5) + str(i)) for i in range(200)]
    before, sizes = spark.conf.get("spark.sql.files.maxPartitionBytes"), [3000, 500, 100_000, 1700]

    def keep_and_change(df, *tag, keep=warc.keep):
        out = keep(df, *tag)
        sizes.append(sizes.pop(0))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(sizes[0]))
        return out

    monkeypatch.setattr(warc, "keep", keep_and_change)
    try:
        path = new_path(spark, "test")
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
        out = [(int(warc_id(r.headers)), bytes(r.payload).decode()) for r in warc.read_warc(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(out) == [(i, h) for i, _, h in rows]


def field(headers, name):
    found = re.search(rf"(?m)^{name}: (.*?)\r?$", headers)
    return found and found[1]


def warc_id(headers):
    return field(headers, "WARC-Record-ID").removeprefix("<urn:page:").removesuffix(">")


def test_warc_of_no_pages(spark):
    path = new_path(spark, "test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "block"), ("example.net", "/en/x", "block"), ("org", "/fr/", "allow"), ("b.org", "/", "block"), ("0.net", "/", "allow")]
    rnd = random.Random(4)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "example-a.net", "org", "b.org", "c.b.org", "NET", "a,b.net", "net.", ".net", "0.net", "-.net", "example.net:80", ""]
    urls = [None, "", "no scheme", "http://", "x://y://net/"] + [f"http://{h}{rnd.choice(['', '/', '/en/', '/en/x?y', '/fr/#z', '?q=/en/', '#/fr/', '/EN/'])}" for h in hosts for _ in range(6)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for salts in (1, 5):
        for r in url_rules.judge_urls(pages, table, salts=salts).collect():
            u = urls[r.page_id] or ""
            rest = u.split("://", 1)[1] if "://" in u else ""
            host = re.match(r"[^/?#]*", rest)[0].translate({k: k + 32 for k in range(65, 91)})
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
            best = max((x for x in rules if fits(host, path, x)), key=lambda x: len(x[0] + x[1]), default=None)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert url_rules.judge_urls(pages, table.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def apportioned(votes, seats):
    won = Counter()
    for _ in range(seats):
        won[max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), [-ord(c) for c in k]))] += 1
    return won


@pytest.mark.parametrize("seats", [0, 1, 7, 1000])
def test_sainte_lague(spark, seats):
    votes = {"a": 500.0, "b": 300.0, "c": 300.0, "d": 3.0, "e": 0.0, "f": 97.5}
    df = spark.createDataFrame([("g", k, v, seats) for k, v in votes.items()], "g string, k string, v double, s long")
    assert {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "v", "s", ["k"]).collect()} == {k: apportioned(votes, seats)[k] for k in votes}


def test_mixing(spark, texts):
    sources = {i: [None, "b", "a", "Z", "é"][min(4, i % 9)] for i, _ in texts}
    docs = documents(spark, texts, sources)
    got = {r.doc_id: r for r in mixing.mix(docs, shard_words=500).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in texts}
    total = sum(size.values())
    by = Counter()
    for i, n in size.items():
        by[sources[i]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(total)
    while True:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * by[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * by[s]
            rest -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and r.source_size == by[sources[i]] and math.isclose(r.target, target[sources[i]]) and 0 <= r.taken <= 3 * size[i]
        taken[sources[i]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 2 for s in order)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7), shard_words=500).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    out = mixing.apply_mix(docs, mixing.mix(docs, shard_words=500))
    assert out.columns == docs.columns
    emitted = Counter()
    for r in out.collect():
        emitted[r.doc_id] += len(WORD.findall(r.text))
    assert emitted == Counter({i: r.taken for i, r in got.items() if r.taken})


def test_importance(spark):
    rnd = random.Random(6)
    good = lambda: " ".join(rnd.choice(["red", "green", "blue", "tree", "house", "river"]) + str(rnd.randrange(30)).translate({k: k + 49 for k in range(48, 58)}) for _ in range(rnd.randint(20, 200)))
    rows, bad = [], set()
    for i in range(3000):
        t = good()
        if i % 6 == 0:
            w = t.split()
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["scoundrel", "villain"])
            t = " ".join(w)
            bad.add(i)
        elif i % 11 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
            bad.add(i)
        rows.append((i, t))
    docs = documents(spark, rows + [(3000, None), (3001, ""), (3001, "")])
    labels = spark.createDataFrame([(i, 0 if i in bad and i % 6 else 1, 1 if i in bad and i % 6 == 0 else 0) for i in range(0, 3000, 2)] + [(9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in importance.resample(docs, labels).collect()}
    assert len(got) == 3002 and got[3000] and got[3001]
    held = [i for i in range(1, 3000, 2)]
    assert sum(got[i] for i in held if i not in bad) / sum(i not in bad for i in held) > 0.98
    assert sum(not got[i] for i in held if i in bad) / sum(i in bad for i in held) > 0.95
    assert {r.doc_id: r.kept for r in importance.resample(docs.repartition(5), labels).collect()} == got
    assert all(r.kept for r in importance.resample(docs.limit(50), labels.limit(0)).collect())


@pytest.mark.parametrize("sharpness", [importance.SHARPNESS, 1.0])
def test_importance_equals_brute_force(spark, sharpness):
    rnd = random.Random(12)
    rows = []
    for i in range(160):
        w = [rnd.choice(["red", "green", "Blue", "tree,", "house", "river", "a-b", "ünd"]) + rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))]
        if i % 4 == 0:
            w += ["scoundrel"] * rnd.randint(1, 3) + ["villain!!"]
        rows.append((i, " ".join(w) if i % 37 else None))
    labels = [(i, int(i % 4 > 0 or rnd.random() < 0.1), int(i % 8 == 0)) for i in range(0, 160, 2)] + [(2, 0, 0), (None, 1, 0), (999, 0, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.resample(documents(spark, rows).repartition(3), frame, sharpness=sharpness).collect()}
    want = brute.resampled(spark, rows, labels, sharpness=sharpness)
    assert len(got) == len(want) and any(w[3] < w[4] for w in want)
    for i, ratio, weight, key, kth in want:
        r = got[i]
        assert math.isclose(r.log_ratio, ratio, rel_tol=1e-5, abs_tol=1e-4) and math.isclose(r.weight, weight, rel_tol=5e-3 * sharpness) and math.isclose(r.key, key, abs_tol=5e-3 * sharpness)
        assert r.kept == (key >= kth) or abs(key - kth) < 0.01 * sharpness


def test_importance_of_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    free = sorted(r.doc_id for r in docs.join(labels, "doc_id", "left_anti").collect())
    planted = docs.where(F.col("doc_id").isin(*free[::8])).select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit(" You scoundrel, a villain and a swine.")).alias("text"))
    ids = sorted(r.doc_id for r in planted.collect())
    marks = spark.createDataFrame([(i, 1, 1) for i in ids[::2]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.resample(docs.unionByName(planted), labels.unionByName(marks)).collect()}
    assert len(got) == 200 + len(ids) and len({r.log_ratio for r in got.values()}) > 150
    assert not any(got[i].kept for i in ids)
    assert sum(got[i].kept for i in clean) >= 0.9 * len(clean)


def test_importance_prior_of_capped_labels(spark):
    docs = documents(spark, [(i, "scoundrel villain" if i % 4 == 0 else "tree house") for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    top = max(r.weight for r in importance.resample(docs, labels, most_labelled=60).collect())
    assert math.isclose(top, 1 / 0.75, rel_tol=1e-3)


def test_importance_keeps_all_where_labels_tell_nothing(spark):
    rnd = random.Random(9)
    docs = documents(spark, [(i, " ".join(rnd.choice("abcdefghijklmnop") for _ in range(30))) for i in range(200)])
    labels = spark.createDataFrame([(i, int(rnd.random() < 0.7), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in importance.resample(docs, labels).collect())


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "LAST_BIN", 5)
    values = [random.Random(8).gauss(0, 1) for _ in range(500)] + [0.25] * 40
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 77, 250, 540):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, 541) is None and importance.kth_largest(df, 0) is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert content_sort.exact_groups(empty).count() == mixing.mix(empty).count() == tokens.count_tokens(empty, PATH).count() == packing.pack(empty, PATH).count() == 0
    assert factors.remove(empty, factors.parse(empty)).count() == parity_join.join_components(empty).count() == importance.resample(empty, labels).count() == 0
    assert url_rules.judge_urls(pages, rules).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(words(45, 4))
    rows = [(None, text), (None, text), (3, text), (3, text), (4, "a b"), (4, "a b"), (5, None)]
    docs = documents(spark, rows)
    counts = lambda rs: Counter(map(tuple, rs))
    tok = Tokenizer.from_file(PATH)
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    assert counts(tokens.count_tokens(docs, PATH).select("doc_id", "n_tokens").collect()) == Counter((i, n(t)) for i, t in rows)
    pieces = packing.pack(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert counts(pieces) == Counter({(i, sum(n(t) + 1 for j, t in rows if j == i)): 1 for i in (None, 3, 4, 5)})
    # rows with one id are copies of one document; a null id comes before all others
    left = factors.remove(docs, factors.parse(docs)).select("doc_id", "n_words", "n_removed").collect()
    assert counts(left) == Counter({(None, 45, 0): 2, (3, 45, 45): 2, (4, 2, 0): 2, (5, 0, 0): 1})
    mixed = mixing.mix(docs).select("doc_id", "size", "source_size", "taken").collect()
    assert sum(r.taken for r in mixed) == 184 and Counter(r.doc_id for r in mixed) == Counter(i for i, _ in rows) and all(r.taken <= 3 * r["size"] for r in mixed)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert counts(url_rules.judge_urls(pages, rules).collect()) == Counter({(1, "a.net", "/x", "net/", "block"): 2, (None, "", "", None, "allow"): 2})


def test_warc_of_repeated_rows(spark):
    big = "y" * 1500
    rows = [(1, "u", big), (1, "u", big), (2, "u", "z"), (2, "u", "z"), (None, None, None), (None, None, big)]
    path = new_path(spark, "test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((warc_id(r.headers), field(r.headers, "WARC-Type"), len(r.payload)) for r in warc.read_warc(spark, path).collect())
    assert got == [("", "response", 0), ("", "revisit", 0), ("1", "response", 1500), ("1", "response", 1500), ("2", "response", 1), ("2", "response", 1)]


def test_counts_of_another_tokenizer(spark, texts):
    """A tokenizer that cuts in another way gets whole texts."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    some = texts[:40]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(documents(spark, some), path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in some}


def test_seats_of_many_equal_parties(spark):
    """Far fewer seats than parties, all quotients equal: the first in order get them."""
    df = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.lit(100.0).alias("v"), F.lit(700).alias("s"))
    got = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "v", "s", ["k"]).collect()}
    assert got == {k: int(k < 700) for k in range(2000)}
