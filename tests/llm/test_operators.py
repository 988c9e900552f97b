"""Each operator against brute force on a small table with the awkward cases."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolake.llm import bpe, decontam, exact_dedup, language, near_dedup, quality, scratch, shingles, suffix_dedup, token_files, toxicity, warc

SCHEMA = "doc_id bigint, text string, id string, key int, n int, node string, doc string, th string"


def rows_of(texts):
    """(id, text) and columns whose names clash with those used inside."""
    return [(i, t, "x", 1, 2, "y", "z", "w") for i, t in texts]


@pytest.fixture(scope="module")
def words():
    random.seed(7)
    return ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(300)]


@pytest.fixture(scope="module")
def texts(words):
    random.seed(11)
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    base = [make(random.randint(30, 120)) for _ in range(40)]
    out = list(enumerate(base))
    out += [(100 + k, base[k % 3]) for k in range(9)]  # copies
    for k in range(12):  # near copies
        w = base[5].split()
        w[random.randrange(len(w))] = f"new{k}"
        out.append((200 + k, " ".join(w)))
    passage = make(40)
    out += [(300 + k, make(10) + " " + passage + " " + make(10)) for k in range(8)]
    out += [(400, None), (401, ""), (402, "one"), (403, " \n\t "), (404, make(20_000)), (405, "é ñ 中 😀 <|endoftext|> 's"), (None, base[0]), (7, base[7]), (406, "aaaa" * 200), (407, "aaaa" * 200)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, texts, nothing, monkeypatch):
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    for keep in (max, min):
        want = sorted(((-1 if i is None else i), keep(x for x in groups[t or ""] if x is not None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
        got = exact_dedup.exact_dedup(docs, keep=keep.__name__).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_trie_spills_by_subtree():
    random.seed(3)
    keys = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 40))) for _ in range(800)]
    rows, classes, rounds = [(key, k, k, 1) for k, key in enumerate(keys)], [], 0
    while rows:
        trie, again = exact_dedup.OwnerTrie(limit=30_000), []
        for key, *value in rows:
            name, elsewhere = trie.insert(key, *value)
            assert name == hashlib.sha256(key).hexdigest()
            again += elsewhere
        classes += trie.classes()
        assert rounds or trie.spilled
        rows, rounds = again, rounds + 1
    want = {}
    for k, key in enumerate(keys):
        want.setdefault(hashlib.sha256(key).hexdigest(), []).append(k)
    assert rounds > 2 and len(classes) == len(want)
    assert {(n, a, b, c) for n, a, b, c in classes} == {(n, min(x), max(x), len(x)) for n, x in want.items()}


def test_trie_counts_whole_keys():
    trie = exact_dedup.PatriciaTrie()
    for k in range(50):
        trie.terminal(b"x" * 1000 + str(k).encode())
    assert trie.root.held >= 50 * 1000
    before = trie.root.held
    prefix, node = trie.cut()
    assert prefix.startswith(b"x" * 1000) and trie.root.held == before - node.held


def test_exact_dedup_in_rounds(docs, texts):
    plain = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    assert sorted(map(str, exact_dedup.exact_dedup(docs, trie_bytes=20_000).collect())) == plain


def test_bpe(docs, texts, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    encoded = bpe.bpe_encode(docs, path)
    assert all(r.ids == want[r.doc_id] for r in encoded.collect())
    decoded = {r.doc_id: r.text for r in bpe.bpe_decode(encoded, path).collect()}
    assert all(decoded[i] == library.decode(want[i], skip_special_tokens=False) == (t or "") for i, t in texts)
    for r in bpe.bpe_round_trip(docs, path).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest() and r.n_tokens == len(want[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(nothing, path).count() == 0


def test_bpe_on_random_bytes():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.automaton(path)
    random.seed(5)
    odd = ["a", "the", " ", "  ", "\n", "'s", "é", "中", "😀", "12", "...", "A", "aa", "\x1c", "̈", "　", "'", "'ll", "tion", "\xa0", "²", "<|endoftext|>"]
    for n in range(1200):
        pool = odd if n % 3 else [chr(x) for x in range(0x250)]
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 50))) + "-" * (n % 40)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_by_table_and_by_one_long_word():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.automaton(path)
    random.seed(8)
    words = ["".join(random.choice("abeinorst") for _ in range(random.randint(1, 16))) for _ in range(3000)]
    want = [library.encode(x, add_special_tokens=False).ids for x in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.paths([x.encode() for x in words])] == want
    assert [own.path(x.encode()) for x in words] == want
    long = "".join(words)
    assert own.path(long.encode()) == library.encode(long, add_special_tokens=False).ids


def test_bpe_gadgets_against_merges_by_rank():
    """Compiled arcs of random small vocabularies against merging the leftmost pair of the least rank."""
    for seed in range(30):
        random.seed(seed)
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 14:
            u, v = random.choice(tokens), random.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                merges.append((u, v))
                tokens.append(u + v)
        ids = {x: k for k, x in enumerate(tokens)}
        own = bpe.TokenAutomaton.__new__(bpe.TokenAutomaton)
        own.labels = [x.encode() for x in tokens]
        own.compile([0, 1, 2], [(ids[u], ids[v], ids[u + v]) for u, v in merges])
        own.grow_tree()
        own.lengths, own.sizes = list(map(len, tokens)), np.array(list(map(len, tokens)), np.int32)
        words = ["".join(random.choice("abc") for _ in range(random.randint(1, 12))) for _ in range(200)]
        for word, got in zip(words, own.paths([x.encode() for x in words]), strict=True):
            parts = list(word)
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (u, v):
                        parts[k : k + 2] = [u + v]
                    k += 1
            assert np.frombuffer(got, "<u4").tolist() == [ids[x] for x in parts] == own.path(word.encode())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, texts, encoding):
    path, name = scratch.new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(docs, path, name, 2, encoding=encoding)
    library = Tokenizer.from_file(name)
    got = token_files.token_offsets(spark, path).join(token_files.token_digests(spark, path), ["file", "row"]).collect()
    start = 0
    ordered = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    for (i, t), r in zip(ordered, sorted(got, key=lambda r: r.start), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read_tokens(spark, path, 100, 108)
    assert some.count() == 9
    assert "tokens:array" not in token_files.read_tokens(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()


def components_by_force(texts, size, percent):
    sets = {k: set(shingles.shingle_set(t, size).tolist()) for k, (_, t) in enumerate(texts)}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            x, y = texts[a][0], texts[b][0]
            if x is not None and y is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in texts if i is not None}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("small", [1024, 3])
def test_near_dedup(docs, texts, nothing, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    want, _ = components_by_force(texts, 2, 80)
    got = near_dedup.near_dedup(docs, shingle=2).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    if small == 1024:
        assert near_dedup.near_dedup(nothing).count() == 0


@pytest.mark.parametrize("small", [1024, 16, 4])
def test_near_dedup_recall_where_nodes_branch(spark, monkeypatch, small):
    """Links of ids divisible by 50 (true pairs at 0.8 and little above, texts that share most of their words) against all rows."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    random.seed(31)
    common = [f"c{k}" for k in range(200)]
    rows = []
    for k in range(0, 1000, 2):
        text = [*common[:40], *(f"w{k}x{j}" for j in range(60)), *common[40:80]]
        other = list(text)
        for j in range(random.choice((5, 6, 7, 7, 7, 8))):
            other[45 + 7 * j] = f"n{k}y{j}"
        rows += [(k, " ".join(text)), (k + 1, " ".join(other))]
    sets = {i: shingles.shingle_set(t, 2) for i, t in rows}
    true = [(a, b) for a in range(0, 1000, 50) for b in sets if a != b and near_dedup.linked(sets[a], sets[b], 80)]
    assert len(true) > 10
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80).collect()}
    found = sum(got[a] == got[b] for a, b in true)
    every = [(k, k + 1) for k in range(0, 1000, 2)]
    linked = [x for x in every if near_dedup.linked(sets[x[0]], sets[x[1]], 80)]
    print("recall", small, found, len(true), sum(got[a] == got[b] for a, b in linked), len(linked))
    assert found >= 0.99 * len(true) and sum(got[a] == got[b] for a, b in linked) >= 0.99 * len(linked)
    assert all(got[a] != got[b] for a, b in every if (a, b) not in linked)


def test_components(spark):
    random.seed(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + random.randrange(50), 100 + random.randrange(50)) for _ in range(60)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.id: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)} | {k: v for k, v in got.items() if k not in parent}


@pytest.mark.parametrize(("large", "length"), [(5000, 100), (1, 100), (5000, 400), (1, 40), (6, 60)])
def test_suffix_dedup(spark, docs, texts, nothing, monkeypatch, large, length):
    monkeypatch.setattr(suffix_dedup.sort_bucket, "__defaults__", (large,))
    got = {}
    for r in suffix_dedup.repeated_spans(docs, length, buckets=3).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    seen = set()
    for i, t in sorted({x for x in texts}, key=lambda x: -1 if x[0] is None else x[0]):
        b = (t or "").encode()
        cut, at = bytearray(len(b)), {}
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                cut[k : k + length] = b"\1" * length
            else:
                seen.add(b[k : k + length])
        spans = sum(1 for k in range(len(b)) if cut[k] and not (k and cut[k - 1]))
        want = (len(b), sum(cut), spans, hashlib.sha256(bytes(c for c, x in zip(b, cut) if not x)).hexdigest())
        assert set(got[i]) == {want}, i
    if large == 1 and length == 100:
        assert suffix_dedup.repeated_spans(nothing, 100).count() == 0
        with pytest.raises(ValueError):
            suffix_dedup.repeated_spans(docs, 20)


def test_suffixes_are_in_order_of_their_bytes():
    random.seed(4)
    text = "".join(random.choice("ab") for _ in range(4000)).encode() * 3
    at, first, last, *characters = suffix_dedup.anchors(np.frombuffer(text, np.uint8), 60)
    none = np.zeros(len(at), np.int64)
    columns = suffix_dedup.sorted_once((*characters, none.astype(np.uint64), none, none, at, at - first, at - last))
    place = columns[suffix_dedup.CHARACTERS + 3].tolist()
    grams = [text[k : k + suffix_dedup.GRAM] for k in place]
    assert grams == sorted(grams) and sorted(place) == at.tolist() and len(set(grams)) < len(grams)
    assert suffix_dedup.as_bytes(list(columns[: suffix_dedup.CHARACTERS])).tolist() == grams
    again = suffix_dedup.unpacked(suffix_dedup.packed(columns))
    assert all((x == y).all() for x, y in zip(again, columns, strict=True))
    marks = suffix_dedup.splitters_of([(x, 1.0) for x in grams], 5)
    assert len(marks) == 4 and marks == sorted(marks)


def test_warc(spark):
    big, other = "<p>" + "x" * 2000, "é" * 700
    pages = [(1, "http://b.com/1", big), (2, "http://a.com/2?q=1", big), (3, None, other), (4, "bad\r\nurl", "small"), (5, "http://a.com/", "small"), (6, "http://a.com/", None), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 99), (8, "http://B.com/1", big), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = scratch.new_path(spark, "warc")
    warc.write_warc(warc.classify(df), path, records_per_archive=2)
    index = warc.capture_index(spark, path).collect()
    assert len(index) == len(pages)
    for r in index:
        html = next(h for i, _, h in pages if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        again = html == big and r.page_id != 8
        assert (r.record_type, r.refers_to) == (("revisit", 8) if again else ("response", None))
    keys = [(r.url_key, r.captured_at) for r in index]
    assert keys == sorted(keys)
    # a record is read by its offset and length alone, and the archive as one stream
    for r in index:
        with open(r.archive.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            one = gzip.decompress(file.read(r.length))
            file.seek(0)
            whole = gzip.decompress(file.read())
        head, _ = warc.parsed(one)
        assert warc.page_of(head["WARC-Record-ID"]) == r.page_id and one in whole and whole.count(b"WARC-Record-ID") <= 2
    empty = scratch.new_path(spark, "warc")
    warc.write_warc(warc.classify(df.limit(0)), empty)
    assert warc.capture_index(spark, empty).count() == 0


def test_warc_of_large_pages_ties_and_other_columns(spark):
    large = "a page of many words " * 2_500_000
    pages = [(1, "http://a.com/", large, 1, "x"), (2, "http://a.com/", large, 2, "y"), (3, "http://a.com/x", "z", 3, "z"), (3, "http://a.com/x", "z", 3, "z"), (3, "http://a.com/x", "other", 3, "z")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, offset int, owner string")
    path = scratch.new_path(spark, "warc")
    warc.write_warc(warc.classify(df), path, archive_bytes=1000)
    index = warc.capture_index(spark, path).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in index] == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (3, "response", None), (3, "response", None)]
    assert index[1].payload_bytes == len(large) > 50 << 20


def test_loser_tree():
    random.seed(4)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(random.randrange(50) for _ in range(random.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontaminate(spark, docs, texts, nothing, monkeypatch, bound):
    import re

    monkeypatch.setattr(decontam, "BROADCAST_ROWS", bound)
    cut = lambda t: [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    by = dict(texts)
    items = [(1, " ".join(by[3].split()[5:30])), (2, by[404][1000:1400].upper()), (10, "ONE"), (11, None), (12, "..."), (1, by[6]), (None, by[8])]
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {}
    for r in decontam.decontaminate(docs, bench).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(x) for x in ids if x is not None}
        for r in got[i]:
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit)), i
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert sum(map(len, got.values())) == len(texts)
    if bound:
        assert decontam.decontaminate(nothing, bench).count() == 0
        assert decontam.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
        assert "Python" not in decontam.decontaminate(docs, bench)._jdf.queryExecution().executedPlan().toString()


def test_quality(spark, words):
    random.seed(9)
    good = [(k, " ".join(random.choice(words) for _ in range(80))) for k in range(300)]
    bad = [(1000 + k, " ".join(random.choice(words) + "!!" for _ in range(80))) for k in range(60)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (None, good[0][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good[:200]] + [(k, 0, 0) for k, _ in bad[:30]] + [(None, 1, 0), (7777, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.importance_resample(docs, labels).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == 362 and len([k for k, _ in good if k in kept]) >= 294 and len([k for k, _ in bad if k in kept]) <= 3
    top = quality.importance_resample(docs, labels, k=50)
    assert top.filter("kept").count() == 50
    keys = sorted((r.key for r in got), reverse=True)
    assert quality.kth_largest(top, 50) == keys[49] and {r.key for r in top.collect() if r.kept} == set(keys[:50])
    assert quality.importance_resample(docs.limit(0), labels).count() == 0
    assert quality.importance_resample(docs, labels.limit(0)).filter("kept").count() == 362
    assert quality.drop_poor(docs, labels).columns == docs.columns


def test_quality_weights_and_draws_against_brute_force(spark, words):
    random.seed(21)
    # from all good words to none
    rows = [(k, " ".join(random.choice(words[:150] if random.random() * 400 > k else words[150:]) for _ in range(60))) for k in range(400)]
    rows += [(400, None), (401, ""), (None, rows[0][1]), (7, rows[7][1]), (402, " ".join(words) * 100)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, key int, th string").repartition(3)
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(0, 400, 2)] + [(2, 0), (9999, 1), (3, None)], "doc_id bigint, quality int")
    got = quality.importance_resample(docs, labels).collect()
    # the models, counted by plain loops
    good = {k for k in range(0, 100, 2)}
    held = {r.doc_id for r in spark.range(100).select(F.col("id").alias("doc_id")).filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(quality.HELD_BACK)) == 0).collect()}
    raw, target = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    grams = lambda t: quality.ngram_buckets(t, quality.BUCKETS).tolist()
    for i, t in rows:
        for x in grams(t):
            raw[x] += 1
            target[x] += i in good and i not in held
    share = sum(target) / sum(raw)
    def weight(t):
        found = grams(t)
        ratios = [np.log((target[x] + quality.PRIOR) / (raw[x] * share + quality.PRIOR)) for x in found]
        return quality.LENGTH * sum(ratios) / len(found) if found else 0.0
    want = sorted(weight(t) for _, t in rows)
    assert np.allclose(sorted(r.log_weight for r in got), want) and len(got) == len(rows)
    # k: as many rows as weigh no less than the least of the good ones that were held back, and 1 % more
    kept = {(r.doc_id, r.th) for r in got if r.kept}
    probes = [r.log_weight for r in got if r.doc_id in good & held]
    assert sum(r.kept for r in got) == int(np.ceil(sum(r.log_weight >= np.quantile(probes, quality.LOST) for r in got) * (1 + quality.SLACK)))
    assert min(r.key for r in got if r.kept) > max(r.key for r in got if not r.kept)
    # another seed draws others, and those of more weight more often
    other = {(r.doc_id, r.th) for r in quality.importance_resample(docs, labels, seed=18).collect() if r.kept}
    assert kept != other
    assert np.mean([r.log_weight for r in got if r.kept]) > np.mean([r.log_weight for r in got if not r.kept])


def test_kth_largest_with_ties(spark):
    keys = spark.createDataFrame([(float(x // 3),) for x in range(300)], "key double")
    for k in (1, 2, 150, 300):
        assert quality.kth_largest(keys, k) == sorted((x // 3 for x in range(300)), reverse=True)[k - 1]


def test_counterfactual_penalty():
    own = [toxicity.features({"women", "awful", f"w{k}"}) for k in range(20)] + [toxicity.features({"nice", "day", f"v{k}"}) for k in range(20)]
    other = [toxicity.features(toxicity.swapped({"women", "awful", f"w{k}"}, toxicity.swaps(toxicity.IDENTITY_TERMS))) for k in range(20)] + [None] * 20
    labels = np.array([1.0] * 20 + [0.0] * 20)
    z = lambda fitted, words: fitted[0][toxicity.features(words)].sum() + fitted[1]
    plain, fair = toxicity.fit(labels, own, [None] * 40), toxicity.fit(labels, own, other, counterfactual=5.0)
    gap = lambda fitted: abs(z(fitted, {"women"}) - z(fitted, {"men"}))
    assert gap(plain) > 1 and gap(fair) < 0.1 and z(fair, {"awful"}) > 0 > z(fair, {"nice", "day"})


def test_toxicity(spark, words):
    random.seed(13)
    make = lambda k, bad: " ".join([random.choice(words) for _ in range(40)] + [f"scum{random.choice('xyz')}"] * bad)
    rows = [(k, make(k, k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, rows[0][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(150)] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    held = toxicity.toxic_fold(F.col("doc_id")) == 0
    got = toxicity.score_toxicity(docs, labels, ~held, held).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0), ~held, held).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels, ~held, held).count() == 0


def test_counterfactual_penalty_against_brute_force(spark, words):
    random.seed(17)
    neutral, bad = ["north", "south", "east4", "west4"], ["scum", "trash"]
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        # toxic texts name the north more often
        place = random.choice(["north"] * 6 + neutral) if toxic else random.choice(neutral)
        rows.append((k, " ".join([*random.choices(words, k=12), place, *[random.choice(bad)] * (toxic and k % 8 == 0)]), int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, label int")
    y, own, other, terms = toxicity.learn(docs, labels, [tuple(neutral)])
    assert len(y) == 400 and sum(x is not None for x in other) == 400 and terms[0] == tuple(neutral) and len(terms) > 1
    # twins by hand
    swap = toxicity.swaps(terms)
    for k in (0, 1, 8, 399):
        have = set(rows[k][1].split())
        assert toxicity.swapped(have, swap) == {swap.get(x, x) for x in have}
    free, free_bias = toxicity.fit(y, own, other, counterfactual=0.0)
    held, held_bias = toxicity.fit(y, own, other)
    before, after = toxicity.swap_change(free, own, other), toxicity.swap_change(held, own, other)
    assert before[0] == after[0] == 400 and after[1] < 0.5 * before[1]

    def loss(w, b):
        total = 0.0
        for label, x, twin in zip(y, own, other):
            z = sum(w[k] for k in x) + b
            total += (np.log1p(np.exp(-z)) if label else np.log1p(np.exp(z))) / len(y)
            total += toxicity.COUNTERFACTUAL * (sum(w[k] for k in x) - sum(w[k] for k in twin)) ** 2 / len(y)
        return total + toxicity.L1 * np.abs(w).sum()

    least = loss(held, held_bias)
    assert least < loss(free, free_bias) and least < loss(np.zeros(toxicity.BUCKETS), 0.0)
    places = np.flatnonzero(held)
    rng = np.random.default_rng(2)
    for _ in range(20):
        near = held.copy()
        near[places] += rng.normal(0, 0.05, len(places))
        assert least < loss(near, held_bias + rng.normal(0, 0.05))


def test_toxicity_of_awkward_rows(spark):
    rows = [(1, "scum " * 3 + "of the place", 1), (2, "words of the place", 2), (3, None, 3), (None, "", 4), (2, "words of the place", 5), (4, "far " * 300_000, 6), (4, "near", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 0), (9, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels, F.lit(True), F.lit(False)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1


def test_language(spark):
    random.seed(17)
    kinds = {"aa": ["the", "and", "thing", "shore"], "bb": ["der", "und", "schön", "ganz"], "cc": ["que", "los", "niño", "para"]}
    rows = [(k, " ".join(random.choice(kinds[lang]) for _ in range(30)), lang) for k in range(150) for lang in [random.choice(list(kinds))]]
    docs = spark.createDataFrame([*rows, (200, None, "aa"), (201, "12 !! ", "bb"), (202, "und ganz schön", None), (None, "los niño", "cc")], "doc_id bigint, text string, lang string")
    held = language.language_fold(F.col("doc_id")) == 2
    got = {r.doc_id: r for r in language.identify_language(docs, ~held, held).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows) and got[202].lang_pred == "bb" and got[None].lang_pred == "cc"
    assert got[200].lang_pred == got[201].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    assert {r.lang_pred for r in language.identify_language(docs.withColumn("lang", F.lit(None).cast("string")), ~held, held).collect()} == {"und"}
    assert language.identify_language(docs.limit(0), ~held, held).count() == 0


def test_language_learns_rare_ones_from_one_row_an_id(spark, monkeypatch):
    random.seed(19)
    monkeypatch.setattr(language, "TRAIN_ROWS", 20)
    kinds = {"aa": ["the", "and", "thing", "shore"], "bb": ["der", "und", "schön", "ganz"], "zz": ["kwyjibo", "xoxo", "qaqaq", "wuwu"]}
    rows = [(k, " ".join(random.choice(kinds[lang]) for _ in range(30)), lang) for k in range(1500) for lang in ["zz" if k % 500 == 0 else random.choice(["aa", "bb"])]]
    hot = [(0, rows[0][1], "zz")] * 50 + [(None, "the shore", "aa")] * 50
    docs = spark.createDataFrame(rows + hot, "doc_id bigint, text string, lang string").repartition(3)
    found = language.sampled(docs)
    assert len(found) == found["doc_id"].nunique(dropna=False) and found["lang"].value_counts().to_dict() == {"aa": 200, "bb": 200, "zz": 3}
    got = {r.doc_id: r.lang_pred for r in language.identify_language(docs, F.lit(True), F.lit(False)).collect()}
    assert all(got[k] == lang for k, _, lang in rows)


def test_toxicity_fits_on_8000_rows_one_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda labels, own, other: seen.append((len(labels), own[0].dtype)) or (np.zeros(toxicity.BUCKETS), 0.0))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"))
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    toxicity.score_toxicity(docs.unionByName(docs.limit(500)), labels, F.lit(True), F.lit(False))
    assert seen == [(8000, np.int32)]


def test_near_dedup_visits_the_same_ids_once(spark, monkeypatch):
    """Two texts meet in many trees; nodes with the same ids have the same pairs, others keep theirs."""
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, " ".join([*words, "y"])), (4, "a b c d e f g h"), (5, "a b c d e f g h i")], "doc_id long, text string")
    made, plain = {}, near_dedup.materialize

    def kept(df, name):
        made[name] = plain(df, name)
        return made[name]

    monkeypatch.setattr(near_dedup, "materialize", kept)
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    nodes = {}
    for r in made["level0"].collect():
        nodes.setdefault(r.node, []).append(r.id)
    sets = sorted(tuple(sorted(x)) for x in nodes.values())
    assert len(sets) == len(set(sets)) and (1, 2, 3) in sets and (4, 5) in sets
    # the same sum of two ids, and rows of one id twice, are other sets
    rows = spark.createDataFrame([(1, 1), (1, 4), (2, 2), (2, 3), (3, 4), (3, 1), (4, 5), (4, 5), (4, 7), (5, 6), (5, 6), (5, 7)], "node long, id long")
    assert sorted(r.node for r in near_dedup.node_sizes(rows).collect()) == [1, 2, 4, 5]
